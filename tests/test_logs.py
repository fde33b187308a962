import io
import json

import pytest

from docweave import logs


def test_json_lines_and_times():
    out = io.StringIO()
    logs.configure(stream=out)
    with logs.timed("ingest", kb="k") as request:
        pass
    with pytest.raises(OSError), logs.timed("query"):
        raise OSError("no")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["event"] == "ingest" and first["kb"] == "k" and first["request_id"] == request and first["ms"] >= 0
    assert second["event"] == "query_failed" and second["level"] == "error" and "OSError" in second["error"]
