"""Logging as JSON lines or plain text, and timed steps."""

from __future__ import annotations

import json
import logging
import sys
import time
import uuid
from contextlib import contextmanager

logger = logging.getLogger("docweave")
_OWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonFormatter(logging.Formatter):
    """One JSON object a line: time, level, event and the record's extra fields."""

    def format(self, record: logging.LogRecord) -> str:
        more = {k: v for k, v in record.__dict__.items() if k not in _OWN}
        body = {"time": self.formatTime(record), "level": record.levelname.lower(), "event": record.getMessage()} | more
        if record.exc_info:
            body["error"] = self.formatException(record.exc_info)
        return json.dumps(body, default=str)


def configure(level: str = "INFO", as_json: bool = True, stream=None) -> None:
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger.handlers[:] = [handler]
    logger.setLevel(level)
    logger.propagate = False


@contextmanager
def timed(event: str, **more):
    """Log an event with its id and milliseconds; a failure is logged as one and raised."""
    began, request = time.perf_counter(), uuid.uuid4().hex
    try:
        yield request
    except Exception:
        logger.exception(f"{event}_failed", extra=more | {"request_id": request, "ms": round((time.perf_counter() - began) * 1000, 1)})
        raise
    logger.info(event, extra=more | {"request_id": request, "ms": round((time.perf_counter() - began) * 1000, 1)})
