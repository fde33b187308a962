"""Each query over the small tables returns its columns, a row for each row it should."""

import pytest

from docweave.llm import queries

COLUMNS = {
    "op1": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2": ["doc_id", "lang", "source", "domain", "n_tokens", "n_copies"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "n_sentences", "sentence_ids", "licenses", "n_parts"],
    "op5": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op6": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7": ["query_id", "rank", "vec_id", "score"],
    "op8": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    number = name.split("_")[0]
    assert df.columns == COLUMNS[number]
    n = df.count()
    if number == "op7":
        assert n == 25 * 20
    elif number == "op8":
        assert n == spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        assert n == spark.read.parquet(f"{small}/documents.parquet").count()
