import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Texts that each operator on documents must take: null, empty, blank, one word, repeated rows, ties, long, and other scripts.
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
PASSAGE = "the passage that is shared by several texts " * 12
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, LONG), (9, LONG + " end"),
    (10, "head " + PASSAGE + " tail"), (11, PASSAGE), (12, "é ß 漢字 ｗｉｄｅ 😀 ͸ \U0001e7e0"), (13, "<|endoftext|> x <|endoftext|><|endoftext|>"), (14, "aaaa" * 400), (15, "A  b\x0bc"), (None, "no id"), (16, "don't   stop  "),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all odd cases, and columns named like the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), 1.0, 7, b"x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, key binary")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
