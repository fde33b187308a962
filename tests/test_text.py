import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import html as H
from docweave.functions import text as T
from docweave.functions import vectors as V
from docweave.functions.clean import clean


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.drop_controls, "hello\x00world\x1f!", "helloworld!"),
        (T.drop_controls, "a\tb\nc\x7f", "a\tb\nc"),
        (T.normalize_whitespace, "  a  \t b \n\n\n\n c ", "a b\n\n c"),
        (T.token_estimate, "", 0),
        (T.token_estimate, "one", 1),
        (T.token_estimate, "a b c", 4),
        (T.paragraphs, "a\n \nb\n\n\n\nc d", ["a", "b", "c d"]),
        (T.sentences, "One. Two!  Three? four", ["One.", "Two!", "Three?", "four"]),
        (T.tokenize, "Cats boxes companies glass bus été_x", ["cat", "box", "company", "glass", "bus", "été_x"]),
        (T.excerpt, " short ", "short"),
        (T.extension, "/a/b.C.TXT", ".txt"),
        (T.extension, "/a.b/c", ""),
        (T.http_date, "Thu, 01 Jan 2026 00:00:00 GMT", None),
        (H.clean_html, "<html><title>T</title><nav>n</nav><p>a <b>b</b><!-- c -->d&amp;e</p><script>x</script><br>f", "T\na\nb\nd&e\nf"),
        (H.title, "<title>\n A &amp; B </title>", "A & B"),
        (H.title, "<p>", None),
    ],
)
def test_functions(spark, f, value, want):
    got = one(spark, f, value)
    if f is T.http_date:
        assert got.isoformat() == "2026-01-01T00:00:00"
    else:
        assert got == want


def test_nulls_stay_null(spark):
    for f in (T.normalize_whitespace, T.content_hash, H.clean_html, H.title, T.excerpt):
        assert one(spark, f, None) is None


def test_stems(spark):
    for word, stem in {"cats": "cat", "boxes": "box", "companies": "company", "glass": "glass", "bus": "bus", "ties": "tie", "matches": "match", "wishes": "wish", "as": "as"}.items():
        assert one(spark, T.light_stem, word) == stem


def test_excerpt_is_cut(spark):
    got = one(spark, lambda c: T.excerpt(c, 50), "word " * 200)
    assert got.endswith("...") and len(got) <= 54


def test_hash_is_of_cleaned_text(spark):
    raw = spark.createDataFrame([("Ｐlain   text\x00 with noise", "txt"), ("<p>x\x00y</p><style>z</style>", "html")], "c string, t string")
    got = [r[0] for r in raw.select(T.content_hash(T.normalize_whitespace(clean(F.col("c"), F.col("t"))))).collect()]
    assert got == [hashlib.sha256(s.encode()).hexdigest() for s in ("Plain text with noise", "xy")]


def test_markdown_table(spark):
    df = spark.createDataFrame([([["name", "role"], ["a"], ["b", "c", "d"]],), ([],)], "r array<array<string>>")
    assert [r[0] for r in df.select(T.markdown_table(F.col("r"))).collect()] == ["| name | role |\n| --- | --- |\n| a |  |\n| b | c |", ""]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 2.0, 9.0], [2.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.dot(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 4.0]
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()][:2] == [1.0, 0.0]
    unit = df.select(V.norm(V.hashed_embedding(F.array(F.lit("x"), F.lit("y")), 8))).first()[0]
    assert abs(unit - 1) < 1e-12


def test_white_space_is_pythons(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert all(re.match(r"\s", c) for c in spaces)
    assert one(spark, T.strip, "".join(spaces) + "x" + "".join(spaces)) == "x"
