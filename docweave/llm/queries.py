"""The queries opN_<name> over the test tables, each a thin layer on its operator, with SQL where SQL can express it."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat_format, license_scan, media_ts, mixing, near_dedup, quality, repeats, token_counts
from .common import keep, load, small_batches

JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Target weights of the mixture: domains, in them languages, in these sources (equal weights where none is named).
TREE = mixing.Node(
    {
        "core": (0.4, mixing.Node({"en": (0.6, mixing.Node({"src0": (2.0, mixing.Node())})), "de": (0.15, mixing.Node()), "fr": (0.15, mixing.Node()), "es": (0.1, mixing.Node())})),
        "wide": (0.6, mixing.Node({"en": (0.5, mixing.Node()), "de": (0.2, mixing.Node()), "fr": (0.2, mixing.Node()), "es": (0.1, mixing.Node())})),
    }
)


def domain() -> Column:
    """The first sources are the core, the others the wide web."""
    return F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), "core").otherwise("wide")


#: The mixture: a budget of four fifths of all tokens, each leaf at most four times.
MIXTURE = {"share": 0.8, "max_epochs": 4, "seed": 11}


def tokens() -> Column:
    return token_counts.library_tokens(F.col("text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def mixture(docs: DataFrame) -> DataFrame:
    """docs with mix_copies: how often each row is taken."""
    small_batches(docs.sparkSession)
    return mixing.mix(docs, [domain(), F.col("lang"), F.col("source")], TREE, tokens(), copies_col="mix_copies", **MIXTURE)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(JSON), public_tokenizers.PATTERN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once, for their tokens; the mixture works on what is kept of each row."""
    small_batches(spark)
    slim = keep(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", domain().alias("domain"), tokens().alias("n_tokens")))
    out = mixing.mix(slim, [F.col("domain"), F.col("lang"), F.col("source")], TREE, F.col("n_tokens"), **MIXTURE)
    return out.select("doc_id", "lang", "source", "domain", "n_tokens", "n_copies")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(JSON))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.digest(media_ts.store(load(spark, sf_dir, "documents")))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(load(spark, sf_dir, "documents"), 400)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    records = rows.unionByName(extra).select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat_format.digest_conversations(chat_format.to_turns(records, "record", ["conv_id", "turn"]))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.fit_on(docs, load(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(quality.holdout(F.col("doc_id")), F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict:
    own = (op1_token_counts, op2_mixing, op3_byte_bpe, op4_license_scan, op5_media, op6_repeats, op7_nearest, op8_chat, op9_near_dedup, op10_quality)
    return {f.__name__: f for f in own}


def _license_sql() -> str:
    """The same rules in DuckDB's dialect: sentences by regular expressions, then a chain of replacements."""
    known = ", ".join(f"('{s}', '{k}')" for k, many in license_scan.SENTENCES.items() for s in many)
    steps, at = [], "s0"
    for i, (_, rule) in enumerate(license_scan.RULES, 1):
        want = " " + "  ".join(rule) + " "
        hits = "".join(f", h{j}" for j in range(1, i))
        steps.append(f"s{i} AS (SELECT doc_id, n, ids, replace(rest, '{want}', ' # ') AS rest{hits}, contains(rest, '{want}') AS h{i} FROM {at})")
        at = f"s{i}"
    names = list(dict.fromkeys(n for n, _ in license_scan.RULES))
    order = sorted(names, key=lambda n: min(i for i, (x, _) in enumerate(license_scan.RULES) if x == n))
    shown = ", ".join(f"CASE WHEN {' OR '.join(f'h{i}' for i, (x, _) in enumerate(license_scan.RULES, 1) if x == n)} THEN '{n}' END" for n in order)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
lines AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g') AS t FROM documents),
normal AS (SELECT doc_id, list_transform(string_split(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}.+\\-\\n]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^[ .+\\-]+|[ .+\\-]+$', '', 'g')) AS s FROM lines),
placed AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM normal),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY pos) AS ids, string_agg(' ' || id || ' ', '' ORDER BY pos) AS rest FROM placed JOIN known USING (sentence) GROUP BY doc_id),
s0 AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(rest, '  ') AS rest FROM documents d LEFT JOIN found USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') AS licenses,
  len(list_filter(string_split(rest, ' '), lambda x: x NOT IN ('', '#'))) AS n_parts
FROM {at}"""


#: Strings of 400 bytes as hex, by a hash; starts that come twice; runs of covered bytes; what is left.
_REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, o, substr(h, 2 * o + 1, 2798) AS h, least(1000, n - o) AS n FROM (SELECT r, h, length(h) // 2 - 399 AS n, unnest(range(0, greatest(length(h) // 2 - 399, 0), 1000)) AS o FROM d)),
s AS (SELECT r, o + i AS i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, o, h, unnest(range(n)) AS i FROM p)),
t AS (SELECT r, i FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM t),
u AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
c AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM u GROUP BY r, run),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM c),
left_ AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS runs FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)"""

#: Turns in order; control strings in texts are counted, since each gets one character more.
def _chat_sql() -> str:
    marks = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(chat_format.CONTROLS, key=len, reverse=True))
    wraps = {"assistant": (chat_format.BEGIN, chat_format.END), "user": (chat_format.USER, chat_format.USER_END), "system": (chat_format.SYSTEM, chat_format.SYSTEM_END)}
    wrap = " ".join(f"WHEN '{role}' THEN {len(a + b)}" for role, (a, b) in wraps.items())
    other = len(chat_format.ROLE + chat_format.ROLE_END + chat_format.END)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '{marks}')) + CASE role {wrap} ELSE {other} + length(role) + len(regexp_extract_all(role, '{marks}')) END AS chars, role = 'assistant' AS loss FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (loss), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


#: Shingle sets by an inverted list, links, and the smallest id that each reaches.
_NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS id, a AS other FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
least_ AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": _license_sql(), "op6_repeats": _REPEATS_SQL, "op8_chat": _chat_sql(), "op9_near_dedup": _NEAR_SQL}
