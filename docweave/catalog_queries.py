"""Queries over the test tables, one for each operator, with the SQL that gives the same rows.

Documents are raw documents of knowledge base ``source`` with the URI doc://<id>; pages are websites; a conversation is a
document of its turns.  Vectors of text are the hashing stand-in's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html as H
from .functions import text as T
from .functions import vectors as V
from .functions.clean import clean
from .operators import answers as A
from .operators import chunk as C
from .operators import evaluate as E
from .operators import retrieval as R
from .operators import tables as K
from .operators.catalog import changed, from_iso, iso
from .operators.embed import hashing_model, split_by_cache
from .operators.vector_table import PAYLOAD, VectorTable, from_payload, to_payload
from .plans import ingest as P
from .sources.files import loader_of, mime_of, raw_rows
from .sources import tables as T_
from .sources.pages import load_pages
from .storage import scratch
from .streaming import ingest as S

_QUERIES, _SQL = {}, {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


#: The key by which a large table is dealt out where its file can't be split.
_SPREAD = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, d: str, name: str, *by: str) -> DataFrame:
    return T_.table(spark, d, name, *(by or filter(None, [_SPREAD.get(name)])))


# Pieces of SQL.
def sql_strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_tokens(x):
    stem = r"CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(xes|ches|shes|ses)$') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"
    return rf"list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: {stem})"


def sql_estimate(x):
    n = rf"len(regexp_extract_all({x}, '\S+'))"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, round({n} / 0.75::DOUBLE)::INT) END"


def sql_sentences(x):
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_paragraphs(x):
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '\n\s*\n', chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_excerpt(x):
    s = sql_strip(x)
    return rf"CASE WHEN length({s}) > 240 THEN regexp_replace(left({s}, 240), '\s+$', '') || '...' ELSE {s} END"


_CONV = r"conv AS (SELECT conv_id AS id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"
_HEADED = r"conv AS (SELECT conv_id AS id, string_agg('# ' || role || ' ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"


def conversations(spark, d, headed=False):
    text = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text") if headed else F.col("text")
    turns = F.array_sort(F.collect_list(F.struct("turn", text.alias("t"))))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(turns, lambda x: x["t"]), "\n\n").alias("content"))


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"), F.col("source").alias("kb"), "lang")


def chunk_rows(spark, d):
    """Documents as one chunk each."""
    return documents(spark, d).select(F.format_string("%012d", "doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "content", "source_uri", F.col("lang").alias("title"), "kb")


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Cleaning, hashing and text functions.


@query(r"SELECT doc_id, regexp_replace(left(text, 10) || chr(7) || substr(text, 11) || chr(31) || chr(9), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS content FROM documents")
def clean_control_chars(spark, d):
    noisy = F.concat(F.substring("content", 1, 10), F.lit("\x07"), F.expr("substr(content, 11)"), F.lit("\x1f\t"))
    return documents(spark, d).select("doc_id", T.drop_controls(noisy).alias("content"))


_NOISY = r"'  ' || replace(replace(text, chr(10), ' ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10)), '. ', '.' || chr(9) || '  ') || chr(10)"


@query(rf"WITH n AS (SELECT doc_id, {_NOISY} AS t FROM documents) SELECT doc_id, {sql_strip(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM n")
def normalize_whitespace(spark, d):
    noisy = F.concat(F.lit("  "), F.replace(F.replace("content", F.lit("\n"), F.lit(" \t\n\n\n\n")), F.lit(". "), F.lit(".\t  ")), F.lit("\n"))
    return documents(spark, d).select("doc_id", T.normalize_whitespace(noisy).alias("content"))


def _page_text_sql():
    x = "html"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', chr(1), 'g')"
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "svg", "form"):
        x = rf"regexp_replace({x}, '(?s)<{tag}[ >].*?</{tag}>', chr(1), 'g')"
    x = rf"regexp_replace({x}, '<[^>]*>', chr(1), 'g')"
    for name, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {sign})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(10))"


@query(f"SELECT page_id, {_page_text_sql()} AS content FROM pages")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", H.clean_html(F.col("html")).alias("content"))


def sql_title(x):
    return sql_strip(f"replace(replace(replace(replace(replace(regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")


@query(f"SELECT page_id, {sql_title('html')} AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, sha256({_page_text_sql()}) AS content_hash FROM pages")
def html_hash(spark, d):
    return table(spark, d, "pages").select("page_id", T.content_hash(H.clean_html(F.col("html"))).alias("content_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return documents(spark, d).select("doc_id", T.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    return documents(spark, d).groupBy(T.content_hash(F.col("content")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"SELECT doc_id, {sql_estimate('text')} AS n_tokens FROM documents")
def token_count(spark, d):
    return documents(spark, d).select("doc_id", T.token_estimate(F.col("content")).alias("n_tokens"))


@query(f"WITH {_CONV}, p AS (SELECT id, {sql_paragraphs('content')} AS p FROM conv) SELECT id, unnest(range(len(p)))::INT AS pos, unnest(p) AS paragraph FROM p")
def paragraphs(spark, d):
    return conversations(spark, d).select("id", F.posexplode(T.paragraphs(F.col("content"))).alias("pos", "paragraph"))


@query(f"WITH s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM s")
def sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n, md5(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents")
def tokenize_stem(spark, d):
    return documents(spark, d).select("doc_id", T.tokenize(F.col("content")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH t AS (SELECT unnest({sql_tokens('text')}) AS term, doc_id FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY term")
def term_freq(spark, d):
    posts = R.postings(chunk_rows(spark, d))
    return posts.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query("""SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS content FROM nation""")
def csv_markdown_table(spark, d):
    """The rows of a small dimension as one CSV-like table, ragged: the last cell is missing."""
    rows = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"), F.lit("n_regionkey"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select(T.markdown_table(cells).alias("content"))


_URIS = "SELECT url AS uri FROM pages UNION ALL SELECT '/kb/' || source || '/file' || doc_id || (ARRAY['.txt', '.MD', '.csv', '.html', '.pdf', '.docx', '.png', '.xyz', ''])[(doc_id % 9 + 1)::INT] FROM documents"


def _uris(spark, d):
    ends = F.array(*(F.lit(x) for x in (".txt", ".MD", ".csv", ".html", ".pdf", ".docx", ".png", ".xyz", "")))
    paths = documents(spark, d).select(F.concat(F.lit("/kb/"), "kb", F.lit("/file"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 9).cast("int"))).alias("uri"))
    return table(spark, d, "pages").select(F.col("url").alias("uri")).unionAll(paths)


@query(rf"""WITH u AS ({_URIS}), e AS (SELECT uri, lower(regexp_extract(uri, '[^/](\.[^./]+)$', 1)) AS ext FROM u)
SELECT uri, CASE WHEN regexp_matches(uri, '^(?i:https?)://') THEN 'website' WHEN ext = '.txt' THEN 'txt' WHEN ext = '.md' THEN 'markdown' WHEN ext = '.csv' THEN 'csv' WHEN ext = '.html' THEN 'html'
WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.docx' THEN 'docx' WHEN ext = '.png' THEN 'image' END AS source_type FROM e""")
def resolve_loader(spark, d):
    return _uris(spark, d).select("uri", loader_of(F.col("uri")).alias("source_type"))


@query(rf"""WITH u AS ({_URIS}), e AS (SELECT uri, lower(regexp_extract(uri, '[^/](\.[^./]+)$', 1)) AS ext FROM u)
SELECT uri, CASE ext WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.csv' THEN 'text/csv' WHEN '.html' THEN 'text/html' WHEN '.pdf' THEN 'application/pdf'
WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.png' THEN 'image/png' END AS mime_type FROM e""")
def mime_type(spark, d):
    return _uris(spark, d).select("uri", mime_of(F.col("uri")).alias("mime_type"))


@query(r"""SELECT page_id, 'text/html' AS mime_type, CASE WHEN page_id % 2 = 0 THEN page_id ELSE strlen(html) END AS file_size_bytes, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' END AS modified_at FROM pages""")
def http_headers(spark, d):
    pages = table(spark, d, "pages").select(
        "page_id", "url", "html", F.lit(" text/html ; charset=utf-8").alias("content_type"),
        F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise("?").alias("content_length"),
        F.when(F.col("page_id") % 3 == 0, "Thu, 01 Jan 2026 00:00:00 GMT").otherwise("soon").alias("last_modified"),
    )
    size = T.length_of_header(F.col("content_length"), F.col("html"))
    return pages.select("page_id", T.mime_of_header(F.col("content_type")).alias("mime_type"), size.alias("file_size_bytes"), T.http_date(F.col("last_modified")).cast("timestamp_ntz").alias("modified_at"))


@query(f"SELECT url AS source_uri, 'website' AS source_type, sha256({_page_text_sql()}) AS content_hash, strlen(html) AS file_size_bytes FROM pages")
def process_pages(spark, d):
    """Pages through loader, cleaner, normaliser and hash."""
    done = P.process(load_pages(table(spark, d, "pages").select("url", "html"), "web"))
    return done.select("metadata.source_uri", "metadata.source_type", "metadata.content_hash", "metadata.file_size_bytes")


@query(f"SELECT doc_id, {sql_strip('text')} AS content FROM documents")
def clean_documents(spark, d):
    return documents(spark, d).select("doc_id", T.normalize_whitespace(clean(F.col("content"), F.lit("txt"))).alias("content"))


# Chunkers.


def _units_sql(src: str, size: int) -> str:
    """(id, i, t, n, solo): paragraphs, or the sentences or pieces of one over the budget."""
    hard = f"list_transform(range(ceil(length(x) / {3 * size}.0)::INT), lambda k: substr(x, (k * {3 * size} + 1)::INT, {3 * size}))"
    est = sql_estimate
    return rf"""
paras AS (SELECT id, unnest(p) AS x, unnest(range(len(p))) AS a FROM (SELECT id, {sql_paragraphs('content')} AS p FROM {src})),
parts AS (SELECT id, a, x AS t, 0 AS b, 0 AS c, false AS solo FROM paras WHERE {est('x')} <= {size}
  UNION ALL SELECT id, a, unnest(CASE WHEN {est('s')} > {size} THEN {hard.replace('(x', '(s')} ELSE [s] END), b, unnest(range(CASE WHEN {est('s')} > {size} THEN ceil(length(s) / {3 * size}.0)::INT ELSE 1 END)), true
    FROM (SELECT id, a, unnest(s) AS s, unnest(range(len(s))) AS b FROM (SELECT id, a, {sql_sentences('x')} AS s FROM paras WHERE {est('x')} > {size}) WHERE len(s) > 1)
  UNION ALL SELECT id, a, unnest({hard}), 0, unnest(range(ceil(length(x) / {3 * size}.0)::INT)), true FROM (SELECT id, a, x, {sql_sentences('x')} AS s FROM paras WHERE {est('x')} > {size}) WHERE len(s) <= 1),
units AS (SELECT id, t, {est('t')} AS n, solo, row_number() OVER (PARTITION BY id ORDER BY a, b, c) AS i, count(*) OVER (PARTITION BY id) AS m FROM parts)"""


def _fold_sql(size: int, overlap: int) -> str:
    """(id, outs): chunk texts of units."""
    words = r"regexp_extract_all(f.cur, '\S+')"
    tail = f"array_to_string({words}[greatest(len({words}) - {overlap}, 0) + 1:], ' ')"
    return rf"""
fold AS (SELECT DISTINCT id, 0::BIGINT AS i, []::VARCHAR[] AS outs, NULL::VARCHAR AS cur, 0 AS ct, m FROM units
  UNION ALL SELECT f.id, u.i,
    CASE WHEN u.solo THEN (CASE WHEN f.cur IS NULL THEN f.outs ELSE list_append(f.outs, f.cur) END) || [u.t] WHEN f.ct + u.n > {size} AND f.cur IS NOT NULL THEN list_append(f.outs, f.cur) ELSE f.outs END,
    CASE WHEN u.solo THEN NULL WHEN f.ct + u.n > {size} AND f.cur IS NOT NULL THEN CASE WHEN {tail} = '' THEN u.t ELSE {tail} || ' ' || u.t END WHEN f.cur IS NULL THEN u.t ELSE f.cur || ' ' || u.t END,
    CASE WHEN u.solo THEN 0 WHEN f.ct + u.n > {size} AND f.cur IS NOT NULL THEN {sql_estimate(tail)} + u.n ELSE f.ct + u.n END, f.m
  FROM fold f JOIN units u ON u.id = f.id AND u.i = f.i + 1),
done AS (SELECT id, CASE WHEN cur IS NULL THEN outs ELSE list_append(outs, cur) END AS o FROM fold WHERE i = m)"""


def _chunk_sql(src: str, cte: str, size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {cte}, {_units_sql(src, size)}, {_fold_sql(size, overlap)}, flat AS (SELECT id, unnest(o) AS content, unnest(range(len(o)))::INT AS chunk_index FROM done)
SELECT id, chunk_index, {sql_estimate('content')} AS token_count, md5(content) AS digest FROM flat WHERE {sql_strip('content')} <> ''"""


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "chunk_index", "token_count", F.md5("content").alias("digest"))


_DOCS = "docs AS (SELECT doc_id AS id, text AS content FROM documents)"


@query(_chunk_sql("docs", _DOCS, 512, 64))
def chunk_recursive(spark, d):
    return _shown(C.chunk_recursive(documents(spark, d).select(F.col("doc_id").alias("id"), "content")))


@query(_chunk_sql("conv", _CONV, 64, 8))
def chunk_recursive_overlap(spark, d):
    return _shown(C.chunk_recursive(conversations(spark, d), 64, 8))


@query(_chunk_sql("docs", "docs AS (SELECT doc_id AS id, replace(replace(replace(text, '.', ','), '!', ','), '?', ',') AS content FROM documents)", 100, 10))
def chunk_hard_split(spark, d):
    """Texts without sentence ends, so that long ones are cut by length."""
    flat = F.translate("content", ".!?", ",,,")
    return _shown(C.chunk_recursive(documents(spark, d).select(F.col("doc_id").alias("id"), flat.alias("content")), 100, 10))


_SECTIONS = rf"""secs AS (SELECT id * 100000 + k AS id, id AS doc, k, s AS content FROM (SELECT id, unnest(x) AS s, unnest(range(len(x))) AS k FROM (
  SELECT id, list_filter(list_transform(string_split(regexp_replace(chr(10) || content, '\n#{{1,6}}\s+', chr(1), 'g'), chr(1)), lambda s: regexp_replace({sql_strip('s')}, '[ ]*\n\s*', chr(10))), lambda s: s <> '') AS x FROM conv)))"""


@query(
    f"""WITH RECURSIVE {_HEADED}, {_SECTIONS}, fit AS (SELECT * FROM secs WHERE {sql_estimate('content')} <= 128), big AS (SELECT * FROM secs WHERE {sql_estimate('content')} > 128),
{_units_sql('big', 128)}, {_fold_sql(128, 16)},
flat AS (SELECT id, unnest(o) AS content, unnest(range(len(o))) AS c FROM done UNION ALL SELECT id, content, 0 FROM fit),
named AS (SELECT id // 100000 AS id, content, (row_number() OVER (PARTITION BY id // 100000 ORDER BY id, c) - 1)::INT AS chunk_index FROM flat WHERE {sql_strip('content')} <> '')
SELECT id, chunk_index, {sql_estimate('content')} AS token_count, md5(content) AS digest FROM named"""
)
def chunk_structural(spark, d):
    """Conversations with a heading for each turn, which has a body always."""
    return _shown(C.chunk_structural(conversations(spark, d, headed=True), 128, 16))


@query(
    rf"""WITH RECURSIVE s AS (SELECT id, unnest(s) AS t, unnest(range(len(s))) AS i, len(s) AS m FROM (SELECT doc_id AS id, {sql_sentences('text')} AS s FROM documents)),
b AS (SELECT id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, count(*)::DOUBLE AS c FROM (SELECT id, i, unnest({sql_tokens('t')}) AS w FROM s) GROUP BY ALL),
nrm AS (SELECT id, i, sqrt(sum(c * c)) AS z FROM b GROUP BY ALL),
dots AS (SELECT x.id, y.i, sum(x.c * y.c) AS v FROM b x JOIN b y ON x.id = y.id AND y.i = x.i + 1 AND x.k = y.k GROUP BY ALL),
u AS (SELECT s.id, s.i, s.t, s.m, {sql_estimate('s.t')} AS n, round(coalesce(v / (n1.z * n2.z), 0), 9) >= 0.3 AS near FROM s LEFT JOIN dots USING (id, i) LEFT JOIN nrm n1 ON n1.id = s.id AND n1.i = s.i LEFT JOIN nrm n2 ON n2.id = s.id AND n2.i = s.i - 1),
f AS (SELECT id, 0::BIGINT AS i, 0 AS g, n AS ct FROM u WHERE i = 0
  UNION ALL SELECT f.id, u.i, CASE WHEN u.near AND f.ct + u.n <= 96 THEN f.g ELSE f.g + 1 END, CASE WHEN u.near AND f.ct + u.n <= 96 THEN f.ct + u.n ELSE u.n END FROM f JOIN u ON u.id = f.id AND u.i = f.i + 1)
SELECT f.id, f.g AS chunk_index, sum(u.n)::INT AS token_count, md5(string_agg(u.t, ' ' ORDER BY u.i)) AS digest FROM f JOIN u ON u.id = f.id AND u.i = f.i GROUP BY f.id, f.g"""
)
def chunk_semantic(spark, d):
    return _shown(C.chunk_semantic(documents(spark, d).select(F.col("doc_id").alias("id"), "content"), threshold=0.3, size=96))


# Vectors and dense search.


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.format_string("%012d", "vec_id").alias("chunk_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def centroids(spark, d):
    """The mean vector of each label, a query each."""
    long = vectors(spark, d).select("label", F.posexplode("vector").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    return long.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("vector"))


_CENT = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), cx AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS p FROM v) GROUP BY label, p), cent AS (SELECT label::BIGINT AS query_id, list(x ORDER BY p) AS q FROM cx GROUP BY label)"


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, round(list_cosine_similarity(e, p), 6) AS cosine FROM v WHERE p IS NOT NULL")
def cosine_pairs(spark, d):
    """Each vector with that of the next smaller id, whatever gaps there are.

    Ids are dealt to blocks of a thousand, so that no task orders them all.  A block's first vector meets the last one of the
    blocks before: that is found among one row for each block.
    """
    v = vectors(spark, d).select("vec_id", "vector", F.floor(F.col("vec_id") / 1000).alias("block"))
    inside = v.withColumn("p", F.lag("vector").over(Window.partitionBy("block").orderBy("vec_id")))
    # Blocks are a thousandth of the rows, and blocks of blocks would be a thousandth of these.
    last = v.groupBy("block").agg(F.max_by("vector", "vec_id").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("block"))).select("block", "before")
    rows = inside.join(last, "block").withColumn("p", F.coalesce("p", "before")).where("p is not null")
    return rows.select("vec_id", F.round(V.cosine(F.col("vector"), F.col("p")), 6).alias("cosine"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(list_cosine_similarity(e, list_transform(range(64), lambda i: 1.0::DOUBLE / (i + 1))), 6) AS score FROM v ORDER BY list_cosine_similarity(e, list_transform(range(64), lambda i: 1.0::DOUBLE / (i + 1))) DESC, vec_id LIMIT 20")
def knn_topk(spark, d):
    return R.search_one(vectors(spark, d), [1.0 / (i + 1) for i in range(64)], 20).select("vec_id", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings) SELECT vec_id, label, round(list_cosine_similarity(e, list_transform(range(64), lambda i: 1.0::DOUBLE / (i + 1))), 6) AS score FROM v WHERE label = 3 ORDER BY list_cosine_similarity(e, list_transform(range(64), lambda i: 1.0::DOUBLE / (i + 1))) DESC, vec_id LIMIT 10")
def knn_filtered(spark, d):
    return R.search_one(vectors(spark, d), [1.0 / (i + 1) for i in range(64)], 10, {"label": 3}).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {_CENT}, s AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS score FROM v, cent), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def knn_batch(spark, d):
    out = R.search_dense(vectors(spark, d), centroids(spark, d), 10)
    return out.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) AS dims FROM embeddings")
def vector_json(spark, d):
    """Vectors through JSON text and back."""
    back = V.from_json(V.to_json(F.col("vector")))
    return vectors(spark, d).select("vec_id", F.round(V.norm(back), 6).alias("norm"), F.size(back).cast("long").alias("dims"))


@query("SELECT event_id, ts FROM events")
def timestamp_iso(spark, d):
    return table(spark, d, "events").select("event_id", from_iso(iso(F.col("ts").cast("timestamp"))).cast("timestamp_ntz").alias("ts"))


# Sparse and hybrid search.

_POST = f"""tok AS (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT doc_id, len(ts) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
fl AS (SELECT avg(raw) * 0.25 AS fl FROM raw), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN fl ELSE raw END AS idf FROM raw, fl)"""
_ASK = f"qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL)"
_SPARSE = """sc AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def _top_sql(src, k, name):
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k})"


@query(f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    words = R.vocabulary(chunk_rows(spark, d)).persist()
    return R.idf(words, R.corpus_stats(words)).select("term", "df", F.round("idf", 6).alias("idf"))


_ONE = "qt AS (SELECT 0 AS query_id, unnest(['the', 'eder', 'license', 'the']) AS term), "


@query(f"WITH {_POST}, {_ONE.replace('qt AS (SELECT', 'qq AS (SELECT')} qt AS (SELECT query_id, term, count(*) AS qf FROM qq GROUP BY ALL), {_SPARSE}, {_top_sql('sc', 20, 'r')} SELECT doc_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE score > 0")
def bm25_topk(spark, d):
    ask = spark.createDataFrame([(0, "The eders license the")], "query_id long, text string")
    out = R.BM25Index(chunk_rows(spark, d)).search(ask, 20)
    return out.select(F.col("chunk_id").cast("long").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_POST}, {_ASK}, {_SPARSE}, {_top_sql('sc', 10, 'r')} SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE score > 0")
def bm25_batch(spark, d):
    out = R.BM25Index(chunk_rows(spark, d)).search(items(spark, d), 10)
    return out.select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


_RERANK = f"""cand AS (SELECT query_id, doc_id, score FROM r), ct AS (SELECT query_id, doc_id, ts FROM cand JOIN tok USING (doc_id)),
cpost AS (SELECT query_id, doc_id, term, count(*) AS tf FROM (SELECT query_id, doc_id, unnest(ts) AS term FROM ct) GROUP BY ALL),
cst AS (SELECT query_id, count(*) AS n, avg(len(ts)) AS avgdl FROM ct GROUP BY query_id),
craw AS (SELECT query_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM cpost JOIN cst USING (query_id) GROUP BY query_id, term),
cfl AS (SELECT query_id, avg(raw) * 0.25 AS fl FROM craw GROUP BY query_id),
cidf AS (SELECT query_id, term, CASE WHEN raw < 0 THEN fl ELSE raw END AS idf FROM craw JOIN cfl USING (query_id)),
csc AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN cpost USING (query_id, term) JOIN cidf USING (query_id, term) JOIN dl USING (doc_id) JOIN cst USING (query_id) GROUP BY ALL),
rr AS (SELECT query_id, doc_id, score, coalesce(s, 0) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, round(score, 9) DESC, doc_id) AS rank FROM cand LEFT JOIN csc USING (query_id, doc_id))"""


@query(f"WITH {_POST}, {_ASK}, {_SPARSE}, {_top_sql('sc', 20, 'r')}, {_RERANK} SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score FROM rr WHERE rank <= 5")
def rerank_bm25(spark, d):
    rows = chunk_rows(spark, d)
    found = R.with_chunks(R.BM25Index(rows).search(items(spark, d), 20), rows, items(spark, d))
    out = R.rerank_bm25(items(spark, d), found, 5)
    return out.select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"))


@query("SELECT event_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (value - lo) / (hi - lo) END, 6) AS score FROM (SELECT event_id, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)")
def minmax_norm(spark, d):
    return table(spark, d, "events").select("event_id", F.round(V.min_max(F.col("value"), Window.partitionBy("event_type")), 6).alias("score"))


_DENSE = f"""tb AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS k, sum(tf)::DOUBLE AS c FROM post GROUP BY ALL), tn AS (SELECT doc_id, sqrt(sum(c * c)) AS z FROM tb GROUP BY doc_id),
qb AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS k, sum(qf)::DOUBLE AS c FROM qt GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(c * c)) AS z FROM qb GROUP BY query_id),
de AS (SELECT query_id, doc_id, sum(tb.c * qb.c) / (any_value(tn.z) * any_value(qn.z)) AS score FROM tb JOIN qb USING (k) JOIN tn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id)"""
_SIDES = f"{_POST}, {_ASK}, {_SPARSE}, {_DENSE}, {_top_sql('de', 20, 'dt')}, {_top_sql('sc', 20, 'sp0')}, sp AS (SELECT * FROM sp0 WHERE score > 0)"
_FUSED = """mm AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM dt WINDOW w AS (PARTITION BY query_id)),
ms AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM sp WINDOW w AS (PARTITION BY query_id)),
fu AS (SELECT query_id, doc_id, coalesce(d, 0) AS d, coalesce(s, 0) AS s FROM mm FULL OUTER JOIN ms USING (query_id, doc_id))"""


def _embedded(spark, d):
    """Documents and queries with vectors."""
    embed = hashing_model(64)
    return chunk_rows(spark, d).withColumn("vector", embed(F.col("content"))), items(spark, d).withColumn("vector", embed(F.col("text")))


def _both(spark, d):
    """Dense and sparse results."""
    rows, asks = _embedded(spark, d)
    return R.search_dense(rows, asks, 20), R.BM25Index(rows.drop("vector")).search(asks, 20)


@query(f"WITH {_SIDES}, {_FUSED} SELECT query_id, doc_id, round(0.5 * d + 0.5 * s, 5) AS score FROM fu")
def hybrid_fuse(spark, d):
    return R.fuse(*_both(spark, d)).select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 5).alias("score"))


@query(f"WITH {_SIDES}, {_FUSED}, al AS (SELECT unnest([0.0, 0.25, 0.75, 1.0]::DOUBLE[]) AS alpha) SELECT alpha, query_id, round(avg(alpha * d + (1 - alpha) * s), 5) AS mean_score, count(*) AS n FROM fu, al GROUP BY alpha, query_id")
def hybrid_alpha_sweep(spark, d):
    """Both sides are fused at alpha 1 and 0 once; other alphas lie between."""
    dense, sparse = _both(spark, d)
    sides = R.fused_sides(dense, sparse)
    rows = sides.withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.75, 1.0)))))
    return rows.groupBy("alpha", "query_id").agg(F.round(F.avg(R.blend(F.col("alpha"))), 5).alias("mean_score"), F.count("*").alias("n"))


@query(f"WITH {_SIDES}, {_FUSED}, fs AS (SELECT query_id, doc_id, 0.5 * d + 0.5 * s AS score FROM fu), {_top_sql('fs', 20, 'r')}, {_RERANK} SELECT query_id, doc_id, round(rerank_score, 5) AS rerank_score FROM rr WHERE rank <= 5")
def hybrid_retrieve(spark, d):
    out = R.retrieve(*_embedded(spark, d), 5)
    return out.select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), F.round("rerank_score", 5).alias("rerank_score"))


# Cache, registry and chunk tables.


@query("WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, sha256(text) IN (SELECT h FROM c) AS hit FROM documents")
def cache_hits_misses(spark, d):
    """A cache that holds a third of the documents, looked up by all."""
    docs = documents(spark, d).withColumn("content_hash", T.content_hash(F.col("content")))
    cache = docs.where("doc_id % 3 = 0").select("content_hash", F.lit("m").alias("model_id"), F.array(F.lit(1.0)).alias("vector"))
    hits, misses = split_by_cache(docs, cache, "m", F.col("content_hash"))
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("WITH r AS (SELECT sha256(text) AS content_hash, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS n FROM documents) SELECT content_hash, doc_id::DOUBLE AS x FROM r WHERE n = 1")
def cache_upsert(spark, d):
    """Vectors of all documents into a cache that has those of every other one: the last writer of a key wins."""
    docs = documents(spark, d).select(T.content_hash(F.col("content")).alias("content_hash"), F.col("doc_id").cast("double").alias("x"))
    old = K.last_rows(docs.where("x % 2 = 0"), ["content_hash"], "x")
    return K.upserted(old, K.last_rows(docs, ["content_hash"], "x"), ["content_hash"])


def _registry(spark, d):
    docs = documents(spark, d).select(F.col("kb").alias("knowledge_base_id"), "source_uri", F.when(F.col("doc_id") % 7 == 0, F.md5("content")).otherwise(T.content_hash(F.col("content"))).alias("content_hash"), "doc_id")
    return docs.where("doc_id % 5 <> 0")


def _changed(spark, d):
    docs = documents(spark, d).select("doc_id", F.col("kb").alias("knowledge_base_id"), "source_uri", T.content_hash(F.col("content")).alias("content_hash"))
    return changed(docs, _registry(spark, d))


@query("SELECT doc_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS changed, doc_id % 5 <> 0 AS known FROM documents")
def changed_sources(spark, d):
    """Every document against a registry that lacks a fifth of the sources and has old hashes of a seventh."""
    return _changed(spark, d).select("doc_id", "changed", "known")


@query("SELECT count(*) FILTER (doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0)) AS indexed_count, count(*) FILTER (doc_id % 11 <> 0 AND NOT (doc_id % 5 = 0 OR doc_id % 7 = 0)) AS skipped_count, count(*) FILTER (doc_id % 11 = 0) AS failed_count FROM documents")
def index_batch_counts(spark, d):
    error = F.when(F.col("doc_id") % 11 == 0, F.lit("not readable"))
    return P.batch_counts(_changed(spark, d).select((~F.col("changed")).alias("skipped"), error.alias("error")))


def chunk_table_rows(spark, d):
    """Rows of the chunk table, small vectors in place of embeddings."""
    rows = P.chunk(P.process(S.as_raw(table(spark, d, "documents"), "kb")), P.chunker("recursive", 128, 16))
    return rows.withColumn("vector", F.array(F.col("chunk_index").cast("double"), F.lit(1.0))).withColumn("model_id", F.lit("old"))


_CH = f"WITH RECURSIVE {_DOCS}, {_units_sql('docs', 128)}, {_fold_sql(128, 16)}, ch AS (SELECT id AS doc_id, count(*) AS n FROM (SELECT id, unnest(o) AS c FROM done) WHERE {sql_strip('c')} <> '' GROUP BY id)"


@query(f"{_CH} SELECT 'doc://' || doc_id AS source_uri, n AS n_chunks FROM ch WHERE NOT (doc_id % 5 = 0 OR doc_id % 7 = 0)")
def stale_delete(spark, d):
    """Chunks that stay when those of changed sources go."""
    gone = _changed(spark, d).where("changed").select("source_uri")
    return K.deleted(chunk_table_rows(spark, d), gone).groupBy("source_uri").agg(F.count("*").alias("n_chunks"))


@query(f"{_CH} SELECT 'doc://' || doc_id AS source_uri, n AS n_chunks, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS model_id FROM ch")
def upsert_chunks(spark, d):
    """Chunks of all documents in a vector table, those of a quarter written again with another model."""
    chunks = VectorTable(spark, f"{scratch(spark)}/chunks")
    chunks.ensure_collection("kb", 2)
    chunks.upsert("kb", chunk_table_rows(spark, d))
    old = chunks.read("kb")
    chunks.upsert("kb", old.where(F.regexp_extract("source_uri", r"(\d+)$", 1).cast("long") % 4 == 0).withColumn("model_id", F.lit("new")))
    return chunks.read("kb").groupBy("source_uri", "model_id").agg(F.count("*").alias("n_chunks")).select("source_uri", "n_chunks", "model_id")


@query("SELECT source AS kb, count(*) AS n_documents, count(DISTINCT sha256(text)) AS n_contents, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def kb_stats(spark, d):
    docs = documents(spark, d).select("kb", T.content_hash(F.col("content")).alias("h"), F.length("content").alias("n"))
    return docs.groupBy("kb").agg(F.count("*").alias("n_documents"), F.count_distinct("h").alias("n_contents"), F.sum("n").alias("n_chars"))


@query("SELECT 'doc://' || doc_id AS source_uri, source AS knowledge_base_id, 'txt' AS source_type, sha256(text) AS content_hash FROM documents")
def payload_round_trip(spark, d):
    """Metadata flattened to payload columns and back; the hash is that of the text as it was loaded."""
    raw = raw_rows(table(spark, d, "documents"), F.col("text"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")), F.lit("txt"), F.col("source"))
    none = F.lit(None).cast("string")
    known = {"author": none, "page_count": none.cast("int"), "language": none, "content_hash": T.content_hash(F.col("content"))}
    flat = raw.select("id", *(known.get(c, F.col(c)).alias(c) for c in (*PAYLOAD, "knowledge_base_id")))
    back = from_payload(to_payload(from_payload(flat)))
    return back.select("metadata.source_uri", "metadata.knowledge_base_id", "metadata.source_type", "metadata.content_hash")


# Answers.

_RES = f"{_POST}, {_ASK}, {_SPARSE}, {_top_sql('sc', 5, 'r0')}, r AS (SELECT * FROM r0 WHERE score > 0)"


def _results(spark, d):
    rows = chunk_rows(spark, d)
    return R.with_chunks(R.BM25Index(rows).search(items(spark, d), 5), rows, items(spark, d))


@query(f"SELECT doc_id, {sql_excerpt('text')} AS excerpt FROM documents")
def citation_excerpt(spark, d):
    return documents(spark, d).select("doc_id", T.excerpt(F.col("content")).alias("excerpt"))


@query(f"WITH {_RES} SELECT query_id, rank::INT AS rank, doc_id::VARCHAR AS document_id, 'doc://' || doc_id AS source_uri, lang AS title, {sql_excerpt('text')} AS excerpt, round(score, 6) AS score FROM r JOIN documents USING (doc_id)")
def citations(spark, d):
    return A.citations(_results(spark, d)).select("query_id", "rank", "document_id", "source_uri", "title", "excerpt", F.round("score", 6).alias("score"))


_BLOCK = "cb AS (SELECT query_id, string_agg('[Source ' || rank || ': doc://' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents USING (doc_id) GROUP BY query_id)"


@query(f"WITH {_RES}, {_BLOCK} SELECT query_id, md5(context) AS digest, length(context) AS n FROM cb")
def context_block(spark, d):
    return A.context_blocks(_results(spark, d)).select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n"))


@query(f"""WITH {_RES}, {_BLOCK} SELECT item_id AS query_id, 'You are a helpful assistant that answers questions using only the provided context. If the context does not contain the answer, say so plainly rather than guessing.' AS system,
md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text) AS digest FROM benchmark LEFT JOIN cb ON query_id = item_id""")
def prompt(spark, d):
    return A.prompts(items(spark, d), _results(spark, d)).select("query_id", "system", F.md5("user").alias("digest"))


@query(
    f"""WITH {_RES}, ex AS (SELECT query_id, rank, lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, doc_id::VARCHAR AS document_id, 'doc://' || doc_id AS source_uri, lang AS title, {sql_excerpt('text')} AS excerpt, round(score, 4) AS score FROM r JOIN documents USING (doc_id)),
ci AS (SELECT query_id, list({{'chunk_id': chunk_id, 'document_id': document_id, 'source_uri': source_uri, 'title': title, 'excerpt': excerpt, 'score': score}} ORDER BY rank) AS c FROM ex GROUP BY query_id),
w AS (SELECT query_id, string_split(excerpt, ' ') AS w FROM ex WHERE rank = 1),
pc AS (SELECT query_id, unnest(range(len(w)))::INT AS seq, unnest(w) || ' ' AS text, false AS is_final FROM w UNION ALL SELECT query_id, len(w)::INT, '', true FROM w)
SELECT query_id, seq, 'data: ' || to_json({{'text': text, 'is_final': is_final, 'citations': CASE WHEN is_final THEN c ELSE c[1:0] END}}) || chr(10) || chr(10) AS event FROM pc JOIN ci USING (query_id)"""
)
def sse_events(spark, d):
    found = _results(spark, d).withColumn("score", F.round("score", 4))
    return A.sse(A.events(A.extractive_pieces(found), A.citations(found)))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS body FROM nation""")
def json_rows(spark, d):
    return A.json_rows(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


# Evaluation.  A document is relevant to an item whose text it contains.

_REL = "rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_EVAL = f"""{_RES}, {_REL}, nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
mk AS (SELECT r.query_id, r.doc_id, r.rank, rel.doc_id IS NOT NULL AS hit FROM r LEFT JOIN rel ON rel.query_id = r.query_id AND rel.doc_id = r.doc_id),
ag AS (SELECT query_id, count(DISTINCT CASE WHEN hit AND rank <= 3 THEN doc_id END) AS f, avg(CASE WHEN rank <= 3 THEN hit::INT END) AS p, min(CASE WHEN hit THEN rank END) AS first, avg(hit::INT) AS cp, count(DISTINCT CASE WHEN hit THEN doc_id END) AS cf FROM mk GROUP BY 1),
ev AS (SELECT item_id AS query_id, coalesce(f / n, 0.0) AS recall, coalesce(p, 0.0) AS precision, coalesce(1.0 / first, 0.0) AS reciprocal_rank, coalesce(cp, 0.0) AS citation_precision, coalesce(cf / n, 0.0) AS citation_recall FROM benchmark LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN ag ON ag.query_id = item_id)"""


def _relevant(spark, d):
    """The items are a stated, small set of queries; each document is held against them once."""
    docs, asks = documents(spark, d), items(spark, d)
    return docs.join(asks, F.contains(docs["content"], asks["text"])).select("query_id", F.col("doc_id").cast("string").alias("document_id"))


def _evaluated(spark, d):
    return E.evaluate_retrieval(items(spark, d), _results(spark, d), _relevant(spark, d), 3)


@query(f"WITH {_EVAL} SELECT query_id, round(recall, 6) AS recall FROM ev")
def eval_recall(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"WITH {_EVAL} SELECT query_id, round(precision, 6) AS precision FROM ev")
def eval_precision(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("precision", 6).alias("precision"))


@query(f"WITH {_EVAL} SELECT query_id, round(reciprocal_rank, 6)::DOUBLE AS reciprocal_rank FROM ev")
def eval_mrr(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"WITH {_EVAL} SELECT count(*) AS case_count, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, round(avg(reciprocal_rank)::DOUBLE, 6) AS mean_reciprocal_rank FROM ev")
def eval_macro(spark, d):
    out = E.evaluate_dataset(_evaluated(spark, d))
    return out.select("case_count", *(F.round(c, 6).alias(c) for c in ("mean_recall", "mean_precision", "mean_reciprocal_rank")))


@query(f"WITH {_EVAL} SELECT query_id, round(citation_precision, 6) AS citation_precision, round(citation_recall, 6) AS citation_recall FROM ev")
def citation_pr(spark, d):
    out = E.evaluate_citations(items(spark, d), A.citations(_results(spark, d)), _relevant(spark, d))
    return out.select("query_id", F.round("citation_precision", 6).alias("citation_precision"), F.round("citation_recall", 6).alias("citation_recall"))


# Streams.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rates(spark, d):
    out = S.event_rates(table(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over cleaned documents, cited."""
    rows = chunk_rows(spark, d).withColumn("content", T.normalize_whitespace(T.drop_controls(F.col("content"))))
    return A.citations(R.with_chunks(R.BM25Index(rows).search(items(spark, d), 5), rows, items(spark, d)))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
