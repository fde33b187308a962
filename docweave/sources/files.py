"""Documents from files: text, Markdown, CSV, HTML, office formats and images.  Each reader returns rows of the raw document schema."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.html import title
from ..schema import EXTENSIONS
from . import pdf


#: Bytes of files that one task reads, about.
TASK = 16 * 2**20


def raw_rows(df: DataFrame, content: Column, uri: Column, source_type: Column, kb: str | Column, title: Column | None = None, mime: Column | None = None, size: Column | None = None, modified: Column | None = None, extra: Column | None = None) -> DataFrame:
    """Rows of the raw document schema.  Ids come from knowledge base and source, so a second load gives the same."""
    null = lambda kind: F.lit(None).cast(kind)
    kb = F.lit(kb)
    return df.select(
        F.sha2(F.concat_ws("|", kb, uri), 256).alias("id"),
        content.alias("content"),
        uri.alias("source_uri"),
        source_type.alias("source_type"),
        kb.alias("knowledge_base_id"),
        (null("string") if title is None else title).alias("title"),
        (null("string") if mime is None else mime).alias("mime_type"),
        (null("long") if size is None else size.cast("long")).alias("file_size_bytes"),
        null("timestamp").alias("created_at"),
        (null("timestamp") if modified is None else modified).alias("modified_at"),
        F.current_timestamp().alias("loaded_at"),
        (F.create_map().cast("map<string,string>") if extra is None else extra).alias("extra"),
    )


def loader_of(uri: Column) -> Column:
    """The source type that a URI resolves to: web addresses first, else by its extension; null if there is none."""
    kinds = F.create_map(*(F.lit(x) for ext, kind, _ in EXTENSIONS for x in (ext, kind)))
    return F.when(T.is_url(uri), F.lit("website")).otherwise(F.try_element_at(kinds, T.extension(uri)))


def resolved(uri: Column) -> Column:
    """``loader_of``, an error for a URI without a loader."""
    return F.coalesce(loader_of(uri), F.raise_error(F.concat(F.lit("No registered loader can handle source: "), uri)).cast("string"))


def mime_of(uri: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for ext, _, mime in EXTENSIONS for x in (ext, mime)))
    return F.try_element_at(kinds, T.extension(uri))


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, content (bytes), length, modificationTime; one row a file.

    Spark counts each file as 4 MB, which makes a task of a few small ones; tasks are joined, without a shuffle, to four a core or as many as hold ``TASK`` bytes.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK)))


def _decoded(content: Column) -> Column:
    """UTF-8 with bad bytes replaced, line ends as \\n."""
    return T.universal_newlines(_utf8(content))


@F.pandas_udf(StringType())
def _utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


@F.pandas_udf(StringType())
def _csv_table(text: pd.Series) -> pd.Series:
    """CSV may quote line ends, so the standard reader takes it."""

    def table(raw: str) -> str:
        rows = list(csv.reader(io.StringIO(raw)))
        if not rows:
            return ""
        width = len(rows[0])
        shown = [rows[0], ["---"] * width, *((r + [""] * width)[:width] for r in rows[1:])]
        return "\n".join(f"| {' | '.join(r)} |" for r in shown)

    return text.map(table, na_action="ignore")


def csv_markdown(text: Column) -> Column:
    return _csv_table(text)


def _xml_text(data: bytes, block: str, leaf: str) -> str:
    """Text of each block element (by local name), its leaves joined."""
    local = lambda e: e.tag.rpartition("}")[2]
    root = ElementTree.fromstring(data)
    lines = ("".join(x.text or "" for x in e.iter() if local(x) == leaf) for e in root.iter() if local(e) == block)
    return "\n".join(x for x in lines if x.strip())


def _numbered(names, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _sheet_rows(data: bytes, shared: list[str]) -> list[list[str]]:
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for row in (e for e in ElementTree.fromstring(data).iter() if local(e) == "row"):
        cells: list[str] = []
        for c in (e for e in row if local(e) == "c"):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            cells += [""] * (max(at, 1) - 1 - len(cells))
            value = "".join(e.text or "" for e in c.iter() if local(e) in ("v", "t"))
            cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
        out.append(cells)
    return out


def office_text(name: str, data: bytes) -> str:
    """Text of a docx, pptx or xlsx file; workbooks as one Markdown table for each sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if name.endswith(".docx"):
            return _xml_text(z.read("word/document.xml"), "p", "t")
        if name.endswith(".pptx"):
            return "\n\n".join(_xml_text(z.read(n), "p", "t") for n in _numbered(names, r"ppt/slides/slide(\d+)\.xml"))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = _xml_list(z.read("xl/sharedStrings.xml"))
        tables = []
        for n in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = _sheet_rows(z.read(n), shared)
            if rows:
                width = max(map(len, rows))
                full = [r + [""] * (width - len(r)) for r in rows]
                tables.append("\n".join(f"| {' | '.join(r)} |" for r in [full[0], ["---"] * width, *full[1:]]))
        return "\n\n".join(tables)


def _xml_list(data: bytes) -> list[str]:
    local = lambda e: e.tag.rpartition("}")[2]
    return ["".join(x.text or "" for x in e.iter() if local(x) == "t") for e in ElementTree.fromstring(data) if local(e) == "si"]


def pdf_text(name: str, data: bytes) -> str:
    """Text of a PDF: by the optional package pypdf where it is installed, else by our own reader."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pdf.text_of(data)
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def image_text(name: str, data: bytes) -> str:
    """Text of an image by Tesseract, if its wrapper is installed."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("OCR needs the optional packages pytesseract and Pillow") from e
    return pytesseract.image_to_string(Image.open(io.BytesIO(data)))


def _converted(files: DataFrame, convert: Callable[[str, bytes], str]) -> DataFrame:
    """files with ``text`` and ``error`` (null where conversion worked); a bad file doesn't fail the job."""

    @F.pandas_udf("text string, error string")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for p, b in zip(path, content, strict=True):
            try:
                out.append((convert(p.lower(), bytes(b)), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("__r", run("path", "content")).select("*", "__r.text", "__r.error").drop("__r")


def _with_facts(files: DataFrame, content: Column, source_type: Column, kb: str, **more) -> DataFrame:
    uri = F.col("path")
    return raw_rows(files, content, uri, source_type, kb, size=F.col("length"), modified=F.col("modificationTime"), **({"mime": mime_of(uri)} | more))


def load_text(spark: SparkSession, path, kb: str) -> DataFrame:
    return _with_facts(_files(spark, path), _decoded(F.col("content")), F.lit("txt"), kb)


def load_markdown(spark: SparkSession, path, kb: str) -> DataFrame:
    return _with_facts(_files(spark, path), _decoded(F.col("content")), F.lit("markdown"), kb)


def load_csv(spark: SparkSession, path, kb: str) -> DataFrame:
    """A CSV file becomes one document, a Markdown table."""
    return _with_facts(_files(spark, path), csv_markdown(_decoded(F.col("content"))), F.lit("csv"), kb)


def load_html(spark: SparkSession, path, kb: str) -> DataFrame:
    files = _files(spark, path).withColumn("__html", _decoded(F.col("content")))
    return _with_facts(files, F.col("__html"), F.lit("html"), kb, title=title(F.col("__html")), mime=F.lit("text/html"))


def _with_error(files: DataFrame, kb: str, extra: Column | None) -> DataFrame:
    marked = F.create_map().cast("map<string,string>") if extra is None else extra
    marked = F.when(F.col("error").isNull(), marked).otherwise(F.map_concat(marked, F.create_map(F.lit("error"), F.coalesce("error", F.lit("")))))
    return _with_facts(files, F.col("text"), loader_of(F.col("path")), kb, extra=marked)


def office_rows(files: DataFrame, kb: str) -> DataFrame:
    """Raw documents of docx, pptx and xlsx files (path, content, length, modificationTime); one that can't be read has null content and its error in ``extra``."""
    return _with_error(_converted(files, office_text), kb, None)


def pdf_rows(files: DataFrame, kb: str, convert=pdf_text) -> DataFrame:
    return _with_error(_converted(files, convert), kb, None)


def image_rows(files: DataFrame, kb: str, ocr=image_text, provider: str = "tesseract") -> DataFrame:
    """Text of images by an OCR provider: a function of name and bytes."""
    return _with_error(_converted(files, ocr), kb, F.create_map(F.lit("ocr_provider"), F.lit(provider)))


def load_office(spark: SparkSession, path, kb: str) -> DataFrame:
    return office_rows(_files(spark, path), kb)


def load_pdf(spark: SparkSession, path, kb: str, convert=pdf_text) -> DataFrame:
    return pdf_rows(_files(spark, path), kb, convert)


def load_images(spark: SparkSession, path, kb: str, ocr=image_text, provider: str = "tesseract") -> DataFrame:
    return image_rows(_files(spark, path), kb, ocr, provider)


#: Loaders by source type; ``register`` adds or replaces one.
LOADERS: dict[str, Callable[[SparkSession, object, str], DataFrame]] = {
    "txt": load_text,
    "markdown": load_markdown,
    "csv": load_csv,
    "html": load_html,
    "docx": load_office,
    "pptx": load_office,
    "xlsx": load_office,
    "pdf": load_pdf,
    "image": load_images,
}


def register(source_type: str, loader: Callable[[SparkSession, object, str], DataFrame]) -> None:
    LOADERS[source_type] = loader


def load_paths(spark: SparkSession, paths: list[str], kb: str) -> DataFrame:
    """Raw documents of files of any known kind; a path without a loader is an error."""
    kinds: dict[str, list[str]] = {}
    known = {ext: kind for ext, kind, _ in EXTENSIONS}
    for p in paths:
        ext = re.search(r"(\.[^./\\]+)$", p)
        kind = known.get(ext[1].lower()) if ext else None
        if kind is None:
            raise ValueError(f"No registered loader can handle source: {p!r}")
        kinds.setdefault(kind, []).append(p)
    parts = [LOADERS[k](spark, v, kb) for k, v in sorted(kinds.items())]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
