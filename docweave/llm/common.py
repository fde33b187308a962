"""What the operators share: Arrow batches in, Arrow batches out, and tables kept between steps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import table
from ..storage import Files, own_folder, scratch

#: Rows turned into Python objects at once; an Arrow batch may hold far more.
SLICE_ROWS = 128
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Bits of the bitmap of ``sought``, 4 MB.
BITS = 1 << 25


_holder: list = ["", lambda: None]


def hold(operator: str, clear: Callable[[], object] = lambda: None) -> None:
    """Say that this worker's caches are one operator's; those of the operator that ran in it before are dropped.  Workers outlive tasks.

    Each operator with Python says so, also one without caches, or those of the one before stay.
    """
    if _holder[0] != operator:
        _holder[1]()
        _holder[:] = operator, clear


def give_back() -> None:
    """Return memory that a task has freed to the system, since a worker waits for its next task with all it has."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not everywhere
        ctypes.CDLL(None).malloc_trim(0)


class Memo:
    """Remembers up to about ``size`` answers in two generations: what was not asked for since the last turn is dropped."""

    def __init__(self, size: int):
        self.half, self.new, self.old = size // 2, {}, {}

    def clear(self):
        self.new, self.old = {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts don't fill a worker; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows.  It goes to the JVM by Arrow: as a list it would pass through Python workers, for which each executor starts a second pool that stays."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow), struct)


def utf8(text: str | None) -> bytes:
    """The UTF-8 bytes of a text; a null text counts as an empty one."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_rows(df: DataFrame, columns: list[str], schema: str | StructType, make: Callable[[], Callable]) -> DataFrame:
    """Apply a Python function to slices of rows.

    ``make()`` runs once a task and returns ``f(*lists) -> tuple of lists``,
    one list per column of ``schema``; f may return fewer or more rows than it got.
    Where the returned object has ``finish``, that is called at the end for last rows.
    """
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(out, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = f(*(c.to_pylist() for c in part.columns))
                if len(out[0]):
                    yield packed(out)
        if hasattr(f, "finish"):
            out = f.finish()
            if len(out[0]):
                yield packed(out)
        give_back()

    return df.select(*columns).mapInArrow(run, struct)


def sought(rows: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """Rows but most of those that would find no partner in a join with keys, dropped before they are shuffled for it.

    The hashes of keys make a bitmap of ``BITS`` bits, which is broadcast in pieces; its size does not grow with keys.
    No partner is missed; a row whose hash another key has stays, so the join must follow.
    """
    bit = F.pmod(F.xxhash64(*by), F.lit(BITS)).alias("__bit")
    maps = keys.select(bit).groupBy(F.bitmap_bucket_number("__bit").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__map"))
    at = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    # The row travels as one column, whatever its columns are called.
    found = rows.select(F.struct("*").alias("__row"), bit).join(F.broadcast(maps), F.bitmap_bucket_number("__bit") == F.col("__piece"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select("__row.*")


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran, since the
    table stays.  Files go away with ``forget``.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    if not _kept:
        atexit.register(_at_exit, spark)
    _kept.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


#: Paths of this session's kept tables, in the order that they were made.
_kept: list[str] = []


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        forget(spark)


def step(make: Callable[[], DataFrame]) -> DataFrame:
    """Keep the table that make() returns, and delete what was kept on the way to it."""
    before = len(_kept)
    out = keep(make())
    files = Files(out.sparkSession)
    for path in _kept[before:-1]:
        files.delete(path)
    _kept[before:-1] = []
    return out


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Delete tables that ``keep`` has written, once nothing still to run reads them; with ``shuffles`` let go of shuffle files as well."""
    for df in tables:
        Files(df.sparkSession).delete(df._kept_at)
        with contextlib.suppress(ValueError):
            _kept.remove(df._kept_at)
    if shuffles:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more (it waits for garbage collection)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder (done at its exit too); results that read it must be stored before."""
    Files(spark).delete(own_folder(spark))
    _kept.clear()


#: The key by which a table is dealt out where its file can't be split into as many tasks as there are cores.
_SPREAD = {"documents": "doc_id", "conversations": "conv_id", "embeddings": "vec_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name, *filter(None, [_SPREAD.get(name)]))
