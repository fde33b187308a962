"""Keyed tables on Parquet: upsert, delete, compaction and clean-up without a lakehouse format.

A table is a log of numbered commits and folders of rows.  A commit names, for each partition, its folders in order;
the highest number is the table's state.  A writer first writes its rows to a new folder, then adds
the commit with the next number.  Commits appear whole and never replace one another, so a reader sees the
state before or after, a writer that dies leaves the state before, and of two writers the second finds its number
taken, reads the new state and adds to that one.  No update is lost.

An upsert writes its own rows only.  Each folder says by which columns its rows supersede those of the folders
before; a read drops these by anti-joins.  Deletes are folders of keys without rows.  After ``most`` folders a partition
is compacted into one.  ``vacuum`` deletes folders that no recent commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import FileExists, Files

#: Folders of a partition before it is compacted; commits tried while others take the number.
MOST, TRIES = 8, 50


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the partition that this one would replace."""


def last_rows(df: DataFrame, key: list[str], newest: str) -> DataFrame:
    """One row for each key, that with the largest ``newest``."""
    order = Window.partitionBy(*key).orderBy(F.desc(newest))
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def last_written(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the last one in the order that df holds its rows."""
    return last_rows(df.withColumn("__at", F.monotonically_increasing_id()), key, "__at").drop("__at")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; of several new rows with one key the last one."""
    new = last_written(new, key)
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(old: DataFrame, keys: DataFrame) -> DataFrame:
    """old without the rows that match keys on all columns of keys."""
    return old.join(keys.distinct(), keys.columns, "left_anti")


#: Rows of a table of marks that may be sent to all tasks.
MARKS = 2**20
#: Bits for marks by hash.
HASHED = 2**26


def marked(rows: DataFrame, number: Column, chosen: DataFrame, flag: str = "__marked") -> DataFrame:
    """rows with a flag that says whether their number is among those of ``chosen`` (one column of longs).

    Numbers are bits, 64 to a row of a small table that is sent to all tasks, so wide rows aren't shuffled to meet a list of some of them.
    """
    n = F.col(chosen.columns[0])
    bit = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    masks = chosen.groupBy(F.shiftright(n, 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(n))).alias("__bits"))
    masks = masks.persist()
    masks = F.broadcast(masks) if masks.count() <= MARKS else masks
    out = rows.withColumn("__number", number).join(masks, F.shiftright("__number", 6) == F.col("__word"), "left")
    return out.withColumn(flag, F.coalesce(F.getbit("__bits", bit(F.col("__number"))) == 1, F.lit(False))).drop("__number", "__word", "__bits")


def hashed(key: Column) -> Column:
    """A key's number among HASHED, for ``marked``; other keys may share it."""
    return F.pmod(F.xxhash64(key), F.lit(HASHED)).cast("long")


class KeyedTable:
    """A Parquet table with a key, in named partitions (one without a name if none is given).  A null in a key matches nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], most: int = MOST):
        self.spark, self.path, self.key, self.most = spark, path.rstrip("/"), key, most
        self.schema = StructType.fromDDL(schema)
        self.files = Files(spark)

    def version(self) -> int:
        """The number of the newest commit; 0 for a table without one."""
        return max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/log") if n.endswith(".json")]

    def _at(self, number: int) -> str:
        return f"{self.path}/log/{number:020d}.json"

    def _state(self) -> tuple[int, dict]:
        """The newest commit's number, and (folders, facts) of each partition."""
        number = self.version()
        return number, json.loads(self.files.read(self._at(number))) if number else {}

    def _commit(self, change: Callable[[dict], None]) -> int:
        """Add a commit that makes ``change`` to the newest state, whichever that is by then."""
        for _ in range(TRIES):
            number, state = self._state()
            change(state)
            try:
                self.files.write_new(self._at(number + 1), json.dumps(state).encode())
            except FileExists:
                continue
            return number + 1
        raise ConcurrentWrite(f"{TRIES} commits to {self.path} were taken by others")

    @staticmethod
    def _part(state: dict, part: str) -> dict:
        return state.setdefault(part, {"folders": [], "facts": {}})

    def _fields(self, names: list[str]) -> StructType:
        return StructType([self.schema[n] for n in names])

    def _rows(self, folder: dict) -> DataFrame:
        return self.spark.read.schema(self.schema if folder["rows"] else self._fields(folder["on"])).parquet(f"{self.path}/{folder['name']}")

    def _merged(self, folders: list[dict]) -> DataFrame | None:
        out = None
        for folder in folders:
            rows = self._rows(folder)
            if out is not None and folder["on"]:
                out = out.join(rows.select(*folder["on"]), folder["on"], "left_anti")
            if folder["rows"]:
                out = rows if out is None else out.unionByName(rows)
        return out

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, part: str | None = None) -> DataFrame:
        """One partition, or all."""
        state = self._state()[1]
        found = [self._merged(p["folders"]) for name, p in sorted(state.items()) if part is None or name == part]
        out = None
        for df in found:
            if df is not None:
                out = df.select(*self.schema.names) if out is None else out.unionByName(df)
        return self._empty() if out is None else out

    def state_of(self, part: str = "") -> str:
        """A name for what a partition holds now: another after each change."""
        folders = self._state()[1].get(part, {"folders": []})["folders"]
        return uuid.uuid5(uuid.NAMESPACE_OID, " ".join(f["name"] for f in folders)).hex

    def parts(self) -> list[str]:
        return sorted(self._state()[1])

    def facts(self, part: str = "") -> dict | None:
        """What was said of a partition when it was made; None if there is none."""
        found = self._state()[1].get(part)
        return found and found["facts"]

    def add_part(self, part: str, facts: dict) -> dict:
        """Make an empty partition, or leave the one that is there; its facts."""

        def change(state: dict) -> None:
            if part not in state:
                self._part(state, part)["facts"] = facts

        found = self.facts(part)
        if found is None:
            self._commit(change)
            found = self.facts(part)
        return found

    def _write(self, df: DataFrame, on: list[str], rows: bool = True) -> dict:
        """A folder of rows, in a column more numbered in the order of df."""
        name = f"v-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in (self.schema if rows else self._fields(on))]
        df.select(*columns, F.monotonically_increasing_id().alias("__at")).write.parquet(f"{self.path}/{name}")
        return {"name": name, "on": on, "rows": rows}

    def stage(self, new: DataFrame) -> dict:
        """Write rows that ``swap`` will add; until then no reader sees them."""
        return self._write(new, [])

    def staged(self, folder: dict) -> DataFrame:
        return self._rows(folder)

    def _last(self, folder: dict) -> dict:
        """A written folder with the last row of each key only: itself, if no hash of a key occurs twice.  Only keys are shuffled."""
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("__at", LongType())])).parquet(f"{self.path}/{folder['name']}")
        keys = rows.select(*self.key, "__at", F.xxhash64(*self.key).alias("__h"))
        twice = keys.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1").select("__h").persist()
        try:
            if twice.isEmpty():
                return folder
            order = Window.partitionBy(*self.key).orderBy(F.desc("__at"))
            older = keys.join(twice, "__h", "left_semi").withColumn("__n", F.row_number().over(order)).where("__n > 1").select("__at")
            out = self._write(marked(rows, F.col("__at"), older).where("not __marked"), folder["on"], folder["rows"])
        finally:
            twice.unpersist()
        self.files.delete(f"{self.path}/{folder['name']}")
        return out

    def _add(self, part: str, *folders: dict) -> None:
        self._commit(lambda state: self._part(state, part)["folders"].extend(folders))
        if len(self._state()[1][part]["folders"]) > self.most:
            self.compact(part)

    def replace(self, df: DataFrame, part: str = "") -> None:
        """Make df the content of one partition, whatever others have written."""
        folder = self._write(df, [])
        self._commit(lambda state: self._part(state, part).update(folders=[folder]))

    def upsert(self, new: DataFrame, part: str = "", unique: bool = False) -> None:
        """Put rows in place of those of the same key.  Of several new ones with one key the last counts; unique: the caller knows that there are none."""
        folder = self._write(new, self.key)
        self._add(part, folder if unique else self._last(folder))

    def delete(self, keys: DataFrame, part: str = "") -> None:
        """Delete the rows that match on all columns of keys."""
        self._add(part, self._write(keys.distinct(), keys.columns, rows=False))

    def swap(self, keys: DataFrame, new: DataFrame | list[dict], part: str = "") -> None:
        """In one commit, delete the rows that match keys and add new ones (or folders of them, staged), whose keys are unique and none of those that stay."""
        gone = self._write(keys.distinct(), keys.columns, rows=False)
        self._add(part, gone, *([self.stage(new)] if isinstance(new, DataFrame) else new))

    def drop_part(self, part: str) -> bool:
        if part not in self._state()[1]:
            return False
        self._commit(lambda state: state.pop(part, None))
        return True

    def compact(self, part: str = "") -> None:
        """Write a partition's rows to one folder.  Folders that others add meanwhile stay behind it."""
        before = self._state()[1].get(part, {"folders": []})["folders"]
        if len(before) < 2:
            return
        merged = self._merged(before)
        folder = self._write(self._empty() if merged is None else merged, [])

        def change(state: dict) -> None:
            now = state.get(part, {"folders": []})["folders"]
            if now[: len(before)] != before:
                raise ConcurrentWrite(f"partition {part!r} of {self.path} was replaced while it was compacted")
            state[part]["folders"] = [folder, *now[len(before) :]]

        self._commit(change)

    def vacuum(self, commits: int = 1, older_ms: int = 0) -> int:
        """Delete commits but the newest ``commits``, and folders that none of these names and that are older than ``older_ms``; the number of folders.

        A folder that a writer has not committed yet is one of these, so ``older_ms`` must exceed the time that a write takes
        where there are other writers, and the time that a query reads.
        """
        numbers = sorted(self._numbers())[-max(commits, 1) :]
        states = [json.loads(self.files.read(self._at(n))) for n in numbers]
        used = {f["name"] for s in states for p in s.values() for f in p["folders"]}
        gone = [n for n in self.files.names(self.path) if n.startswith("v-") and n not in used and self.files.age_ms(f"{self.path}/{n}") >= older_ms]
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
        for n in self._numbers():
            if numbers and n < numbers[0]:
                self.files.delete(self._at(n))
        return len(gone)
