import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def shown(row):
    return tuple("null" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_like_duckdb(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    ours = sorted(shown(r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    found = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    assert ours == sorted(shown([r[theirs.index(c)] for c in columns]) for r in found.fetchall())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(len(r["excerpt"]) <= 243 for r in rows)


BLOCKED = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "ahocorasick":
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry

names = entry.queries()
assert len(names) > 80 and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(entry.oracle_sql()) <= set(names)
"""


def test_a_missing_optional_package_leaves_the_core():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=root, check=True)
