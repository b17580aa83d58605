from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def canonical(value: object) -> object:
    """A value in a form that both engines' results share."""
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "to_eng_string"):
        return float(value)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])


def sql_rows(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(DATA, sf, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return columns, got.fetchall()


def same_as_sql(df: DataFrame, sf: str, sql: str) -> int:
    """Assert that ``df`` has the rows of ``sql``; the number of rows."""
    columns, want = sql_rows(sf, sql)
    assert sorted(df.columns) == sorted(columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(columns, want)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w, (sorted(columns), g, w)
    return len(got)
