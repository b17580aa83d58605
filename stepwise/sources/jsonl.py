"""Scans and sinks: JSON lines, JSON documents, CSV, Markdown, reports."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.sources.documents import read_items
from stepwise.sources.lines import numbered_lines


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """One row a non-blank line: typed columns with ``schema`` (a bad line raises), else one VARIANT column ``raw``; ``limit``: of the first lines."""
    if limit is not None:
        lines = numbered_lines(spark, path).where(F.col("pos") < limit)
        if schema is None:
            return lines.select(F.parse_json(F.trim("value")).alias("raw"))
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    if schema is not None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.parse_json(F.trim("value")).alias("raw"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of VARIANT ``raw``: JSON lines by their suffix, else a list's items, ``episodes`` of an object, or the object."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    return read_items(spark, path).select(F.parse_json("text").alias("raw"))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines under ``path``, replacing what is there; ``order`` sorts within each file and among the files."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(path: str, report: dict[str, Any]) -> None:
    """A small result as indented JSON on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def read_reports(spark: SparkSession, named: list[str]) -> DataFrame:
    """Reports given as NAME=PATH, as rows of VARIANT ``report`` with their ``run``."""
    out = None
    for item in named:
        name, sign, path = item.partition("=")
        if not (name and sign and path):
            raise ValueError(f"expected NAME=PATH, got {item!r}")
        one = spark.read.text(path, wholetext=True).select(F.lit(name).alias("run"), F.parse_json("value").alias("report"))
        out = one if out is None else out.unionAll(one)
    if out is None:
        raise ValueError("no reports given")
    return out


# Review files are for people; of the Markdown file ``most`` rows at most come to the driver.


def _review_rows(df: DataFrame, most: int) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def _csv_lines(header: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as CSV lines without their ends; the first task's begin with a byte order mark and the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = io.StringIO()
        out = csv.writer(text, lineterminator="")

        def line(values: Iterable[Any]) -> str:
            text.seek(0)
            text.truncate()
            out.writerow(values)
            return text.getvalue()

        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(["\ufeff" + line(header)])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line(r.values()) for r in batch.to_pylist()], pa.string())], ["value"])

    return run


def write_csv(df: DataFrame, path: str, empty_header: tuple[str, ...] = ("case_index", "review_label", "notes", "sample_id"), order: str = "case_index") -> None:
    """One CSV file of all rows with a byte order mark, by ``order`` if ``df`` has it; without rows just ``empty_header``.

    Tasks write ranges of rows as parts in a folder beside ``path``; these are
    joined, byte by byte, to a file that takes its name when it is whole.
    """
    spark = df.sparkSession
    folder, whole = f"{path}.parts-{uuid.uuid4().hex}", f"{path}.whole-{uuid.uuid4().hex}"
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order in df.columns else df
    rows.mapInArrow(_csv_lines(df.columns), "value string").write.option("lineSep", "\r\n").text(folder)
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    at = lambda p: hadoop.fs.Path(p)
    files = at(folder).getFileSystem(conf)
    parts = sorted((f.getPath().toString(), f.getLen()) for f in files.listStatus(at(folder)) if f.getPath().getName().startswith("part-"))
    header = len(("\ufeff" + ",".join(df.columns) + "\r\n").encode())
    out = files.create(at(whole), True)
    if sum(n for _, n in parts) <= header:
        out.write(bytearray(("\ufeff" + ",".join(empty_header) + "\r\n").encode()))
    else:
        for part, _ in parts:
            source = files.open(at(part))
            hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    out.close()
    files.delete(at(path), False)
    if not files.rename(at(whole), at(path)):
        raise OSError(f"could not write {path}")
    files.delete(at(folder), True)


def write_markdown(df: DataFrame, path: str, title: str, most: int = 100) -> None:
    """One section a row, a list of its columns."""
    parts = [f"# {title}", ""]
    for i, row in enumerate(_review_rows(df, most), 1):
        parts += [f"## Case {row.get('case_index', i)}", "", *[f"- {k}: {v}" for k, v in row.items()], ""]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    Path(path).write_text("\n".join(parts), encoding="utf-8")
