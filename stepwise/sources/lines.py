"""Lines with their place in the input, and typed lines that are checked: good rows here, rejects with a reason there."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stepwise.functions.geometry import once

#: Splits whose counts are broadcast.
SPLITS = 100_000
_CORRUPT = "_corrupt"
#: Reasons that are not a check's name.
MALFORMED = "malformed"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, pos, value) of each non-blank line: its number in its file, and in all files by their paths, from 0.

    Files are read by many tasks as ever.  A first pass counts the lines of each
    split; their sums tell what stands before a split, which is added to a line's
    place in it.  Both passes read the same splits in the same order, so no row
    is sorted; up to ``SPLITS`` counts are broadcast, and more are joined.
    """
    source = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select(source[0].alias("file"), source[1].alias("start"), "value").where(F.length(F.trim("value")) > 0)
    # Numbers of one task's rows follow one another, also where it reads several splits.
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    counted = splits.limit(SPLITS + 1).collect()
    few = len(counted) <= SPLITS
    splits = spark.createDataFrame(counted, splits.schema) if few else splits
    in_file = Window.partitionBy("file").orderBy("start")
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("files"))
    splits = splits.withColumn("own", F.sum("n").over(in_file) - F.col("n")).join(before, "file").select("file", "start", "first", "own", "files")
    placed = rows.join(F.broadcast(splits) if few else splits, ["file", "start"])
    record = F.col("own") + F.col("at") - F.col("first")
    return placed.select("file", record.alias("record"), (F.col("files") + record).alias("pos"), "value")


def first_lines(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """The first n non-blank lines of the input, as ``numbered_lines``."""
    return numbered_lines(spark, path).where(F.col("pos") < n)


def typed_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The columns of ``schema`` and ``pos`` of each JSON line; a line that is none, or doesn't fit, raises."""
    rows = numbered_lines(spark, path)
    return once(rows.select("pos", "value"), _r=F.from_json("value", schema, {"mode": "FAILFAST"})).select("_r.*", "pos")


def checked_lines(spark: SparkSession, path: str | list[str], schema: StructType, checks: Mapping[str, Column]) -> DataFrame:
    """(file, record, pos, value, reason, r) of each JSON line: ``r`` as ``schema`` says, ``reason`` null where all is well.

    ``checks`` are conditions on columns of ``r``, named by what they ask for;
    the first that does not hold (null does not) is the reason, and
    ``malformed`` that of a line that is no object of this schema.
    """
    wide = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    rows = once(numbered_lines(spark, path), _r=F.from_json("value", wide, options))
    malformed = F.when(F.col("_r").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull(), MALFORMED)
    # The fields stand in columns of their own while the checks name them.
    rows = once(rows.select("file", "record", "pos", "value", malformed.alias("_bad"), "_r.*").drop(_CORRUPT), _said=F.coalesce("_bad", *[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    return rows.select("file", "record", "pos", "value", F.col("_said").alias("reason"), F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("r"))


def accepted(checked: DataFrame) -> DataFrame:
    """The good rows of ``checked_lines``, with ``pos``."""
    return checked.where("reason is null").select("r.*", "pos")


def rejected(checked: DataFrame) -> DataFrame:
    """(file, record, pos, reason, value) of the others."""
    return checked.where("reason is not null").select("file", "record", "pos", "reason", "value")


def strict(checked: DataFrame) -> DataFrame:
    """The rows of ``checked_lines``, with ``pos``; the first bad one that a task meets raises, and tells where it stands."""
    said = F.concat_ws(" ", F.lit("bad record"), F.col("record").cast("string"), F.lit("of"), "file", F.lit(":"), "reason")
    return checked.where(F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).select("r.*", "pos")
