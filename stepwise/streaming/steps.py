"""Row-local stages on streams: raw episodes to audited steps, as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepwise.operators.audit import audited
from stepwise.sources.episodes import parser


def stream_jsonl(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines of files that arrive under ``path``, as VARIANT ``raw``."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).where(F.length(F.trim("value")) > 0).select(F.parse_json(F.trim("value")).alias("raw"))


def audited_stream(raw: DataFrame, source: str) -> DataFrame:
    """Audited steps of a stream of raw records: no state, so every trigger's rows are final."""
    return audited(parser(source)(raw))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once for each input file; ends when what has arrived is done."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
