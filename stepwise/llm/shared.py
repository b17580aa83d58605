"""What the operators of this package share: staging, row keys, bounded filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task takes up at once.  Documents can be long, so they are few.
ARROW_ROWS = 256
#: Characters that one vectorised step of a Python task holds at most (a single longer text goes alone).
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stepwise-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders that were named since each open ``scratch`` began.
_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/stepwise/{label}-{uuid.uuid4().hex}"
    for made in _scratch[-1:]:
        made.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all folders that operators have staged within: their result must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove_folder(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor never recomputes what stands before),
    and gives what follows exact sizes and no inherited partitioning, so that
    adaptive execution can split the large partitions of a later join.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` (staged), to be broadcast if it has ``most`` rows or fewer, and else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= most else df


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_short_batches(f: Mapper) -> Mapper:
    """``f`` for ``mapInArrow``, on slices of ``ARROW_ROWS`` rows (Spark bounds a batch by its bytes, whatever the session's rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(batch.slice(at, ARROW_ROWS) for batch in batches for at in range(0, batch.num_rows, ARROW_ROWS))

    return run


def packed_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with all its columns in one, ``r``, so that none clashes with ``columns``; ``unpacked`` brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), *[c.alias(k) for k, c in columns.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("r.*")


def key_parts(doc_id: str = "doc_id") -> dict[str, Column]:
    """A doc_id as two columns that are never null, so that joins and windows by them share one shuffle."""
    return {"no_id": F.col(doc_id).isNull(), "id": F.coalesce(F.col(doc_id).cast("string"), F.lit(""))}


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def smallest(rows: DataFrame, name: str, key: Column, limit: int) -> DataFrame:
    """The ``limit`` values of column ``name`` with the smallest hashes ``key`` (long) of them, or all if they are fewer.

    A cut by the number of distinct values lets about twice as many through, so
    that what meets for the last choice doesn't grow with the input, however
    often a value is repeated.
    """
    n = rows.agg(F.approx_count_distinct(name).alias("n")).first()["n"]
    share = (2 * limit + 1000) / max(1, n)
    if share < 1:
        rows = rows.where(key < F.lit(-(1 << 63) + int(share * (1 << 64))))
    return rows.distinct().withColumn("key", key).orderBy("key").limit(limit).drop("key")


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores in front as keep it off the columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_steps(texts: Iterable[str | None], limit: int = STEP_CHARS) -> Iterator[list[str]]:
    """Groups of neighbouring texts of at most ``limit`` characters together; nulls become empty."""
    group: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if group and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


# A set of 64-bit hashes as a bit map: a hash that is in the set is always
# found; others are found with a chance of 1 in 32 or less (1 in 8 for the
# largest), which costs movement and never changes a result.  A map is sized by
# the number of hashes, between LEAST_WORDS and MAP_WORDS; where the largest one
# has fewer than 8 bits a hash there is none, and all rows count as found.

FILTER_WORD_BITS = 6
LEAST_WORDS, MAP_WORDS = 1 << 18, 1 << 21


def bitmap(df: DataFrame, column: str) -> np.ndarray | None:
    """The hashes of ``column`` as 64-bit words (2 to 16 MB), 32 bits a row or more, or at least 8 of the largest map; else None.

    The rows of ``df`` are counted first, so it should be a staged table.
    """
    n = df.count()
    if n * 8 > MAP_WORDS << FILTER_WORD_BITS:
        return None
    words = min(MAP_WORDS, max(LEAST_WORDS, 1 << (n * 32 >> FILTER_WORD_BITS).bit_length()))
    slot = F.pmod(F.col(column), F.lit(words << FILTER_WORD_BITS))
    held = (
        df.select(
            F.shiftrightunsigned(slot, FILTER_WORD_BITS).alias("word"),
            F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("mask"),
        )
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toPandas()
    )
    out = np.zeros(words, dtype=np.uint64)
    out[held["word"].to_numpy(dtype=np.int64)] = held["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit ``hashes`` the bit map may hold."""
    if words is None:
        return np.ones(len(hashes), bool)
    slot = np.mod(hashes, len(words) << FILTER_WORD_BITS)
    return (words[slot >> FILTER_WORD_BITS] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
