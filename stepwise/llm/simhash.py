"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import Mapper, bitmap, in_bitmap, in_short_batches, key_parts, packed_rows, stage, text_or_empty, unpacked

RADIUS = 2
WORDS = 3
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; 0 without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(tokens) < words:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: len(tokens) - words + 1], end[words - 1 :]
    digest, n = xxhash.xxh64_intdigest, len(start)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(start[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), pa.array(prints, pa.int64())], ["doc_id", "check", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, check, fp) of each row; check is a hash of the text, to tell rows of one doc_id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("check"))
    return rows.mapInArrow(in_short_batches(_fingerprints), f"doc_id {kind}, check long, fp long")


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints of ``prints`` (fp) within ``radius`` (2) bits of one another.

    Every fingerprint emits itself and all 64 variants at one flipped bit; two
    fingerprints at 2 bits or fewer share a variant.  Those that share one lie
    within 2 bits of one another (each is within 1 bit of it), so a variant has
    65 fingerprints at most and a chain through them in order loses no
    connection: no pairs within a group are made.  Each link is verified.
    """
    masks = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    near = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    last = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = near.select("fp", last.alias("last")).where("last is not null")
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("last"))) <= radius)
    return pairs.select(F.col("last").alias("src"), F.col("fp").alias("dst")).distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, check, fp, component_id (smallest doc_id reachable), root (its fingerprint).

    Texts without words share fingerprint zero and are linked like any others.
    A null text counts as empty; a null doc_id takes part and never names a
    component unless it has no other member; repeated rows stay.  A very long
    text is hashed whole, in blocks of shingles.  An empty table gives no rows;
    other columns are not read, whatever their names.  Equal fingerprints are
    pre-aggregated, so copies cost one row; only the last join meets a hot
    fingerprint, and adaptive execution splits it.
    """
    prints = stage(fingerprints(docs), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(ball_links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    named = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    of = stage(rooted.join(named, "root").select("fp", "component_id", "root"), "of")
    return prints.join(of, "fp").select("doc_id", "check", "fp", "component_id", "root")


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def _met(sent) -> Mapper:
    """Add whether a row's ``check`` may be one of the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(sent.value, batch.column("check").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], [*batch.schema.names, "met"])

    return run


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component, all columns unchanged, whatever their names.

    A null doc_id gives way to any other; of rows that repeat a doc_id and text
    one stays; null and empty texts are one component; an empty table gives no
    rows.  Rows alone in their component (a sized bit map of the others' text
    hashes tells) pass without a shuffle, so the texts that move are those of
    components of several rows.
    """
    spark = docs.sparkSession
    found = stage(near_components(docs).select("doc_id", "check", "root"), "found")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "check"))
    groups = stage(found.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "best"), "groups")
    of = found.join(groups, "root").groupBy("doc_id", "check").agg(F.max(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "check") == F.col("best")).alias("stays"))
    of = stage(of.select(*[c.alias(k) for k, c in key_parts().items()], "check", "stays"), "of")
    sent = spark.sparkContext.broadcast(bitmap(of, "check"))
    rows = packed_rows(docs, check=F.xxhash64(text_or_empty()), **key_parts())
    rows = rows.mapInArrow(in_short_batches(_met(sent)), T.StructType([*rows.schema.fields, T.StructField("met", T.BooleanType())]))
    # Rows that repeat another whole are cut before they move.  What the bit map takes for another has no decision and stays.
    once = F.row_number().over(Window.partitionBy("no_id", "id", "check").orderBy("check"))
    some = rows.where("met").withColumn("turn", once).where("turn = 1").drop("turn").join(of, ["no_id", "id", "check"], "left").where("stays or stays is null")
    return unpacked(rows.where("not met").select("r").unionAll(some.select("r")))
