"""Repeated passages by suffix arrays: every byte that a string of 400 bytes covers which also starts elsewhere goes.

Equal strings are brought together by content, so that each shard of suffixes
can be sorted on its own:

1. Texts are told apart by 128 bits of their SHA-256, and each distinct one is
   written once, bucketed by it.  Later joins with texts move no text.
2. A *window* is the string of 400 bytes at a place.  It belongs to the group of
   the smallest hash of the 64-byte strings in it, so equal windows share a
   group.  Neighbouring windows of one group are a *segment*, with a digest.
3. Segments that occur twice as they are need no sorting.  Of groups with
   several different segments, or one that may repeat itself, one copy of each
   goes to a shard.
4. A shard's suffix array is induced, its common prefixes are permuted into
   text order, and windows that share 400 bytes with a neighbour are repeated.

A group of more than ``GROUP`` different segments (the edges of a passage that
very many texts share) is split: a window there joins those whose group hash
stands about as far from its start and that share all bytes near it.  The third
split tells windows apart by all their bytes.  So no group grows with the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Mapper, in_short_batches, new_folder, packed_rows, stage, text_or_empty
from .suffix_array import common_prefixes, suffix_array

WINDOW = 400
#: Windows in a segment, different segments in a group that is sorted, and bytes in a shard's suffix array.
SEGMENT, GROUP, SHARD_BYTES = 512, 2000, 2 << 20
#: Bytes that are hashed at once.
STEP_BYTES = 1 << 20

#: due: its text has one copy, so that its windows are looked for; inner: its group's hash stands in it more than once.
SEGMENTS = "g long, b binary, key binary, start int, n int, due boolean, inner boolean"
EMPTY_SHA = hashlib.sha256(b"").digest()


def gram_of(window: int) -> int:
    """Bytes of the strings whose smallest hash names a window's group: 64 of 400; 8 times a power of two."""
    if window < 8:
        raise ValueError("a window has 8 bytes or more")
    return 8 << max(0, (window // 48).bit_length() - 1)


def widths_of(window: int) -> tuple[int, ...]:
    """How many places the windows of a split group may differ in where the group's hash stands, split by split."""
    return max(1, window // 8), max(1, window // 64), 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on: of 8 bytes, then of twice as many from two, until they are so many."""
    h = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 8
    while size < gram:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours: of blocks, from their ends and from their beginnings."""
    n = len(h) - width + 1
    rows = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(h)] = h
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, first window, bytes) that are hashed at once; a long text is taken in parts whose windows follow one another."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - window + 1, STEP_BYTES):
            piece = text[at : at + STEP_BYTES + window - 1]
            group.append((i, at, piece))
            held += len(piece)
            if held >= STEP_BYTES:
                yield group
                group, held = [], 0
    if group:
        yield group


def _runs(new: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the runs that begin where ``new`` says, cut at ``longest``."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    parts = -(-size // longest)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, left = np.repeat(first, parts) + nth * longest, np.repeat(size, parts) - nth * longest
    return first, np.minimum(left, longest)


def _digests(data: bytes, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    view = memoryview(data)
    return [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def _holds_twice(grams: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the hash h of each segment stands in it (from start to stop) more than once."""
    low = np.flatnonzero(grams <= h.max())
    a, b = np.searchsorted(low, start), np.searchsorted(low, stop)
    of = np.repeat(np.arange(len(h)), b - a)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    equal = grams[low[a[of] + nth]] == h[of]
    return np.bincount(of[equal], minlength=len(h)) > 1


def _segments(window: int) -> Mapper:
    """The segments of each text: of columns key, text (bytes) and copies."""
    gram = gram_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, single = batch.column("key"), np.array(batch.column("copies").to_pylist(), np.int64) == 1
            for group in _pieces(batch.column("text").to_pylist(), window):
                data = b"".join(piece for _, _, piece in group)
                size = np.array([len(piece) for _, _, piece in group])
                offset = np.cumsum(size) - size
                grams = gram_hashes(np.frombuffer(data, np.uint8), gram)
                least = sliding_least(grams, window - gram + 1)
                count = size - window + 1
                begins = np.cumsum(count) - count
                place = np.arange(count.sum()) + np.repeat(offset - begins, count)
                h = least[place]
                new = np.append(True, h[1:] != h[:-1])
                new[begins] = True
                first, n = _runs(new, SEGMENT)
                at, of = place[first], np.searchsorted(begins, first, side="right") - 1
                text = np.array([i for i, _, _ in group])[of]
                start = at - offset[of] + np.array([s for _, s, _ in group])[of]
                b = _digests(data, at, at + n + window - 1)
                inner = _holds_twice(grams, h[first], at, at + n + window - gram)
                columns = [pa.array(h[first].view(np.int64)), pa.array(b, pa.binary()), keys.take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(single[text]), pa.array(inner)]
                yield pa.RecordBatch.from_arrays(columns, ["g", "b", "key", "start", "n", "due", "inner"])

    return in_short_batches(run)


def split_segment(body: bytes, n: int, width: int, window: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(group, digest, first window, windows) of the parts of a segment with ``n`` windows, by where their least hash stands.

    Windows whose hash stands ``width * j`` to ``width * (j + 1) - 1`` bytes in share
    the bytes from ``width * j`` before it on that lie in all of them; these, and j, are the group.
    """
    gram = gram_of(window)
    h = gram_hashes(np.frombuffer(body, np.uint8), gram)
    value = h[: window - gram + 1].min()
    places = np.flatnonzero(h == value)
    start = np.arange(n)
    anchor = places[np.searchsorted(places, start)]
    j = (anchor - start) // width
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (j[1:] != j[:-1]))
    view = memoryview(body)
    for first, size in zip(*(x.tolist() for x in _runs(new, SEGMENT)), strict=True):
        a = int(anchor[first]) - int(j[first]) * width
        common = xxhash.xxh3_64_intdigest(view[a : a - width + 1 + window], seed=int(j[first]))
        yield common - (1 << 64 if common >> 63 else 0), xxhash.xxh3_128_digest(view[first : first + size + window - 1]), first, size


def _split(width: int, window: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, segments in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "segments")), strict=True):
                rows = [
                    (g, b, key, s["start"] + first, n, s["due"], False)
                    for s in segments
                    for g, b, first, n in split_segment(text[s["start"] : s["start"] + s["n"] + window - 1], s["n"], width, window)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)],
                    ["g", "b", "key", "start", "n", "due", "inner"],
                )

    return in_short_batches(run)


def _bodies(window: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, segments in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "segments")), strict=True):
                columns = {
                    "g": pa.array([s["g"] for s in segments], pa.int64()),
                    "key": pa.array([key] * len(segments), pa.binary()),
                    "start": pa.array([s["start"] for s in segments], pa.int32()),
                    "due": pa.array([s["due"] for s in segments], pa.bool_()),
                    "body": pa.array([text[s["start"] : s["start"] + s["n"] + window - 1] for s in segments], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return in_short_batches(run)


def repeated_windows(bodies: list[bytes], window: int) -> list[np.ndarray]:
    """Of each body the windows, by their places, that stand elsewhere in it or in another."""
    m = len(bodies)
    size = np.array([len(b) for b in bodies])
    # Each body has an end mark of its own, so no prefix goes beyond it.
    t = np.zeros(int(size.sum()) + m + 1, np.uint16 if m < 65000 else np.int32)
    end = np.cumsum(size + 1) - 1
    body = np.ones(len(t), bool)
    body[end], body[-1] = False, False
    t[body] = np.frombuffer(b"".join(bodies), np.uint8).astype(t.dtype) + (m + 1)
    t[end] = np.arange(1, m + 1)
    order = suffix_array(t, m + 257)
    begin = end - size
    starts = np.zeros(len(t) + 1, np.int32)
    np.add.at(starts, begin, 1)
    np.add.at(starts, end - window + 1, -1)
    is_window = np.cumsum(starts[:-1]) > 0
    order = order[is_window[order]]
    equal = common_prefixes(t, order) >= window
    found = np.zeros(len(t), bool)
    found[order[equal]] = True
    found[order[np.flatnonzero(equal) - 1]] = True
    return [np.flatnonzero(found[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]


def _sorted_shards(window: int) -> Mapper:
    """Windows that repeat: bodies come by group; a shard takes whole groups."""

    def search(rows: list[tuple[bytes, int, bool, bytes]]) -> pa.RecordBatch:
        out: list[tuple[bytes, int, int]] = []
        for (key, start, due, _), places in zip(rows, repeated_windows([r[3] for r in rows], window), strict=True):
            if due and len(places):
                new = np.append(True, np.diff(places) != 1)
                out += [(key, start + int(places[a]), int(k)) for a, k in zip(*_runs(new, len(places)), strict=True)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, bool, bytes]] = []
        held, group = 0, None
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "key", "start", "due", "body")), strict=True):
                if g != group and held >= SHARD_BYTES:
                    yield search(rows)
                    rows, held = [], 0
                group = g
                rows.append(tuple(row))
                held += len(row[3])
        if rows:
            yield search(rows)

    return in_short_batches(run)


def _cut(window: int) -> Mapper:
    """What the spans of a text leave: windows that repeat, by first and number, as runs of bytes, and the digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, removed, digests = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                edge = np.zeros(len(text) + 1, np.int32)
                start = np.array([f["start"] for f in found])
                np.add.at(edge, start, 1)
                np.add.at(edge, start + np.array([f["n"] for f in found]) + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": a, "stop": b} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).digest())
            columns = {
                "key": batch.column("key"),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                "kept": pa.array(digests, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return in_short_batches(run)


class Texts:
    """Each distinct text once (key, text, copies), bucketed by its key: joins with small tables move no text."""

    def __init__(self, docs: DataFrame, window: int):
        self.spark = docs.sparkSession
        text = text_or_empty().cast("binary")
        rows = docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), text.alias("text")).where(F.octet_length("text") >= window)
        distinct = rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        self.name = f"stepwise_texts_{uuid.uuid4().hex}"
        # As many buckets as a shuffle has partitions: each task writes whole buckets.
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        distinct.write.bucketBy(buckets, "key").format("parquet").option("path", new_folder(self.spark, "texts")).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def mapped(self, rows: DataFrame, name: str, run: Mapper, schema: str) -> DataFrame:
        """``run`` over each text that ``rows`` (key and other columns) has some of, with these as an array ``name``."""
        of_text = rows.groupBy("key").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "key"])).alias(name))
        return self.table.join(of_text.hint("shuffle_hash"), "key").select("key", "text", name).mapInArrow(run, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _found(texts: Texts, window: int) -> DataFrame:
    """(key, start, n): runs of windows of the texts that have one copy which stand anywhere else."""
    segments = stage(texts.table.mapInArrow(_segments(window), SEGMENTS), "segments")
    found, to_sort = [], []
    for width in (*widths_of(window), None):
        groups = segments.groupBy("g", "b").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "start", "n", "due", "inner")).alias("one"))
        groups = stage(groups, "groups")
        twice = groups.where("times > 1").select("g", "b")
        found.append(stage(segments.where("due").join(twice, ["g", "b"], "left_semi").select("key", "start", "n"), "twice"))
        counts = F.count(F.lit(1)).alias("different"), F.max("one.inner").alias("inner"), F.max(F.col("one.due") & (F.col("times") == 1)).alias("due")
        sizes = groups.groupBy("g").agg(*counts).where("(different > 1 or inner) and due")
        # Written, so that the join may split what a group of very many segments has.
        sizes = stage(sizes.select("g", "different"), "sizes")
        mixed = groups.join(sizes, "g").select("g", "b", "one.key", "one.start", "one.n", (F.col("one.due") & (F.col("times") == 1)).alias("due"), "different")
        mixed = stage(mixed, "mixed")
        to_sort.append(mixed.where(F.col("different") <= GROUP).drop("different", "b"))
        hot = mixed.where(F.col("different") > GROUP).drop("different", "b", "g")
        if width is None or hot.isEmpty():
            break
        segments = stage(texts.mapped(hot, "segments", _split(width, window), SEGMENTS), "split")
    rows = to_sort[0]
    for more in to_sort[1:]:
        rows = rows.unionByName(more)
    bodies = texts.mapped(rows, "segments", _bodies(window), "g long, key binary, start int, due boolean, body binary")
    shards = bodies.repartition("g").sortWithinPartitions("g")
    out = shards.mapInArrow(_sorted_shards(window), "key binary, start int, n int")
    for more in found:
        out = out.unionByName(more)
    return out


def _results(docs: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, spans, kept: digest of what stays) of the distinct texts that lose bytes; n_removed is null where all do."""
    texts = Texts(docs, window)
    cut = texts.mapped(_found(texts, window), "found", _cut(window), "key binary, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    copied = texts.table.where("copies > 1").select("key", F.lit(None).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.lit(EMPTY_SHA).alias("kept"))
    out = stage(cut.unionByName(copied), "cut")
    texts.drop()
    return out


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans, kept_sha256.

    ``spans`` are the maximal runs of bytes (start, stop: exclusive) of the UTF-8
    text that some string of ``window`` bytes covers which starts at another
    place of any row too; ``kept_sha256`` is of the other bytes.  Rows that
    repeat a text, and a doc_id or not, are rows of their own: a text of
    ``window`` bytes or more that two rows have goes as a whole.  Null text
    counts as empty; a text shorter than ``window`` stays whole.  Very long
    texts are hashed by parts, cut nowhere.  Empty tables give no rows; other
    columns are not read, whatever their names.  Equal means equal in 128 bits
    of a digest for texts and segments, and byte by byte in the suffix arrays.
    """
    text = text_or_empty().cast("binary")
    rows = stage(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")), "rows")
    got = _results(docs, window)
    out = rows.withColumn("key", F.substring("sha", 1, 16)).join(got, "key", "left")
    whole = F.col("kept").isNotNull() & F.col("n_removed").isNull()
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, all_of).otherwise(F.coalesce("spans", F.array())).alias("spans"),
        F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"),
    )


def _without(name: str) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ends = [0, *[x for s in spans for x in (s["start"], s["stop"])], len(text)]
                left.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(left, pa.string())], ["r", name])

    return in_short_batches(run)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its texts less the bytes that ``repeats`` finds; a character that loses a byte goes as a whole.

    All other columns stay, whatever their names, and all rows; a null text stays null.
    """
    text = text_or_empty().cast("binary")
    got = _results(docs, window).select("key", F.col("n_removed").isNull().alias("whole"), "spans")
    rows = packed_rows(docs, text=text).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    met = rows.join(got, "key", "left")
    some = met.where("size(spans) > 0").select("r", "text", "spans")
    cut = some.mapInArrow(_without("left"), T.StructType([rows.schema["r"], T.StructField("left", T.StringType())]))
    rest = met.where("spans is null or size(spans) = 0").select("r", F.when(F.col("whole"), F.lit("")).otherwise(F.col("r.text")).alias("left"))
    return rest.unionByName(cut).select(*[F.when(F.col("r.text").isNull(), F.col("r.text")).otherwise(F.col("left")).alias(c) if c == "text" else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
