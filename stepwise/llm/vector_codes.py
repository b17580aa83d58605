"""Compressed vectors: codebooks by rounds of exact assignment, with the candidates of each part filtered by a VA-file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .maxscore import weights
from .shared import Mapper, small, stage

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Bits that each coordinate of an entry is quantised to.
BITS = 4
#: Vectors that are held against a codebook at once.
STEP_ROWS = 2048
#: Different lengths of vectors that are compressed, each with codebooks of its own; labels whose sums are broadcast.
LENGTHS, LABELS = 64, 10_000

Book = np.ndarray


class Cells:
    """A codebook as a VA-file: each coordinate lies in one of a few cells, of which the least and the largest value are kept."""

    def __init__(self, book: Book, bits: int = BITS):
        n, d = book.shape
        self.book, self.cells = book, min(n, 1 << bits)
        rank = np.empty((n, d), np.int64)
        np.put_along_axis(rank, np.argsort(book, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
        cell = rank * self.cells // max(1, n)
        self.low = np.full((d, self.cells), np.iinfo(np.int64).max)
        self.high = np.full((d, self.cells), np.iinfo(np.int64).min)
        at = (np.broadcast_to(np.arange(d), (n, d)), cell)
        np.minimum.at(self.low, at, book)
        np.maximum.at(self.high, at, book)
        #: Which cell each entry has in each place, as a matrix: a table of bounds by place and cell becomes one of sums by entry.
        self.held = np.zeros((d * self.cells, n))
        self.held[np.arange(d) * self.cells + cell, np.arange(n)[:, None]] = 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) squared distance of each row of ``x`` to each entry that its cells allow, each a hair too wide for what floats lose."""
        below, above = (self.low[None] - x[:, :, None]).astype(float), (x[:, :, None] - self.high[None]).astype(float)
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(-below, -above) ** 2
        flat = (len(x), self.held.shape[0])
        return least.reshape(flat) @ self.held * (1 - 1e-9), most.reshape(flat) @ self.held * (1 + 1e-9)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers; beyond 64 bits in Python's."""
    if not len(a):
        return np.zeros(0, np.int64)
    reach = int(np.abs(a).max(initial=0)) + int(np.abs(b).max(initial=0))
    if reach * reach * max(1, a.shape[1]) < 1 << 63:
        return ((a - b) ** 2).sum(axis=1)
    return ((a.astype(object) - b.astype(object)) ** 2).sum(axis=1)


def nearest(x: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's nearest entry, ties to the smaller index: exact among the entries that the bounds leave."""
    least, most = cells.bounds(x)
    row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
    distance = exact_distances(x[row], cells.book[entry])
    first = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(distance, first)
    hit = np.flatnonzero(distance == best[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], best


def bounds_of(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end: equal ones where the length allows."""
    return [length * i // parts for i in range(parts + 1)]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(at, STEP_ROWS)
            flat = part.column("w").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1)


def _sums(books) -> Mapper:
    """For each part and entry: how many parts it is nearest to, and their sums, a row for each entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books.value]
        counts, sums = None, None
        held = peak = 0

        def done() -> pa.RecordBatch:
            rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(cells)) for e in np.flatnonzero(counts[p]).tolist()]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "n", "sums"])

        for _, w in _steps(batches):
            peak = max(peak, int(np.abs(w).max(initial=0)))
            if counts is not None and (held + len(w)) * peak >= 1 << 63:
                yield done()
                counts, held = None, 0
            if counts is None:
                counts, sums = [np.zeros(len(c.book), np.int64) for c in cells], [np.zeros(c.book.shape, np.int64) for c in cells]
            held += len(w)
            at = bounds_of(w.shape[1], len(cells))
            for p, c in enumerate(cells):
                x = w[:, at[p] : at[p + 1]]
                entry, _ = nearest(x, c)
                np.add.at(counts[p], entry, 1)
                np.add.at(sums[p], entry, x)
        if counts is not None:
            yield done()

    return run


def refined(rows: DataFrame, books: list[Book]) -> list[Book]:
    """A round: every part goes to its nearest entry, and each entry that has some becomes their mean, componentwise, rounded down.

    Tasks add up their own parts, so a row for each entry and task is shuffled,
    and a row for each entry comes to the driver.
    """
    sent = rows.sparkSession.sparkContext.broadcast(books)
    got = rows.select("w").mapInArrow(_sums(sent), "part int, entry int, n long, sums array<long>")
    exact = T.DecimalType(38, 0)
    each = got.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    totals = each.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x"))
    out = [b.copy() for b in books]
    for r in totals.collect():
        out[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return out


def fit(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[Book]:
    """Codebooks of vectors of one length (vec_id, w): from the vectors with the smallest ids, refined ``rounds`` times."""
    first = np.array([r["w"] for r in rows.select("vec_id", "w").orderBy(F.asc_nulls_last("vec_id"), "w").limit(entries).collect()], np.int64)
    at = bounds_of(first.shape[1], parts)
    books = [np.ascontiguousarray(first[:, a:b]) for a, b in zip(at, at[1:], strict=False)]
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def _encode(books) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books.value]
        for batch, w in _steps(batches):
            at = bounds_of(w.shape[1], len(cells))
            found = [nearest(w[:, a:b], c) for a, b, c in zip(at, at[1:], cells, strict=False)]
            codes = np.stack([e for e, _ in found], axis=1)
            error = [sum(x) for x in zip(*(d.tolist() for _, d in found), strict=True)]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "w"]
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * len(cells), pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            # A sum beyond 64 bits raises here.
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), code, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return run


def book_digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per vector (vec_id, embedding, label): vec_id, label, codes, error, label_error, codebooks_sha256.

    Components become floor(scale * x).  A vector's parts (consecutive, equal
    where its length allows) are coded by their nearest codebook entries, ties
    to the smaller one; ``error`` is the sum of squared distances, and
    ``label_error`` its sum over the rows of a label, nulls together.  Codebooks
    begin as the parts of the ``entries`` rows with the smallest vec_ids (null
    ids last, equal ids by their components; fewer rows, fewer entries), and
    ``rounds`` rounds refine them; of an entry that no part is nearest to,
    nothing changes.

    Vectors that are null, empty or hold null or non-finite components go.
    Vectors of each length have codebooks of their own, for ``LENGTHS`` lengths
    at most.  Rows that repeat an id count each.  Components of 2^62 and more,
    and errors of 2^63 and more, raise.  An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = stage(weights(vectors, scale, "label"), "vectors")
    lengths = [r[0] for r in rows.select(F.size("w")).distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType(
        [T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    )
    coded = spark.createDataFrame([], schema).withColumn("codebooks_sha256", F.lit(""))
    for length in sorted(lengths):
        own = rows.where(F.size("w") == length)
        books = fit(own, parts, entries, rounds)
        sent = spark.sparkContext.broadcast(books)
        coded = coded.unionByName(own.mapInArrow(_encode(sent), schema).withColumn("codebooks_sha256", F.lit(book_digest(books))))
    coded = stage(coded, "codes")
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "sums")
    out = coded.join(small(sums, LABELS), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "label", "codes", "error", "label_error", "codebooks_sha256")
