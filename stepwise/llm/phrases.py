"""Phrase collocations: merged count-min sketches leave survivors, which are counted exactly, scored and subsumed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Mapper, in_short_batches, stage, text_or_empty

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Rows of a sketch; its width is a power of two near the bytes of text over ``CELL_BYTES``, in these bounds.
ROWS, CELL_BYTES, WIDTHS = 2, 32, (1 << 16, 1 << 26)
#: Cells of a sketch that are merged as one value.
BLOCK = 1 << 16
#: Bytes of text whose words are numbered and counted at once.
STEP_BYTES = 2 << 20
#: Phrases that a task writes out and sends on at once.
SENT = 16_384
#: Groups that the phrases of a language are ranked in first.
SPREAD = 64

# Capitals become small, stops become a byte that no UTF-8 text has, tabs and blanks part words.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if i in _STOPS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_STOP = b"\xff"


class Chunk(NamedTuple):
    """Texts of one language: their words, numbered, and the places of words and of stops (-1)."""

    lang: str
    words: list[bytes]
    numbers: np.ndarray


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Words of the texts (lang, text: bytes), by language, ``STEP_BYTES`` at a time; no phrase crosses a text or a stop."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def chunk(lang: str) -> Chunk:
        data = (b" " + _STOP + b" ").join(held.pop(lang)).translate(_TABLE).replace(_STOP, b" " + _STOP + b" ")
        size.pop(lang)
        number: dict[bytes, int] = {_STOP: -1}
        words = data.split()
        found = np.fromiter((number.setdefault(w, len(number) - 1) for w in words), np.int64, len(words))
        return Chunk(lang, [w for w in number if w != _STOP], found)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= STEP_BYTES:
                yield chunk(lang)
    for lang in list(held):
        yield chunk(lang)


class Phrases(NamedTuple):
    """The distinct phrases of a length in a chunk: where one stands, how often, and a 64-bit hash of its language and words."""

    at: np.ndarray
    times: np.ndarray
    hashes: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def phrases_of(chunk: Chunk, longest: int, keep=None) -> Iterator[tuple[int, Phrases]]:
    """(length, phrases) up to ``longest`` words.  ``keep`` (hashes to booleans) drops phrases, and so all longer ones that hold them."""
    seed = xxhash.xxh3_64_intdigest(chunk.lang.encode())
    word_hash = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in chunk.words], np.uint64)
    # Number of the phrase of the length before at each place, or -1.
    number, hashes = chunk.numbers, word_hash
    for n in range(1, longest + 1):
        if n > 1:
            # A phrase is its first words and its last ones, each a phrase of the length before: two numbers name it.
            first, second = number[:-1], number[1:]
            alive = (first >= 0) & (second >= 0)
            place = np.flatnonzero(alive)
            key = first[place] * np.int64(len(hashes) + 1) + second[place]
        else:
            place = np.flatnonzero(number >= 0)
            key = number[place]
        if not len(place):
            return
        _, at, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = place[at]
        if n == 1:
            found = word_hash[chunk.numbers[at]]
        else:
            found = _mixed(hashes[number[at]] + np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64))) + word_hash[chunk.numbers[at + n - 1]]
        got = Phrases(at, times, found)
        good = np.ones(len(at), bool) if keep is None else keep(_mixed(found))
        yield n, Phrases(at[good], times[good], _mixed(found[good]))
        renumbered = np.where(good, np.cumsum(good) - 1, -1)
        following = np.full(len(number) - (n > 1), -1, np.int64)
        following[place] = renumbered[inverse]
        number, hashes = following, got.hashes[good]


def cells_of(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return ((_mixed(hashes + np.uint64(row * 0x94D049BB133111EB % (1 << 64))) >> np.uint64(16)) & np.uint64(width - 1)).astype(np.int64)


def _sketch(width: int, longest: int, least: int) -> Mapper:
    """A task's sketch: by row and block of cells, counts up to ``least``; and the words of each language."""
    kind = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((ROWS, width), kind)
        words: dict[str, int] = {}
        for chunk in chunks(batches):
            words[chunk.lang] = words.get(chunk.lang, 0) + int((chunk.numbers >= 0).sum())
            for _, p in phrases_of(chunk, longest):
                often = np.minimum(p.times, least)
                for row in range(ROWS):
                    cell = cells_of(p.hashes, row, width)
                    order = np.argsort(cell)
                    cell, n = cell[order], often[order]
                    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                    own = cell[first]
                    sketch[row, own] = np.minimum(sketch[row, own] + np.add.reduceat(n, first), least).astype(kind)
        names = ["lang", "row", "block", "n", "cells"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if words:
            yield of([(lang, -1, 0, n, None) for lang, n in words.items()])
            for row in range(ROWS):
                for block in range(0, width, BLOCK):
                    part = sketch[row, block : block + BLOCK]
                    if part.any():
                        yield of([(None, row, block // BLOCK, 0, part.tobytes())])

    return run


def _merged(least: int) -> Mapper:
    """Blocks of one row and number, which follow one another, as one: summed up to ``least``, then a bit a cell that tells whether it got there."""
    kind = np.uint8 if least <= 255 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["row", "block", "bits"])

        for batch in batches:
            for row, block, cells in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "cells")), strict=True):
                if at != (row, block):
                    if at is not None:
                        yield done()
                    at, total = (row, block), np.zeros(len(cells) // np.dtype(kind).itemsize, np.int64)
                total = np.minimum(total + np.frombuffer(cells, kind), least)
        if at is not None:
            yield done()

    return run


def _written(words: list[pa.Array]) -> pa.Array:
    """Phrases as texts, of their first words, their second words and so on; bytes that are no UTF-8 are replaced."""
    joined = pc.binary_join_element_wise(*words, b" ")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def _survivors(bits, longest: int) -> Mapper:
    """Exact counts of a task's phrases whose cells all reached the bound, and whose parts' cells did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = bits.value
        width = tables.shape[1] * 8

        def keep(hashes: np.ndarray) -> np.ndarray:
            good = np.ones(len(hashes), bool)
            for row in range(ROWS):
                cell = cells_of(hashes, row, width)
                good &= (tables[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            return good

        for chunk in chunks(batches):
            words = pa.array(chunk.words, pa.binary())
            for n, p in phrases_of(chunk, longest, keep):
                for low in range(0, len(p.at), SENT):
                    at = p.at[low : low + SENT]
                    texts = _written([words.take(pa.array(chunk.numbers[at + i])) for i in range(n)])
                    columns = [pa.array([chunk.lang] * len(at)), pa.array(np.full(len(at), n, np.int32)), texts, pa.array(p.times[low : low + SENT].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "times"])

    return run


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, sketch_width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases up to ``longest`` words that stand ``least`` times or more, and (lang, n): words of each language.

    In the first pass each task keeps a count-min sketch of its phrases, its
    counts cut at ``least``.  Sketches are merged block by block: sums of a cell
    never fall short of any of its phrases.  What comes to the driver is a bit
    for each cell (16 MB at most), and the second pass counts exactly the
    phrases that no cell rules out.  Beyond about ``WIDTHS[1] * CELL_BYTES``
    bytes of text the sketch fills up and rules out less; nothing is lost then,
    but more phrases are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().cast("binary").alias("text")).where(F.octet_length("text") > 0)
    if sketch_width is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        sketch_width = min(WIDTHS[1], max(WIDTHS[0], 1 << (size // CELL_BYTES).bit_length()))
    # Few sketches, each of many texts: two for each core.
    few = rows.coalesce(2 * spark.sparkContext.defaultParallelism)
    sketches = stage(few.mapInArrow(in_short_batches(_sketch(sketch_width, longest, least)), "lang string, row int, block int, n long, cells binary"), "sketches")
    words = sketches.where("row < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    blocks = sketches.where("row >= 0").select("row", "block", "cells").repartition("row", "block").sortWithinPartitions("row", "block")
    bits = np.zeros((ROWS, sketch_width // 8), np.uint8)
    for r in blocks.mapInArrow(_merged(least), "row int, block int, bits binary").toLocalIterator():
        at = r["block"] * BLOCK // 8
        bits[r["row"], at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    found = rows.mapInArrow(in_short_batches(_survivors(sent, longest)), "lang string, words int, phrase string, times long")
    exact = found.groupBy("lang", "words", "phrase").agg(F.sum("times").alias("f")).where(F.col("f") >= least)
    return stage(exact, "phrases"), stage(words, "words")


def _words_from(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(exact: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases of two words and more, by their weakest cut."""
    parts = F.split("phrase", " ")
    cuts = exact.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _words_from(F.col("parts"), F.lit(1), F.col("k")).alias("first"), _words_from(F.col("parts"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda side, name: exact.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    # Each part of a frequent phrase is frequent, so none is missing.
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # Decimals of 38 digits hold the product of any two counts that can be.
    both = both.withColumn("score", F.expr("cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)"))
    weakest = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """``candidates`` without those inside a longer one that stands at least ``share`` times for each 100 of theirs."""
    parts = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", "words", F.col("a").alias("longer"), parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = longer.select("lang", "longer", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    most = inner.select("lang", _words_from(F.col("parts"), F.col("at"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(3,0)")
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", share))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, sketch_width: int | None = None) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    A text (documents' lang, text) is lower-cased in A-Z and cut at
    ``[.,;:!?\\x0A-\\x0D]``, and its pieces at blanks and tabs.  Candidates are the
    contiguous phrases of 2 to ``longest`` words that stand ``least`` times (a)
    or more in a language, overlaps counted.  Of the cuts in two parts, which
    stand l and r times, the one with the lowest floor(2000000 * a / (l + r))
    gives the score, ties to the shortest first part; n is the number of all
    words.  Candidates inside a longer one of nearly their count go.  The order
    is by score and a, largest first, then by the phrase's bytes.

    Null languages count as ``und``, null texts as empty; a very long text is
    counted whole.  Repeated rows and ids count each.  Empty tables, and
    languages without frequent phrases, give no rows; other columns are not
    read, whatever their names.
    """
    exact, words = counted(docs, longest, least, sketch_width)
    left = stage(subsumed(scored(exact), share), "collocations")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    near = left.withColumn("near", F.row_number().over(spread)).where(F.col("near") <= top).drop("near")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
