"""JSON documents of any size: a list's items, or those of an object's ``episodes``, read by many tasks.

A file is read as the pieces between closing braces, which Spark cuts at byte
ranges as it cuts lines.  Whether a range begins inside a string, and how deep,
follows from what stands before it: quotes add up to a parity, and brackets to a
depth for either parity.  So a first pass brings a row a range, and the next
ones know where the items end.  Only an item that crosses ranges is put
together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the key whose list holds an object's records.
LIST_KEY = "episodes"
_OPENS_LIST = re.compile(rf'"{LIST_KEY}"\s*:\s*$')
_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'\\.|["{}\[\],]', re.DOTALL)
#: Ranges of bytes whose counts are broadcast to the tasks.
RANGES = 100_000


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the pieces of text between closing braces, and where the range begins that they are read in."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True)


def depth_change(text: str) -> tuple[int, int, int]:
    """(parity of quotes, change of depth if it begins outside a string, and if inside) of a piece and the brace behind it."""
    parts = _ESCAPE.sub("", text + "}").split('"')
    change = [0, 0]
    for k in (0, 1):
        outside = "".join(parts[k::2])
        change[k] = outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
    return (len(parts) - 1) % 2, change[0], change[1]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: parity, change of depth from either state, and the first character that is no blank."""
    done: dict[tuple[str, int], list] = {}
    for file, start, text in _by_range(batches):
        at = done.setdefault((file, start), [0, 0, 0, None])
        parity, outside, inside = depth_change(text)
        change = (outside, inside)
        at[1], at[2] = at[1] + change[at[0]], at[2] + change[1 - at[0]]
        at[0] ^= parity
        if at[3] is None:
            at[3] = (text + "}").lstrip()[:1] or None
    rows = [(f, s, *v) for (f, s), v in done.items()]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "parity", "outside", "inside", "head"])


class State(NamedTuple):
    """Where a range begins: inside a string, how deep, and whether in the list of records; ``level`` is the depth of its items."""

    inside: bool
    depth: int
    active: bool
    level: int


def items(pieces: Iterator[str], state: State) -> Iterator[tuple[int, str, bool]]:
    """(number of commas between items so far, text, whether it ends here) of the items and parts of items in a range.

    A list that is opened or closed counts as a comma more, so that what stands
    before it has a number of its own.
    """
    inside, depth, active, level = state
    n, held = 0, []
    for piece in pieces:
        text = piece + "}"
        parity, outside_change, inside_change = depth_change(piece)
        # Nothing of the list's own level is in a piece that stays deeper: as many brackets as there are can't reach it.
        if depth - text.count("}") - text.count("]") > level and not (inside and depth <= level):
            held.append(text)
            depth += inside_change if inside else outside_change
            inside ^= bool(parity)
            continue
        begin = 0
        for m in _TOKEN.finditer(text):
            c = m[0]
            if c == '"':
                inside = not inside
            elif inside or len(c) > 1:
                continue
            elif c in "[{":
                if c == "[" and depth == level - 1 and not active and (level == 1 or _OPENS_LIST.search(text, 0, m.start())):
                    active, begin, held = True, m.end(), []
                    n += 1
                depth += 1
            elif c in "]}":
                depth -= 1
                if active and depth == level - 1:
                    yield n, "".join([*held, text[begin : m.start()]]), True
                    active, held = False, []
                    n += 1
            elif active and depth == level:
                yield n, "".join([*held, text[begin : m.start()]]), True
                n, held, begin = n + 1, [], m.end()
        if active:
            held.append(text[begin:])
    if active:
        yield n, "".join(held), False


def _found(state_of: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items of each range: its first and its last one may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _by_range(batches)
        row = next(rows, None)
        while row is not None:
            file, start = row[:2]
            following: list = []

            def own(row=row, file=file, start=start, following=following) -> Iterator[str]:
                while row is not None and row[:2] == (file, start):
                    yield row[2]
                    row = next(rows, None)
                following.append(row)

            state = state_of.value.get((file, start))
            if state is None:
                for _ in own():
                    pass
            else:
                for n, text, ends in items(own(), state):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([text]), pa.array([ends])], ["file", "start", "n", "text", "ends"])
            row = following[0]

    return run


_FOUND = "file string, start long, n long, text string, ends boolean"


def _states(rows: list, opened: dict[tuple[str, int], int] | None = None) -> dict[tuple[str, int], State]:
    """Where each range begins, from the measures of those before it."""
    out, file, inside, depth, active, level = {}, None, False, 0, False, 1
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth, active = r["file"], False, 0, False
            level = {"[": 1, "{": 2}.get(r["head"])
        if level is None:
            raise ValueError(f"records must be a list or an object: {file}")
        out[file, r["start"]] = State(inside, depth, active, level)
        depth += r["inside"] if inside else r["outside"]
        inside ^= bool(r["parity"])
        if opened is not None:
            active = opened.get((file, r["start"]), active)
    return out


def _lists(state_of: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each range where the list of records, or another one beside it, opens or closes: whether it is open at the range's end, and whether it began there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at: dict[tuple[str, int], bool] = {}
        began: set[tuple[str, int]] = set()
        now: dict[tuple[str, int], list] = {}
        for file, start, piece in _by_range(batches):
            s = state_of.value[file, start]
            at = now.setdefault((file, start), [s.inside, s.depth])
            text, (inside, depth) = piece + "}", at
            parity, outside_change, inside_change = depth_change(piece)
            if depth - text.count("}") - text.count("]") < s.level:
                for m in _TOKEN.finditer(text):
                    c = m[0]
                    if c == '"':
                        inside = not inside
                    elif not inside and len(c) == 1 and c != ",":
                        if c == "[" and depth == s.level - 1 and (s.level == 1 or _OPENS_LIST.search(text, 0, m.start())):
                            open_at[file, start] = True
                            began.add((file, start))
                        depth += 1 if c in "[{" else -1
                        if c in "]}" and depth == s.level - 1:
                            open_at[file, start] = False
                at[:] = inside, depth
            else:
                at[:] = inside ^ bool(parity), depth + (inside_change if inside else outside_change)
        rows = [(f, s, v, (f, s) in began) for (f, s), v in open_at.items()]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], ["file", "start", "open", "began"])

    return run


def _few(df: DataFrame) -> list:
    rows = df.limit(RANGES + 1).collect()
    if len(rows) > RANGES:
        raise ValueError(f"more than {RANGES} ranges of bytes: raise spark.sql.files.maxPartitionBytes")
    return rows


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each record of JSON documents: a list's items, those of an object's list ``episodes``, or else the object.

    At most ``RANGES`` ranges of bytes are read, a row of each comes to the
    driver; a document that is neither list nor object raises.
    """
    pieces = ranges(spark, path)
    measured = _few(pieces.mapInArrow(_measured, "file string, start long, parity int, outside long, inside long, head string"))
    if not measured:
        return spark.createDataFrame([], "file string, text string")
    starts = spark.sparkContext.broadcast(_states(measured))
    lists = _few(pieces.mapInArrow(_lists(starts), "file string, start long, open boolean, began boolean"))
    opened = {(r["file"], r["start"]): r["open"] for r in lists}
    state_of = _states(measured, opened)
    # Objects without a list of records are records themselves.
    listed = {r["file"] for r in lists if r["began"]}
    whole = sorted({r["file"] for r in measured} - listed)
    sent = spark.sparkContext.broadcast({k: v for k, v in state_of.items() if k[0] in listed})
    found = pieces.mapInArrow(_found(sent), _FOUND)
    # What goes on: the last part of a range, and the first of a range that begins within the list.
    inside = spark.createDataFrame([(f, s) for (f, s), v in sent.value.items() if v.active], "file string, start long")
    found = found.join(F.broadcast(inside.withColumn("goes_on", F.lit(True))), ["file", "start"], "left")
    cut = ~F.col("ends") | ((F.col("n") == 0) & F.coalesce("goes_on", F.lit(False)))
    parts = found.where(cut)
    out = found.where(~cut).select("file", "text").unionByName(_joined(parts))
    out = out.where(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)
    if whole:
        own = spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        out = out.unionByName(own)
    return out


def _joined(parts: DataFrame) -> DataFrame:
    """Items that cross ranges: their parts, which follow one another, as one."""
    order = Window.partitionBy("file").orderBy("start", "n")
    # An item ends with the first part that ends; what follows belongs to the next.
    ended = F.coalesce(F.sum(F.col("ends").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = parts.withColumn("item", ended)
    texts = F.array_sort(F.collect_list(F.struct("start", "n", "text")))
    return numbered.groupBy("file", "item").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text")).select("file", "text")

