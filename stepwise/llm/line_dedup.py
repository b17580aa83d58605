"""Fuzzy line dedup: MinHash bands, exact Jaccard, union-find; one line of each component stays."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .components import connected_components, extended_components
from .shared import bitmap, in_bitmap, in_short_batches, in_steps, key_parts, packed_rows, stage, text_or_empty, unpacked

#: Characters of a shingle (a shorter line is one shingle), and the least Jaccard similarity of a link.
SHINGLE = 8
SIMILAR = 0.8
#: A link of similarity s is found by some band with chance 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8, 1 - 1e-6 at 0.9.
BANDS, ROWS = 12, 4
#: Lines of one band key that are linked in one chain, about; a hotter key is cut into more.
GROUP = 1000
#: A line is paired with this many before it in the chain, so all pairs of a key of NEAR + 1 lines or fewer are tried at once.
NEAR = 4
#: Lines and characters of a block, about: a hotter key's lines that are still apart meet block by block.
BLOCK, BLOCK_CHARS = 2000, 500_000
#: Pairs of lines that one vectorised step of a block join holds.
STEP_PAIRS = 500_000
_RNG = np.random.default_rng(20240101)
MULTIPLIERS = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
FOLDS = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
#: Characters whose shingles are hashed at once.
STEP = 200_000
#: Lines that a task remembers as seen, about; one that it has forgotten just sends its keys again.
SEEN = 200_000
#: Band keys that are sorted at once to find those of several lines, and keys of a part that meet in one step, about.
SORTED_KEYS, PART_KEYS = 1 << 20, 1 << 18
#: Least number of parts, so that they can be dealt evenly.
PARTS = 512
#: Hashed similarities this close to the threshold are computed again from the shingles.
CLOSE = 0.02


def normal_lines(text: str) -> list[str]:
    """What is compared of a text's lines: lower case, white space collapsed and trimmed."""
    # Of white space only the blank is printable, so most lines are seen to be normal as they are.
    return [x if x.isprintable() and "  " not in x and x[:1] != " " and x[-1:] != " " else " ".join(x.split()) for x in text.lower().split("\n")]


def line_ids(line: str, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit hashes of a line: its identifier (of ``bits`` bits), and the check that tells lines of one identifier apart."""
    own, other = struct.unpack("<qq", xxhash.xxh3_128_digest(line.encode("utf-8", "replace")))
    return own >> (64 - bits), other


def line_id(line: str) -> int:
    return line_ids(line)[0]


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle of all non-empty lines, shingles of each line, the first one's place)."""
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    sums = flat.hashed(codes)
    first = np.cumsum(size) - size
    n = np.maximum(1, size - SHINGLE + 1)
    at = np.cumsum(n) - n
    start = np.arange(int(n.sum())) + np.repeat(first - at, n)
    whole = max(0, len(codes) - SHINGLE + 1)
    h = np.append(flat.between(sums, slice(0, whole), slice(SHINGLE, SHINGLE + whole), 3), np.zeros(SHINGLE, np.uint64))[start]
    short = np.flatnonzero(size < SHINGLE)
    h[at[short]] = flat.between(sums, first[short], first[short] + size[short], 3)
    return h, n, at


def band_keys(lines: list[str]) -> np.ndarray:
    """The band keys (lines x BANDS) of MinHash signatures of non-empty lines, vectorised over all their shingles."""
    done = []
    for group in in_steps(lines, STEP):
        h, _, at = shingle_hashes(group)
        h = flat.mix(h, 32).astype(np.uint32)
        least = np.stack([np.minimum.reduceat(h * m, at) for m in MULTIPLIERS], axis=1).reshape(len(group), BANDS, ROWS)
        key = np.zeros((len(group), BANDS), np.uint64)
        for r in range(ROWS):
            key = (key ^ least[:, :, r]) * FOLDS[r]
            key ^= key >> np.uint64(29)
        done.append(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(done).view(np.int64) if done else np.zeros((0, BANDS), np.int64)


def _lines(bits: int):
    """A row for each line that isn't blank; the band keys come with a line's first place in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            docs, numbers, ids, others, new, fresh = [], [], [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for d, text in enumerate(batch.column("text").to_pylist()):
                for i, line in enumerate(normal_lines(text)):
                    if line:
                        h, other = line_ids(line, bits)
                        docs.append(d)
                        numbers.append(i)
                        ids.append(h)
                        others.append(other)
                        new.append((h, other) not in seen)
                        if new[-1]:
                            seen.add((h, other))
                            fresh.append(line)
            keys = iter(band_keys(fresh).tolist())
            bands = [next(keys) if x else None for x in new]
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("doc_id").take(at), batch.column("check").take(at), pa.array(numbers, pa.int32()), pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "doc_id", "check", "line_no", "line", "other", "bands"],
            )

    return in_short_batches(run)


def _extremes(keys: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, its smallest line, its largest line) of each distinct key, ascending."""
    order = np.argsort(keys)
    keys, lines = keys[order], lines[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(first):
        return keys, lines, lines
    return keys[first], np.minimum.reduceat(lines, first), np.maximum.reduceat(lines, first)


def _key_parts(parts: int):
    """(part, keys, lines): a task's band keys, ``SORTED_KEYS`` at a time, in ``parts`` ranges of keys; of a key's lines the smallest and the largest."""
    edges = np.array([-(1 << 63) + (i << 64) // parts for i in range(1, parts)], np.int64)

    def dealt(keys: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
        key, least, most = _extremes(keys, lines)
        times = 1 + (least != most)
        line = np.repeat(least, times)
        line[np.cumsum(times) - 1] = most
        key = np.repeat(key, times)
        ends = np.concatenate(([0], np.searchsorted(key, edges), [len(key)])) * 8
        packed = [pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)]) for x in (key, line)]
        held = pa.array(np.flatnonzero(ends[1:] > ends[:-1]), pa.int32())
        return pa.RecordBatch.from_arrays([held, *[x.take(held) for x in packed]], ["part", "keys", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, n = [], [], 0
        for batch in batches:
            keys.append(batch.column("bands").flatten().to_numpy(zero_copy_only=False))
            lines.append(np.repeat(batch.column("line").to_numpy(zero_copy_only=False), BANDS))
            n += len(keys[-1])
            if n >= SORTED_KEYS:
                yield dealt(np.concatenate(keys), np.concatenate(lines))
                keys, lines, n = [], [], 0
        if n:
            yield dealt(np.concatenate(keys), np.concatenate(lines))

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of two lines or more, of rows of ``_key_parts`` sorted by part."""

    def shared(keys: list[bytes], lines: list[bytes]) -> pa.RecordBatch:
        key, least, most = _extremes(np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(lines), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key[least != most], pa.int64())], ["key"])

    at, keys, lines = None, [], []
    for batch in batches:
        for part, k, x in zip(*(batch.column(c) for c in ("part", "keys", "lines")), strict=True):
            if part.as_py() != at:
                if keys:
                    yield shared(keys, lines)
                at, keys, lines = part.as_py(), [], []
            keys.append(k.as_py())
            lines.append(x.as_py())
    if keys:
        yield shared(keys, lines)


def shared_keys(fresh: DataFrame) -> DataFrame:
    """(key): the band keys that two different lines of ``fresh`` (line, bands) or more have.

    Nearly all keys are of one line.  They are sorted in the tasks and shuffled
    as ranges, some thousands a row; a hot key leaves a task as two lines each
    ``SORTED_KEYS`` keys at most, however many lines have it.
    """
    parts = max(PARTS, 1 << (fresh.count() * BANDS // PART_KEYS).bit_length())
    dealt = fresh.select("line", "bands").mapInArrow(_key_parts(parts), "part int, keys binary, lines binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_shared_keys, "key long")


def _members(shared):
    """(key, line, near) for each key of a line that others may have; near is the line's next key, by which chains are ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("bands").flatten().to_numpy(zero_copy_only=False)
            lines = np.repeat(batch.column("line").to_numpy(zero_copy_only=False), BANDS)
            near = np.roll(keys.reshape(-1, BANDS), -1, axis=1).ravel()
            hit = in_bitmap(shared.value, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit], pa.int64()), pa.array(lines[hit], pa.int64()), pa.array(near[hit], pa.int64())], ["key", "line", "near"])

    return run


def _texts(shared, bits: int):
    """(line, other, text) of the lines that are sought, once for each task, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            lines = list({line for text in batch.column("text").to_pylist() for line in normal_lines(text) if line})
            ids = [line_ids(x, bits) for x in lines]
            hit = np.flatnonzero(in_bitmap(shared.value, np.array([i for i, _ in ids], np.int64))).tolist()
            if len(seen) > SEEN:
                seen.clear()
            new = [i for i in hit if ids[i] not in seen]
            seen.update(ids[i] for i in new)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i][0] for i in new], pa.int64()), pa.array([ids[i][1] for i in new], pa.int64()), pa.array([lines[i] for i in new], pa.string())], ["line", "other", "text"])

    return in_short_batches(run)


def own_ids(lines: DataFrame) -> DataFrame | None:
    """(line, other, own): new identifiers of lines whose identifier another line has too; None where there are none.

    ``lines`` (line, other) tells each line of the table by 128 bits.  New
    identifiers are hashes of both halves; they are tried until none is taken.
    """
    given = lines.select("line", "other").distinct()
    clash = lines.groupBy("line").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("line")
    clash = stage(clash, "clash")
    if clash.isEmpty():
        return None
    doubled = stage(given.join(clash, "line", "left_semi"), "doubled")
    for salt in range(16):
        own = doubled.withColumn("own", F.xxhash64(F.lit(salt), "line", "other"))
        taken = own.select("own").unionAll(given.select(F.col("line").alias("own"))).groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if own.join(taken, "own", "left_semi").isEmpty():
            return stage(own, "own")
    raise ValueError("no free identifiers found")


def with_own_ids(rows: DataFrame, own: DataFrame | None) -> DataFrame:
    """``rows`` (line, other, …) with ``line`` unique, and without ``other``."""
    if own is None:
        return rows.drop("other")
    return rows.join(own, ["line", "other"], "left").withColumn("line", F.coalesce("own", "line")).drop("own", "other")


def _pair_keys(pair: np.ndarray, text: np.ndarray, sets: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The set of each pair's text, marked with the pair's number."""
    n = at[text + 1] - at[text]
    places = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - at[text], n)
    return (np.repeat(pair, n).astype(np.uint64) << np.uint64(bits)) | (sets[places] & np.uint64((1 << bits) - 1))


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """The Jaccard similarity of the hashed shingle sets of each pair of non-empty lines."""
    texts = list(dict.fromkeys([*a, *b]))
    number = {x: i for i, x in enumerate(texts)}
    bits = 64 - max(len(texts), len(a)).bit_length()
    h, n, _ = shingle_hashes(texts)
    sets = np.sort((np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(bits)) | flat.mix(h, bits).astype(np.uint64))
    sets = sets[np.append(True, sets[1:] != sets[:-1])]
    at = np.searchsorted(sets, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(bits))
    x, y = np.array([number[t] for t in a], np.int64), np.array([number[t] for t in b], np.int64)
    pair = np.arange(len(a))
    keys = np.sort(np.concatenate((_pair_keys(pair, x, sets, at, bits), _pair_keys(pair, y, sets, at, bits))))
    both = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(bits)).astype(np.int64), minlength=len(a))
    size = at[1:] - at[:-1]
    return both / (size[x] + size[y] - both)


def similar(a: list[str], b: list[str], threshold: float) -> list[bool]:
    """Which pairs reach the threshold: by hashed shingles, and by the shingles themselves where it is close."""
    found = similarities(a, b) if a else np.zeros(0)
    keep = found >= threshold
    for i in np.flatnonzero(np.abs(found - threshold) < CLOSE).tolist():
        keep[i] = jaccard(a[i], b[i]) >= threshold
    return keep.tolist()


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()
            keep, at = [], 0
            for group in in_steps([x + y for x, y in zip(a, b, strict=True)], STEP):
                keep += similar(a[at : at + len(group)], b[at : at + len(group)], threshold)
                at += len(group)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["src", "dst"])

    return run


class Labels:
    """Union-find over the roots of a block join's rows."""

    def __init__(self, roots: np.ndarray):
        self.held, self.of = np.unique(roots, return_inverse=True)
        self.parent = list(range(len(self.held)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        """Whether the rows ``a`` and ``b`` were apart."""
        x, y = self.find(self.of[a]), self.find(self.of[b])
        self.parent[y] = x
        return x != y

    def settle(self) -> None:
        self.of = np.array([self.find(i) for i in range(len(self.parent))], np.int64)[self.of]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def prefixes(text: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, place in its set) of each text's prefix, and the size of each text's set.

    Of a set of n shingles, rarest first, two that reach the threshold share one
    among their first n - ceil(threshold * n) + 1.
    """
    number = {x: i for i, x in enumerate(dict.fromkeys(text))}
    h, n, _ = shingle_hashes(list(number))
    _, token, times = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(len(number)), n)
    held = distinct((owner << 32) | rank[token])
    owner, rank = held >> 32, held & 0xFFFFFFFF
    size = np.bincount(owner, minlength=len(number))
    place = np.arange(len(held)) - (np.cumsum(size) - size)[owner]
    own = place < (size - np.ceil(threshold * size - 1e-9) + 1)[owner]
    owner, rank, place = owner[own], rank[own], place[own]
    n = np.bincount(owner, minlength=len(number))
    row = np.array([number[x] for x in text], np.int64)
    m = n[row]
    places = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m - (np.cumsum(n) - n)[row], m)
    return np.repeat(np.arange(len(text)), m), rank[places], place[places], size[row]


def meetings(group: np.ndarray, main: np.ndarray, row: np.ndarray, token: np.ndarray, place: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): rows of one group that share a shingle early enough to reach the threshold, some STEP_PAIRS at a time.

    The smaller set b (or an equal one) shows only the first n - ceil(least
    overlap) + 1 of its shingles, and what both have from the shared one on must
    suffice for the least overlap.  Two rows that are ``main`` never meet.
    """
    share = threshold / (1 + threshold)
    order = np.lexsort((row, size[row], token, group[row]))
    row, token, place = row[order], token[order], place[order]
    new = np.append(True, (token[1:] != token[:-1]) | (group[row][1:] != group[row][:-1]))[: len(row)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(row) else row
    shown = place < size[row] - np.ceil(2 * share * size[row] - 1e-9) + 1
    left = size[row] - place
    for asks, holds in ((np.ones(len(row), bool), shown & ~main[row]), (~main[row], shown & main[row])):
        asks, holds = np.flatnonzero(asks), np.flatnonzero(holds)
        low, high = np.searchsorted(holds, first[asks]), np.searchsorted(holds, asks)
        asks, low, count = asks[high > low], low[high > low], (high - low)[high > low]
        seen, end = 0, np.cumsum(count)
        while seen < len(asks):
            to = max(seen + 1, int(np.searchsorted(end, (end[seen - 1] if seen else 0) + STEP_PAIRS, side="right")))
            c = count[seen:to]
            a = np.repeat(asks[seen:to], c)
            b = holds[np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c - low[seen:to], c)]
            seen = to
            fit = np.minimum(left[a], left[b]) >= share * (size[row[a]] + size[row[b]]) - 1e-9
            yield row[a[fit]], row[b[fit]]


def block_links(group: np.ndarray, part: np.ndarray, whole: np.ndarray, main: np.ndarray, root: np.ndarray, text: list[str], threshold: float) -> list[tuple[int, int]]:
    """Links that join all roots of rows of one group at the threshold: of whole groups any two rows, of others those of two parts.

    Rows that are ``main`` have their key's commonest root, so two of them are never compared.
    """
    row, token, place, size = prefixes(text, threshold)
    labels, length, out = Labels(root), np.array([len(x) for x in text]), []
    for a, b in meetings(group, main, row, token, place, size, threshold):
        fit = (labels.of[a] != labels.of[b]) & (whole[a] | (part[a] != part[b]))
        pairs = distinct(a[fit] * len(text) + b[fit])
        a, b = pairs // len(text), pairs % len(text)
        while len(a):
            n = max(1, int(np.searchsorted(np.cumsum(length[a] + length[b]), STEP, side="right")))
            hit = similar([text[i] for i in a[:n]], [text[i] for i in b[:n]], threshold)
            out += [(x, y) for x, y, yes in zip(a[:n].tolist(), b[:n].tolist(), hit, strict=True) if yes and labels.union(x, y)]
            labels.settle()
            a, b = a[n:], b[n:]
            apart = labels.of[a] != labels.of[b]
            a, b = a[apart], b[apart]
    return out


def _block_links(threshold: float):
    """Links within the groups (key, i, j) of sorted rows; many small groups are joined in one go."""

    def joined(held: pa.Table) -> pa.RecordBatch:
        column = lambda c: held.column(c).to_numpy()
        key, i, j, line = column("key"), column("i"), column("j"), column("line")
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        links = block_links(np.cumsum(new), column("part"), i == j, column("main").astype(bool), column("root"), held.column("text").to_pylist(), threshold)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(line[ends[:, 0]], pa.int64()), pa.array(line[ends[:, 1]], pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            chars += batch.column("text").nbytes
            if chars < BLOCK_CHARS:
                continue
            rows = pa.Table.from_batches(held)
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            # The last group may go on.
            cut = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[-1])
            if cut:
                yield joined(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                chars = sum(x.column("text").nbytes for x in held)
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


def apart_links(hot: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): verified links that join what is still apart of each hot key's lines (key, line), so that no pair is left.

    Lines of a key's commonest root (main) meet only those of other roots.  A
    key with more than a block of lines is dealt to blocks, and each two blocks
    that may hold such a pair meet in one group.
    """
    named = hot.join(roots, hot["line"] == roots["node"], "left").select("key", "line", F.coalesce("root", "line").alias("root"))
    named = stage(named, "hot")
    counts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = stage(counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "most"), "mixed")
    rows = named.join(mixed, "key").select("key", "line", "root", (F.col("root") == F.col("most")).alias("main"))
    rows = stage(rows.join(texts, "line"), "apart")
    size = rows.groupBy("key").agg(*[f(F.when(side, x)).alias(f"{name}_{what}") for name, side in (("main", F.col("main")), ("other", ~F.col("main"))) for what, f, x in (("n", F.count, F.lit(1)), ("chars", F.sum, F.length("text")))])
    parts = lambda n, chars: F.ceil(F.greatest(F.lit(1), n / BLOCK, chars / BLOCK_CHARS)).cast("int")
    one = (F.col("main_n") + F.col("other_n") <= BLOCK) & (F.col("main_chars") + F.col("other_chars") <= BLOCK_CHARS)
    size = size.select("key", one.alias("one"), parts(F.col("main_n"), F.col("main_chars")).alias("mains"), parts(F.col("other_n"), F.col("other_chars")).alias("others"))
    rows = rows.join(size, "key")
    part = F.when(F.col("one"), 0).when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("line"), "mains")).otherwise(F.pmod(F.xxhash64("line"), "others")).cast("int")
    rows = rows.withColumn("part", part)
    pair = lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j"))
    met = F.when(F.col("one"), F.array(F.lit(0))).when(F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    rows = rows.select("key", "line", "root", "main", "part", "text", F.inline(F.transform(met, pair)))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select("key", "i", "j", "part", "main", "root", "line", "text").mapInArrow(_block_links(threshold), "src long, dst long")


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, pivot) and (key, line): pairs of lines that share a band, and the lines of the keys that have more pairs.

    A key's distinct lines are counted before they meet.  They are chained in
    runs of about ``GROUP``, ordered by their next key, which similar lines
    often share too.  Each is paired with its key's smallest line (pivot) and
    the ``NEAR`` before it; that joins most of what is similar, and what is left
    of a key of more than NEAR + 1 lines is for ``apart_links``.
    """
    spark = lines.sparkSession
    fresh = lines.where("bands is not null").select("line", "bands")
    sent = spark.sparkContext.broadcast(bitmap(stage(shared_keys(fresh), "keys"), "key"))
    members = fresh.mapInArrow(in_short_batches(_members(sent)), "key long, line long, near long").groupBy("key", "line", "near").agg(F.count(F.lit(1)).alias("n")).drop("n")
    members = stage(members, "members")
    groups = members.groupBy("key").agg(F.min("line").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = members.join(groups.where(F.col("n") > NEAR + 1).select("key"), "key").select("key", "line")
    members = members.join(groups, "key").withColumn("part", F.pmod(F.col("line"), F.ceil(F.col("n") / GROUP)))
    chain = Window.partitionBy("key", "part").orderBy("near", "line")
    pairs = members.select("line", F.array(F.struct(F.col("pivot").alias("b"), F.lit(True).alias("pivot")), *[F.struct(F.lag("line", i).over(chain).alias("b"), F.lit(False).alias("pivot")) for i in range(1, NEAR + 1)]).alias("others"))
    both = pairs.select(F.col("line").alias("a"), F.inline("others")).where("a <> b")
    return both.groupBy("a", "b").agg(F.max("pivot").alias("pivot")), hot


def line_components(docs: DataFrame, lines: DataFrame, threshold: float = SIMILAR, own: DataFrame | None = None, id_bits: int = 64) -> DataFrame:
    """(node, root) of lines with a verified link.

    Pairs with a key's pivot are verified first; then, of the others, only those
    whose ends are still apart: of the chains, and at last all that hot keys have.
    Only texts of lines in a pair move.
    """
    spark = lines.sparkSession
    pairs, hot = candidates(lines)
    pairs = stage(pairs, "candidates")
    ends = stage(pairs.select(F.col("a").alias("line")).unionAll(pairs.select("b")).distinct(), "ends")
    # Given identifiers are looked up, so what was given a new one isn't sought by it.
    sent = spark.sparkContext.broadcast(bitmap(ends, "line") if own is None else None)
    texts = with_own_ids(docs.select(text_or_empty().alias("text")).mapInArrow(_texts(sent, id_bits), "line long, other long, text string"), own)
    texts = stage(texts.groupBy("line", "text").agg(F.count(F.lit(1)).alias("n")).select("line", "text"), "texts")

    def verified(some: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("line").alias("a"), F.col("text").alias("a_text")), texts.select(F.col("line").alias("b"), F.col("text").alias("b_text"))
        return some.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(in_short_batches(_similar(threshold)), "src long, dst long")

    links = stage(verified(pairs.where("pivot")), "links")
    roots = connected_components(links)
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = pairs.where("not pivot").join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = stage(verified(apart), "more")
    if not more.isEmpty():
        roots = extended_components(roots, more)
    last = stage(apart_links(hot, roots, texts, threshold), "last")
    return roots if last.isEmpty() else extended_components(roots, last)


def dedup_lines(docs: DataFrame, threshold: float = SIMILAR, id_bits: int = 64) -> DataFrame:
    """One row per non-blank line of ``docs`` (doc_id, text): doc_id, check, line_no (from 0), line_id, component_id, kept.

    Lines (cut at line feeds) are compared in lower case with white space
    collapsed.  Lines are linked at a Jaccard similarity of ``threshold`` or
    more of their character shingles; equal lines always are.  A line's
    identifier is a hash of ``id_bits`` bits; lines that share one and differ in
    another 64 get identifiers of their own.  Of a component the first line by
    doc_id and line number is kept (of rows that repeat a doc_id, one row's).
    Blank lines, null and empty texts give no row; a line of any length takes
    part whole; a null doc_id comes first in the order.  An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("check"), text_or_empty().alias("text"))
    lines = stage(rows.mapInArrow(_lines(id_bits), f"row long, doc_id {kind}, check long, line_no int, line long, other long, bands array<long>"), "lines")
    own = own_ids(lines.where("bands is not null"))
    lines = with_own_ids(lines, own)
    roots = line_components(docs, lines, threshold, own, id_bits)
    named = lines.drop("bands").join(roots, lines["line"] == roots["node"], "left").withColumn("component_id", F.coalesce("root", "line")).drop("node", "root")
    named = stage(named, "named")
    first = stage(named.groupBy("component_id").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first")).select("component_id", F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_line")), "first")
    out = named.join(first, "component_id")
    kept = (F.col("row") == F.col("first_row")) & (F.col("line_no") == F.col("first_line"))
    return out.select("doc_id", "check", "line_no", F.col("line").alias("line_id"), "component_id", kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``docs`` with the lines that are not kept cut out of ``text``, all other columns unchanged, whatever their names.

    Null texts stay null; rows that repeat a doc_id and text each keep the lines
    that any of them keeps.
    """
    lines = dedup_lines(docs, threshold).select("check", "line_no", "kept", *[c.alias(k) for k, c in key_parts().items()])
    gone = lines.groupBy("no_id", "id", "check", "line_no").agg(F.max("kept").alias("kept")).where("not kept")
    gone = gone.groupBy("no_id", "id", "check").agg(F.collect_set("line_no").alias("gone"))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    rows = packed_rows(docs, text=F.col("text"), check=F.xxhash64(text_or_empty()), **key_parts()).join(gone, ["no_id", "id", "check"], "left")
    return unpacked(rows.withColumn("r", F.when(F.col("gone").isNull(), F.col("r")).otherwise(F.col("r").withField("text", left))))
