"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, in_bitmap, in_short_batches, stage, text_or_empty

END_OF_TEXT = "<|endoftext|>"
#: A chunk ends where the rolling hash of the last WINDOW bytes has these low bits zero.
WINDOW = 32
MASK = 1023
#: Bytes of a chunk, at least and at most.
LEAST, MOST = 512, 16384
#: Texts that hold other characters go to the library that defines the result, so
#: that the Unicode tables of the faster one need not be the same.
PLAIN = re.compile("[\x00-\x7f\xa0-ɏ‐-‟•…€]*")
#: A single blank between two other characters: a word starts there whatever stands around.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters from a chunk's end in which its last safe places are looked for first.
TAIL = 256

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class Codec:
    """Encodes as the tokenizer of the JSON file does, by the faster library where the two agree."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.exact = Tokenizer.from_file(json_path)
        self.exact.no_padding()
        self.exact.no_truncation()
        by_id = sorted(ranks, key=ranks.get) + [END_OF_TEXT.encode()]
        self.size = np.array([len(x) for x in by_id])
        self.names = [str(i) for i in range(len(by_id))]

    def encode(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text):
            return self.fast.encode(text, allowed_special="all")
        return self.exact.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)

    def at(self, ids: list[int], place: int) -> int:
        """The number of tokens before byte ``place``, where a word starts."""
        return int(np.searchsorted(np.cumsum(self.size[ids]), place, side="right"))


@functools.lru_cache(maxsize=4)
def codec(paths: tuple[str, str]) -> Codec:
    return Codec(*paths)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def chunks(text: str) -> list[str]:
    """Cut a text where the rolling hash says, never inside a character."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if n <= LEAST:
        return [text] if data else []
    codes = np.frombuffer(data, np.uint8)
    up, down = _powers(1 << max(18, n.bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n])))
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1]
    whole = np.append((codes & 0xC0) != 0x80, True)
    ends = np.flatnonzero(((rolled >> np.uint64(40)) & np.uint64(MASK)) == 0) + WINDOW
    out, last = [], 0
    for end in [*ends[whole[ends]].tolist(), n]:
        while end - last > MOST:
            cut = last + MOST
            while not whole[cut]:
                cut -= 1
            out.append(data[last:cut].decode())
            last = cut
        if end - last >= LEAST or end == n > last:
            out.append(data[last:end].decode())
            last = end
    return out


def digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "replace"), digest_size=16).digest()


def _short(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8")[::2]


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def _safe(text: str) -> tuple[list[int], list[int]] | None:
    """The first two and the last two safe places of a text; none if they are fewer than four."""
    head = [m.start() for m in islice(SAFE.finditer(text), 4)]
    if len(head) < 4:
        return None
    tail = [m.start() for m in SAFE.finditer(text, max(0, len(text) - TAIL))][-2:]
    if len(tail) < 2 or tail[0] < head[1]:
        tail = [m.start() for m in SAFE.finditer(text)][-2:]
    return head[:2], tail


def join(c: Codec, parts: list[tuple[str, list[int]]]) -> list[int]:
    """The ids of a whole text from its consecutive ``parts`` (text, ids).

    A seam is encoded again from the last safe place before it to the first one
    behind it, and once more from the second last to the second; where the two
    disagree, or a part has no such places, the parts are encoded as one.
    """
    done: list[int] = []
    text, ids = parts[0]
    for more, own in parts[1:]:
        a, b = _safe(text), _safe(more)
        agreed = False
        if a and b:
            (_, (far, near)), ((first, second), _) = a, b
            total = _bytes(text)
            t_far, t_near = c.at(ids, total - _bytes(text[far:])), c.at(ids, total - _bytes(text[near:]))
            h_first, h_second = c.at(own[: 4 * second + 8], _bytes(more[:first])), c.at(own[: 4 * second + 8], _bytes(more[:second]))
            seam = c.encode(text[near:] + more[:first])
            agreed = c.encode(text[far:] + more[:second]) == ids[t_far:t_near] + seam + own[h_first:h_second]
        if agreed:
            done += ids[:t_near] + seam
            # What stands before the first safe place of the part is settled.
            text, ids = more[first:], own[h_first:]
        else:
            text += more
            ids = c.encode(text)
    return done + ids


def _reusable(text: str) -> bool:
    return END_OF_TEXT not in text


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_short([digest(x) for x in cut]) for t in batch.column("text").to_pylist() if _reusable(t) and (cut := set(chunks(t)))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())], ["h"])


def _row(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    names = c.names
    return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]


def _alone(shared, paths: tuple[str, str]):
    """Encode the texts that share no chunk; pass the others on, with a hash of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, words = codec(paths), shared.value
        for batch in batches:
            rows, sha, kept = [], [], []
            for text in batch.column("text").to_pylist():
                cut = [digest(x) for x in chunks(text)] if _reusable(text) else []
                if cut and in_bitmap(words, _short(cut)).any():
                    rows.append((None, None, None))
                    sha.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    kept.append(text)
                else:
                    rows.append(_row(c, c.encode(text)))
                    sha.append(None)
                    kept.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *_columns(rows)], ["doc_id", "sha", "text", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _references(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            shas, pos, keys, texts = [], [], [], []
            for sha, text in zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cut = chunks(text)
                named = [digest(x) for x in cut]
                for i in np.flatnonzero(in_bitmap(words, _short(named))).tolist():
                    shas.append(sha)
                    pos.append(i)
                    keys.append(named[i])
                    texts.append(cut[i])
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.string()), pa.array(pos, pa.int32()), pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["sha", "pos", "key", "chunk"])

    return run


def _encode(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(paths)
        for batch in batches:
            ids = [np.array(c.encode(t), "<u2").tobytes() for t in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    return run


def _assemble(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(paths)
        for batch in batches:
            rows = []
            for text, given in zip(batch.column("text").to_pylist(), batch.column("given").to_pylist(), strict=True):
                known = {x["pos"]: np.frombuffer(x["ids"], "<u2").tolist() for x in given}
                parts: list[tuple[str, list[int]]] = []
                own = ""
                for i, chunk in enumerate(chunks(text)):
                    if i in known:
                        if own:
                            parts.append((own, c.encode(own)))
                            own = ""
                        parts.append((chunk, known[i]))
                    else:
                        own += chunk
                if own:
                    parts.append((own, c.encode(own)))
                rows.append(_row(c, join(c, parts)))
            yield pa.RecordBatch.from_arrays([batch.column("sha"), *_columns(rows)], ["sha", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``paths`` are the vocabulary's two files, which every node has.  Chunk
    hashes are counted over all documents; a chunk that several documents hold
    is encoded once and its ids are joined back.  A bit map, sized by their
    count, says which chunks may be shared: others never leave the task that
    read them, so only texts that share something move, once for each distinct
    text (beyond the largest map, every text).

    A null or empty text has no tokens; rows that repeat a doc_id or a text are
    answered each; a text with the end-of-text token is encoded whole, as the
    token may straddle a cut; a very long text is cut, encoded and decoded whole
    in the memory of one task.  An empty table gives no rows.  Other columns are
    not read, whatever their names.
    """
    spark = docs.sparkSession
    paths = paths or default_paths()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.select("text").mapInArrow(in_short_batches(_hashes), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shared = spark.sparkContext.broadcast(bitmap(stage(counted.where("n > 1").select("h"), "shared"), "h"))
    first = stage(rows.mapInArrow(in_short_batches(_alone(shared, paths)), f"doc_id {kind}, sha string, text string, {RESULT}"), "first")
    texts = stage(first.where("sha is not null").groupBy("sha", "text").agg(F.count(F.lit(1)).alias("n")).select("sha", "text"), "texts")
    refs = stage(texts.mapInArrow(in_short_batches(_references(shared)), "sha string, pos int, key binary, chunk string"), "refs")
    ids = stage(refs.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n")).select("key", "chunk").mapInArrow(in_short_batches(_encode(paths)), "key binary, ids binary"), "ids")
    given = refs.select("sha", "pos", "key").join(ids, "key").groupBy("sha").agg(F.collect_list(F.struct("pos", "ids")).alias("given"))
    joined = texts.join(given, "sha").select("sha", "text", "given").mapInArrow(in_short_batches(_assemble(paths)), f"sha string, {RESULT}")
    alone = first.where("sha is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return alone.unionByName(first.where("sha is not null").select("doc_id", "sha").join(stage(joined, "joined"), "sha").drop("sha"))
