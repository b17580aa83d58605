"""Exact top-k by integer inner product: MaxScore over shards of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import smallest, stage

SCALE = 256
#: Vectors in a shard of postings, and queries in a block.
SHARD_ROWS = 4096
QUERY_ROWS = 2048
#: Shards and blocks of queries that one task holds against each other: a shard moves once for so many blocks.
CELL_SHARDS, CELL_BLOCKS = 2, 16
#: Terms that are probed between two tests of the bounds.
STEP = 8
#: Vectors that every query is scored against first, for a threshold to begin with.
SEEDS = 1024


def weights(vectors: DataFrame, scale: int = SCALE, *others: str) -> DataFrame:
    """(vec_id, others, w): floor(scale * x) of each component; vectors that are null, empty or hold null or non-finite components go.

    A component whose product reaches 2^62 raises: whole numbers of 64 bits would not hold it.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v * scale) < float(1 << 62), F.floor(v * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return vectors.where(sound).select("vec_id", *others, F.transform(x, whole).alias("w"))


def _pack(rows_of: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dim: int) -> pd.DataFrame:
            rows = held.pop(dim)
            ids = np.array([i for i, _ in rows], dtype="<i8")
            postings = np.stack([w for _, w in rows]).T.astype("<i8")
            return pd.DataFrame({"dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()], "postings": [np.ascontiguousarray(postings).tobytes()]})

        for batch in batches:
            for i, w in zip(batch["vec_id"], batch["w"], strict=True):
                rows = held.setdefault(len(w), [])
                rows.append((i, np.asarray(w)))
                if len(rows) >= rows_of:
                    yield flush(len(w))
        for dim in list(held):
            yield flush(dim)

    return pack


def packed(rows: DataFrame, rows_of: int) -> DataFrame:
    """Blocks of vectors of one length: dim, n, ids and the weights term by term (a block's postings), with a number (part)."""
    return rows.mapInPandas(_pack(rows_of), "dim int, n int, ids binary, postings binary").withColumn("part", F.monotonically_increasing_id())


class Shard:
    """Postings of a block of vectors: of each term all weights, and the vectors in order of it."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        self.ids, self.postings = ids, postings
        self.order = np.argsort(postings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(postings, self.order, axis=1)
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]

    def postings_above(self, term: int, weight: int, excess: int) -> np.ndarray:
        """The vectors to whose sums a query's term adds more than ``excess`` beyond the least it can."""
        if weight > 0:
            return self.order[term, np.searchsorted(self.sorted[term], self.low[term] + excess // weight, side="right") :]
        return self.order[term, : np.searchsorted(self.sorted[term], self.high[term] - excess // -weight, side="left")]


class Found:
    """A query's k best so far, and the score that a further vector has to reach."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.threshold = k, floor
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            least = int(self.scores[-1])
            self.threshold = least if self.threshold is None else max(self.threshold, least)


def search(query: np.ndarray, own: int, shard: Shard, found: Found) -> int:
    """Add a shard's vectors to what is found for a query; the number of postings that were looked at.

    Terms come in order of their spans: the most that a term can add here, less
    the least.  The last ones whose spans together can't lift a sum to the
    threshold are not essential.  What the threshold leaves besides is dealt to
    the essential terms: a vector that exceeds none's share can't reach it, so
    only postings beyond the shares are traversed.  The vectors found there are
    then probed term by term, as long as their sums may still reach the
    threshold, which rises with the sums that are sure.
    """
    upper, lower = np.maximum(query * shard.high, query * shard.low), np.minimum(query * shard.high, query * shard.low)
    order = np.argsort(lower - upper, kind="stable")
    span = (upper - lower)[order]
    rest = np.concatenate((np.cumsum(span[::-1])[::-1], [0]))
    rest_low = np.concatenate((np.cumsum(lower[order][::-1])[::-1], [0]))
    base, seen = int(lower.sum()), 0
    alive = np.arange(len(shard.ids))
    if found.threshold is not None:
        if base + rest[0] < found.threshold:
            return 0
        essential = int(np.argmax(base + rest < found.threshold)) if base < found.threshold else len(order)
        slack = found.threshold - 1 - base - int(rest[essential])
        if slack > 0:
            shares = [slack * int(s) // max(1, int(span[:essential].sum())) for s in span[:essential]]
            lists = []
            for term, share in zip(order[:essential], shares, strict=True):
                lists.append(shard.postings_above(term, int(query[term]), share) if query[term] else alive[:0])
                seen += len(lists[-1])
                if seen >= len(alive):
                    # No fewer than there are vectors: the lists tell nothing more.
                    break
            else:
                alive = np.unique(np.concatenate(lists)) if lists else alive[:0]
    alive = alive[shard.ids[alive] != own]
    sums = np.zeros(len(alive), dtype=np.int64)
    for at in range(0, len(order), STEP):
        if not len(alive):
            return seen
        terms = order[at : at + STEP]
        part = shard.postings[terms] if len(alive) == len(shard.ids) else shard.postings[np.ix_(terms, alive)]
        sums = sums + query[terms] @ part
        seen += part.size
        done = min(at + STEP, len(order))
        threshold = found.threshold
        if len(alive) > found.k:
            sure = int(np.partition(sums, len(sums) - found.k)[len(sums) - found.k] + rest_low[done])
            threshold = sure if threshold is None else max(threshold, sure)
        if threshold is not None:
            keep = sums + rest_low[done] + rest[done] >= threshold
            if not keep.all():
                alive, sums = alive[keep], sums[keep]
    found.add(sums, shard.ids[alive])
    return seen


def fits(queries: np.ndarray, postings: np.ndarray) -> None:
    """Raise where a sum of products may leave 64 bits, so that none wraps around."""
    reach = lambda w: max(abs(int(w.max(initial=0))), abs(int(w.min(initial=0))))
    if queries.shape[1] * reach(queries) * reach(postings) >= 1 << 63:
        raise OverflowError("components are too large: a score may not fit into 64 bits")


def floors(queries: np.ndarray, own: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> list[int | None]:
    """Each query's k-th best score among the seeds (one vector an id), its own id apart: k vectors reach it for sure."""
    if len(seed_ids) <= k:
        return [None] * len(queries)
    fits(queries, seeds)
    out: list[int | None] = []
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ seeds.T
        scores[own[at : at + 256, None] == seed_ids[None, :]] = np.iinfo(np.int64).min
        out += np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].tolist()
    return out


def _search_cells(k: int, seeds):
    """Search each cell's shards, which follow its queries, one after another; a threshold goes on from shard to shard."""

    def done(own: np.ndarray, found: list[Found]) -> pd.DataFrame:
        n = [len(f.ids) for f in found]
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"query_id": np.repeat(own, n), "vec_id": np.concatenate(none + [f.ids for f in found]), "score": np.concatenate(none + [f.scores for f in found])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, queries, own, found = None, np.zeros((0, 0), np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            for x in batch.itertuples(index=False):
                ids, postings = np.frombuffer(x.ids, "<i8"), np.frombuffer(x.postings, "<i8").reshape(x.dim, -1)
                if cell != (x.dim, x.q, x.s):
                    if len(own):
                        yield done(own, found)
                    cell, queries, own, found = (x.dim, x.q, x.s), np.zeros((0, x.dim), np.int64), np.zeros(0, np.int64), []
                if x.kind == 0:
                    queries, own = np.concatenate((queries, postings.T)), np.concatenate((own, ids))
                    seed_ids, vectors = seeds.value.get(x.dim, (np.zeros(0, np.int64), np.zeros((0, x.dim), np.int64)))
                    found += [Found(k, f) for f in floors(postings.T, ids, vectors, seed_ids, k)]
                elif len(own):
                    fits(queries, postings)
                    shard = Shard(ids, postings)
                    for i in range(len(own)):
                        search(queries[i], own[i], shard, found[i])
        if len(own):
            yield done(own, found)

    return run


def seed_vectors(rows: DataFrame, limit: int = SEEDS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and vectors of at most ``limit`` ids, one vector each, those of the smallest hashes."""
    ids = stage(smallest(rows.select("vec_id"), "vec_id", F.xxhash64(F.lit("seed"), F.col("vec_id")), limit), "seeds")
    got = rows.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("w").alias("w")).collect()
    by_dim: dict[int, list[tuple[int, list[int]]]] = {}
    for r in sorted(got):
        by_dim.setdefault(len(r["w"]), []).append((r["vec_id"], r["w"]))
    return {dim: (np.array([i for i, _ in held]), np.array([w for _, w in held])) for dim, held in by_dim.items()}


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's k highest scores: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but the query's own (all rows of its vec_id).  Vectors are packed
    into shards and queries into blocks; a cell of a few shards and blocks meets
    in one task, which holds the blocks and one shard at a time, and the cells'
    best are merged by query, k rows from each at most.  A query's threshold
    begins with its k-th best among a bounded sample of vectors (``SEEDS``, the
    only ones that are broadcast) and goes on from shard to shard.

    Vectors that are null, empty or hold null or non-finite components take no
    part, rows with a null vec_id neither; vectors of different lengths are not
    compared.  Rows that repeat a vec_id are candidates of their own, and a
    query that is repeated is answered for each distinct vector, the best of
    all; equal scores go to the smaller vec_id.  Where the largest components of
    a block of queries and of a shard could give a score beyond 64 bits, the
    search raises; nothing wraps around.  Empty tables give no rows.
    Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = weights(vectors.where("vec_id is not null"))
    shards = stage(packed(rows, shard_rows), "shards")
    wanted = rows.where(F.col("vec_id") % every == 0)
    tasks = 1 + wanted.count() // (4 * query_rows)
    asked = stage(packed(wanted.repartition(tasks), query_rows), "queries")
    seeds = spark.sparkContext.broadcast(seed_vectors(rows))
    # Rows of each length: how many cells its shards and blocks are dealt to.
    cells = lambda df, of, name: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / of).cast("int").alias(name))
    grid = stage(cells(shards, CELL_SHARDS, "across").join(cells(asked, CELL_BLOCKS, "down"), "dim"), "grid")
    number = lambda n: F.pmod(F.xxhash64("part"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shards = shards.join(grid, "dim").select("dim", all_of("down").alias("q"), number("across").alias("s"), F.lit(1).alias("kind"), "ids", "postings")
    asked = asked.join(grid, "dim").select("dim", number("down").alias("q"), all_of("across").alias("s"), F.lit(0).alias("kind"), "ids", "postings")
    met = asked.unionByName(shards).repartition("dim", "q", "s").sortWithinPartitions("dim", "q", "s", "kind")
    found = met.mapInPandas(_search_cells(k, seeds), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
