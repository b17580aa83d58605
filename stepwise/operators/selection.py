"""Selection by quality, difficulty and diversity; splits; samples per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.geometry import once
from stepwise.functions.text import collapsed, md5_mod, split_name, split_of
from stepwise.operators.places import numbered

# The order of the quality buckets.
QUALITY = {"low": 0, "medium": 1, "high": 2}


def difficulty(score: Column, model_error: Column, quality: Column) -> Column:
    return F.coalesce(score, model_error, 1 - F.coalesce(quality, F.lit(1.0)))


def step_difficulty(metadata: Column, quality: Column) -> Column:
    """A step's difficulty: what its metadata say, else what it lacks in quality."""
    told = lambda key: F.try_element_at(metadata, F.lit(key)).cast("double")
    return difficulty(told("difficulty_score"), told("model_error_rate"), quality)


#: Beyond this many rows a type, Spark's group limit doesn't cut a type below the shuffle, and rows are numbered by ranges.
GROUP_LIMIT = 1000


def last_turn(sizes: list[int], max_samples: int) -> int:
    """The last turn in which all types that have rows left can give one, so that no more than ``max_samples`` are given."""
    turn, left, given = 0, sorted(sizes), 0
    while left:
        step = left[0] - turn
        if given + step * len(left) > max_samples:
            return turn + (max_samples - given) // len(left)
        given, turn = given + step * len(left), left[0]
        left = [n for n in left if n > turn]
    return turn


def _many_diverse(rows: DataFrame, least: int, max_samples: int) -> DataFrame:
    """``select_diverse`` for many rows a type: turns are places in the order by type, difficulty and key, counted by ranges, from each type's end.

    The last turn that is given whole follows from the types' sizes (a row a
    type comes to the driver), so that rows beyond it are cut by a filter.
    """
    sizes = {r["action_type"]: r["n"] for r in rows.groupBy("action_type").agg(F.count(F.lit(1)).alias("n")).orderBy("action_type").collect()}
    ends, total = {}, 0
    for kind, n in sizes.items():
        total += n
        ends[kind] = total
    end = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])[F.col("action_type")] if ends else F.lit(0)
    turns = numbered(rows, ["action_type", "difficulty", "key"], "turn").withColumn("turn", (end - F.col("turn") + 1).cast("int"))
    capped = {k: min(n, least) for k, n in sizes.items()}
    turn = last_turn(list(capped.values()), max_samples)
    # Of the turn after it, the first types give what is left.
    rest = max_samples - sum(min(n, turn) for n in capped.values())
    more = [k for k in sorted(capped) if capped[k] > turn][: max(0, rest)]
    kept = turns.where((F.col("turn") <= turn) | ((F.col("turn") == turn + 1) & F.col("action_type").isin(more)))
    return kept.where(F.col("turn") <= least).orderBy("turn", "action_type")


def select_diverse(rows: DataFrame, max_samples: int, min_quality: str = "high", per_action: int | None = None) -> DataFrame:
    """Round robin over action types, the most difficult first: ``rows`` (key, action_type, bucket, difficulty) with turn and position.

    Rows of equal difficulty come by key, descending.  A type's rows beyond
    ``max_samples`` can never be chosen, so each type keeps that many before
    the types meet: up to ``GROUP_LIMIT`` by Spark's group limit, a partial one
    before the shuffle, and beyond it by counted ranges.
    """
    rank = {k: v for k, v in QUALITY.items() if v >= QUALITY[min_quality]}
    least = min(max_samples, per_action) if per_action is not None else max_samples
    rows = rows.where(F.coalesce("bucket", F.lit("low")).isin(list(rank))).withColumn("action_type", F.coalesce("action_type", F.lit("unknown")))
    if least > GROUP_LIMIT:
        return _many_diverse(rows, least, max_samples)
    order = Window.partitionBy("action_type").orderBy(F.desc("difficulty"), F.desc("key"))
    turns = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= least)
    return turns.orderBy("turn", "action_type").limit(max_samples)


def with_split(rows: DataFrame, instruction: str, train: float = 0.8, val: float = 0.1, bucket: str | None = None) -> DataFrame:
    """Add ``split`` by the instruction's hash: equal instructions stay together, and nothing is shuffled.

    ``bucket``: a column for the hash's bucket too; the text's normal form is made once for both.
    """
    if bucket is None:
        return rows.withColumn("split", split_name(F.col(instruction), train, val))
    return once(rows, **{bucket: md5_mod(collapsed(F.col(instruction)))}).withColumn("split", split_of(F.col(bucket), train, val))


def first_per_group(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in input order (``order``), with their place ``rn``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows that the seed picks by the md5 of their key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary")), key).limit(n)


def write_split(rows: DataFrame, path: str) -> DataFrame:
    """Write a folder for each split and return the counts."""
    rows.write.mode("overwrite").partitionBy("split").json(path)
    return rows.groupBy("split").count()
