"""Quality rules over steps: four predicates, a mean score, a bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import primary_point, to_pixel

# Action types, the longest typed text, the shortest instruction, the buckets.
ACTION_TYPES = ("click", "type", "scroll", "swipe", "back", "home", "wait", "finish", "impossible")
MAX_TEXT, MIN_TASK = 256, 3
BUCKETS = ((0.8, "high"), (0.5, "medium"))
LOW = "low"


def rules(allowed: Sequence[str] = ()) -> dict[str, Column]:
    """Each rule by name: whether a step passes.  No allowed types given: all."""
    action, screen = F.col("action"), F.col("screen_size")
    p = to_pixel(primary_point(action), screen, action["coordinate_space"])
    inside = (p["x"] >= 0) & (p["x"] < screen["width"]) & (p["y"] >= 0) & (p["y"] < screen["height"])
    typed = F.coalesce(action["text"], F.lit(""))
    return {
        "action_type": action["type"].isin(list(allowed or ACTION_TYPES)),
        "coordinate_in_screen": F.coalesce(inside, F.lit(True)),
        "text_input": (action["type"] != "type") | ((F.length(F.trim(typed)) > 0) & (F.length(typed) <= MAX_TEXT)),
        "instruction": F.length(F.trim(F.coalesce("task", F.lit("")))) >= MIN_TASK,
    }


def bucket(score: Column, buckets: Sequence[tuple[float, str]] = BUCKETS) -> Column:
    out = F.when(F.lit(False), "")
    for least, name in buckets:
        out = out.when(score >= least, name)
    return out.otherwise(LOW)


def audited(steps: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """``steps`` with a column ``audit``: key, findings, quality_score, quality_bucket.  Row-local."""
    passed = rules(allowed)
    findings = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("passed"), v.cast("double").alias("score")) for k, v in passed.items()])
    score = sum((v.cast("double") for v in passed.values()), F.lit(0.0)) / len(passed)
    key = F.concat_ws(":", "episode_id", F.col("step_id").cast("string"))
    return steps.withColumn("audit", F.struct(key.alias("key"), findings.alias("findings"), score.alias("quality_score"), bucket(score).alias("quality_bucket")))
