"""Rule rewards of a candidate action, their weighted mean, and reranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.geometry import box_to_pixel, contains, distance, primary_point, to_pixel

# Decay of the coordinate reward, threshold of the state change, presets.
TAU_PX = 80.0
STATE_CHANGE = 0.01
PRESETS: dict[str, dict[str, float]] = {
    "grounding": {"format": 0.25, "coordinate": 1.0},
    "action_prediction": {"format": 0.5, "action_type": 1.0, "coordinate": 1.0, "text": 1.0},
    "full_audit": {"format": 0.5, "action_type": 1.0, "coordinate": 1.0, "text": 1.0, "state_change": 0.5},
}


def components(candidate: Column, reference: Column, screen: Column, target_box: Column, change: Column, tau: float = TAU_PX, threshold: float = STATE_CHANGE) -> dict[str, Column]:
    """Each component by name, in [0, 1]; ``reference`` may be null, and so may all that a step can lack."""
    p, q = primary_point(candidate), primary_point(reference)
    p_px, q_px = to_pixel(p, screen, candidate["coordinate_space"]), to_pixel(q, screen, reference["coordinate_space"])
    apart = F.when(screen.isNotNull(), distance(p_px, q_px)).otherwise(distance(p, q))
    inside = contains(box_to_pixel(target_box, screen), p_px).cast("double")
    coordinate = (
        F.when(~candidate["type"].isin("click", "swipe"), 1.0)
        .when(p.isNull(), 0.0)
        .when(target_box.isNotNull() & screen.isNotNull(), inside)
        .when(q.isNull(), 0.0)
        .otherwise(F.exp(-apart / tau))
    )
    a, b = F.coalesce(candidate["text"], F.lit("")), F.coalesce(reference["text"], F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    text = F.when(reference.isNull(), 0.0).when(candidate["type"] != "type", 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)
    return {
        "format": candidate["type"].isNotNull().cast("double"),
        "action_type": F.coalesce((candidate["type"] == reference["type"]).cast("double"), F.lit(0.0)),
        "coordinate": coordinate,
        "text": text,
        "state_change": F.coalesce((change >= threshold).cast("double"), F.lit(0.0)),
    }


def total(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean; a part without a weight weighs 1; weights that sum to nothing divide by 1."""
    weighed = {k: float(weights.get(k, 1.0)) for k in parts}
    out = F.lit(0.0)
    for name, part in parts.items():
        out = out + part * weighed[name]
    return out / (sum(weighed.values()) or 1.0)


def preset(name: str, candidate: Column, reference: Column, screen: Column, target_box: Column, change: Column) -> Column:
    """struct<total, components> by a preset's weights, over its own components only."""
    parts = components(candidate, reference, screen, target_box, change)
    own = {k: parts[k] for k in PRESETS[name]}
    return F.struct(total(own, PRESETS[name]).alias("total"), F.struct(*[v.alias(k) for k, v in own.items()]).alias("components"))


def reranked(candidates: DataFrame, keys: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """``candidates`` with ``rank`` from 1 within ``keys``: higher scores first, ties in input order."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(pos))
    return candidates.withColumn("rank", F.row_number().over(order))


def ranked_lists(candidates: DataFrame, keys: list[str], payload: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """One row for each of ``keys``, its candidates in order of rank.  A key's candidates are those of one step."""
    entry = F.struct((-F.col(score)).alias("_s"), F.col(pos).alias("_p"), *payload, score)
    ordered = F.array_sort(F.collect_list(entry))
    return candidates.groupBy(*keys).agg(ordered.alias("ranked")).withColumn("ranked", F.transform("ranked", lambda x: F.struct(*[x[c].alias(c) for c in [*payload, score]])))


def pair_report(scored: DataFrame, chosen: str, rejected: str, by: list[str], margins: Mapping[str, Column] | None = None) -> DataFrame:
    """Count, strict wins, ties and mean margin of all pairs and by ``by``, in one pass (the total's row has nulls)."""
    c, r = F.col(chosen), F.col(rejected)
    measures = [F.count(F.lit(1)).alias("n"), F.avg((c > r).cast("double")).alias("win_rate"), F.avg((c == r).cast("double")).alias("tie_rate"), F.avg(c - r).alias("mean_margin")]
    measures += [F.avg(v).alias(f"margin_{k}") for k, v in (margins or {}).items()]
    return scored.rollup(*by).agg(*measures)
