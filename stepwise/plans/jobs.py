"""End-to-end jobs: raw records to steps, pairs, scorer rows and reports.

Every job writes what the next step reads, as JSON lines in folders below
``out`` (shared storage on a cluster), so a lost executor recomputes one stage,
and returns the counts.  Reports are small results, one file each.
"""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.operators import audit, negatives, pair_filter, profile, regions, scorer, selection
from stepwise.operators.transforms import in_space
from stepwise.sources import episodes, jsonl, lines

# Endings of raw files' names that the tag leaves out; rows that the first census looks at.
TAG_ENDINGS = ("_with_images", "_raw")
CENSUS_ROWS = 50


def tag_of(path: str) -> str:
    """A run's tag: the file's name without suffix and endings."""
    name = PurePath(path).stem
    for ending in TAG_ENDINGS:
        name = name.removesuffix(ending)
    return name


def _report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def _staged(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as written to ``path`` and read again."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return jsonl.read_jsonl(rows.sparkSession, path, rows.schema)


def prepare_pairs(spark: SparkSession, raw: str, out: str, tag: str | None = None, source: str = "coded", selected: int = 200) -> dict[str, int]:
    """Raw JSON lines to a census, steps, normalised steps, a profile, audited steps, pairs and a selection."""
    tag = tag or tag_of(raw)
    at = lambda name: f"{out}/{tag}_{name}"
    texts = lines.first_lines(spark, raw, CENSUS_ROWS).select(F.col("value").alias("raw"))
    _report(profile.record_census(texts, limit=None), at("census"))
    steps = _staged(episodes.parser(source)(jsonl.read_records(spark, raw)), at("steps"))
    in_space(steps).write.mode("overwrite").option("ignoreNullFields", "false").json(at("steps_normalized"))
    _report(profile.step_profile(steps), at("step_profile"))
    audited = _staged(audit.audited(steps), at("audited"))
    pairs = _staged(negatives.preference_pairs(regions.with_pixel_boxes(steps)), at("pairs"))
    hard = selection.step_difficulty(F.col("metadata"), F.col("audit.quality_score"))
    rows = audited.withColumns({"key": F.col("audit.key"), "action_type": F.col("action.type"), "bucket": F.col("audit.quality_bucket"), "difficulty": hard})
    picked = selection.select_diverse(rows, selected).select("turn", "difficulty", *audited.columns)
    picked.write.mode("overwrite").option("ignoreNullFields", "false").json(at("selected"))
    return {"num_steps": steps.count(), "num_pairs": pairs.count()}


def _split(rows: DataFrame, path: str) -> dict[str, int]:
    split = selection.with_split(rows, "instruction")
    counts = {r["split"]: r["count"] for r in selection.write_split(split, path).collect()}
    for name in counts:
        part = split.where(F.col("split") == name)
        _report(scorer.scorer_summary(part), f"{path}_{name}_summary")
        _report(scorer.scorer_histograms(part), f"{path}_{name}_histograms")
    return counts


def pair_schema(spark: SparkSession) -> StructType:
    """The schema that ``preference_pairs`` gives to pairs."""
    none = episodes.coded_episodes(spark.createDataFrame([], "raw string").select(F.parse_json("raw").alias("raw")))
    return negatives.preference_pairs(regions.with_pixel_boxes(none)).schema


def checked_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Written pairs as ``lines.checked_lines`` gives them."""
    return lines.checked_lines(spark, path, pair_schema(spark), episodes.pair_checks())


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """Written pairs with their place ``pos``; a bad line raises."""
    return lines.strict(checked_pairs(spark, path))


def rejects(spark: SparkSession, pairs: str, out: str) -> dict[str, int]:
    """Written pairs to good ones and to rejects, which keep their file, place, reason and line; how many of each."""
    checked = checked_pairs(spark, pairs)
    good = _staged(lines.accepted(checked).drop("pos"), f"{out}/accepted")
    bad = _staged(lines.rejected(checked), f"{out}/rejected")
    return {"accepted": good.count(), "rejected": bad.count()}


def prepare_scorer(spark: SparkSession, raw: str, out: str, tag: str | None = None, source: str = "coded", selected: int = 200) -> dict[str, object]:
    """``prepare_pairs``, then the pairs' profile, scorer rows and their splits, each with a summary."""
    tag = tag or tag_of(raw)
    counts = prepare_pairs(spark, raw, out, tag, source, selected)
    pairs = _pairs(spark, f"{out}/{tag}_pairs")
    _report(profile.pair_profile(pairs.drop("pos")), f"{out}/{tag}_pair_profile")
    rows = _staged(scorer.scorer_rows(pairs), f"{out}/{tag}_scorer")
    return {**counts, "num_scorer_rows": rows.count(), "splits": _split(rows, f"{out}/{tag}_splits")}


def filter_pairs(spark: SparkSession, pairs: str, out: str, per_decision: int = 20) -> dict[str, int]:
    """Written pairs to decisions, their summary and the first cases of each decision, in the pairs' order; counts by decision."""
    decided = pair_filter.decided(_pairs(spark, pairs))
    kinds = F.col("target_region.kind").alias("target_region_kind"), F.col("candidate_region.kind").alias("candidate_region_kind")
    told = "negative_type", "negative_subtype", "decision", "reason", "major_category"
    kept = _staged(decided.select("pos", "pair_id", *told, *kinds, "target_region", "candidate_region", "region_overlap"), f"{out}/decisions")
    _report(pair_filter.decision_summary(kept), f"{out}/decision_summary")
    _report(selection.first_per_group(kept, "decision", ["pos"], per_decision), f"{out}/decision_samples")
    return {r["decision"]: r["count"] for r in kept.groupBy("decision").count().collect()}


def ablation(spark: SparkSession, pairs: str, decisions: str, out: str) -> dict[str, dict[str, object]]:
    """Written pairs and decisions to each variant's kept pairs, scorer rows, splits and report.

    Of decisions that repeat a pair, the last line counts, over all files by
    their paths; a pair without one raises.  Kept pairs carry what was decided in
    ``filter_metadata``.  The report (dim, value, n) is the variant's summary.
    """
    rows = _pairs(spark, pairs).drop("pos")
    said = lines.typed_lines(spark, decisions, ", ".join(f"{c} string" for c in ("pair_id", *pair_filter.DECISION_COLUMNS)))
    decided = pair_filter.with_decision(rows, said)
    done = {}
    for name in pair_filter.VARIANTS:
        marked = pair_filter.variant(decided, name)
        summary = pair_filter.variant_summary(marked)
        _report(summary, f"{out}/{name}_summary")
        kept = _staged(pair_filter.with_filter_metadata(marked.where("kept")), f"{out}/{name}_pairs")
        scored = _staged(scorer.scorer_rows(kept), f"{out}/{name}_scorer")
        done[name] = {
            "drop_decisions": sorted(pair_filter.VARIANTS[name]),
            "num_pairs": kept.count(),
            "num_scorer_rows": scored.count(),
            "splits": _split(scored, f"{out}/{name}_splits"),
        }
    return done
