"""False-negative filter: which rejected actions may be right after all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import once, overlap, primary_point, to_pixel
from stepwise.functions.maps import entries
from stepwise.operators.profile import histograms
from stepwise.operators.regions import CARD, COMPACT, CTA, SEARCH, in_region, on_products, with_region

# Kinds by confidence, the overlap that counts, variants and what they drop.
HIGH_CONFIDENCE = (CTA, COMPACT)
FUNCTIONAL = (SEARCH, CTA, COMPACT, CARD)
OVERLAP = 0.5
VARIANTS = {"clean_filter": ("filter",), "ambiguous_removed": ("filter", "ambiguous")}


def _said(decision: str, reason: str, category: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(category).alias("major_category"))


def _clicked(action: Column) -> Column:
    return F.when(action["type"] == "click", to_pixel(primary_point(action), F.col("screen_size"), action["coordinate_space"]))


def with_target_region(rows: DataFrame, action: str = "action") -> DataFrame:
    """``rows``, the region of their recorded click, and ``product_task``: on steps, they are found once for all pairs that are made of them."""
    return with_region(once(rows, _c=_clicked(F.col(action)), product_task=on_products(F.col("task"))), F.col("_c"), "target_region").drop("_c")


def decided(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with ``boxes``, ``screen_size``, ``task``) and decision, reason, major_category and both regions.

    The first test that holds decides.  Regions are those of clicks; no
    shuffle.  A ``target_region`` that the pairs have from their steps is taken
    as it is, and so is ``product_task``, which goes.
    """
    chosen, rejected = F.col("chosen"), F.col("rejected")
    df = pairs if "target_region" in pairs.columns else with_target_region(pairs, "chosen")
    df = with_region(once(df, _r=_clicked(rejected)), F.col("_r"), "candidate_region")
    df = once(df, region_overlap=overlap(F.col("target_region"), F.col("candidate_region")))
    kind, other = F.col("target_region.kind"), F.col("candidate_region.kind")
    by_type = F.col("negative_type") == "wrong_action_type"
    inside = in_region("target_region", F.col("_r"))
    same = F.coalesce(kind == other, F.lit(False)) & (F.col("region_overlap") >= OVERLAP)
    moves = lambda a: a["type"].isin("swipe", "scroll")
    tree = (
        F.when(moves(rejected) | moves(chosen), _said("ambiguous", "swipe_or_scroll_uncertain", "ambiguous_or_uncertain"))
        .when((rejected["type"] != "click") & by_type, _said("keep", "wrong_action_type_non_click", "wrong_action_type"))
        .when(rejected["type"] != "click", _said("ambiguous", "non_click_candidate_unchecked", "ambiguous_or_uncertain"))
        .when((chosen["type"] != "click") & by_type, _said("keep", "wrong_action_type_click_instead_of_non_click", "wrong_action_type"))
        .when(chosen["type"] != "click", _said("ambiguous", "non_click_gt_unchecked", "ambiguous_or_uncertain"))
        .when(inside & ~kind.isin(*HIGH_CONFIDENCE), _said("ambiguous", "candidate_inside_low_confidence_target_region", "ambiguous_or_uncertain"))
        .when(inside, _said("filter", "candidate_inside_high_confidence_target_region", "negative_construction_error"))
        .when(same & kind.isin(*HIGH_CONFIDENCE), _said("filter", "candidate_same_high_confidence_functional_region", "negative_construction_error"))
        .when(same & kind.isin(*FUNCTIONAL), _said("ambiguous", "candidate_same_low_confidence_functional_region", "ambiguous_or_uncertain"))
        .when(other.isNull(), _said("keep", "candidate_no_ui_region", "clean_negative"))
        .when(other.isin(*FUNCTIONAL) | F.col("negative_type").isin("same_screen_element", "shifted_coordinate"), _said("keep", "candidate_other_ui_or_functional_region", "semantic_hard_negative"))
        .otherwise(_said("keep", "candidate_other_ui_region", "clean_negative"))
    )
    return once(df, _d=tree).select("*", "_d.*").drop("_d", "_r", "product_task")


def last_by_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows that repeat a key, the one that came last by ``pos``, which tells a key's rows apart."""
    rest = [c for c in rows.columns if c not in (key, pos)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_last")).select(key, *[f"_last.{c}" for c in rest])


def with_decision(pairs: DataFrame, decisions: DataFrame, pos: str = "pos") -> DataFrame:
    """``pairs`` with their decision columns; the last of repeated decisions counts, and a pair without one raises."""
    out = pairs.join(last_by_key(decisions, "pair_id", pos), "pair_id", "left")
    return out.where(F.assert_true(F.col("decision").isNotNull(), "a pair has no decision").isNull())


def variant(pairs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (with ``decision``) and ``kept`` by a variant."""
    return pairs.withColumn("kept", ~F.col("decision").isin(*VARIANTS[name]))


# What a kept pair's metadata tell of its decision, by the decision's column.
FILTER_KEYS = {
    "v3_filter_decision": "decision",
    "v3_filter_reason": "reason",
    "v3_major_category": "major_category",
    "target_region_kind": "target_region_kind",
    "candidate_region_kind": "candidate_region_kind",
}
DECISION_COLUMNS = tuple(FILTER_KEYS.values())


def with_filter_metadata(decided_pairs: DataFrame) -> DataFrame:
    """Pairs with their decision's columns as a map ``filter_metadata``; these columns go."""
    told = entries(**{k: F.col(c).cast("string") for k, c in FILTER_KEYS.items()})
    return decided_pairs.withColumn("filter_metadata", told).drop(*DECISION_COLUMNS, "kept")


def variant_summary(marked: DataFrame, times: str | None = None) -> DataFrame:
    """(dim, value, n) of a variant's pairs (``kept`` or not), in one pass: kept ones by decision, category and type; dropped ones by decision, reason, type, type and reason; a row stands for ``times`` pairs."""
    kept = lambda c: F.when(F.col("kept"), F.coalesce(c, F.lit("unknown")))
    gone = lambda c: F.when(~F.col("kept"), F.coalesce(c, F.lit("unknown")))
    kind = F.col("negative_type")
    by_reason = F.concat_ws("->", F.coalesce(kind, F.lit("unknown")), F.coalesce("reason", F.lit("unknown")))
    return histograms(marked, {
        "num_pairs": F.when(F.col("kept"), "all"),
        "kept_decisions": kept(F.col("decision")),
        "kept_major_categories": kept(F.col("major_category")),
        "kept_negative_types": kept(kind),
        "num_dropped_pairs": F.when(~F.col("kept"), "all"),
        "dropped_decisions": gone(F.col("decision")),
        "dropped_reasons": gone(F.col("reason")),
        "dropped_negative_types": gone(kind),
        "dropped_by_negative_type_reason": F.when(~F.col("kept"), by_reason),
    }, times)


def decision_summary(decided_pairs: DataFrame) -> DataFrame:
    """(dim, value, n) of decided pairs: decisions, reasons and categories, alone and by type or subtype, in one pass."""
    arrow = lambda a, b: F.concat_ws("->", a, b)
    kind, sub = F.col("negative_type"), F.coalesce("negative_subtype", F.lit("unknown"))
    return histograms(decided_pairs, {
        "decision": F.col("decision"), "reason": F.col("reason"), "category": F.col("major_category"), "negative_type": kind, "negative_subtype": sub,
        "decision_by_type": arrow(kind, "decision"), "category_by_type": arrow(kind, "major_category"), "reason_by_type": arrow("reason", kind), "decision_by_subtype": arrow(sub, "decision"),
    })
