"""Error analysis of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import distance_bucket
from stepwise.functions.text import action_text, compact
from stepwise.operators.pair_filter import last_by_key
from stepwise.operators.places import numbered
from stepwise.operators.profile import histograms, with_pair_facts

# Labels that a reviewer chooses from; lengths of review texts.
REVIEW_LABELS = ("clean_error", "semantic_hard", "ambiguous", "construction_error")
TEXT_LENGTHS = {"instruction": 300, "candidate_action_text": 260, "gt_action_text": 260, "candidate_element_text": 180, "gt_element_text": 180}


def is_error(correct: Column, label: Column, predicted: Column) -> Column:
    return F.coalesce(~correct, ~label.eqNullSafe(predicted))


def subtype(negative_subtype: Column, negative_source: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(negative_subtype), blank(negative_source), F.lit("unknown"))


def errors(predictions: DataFrame, focus: str | None = None) -> DataFrame:
    """The wrong predictions; ``focus``: only those of one kind, as ``Yes->No``."""
    wrong = predictions.where(is_error(F.col("correct"), F.col("label"), F.col("prediction_label")))
    return wrong.where(F.concat_ws("->", "label", "prediction_label") == focus) if focus else wrong


def enriched(wrong: DataFrame, pairs: DataFrame, pos: str = "pos") -> DataFrame:
    """Errors with what their pair tells (left join, the last of repeated pairs): elements, distance, bucket."""
    # Facts are row-local and narrow: they are found before the pairs move, so that no screen's boxes are shuffled.
    facts = with_pair_facts(pairs)
    found = F.col("rejected_element")
    facts = facts.select(
        "pair_id",
        pos,
        F.col("chosen").alias("gt_action"),
        action_text(F.col("chosen")).alias("gt_action_text"),
        found.alias("candidate_element"),
        "gt_element",
        F.coalesce(found["label"], F.lit("")).alias("candidate_element_text"),
        F.coalesce(F.col("gt_element.label"), F.lit("")).alias("gt_element_text"),
        found.isNotNull().alias("candidate_in_ui_element"),
        F.col("same_element").alias("same_element_as_gt"),
        "distance_px",
    )
    facts = facts.join(wrong.select("pair_id").distinct(), "pair_id", "left_semi")
    return wrong.join(last_by_key(facts, "pair_id", pos), "pair_id", "left").withColumn("distance_bucket", distance_bucket(F.col("distance_px")))


def _told(cases: DataFrame, name: str, none: str = "") -> Column:
    """A column as text, ``none`` where it is null or the cases lack it."""
    return F.coalesce(F.col(name).cast("string"), F.lit(none)) if name in cases.columns else F.lit(none)


def _of(cases: DataFrame, struct: str, field: str) -> Column:
    return F.coalesce(F.col(f"{struct}.{field}"), F.lit("")) if struct in cases.columns else F.lit("")


def review_rows(cases: DataFrame, order: list[str], negative_subtype: str | None = None, action_type: str | None = None) -> DataFrame:
    """Enriched errors as a reviewer's rows: numbered from 1 in ``order``, 25 columns, texts compacted; one subtype or action type if asked.

    Columns that the cases lack, and nulls, are empty texts.
    """
    sub, kind = subtype(F.col("negative_subtype"), F.col("negative_source")), F.col("candidate_action.type")
    if negative_subtype is not None:
        cases = cases.where(sub == negative_subtype)
    if action_type is not None:
        cases = cases.where(kind == action_type)
    as_json = lambda name: F.coalesce(F.to_json(name), F.lit("{}")).alias(f"{name}_json") if name in cases.columns else F.lit("{}").alias(f"{name}_json")
    plain = ("distance_px", "distance_bucket", "candidate_in_ui_element", "same_element_as_gt")
    texts = [compact(_told(cases, k), n).alias(k) for k, n in TEXT_LENGTHS.items()]
    # Rows are numbered when their texts are cut, so that whole instructions aren't sorted.
    rows = cases.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(order)],
        F.lit("").alias("review_label"),
        F.lit("").alias("notes"),
        F.lit("|".join(REVIEW_LABELS)).alias("suggested_labels"),
        _told(cases, "label").alias("label"),
        _told(cases, "prediction_label").alias("prediction"),
        _told(cases, "negative_type").alias("negative_type"),
        sub.alias("negative_subtype"),
        F.coalesce(kind, F.lit("unknown")).alias("candidate_action_type"),
        *[_told(cases, k).alias(k) for k in plain],
        *texts,
        _of(cases, "candidate_element", "ui_type").alias("candidate_element_type"),
        _of(cases, "gt_element", "ui_type").alias("gt_element_type"),
        *[_told(cases, k).alias(k) for k in ("image", "sample_id", "pair_id")],
        as_json("candidate_action"),
        as_json("gt_action"),
    )
    by = [f"_by_{i}" for i in range(len(order))]
    return numbered(rows, by, "case_index").select(F.col("case_index").cast("int").alias("case_index"), *[c for c in rows.columns if c not in by])


def _case_facts(cases: DataFrame) -> dict[str, Column]:
    flag = lambda name: _told(cases, name, "unknown")
    return {
        "candidate_action_type": F.coalesce(F.col("candidate_action.type"), F.lit("unknown")),
        "distance_bucket": flag("distance_bucket"),
        "candidate_in_ui_element": flag("candidate_in_ui_element"),
        "same_element_as_gt": flag("same_element_as_gt"),
    }


def _with_instructions(cases: DataFrame, dims: dict[str, Column], top: int) -> DataFrame:
    said = cases.groupBy(F.coalesce("instruction", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return histograms(cases, dims).unionByName(said.select(F.lit("instruction").alias("dim"), "value", "n"))


def error_summary(wrong: DataFrame, top: int = 20) -> DataFrame:
    """(dim, value, n) of enriched errors: confusion, type and subtype (of those labelled No), action type, distance, elements, top instructions.

    The ``top`` most frequent instructions count, ties by text.
    """
    no = F.col("label") == "No"
    sub = subtype(F.col("negative_subtype"), F.col("negative_source"))
    dims = {"error": F.concat_ws("->", "label", "prediction_label"), "negative_type": F.when(no, F.col("negative_type")), "negative_subtype": F.when(no, sub)}
    return _with_instructions(wrong, {**dims, **_case_facts(wrong)}, top)


def badcase_summary(cases: DataFrame, top: int = 20) -> DataFrame:
    """(dim, value, n) of the cases that go to a reviewer, whatever their label: their number, then as ``error_summary``."""
    dims = {"all": F.lit("all"), "negative_type": _told(cases, "negative_type"), "negative_subtype": subtype(F.col("negative_subtype"), F.col("negative_source"))}
    return _with_instructions(cases, {**dims, **_case_facts(cases)}, top)


def marker_style(x: Column, y: Column) -> Column:
    """A normalised point as a marker's place: clamped to [0, 1], in percent."""
    part = lambda v: F.format_number(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 100, 3)
    return F.concat(F.lit("left: "), part(x), F.lit("%; top: "), part(y), F.lit("%;"))


# The sides of a screen whose size is unknown.
WIDTH, HEIGHT = 720, 1520


def aspect_ratio(screen: Column) -> Column:
    side = lambda name, none: F.greatest(F.coalesce(F.nullif(screen[name], F.lit(0)), F.lit(none)), F.lit(1)).cast("string")
    return F.concat(side("width", WIDTH), F.lit(" / "), side("height", HEIGHT))


def action_markers(action: Column) -> Column:
    """Where a page marks an action (points are normalised): (label, style) of a click's point or a move's ends; empty without any."""
    marks = []
    for label, kinds, name in (("click", ("click",), "point"), ("start", ("swipe", "scroll"), "start_point"), ("end", ("swipe", "scroll"), "end_point")):
        mark = F.struct(F.lit(label).alias("label"), marker_style(action[name]["x"], action[name]["y"]).alias("style"))
        marks.append(F.when(action["type"].isin(*kinds) & action[name].isNotNull(), mark))
    return F.array_compact(F.array(*marks))
