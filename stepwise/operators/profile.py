"""Descriptive statistics: steps, pairs, predictions, runs; a census of raw JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import bound, distance, distance_bucket, first_at, once, primary_point, to_pixel
from stepwise.functions.text import identity


def histograms(rows: DataFrame, dims: Mapping[str, Column], times: str | None = None) -> DataFrame:
    """(dim, value, n): several group-bys over one pass and one shuffle; null values don't count; a row stands for ``times`` rows."""
    n, kept = (F.count(F.lit(1)), []) if times is None else (F.sum(times), [times])
    cells = F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dims.items()])
    return rows.select(*kept, F.explode(cells).alias("c")).where("c.value is not null").groupBy("c.dim", "c.value").agg(n.alias("n"))


def step_profile(steps: DataFrame) -> DataFrame:
    """One row of step statistics, in one pass: sums by episode and by task (128 bits of it) are counted first, so no distinct set is gathered."""
    action, screen = F.col("action"), F.col("screen_size")
    p = to_pixel(primary_point(action), screen, action["coordinate_space"])
    rows = once(steps, _p=p).withColumn("_task", identity(F.col("task")))
    p = F.col("_p")
    out = ~((p["x"] >= 0) & (p["x"] < screen["width"]) & (p["y"] >= 0) & (p["y"] < screen["height"]))
    typed = action["type"] == "type"
    empty = typed & (F.length(F.trim(F.coalesce(action["text"], F.lit("")))) == 0)
    sums = {
        "len": F.count(F.lit(1)), "points": F.count_if(primary_point(action).isNotNull()), "outside": F.count_if(F.coalesce(out, F.lit(False))),
        "sx": F.sum(F.round(p["x"] / screen["width"], 9)), "sy": F.sum(F.round(p["y"] / screen["height"], 9)), "np": F.count(p), "typed": F.count_if(typed), "empty": F.count_if(empty),
    }
    both = rows.groupBy("episode_id", "_task").agg(*[v.alias(k) for k, v in sums.items()])
    # Each row stands once for its episode and once for its task.
    own = F.struct(F.lit(True).alias("episode"), F.col("episode_id").cast("binary").alias("key"), *sums)
    other = F.struct(F.lit(False).alias("episode"), F.col("_task").alias("key"), *[F.lit(None).alias(k) for k in sums])
    keyed = both.select(F.inline(F.array(own, other))).groupBy("episode", "key").agg(*[F.sum(k).alias(k) for k in sums])
    n, points = F.sum("len"), F.sum("points")
    return keyed.agg(
        n.alias("n_steps"), F.count_if("episode").alias("n_episodes"), F.min("len").alias("len_min"), F.max("len").alias("len_max"), F.avg("len").alias("len_mean"),
        points.alias("n_points"), F.sum("outside").alias("n_outside"), (F.sum("outside") / F.greatest(points, F.lit(1))).alias("outside_rate"),
        F.round(F.sum("sx") / F.sum("np"), 6).alias("mean_x"), F.round(F.sum("sy") / F.sum("np"), 6).alias("mean_y"),
        F.sum("typed").alias("n_typed"), F.sum("empty").alias("n_empty"), (F.sum("empty") / F.greatest(F.sum("typed"), F.lit(1))).alias("empty_rate"),
        F.count_if(~F.col("episode") & F.col("key").isNotNull()).alias("n_tasks"),
    )


def _pixel(action: str) -> Column:
    return to_pixel(primary_point(F.col(action)), F.col("screen_size"), F.col(f"{action}.coordinate_space"))


def _held(p: str) -> Column:
    return F.when(F.col(p).isNotNull(), first_at(F.col("boxes"), F.col(p), True))


def with_gt_element(steps: DataFrame) -> DataFrame:
    """``steps`` (with ``boxes``) and the element of their action: it is found once for all pairs that are made of a step."""
    return once(once(steps, _g=_pixel("action")), gt_element=_held("_g")).drop("_g")


def with_pair_facts(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with ``boxes``) and gt_element, rejected_element (first at the point, whatever its size), distance_px, same_element.

    A ``gt_element`` that the pairs have from their steps is taken as it is.
    """
    df = once(pairs, _g=_pixel("chosen"), _r=_pixel("rejected"))
    known = {} if "gt_element" in pairs.columns else {"gt_element": _held("_g")}
    df = once(df, **known, rejected_element=_held("_r"), distance_px=distance(F.col("_g"), F.col("_r")))
    same = F.coalesce(F.col("gt_element.index") == F.col("rejected_element.index"), F.lit(False))
    return df.withColumn("same_element", same).drop("_g", "_r")


def pair_profile(pairs: DataFrame) -> DataFrame:
    """(dim, value, n) of pairs with their facts."""
    arrow = lambda a, b: F.concat(a, F.lit("->"), b)
    return histograms(with_pair_facts(pairs), {
        "negative_type": F.col("negative_type"), "negative_subtype": F.coalesce("negative_subtype", F.lit("unknown")), "chosen_action_type": F.col("chosen.type"), "rejected_action_type": F.col("rejected.type"),
        "transition": arrow(F.col("chosen.type"), F.col("rejected.type")), "type_subtype": arrow(F.col("negative_type"), F.coalesce("negative_subtype", F.lit("unknown"))), "type_rejected": arrow(F.col("negative_type"), F.col("rejected.type")),
        "distance": distance_bucket(F.col("distance_px")), "rejected_in_ui": F.col("rejected_element").isNotNull(), "same_element": F.col("same_element"),
        "rejected_ui_type": F.when(F.col("rejected_element").isNotNull(), F.coalesce(F.expr("nullif(rejected_element.ui_type, '')"), F.lit("unknown"))),
    })


def prediction_metrics(rows: DataFrame, dims: Mapping[str, Column]) -> DataFrame:
    """(dim, value, total, correct, accuracy) of predictions by each dimension, in one pass; null values don't count."""
    cells = F.array(*[F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dims.items()])
    right = F.coalesce(F.col("correct"), F.col("label") == F.col("prediction_label")).cast("long").alias("ok")
    out = rows.select(right, F.explode(cells).alias("c")).where("c.value is not null").groupBy("c.dim", "c.value").agg(F.count(F.lit(1)).alias("total"), F.sum("ok").alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def run_comparison(rows: DataFrame, runs: list[str], slice_col: str) -> DataFrame:
    """One row for each slice, a column of accuracy for each run."""
    return rows.groupBy(slice_col).pivot("run", runs).agg(F.avg(F.col("correct").cast("double")))


# Reports of runs.

# Where a run's report keeps its figures.
REPORT_FIGURES = {
    "num_samples": ("$.num_samples", "long"),
    "accuracy": ("$.accuracy", "double"),
    "yes_accuracy": ("$.by_label.Yes.accuracy", "double"),
    "no_accuracy": ("$.by_label.No.accuracy", "double"),
}
REPORT_ERRORS = {"false_positive_no_to_yes": "$.confusion['No->Yes']", "false_negative_yes_to_no": "$.confusion['Yes->No']"}
REPORT_SLICES = {"negative_type": "by_negative_type_no_only", "negative_subtype": "by_negative_subtype_no_only", "action_type": "by_candidate_action_type"}


def run_figures(reports: DataFrame) -> DataFrame:
    """One row a report (run, VARIANT report): counts, accuracies (null where the report lacks them) and error counts (0 then)."""
    figures = [F.try_variant_get("report", path, kind).alias(name) for name, (path, kind) in REPORT_FIGURES.items()]
    wrong = [F.coalesce(F.try_variant_get("report", path, "long"), F.lit(0).cast("long")).alias(name) for name, path in REPORT_ERRORS.items()]
    return reports.select("run", *figures, *wrong)


def run_slices(reports: DataFrame, runs: list[str], dim: str) -> DataFrame:
    """The accuracies that reports give by ``dim`` (a key of REPORT_SLICES): a row a value, a column a run."""
    cells = F.try_variant_get("report", f"$.{REPORT_SLICES[dim]}", "map<string,variant>")
    rows = reports.select("run", F.explode(cells).alias(dim, "cell"))
    return rows.groupBy(dim).pivot("run", runs).agg(F.first(F.try_variant_get("cell", "$.accuracy", "double")))


# Raw JSON: a walk by levels over VARIANT.  Every level is one generator over the level before, so the source is read once.

CENSUS_DEPTH, CENSUS_ITEMS, CENSUS_ROWS = 12, 3, 20
# Names of JSON types; which paths hold actions, where an action object names its type, and how much of it counts.
TYPE_NAMES = {"VOID": "null", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "STRING": "str"}
ACTION_ENDS, ACTION_PART, ACTION_KEYS, ACTION_LENGTH, ACTION_TOP = ("action", "operation"), "action_type", ("type", "action_type", "action"), 120, 20


def json_type(v: Column) -> Column:
    def of(kind: Column) -> Column:
        out = F.when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list").when(kind.startswith("DECIMAL"), "float")
        for spark, name in TYPE_NAMES.items():
            out = out.when(kind == spark, name)
        return out.otherwise(F.lower(kind))

    return bound(F.schema_of_variant(v), of)


def action_said(path: Column, sample: Column) -> Column:
    """What an action-like path's sample says: a text, or the first type name of an object that isn't empty; null on other paths."""
    low = F.lower(path)
    here = low.contains(ACTION_PART)
    for end in ACTION_ENDS:
        here = here | low.endswith(end)
    names = [F.try_variant_get(sample, f"$.{k}", "string") for k in ACTION_KEYS]
    named = F.coalesce(*[F.when(n != "", n) for n in names[:-1]], names[-1])
    text = F.when(json_type(sample) == "str", F.try_variant_get(sample, "$", "string")).when(json_type(sample) == "dict", named)
    return F.when(here, F.substring(text, 1, ACTION_LENGTH))


def json_nodes(raw: DataFrame, column: str = "raw", limit: int | None = CENSUS_ROWS, depth: int = CENSUS_DEPTH, items: int = CENSUS_ITEMS) -> DataFrame:
    """(path, type, n, level, said): each value below the JSON texts in ``column``; keys are joined by dots, ``[]`` stands for a list's items.

    Of a list the first ``items`` are looked at.  A list counts twice (n): as a
    value and as the list that is entered; a record that is a list once.
    ``said`` is what an action-like path says, by its sample: the value that the
    path leads to where each ``[]`` is the first item.  A record that goes
    deeper than ``depth`` levels raises.  ``limit`` rows are looked at, as in a
    first look at unknown data; None looks at all.
    """
    rows = raw.select(F.parse_json(F.col(column)).alias("v"))
    rows = rows.limit(limit) if limit is not None else rows
    kind = "struct<path:string,type:string,n:int,level:int,said:string,v:variant,sample:variant>"

    def node(path: Column, n: Column, level: Column, said: Column | None, v: Column | None, sample: Column | None, named: Column) -> Column:
        null = F.lit(None)
        parts = (path, named, n, level, null if said is None else said, null if v is None else v, null if sample is None else sample)
        return F.struct(*[p.alias(k) for k, p in zip(("path", "type", "n", "level", "said", "v", "sample"), parts, strict=True)]).cast(kind)

    def child(path: Column, v: Column, sample: Column) -> Column:
        return bound(json_type(v), lambda named: node(path, F.when(named == "list", 2).otherwise(1), F.col("level") + 1, action_said(path, sample), v, sample, named))

    own = json_type(F.col("v"))
    level = rows.select(F.inline(F.array(node(F.lit(""), F.when(own == "list", 1).otherwise(0), F.lit(0), None, F.col("v"), F.col("v"), own))))
    path, v, sample = F.col("path"), F.col("v"), F.col("sample")
    prefix = F.when(F.col("level") == 0, "").otherwise(F.concat(path, F.lit(".")))
    keyed, samples = (F.try_variant_get(x, "$", "map<string,variant>") for x in (v, sample))
    of_object = F.transform(F.map_entries(keyed), lambda e: child(F.concat(prefix, e["key"]), e["value"], F.try_element_at(samples, e["key"])))
    first = F.when(~path.endswith("[]") & (F.col("level") > 0), F.try_variant_get(sample, "$[0]", "variant"))
    listed = F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, items)
    of_list = F.transform(listed, lambda x: child(F.concat(path, F.lit("[]")), x, first))
    below = F.when(v.isNull(), None).when(F.col("type") == "dict", of_object).when(F.col("type") == "list", of_list)
    closed = F.array(node(path, F.col("n"), F.col("level"), F.col("said"), None, None, F.col("type")))
    # Made below the generator, which would interpret all of it.
    step = F.concat(closed, F.coalesce(below, F.array().cast(f"array<{kind}>"))).alias("_below")
    for _ in range(depth):
        level = level.select(step).select(F.inline("_below"))
    inside = F.size(F.try_variant_get(v, "$", "array<variant>")) > 0
    deeper = F.coalesce(F.when(F.col("type") == "list", inside).when(F.col("type") == "dict", F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0), F.lit(False))
    level = level.where(F.assert_true(~deeper, f"records have more than {depth} levels").isNull())
    return level.select("path", "type", "n", "level", "said")


def json_census(raw: DataFrame, column: str = "raw", limit: int | None = CENSUS_ROWS, depth: int = CENSUS_DEPTH, items: int = CENSUS_ITEMS) -> DataFrame:
    """(path, type, n) of the values below the JSON texts in ``column`` (see ``json_nodes``)."""
    return json_nodes(raw, column, limit, depth, items).where("n > 0").groupBy("path", "type").agg(F.sum("n").alias("n"))


def record_census(raw: DataFrame, column: str = "raw", limit: int | None = CENSUS_ROWS, depth: int = CENSUS_DEPTH, items: int = CENSUS_ITEMS) -> DataFrame:
    """(dim, value, type, n): records, top-level keys, paths by type, and the most frequent values of action-like paths (ties by value)."""
    cell = lambda dim, value, n, kind=None: F.struct(F.lit(dim).alias("dim"), value.alias("value"), F.lit(kind).cast("string").alias("type") if kind is None else kind.alias("type"), n.alias("n"))
    top, one = F.col("level") == 1, F.lit(1)
    cells = F.array(
        F.when(F.col("level") == 0, cell("record", F.lit("all"), one)),
        F.when(top & ~F.col("path").endswith("[]"), cell("key", F.col("path"), one)),
        F.when(F.col("n") > 0, cell("path", F.col("path"), F.col("n"), F.col("type"))),
        F.when(F.col("said").isNotNull(), cell("action_like", F.col("said"), F.col("n"))),
    )
    found = json_nodes(raw, column, limit, depth, items).select(F.explode(cells).alias("c")).where("c is not null").select("c.*")
    counts = found.groupBy("dim", "value", "type").agg(F.sum("n").alias("n"))
    said = counts.where("dim = 'action_like'").orderBy(F.desc("n"), "value").limit(ACTION_TOP)
    return counts.where("dim <> 'action_like'").unionByName(said)
