"""Column functions on points, boxes and coordinate spaces.

A point is struct<x,y>; a box struct<x1,y1,x2,y2,coordinate_space>; a screen
struct<width,height>.  Spaces are ``pixel``, ``normalized_1000`` and
``normalized_1``; any other raises when a row needs it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The coordinate spaces and the parts of a side that one is.
SPACES = {"pixel": None, "normalized_1000": 1000.0, "normalized_1": 1.0}
# Limits of the distance buckets, in pixels.
DISTANCE_BUCKETS = ((20, "<=20px"), (50, "<=50px"), (100, "<=100px"))
FAR_BUCKET, UNKNOWN_BUCKET = ">100px", "unknown"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later steps name them.

    A plain projection may be merged into those above it, or into a filter that
    is pushed below it, which repeats nested expressions many times over; a
    generated row of one element is neither merged nor passed.  The columns are
    worked out in a projection below it, as compiled code: a generator that
    holds a higher-order function is interpreted as a whole.
    """
    mine = {f"_once_{k}": c.alias(f"_once_{k}") for k, c in columns.items()}
    row = F.struct(*[F.col(m).alias(k) for m, k in zip(mine, columns, strict=True)])
    return df.select("*", *mine.values()).select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(row)))


def settled(df: DataFrame) -> DataFrame:
    """``df``, each of its columns worked out once a row though later steps take several fields of it; columns that none takes are left out."""
    return df.select("*", F.inline(F.array(F.struct(F.lit(True).alias("_settled"))))).drop("_settled")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x worked out once, however often f names it; within a lambda too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _scale(value: Column, side: Column, space: Column, to_pixel: bool) -> Column:
    out = F.when(space == "pixel", value)
    for name, parts in SPACES.items():
        if parts:
            out = out.when(space == name, value / parts * side if to_pixel else value / side * parts)
    unknown = F.raise_error(F.concat(F.lit("unknown coordinate space: "), space)).cast("double")
    return out.when(space.isNull() | value.isNull(), F.lit(None)).otherwise(unknown)


def to_pixel(p: Column, screen: Column, space: Column) -> Column:
    """Point in pixels; null without point or screen."""
    moved = point(_scale(p["x"], screen["width"], space, True), _scale(p["y"], screen["height"], space, True))
    return F.when(p.isNotNull() & screen.isNotNull(), moved)


def from_pixel(p: Column, screen: Column, space: Column) -> Column:
    moved = point(_scale(p["x"], screen["width"], space, False), _scale(p["y"], screen["height"], space, False))
    return F.when(p.isNotNull() & screen.isNotNull(), moved)


def box(x1: Column, y1: Column, x2: Column, y2: Column, space: Column | str = "pixel") -> Column:
    sides = (v.cast("double").alias(k) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)))
    return F.struct(*sides, (F.lit(space) if isinstance(space, str) else space).alias("coordinate_space"))


def _box_to(b: Column, screen: Column, space: Column, pixel: bool, name: Column) -> Column:
    sides = [_scale(b[k], screen["width" if k[0] == "x" else "height"], space, pixel) for k in ("x1", "y1", "x2", "y2")]
    return F.when(b.isNotNull() & screen.isNotNull(), box(*sides, name))


def box_to_pixel(b: Column, screen: Column) -> Column:
    return _box_to(b, screen, b["coordinate_space"], True, F.lit("pixel"))


def box_from_pixel(b: Column, screen: Column, space: Column) -> Column:
    return _box_to(b, screen, space, False, space)


def box_to_space(b: Column, screen: Column, space: Column) -> Column:
    return box_from_pixel(box_to_pixel(b, screen), screen, space)


def pixel_sides(b: Column, screen: Column) -> dict[str, Column]:
    """A box's sides in pixels, each worked out by itself: a field of ``box_to_pixel`` works out all four, where nothing is compiled."""
    return {k: _scale(b[k], screen["width" if k[0] == "x" else "height"], b["coordinate_space"], True) for k in ("x1", "y1", "x2", "y2")}


def valid_box(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def center(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def contains(b: Column, p: Column) -> Column:
    """Both sides of the box count as inside; null where either is missing."""
    return p["x"].between(b["x1"], b["x2"]) & p["y"].between(b["y1"], b["y2"])


def primary_point(action: Column) -> Column:
    return F.coalesce(action["point"], action["start_point"])


def action_to_space(action: Column, screen: Column, space: Column) -> Column:
    """All points of an action in another space, whose name it takes; absent points stay absent."""
    out = action
    for name in ("point", "start_point", "end_point"):
        out = out.withField(name, from_pixel(to_pixel(action[name], screen, action["coordinate_space"]), screen, space))
    return out.withField("coordinate_space", space)


def pixel_boxes(elements: Column, screen: Column) -> Column:
    """A screen's elements as pixel boxes in list order; null without a screen.  ``text`` is in its normal form, ``label`` as given."""

    def one(e: Column, i: Column) -> Column:
        sides = [v.alias(k) for k, v in pixel_sides(e["bbox"], screen).items()]
        return F.struct(
            i.alias("pos"), e["index"].alias("index"), *sides,
            valid_box(e["bbox"]).alias("valid"), F.lower(F.trim(F.coalesce(e["text"], F.lit("")))).alias("text"), e["ui_type"].alias("ui_type"), e["text"].alias("label"),
        )

    return F.when(screen.isNotNull(), F.transform(elements, one))


def first_at(boxes: Column, p: Column, any_box: bool = False) -> Column:
    """The first box in list order that holds a point; ``any_box``: also boxes without width or height."""
    return F.get(F.filter(boxes, lambda b: contains(b, p) if any_box else b["valid"] & contains(b, p)), F.lit(0))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def held_at(boxes: Column, p: Column) -> Column:
    """All valid boxes that hold a point, the least area first, equal ones in list order; none without a point."""
    held = F.filter(boxes, lambda b: b["valid"] & contains(b, p))
    ordered = F.array_sort(F.transform(held, lambda b: F.struct(area(b).alias("area"), b["pos"].alias("pos"), b.alias("box"))))
    return F.transform(ordered, lambda x: x["box"])


# How much of an element's text its label tells, and decimals of a listed side.
LABEL_TEXT, LIST_DECIMALS = 24, 1


def element_label(element: Column) -> Column:
    """``index:type``, and ``:text`` of a text that isn't blank, cut to its beginning."""
    text = F.trim(F.coalesce(element["text"], F.lit("")))
    start = F.concat_ws(":", F.coalesce(element["index"].cast("string"), F.lit("None")), F.coalesce(element["ui_type"], F.lit("")))
    return F.when(text != "", F.concat(start, F.lit(":"), F.substring(text, 1, LABEL_TEXT))).otherwise(start)


def listed(b: Column, label: Column) -> Column:
    """A box as [x1, y1, x2, y2, label], its sides rounded, as JSON."""
    sides = [F.bround(b[k], LIST_DECIMALS).cast("string") for k in ("x1", "y1", "x2", "y2")]
    quoted = F.substring(F.to_json(F.array(label)), 2, 1_000_000_000)
    return F.concat(F.lit("["), F.concat_ws(", ", *sides), F.lit(", "), quoted)


def smallest_at(boxes: Column, p: Column) -> Column:
    """The valid box of the least area that holds a point, the first of equals."""
    held = F.filter(boxes, lambda b: b["valid"] & contains(b, p))
    return F.array_min(F.transform(held, lambda b: F.struct(area(b).alias("area"), b["pos"].alias("pos"), b.alias("box"))))["box"]


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def distance_bucket(d: Column) -> Column:
    out = F.when(d.isNull(), UNKNOWN_BUCKET)
    for limit, name in DISTANCE_BUCKETS:
        out = out.when(d <= limit, name)
    return out.otherwise(FAR_BUCKET)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller area (1 at least); 0 where a box is missing or they only touch."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when(a.isNotNull() & b.isNotNull() & (w > 0) & (h > 0), w * h / F.greatest(F.lit(1.0), F.least(area(a), area(b)))).otherwise(0.0)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))
