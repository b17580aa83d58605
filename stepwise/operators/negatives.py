"""Preference pairs: the recorded action against deterministic negatives.  All row-local."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import center, clamp, first_at, from_pixel, once, point, primary_point, to_pixel
from stepwise.functions.maps import entries, merged
from stepwise.functions.text import uniform

# Tries for a point off all elements, and the shifts, nearest first.
RANDOM_TRIES = 50
MOVES = ("swipe", "scroll")
OFFSET = 120.0
RADII = (1.0, 1.5, 2.0)
DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))
ORDER = ("random_coordinate", "shifted_coordinate", "same_screen_element", "wrong_action_type")
#: Random points and shifts that are tried before the rest; most steps need no more, and the first random point often does.
FIRST_TRIES = 4


def _action(
    kind: Column | str,
    at: Column | None = None,
    text: Column | None = None,
    start: Column | None = None,
    end: Column | None = None,
    direction: Column | None = None,
    metadata: Column | None = None,
) -> Column:
    none = F.lit(None).cast("struct<x:double,y:double>")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        (none if at is None else at).alias("point"),
        (none if start is None else start).alias("start_point"),
        (none if end is None else end).alias("end_point"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None).cast("string") if direction is None else direction).alias("direction"),
        F.col("action.coordinate_space").alias("coordinate_space"),
        (entries() if metadata is None else metadata).alias("metadata"),
    )


def _negative(action: Column, source: str, subtype: Column | str) -> Column:
    """An action whose metadata tell where it comes from, and the same as columns."""
    kind = F.lit(subtype) if isinstance(subtype, str) else subtype
    told = merged(action["metadata"], entries(negative_source=source, negative_subtype=kind))
    return F.struct(action.withField("metadata", told).alias("action"), F.lit(source).alias("negative_source"), kind.alias("negative_subtype"))


def _attempt(i: Column, seed: int, key: Column | None = None) -> Column:
    screen, key = F.col("screen_size"), F.col("_key") if key is None else key
    return point(uniform(key, i, "x", seed) * (screen["width"] - 1), uniform(key, i, "y", seed) * (screen["height"] - 1))


def with_sampling(steps: DataFrame, seed: int = 42) -> DataFrame:
    """``steps`` (with ``boxes``) and what the samplers share: pixel point, element, random point, shifted points, another element.

    The random point is the first of RANDOM_TRIES points that lies on no valid
    element, else the last; the step's key and the seed fix them all.  Each is
    computed once a step; points after the first, and those and shifts after the
    FIRST_TRIES, only where those before all lie on elements.
    """
    screen, boxes, p, source = F.col("screen_size"), F.col("boxes"), F.col("_p"), F.col("_source")
    key = F.concat_ws(":", "episode_id", F.col("step_id").cast("string"))
    at = F.when(screen.isNotNull(), _attempt(F.lit(0), seed, key))
    df = once(steps, _p=to_pixel(primary_point(F.col("action")), screen, F.col("action.coordinate_space")), _key=key, _first=at)
    taken = lambda q: F.exists(boxes, lambda b: b["valid"] & q["x"].between(b["x1"], b["x2"]) & q["y"].between(b["y1"], b["y2"]))
    free = lambda low, high: F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: _attempt(i, seed)), lambda q: ~taken(q)), F.lit(0))
    off = lambda shifts: F.get(F.filter(F.array(*shifts), lambda q: first_at(boxes, q)["pos"].isNull()), F.lit(0))
    shifts, shifted = _shifts(OFFSET), p.isNotNull() & ~F.col("action.type").isin(*MOVES)
    unheld = F.coalesce(F.when(~taken(F.col("_first")), F.col("_first")), free(1, FIRST_TRIES), free(FIRST_TRIES, RANDOM_TRIES))
    df = once(
        df, _source=F.when(p.isNotNull(), first_at(boxes, p)), _free=F.when(screen.isNotNull(), unheld),
        _off=F.when(shifted, F.coalesce(off(shifts[:FIRST_TRIES]), off(shifts[FIRST_TRIES:]))),
    )
    other = F.get(F.filter(F.array(*shifts), lambda q: ~first_at(boxes, q)["pos"].eqNullSafe(source["pos"])), F.lit(0))
    others = F.filter(boxes, lambda b: b["valid"] & (source.isNull() | ~b["index"].eqNullSafe(source["index"])))
    df = once(df, _pixel=F.coalesce("_free", F.when(screen.isNotNull(), _attempt(F.lit(RANDOM_TRIES - 1), seed))), _other=F.when(shifted & F.col("_off").isNull(), other), _others=others)
    pick = F.get("_others", F.floor(uniform(F.col("_key"), F.lit(0), "element", seed) * F.size("_others")).cast("int"))
    return once(df, _pick=pick)


def random_coordinate() -> Column:
    screen, space = F.col("screen_size"), F.col("action.coordinate_space")
    at = F.coalesce(from_pixel(F.col("_pixel"), screen, space), point(F.lit(0.0), F.lit(0.0)))
    return _negative(_action("click", at), "random_coordinate", F.when(screen.isNull() | F.col("_free").isNotNull(), "random_non_ui_point").otherwise("random_coordinate"))


def reversed_swipe() -> Column:
    a = F.col("action")
    swapped = _action(a["type"], a["end_point"], a["text"], a["end_point"], a["start_point"], a["direction"], a["metadata"])
    ends = a["start_point"].isNotNull() & a["end_point"].isNotNull()
    return F.when(ends, _negative(swapped, "shifted_coordinate", "wrong_swipe_direction")).otherwise(random_coordinate())


def _moved(dx: Column, dy: Column) -> Column:
    p, screen, zero = F.col("_p"), F.col("screen_size"), F.lit(0.0)
    return point(clamp(p["x"] + dx, zero, (screen["width"] - 1).cast("double")), clamp(p["y"] + dy, zero, (screen["height"] - 1).cast("double")))


def _shifts(offset: float) -> list[Column]:
    """Where each shift leads."""
    return [_moved(F.lit(offset * r * dx), F.lit(offset * r * dy)) for r in RADII for dx, dy in DIRECTIONS]


def shifted_coordinate() -> Column:
    """The first shift off all elements, else the first onto another element, else a fixed one."""
    a, screen = F.col("action"), F.col("screen_size")
    at = from_pixel(F.coalesce("_off", "_other", _moved(F.lit(OFFSET), F.lit(OFFSET))), screen, a["coordinate_space"])
    subtype = F.when(F.col("_off").isNotNull(), "near_miss_non_ui_shift").when(F.col("_other").isNotNull(), "shifted_other_ui_element").otherwise("shifted_coordinate_fallback")
    shifted = _negative(_action(a["type"], at, a["text"], a["start_point"], a["end_point"], a["direction"], a["metadata"]), "shifted_coordinate", subtype)
    return F.when(a["type"].isin(*MOVES), reversed_swipe()).when(F.col("_p").isNull(), random_coordinate()).otherwise(shifted)


def same_screen_element() -> Column:
    """The middle of another valid element, picked by the step's key; its index, text and type go to the metadata."""
    other = F.col("_pick")
    at = from_pixel(center(other), F.col("screen_size"), F.col("action.coordinate_space"))
    facts = entries(ui_element_index=other["index"], ui_element_text=other["label"], ui_element_type=other["ui_type"])
    found = _negative(_action("click", at, metadata=facts), "same_screen_element", "wrong_ui_element")
    return F.when(F.coalesce(F.size("_others") > 0, F.lit(False)), found).otherwise(random_coordinate())


def wrong_action_type() -> Column:
    a = F.col("action")
    typed = _negative(_action("type", text=F.lit("")), "wrong_action_type", "click_to_type")
    clicked = _negative(_action("click", F.coalesce(primary_point(a), point(F.lit(0.0), F.lit(0.0)))), "wrong_action_type", F.concat(a["type"], F.lit("_to_click")))
    return F.when(a["type"] == "click", typed).otherwise(clicked)


#: Strategies by name; the order is that in which a limited number is taken.
SAMPLERS: dict[str, Callable[[], Column]] = {
    "random_coordinate": random_coordinate,
    "shifted_coordinate": shifted_coordinate,
    "same_screen_element": same_screen_element,
    "wrong_action_type": wrong_action_type,
}


def preference_pairs(steps: DataFrame, strategies: int = len(ORDER), seed: int = 42) -> DataFrame:
    """Each step against the first ``strategies`` negatives: pair_id, negative_type, chosen, rejected, source and subtype.

    ``negative_type`` is the strategy's name even where it fell back to another.
    The step's own columns stay.  One row becomes ``strategies`` rows; no shuffle.
    """
    df = with_sampling(steps, seed)
    made = F.array(*[F.struct(F.lit(name).alias("negative_type"), SAMPLERS[name]().alias("n")) for name in ORDER[:strategies]])
    keep = [c for c in steps.columns if c != "action"]
    # Made below the generator, which would interpret all of it.
    df = df.select(*keep, F.col("action").alias("chosen"), made.alias("_made")).select(*keep, "chosen", F.explode("_made").alias("m"))
    key = F.concat_ws(":", "episode_id", F.col("step_id").cast("string"), "m.negative_type")
    return df.select(*keep, key.alias("pair_id"), F.col("m.negative_type"), "chosen", F.col("m.n.action").alias("rejected"), F.col("m.n.negative_source"), F.col("m.n.negative_subtype"))
