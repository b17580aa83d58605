"""Functional regions: what else a tap on an element would have done the same with.

All is done within a row, on the array of a screen's pixel boxes: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import bound, clamp, contains, once, pixel_boxes, smallest_at

# Word lists and icon types.
SEARCH_WORD = "search"
SEARCH_ICON = "ICON_MAGNIFYING_GLASS"
SEARCH_ICONS = ("ICON_MAGNIFYING_GLASS", "ICON_MIC", "ICON_TAKE_PHOTO", "ICON_X")
CTA_PHRASES = ("sign in to check out", "buy it now", "buy now", "add to cart", "view in cart", "checkout")
CTA_PAIR = ("sign", "check out")
COMPACT_WORDS = ("best match", "filter", "sort", "condition", "screen size", "maximum", "quantity")
PRODUCT_WORDS = ("product", "item", "result", "cart", "macbook", "ebay", "amazon", "walmart", "bestbuy", "costco")
# A least length in pixels and the times of a side that may exceed it, as (least, times).
ROW, TARGET_ROW = (20, 1.5), (20, 1.6)
SEARCH_GAP, SEARCH_HEIGHT, SEARCH_PAD = (70, 2.5), (28, 2.0), (8, 0.35)
SIDE_GAP, CARD_COLUMN, CARD_GAP = (48, 2.2), (150, 0.85), (110, 2.4)
CTA_HEIGHT, COMPACT_PAD, OWN_PAD = (52, 2.7), ((24, 0.35), (18, 0.95)), ((6, 0.12), (4, 0.12))
# Paddings and least sides in pixels, parts of a screen's width, elements of a card.
UNION_PAD, SEARCH_MORE, LEAST_SIDE, CTA_SIDES, LEAST_CARD = 10.0, 8, 2, (0.04, 0.96), 2
# Kinds, in the order in which they are tried.
SEARCH, CTA, COMPACT, CARD, PADDED = "search_or_suggestion_row", "full_width_cta_button", "compact_control_button", "product_card_region", "padded_raw_bbox"


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def on_products(task: Column) -> Column:
    """Whether a task names products; its text, which may be long, is lowered once for all words."""
    return bound(F.lower(F.coalesce(task, F.lit(""))), lambda t: _any_in(t, PRODUCT_WORDS))


def _w(b: Column) -> Column:
    return b["x2"] - b["x1"]


def _h(b: Column) -> Column:
    return b["y2"] - b["y1"]


def _mid(b: Column, axis: str) -> Column:
    return (b[f"{axis}1"] + b[f"{axis}2"]) / 2


def _gap(a: Column, b: Column, axis: str) -> Column:
    return F.greatest(F.lit(0.0), a[f"{axis}1"] - b[f"{axis}2"], b[f"{axis}1"] - a[f"{axis}2"])


def _most(limit: tuple[float, float], side: Column) -> Column:
    return F.greatest(F.lit(float(limit[0])), side * limit[1])


def same_row(boxes: Column, target: Column, limit: tuple[float, float] = ROW) -> Column:
    """Valid boxes whose middle is near the target's, or that overlap it vertically; the target too."""
    near = _most(limit, _h(target))
    return F.filter(boxes, lambda b: b["valid"] & ((F.abs(_mid(b, "y") - _mid(target, "y")) <= near) | ((b["y2"] >= target["y1"]) & (b["y1"] <= target["y2"]))))


def row_text(row: Column) -> Column:
    """The row's texts from left to right."""
    ordered = F.sort_array(F.transform(row, lambda b: F.struct(b["x1"], b["pos"], b["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda b: b["text"]), " ")


def search_like(b: Column) -> Column:
    return F.contains(b["text"], F.lit(SEARCH_WORD)) | (F.upper(F.coalesce(b["ui_type"], F.lit(""))) == SEARCH_ICON)


def search_boxes(row: Column, target: Column) -> Column:
    """The row's boxes that belong to a search field, the target if there is none; those far above or below go."""
    related = F.filter(row, lambda b: (F.contains(b["text"], F.lit(SEARCH_WORD)) | F.upper(F.coalesce(b["ui_type"], F.lit(""))).isin(*SEARCH_ICONS)) & (_gap(b, target, "x") <= _most(SEARCH_GAP, _w(target))))
    related = F.when(F.size(related) > 0, related).otherwise(F.array(target))
    return F.filter(related, lambda b: F.abs(_mid(b, "y") - _mid(target, "y")) <= _most(SEARCH_HEIGHT, _h(target)))


def full_width_cta(text: Column) -> Column:
    return _any_in(text, CTA_PHRASES) | (F.contains(text, F.lit(CTA_PAIR[0])) & F.contains(text, F.lit(CTA_PAIR[1])))


def side_by_side(row: Column, target: Column) -> Column:
    related = F.filter(row, lambda b: _gap(b, target, "x") <= _most(SIDE_GAP, _w(target)))
    return F.when(F.size(related) > 0, related).otherwise(F.array(target))


def card_boxes(boxes: Column, target: Column) -> Column:
    return F.filter(boxes, lambda b: b["valid"] & (F.abs(_mid(b, "x") - _mid(target, "x")) <= _most(CARD_COLUMN, _w(target))) & (_gap(b, target, "y") <= _most(CARD_GAP, _h(target))))


def region(kind: str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    sides = (v.cast("double").alias(k) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)))
    return F.struct(F.lit(kind).alias("kind"), *sides)


def _padded(kind: str, sides: dict[str, Column], screen: Column, dx: Column, dy: Column) -> Column:
    zero = F.lit(0.0)
    return region(
        kind,
        clamp(sides["x1"] - dx, zero, screen["width"]),
        clamp(sides["y1"] - dy, zero, screen["height"]),
        clamp(sides["x2"] + dx, zero, screen["width"]),
        clamp(sides["y2"] + dy, zero, screen["height"]),
    )


def _union(boxes: Column) -> dict[str, Column]:
    least, most = (lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))), (lambda k: F.array_max(F.transform(boxes, lambda b: b[k])))
    return {"x1": least("x1"), "y1": least("y1"), "x2": most("x2"), "y2": most("y2")}


def with_pixel_boxes(steps: DataFrame) -> DataFrame:
    return once(steps, boxes=pixel_boxes(F.col("ui_elements"), F.col("screen_size")))


def with_region(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the region of the smallest element at a pixel point: ``name`` (kind, x1, y1, x2, y2) and ``name``_element.

    ``df`` needs ``boxes`` (of ``with_pixel_boxes``), ``screen_size`` and
    ``task``, or what ``on_products`` says of it as ``product_task``.  Both are
    null where no valid element holds the point.  The parts are columns of their
    own, so that each is computed once.
    """
    product = F.col("product_task") if "product_task" in df.columns else on_products(F.col("task"))
    t, row, screen = F.col("_target"), F.col("_row"), F.col("screen_size")
    df = once(df, _target=F.when(p.isNotNull(), smallest_at(F.col("boxes"), p)))
    df = once(df, _row=F.when(t.isNotNull(), same_row(F.col("boxes"), t, TARGET_ROW)))
    found = F.filter(search_boxes(row, t), lambda b: (_w(b) > LEAST_SIDE) & (_h(b) > LEAST_SIDE))
    df = once(df, _found=F.when(search_like(t), found), _row_text=row_text(row))
    df = once(
        df,
        _search=F.when(search_like(t), F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(t))),
        _side=F.when(_any_in(t["text"], COMPACT_WORDS), side_by_side(row, t)),
        _card=F.when(t.isNotNull() & product, card_boxes(F.col("boxes"), t)),
        _cta=full_width_cta(F.col("_row_text")),
    )
    search = _padded(SEARCH, _union(F.col("_search")), screen, F.lit(UNION_PAD), _most(SEARCH_PAD, _h(t)))
    search = region(SEARCH, F.greatest(F.lit(0.0), search["x1"] - SEARCH_MORE), search["y1"], F.least(screen["width"], search["x2"] + SEARCH_MORE), search["y2"])
    half = _most(CTA_HEIGHT, _h(t)) / 2
    cta = region(CTA, screen["width"] * CTA_SIDES[0], clamp(_mid(t, "y") - half, F.lit(0.0), screen["height"]), screen["width"] * CTA_SIDES[1], clamp(_mid(t, "y") + half, F.lit(0.0), screen["height"]))
    compact = _padded(COMPACT, _union(F.col("_side")), screen, _most(COMPACT_PAD[0], _w(t)), _most(COMPACT_PAD[1], _h(t)))
    card = _padded(CARD, _union(F.col("_card")), screen, F.lit(UNION_PAD), F.lit(UNION_PAD))
    own = _padded(PADDED, {k: t[k] for k in ("x1", "y1", "x2", "y2")}, screen, _most(OWN_PAD[0], _w(t)), _most(OWN_PAD[1], _h(t)))
    cascade = F.when(t.isNull(), F.lit(None)).when(F.col("_search").isNotNull(), search).when(F.col("_cta"), cta).when(F.col("_side").isNotNull(), compact).when(F.size("_card") >= LEAST_CARD, card).otherwise(own)
    df = once(df, **{name: cascade, f"{name}_element": t})
    return df.drop("_target", "_row", "_found", "_row_text", "_search", "_side", "_card", "_cta")


def in_region(name: str, p: Column) -> Column:
    return F.coalesce(contains(F.col(name), p), F.lit(False))


def distinct_boxes(df: DataFrame, boxes: str = "boxes", label: str = "ui_type", grid: int = 6) -> DataFrame:
    """``df`` with ``boxes`` less those without a side, and of those that agree on a grid and in their label all but the first; within the row: no shuffle."""
    cell = lambda b: F.struct(*[(F.bround(b[c] / grid) * grid).alias(c) for c in ("x1", "y1", "x2", "y2")], b[label].alias("label"))
    valid = F.filter(boxes, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    df = once(df, _cells=F.sort_array(F.transform(valid, lambda b: F.struct(cell(b).alias("cell"), b["pos"].alias("pos"), b.alias("box")))))
    first = F.filter("_cells", lambda c, i: (i == 0) | ~c["cell"].eqNullSafe(F.get("_cells", i - 1)["cell"]))
    return df.withColumn(boxes, F.sort_array(F.transform(first, lambda c: c["box"]))).drop("_cells")
