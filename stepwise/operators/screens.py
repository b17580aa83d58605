"""Regions of a whole screen: one for each of its boxes, and a second way to find a target's.

All is done within a row, on the array of a screen's boxes: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import bound, clamp, once, pixel_sides, smallest_at
from stepwise.operators.regions import COMPACT, COMPACT_WORDS, CTA, CTA_PAIR, CTA_PHRASES, PADDED, PRODUCT_WORDS, SEARCH, SEARCH_ICON, SEARCH_ICONS, SEARCH_WORD, distinct_boxes, on_products, region

# Kinds that only these ways know, and their words.
BUTTON, CARD, PADDED_TARGET = "button_like", "possible_card_region", "padded_bbox"
SCREEN_CTA_PHRASES = (*CTA_PHRASES, "watch")
SCREEN_BUTTON_WORDS = ("add to cart", "buy it", "buy now", "checkout", "continue", "accept", "verify", "submit", "next", "done", "sign in", "yes", "no thanks", "save")
TARGET_BUTTON_WORDS = ("add to cart", "buy", "continue", "accept", "verify", "submit", "next", "done", "sign in", "yes", "no thanks", "save")
TEXT_TYPE, TEXT_LENGTH = "TEXT", 18
# A least length in pixels and the times of a side that may exceed it, as (least, times).
ROW, SCREEN_ROW_PAD, SCREEN_ROW_GAP, SCREEN_ROW_HEIGHT = (20, 1.5), (8, 0.35), (70, 2.5), (28, 2.0)
CTA_HEIGHT, COMPACT_GAP, COMPACT_PAD = (52, 2.7), (48, 2.2), ((24, 0.35), (18, 0.95))
BUTTON_PAD, CARD_GAP, PAD = ((24, 0.55), (10, 0.65)), (120, 3.0), ((6, 0.12), (4, 0.12))
TARGET_TYPE_ROW, TARGET_ROW, TARGET_ROW_PAD, TARGET_PAD = (20, 1.4), (24, 1.6), (8, 0.4), ((12, 0.35), (8, 0.35))
# Parts of a screen's sides, heights and paddings in pixels.
CTA_SIDES, CARD_OVERLAP, CARD_HEIGHT, TOP_OF_SCREEN, TARGET_ROW_WIDTH = (0.04, 0.96), -0.20, 60, 0.35, 0.75
SCREEN_PAD, SCREEN_ROW_MORE, TARGET_UNION_PAD, LEAST_SIDE, TARGET_ALONE = 10.0, 8.0, 12.0, 2, (3.0, 0.7)


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _w(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def _h(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def _cy(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def _gap(a: Column, b: Column, axis: str) -> Column:
    return F.greatest(F.lit(0.0), a[f"{axis}1"] - b[f"{axis}2"], b[f"{axis}1"] - a[f"{axis}2"])


def _most(limit: tuple[float, float], side: Column) -> Column:
    return F.greatest(F.lit(float(limit[0])), side * limit[1])


def _row(boxes: Column, b: Column, limit: tuple[float, float]) -> Column:
    """Boxes whose middle is near the box's, or that overlap it vertically; the box too."""
    return F.filter(boxes, lambda o: (F.abs(_cy(o) - _cy(b)) <= _most(limit, _h(b))) | ((o["y2"] >= b["y1"]) & (o["y1"] <= b["y2"])))


def _near(boxes: Column, b: Column, width: Column) -> Column:
    """Boxes of about the same column that stand not far above or below; the box too."""
    shared = lambda o: F.least(o["x2"], b["x2"]) - F.greatest(o["x1"], b["x1"])
    return F.filter(boxes, lambda o: (_gap(o, b, "y") <= _most(CARD_GAP, _h(b))) & (shared(o) > width * CARD_OVERLAP))


def _expanded(kind: str, sides: dict[str, Column], screen: Column, dx: Column, dy: Column) -> Column:
    zero = F.lit(0.0)
    low, high = (lambda v, d, s: clamp(v - d, zero, s)), (lambda v, d, s: clamp(v + d, zero, s))
    return region(kind, low(sides["x1"], dx, screen["width"]), low(sides["y1"], dy, screen["height"]), high(sides["x2"], dx, screen["width"]), high(sides["y2"], dy, screen["height"]))


def _own(b: Column) -> dict[str, Column]:
    return {k: b[k] for k in ("x1", "y1", "x2", "y2")}


def _union(boxes: Column) -> dict[str, Column]:
    least, most = (lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))), (lambda k: F.array_max(F.transform(boxes, lambda b: b[k])))
    return {"x1": least("x1"), "y1": least("y1"), "x2": most("x2"), "y2": most("y2")}


def screen_boxes(elements: Column, screen: Column) -> Column:
    """A screen's elements as boxes cut to it, those with a width and height: pos, sides, label ``index:type[:text]``, and the lower text (the label without one)."""

    def one(e: Column, i: Column) -> Column:
        b = pixel_sides(e["bbox"], screen)
        zero, text = F.lit(0.0), F.substring(F.trim(F.coalesce(e["text"], F.lit(""))), 1, TEXT_LENGTH)
        label = F.concat(i.cast("string"), F.lit(":"), F.trim(F.coalesce(e["ui_type"], F.lit(""))), F.when(text != "", F.concat(F.lit(":"), text)).otherwise(""))
        return F.struct(
            i.alias("pos"), clamp(b["x1"], zero, screen["width"]).alias("x1"), clamp(b["y1"], zero, screen["height"]).alias("y1"),
            clamp(b["x2"], zero, screen["width"]).alias("x2"), clamp(b["y2"], zero, screen["height"]).alias("y2"),
            label.alias("label"), F.lower(F.when(text != "", text).otherwise(label)).alias("text"),
        )

    return F.when(screen.isNotNull(), F.filter(F.transform(elements, one), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])))


def _screen_region(boxes: Column, b: Column, screen: Column, product: Column) -> Column:
    icons = lambda o, names: _any_in(F.upper(o["label"]), names)

    def of(row: Column) -> Column:
        searchish = lambda o: F.contains(o["text"], F.lit(SEARCH_WORD)) | icons(o, SEARCH_ICONS)
        related = F.filter(row, lambda o: searchish(o) & (_gap(o, b, "x") <= _most(SCREEN_ROW_GAP, _w(b))) & (F.abs(_cy(o) - _cy(b)) <= _most(SCREEN_ROW_HEIGHT, _h(b))))

        def search(found: Column) -> Column:
            some = F.when(F.size(found) > 0, found).otherwise(F.array(b))
            wide = _expanded(SEARCH, _union(some), screen, F.lit(SCREEN_PAD), _most(SCREEN_ROW_PAD, _h(b)))
            return bound(wide, lambda r: region(SEARCH, F.greatest(F.lit(0.0), r["x1"] - SCREEN_ROW_MORE), r["y1"], F.least(screen["width"], r["x2"] + SCREEN_ROW_MORE), r["y2"]))

        texts = F.sort_array(F.transform(row, lambda o: F.struct(o["x1"], o["pos"], o["text"].alias("text"))))
        said = F.array_join(F.transform(texts, lambda o: o["text"]), " ")
        cta = bound(said, lambda t: _any_in(t, SCREEN_CTA_PHRASES) | (F.contains(t, F.lit(CTA_PAIR[0])) & F.contains(t, F.lit(CTA_PAIR[1]))))
        half, zero = _most(CTA_HEIGHT, _h(b)) / 2, F.lit(0.0)
        button = region(CTA, screen["width"] * CTA_SIDES[0], clamp(_cy(b) - half, zero, screen["height"]), screen["width"] * CTA_SIDES[1], clamp(_cy(b) + half, zero, screen["height"]))
        side = F.filter(row, lambda o: _gap(o, b, "x") <= _most(COMPACT_GAP, _w(b)))
        pad = lambda limits: (_most(limits[0], _w(b)), _most(limits[1], _h(b)))
        card = product & (F.contains(b["label"], F.lit(TEXT_TYPE)) | (_h(b) > CARD_HEIGHT))
        return (
            F.when(F.contains(b["text"], F.lit(SEARCH_WORD)) | icons(b, (SEARCH_ICON,)), bound(related, search))
            .when(cta, button)
            .when(_any_in(b["text"], COMPACT_WORDS), bound(side, lambda s: _expanded(COMPACT, _union(s), screen, *pad(COMPACT_PAD))))
            .when(_any_in(b["text"], SCREEN_BUTTON_WORDS), _expanded(BUTTON, _own(b), screen, *pad(BUTTON_PAD)))
            .when(card, bound(_near(boxes, b, screen["width"]), lambda s: _expanded(CARD, _union(s), screen, F.lit(SCREEN_PAD), F.lit(SCREEN_PAD))))
            .otherwise(_expanded(PADDED, _own(b), screen, *pad(PAD)))
        )

    # A field that is set on the result would repeat the whole expression for each of its fields.
    return bound(bound(_row(boxes, b, ROW), of), lambda r: F.struct(*[r[k].alias(k) for k in ("kind", "x1", "y1", "x2", "y2")], b["pos"].alias("pos")))


def with_screen_regions(steps: DataFrame, merge_cards: bool = True, name: str = "screen_regions") -> DataFrame:
    """``steps`` (ui_elements, screen_size, task) and ``name``: a region for each box (kind, sides, pos), less those that agree on a grid and in kind.

    The first kind whose words or icons are met counts; ``merge_cards``: on a
    task about products, texts and tall boxes become cards with their
    neighbours.  Null without a screen.
    """
    screen = F.col("screen_size")
    product = on_products(F.col("task")) if merge_cards else F.lit(False)
    df = once(steps, _raw=screen_boxes(F.col("ui_elements"), screen), _product=product)
    df = once(df, **{name: F.transform("_raw", lambda b: _screen_region(F.col("_raw"), b, screen, F.col("_product")))})
    return distinct_boxes(df, name, "kind").drop("_raw", "_product")


def with_target_area(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the area around the smallest element at a pixel point that a tap may have meant: ``name`` (kind, x1, y1, x2, y2).

    ``df`` needs ``boxes`` (of ``regions.with_pixel_boxes``), ``screen_size`` and
    ``task``.  A row with a search field reaches from the left edge over three
    quarters of the screen at least.  Null where no valid element holds the point.
    """
    screen, t, task = F.col("screen_size"), F.col("_t"), F.lower(F.coalesce("task", F.lit("")))
    df = once(df, _t=F.when(p.isNotNull(), smallest_at(F.col("boxes"), p)), _valid=F.filter("boxes", lambda b: b["valid"]))
    icon = F.exists(_row(F.col("_valid"), t, TARGET_TYPE_ROW), lambda b: F.upper(F.coalesce(b["ui_type"], F.lit(""))) == SEARCH_ICON)
    at_top = F.contains(task, F.lit(SEARCH_WORD)) & (t["y1"] < screen["height"] * TOP_OF_SCREEN)
    kind = (
        F.when(F.contains(t["text"], F.lit(SEARCH_WORD)) | at_top | icon, SEARCH)
        .when(_any_in(t["text"], TARGET_BUTTON_WORDS), BUTTON)
        .when(_any_in(task, PRODUCT_WORDS) & ((F.upper(F.coalesce(t["ui_type"], F.lit(""))) == TEXT_TYPE) | (_h(t) > CARD_HEIGHT)), CARD)
        .otherwise(PADDED_TARGET)
    )
    df = once(df, _kind=F.when(t.isNotNull(), kind))
    row = F.filter(_row(F.col("_valid"), t, TARGET_ROW), lambda b: (_w(b) > LEAST_SIDE) & (_h(b) > LEAST_SIDE))
    df = once(df, _some=F.when(F.col("_kind") == SEARCH, row).when(F.col("_kind") == CARD, _near(F.col("_valid"), t, screen["width"])))
    some, pad = F.col("_some"), lambda limits: (_most(limits[0], _w(t)), _most(limits[1], _h(t)))
    wide = _expanded(SEARCH, _union(some), screen, F.lit(TARGET_UNION_PAD), _most(TARGET_ROW_PAD, _h(t)))
    zero = F.lit(0.0)
    reach = bound(wide, lambda r: region(SEARCH, clamp(F.least(r["x1"], zero), zero, screen["width"]), r["y1"], clamp(F.greatest(r["x2"], screen["width"] * TARGET_ROW_WIDTH), zero, screen["width"]), r["y2"]))
    area = (
        F.when(t.isNull(), F.lit(None))
        .when((F.col("_kind") == SEARCH) & (F.size(some) > 0), reach)
        .when(F.col("_kind") == SEARCH, _expanded(SEARCH, _own(t), screen, _w(t) * TARGET_ALONE[0], _h(t) * TARGET_ALONE[1]))
        .when(F.col("_kind") == BUTTON, _expanded(BUTTON, _own(t), screen, *pad(BUTTON_PAD)))
        .when((F.col("_kind") == CARD) & (F.size(some) > 0), _expanded(CARD, _union(some), screen, F.lit(TARGET_UNION_PAD), F.lit(TARGET_UNION_PAD)))
        .otherwise(_expanded(PADDED_TARGET, _own(t), screen, *pad(TARGET_PAD)).withField("kind", F.col("_kind")))
    )
    return once(df, **{name: area}).drop("_t", "_valid", "_kind", "_some")
