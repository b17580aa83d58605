"""Raw episodes (VARIANT) to step rows: alias-tolerant, row-local, one flat map."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import SPACES, bound, box, distance, point, settled
from stepwise.functions.maps import METADATA, entries

# Aliases, in order of precedence.
TYPE_ALIASES = {
    "tap": "click", "click": "click", "touch": "click",
    "input_text": "type", "type_text": "type", "type": "type", "text": "type",
    "scroll": "scroll", "swipe": "swipe",
    "press_back": "back", "back": "back", "press_home": "home", "home": "home",
    "wait": "wait", "done": "finish", "finish": "finish", "task_complete": "finish",
    "task_impossible": "impossible", "impossible": "impossible",
}
SCREEN_STRUCTS = ("screen_size", "image_size", "resolution", "size")
SCREEN_WIDTHS, SCREEN_HEIGHTS = ("width", "w", "screen_width", "image_width"), ("height", "h", "screen_height", "image_height")
FLAT_WIDTHS, FLAT_HEIGHTS = ("screen_width", "image_width", "width", "w"), ("screen_height", "image_height", "height", "h")
POINT_X, POINT_Y = ("x", "X", "left"), ("y", "Y", "top")
ACTION_TYPE_KEYS = ("type", "action_type", "action", "name")
ACTION_POINT, ACTION_X, ACTION_Y = ("point", "position", "coordinate", "coords"), ("x", "touch_x", "tap_x"), ("y", "touch_y", "tap_y")
ACTION_START, ACTION_END = ("start_point", "start", "from"), ("end_point", "end", "to")
ACTION_TEXT, ACTION_DIRECTION = ("text", "typed_text", "input_text", "value"), ("direction", "scroll_direction", "swipe_direction")
ACTION_SPACE = ("coordinate_space", "coord_space")
STEP_LISTS = ("steps", "actions", "trajectory", "events")
BEFORE, AFTER = ("screenshot_before", "image", "image_path", "screenshot", "before", "image_encoded"), ("screenshot_after", "next_image", "next_image_path", "after")
CODED_EPISODE, CODED_TASK = ("episode_id", "ep_id", "id"), ("task", "instruction", "goal", "goal_info", "query")
LEVEL_EPISODE = ("episode_id", "id")
LEVEL_TASK, LEVEL_STEP_TASK = ("high_level_instruction", "task", "instruction", "goal"), ("low_level_instruction", "task", "instruction")
ACTION_PAYLOAD, TARGET_BOX = ("action", "target_action", "operation"), ("target_bbox", "bbox", "box")
TYPED = ("results_type_action", "type_action")
# Fixed value: the form of an action written as a call.
CALL = r"^([a-zA-Z_ ]+)\s*\((?s:(.*))\)"
# Action codes, and the least distance of a swipe (normalised).
CODES = {3: "type", 5: "back", 6: "home", 7: "wait", 10: "finish", 11: "impossible"}
ENTER, ENTER_MEANING = 7, "press_enter"
DUAL_POINT, TAP_DISTANCE = 4, 0.04

POINT = "struct<x:double,y:double>"
ACTION = f"struct<type:string,point:{POINT},start_point:{POINT},end_point:{POINT},text:string,direction:string,coordinate_space:string,metadata:{METADATA}>"
#: Fields of a coded step that its metadata keep.
STEP_FACTS = ("current_activity", "device_type", "episode_length")


def present(v: Column, keys: Sequence[str]) -> Column:
    """The first value (VARIANT) among aliases that is neither absent nor JSON null; 0, "" and [] are values."""
    found = [F.try_variant_get(v, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])


def of_type(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, prefix: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(prefix), F.lit(False))


def action_type(name: Column) -> Column:
    """An action name's type; an unknown one is ``wait``."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    clean = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(known, clean), F.lit("wait"))


def as_point(v: Column) -> Column:
    """A point from an object or from a list of two or more."""
    x, y = of_type(present(v, POINT_X), "double"), of_type(present(v, POINT_Y), "double")
    a, b = F.try_variant_get(v, "$[0]", "double"), F.try_variant_get(v, "$[1]", "double")
    return F.when(x.isNotNull() & y.isNotNull(), point(x, y)).when(a.isNotNull() & b.isNotNull(), point(a, b))


def swapped_point(v: Column) -> Column:
    """A point from a list (y, x)."""
    return F.when(F.try_variant_get(v, "$[1]", "double").isNotNull(), point(F.try_variant_get(v, "$[1]", "double"), F.try_variant_get(v, "$[0]", "double")))


def screen_size(v: Column) -> Column:
    """The first complete size: a struct or a list of two under an alias, then flat keys, then the encoded image's."""

    def size(w: Column, h: Column) -> Column:
        return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))

    pairs = []
    for key in SCREEN_STRUCTS:
        inner = F.try_variant_get(v, f"$.{key}", "variant")
        pairs.append(size(of_type(present(inner, SCREEN_WIDTHS), "double"), of_type(present(inner, SCREEN_HEIGHTS), "double")))
        pairs.append(size(F.try_variant_get(inner, "$[0]", "double"), F.try_variant_get(inner, "$[1]", "double")))
    pairs.append(size(of_type(present(v, FLAT_WIDTHS), "double"), of_type(present(v, FLAT_HEIGHTS), "double")))
    pairs.append(size(F.try_variant_get(v, "$.image_encoded.size[0]", "double"), F.try_variant_get(v, "$.image_encoded.size[1]", "double")))
    return F.coalesce(*pairs)


def action(
    kind: Column,
    at: Column | None = None,
    start: Column | None = None,
    end: Column | None = None,
    text: Column | None = None,
    direction: Column | None = None,
    space: Column | str = "pixel",
    metadata: Column | None = None,
) -> Column:
    none, word = F.lit(None).cast(POINT), F.lit(None).cast("string")
    return F.struct(
        kind.alias("type"),
        (none if at is None else at).alias("point"),
        (none if start is None else start).alias("start_point"),
        (none if end is None else end).alias("end_point"),
        (word if text is None else text).alias("text"),
        (word if direction is None else direction).alias("direction"),
        (F.lit(space) if isinstance(space, str) else space).alias("coordinate_space"),
        (entries() if metadata is None else metadata).alias("metadata"),
    )


def string_action(text: Column) -> Column:
    """``name(arguments)`` or a bare name."""
    trimmed = F.trim(text)
    call = trimmed.rlike(CALL)
    kind = action_type(F.when(call, F.regexp_extract(trimmed, CALL, 1)).otherwise(trimmed))
    parts = F.filter(F.split(F.regexp_extract(trimmed, CALL, 2), ","), lambda a: F.length(F.trim(a)) > 0)
    args = F.transform(parts, lambda a: F.regexp_replace(F.trim(a), r"^['\"]+|['\"]+$", ""))
    at = F.when(call & (kind == "click") & (F.size(args) >= 2), point(F.get(args, F.lit(0)), F.get(args, F.lit(1))))
    typed = F.when(call & (kind == "type"), F.array_join(args, ", "))
    direction = F.when(call & kind.isin("scroll", "swipe"), F.get(args, F.lit(0)))
    return action(kind, at, text=typed, direction=direction, metadata=entries(raw_action=text))


def object_action(v: Column) -> Column:
    x, y = of_type(present(v, ACTION_X), "double"), of_type(present(v, ACTION_Y), "double")
    at = F.coalesce(as_point(present(v, ACTION_POINT)), F.when(x.isNotNull() & y.isNotNull(), point(x, y)))
    word = lambda keys: of_type(present(v, keys), "string")
    return action(
        action_type(word(ACTION_TYPE_KEYS)),
        at,
        as_point(present(v, ACTION_START)),
        as_point(present(v, ACTION_END)),
        word(ACTION_TEXT),
        word(ACTION_DIRECTION),
        F.coalesce(word(ACTION_SPACE), F.lit("pixel")),
        entries(raw_action=F.to_json(v)),
    )


def any_action(v: Column) -> Column:
    """A text, an object, or anything else (``wait``); the metadata hold what was given (objects as JSON)."""
    text = F.when(_is(v, "STRING"), string_action(of_type(v, "string")))
    return text.when(_is(v, "OBJECT"), object_action(v)).otherwise(action(F.lit("wait"), metadata=entries(raw_action=F.to_json(v))))


def is_tap(touch: Column, lift: Column) -> Column:
    return distance(touch, lift) <= TAP_DISTANCE


def coded_action(code: Column, touch: Column, lift: Column, typed: Column) -> Column:
    """An action of a numeric code; null without one.  The metadata hold the code and, of the enter key, its meaning."""
    given = entries(action_code=code)
    tapped = lift.isNull() | is_tap(touch, lift)
    start = F.when(touch.isNull() | tapped, None).otherwise(touch)
    kind = F.when(code == DUAL_POINT, F.when(touch.isNull(), "wait").when(tapped, "click").otherwise("swipe"))
    for number, name in CODES.items():
        kind = kind.when(code == number, name)
    pointed = code == DUAL_POINT
    made = action(
        kind.otherwise("wait"),
        F.when(pointed & tapped, touch),
        F.when(pointed, start),
        F.when(pointed & start.isNotNull(), lift),
        F.when(code == 3, typed),
        None,
        F.when(pointed & touch.isNotNull(), "normalized_1").otherwise("pixel"),
        F.when(code == ENTER, entries(action_code=code, semantic=ENTER_MEANING)).otherwise(given),
    )
    return F.when(code.isNotNull(), made)


def coded_step_action(v: Column) -> Column:
    typed = present(v, TYPED)
    first = F.when(_is(typed, "ARRAY"), F.coalesce(F.try_variant_get(typed, "$[0]", "string"), F.lit(""))).otherwise(F.coalesce(of_type(typed, "string"), F.lit("")))
    return coded_action(F.try_variant_get(v, "$.results_action_type", "int"), swapped_point(present(v, ["results_yx_touch"])), swapped_point(present(v, ["results_yx_lift"])), first)


def as_box(v: Column) -> Column:
    """A box from x1..y2, from left, top, right, bottom, or from a list of four or more (always pixels)."""
    get = lambda k: F.try_variant_get(v, k, "double")
    space = F.coalesce(F.try_variant_get(v, "$.coordinate_space", "string"), F.lit("pixel"))
    out = None
    for keys, named in ((("$.x1", "$.y1", "$.x2", "$.y2"), space), (("$.left", "$.top", "$.right", "$.bottom"), space), (("$[0]", "$[1]", "$[2]", "$[3]"), F.lit("pixel"))):
        sides = [get(k) for k in keys]
        whole = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
        out = F.when(whole, box(*sides, named)) if out is None else out.when(whole, box(*sides, named))
    return out


ELEMENTS = "array<struct<bbox:struct<x1:double,y1:double,x2:double,y2:double,coordinate_space:string>,text:string,ui_type:string,index:int>>"


def flat_elements(positions: Column, texts: Column, types: Column) -> Column:
    """UI elements from parallel arrays; positions are middle y, middle x, height, width, four an element."""
    n = F.least(F.floor(F.size(positions) / 4), F.size(texts), F.size(types)).cast("int")
    at = lambda i, k: F.get(positions, (i * 4 + k).cast("int"))

    def one(i: Column) -> Column:
        y, x, h, w = (at(i, k) for k in range(4))
        b = box(F.greatest(F.lit(0.0), x - w / 2), F.greatest(F.lit(0.0), y - h / 2), F.least(F.lit(1.0), x + w / 2), F.least(F.lit(1.0), y + h / 2), "normalized_1")
        return F.struct(b.alias("bbox"), F.coalesce(F.get(texts, i), F.lit("")).alias("text"), F.coalesce(F.get(types, i), F.lit("")).alias("ui_type"), i.alias("index"))

    some = F.coalesce((n > 0) & (F.size(positions) >= 4), F.lit(False))
    return F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast(ELEMENTS)).cast(ELEMENTS)


def step_list(v: Column) -> Column:
    """An episode's steps: the first alias that is there counts; if that is no list or empty, a record with a code is itself the step."""
    listed = F.try_variant_get(present(v, STEP_LISTS), "$", "array<variant>")
    coded = F.try_variant_get(v, "$.results_action_type", "variant").isNotNull()
    return F.when(F.size(listed) > 0, listed).when(coded, F.array(v))


def before_image(v: Column) -> Column:
    found = present(v, BEFORE)
    return F.when(_is(found, "OBJECT"), F.try_variant_get(found, "$.path", "string")).when(_is(found, "STRING"), of_type(found, "string"))


def _steps(raw: DataFrame) -> DataFrame:
    """(v, pos, s): each step of each record."""
    return settled(raw).select(F.col("raw").alias("v"), step_list(F.col("raw")).alias("_s")).select("v", F.posexplode("_s").alias("pos", "s"))


def _word(v: Column, keys: Sequence[str]) -> Column:
    return of_type(present(v, keys), "string")


def _common(df: DataFrame, episode: Column, task: Column, screen: Column, act: Column, elements: Column, metadata: Column) -> DataFrame:
    number = F.try_variant_get("s", "$.step_id", "variant")
    bad = F.raise_error("step_id must be a number").cast("int")
    step = F.when(number.isNull(), F.col("pos")).otherwise(F.coalesce(of_type(number, "int"), bad))
    return df.select(
        episode.alias("episode_id"),
        step.cast("int").alias("step_id"),
        F.coalesce(task, F.lit("")).alias("task"),
        before_image(F.col("s")).alias("screenshot_before"),
        _word(F.col("s"), AFTER).alias("screenshot_after"),
        screen.alias("screen_size"),
        act.alias("action"),
        as_box(present(F.col("s"), TARGET_BOX)).alias("target_bbox"),
        elements.alias("ui_elements"),
        F.array().cast(f"array<{ACTION}>").alias("history"),
        metadata.alias("metadata"),
    )


def coded_episodes(raw: DataFrame) -> DataFrame:
    """Steps of records whose actions may be coded: a step's task and screen come before its episode's.

    ``metadata`` hold the source and the step's STEP_FACTS; ``history`` is empty, as records have none.
    """
    v, s = F.col("v"), F.col("s")
    array = lambda key, kind: F.try_variant_get(s, f"$.{key}", f"array<{kind}>")
    lists = F.struct(array("image_ui_annotations_positions", "double").alias("at"), array("image_ui_annotations_text", "string").alias("texts"), array("image_ui_annotations_ui_types", "string").alias("types"))
    # The lists are read once a step, not once for each of an element's numbers.
    elements = bound(lists, lambda x: flat_elements(x["at"], x["texts"], x["types"]))
    act = F.coalesce(coded_step_action(s), any_action(present(s, ACTION_PAYLOAD)))
    facts = entries(source="coded", **{k: F.try_variant_get(s, f"$.{k}", "string") for k in STEP_FACTS})
    episode = F.coalesce(_word(v, CODED_EPISODE), F.lit("unknown"))
    task = F.coalesce(_word(s, CODED_TASK[:4]), _word(v, CODED_TASK))
    return _common(_steps(raw), episode, task, F.coalesce(screen_size(s), screen_size(v)), act, elements, facts)


def two_level_episodes(raw: DataFrame) -> DataFrame:
    """Steps of records with an instruction for each step besides the episode's; the screen is the episode's, and there are no elements."""
    v, s = F.col("v"), F.col("s")
    given = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in LEVEL_EPISODE])
    episode = F.when(given.isNull(), F.lit("unknown")).when(F.is_variant_null(given), F.lit("None")).otherwise(of_type(given, "string"))
    whole = F.coalesce(_word(v, LEVEL_TASK), F.lit(""))
    act = any_action(present(s, ACTION_PAYLOAD))
    facts = entries(source="two_level", high_level_instruction=whole)
    return _common(_steps(raw), episode, F.coalesce(_word(s, LEVEL_STEP_TASK), whole), screen_size(v), act, F.array().cast(ELEMENTS), facts)


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"coded": coded_episodes, "two_level": two_level_episodes}


def parser(source: str) -> Callable[[DataFrame], DataFrame]:
    if source not in PARSERS:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[source]


def action_checks(action: Column, name: str = "action") -> dict[str, Column]:
    """What holds for an action: a known type and space."""
    return {f"{name} type": action["type"].isin(sorted(set(TYPE_ALIASES.values()))), f"{name} space": action["coordinate_space"].isin(*SPACES)}


def step_checks() -> dict[str, Column]:
    """What holds for the columns that steps, and pairs made of them, share: ids, task, sides of a screen, spaces of boxes."""
    known = lambda b: b["coordinate_space"].isin(*SPACES)
    return {
        "episode_id": F.col("episode_id").isNotNull(),
        "step_id": F.col("step_id") >= 0,
        "task": F.col("task").isNotNull(),
        "screen_size": F.col("screen_size").isNull() | ((F.col("screen_size.width") > 0) & (F.col("screen_size.height") > 0)),
        "target_bbox space": F.col("target_bbox").isNull() | known(F.col("target_bbox")),
        "ui_elements": F.col("ui_elements").isNull() | F.forall("ui_elements", lambda e: F.coalesce(known(e["bbox"]), F.lit(False))),
    }


def pair_checks() -> dict[str, Column]:
    """What holds for a written pair."""
    own = {k: F.col(k).isNotNull() for k in ("pair_id", "negative_type")}
    return {**own, **step_checks(), **action_checks(F.col("chosen"), "chosen"), **action_checks(F.col("rejected"), "rejected")}


def validated(steps: DataFrame) -> DataFrame:
    """``steps``, raising at a row that is out of its domain."""
    ok = F.lit(True)
    for check in {**step_checks(), **action_checks(F.col("action"))}.values():
        ok = ok & F.coalesce(check, F.lit(False))
    return steps.where(F.assert_true(ok, "a step is out of its domain").isNull())
