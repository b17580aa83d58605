"""All queries of the library by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions import geometry as G
from stepwise.functions import text as X
from stepwise.operators import audit, errors, metrics, negatives, pair_filter, profile, regions, rewards, scorer, screens, selection, transforms
from stepwise.plans.fixtures import ELEMENT_TEXTS, ELEMENT_TYPES, HEIGHT, SQL_PREDICTIONS, SQL_STEPS, WIDTH, predictions, read, spread, sql_list, steps
from stepwise.sources import episodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: str = SQL_STEPS) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` follows the common table expressions of ``base``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {base}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


def _r(c, n: int = 6):
    return F.round(c, n)


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.with_pixel_boxes(steps(spark, sf_dir))


def _p(name: str = "action"):
    return G.to_pixel(G.primary_point(F.col(name)), F.col("screen_size"), F.col(f"{name}.coordinate_space"))


# Audit.

_PASSED = """, a AS (
    SELECT *, coalesce(px >= 0 AND px < 1080 AND py >= 0 AND py < 2400, TRUE) AS inside,
           kind <> 'type' OR (length(trim(typed)) > 0 AND length(typed) <= 256) AS typed_ok, length(trim(task)) >= 3 AS task_ok FROM steps),
  q AS (SELECT *, (1.0::DOUBLE + inside::INT + typed_ok::INT + task_ok::INT) / 4 AS score FROM a),
  b AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM q)
"""


@query(_PASSED + "SELECT kind AS action_type, bucket AS quality_bucket, count(*) AS n, avg(score) AS mean_score FROM b GROUP BY ALL")
def audit_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audited(steps(spark, sf_dir))
    return rows.groupBy(F.col("action.type").alias("action_type"), F.col("audit.quality_bucket").alias("quality_bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("audit.quality_score").alias("mean_score"))


@query(_PASSED + "SELECT episode_id || ':' || step_id AS key, TRUE AS action_type, inside AS coordinate_in_screen, typed_ok AS text_input, task_ok AS instruction, score AS quality_score, bucket AS quality_bucket FROM b")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audited(steps(spark, sf_dir))
    found = {r: F.get("audit.findings", F.lit(i))["passed"] for i, r in enumerate(audit.rules())}
    return rows.select(F.col("audit.key").alias("key"), *[v.alias(k) for k, v in found.items()], F.col("audit.quality_score"), F.col("audit.quality_bucket"))


# Parsing.

_WORDS = ("click(%d, %d)", "TAP (%d,%d)", "type('a, b')", "scroll(down)", "press back", "dance", "Input Text(hello)", "swipe( 'left' )")


@query("""SELECT event_id, ['click', 'click', 'type', 'scroll', 'back', 'wait', 'type', 'swipe'][1 + event_id % 8] AS type,
    CASE WHEN event_id % 8 < 2 THEN CAST(event_id % 1080 AS DOUBLE) END AS x, CASE WHEN event_id % 8 < 2 THEN CAST(event_id % 2400 AS DOUBLE) END AS y,
    CASE event_id % 8 WHEN 2 THEN 'a, b' WHEN 6 THEN 'hello' END AS text, CASE event_id % 8 WHEN 3 THEN 'down' WHEN 7 THEN 'left' END AS direction FROM events""")
def parse_string_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    forms = F.array(*[F.format_string(w, e % 1080, e % 2400) if "%d" in w else F.lit(w) for w in _WORDS])
    rows = read(spark, sf_dir, "events").select("event_id", F.get(forms, (e % 8).cast("int")).alias("s"))
    a = rows.select("event_id", episodes.string_action(F.col("s")).alias("a"))
    return a.select("event_id", F.col("a.type"), F.col("a.point.x").alias("x"), F.col("a.point.y").alias("y"), F.col("a.text"), F.col("a.direction"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'click' ELSE 'wait' END AS type, count(*) AS n FROM events GROUP BY ALL")
def parse_alias_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", episodes.action_type(F.col("event_type")).alias("type"))
    return rows.groupBy("event_type", "type").agg(F.count(F.lit(1)).alias("n"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded single-step records, as JSON."""
    e = F.col("event_id")
    yx = lambda a, b: F.array((e * a) % 1000 / 1000.0, (e * b) % 1000 / 1000.0)
    touch = yx(7919, 104729)
    lift = F.when(e % 3 == 0, touch).otherwise(yx(6007, 9973))
    i = F.sequence(F.lit(0), F.lit(2))
    record = F.struct(
        F.concat(F.lit("e"), e.cast("string")).alias("ep_id"), F.concat(F.lit("goal "), (e % 9).cast("string")).alias("goal_info"), F.get(F.array(*map(F.lit, (3, 4, 5, 6, 7, 10, 11, 99))), (e % 8).cast("int")).alias("results_action_type"),
        F.when(e % 2 == 0, "phone").alias("device_type"), (e % 7).alias("episode_length"), F.when(e % 16 != 1, touch).alias("results_yx_touch"), lift.alias("results_yx_lift"), F.array(F.lit("hi"), F.lit("there")).alias("results_type_action"),
        F.struct(F.array(F.lit(1080), F.lit(2400)).alias("size"), F.concat(F.lit("shots/"), e.cast("string"), F.lit(".png")).alias("path")).alias("image_encoded"),
        F.flatten(F.transform(i, lambda k: F.array((e * 3 + k * 311) % 1000 / 1000.0, (e * 7 + k * 97) % 1000 / 1000.0, F.lit(0.1), F.lit(0.3)))).alias("image_ui_annotations_positions"),
        F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("c")).alias("image_ui_annotations_text"), F.array(F.lit("TEXT"), F.lit("ICON"), F.lit("TEXT")).alias("image_ui_annotations_ui_types"),
    )
    return spread(read(spark, sf_dir, "events").select("event_id"), "event_id").select(F.parse_json(F.to_json(record)).alias("raw"))


_RAW = """r AS (
    SELECT event_id AS e, event_id % 8 AS c, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS ty, ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS tx,
           CASE WHEN event_id % 3 = 0 THEN ((event_id * 7919) % 1000) / 1000.0::DOUBLE ELSE ((event_id * 6007) % 1000) / 1000.0::DOUBLE END AS ly,
           CASE WHEN event_id % 3 = 0 THEN ((event_id * 104729) % 1000) / 1000.0::DOUBLE ELSE ((event_id * 9973) % 1000) / 1000.0::DOUBLE END AS lx FROM events)"""


@query("""SELECT 'e' || e AS episode_id, 0 AS step_id, 'goal ' || e % 9 AS task, 'shots/' || e || '.png' AS screenshot_before, 1080 AS width, 2400 AS height, type, CASE WHEN type = 'type' THEN 'hi' END AS text, ['3', '4', '5', '6', '7', '10', '11', '99'][c + 1] AS action_code,
      CASE WHEN c = 4 THEN 'press_enter' END AS semantic, 'coded' AS source, CASE WHEN e % 2 = 0 THEN 'phone' END AS device_type, CAST(e % 7 AS VARCHAR) AS episode_length, CASE WHEN type IN ('click', 'swipe') THEN 'normalized_1' ELSE 'pixel' END AS space,
      CASE WHEN type = 'click' THEN tx END AS x, CASE WHEN type = 'click' THEN ty END AS y, CASE WHEN type = 'swipe' THEN tx END AS sx, CASE WHEN type = 'swipe' THEN ly END AS ey
    FROM (SELECT *, CASE c WHEN 0 THEN 'type' WHEN 1 THEN CASE WHEN e % 16 = 1 THEN 'wait' WHEN sqrt((tx - lx) * (tx - lx) + (ty - ly) * (ty - ly)) <= 0.04 THEN 'click' ELSE 'swipe' END
            WHEN 2 THEN 'back' WHEN 3 THEN 'home' WHEN 4 THEN 'wait' WHEN 5 THEN 'finish' WHEN 6 THEN 'impossible' ELSE 'wait' END AS type FROM r)""", _RAW)
def decode_coded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.settled(episodes.parser("coded")(_raw(spark, sf_dir)))
    return s.select("episode_id", "step_id", "task", "screenshot_before", F.col("screen_size.width"), F.col("screen_size.height"), F.col("action.type"), F.col("action.text"), F.col("action.point.x").alias("x"), F.col("action.point.y").alias("y"), F.col("action.start_point.x").alias("sx"), F.col("action.end_point.y").alias("ey"),
        *[F.try_element_at("action.metadata", F.lit(k)).alias(k) for k in ("action_code", "semantic")], *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("source", "device_type", "episode_length")],
        F.col("action.coordinate_space").alias("space"))


@query("""SELECT 'e' || e AS episode_id, CAST(k AS INTEGER) AS "index", ['a', '', 'c'][k + 1] AS text, ['TEXT', 'ICON', 'TEXT'][k + 1] AS ui_type,
      greatest(0.0::DOUBLE, xc - 0.3::DOUBLE / 2) AS x1, greatest(0.0::DOUBLE, yc - 0.1::DOUBLE / 2) AS y1, least(1.0::DOUBLE, xc + 0.3::DOUBLE / 2) AS x2, least(1.0::DOUBLE, yc + 0.1::DOUBLE / 2) AS y2
    FROM (SELECT e, k, ((e * 3 + k * 311) % 1000) / 1000.0::DOUBLE AS yc, ((e * 7 + k * 97) % 1000) / 1000.0::DOUBLE AS xc FROM r, range(3) t(k))""", _RAW)
def ui_elements_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = episodes.coded_episodes(_raw(spark, sf_dir)).select("episode_id", F.explode("ui_elements").alias("u"))
    return s.select("episode_id", "u.index", "u.text", "u.ui_type", "u.bbox.x1", "u.bbox.y1", "u.bbox.x2", "u.bbox.y2")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE 100 + event_id % 900 END::INTEGER AS width, CASE WHEN event_id % 7 = 6 THEN NULL ELSE 200 + event_id % 800 END::INTEGER AS height FROM events""", "u AS (SELECT 1)")
def screen_size_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    w, h = 100 + e % 900, 200 + e % 800
    forms = ('{"screen_size":{"width":%d,"height":%d}}', '{"resolution":[%d,%d]}', '{"image_width":%d,"image_height":%d}', '{"image_size":{"w":%d,"h":%d}}', '{"image_encoded":{"size":[%d,%d]}}', '{"screen_size":{"width":5},"w":%d,"h":%d}')
    text = F.get(F.array(*[F.format_string(f, w, h) for f in forms], F.lit('{"screen_size":null}')), (e % 7).cast("int"))
    s = read(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v")).select("event_id", episodes.screen_size(F.col("v")).alias("s"))
    return s.select("event_id", "s.width", "s.height")


@query("""SELECT event_id, ['click', 'click', 'swipe', 'type', 'wait', 'scroll'][1 + event_id % 6] AS type, CASE WHEN event_id % 6 < 2 THEN CAST(event_id % 500 AS DOUBLE) END AS x,
      CASE WHEN event_id % 6 = 2 THEN 3.0::DOUBLE END AS ex, CASE event_id % 6 WHEN 3 THEN 'hey' END AS text, CASE event_id % 6 WHEN 5 THEN 'up' END AS direction,
      CASE WHEN event_id % 6 = 1 THEN 'normalized_1000' ELSE 'pixel' END AS space FROM events""", "u AS (SELECT 1)")
def parse_object_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("event_id") % 500
    forms = ('{"action_type":"tap","x":%d,"y":6}', '{"type":"click","position":{"X":%d,"Y":8},"coord_space":"normalized_1000"}', '{"action":"swipe","from":[1,2],"to":[3,4]}', '{"name":"input text","value":"hey"}', "[1]", '"scroll(up)"')
    text = F.get(F.array(*[F.format_string(f, x) if "%d" in f else F.lit(f) for f in forms]), (F.col("event_id") % 6).cast("int"))
    rows = spread(read(spark, sf_dir, "events").select("event_id"), "event_id")
    a = G.once(rows.select("event_id", F.parse_json(text).alias("v")), a=episodes.any_action(F.col("v")))
    return a.select("event_id", "a.type", F.col("a.point.x").alias("x"), F.col("a.end_point.x").alias("ex"), "a.text", "a.direction", F.col("a.coordinate_space").alias("space"))


# Geometry.


@query("SELECT event_id, space, round(px, 6) AS px, round(py, 6) AS py, round(px / 1080 * 1000, 6) AS nx, round(py / 2400 * 1, 6) AS ny FROM steps")
def coords_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir, texts=False)
    a, b = (G.from_pixel(_p(), F.col("screen_size"), F.lit(k)) for k in ("normalized_1000", "normalized_1"))
    return s.select("event_id", F.col("action.coordinate_space").alias("space"), _r(_p()["x"]).alias("px"), _r(_p()["y"]).alias("py"), _r(a["x"]).alias("nx"), _r(b["y"]).alias("ny"))


@query("""SELECT event_id, CASE WHEN screen THEN 'normalized_1000' ELSE space END AS space, round(CASE WHEN screen THEN px / 1080 * 1000 ELSE x END, 6) AS x,
      round(CASE WHEN screen THEN ((event_id * 11) % 800)::DOUBLE / 1080 * 1000 ELSE (event_id * 11) % 800 END, 6) AS tx1,
      round(CASE WHEN screen THEN px / 1080 * 1000 ELSE x END, 6) AS history_x, 1 AS n_history FROM steps""")
def step_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir, texts=False)
    s = s.withColumns({"target_bbox": G.box((F.col("event_id") * 11) % 800, F.lit(0), F.lit(900), F.lit(10)), "history": F.array("action")})
    s = transforms.in_space(s)
    past = F.get("history", F.lit(0))
    return s.select(
        "event_id",
        F.col("action.coordinate_space").alias("space"),
        _r(G.primary_point(F.col("action"))["x"]).alias("x"),
        _r(F.col("target_bbox.x1")).alias("tx1"),
        _r(G.primary_point(past)["x"]).alias("history_x"),
        F.size("history").alias("n_history"),
    )


_HELD = ", held AS (SELECT s.event_id, i, txt, ui_type, valid, (x2 - x1) * (y2 - y1) AS area FROM steps s JOIN els e ON s.event_id = e.event_id AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2) "


@query(_HELD + "SELECT event_id, min(i) FILTER (valid) AS first_valid, min(i) AS first_any FROM held GROUP BY event_id")
def element_at_point_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.once(_boxed(spark, sf_dir), p=_p())
    s = G.once(s, first_valid=G.first_at(F.col("boxes"), F.col("p"))["index"].cast("long"), first_any=G.first_at(F.col("boxes"), F.col("p"), True)["index"].cast("long"))
    return s.where("first_any is not null").select("event_id", "first_valid", "first_any")


@query(_HELD + "SELECT event_id, i AS smallest FROM held WHERE valid QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY area, i) = 1")
def element_at_point_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.once(_boxed(spark, sf_dir), p=_p())
    s = G.once(s, smallest=G.smallest_at(F.col("boxes"), F.col("p"))["index"].cast("long"))
    return s.where("smallest is not null").select("event_id", "smallest")


@query(_HELD + "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY area, i) AS place, i AS element FROM held WHERE valid")
def elements_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.once(G.once(_boxed(spark, sf_dir), p=_p()), held=G.held_at(F.col("boxes"), F.col("p")))
    s = s.select("event_id", F.posexplode("held").alias("at", "b"))
    return s.select("event_id", (F.col("at") + 1).cast("long").alias("place"), F.col("b.index").cast("long").alias("element"))


# Profiles.


@query("""SELECT count(*) AS n_steps, count(DISTINCT episode_id) AS n_episodes, (SELECT min(c) FROM (SELECT count(*) AS c FROM steps GROUP BY episode_id)) AS len_min, (SELECT max(c) FROM (SELECT count(*) AS c FROM steps GROUP BY episode_id)) AS len_max,
      count(*) / count(DISTINCT episode_id) AS len_mean, count(x) AS n_points, count(*) FILTER (NOT (px >= 0 AND px < 1080 AND py >= 0 AND py < 2400)) AS n_outside,
      count(*) FILTER (NOT (px >= 0 AND px < 1080 AND py >= 0 AND py < 2400)) / greatest(count(x), 1) AS outside_rate, round(avg(round(px / 1080, 9)), 6) AS mean_x, round(avg(round(py / 2400, 9)), 6) AS mean_y,
      count(typed) AS n_typed, count(*) FILTER (trim(typed) = '') AS n_empty, count(*) FILTER (trim(typed) = '') / greatest(count(typed), 1) AS empty_rate, count(DISTINCT task) AS n_tasks FROM steps""")
def step_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.step_profile(steps(spark, sf_dir))


@query("SELECT len, count(*) AS n FROM (SELECT count(*) AS len FROM steps GROUP BY episode_id) GROUP BY len")
def episode_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir, texts=False).groupBy("episode_id").agg(F.count(F.lit(1)).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind AS value, count(*) AS n FROM steps GROUP BY kind")
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histograms(steps(spark, sf_dir, texts=False), {"action_type": F.col("action.type")}).drop("dim")


_RECORDS = """n AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM n)"""
_PATHS = "(VALUES ('id', 'int', 1), ('steps', 'list', 2), ('steps[]', 'dict', 2), ('steps[].action', 'str', 1), ('steps[].action', 'dict', 1), ('steps[].action.type', 'str', 1), ('steps[].size', 'float', 1), ('none', 'list', 2)) p(path, type, m)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = '{"id": %d, "steps": [{"action": "%s"}, {"action": {"type": "%s"}, "size": 1.5}], "none": []}'
    return spread(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select(F.format_string(form, "event_id", "event_type", "event_type").alias("raw"))


@query(f"SELECT path, type, m * n AS n FROM s, {_PATHS}", _RECORDS)
def json_census_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_census(_records(spark, sf_dir), limit=None, depth=5)


@query(f"""SELECT 'path' AS dim, path AS value, type, m * n AS n FROM s, {_PATHS} UNION ALL SELECT 'record', 'all', NULL, n FROM s
    UNION ALL SELECT 'key', unnest(['id', 'steps', 'none']), NULL, n FROM s UNION ALL SELECT 'action_like', k, NULL, 2 * n FROM n""", _RECORDS)
def record_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.record_census(_records(spark, sf_dir), limit=None, depth=5)


@query("""SELECT path, type, n FROM (SELECT 'k' AS path, CASE typeof(v) WHEN 'x' THEN '' ELSE 'int' END AS type, count(*) AS n FROM (SELECT json_extract(props, '$.k') AS v FROM events WHERE json_valid(props)) WHERE v IS NOT NULL GROUP BY ALL)""", "u AS (SELECT 1)")
def json_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_census(read(spark, sf_dir, "events").where("props is not null").select(F.col("props").alias("raw")), limit=None, depth=4)


# Selection and splits.

_QDD = _PASSED + """, t AS (
    SELECT key, action_type, difficulty, row_number() OVER (PARTITION BY action_type ORDER BY difficulty DESC, key DESC) AS turn
    FROM (SELECT episode_id || ':' || step_id AS key, kind AS action_type, coalesce(difficulty, 1 - score) AS difficulty FROM b WHERE bucket = 'high'))
"""


def _qdd(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    rows = audit.audited(steps(spark, sf_dir))
    hard = selection.step_difficulty(F.col("metadata"), F.col("audit.quality_score"))
    rows = rows.select(F.col("audit.key").alias("key"), F.col("action.type").alias("action_type"), F.col("audit.quality_bucket").alias("bucket"), hard.alias("difficulty"))
    return selection.select_diverse(rows, **limits).select("key", "action_type", "difficulty", "turn")


@query(_QDD + "SELECT key, action_type, difficulty, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, action_type LIMIT 500")
def qdd_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qdd(spark, sf_dir, max_samples=500)


@query(_QDD + "SELECT key, action_type, difficulty, CAST(turn AS INTEGER) AS turn FROM t WHERE turn <= 40 ORDER BY turn, action_type LIMIT 500")
def qdd_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qdd(spark, sf_dir, max_samples=500, per_action=40)


_SPLIT = """, h AS (SELECT *, md5(trim(regexp_replace(lower(task), '[\\s\\x0B\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g'))) AS m FROM steps),
  p AS (SELECT *, CAST(('0x' || m)::UHUGEINT % 10000 AS BIGINT) AS bucket FROM h),
  w AS (SELECT *, CASE WHEN bucket < 8000 THEN 'train' WHEN bucket < 9000 THEN 'val' ELSE 'test' END AS split FROM p)
"""


@query(_SPLIT + "SELECT event_id, bucket, split FROM w")
def instruction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_split(steps(spark, sf_dir), "task", bucket="bucket").select("event_id", "bucket", "split")


@query(_SPLIT + "SELECT split, count(*) AS n, count(DISTINCT task) AS n_tasks FROM w GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_split(steps(spark, sf_dir), "task").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(X.identity(F.col("task"))).alias("n_tasks"))


@query("SELECT event_id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 100", "u AS (SELECT 1)")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.seeded_sample(read(spark, sf_dir, "events").select("event_id"), F.col("event_id"), 100)


# Rewards.  A candidate is the next step's action, if it has one; the reference is the step's own.

_NEXT = """, c AS (
    SELECT *, lead(kind) OVER w AS ckind, lead(x) OVER w AS cx, lead(y) OVER w AS cy, lead(space) OVER w AS cspace, lead(typed) OVER w AS ctext FROM steps WINDOW w AS (PARTITION BY episode_id ORDER BY step_id)),
  d AS (
    SELECT *, CASE cspace WHEN 'pixel' THEN cx WHEN 'normalized_1000' THEN cx / 1000 * 1080 ELSE cx / 1 * 1080 END AS cpx, CASE cspace WHEN 'pixel' THEN cy WHEN 'normalized_1000' THEN cy / 1000 * 2400 ELSE cy / 1 * 2400 END AS cpy FROM c WHERE ckind IS NOT NULL),
  parts AS (
    SELECT event_id, kind, 1.0::DOUBLE AS format, (ckind = kind)::INT::DOUBLE AS action_type,
           CASE WHEN ckind NOT IN ('click', 'swipe') THEN 1.0::DOUBLE
                WHEN event_id % 4 = 0 AND screen THEN (cpx BETWEEN (event_id * 11) % 800 AND (event_id * 11) % 800 + 200 AND cpy BETWEEN (event_id * 19) % 1800 AND (event_id * 19) % 1800 + 300)::INT::DOUBLE
                WHEN x IS NULL THEN 0.0::DOUBLE
                WHEN screen THEN exp(-sqrt((cpx - px) * (cpx - px) + (cpy - py) * (cpy - py)) / 80) ELSE exp(-sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) / 80) END AS coordinate,
           CASE WHEN ckind <> 'type' THEN 1.0::DOUBLE WHEN coalesce(ctext, '') = '' OR coalesce(typed, '') = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein(ctext, typed)::DOUBLE / greatest(length(ctext), length(typed)) END AS text
    FROM d)
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = steps(spark, sf_dir)
    return s.withColumn("candidate", F.lead("action").over(Window.partitionBy("episode_id").orderBy("step_id"))).where("candidate is not null")


def _parts() -> dict:
    return rewards.components(F.col("candidate"), F.col("action"), F.col("screen_size"), F.col("target_bbox"), F.lit(None).cast("double"))


@query(_NEXT + """SELECT event_id, format, action_type, round(coordinate, 6) AS coordinate, round(text, 6) AS text, 0.0::DOUBLE AS state_change,
    round((0.25::DOUBLE * format + coordinate) / 1.25::DOUBLE, 6) AS grounding, round((0.5::DOUBLE * format + action_type + coordinate + text) / 3.5::DOUBLE, 6) AS action_prediction,
    round((0.5::DOUBLE * format + action_type + coordinate + text) / 4::DOUBLE, 6) AS full_audit FROM parts""")
def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts()
    rows = _candidates(spark, sf_dir).select("event_id", *[v.alias(k) for k, v in parts.items()])
    own = {k: F.col(k) for k in parts}
    totals = [_r(rewards.total({k: own[k] for k in w}, w)).alias(name) for name, w in rewards.PRESETS.items()]
    return rows.select("event_id", "format", "action_type", _r(F.col("coordinate")).alias("coordinate"), _r(F.col("text")).alias("text"), "state_change", *totals)


@query(_NEXT + """, t AS (SELECT kind, (0.5::DOUBLE * format + action_type + coordinate + text) / 3.5::DOUBLE AS r,
      (0.5::DOUBLE + 1 + CASE WHEN kind NOT IN ('click', 'swipe') THEN 1.0 ELSE 0.5 END + 1) / 3.5::DOUBLE AS c FROM parts)
    SELECT kind AS negative_type, count(*) AS n, round(avg((c > r)::INT), 6) AS win_rate, round(avg((c = r)::INT), 6) AS tie_rate, round(avg(c - r), 6) AS mean_margin FROM t GROUP BY ROLLUP (kind)""")
def reward_pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts()
    weights = rewards.PRESETS["action_prediction"]
    rows = _candidates(spark, sf_dir).select(F.col("action.type").alias("negative_type"), rewards.total({k: parts[k] for k in weights}, weights).alias("r"))
    rows = rows.withColumn("c", (F.lit(0.5) + 1 + F.when(~F.col("negative_type").isin("click", "swipe"), 1.0).otherwise(0.5) + 1) / 3.5)
    out = rewards.pair_report(rows, "c", "r", ["negative_type"])
    return out.select("negative_type", "n", *[_r(F.col(c)).alias(c) for c in ("win_rate", "tie_rate", "mean_margin")])


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS INTEGER) AS rank, score FROM (SELECT user_id, event_id, CAST(event_id % 5 AS DOUBLE) AS score FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) <= 3""", "u AS (SELECT 1)")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5).cast("double").alias("score"))
    return rewards.reranked(rows, ["user_id"], pos="event_id").where("rank <= 3").select("user_id", "event_id", "rank", "score")


# Negatives and pairs.

_BACK = "CASE space WHEN 'pixel' THEN {0} WHEN 'normalized_1000' THEN {0} / {1} * 1000 ELSE {0} / {1} * 1 END"
_NEG = """, tries AS (
    SELECT event_id, a, CAST('0x' || substr(md5('42|' || episode_id || ':' || step_id || '|' || a || '|x'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 1079 AS qx,
           CAST('0x' || substr(md5('42|' || episode_id || ':' || step_id || '|' || a || '|y'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 2399 AS qy FROM steps, range(50) r(a) WHERE screen),
  tf AS (SELECT t.*, NOT EXISTS (SELECT 1 FROM els e WHERE e.event_id = t.event_id AND valid AND qx BETWEEN x1 AND x2 AND qy BETWEEN y1 AND y2) AS free FROM tries t),
  rnd AS (SELECT event_id, qx, qy, free FROM tf QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN free THEN a ELSE 100 - a END) = 1),
  src AS (SELECT s.event_id, min(i) AS i FROM steps s JOIN els e ON s.event_id = e.event_id AND valid AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY s.event_id),
  offs AS (SELECT o, [1.0, 1.5, 2.0][1 + o // 8]::DOUBLE * 120 * [1, -1, 0, 0, 1, -1, 1, -1][1 + o % 8] AS dx, [1.0, 1.5, 2.0][1 + o // 8]::DOUBLE * 120 * [0, 0, 1, -1, 1, -1, -1, 1][1 + o % 8] AS dy FROM range(24) r(o)),
  sh AS (SELECT s.event_id, o, greatest(0.0::DOUBLE, least(px + dx, 1079.0::DOUBLE)) AS qx, greatest(0.0::DOUBLE, least(py + dy, 2399.0::DOUBLE)) AS qy FROM steps s, offs WHERE px IS NOT NULL AND kind = 'click'),
  shl AS (SELECT sh.*, (SELECT min(i) FROM els e WHERE e.event_id = sh.event_id AND valid AND qx BETWEEN x1 AND x2 AND qy BETWEEN y1 AND y2) AS hit FROM sh),
  pick AS (SELECT shl.event_id, qx, qy, hit FROM shl LEFT JOIN src USING (event_id) WHERE hit IS NULL OR hit IS DISTINCT FROM src.i
           QUALIFY row_number() OVER (PARTITION BY shl.event_id ORDER BY hit IS NOT NULL, o) = 1),
  oth AS (SELECT e.event_id, e.i, x1, y1, x2, y2, row_number() OVER (PARTITION BY e.event_id ORDER BY e.i) - 1 AS rn, count(*) OVER (PARTITION BY e.event_id) AS n FROM els e LEFT JOIN src USING (event_id) WHERE valid AND e.i IS DISTINCT FROM src.i),
  same AS (SELECT s.event_id, (x1 + x2) / 2 AS qx, (y1 + y2) / 2 AS qy FROM steps s JOIN oth o ON s.event_id = o.event_id
           AND rn = CAST(floor(CAST('0x' || substr(md5('42|' || episode_id || ':' || step_id || '|0|element'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * n) AS BIGINT)),
  neg AS (
    SELECT s.event_id, 'random_coordinate' AS negative_type, 'click' AS rkind, coalesce(qx, 0) AS qx, coalesce(qy, 0) AS qy, NOT screen AS raw, 'random_coordinate' AS source, CASE WHEN NOT screen OR free THEN 'random_non_ui_point' ELSE 'random_coordinate' END AS subtype FROM steps s LEFT JOIN rnd USING (event_id)
    UNION ALL
    SELECT s.event_id, 'shifted_coordinate', CASE WHEN kind = 'swipe' THEN 'swipe' ELSE 'click' END,
           CASE WHEN kind = 'swipe' THEN ex WHEN s.px IS NULL THEN coalesce(r.qx, 0) WHEN p.event_id IS NOT NULL THEN p.qx ELSE greatest(0.0::DOUBLE, least(px + 120, 1079.0::DOUBLE)) END,
           CASE WHEN kind = 'swipe' THEN ey WHEN s.px IS NULL THEN coalesce(r.qy, 0) WHEN p.event_id IS NOT NULL THEN p.qy ELSE greatest(0.0::DOUBLE, least(py + 120, 2399.0::DOUBLE)) END,
           kind = 'swipe' OR NOT screen, CASE WHEN kind <> 'swipe' AND s.px IS NULL THEN 'random_coordinate' ELSE 'shifted_coordinate' END,
           CASE WHEN kind = 'swipe' THEN 'wrong_swipe_direction' WHEN s.px IS NULL THEN CASE WHEN NOT screen OR free THEN 'random_non_ui_point' ELSE 'random_coordinate' END
                WHEN p.event_id IS NULL THEN 'shifted_coordinate_fallback' WHEN p.hit IS NULL THEN 'near_miss_non_ui_shift' ELSE 'shifted_other_ui_element' END
    FROM steps s LEFT JOIN rnd r USING (event_id) LEFT JOIN pick p USING (event_id)
    UNION ALL
    SELECT s.event_id, 'same_screen_element', 'click', coalesce(m.qx, r.qx, 0), coalesce(m.qy, r.qy, 0), NOT screen, CASE WHEN m.event_id IS NULL THEN 'random_coordinate' ELSE 'same_screen_element' END,
           CASE WHEN m.event_id IS NOT NULL THEN 'wrong_ui_element' WHEN NOT screen OR free THEN 'random_non_ui_point' ELSE 'random_coordinate' END
    FROM steps s LEFT JOIN same m USING (event_id) LEFT JOIN rnd r USING (event_id)
    UNION ALL
    SELECT event_id, 'wrong_action_type', CASE WHEN kind = 'click' THEN 'type' ELSE 'click' END, CASE WHEN kind <> 'click' THEN coalesce(x, 0) END, CASE WHEN kind <> 'click' THEN coalesce(y, 0) END, TRUE, 'wrong_action_type', kind || CASE WHEN kind = 'click' THEN '_to_type' ELSE '_to_click' END FROM steps),
  pairs AS (
    SELECT s.*, episode_id || ':' || step_id || ':' || negative_type AS pair_id, negative_type, rkind, source, subtype, raw, qx, qy,
           CASE WHEN raw THEN qx ELSE CASE space WHEN 'pixel' THEN qx WHEN 'normalized_1000' THEN qx / 1080 * 1000 ELSE qx / 1080 * 1 END END AS nx,
           CASE WHEN raw THEN qy ELSE CASE space WHEN 'pixel' THEN qy WHEN 'normalized_1000' THEN qy / 2400 * 1000 ELSE qy / 2400 * 1 END END AS ny FROM steps s JOIN neg USING (event_id)),
  pr AS (
    SELECT *, CASE WHEN screen THEN CASE space WHEN 'pixel' THEN nx WHEN 'normalized_1000' THEN nx / 1000 * 1080 ELSE nx / 1 * 1080 END END AS rpx,
           CASE WHEN screen THEN CASE space WHEN 'pixel' THEN ny WHEN 'normalized_1000' THEN ny / 1000 * 2400 ELSE ny / 1 * 2400 END END AS rpy FROM pairs)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.preference_pairs(_boxed(spark, sf_dir))


def _pairs_of_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.preference_pairs(profile.with_gt_element(_boxed(spark, sf_dir)))


def _negative_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = negatives.with_sampling(_boxed(spark, sf_dir)).select("event_id", negatives.SAMPLERS[name]().alias("n"))
        p = F.col("n.action.point")
        return n.select("event_id", F.col("n.action.type").alias("type"), _r(p["x"]).alias("x"), _r(p["y"]).alias("y"), "n.negative_source", "n.negative_subtype")

    run.__name__ = f"neg_{name}"
    query(_NEG + f"SELECT event_id, rkind AS type, round(nx, 6) AS x, round(ny, 6) AS y, source AS negative_source, subtype AS negative_subtype FROM pairs WHERE negative_type = '{name}'")(run)


for _name in negatives.ORDER:
    _negative_query(_name)


@query(_NEG + """, chosen AS (SELECT s.event_id, o.i FROM steps s JOIN oth o ON s.event_id = o.event_id
      AND rn = CAST(floor(CAST('0x' || substr(md5('42|' || episode_id || ':' || step_id || '|0|element'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * n) AS BIGINT))
  SELECT p.event_id, p.negative_type, source AS negative_source, subtype AS negative_subtype, CASE WHEN source = 'shifted_coordinate' THEN 'd' END AS device,
    CAST(c.i AS VARCHAR) AS ui_element_index, e.txt AS ui_element_text, e.ui_type AS ui_element_type
  FROM pairs p LEFT JOIN chosen c ON p.event_id = c.event_id AND p.negative_type = 'same_screen_element' LEFT JOIN els e ON c.event_id = e.event_id AND c.i = e.i""")
def negative_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda key: F.try_element_at("rejected.metadata", F.lit(key)).alias(key)
    keys = ("negative_source", "negative_subtype", "device", "ui_element_index", "ui_element_type")
    return _pairs(spark, sf_dir).select("event_id", "negative_type", *map(told, keys), F.lower(F.trim(told("ui_element_text"))).alias("ui_element_text"))


@query("SELECT event_id, x AS old_x, ex AS start_x, ey AS start_y, x AS end_x, y AS end_y FROM steps WHERE kind = 'swipe'")
def neg_swipe_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = negatives.with_sampling(_boxed(spark, sf_dir)).where("action.type = 'swipe'").select("event_id", F.col("action.start_point.x").alias("old_x"), negatives.reversed_swipe().alias("n"))
    a = "n.action"
    return n.select("event_id", "old_x", F.col(f"{a}.start_point.x").alias("start_x"), F.col(f"{a}.start_point.y").alias("start_y"), F.col(f"{a}.end_point.x").alias("end_x"), F.col(f"{a}.end_point.y").alias("end_y"))


_FACTS = """, ge AS (SELECT p.pair_id, min(i) AS gi FROM pr p JOIN els e ON p.event_id = e.event_id AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY ALL),
  re AS (SELECT p.pair_id, min(i) AS ri FROM pr p JOIN els e ON p.event_id = e.event_id AND rpx BETWEEN x1 AND x2 AND rpy BETWEEN y1 AND y2 GROUP BY ALL),
  facts AS (
    SELECT pr.*, gi, ri, coalesce(gi = ri, FALSE) AS same_element, sqrt((px - rpx) * (px - rpx) + (py - rpy) * (py - rpy)) AS dist FROM pr LEFT JOIN ge USING (pair_id) LEFT JOIN re USING (pair_id)),
  fb AS (SELECT *, CASE WHEN dist IS NULL THEN 'unknown' WHEN dist <= 20 THEN '<=20px' WHEN dist <= 50 THEN '<=50px' WHEN dist <= 100 THEN '<=100px' ELSE '>100px' END AS bucket FROM facts)
"""


@query(_NEG + _FACTS + """, v AS (
    SELECT unnest(['negative_type', 'negative_subtype', 'chosen_action_type', 'rejected_action_type', 'transition', 'type_subtype', 'type_rejected', 'distance', 'rejected_in_ui', 'same_element', 'rejected_ui_type']) AS dim,
           unnest([negative_type, subtype, kind, rkind, kind || '->' || rkind, negative_type || '->' || subtype, negative_type || '->' || rkind, bucket, CASE WHEN ri IS NULL THEN 'false' ELSE 'true' END, CASE WHEN same_element THEN 'true' ELSE 'false' END,
                   CASE WHEN ri IS NOT NULL THEN ['TEXT', 'ICON_MAGNIFYING_GLASS', 'TEXT', 'BUTTON', 'ICON_MIC'][1 + (event_id + ri) % 5] END]) AS value FROM fb)
  SELECT dim, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL""")
def pairs_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pair_profile(_pairs_of_elements(spark, sf_dir))


@query(_NEG + _FACTS + "SELECT negative_type, bucket, count(*) AS n FROM fb GROUP BY ALL")
def distance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.with_pair_facts(_pairs_of_elements(spark, sf_dir))
    return rows.groupBy("negative_type", G.distance_bucket(F.col("distance_px")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Scorer rows.


@query(_NEG + """SELECT pair_id || ':chosen' AS sample_id, 'Yes' AS label, 1 AS label_id, kind AS action_type, round(x, 6) AS x, image, task AS instruction, negative_type FROM pairs
    UNION ALL SELECT pair_id || ':rejected', 'No', 0, rkind, round(nx, 6), image, task, negative_type FROM (SELECT *, CASE WHEN rkind = 'type' THEN NULL ELSE nx END AS q FROM pairs)""")
def scorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scorer.scorer_rows(_pairs(spark, sf_dir))
    return s.select("sample_id", "label", "label_id", F.col("candidate_action.type").alias("action_type"), _r(G.primary_point(F.col("candidate_action"))["x"]).alias("x"), "image", "instruction", "negative_type")


@query("SELECT 8 * count(*) AS n, 4 * count(*) AS n_yes, 4 * count(*) AS n_no, count(DISTINCT lower(trim(task))) AS n_instructions, count(DISTINCT episode_id) AS n_episodes, 8 * count(image) AS n_images FROM steps")
def scorer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer.scorer_summary(scorer.scorer_rows(_pairs(spark, sf_dir)))


@query(_NEG + """, r AS (SELECT 'Yes' AS label, kind AS k, negative_type FROM pairs UNION ALL SELECT 'No', rkind, negative_type FROM pairs),
    v AS (SELECT unnest(['label', 'negative_type', 'candidate_action_type']) AS dim, unnest([label, CASE WHEN label = 'No' THEN negative_type END, k]) AS value FROM r)
  SELECT dim, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL""")
def scorer_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer.scorer_histograms(scorer.scorer_rows(_pairs(spark, sf_dir)))


@query("SELECT '/shots/root/' || image AS path, count(*) AS n FROM steps WHERE event_id % 3 <> 0 AND image IS NOT NULL GROUP BY image")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir, texts=False).select("event_id", F.col("screenshot_before").alias("image"))
    there = rows.where(F.col("event_id") % 3 == 0).select(scorer.resolved(F.col("image"), "/shots/root/").alias("path")).where("path is not null")
    return scorer.missing_images(rows, there, "/shots/root")


_TEXT = "CASE kind WHEN 'click' THEN 'click(point=[' || x || ', ' || y || '])' WHEN 'swipe' THEN 'swipe(start_point=[' || x || ', ' || y || '], end_point=[' || ex || ', ' || ey || '])' WHEN 'type' THEN 'type(text=' || CASE WHEN contains(typed, '''') AND NOT contains(typed, '\"') THEN '\"' || replace(typed, '\\', '\\\\') || '\"' ELSE '''' || replace(replace(typed, '\\', '\\\\'), '''', '\\''') || '''' END || ')' ELSE kind END"


@query(f"SELECT event_id, 'Instruction: ' || task || chr(10) || 'Candidate action: ' || {_TEXT} || chr(10) || 'Is this candidate action correct for the instruction and screenshot?' || chr(10) || 'Answer only Yes or No.' AS prompt FROM steps")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).select("event_id", F.col("task").alias("instruction"), X.action_text(F.col("action")).alias("candidate_action_text"))
    return scorer.with_prompt(s).select("event_id", "prompt")


_ANSWERS = ("Yes", "no.", "YES, it is", "I say yes", "well, no", "yes and no", "maybe", "")


@query("SELECT conv_id, turn, ['Yes', 'No', 'Yes', 'Yes', 'No', 'Yes', 'Unknown', 'Unknown'][1 + (conv_id + turn) % 8] AS answer FROM conversations", "u AS (SELECT 1)")
def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, _ANSWERS)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.answer(said).alias("answer"))


# Regions and the filter.

_LIKE = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_REGION = """, pts AS ({points}),
  tg AS (
    SELECT p.id, p.event_id, p.task, e.i, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, txt, ui_type FROM pts p JOIN els e ON p.event_id = e.event_id AND valid AND qx BETWEEN x1 AND x2 AND qy BETWEEN y1 AND y2
    QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (x2 - x1) * (y2 - y1), e.i) = 1),
  nb AS (
    SELECT t.id, t.w, t.h, t.cx, t.cy, e.i, e.x1, e.y1, e.x2, e.y2, e.txt, e.ui_type, greatest(0.0::DOUBLE, e.x1 - t.x2, t.x1 - e.x2) AS gx, greatest(0.0::DOUBLE, e.y1 - t.y2, t.y1 - e.y2) AS gy,
           abs((e.y1 + e.y2) / 2 - t.cy) AS dy, abs((e.x1 + e.x2) / 2 - t.cx) AS dx, abs((e.y1 + e.y2) / 2 - t.cy) <= greatest(20.0::DOUBLE, t.h * 1.6::DOUBLE) OR (e.y2 >= t.y1 AND e.y1 <= t.y2) AS in_row FROM tg t JOIN els e ON t.event_id = e.event_id AND valid),
  ag AS (
    SELECT id, string_agg(txt, ' ' ORDER BY x1, i) FILTER (in_row) AS row_text,
           [min(x1), min(y1), max(x2), max(y2)] FILTER_S AS se, [min(x1), min(y1), max(x2), max(y2)] FILTER_C AS co, [min(x1), min(y1), max(x2), max(y2)] FILTER_D AS ca, count(*) FILTER (dx <= greatest(150.0::DOUBLE, w * 0.85::DOUBLE) AND gy <= greatest(110.0::DOUBLE, h * 2.4::DOUBLE)) AS nca
    FROM nb GROUP BY id),
  kd AS (
    SELECT t.*, row_text, se, co, ca, CASE WHEN contains(txt, 'search') OR ui_type = 'ICON_MAGNIFYING_GLASS' THEN 'search_or_suggestion_row' WHEN {cta} OR (contains(row_text, 'sign') AND contains(row_text, 'check out')) THEN 'full_width_cta_button'
           WHEN {compact} THEN 'compact_control_button' WHEN {product} AND nca >= 2 THEN 'product_card_region' ELSE 'padded_raw_bbox' END AS kind FROM tg t JOIN ag USING (id)),
  sb AS (
    SELECT id, CASE kind WHEN 'search_or_suggestion_row' THEN coalesce(se[1], x1) - 10 WHEN 'full_width_cta_button' THEN 1080 * 0.04::DOUBLE WHEN 'compact_control_button' THEN co[1] - greatest(24.0::DOUBLE, w * 0.35::DOUBLE) WHEN 'product_card_region' THEN ca[1] - 10 ELSE x1 - greatest(6.0::DOUBLE, w * 0.12::DOUBLE) END AS a,
           CASE kind WHEN 'search_or_suggestion_row' THEN coalesce(se[2], y1) - greatest(8.0::DOUBLE, h * 0.35::DOUBLE) WHEN 'full_width_cta_button' THEN cy - greatest(52.0::DOUBLE, h * 2.7::DOUBLE) / 2 WHEN 'compact_control_button' THEN co[2] - greatest(18.0::DOUBLE, h * 0.95::DOUBLE) WHEN 'product_card_region' THEN ca[2] - 10 ELSE y1 - greatest(4.0::DOUBLE, h * 0.12::DOUBLE) END AS b,
           CASE kind WHEN 'search_or_suggestion_row' THEN coalesce(se[3], x2) + 10 WHEN 'full_width_cta_button' THEN 1080 * 0.96::DOUBLE WHEN 'compact_control_button' THEN co[3] + greatest(24.0::DOUBLE, w * 0.35::DOUBLE) WHEN 'product_card_region' THEN ca[3] + 10 ELSE x2 + greatest(6.0::DOUBLE, w * 0.12::DOUBLE) END AS c,
           CASE kind WHEN 'search_or_suggestion_row' THEN coalesce(se[4], y2) + greatest(8.0::DOUBLE, h * 0.35::DOUBLE) WHEN 'full_width_cta_button' THEN cy + greatest(52.0::DOUBLE, h * 2.7::DOUBLE) / 2 WHEN 'compact_control_button' THEN co[4] + greatest(18.0::DOUBLE, h * 0.95::DOUBLE) WHEN 'product_card_region' THEN ca[4] + 10 ELSE y2 + greatest(4.0::DOUBLE, h * 0.12::DOUBLE) END AS d,
           kind, i FROM kd),
  sc AS (SELECT id, kind, i, greatest(0.0::DOUBLE, least(a, 1080.0::DOUBLE)) AS a, greatest(0.0::DOUBLE, least(b, 2400.0::DOUBLE)) AS b, greatest(0.0::DOUBLE, least(c, 1080.0::DOUBLE)) AS c, greatest(0.0::DOUBLE, least(d, 2400.0::DOUBLE)) AS d FROM sb),
  rg AS (SELECT id, kind, i, CASE WHEN kind = 'search_or_suggestion_row' THEN greatest(0.0::DOUBLE, a - 8) ELSE a END AS a, b, CASE WHEN kind = 'search_or_suggestion_row' THEN least(1080.0::DOUBLE, c + 8) ELSE c END AS c, d FROM sc)
"""


def _region_sql(points: str) -> str:
    def agg(when: str) -> str:
        return f"[min(x1) FILTER ({when}), min(y1) FILTER ({when}), max(x2) FILTER ({when}), max(y2) FILTER ({when})]"

    search = "in_row AND x2 - x1 > 2 AND y2 - y1 > 2 AND (contains(txt, 'search') OR ui_type IN ('ICON_MAGNIFYING_GLASS', 'ICON_MIC', 'ICON_TAKE_PHOTO', 'ICON_X')) AND gx <= greatest(70.0::DOUBLE, w * 2.5::DOUBLE) AND dy <= greatest(28.0::DOUBLE, h * 2.0::DOUBLE)"
    side = "in_row AND gx <= greatest(48.0::DOUBLE, w * 2.2::DOUBLE)"
    card = "dx <= greatest(150.0::DOUBLE, w * 0.85::DOUBLE) AND gy <= greatest(110.0::DOUBLE, h * 2.4::DOUBLE)"
    out = _REGION
    for mark, when in (("S", search), ("C", side), ("D", card)):
        out = out.replace(f"[min(x1), min(y1), max(x2), max(y2)] FILTER_{mark}", agg(when))
    return out.format(points=points, cta=_LIKE("row_text", regions.CTA_PHRASES), compact=_LIKE("txt", regions.COMPACT_WORDS), product=_LIKE("lower(task)", regions.PRODUCT_WORDS))


_OWN = _region_sql("SELECT event_id AS id, event_id, task, px AS qx, py AS qy FROM steps WHERE kind = 'click' AND screen")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.with_region(_boxed(spark, sf_dir).where("action.type = 'click'"), _p(), "region").where("region is not null")
    return s.select("event_id", "region.kind", *[_r(F.col(f"region.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2")], F.col("region_element.index").cast("long").alias("element"))


@query(_OWN + "SELECT id AS event_id, kind, round(a, 6) AS x1, round(b, 6) AS y1, round(c, 6) AS x2, round(d, 6) AS y2, i AS element FROM rg")
def region_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)


def _region_query(name: str, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _regions(spark, sf_dir).where(F.col("kind") == kind).drop("kind")

    run.__name__ = name
    query(_OWN + f"SELECT id AS event_id, round(a, 6) AS x1, round(b, 6) AS y1, round(c, 6) AS x2, round(d, 6) AS y2, i AS element FROM rg WHERE kind = '{kind}'")(run)


for _name, _kind in (("region_search", regions.SEARCH), ("region_cta", regions.CTA), ("region_compact", regions.COMPACT), ("region_card", regions.CARD)):
    _region_query(_name, _kind)

_DECIDED = _NEG + _region_sql("SELECT pair_id || '+' AS id, event_id, task, px AS qx, py AS qy FROM pr WHERE kind = 'click' AND screen UNION ALL SELECT pair_id || '-', event_id, task, rpx, rpy FROM pr WHERE rkind = 'click' AND screen") + """, j AS (
    SELECT pr.*, t.kind AS tk, o.kind AS ok, coalesce(rkind = 'click' AND rpx BETWEEN t.a AND t.c AND rpy BETWEEN t.b AND t.d, FALSE) AS inside,
           CASE WHEN t.a IS NOT NULL AND o.a IS NOT NULL AND least(t.c, o.c) - greatest(t.a, o.a) > 0 AND least(t.d, o.d) - greatest(t.b, o.b) > 0
                THEN (least(t.c, o.c) - greatest(t.a, o.a)) * (least(t.d, o.d) - greatest(t.b, o.b)) / greatest(1.0::DOUBLE, least((t.c - t.a) * (t.d - t.b), (o.c - o.a) * (o.d - o.b))) ELSE 0.0::DOUBLE END AS ov
    FROM pr LEFT JOIN rg t ON t.id = pair_id || '+' LEFT JOIN rg o ON o.id = pair_id || '-'),
  dn AS (
    SELECT *, CASE WHEN rkind = 'swipe' OR kind = 'swipe' THEN 'ambiguous,swipe_or_scroll_uncertain,ambiguous_or_uncertain'
         WHEN rkind <> 'click' AND negative_type = 'wrong_action_type' THEN 'keep,wrong_action_type_non_click,wrong_action_type' WHEN rkind <> 'click' THEN 'ambiguous,non_click_candidate_unchecked,ambiguous_or_uncertain'
         WHEN kind <> 'click' AND negative_type = 'wrong_action_type' THEN 'keep,wrong_action_type_click_instead_of_non_click,wrong_action_type' WHEN kind <> 'click' THEN 'ambiguous,non_click_gt_unchecked,ambiguous_or_uncertain'
         WHEN inside AND tk NOT IN ('full_width_cta_button', 'compact_control_button') THEN 'ambiguous,candidate_inside_low_confidence_target_region,ambiguous_or_uncertain' WHEN inside THEN 'filter,candidate_inside_high_confidence_target_region,negative_construction_error'
         WHEN tk = ok AND ov >= 0.5 AND tk IN ('full_width_cta_button', 'compact_control_button') THEN 'filter,candidate_same_high_confidence_functional_region,negative_construction_error'
         WHEN tk = ok AND ov >= 0.5 AND tk <> 'padded_raw_bbox' THEN 'ambiguous,candidate_same_low_confidence_functional_region,ambiguous_or_uncertain'
         WHEN ok IS NULL THEN 'keep,candidate_no_ui_region,clean_negative' WHEN ok <> 'padded_raw_bbox' OR negative_type IN ('same_screen_element', 'shifted_coordinate') THEN 'keep,candidate_other_ui_or_functional_region,semantic_hard_negative'
         ELSE 'keep,candidate_other_ui_region,clean_negative' END AS said FROM j),
  ds AS (SELECT *, split_part(said, ',', 1) AS decision, split_part(said, ',', 2) AS reason, split_part(said, ',', 3) AS major_category FROM dn)
"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_filter.decided(negatives.preference_pairs(pair_filter.with_target_region(_boxed(spark, sf_dir))))


@query(_DECIDED + "SELECT pair_id, decision, reason, major_category, tk AS target_kind, ok AS candidate_kind FROM ds")
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("pair_id", "decision", "reason", "major_category", F.col("target_region.kind").alias("target_kind"), F.col("candidate_region.kind").alias("candidate_kind"))


@query(_DECIDED + "SELECT pair_id, round(ov, 6) AS region_overlap FROM ds WHERE ov > 0")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).where("region_overlap > 0").select("pair_id", _r(F.col("region_overlap")).alias("region_overlap"))


_DROPS = " UNION ALL ".join(f"SELECT '{name}' AS variant, *, decision NOT IN ({', '.join(repr(d) for d in drops)}) AS kept FROM ds" for name, drops in pair_filter.VARIANTS.items())


@query(_DECIDED + f""", mv AS ({_DROPS}),
  v AS (
    SELECT variant, unnest(['num_pairs', 'kept_decisions', 'kept_major_categories', 'kept_negative_types', 'num_dropped_pairs', 'dropped_decisions', 'dropped_reasons', 'dropped_negative_types', 'dropped_by_negative_type_reason']) AS dim,
           unnest(CASE WHEN kept THEN ['all', decision, major_category, negative_type, NULL, NULL, NULL, NULL, NULL] ELSE [NULL, NULL, NULL, NULL, 'all', decision, reason, negative_type, negative_type || '->' || reason] END) AS value FROM mv)
  SELECT variant, dim, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pairs are counted once for all variants.
    facts = _decided(spark, sf_dir).groupBy("negative_type", "decision", "reason", "major_category").agg(F.count(F.lit(1)).alias("times"))
    out = None
    for name in pair_filter.VARIANTS:
        one = pair_filter.variant_summary(pair_filter.variant(facts, name), "times").withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(_DECIDED + """, v AS (SELECT unnest(['decision', 'reason', 'category', 'negative_type', 'negative_subtype', 'decision_by_type', 'category_by_type', 'reason_by_type', 'decision_by_subtype']) AS dim,
      unnest([decision, reason, major_category, negative_type, subtype, negative_type || '->' || decision, negative_type || '->' || major_category, reason || '->' || negative_type, subtype || '->' || decision]) AS value FROM ds)
  SELECT dim, value, count(*) AS n FROM v GROUP BY ALL""")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_filter.decision_summary(_decided(spark, sf_dir))


def _variant_query(name: str, dropped: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir)
        decisions = _decided(spark, sf_dir).select("pair_id", "decision", F.lit(0).alias("pos"))
        rows = pair_filter.variant(pair_filter.with_decision(pairs.select("pair_id", "negative_type"), decisions), name)
        return rows.groupBy("negative_type", "kept").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.when(F.col("kept"), 2).otherwise(0)).alias("n_scorer_rows"))

    run.__name__ = f"variant_{name}"
    gone = ", ".join(f"'{x}'" for x in dropped)
    query(_DECIDED + f"SELECT negative_type, decision NOT IN ({gone}) AS kept, count(*) AS n_pairs, CAST(sum(CASE WHEN decision NOT IN ({gone}) THEN 2 ELSE 0 END) AS BIGINT) AS n_scorer_rows FROM ds GROUP BY ALL")(run)


for _name, _dropped in pair_filter.VARIANTS.items():
    _variant_query(_name, _dropped)


@query(_DECIDED + "SELECT decision, pair_id, CAST(row_number() OVER (PARTITION BY decision ORDER BY pair_id) AS INTEGER) AS rn FROM ds QUALIFY row_number() OVER (PARTITION BY decision ORDER BY pair_id) <= 20")
def sample_per_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_per_group(_decided(spark, sf_dir).select("decision", "pair_id"), "decision", ["pair_id"], 20)


@query(""", v AS (SELECT DISTINCT event_id, bround6(x1) AS a, bround6(y1) AS b, bround6(x2) AS c, bround6(y2) AS d, ui_type AS label FROM els WHERE valid)
  SELECT event_id, count(*) AS n FROM v GROUP BY event_id""".replace("bround6(", "round_even6("), SQL_STEPS.replace("\n", "\n"))
def boxes_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.distinct_boxes(_boxed(spark, sf_dir).where("boxes is not null"))
    return s.select("event_id", F.size("boxes").cast("long").alias("n")).where("n > 0")


ORACLES["boxes_dedupe"] = f"""WITH {SQL_STEPS}, v AS (
    SELECT DISTINCT event_id, round_even(x1 / 6, 0) AS a, round_even(y1 / 6, 0) AS b, round_even(x2 / 6, 0) AS c, round_even(y2 / 6, 0) AS d, ui_type FROM els WHERE x2 > x1 AND y2 > y1)
  SELECT event_id, count(*) AS n FROM v GROUP BY event_id"""


# Whole screens, and targets the second way.

_SB = f""", sb AS (
    SELECT event_id, i AS pos, greatest(0.0::DOUBLE, least(x1, {WIDTH})) AS x1, greatest(0.0::DOUBLE, least(y1, {HEIGHT})) AS y1, greatest(0.0::DOUBLE, least(x2, {WIDTH})) AS x2, greatest(0.0::DOUBLE, least(y2, {HEIGHT})) AS y2,
           upper(i || ':' || ui_type || CASE WHEN txt <> '' THEN ':' || txt ELSE '' END) AS label, contains(ui_type, 'TEXT') AS texty, CASE WHEN txt <> '' THEN left(txt, 18) ELSE lower(i || ':' || ui_type) END AS t FROM els),
  bx AS (SELECT b.*, x2 - x1 AS w, y2 - y1 AS h, (y1 + y2) / 2 AS cy, lower(task) AS task FROM sb b JOIN steps USING (event_id) WHERE x2 > x1 AND y2 > y1),
  nx AS (
    SELECT b.event_id, b.pos, b.w, b.h, b.cy, o.pos AS opos, o.x1, o.y1, o.x2, o.y2, o.t, o.label, greatest(0.0::DOUBLE, o.x1 - b.x2, b.x1 - o.x2) AS gx, greatest(0.0::DOUBLE, o.y1 - b.y2, b.y1 - o.y2) AS gy,
           abs(o.cy - b.cy) AS dy, least(o.x2, b.x2) - greatest(o.x1, b.x1) AS ov, abs(o.cy - b.cy) <= greatest(20.0::DOUBLE, b.h * 1.5::DOUBLE) OR (o.y2 >= b.y1 AND o.y1 <= b.y2) AS in_row
    FROM bx b JOIN bx o USING (event_id)),
  ax AS (
    SELECT event_id, pos, string_agg(t, ' ' ORDER BY x1, opos) FILTER (in_row) AS rt, SEARCH_ AS se, SIDE_ AS co, CARD_ AS ca FROM nx GROUP BY event_id, pos),
  kx AS (
    SELECT *, CASE WHEN contains(t, 'search') OR contains(label, 'ICON_MAGNIFYING_GLASS') THEN 'search_or_suggestion_row' WHEN {_LIKE("rt", screens.SCREEN_CTA_PHRASES)} OR (contains(rt, 'sign') AND contains(rt, 'check out')) THEN 'full_width_cta_button'
           WHEN {_LIKE("t", regions.COMPACT_WORDS)} THEN 'compact_control_button' WHEN {_LIKE("t", screens.SCREEN_BUTTON_WORDS)} THEN 'button_like' WHEN {_LIKE("task", regions.PRODUCT_WORDS)} AND (texty OR h > 60) THEN 'possible_card_region' ELSE 'padded_raw_bbox' END AS kind
    FROM bx JOIN ax USING (event_id, pos)),
  ux AS (
    SELECT event_id, pos, kind, h, w, CASE kind WHEN 'search_or_suggestion_row' THEN coalesce(se, [x1, y1, x2, y2]) WHEN 'full_width_cta_button' THEN [{WIDTH} * 0.04::DOUBLE, cy, {WIDTH} * 0.96::DOUBLE, cy] WHEN 'compact_control_button' THEN co WHEN 'possible_card_region' THEN ca ELSE [x1, y1, x2, y2] END AS s,
           CASE kind WHEN 'search_or_suggestion_row' THEN [10.0::DOUBLE, greatest(8.0::DOUBLE, h * 0.35::DOUBLE)] WHEN 'full_width_cta_button' THEN [0.0::DOUBLE, greatest(52.0::DOUBLE, h * 2.7::DOUBLE) / 2] WHEN 'compact_control_button' THEN [greatest(24.0::DOUBLE, w * 0.35::DOUBLE), greatest(18.0::DOUBLE, h * 0.95::DOUBLE)]
                WHEN 'button_like' THEN [greatest(24.0::DOUBLE, w * 0.55::DOUBLE), greatest(10.0::DOUBLE, h * 0.65::DOUBLE)] WHEN 'possible_card_region' THEN [10.0::DOUBLE, 10.0::DOUBLE] ELSE [greatest(6.0::DOUBLE, w * 0.12::DOUBLE), greatest(4.0::DOUBLE, h * 0.12::DOUBLE)] END AS p FROM kx),
  cx AS (SELECT event_id, pos, kind, greatest(0.0::DOUBLE, least(s[1] - p[1], {WIDTH})) AS a, greatest(0.0::DOUBLE, least(s[2] - p[2], {HEIGHT})) AS b, greatest(0.0::DOUBLE, least(s[3] + p[1], {WIDTH})) AS c, greatest(0.0::DOUBLE, least(s[4] + p[2], {HEIGHT})) AS d FROM ux),
  rx AS (SELECT event_id, pos, kind, CASE WHEN kind = 'search_or_suggestion_row' THEN greatest(0.0::DOUBLE, a - 8) ELSE a END AS a, b, CASE WHEN kind = 'search_or_suggestion_row' THEN least({WIDTH}::DOUBLE, c + 8) ELSE c END AS c, d FROM cx),
  dx AS (SELECT * FROM rx WHERE c > a AND d > b QUALIFY row_number() OVER (PARTITION BY event_id, kind, round_even(a / 6, 0), round_even(b / 6, 0), round_even(c / 6, 0), round_even(d / 6, 0) ORDER BY pos) = 1)
"""


def _sides(when: str) -> str:
    return f"CASE WHEN count(*) FILTER ({when}) > 0 THEN [min(x1) FILTER ({when}), min(y1) FILTER ({when}), max(x2) FILTER ({when}), max(y2) FILTER ({when})] END"


_SEARCHISH = "contains(t, 'search') OR " + _LIKE("label", regions.SEARCH_ICONS)
_SB = _SB.replace("SEARCH_ AS", _sides(f"in_row AND ({_SEARCHISH}) AND gx <= greatest(70.0::DOUBLE, w * 2.5::DOUBLE) AND dy <= greatest(28.0::DOUBLE, h * 2.0::DOUBLE)") + " AS")
_SB = _SB.replace("SIDE_ AS", _sides("in_row AND gx <= greatest(48.0::DOUBLE, w * 2.2::DOUBLE)") + " AS")
_SB = _SB.replace("CARD_ AS", _sides(f"gy <= greatest(120.0::DOUBLE, h * 3.0::DOUBLE) AND ov > {WIDTH} * -0.20::DOUBLE") + " AS")


@query(_SB + "SELECT event_id, pos, kind, round(a, 6) AS x1, round(b, 6) AS y1, round(c, 6) AS x2, round(d, 6) AS y2 FROM dx")
def screen_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = screens.with_screen_regions(steps(spark, sf_dir)).select("event_id", F.explode("screen_regions").alias("r"))
    return s.select("event_id", F.col("r.pos").cast("long").alias("pos"), "r.kind", *[_r(F.col(f"r.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2")])


_TA = _OWN + f""", na AS (
    SELECT t.id, e.x1, e.y1, e.x2, e.y2, e.ui_type, t.h, t.w, abs((e.y1 + e.y2) / 2 - t.cy) AS dy, e.y2 >= t.y1 AND e.y1 <= t.y2 AS over, greatest(0.0::DOUBLE, e.y1 - t.y2, t.y1 - e.y2) AS gy, least(e.x2, t.x2) - greatest(e.x1, t.x1) AS ov
    FROM tg t JOIN els e ON t.event_id = e.event_id AND valid),
  aa AS (SELECT id, bool_or(ui_type = 'ICON_MAGNIFYING_GLASS' AND (over OR dy <= greatest(20.0::DOUBLE, h * 1.4::DOUBLE))) AS icon, ROW_ AS ro, CARD_ AS ca FROM na GROUP BY id),
  ka AS (
    SELECT t.*, ro, ca, CASE WHEN contains(txt, 'search') OR (contains(lower(task), 'search') AND y1 < {HEIGHT} * 0.35::DOUBLE) OR icon THEN 'search_or_suggestion_row' WHEN {_LIKE("txt", screens.TARGET_BUTTON_WORDS)} THEN 'button_like'
           WHEN {_LIKE("lower(task)", regions.PRODUCT_WORDS)} AND (ui_type = 'TEXT' OR h > 60) THEN 'possible_card_region' ELSE 'padded_bbox' END AS kind FROM tg t JOIN aa USING (id)),
  ua AS (
    SELECT id, kind, ro IS NULL AS alone, CASE kind WHEN 'search_or_suggestion_row' THEN coalesce(ro, [x1, y1, x2, y2]) WHEN 'possible_card_region' THEN ca ELSE [x1, y1, x2, y2] END AS s,
           CASE kind WHEN 'search_or_suggestion_row' THEN CASE WHEN ro IS NULL THEN [w * 3.0::DOUBLE, h * 0.7::DOUBLE] ELSE [12.0::DOUBLE, greatest(8.0::DOUBLE, h * 0.4::DOUBLE)] END WHEN 'button_like' THEN [greatest(24.0::DOUBLE, w * 0.55::DOUBLE), greatest(10.0::DOUBLE, h * 0.65::DOUBLE)]
                WHEN 'possible_card_region' THEN [12.0::DOUBLE, 12.0::DOUBLE] ELSE [greatest(12.0::DOUBLE, w * 0.35::DOUBLE), greatest(8.0::DOUBLE, h * 0.35::DOUBLE)] END AS p FROM ka),
  ba AS (SELECT id, kind, alone, greatest(0.0::DOUBLE, least(s[1] - p[1], {WIDTH})) AS a, greatest(0.0::DOUBLE, least(s[2] - p[2], {HEIGHT})) AS b, greatest(0.0::DOUBLE, least(s[3] + p[1], {WIDTH})) AS c, greatest(0.0::DOUBLE, least(s[4] + p[2], {HEIGHT})) AS d FROM ua)
""".replace("ROW_ AS", _sides("(over OR dy <= greatest(24.0::DOUBLE, h * 1.6::DOUBLE)) AND x2 - x1 > 2 AND y2 - y1 > 2") + " AS").replace("CARD_ AS", _sides(f"gy <= greatest(120.0::DOUBLE, h * 3.0::DOUBLE) AND ov > {WIDTH} * -0.20::DOUBLE") + " AS")


@query(_TA + f"""SELECT id AS event_id, kind, round(CASE WHEN kind = 'search_or_suggestion_row' AND NOT alone THEN 0 ELSE a END, 6) AS x1, round(b, 6) AS y1,
  round(CASE WHEN kind = 'search_or_suggestion_row' AND NOT alone THEN greatest(c, {WIDTH} * 0.75::DOUBLE) ELSE c END, 6) AS x2, round(d, 6) AS y2 FROM ba""")
def target_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = screens.with_target_area(_boxed(spark, sf_dir).where("action.type = 'click'"), _p(), "area").where("area is not null")
    return s.select("event_id", "area.kind", *[_r(F.col(f"area.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2")])


# Predictions.

_OK = ", p AS (SELECT *, label = prediction_label AS ok FROM preds)"


@query(_OK + """, v AS (SELECT ok, unnest(['all', 'label', 'action_type', 'negative_type', 'negative_subtype']) AS dim, unnest(['all', label, action_type, CASE WHEN label = 'No' THEN negative_type END, CASE WHEN label = 'No' THEN negative_subtype END]) AS value FROM p)
  SELECT dim, value, count(*) AS total, CAST(sum(ok::INT) AS BIGINT) AS correct, sum(ok::INT) / count(*) AS accuracy FROM v WHERE value IS NOT NULL GROUP BY ALL""", SQL_PREDICTIONS)
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("label") == "No"
    sub = errors.subtype(F.col("negative_subtype"), F.col("negative_source"))
    return profile.prediction_metrics(predictions(spark, sf_dir), {"all": F.lit("all"), "label": F.col("label"), "action_type": F.col("action_type"), "negative_type": F.when(no, F.col("negative_type")), "negative_subtype": F.when(no, sub)})


@query("SELECT label || '->' || prediction_label AS confusion, count(*) AS n FROM preds GROUP BY ALL", SQL_PREDICTIONS)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy(F.concat_ws("->", "label", "prediction_label").alias("confusion")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sample_id, negative_type, negative_subtype FROM preds WHERE label = 'No' AND prediction_label = 'Yes'", SQL_PREDICTIONS)
def error_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.errors(predictions(spark, sf_dir), "No->Yes").select("sample_id", "negative_type", errors.subtype(F.col("negative_subtype"), F.col("negative_source")).alias("negative_subtype"))


@query("""SELECT negative_type, avg((label = prediction_label)::INT) FILTER (sample_id % 2 = 0) AS a, avg((label = prediction_label)::INT) FILTER (sample_id % 2 = 1) AS b FROM preds GROUP BY negative_type""", SQL_PREDICTIONS)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumns({"run": F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b"), "correct": F.col("label") == F.col("prediction_label")})
    return profile.run_comparison(rows, ["a", "b"], "negative_type")


# Every ninth step's pairs are judged wrongly; so SQL needs only those, and says all the same.
_WRONG_STEPS = SQL_STEPS.replace("    steps AS (", "    all_steps AS (").replace("    els AS (", "    steps AS (SELECT * FROM all_steps WHERE event_id % 9 = 0),\n    els AS (").replace("range(7) r(i) WHERE event_id % 50 <> 0", "range(7) r(i) WHERE event_id % 50 <> 0 AND event_id % 9 = 0")
_WRONG = """, wr AS (SELECT * FROM fb)
"""


def _wrong(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The wrong ones of predictions on all rejected actions, and the pairs; one in eleven has lost its pair."""
    pairs = _pairs(spark, sf_dir)
    rows = pairs.select(
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("lost:"), "pair_id")).otherwise(F.col("pair_id")).alias("pair_id"), F.concat("pair_id", F.lit(":rejected")).alias("sample_id"),
        F.lit("No").alias("label"), F.when(F.col("event_id") % 9 == 0, "Yes").otherwise("No").alias("prediction_label"), F.lit(None).cast("boolean").alias("correct"), F.col("task").alias("instruction"), "negative_type", "negative_subtype", "negative_source",
        F.col("rejected").alias("candidate_action"), F.col("screenshot_before").alias("image"),
    )
    return errors.errors(rows), pairs.withColumn("pos", F.lit(0))


@query(_NEG + _FACTS + _WRONG + """SELECT pair_id || ':rejected' AS sample_id, CASE WHEN event_id % 11 <> 0 THEN ri IS NOT NULL END AS candidate_in_ui_element, CASE WHEN event_id % 11 <> 0 THEN same_element END AS same_element_as_gt,
    CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE bucket END AS distance_bucket, CASE WHEN event_id % 11 <> 0 THEN round(dist, 6) END AS distance_px FROM wr""", _WRONG_STEPS)
def error_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = errors.enriched(*_wrong(spark, sf_dir))
    return out.select("sample_id", "candidate_in_ui_element", "same_element_as_gt", "distance_bucket", _r(F.col("distance_px")).alias("distance_px"))


_LOST = "event_id % 11 = 0"
_CASES = f"""SELECT CAST(row_number() OVER (ORDER BY pair_id || ':rejected') AS INTEGER) AS case_index, '' AS review_label, '' AS notes, 'No' AS label, 'Yes' AS prediction, negative_type,
    subtype AS negative_subtype, rkind AS candidate_action_type, CASE WHEN {_LOST} THEN 'unknown' ELSE bucket END AS distance_bucket, CASE WHEN {_LOST} THEN '' WHEN ri IS NULL THEN 'false' ELSE 'true' END AS candidate_in_ui_element,
    CASE WHEN {_LOST} THEN '' WHEN same_element THEN 'true' ELSE 'false' END AS same_element_as_gt, CASE WHEN length(trim(task)) > 300 THEN substr(trim(task), 1, 297) || '...' ELSE trim(task) END AS instruction,
    CASE WHEN {_LOST} THEN '' WHEN length({_TEXT}) > 260 THEN substr({_TEXT}, 1, 257) || '...' ELSE {_TEXT} END AS gt_action_text, coalesce(image, '') AS image, pair_id || ':rejected' AS sample_id, CASE WHEN {_LOST} THEN 'lost:' ELSE '' END || pair_id AS pair_id,
    CASE WHEN {_LOST} OR ri IS NULL THEN '' ELSE {sql_list(ELEMENT_TYPES)}[1 + (event_id + ri) % 5] END AS candidate_element_type, CASE WHEN {_LOST} OR gi IS NULL THEN '' ELSE {sql_list(ELEMENT_TEXTS)}[1 + (event_id + gi * 3) % 10] END AS gt_element_text FROM wr"""
_LEFT_OUT = ("suggested_labels", "distance_px", "candidate_action_text", "candidate_element_text", "gt_element_type", "candidate_action_json", "gt_action_json")


@query(_NEG + _FACTS + _WRONG + _CASES, _WRONG_STEPS)
def badcase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows, but for columns of numbers as text."""
    return errors.review_rows(errors.enriched(*_wrong(spark, sf_dir)), ["sample_id"]).drop(*_LEFT_OUT)


@query(_NEG + _FACTS + _WRONG + "SELECT CAST(row_number() OVER (ORDER BY pair_id || ':rejected') AS INTEGER) AS case_index, pair_id || ':rejected' AS sample_id FROM wr WHERE subtype = 'near_miss_non_ui_shift' AND rkind = 'click'", _WRONG_STEPS)
def badcase_rows_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong, _ = _wrong(spark, sf_dir)
    return errors.review_rows(wrong, ["sample_id"], "near_miss_non_ui_shift", "click").select("case_index", "sample_id")


_SUMMED = f"""candidate_action_type', 'distance_bucket', 'candidate_in_ui_element', 'same_element_as_gt']) AS dim,
    unnest([{{0}}, negative_type, subtype, rkind, CASE WHEN {_LOST} THEN 'unknown' ELSE bucket END, CASE WHEN {_LOST} THEN 'unknown' WHEN ri IS NULL THEN 'false' ELSE 'true' END,
            CASE WHEN {_LOST} THEN 'unknown' WHEN same_element THEN 'true' ELSE 'false' END]) AS value FROM wr)
  SELECT dim, value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'instruction', task, count(*) FROM wr GROUP BY task ORDER BY count(*) DESC, task LIMIT 20)"""


@query(_NEG + _FACTS + _WRONG + ", v AS (SELECT unnest(['error', 'negative_type', 'negative_subtype', '" + _SUMMED.format("'No->Yes'"), _WRONG_STEPS)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_summary(errors.enriched(*_wrong(spark, sf_dir)))


@query(_NEG + _FACTS + _WRONG + ", v AS (SELECT unnest(['all', 'negative_type', 'negative_subtype', '" + _SUMMED.format("'all'"), _WRONG_STEPS)
def badcase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.badcase_summary(errors.enriched(*_wrong(spark, sf_dir)))


@query("""SELECT event_id, CASE kind WHEN 'click' THEN 1 WHEN 'swipe' THEN 2 ELSE 0 END AS n,
    CASE WHEN x IS NOT NULL THEN format('left: {:.3f}%; top: {:.3f}%;', greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)) * 100, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y)) * 100) END AS first_style FROM steps""")
def action_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir, texts=False).select("event_id", errors.action_markers(F.col("action")).alias("m"))
    return s.select("event_id", F.size("m").alias("n"), F.get("m", F.lit(0))["style"].alias("first_style"))


@query("""SELECT doc_id % 5 AS run_id, count(*) AS num_samples, round(avg((label = prediction_label)::INT), 9) AS accuracy, count(*) FILTER (label = 'No' AND prediction_label = 'Yes') AS false_positive_no_to_yes
    FROM (SELECT sample_id AS doc_id, label, prediction_label FROM preds) GROUP BY ALL""", SQL_PREDICTIONS)
def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs' reports as JSON, looked up again."""
    p = predictions(spark, sf_dir).withColumn("run", (F.col("sample_id") % 5).cast("string"))
    right = F.avg((F.col("label") == F.col("prediction_label")).cast("int"))
    wrong = F.count_if((F.col("label") == "No") & (F.col("prediction_label") == "Yes"))
    r = p.groupBy("run").agg(F.count(F.lit(1)).alias("num_samples"), right.alias("accuracy"), F.create_map(F.lit("No->Yes"), wrong).alias("confusion"))
    r = r.select("run", F.parse_json(F.to_json(F.struct("num_samples", "accuracy", "confusion"))).alias("report"))
    out = profile.run_figures(r)
    return out.select(F.col("run").cast("long").alias("run_id"), "num_samples", _r(F.col("accuracy"), 9).alias("accuracy"), "false_positive_no_to_yes")


# Metrics.

_LISTS = """g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
  l AS (SELECT user_id, list(event_type ORDER BY n DESC, event_type) AS ranked FROM g GROUP BY user_id),
  o AS (SELECT user_id, event_type AS gold FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
  r AS (SELECT ranked, gold FROM l JOIN o USING (user_id))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    counts = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))).alias("ranked"))
    gold = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("gold"))
    return metrics.zipped(lists.select("user_id", F.transform("ranked", lambda x: x["event_type"]).alias("ranked")), gold, "user_id")


@query("SELECT avg((ranked[1] = gold)::INT) AS top1, avg(list_contains(ranked[1:2], gold)::INT) AS top2, avg(list_contains(ranked[1:3], gold)::INT) AS top3 FROM r", _LISTS)
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).agg(*[metrics.top_k_accuracy(F.col("ranked"), F.col("gold"), k).alias(f"top{k}") for k in (1, 2, 3)])


@query("SELECT round(avg(coalesce(1.0::DOUBLE / nullif(list_position(ranked, gold), 0), 0)), 9) AS mrr FROM r", _LISTS)
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).agg(_r(metrics.mean_reciprocal_rank(F.col("ranked"), F.col("gold")), 9).alias("mrr"))


@query("SELECT avg((value > (event_id * 7) % 500)::INT) AS accuracy FROM events", "u AS (SELECT 1)")
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(metrics.pairwise_accuracy(F.col("value"), ((F.col("event_id") * 7) % 500).cast("double")).alias("accuracy"))


@query("SELECT kind, avg((event_id % 4 = 0 AND coalesce(px BETWEEN (event_id * 11) % 800 AND (event_id * 11) % 800 + 200 AND py BETWEEN (event_id * 19) % 1800 AND (event_id * 19) % 1800 + 300, FALSE))::INT) AS accuracy FROM steps GROUP BY kind")
def click_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir, texts=False).groupBy(F.col("action.type").alias("kind")).agg(metrics.click_accuracy(_p(), F.col("target_bbox")).alias("accuracy"))


@query("""SELECT avg((d <= 50)::INT) AS within_50, avg((d <= 300)::INT) AS within_300, round(avg(round(d / sqrt(1080.0::DOUBLE * 1080 + 2400.0::DOUBLE * 2400), 9)), 6) AS mean_error
    FROM (SELECT sqrt((px - (event_id * 11) % 800) * (px - (event_id * 11) % 800) + (py - (event_id * 19) % 1800) * (py - (event_id * 19) % 1800)) AS d FROM steps WHERE px IS NOT NULL AND event_id % 4 = 0)""")
def distance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir, texts=False).withColumn("p", _p()).where("p is not null and target_bbox is not null")
    corner = G.point(F.col("target_bbox.x1"), F.col("target_bbox.y1"))
    return s.agg(metrics.distance_accuracy(F.col("p"), corner).alias("within_50"), metrics.distance_accuracy(F.col("p"), corner, 300.0).alias("within_300"), _r(F.avg(F.round(metrics.coordinate_error(F.col("p"), corner, F.col("screen_size")), 9))).alias("mean_error"))


FLAGSHIP = audit_by_action
