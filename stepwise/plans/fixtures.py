"""Steps, predictions and raw records derived from the synthetic tables; the SQL says the same for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwise.functions.geometry import box, once, point
from stepwise.functions.maps import entries
from stepwise.sources.episodes import ACTION

EVENT_TYPES = {"click": "click", "view": "swipe", "signup": "type", "purchase": "finish", "error": "back"}
WIDTH, HEIGHT = 1080, 2400
TASK_WORDS = ("search ", "add item to cart ", "open settings ", "amazon result ", "")
ELEMENT_TEXTS = ("Search", "Add to cart", "Sign", "in to check out", "Filter", "Best Match", "$ 12", "", "Home", "Sort by")
#: Documents whose texts a task joins, about: few enough for one Parquet dictionary, so that rows of one text are written with one copy of it.
TASK_TEXTS = 200
#: Tasks for each of the session's shuffle partitions, at most, unless the texts that events have need more.
MORE_TASKS = 16
ELEMENT_TYPES = ("TEXT", "ICON_MAGNIFYING_GLASS", "TEXT", "BUTTON", "ICON_MIC")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Narrow rows dealt to as many tasks as shuffles have, before they become wide; to ``least`` tasks, if that is more.

    What a row becomes is long work for its bytes: input splits, and partitions
    that adaptive execution merges by their bytes, leave cores idle.
    """
    return rows.repartition(max(_shuffle_tasks(rows), least), *keys)


def _shuffle_tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _text_tasks(events: DataFrame, docs: DataFrame) -> int:
    """Tasks of TASK_TEXTS documents each; where these are out of proportion to a shuffle's, of as many texts as there are users, if that takes more."""
    of = lambda texts: -(-texts // TASK_TEXTS)
    whole, most = of(docs.count()), MORE_TASKS * _shuffle_tasks(docs)
    if whole <= most:
        return whole
    users = events.agg(F.approx_count_distinct("user_id")).first()[0]
    return max(most, min(whole, of(users)))


def _ascii(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^ -~]", "?")


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def steps(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """One step for each event, with its event_id; ``texts``: tasks are documents' texts, typed texts the names of parts (some many times over)."""
    e = F.col("event_id")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    df = events.withColumn("step_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int"))
    df = df.withColumn("kind", F.create_map(*[F.lit(x) for p in EVENT_TYPES.items() for x in p])[F.col("event_type")])
    if texts:
        docs = read(spark, sf_dir, "documents")
        n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
        df = df.join(F.broadcast(n))  # one row
        parts = read(spark, sf_dir, "part")
        df = df.join(F.broadcast(parts.agg(F.count(F.lit(1)).alias("n_parts"))))  # one row
        df = df.withColumns({"_t": e % F.col("n_parts") + 1, "_u": F.col("user_id") % F.col("n_docs")})
        df = df.join(parts.select(F.col("p_partkey").alias("_t"), F.col("p_name").alias("_typed")), "_t", "left")
        df = df.withColumn("_typed", F.when(e % 13 == 0, F.repeat("_typed", 30)).otherwise(F.col("_typed")))
        df = spread(df, "_u", least=_text_tasks(events, docs)).join(docs.select(F.col("doc_id").alias("_u"), _ascii(F.col("text")).alias("_task")), "_u", "left")
        task = F.concat(_pick(TASK_WORDS, F.col("user_id") % 5), F.coalesce("_task", F.lit("")))
        typed = F.when(F.col("kind") == "type", F.when(e % 11 == 0, "").otherwise(F.coalesce("_typed", F.lit(""))))
    else:
        task, typed = _pick(TASK_WORDS, F.col("user_id") % 5), F.when(F.col("kind") == "type", F.when(e % 11 == 0, "").otherwise("text"))
        df = spread(df, "user_id")
    turn = e % 3
    space = F.when(turn == 0, "pixel").when(turn == 1, "normalized_1000").otherwise("normalized_1")

    def at(a: int, b: int) -> Column:
        x, y = F.when(turn == 0, (e * a) % 1100).otherwise((e * a) % 1050), F.when(turn == 0, (e * b) % 2500).otherwise((e * b) % 1040)
        return F.when(turn == 2, point(x / 1000.0, y / 1000.0)).otherwise(point(x, y))

    screen = F.when(e % 50 != 0, F.struct(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")))
    kind = F.col("kind")
    action = F.struct(
        kind.alias("type"), F.when(kind == "click", at(7919, 104729)).alias("point"), F.when(kind == "swipe", at(7919, 104729)).alias("start_point"), F.when(kind == "swipe", at(6007, 9973)).alias("end_point"),
        typed.alias("text"), F.lit(None).cast("string").alias("direction"), space.alias("coordinate_space"),
        entries(device="d").alias("metadata"),
    )

    def element(i: Column) -> Column:
        x, y = (e * 13 + i * 151) % 900, (e * 17 + i * 337) % 2000
        w = F.when((e % 37 == 0) & (i == 3), 0).otherwise(40 + (e + i * 53) % 600)
        h = 20 + (e * 3 + i * 71) % 500
        return F.struct(box(x, y, x + w, y + h, F.when(i == 6, "normalized_1000").otherwise("pixel")).alias("bbox"), _pick(ELEMENT_TEXTS, (e + i * 3) % 10).alias("text"), _pick(ELEMENT_TYPES, (e + i) % 5).alias("ui_type"), i.alias("index"))

    target = F.when(e % 4 == 0, box((e * 11) % 800, (e * 19) % 1800, (e * 11) % 800 + 200, (e * 19) % 1800 + 300))
    # The task stands by itself: who uses none reads no document's text.
    df = once(df.withColumn("task", task), action=action, target_bbox=target, screen_size=screen)
    hard = (F.col("value") / 500).cast("string")
    told = F.when(turn == 0, entries(difficulty_score=hard)).when(turn == 1, entries(model_error_rate=hard)).otherwise(entries())
    return df.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("episode_id"), "step_id", "task",
        F.when(e % 7 != 0, F.concat(F.lit("shots/"), e.cast("string"), F.lit(".png"))).alias("screenshot_before"), "screen_size", "action",
        "target_bbox", F.array(*[element(F.lit(i)) for i in range(7)]).alias("ui_elements"),
        F.array().cast(f"array<{ACTION}>").alias("history"), told.alias("metadata"),
    )


_S = "e.event_id"


def _sql_at(a: int, b: int) -> tuple[str, str]:
    x = f"CASE {_S} % 3 WHEN 0 THEN CAST(({_S} * {a}) % 1100 AS DOUBLE) WHEN 1 THEN CAST(({_S} * {a}) % 1050 AS DOUBLE) ELSE (({_S} * {a}) % 1050) / 1000.0::DOUBLE END"
    y = f"CASE {_S} % 3 WHEN 0 THEN CAST(({_S} * {b}) % 2500 AS DOUBLE) WHEN 1 THEN CAST(({_S} * {b}) % 1040 AS DOUBLE) ELSE (({_S} * {b}) % 1040) / 1000.0::DOUBLE END"
    return x, y


_X, _Y = _sql_at(7919, 104729)
_EX, _EY = _sql_at(6007, 9973)
sql_list = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"

#: Common table expressions for the other engine: steps (flat: x, y the primary point, px, py in pixels) and els (an element a row, in pixels).
SQL_STEPS = f"""
    nd AS (SELECT count(*) AS n FROM documents),
    np AS (SELECT count(*) AS m FROM part),
    heads AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS head FROM documents),
    k AS (
        SELECT e.*, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'swipe' WHEN 'signup' THEN 'type' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'back' END AS kind,
               CASE {_S} % 3 WHEN 0 THEN 'pixel' WHEN 1 THEN 'normalized_1000' ELSE 'normalized_1' END AS space,
               {_X} AS rx, {_Y} AS ry, {_EX} AS rex, {_EY} AS rey FROM events e),
    steps AS (
        SELECT k.event_id, 'u' || user_id AS episode_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_id,
               {sql_list(TASK_WORDS)}[1 + user_id % 5] || coalesce(u.head, '') AS task, kind, space, event_id % 50 <> 0 AS screen,
               CASE WHEN kind = 'type' THEN CASE WHEN event_id % 11 = 0 THEN '' ELSE coalesce(CASE WHEN event_id % 13 = 0 THEN repeat(t.p_name, 30) ELSE t.p_name END, '') END END AS typed,
               CASE WHEN kind IN ('click', 'swipe') THEN rx END AS x, CASE WHEN kind IN ('click', 'swipe') THEN ry END AS y,
               CASE WHEN kind = 'swipe' THEN rex END AS ex, CASE WHEN kind = 'swipe' THEN rey END AS ey,
               CASE WHEN event_id % 50 <> 0 AND kind IN ('click', 'swipe') THEN CASE space WHEN 'pixel' THEN rx WHEN 'normalized_1000' THEN rx / 1000 * {WIDTH} ELSE rx / 1 * {WIDTH} END END AS px,
               CASE WHEN event_id % 50 <> 0 AND kind IN ('click', 'swipe') THEN CASE space WHEN 'pixel' THEN ry WHEN 'normalized_1000' THEN ry / 1000 * {HEIGHT} ELSE ry / 1 * {HEIGHT} END END AS py,
               CASE WHEN event_id % 7 <> 0 THEN 'shots/' || event_id || '.png' END AS image, CASE WHEN event_id % 3 < 2 THEN value / 500 END AS difficulty
        FROM k CROSS JOIN nd CROSS JOIN np LEFT JOIN part t ON t.p_partkey = event_id % m + 1 LEFT JOIN heads u ON u.doc_id = user_id % n),
    els AS (
        SELECT event_id, i, x1, y1, x2, y2, w > 0 AS valid, lower(trim(txt)) AS txt, ui_type
        FROM (SELECT event_id, i, w, CASE WHEN i = 6 THEN a / 1000 * {WIDTH} ELSE a END AS x1, CASE WHEN i = 6 THEN b / 1000 * {HEIGHT} ELSE b END AS y1,
                     CASE WHEN i = 6 THEN (a + w) / 1000 * {WIDTH} ELSE a + w END AS x2, CASE WHEN i = 6 THEN (b + h) / 1000 * {HEIGHT} ELSE b + h END AS y2,
                     {sql_list(ELEMENT_TEXTS)}[1 + (event_id + i * 3) % 10] AS txt, {sql_list(ELEMENT_TYPES)}[1 + (event_id + i) % 5] AS ui_type
              FROM (SELECT event_id, i, CAST((event_id * 13 + i * 151) % 900 AS DOUBLE) AS a, CAST((event_id * 17 + i * 337) % 2000 AS DOUBLE) AS b,
                           CASE WHEN event_id % 37 = 0 AND i = 3 THEN 0 ELSE 40 + (event_id + i * 53) % 600 END AS w, 20 + (event_id * 3 + i * 71) % 500 AS h
                    FROM events, range(7) r(i) WHERE event_id % 50 <> 0)))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers derived from documents and labels: wrong by a rule, with a type and a subtype."""
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    label = F.when(F.col("quality") == 1, "Yes").otherwise("No")
    flipped = F.when(F.col("quality") == 1, "No").otherwise("Yes")
    return rows.select(
        d.alias("sample_id"), label.alias("label"), F.when(d % 41 == 0, "Unknown").when(d % 7 == 0, flipped).otherwise(label).alias("prediction_label"),
        F.coalesce("source", F.lit("unknown")).alias("negative_type"), F.col("lang").alias("negative_subtype"), F.lit(None).cast("string").alias("negative_source"),
        _pick(("click", "swipe", "type"), d % 3).alias("action_type"), F.when(d % 5 != 0, d % 41 != 0).otherwise(F.lit(None)).alias("_given"),
    ).withColumn("correct", F.when(F.col("_given").isNotNull(), F.col("label") == F.col("prediction_label"))).drop("_given")


SQL_PREDICTIONS = """
    lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    preds AS (
        SELECT doc_id AS sample_id, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS label,
               CASE WHEN doc_id % 41 = 0 THEN 'Unknown' WHEN doc_id % 7 = 0 THEN CASE WHEN quality = 1 THEN 'No' ELSE 'Yes' END WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS prediction_label,
               coalesce(source, 'unknown') AS negative_type, coalesce(nullif(lang, ''), 'unknown') AS negative_subtype, ['click', 'swipe', 'type'][1 + doc_id % 3] AS action_type
        FROM lab JOIN documents USING (doc_id))"""
