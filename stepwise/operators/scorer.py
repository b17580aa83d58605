"""Pairs as labelled scorer rows; prompts, messages, answers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.text import action_text, identity, prompt
from stepwise.operators.profile import histograms

# Fixed value: the question of a prompt.
QUESTION = "Is this candidate action correct for the instruction and screenshot?"


def scorer_rows(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair: the chosen action with Yes, the rejected one with No.  No shuffle."""
    both = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("action"), F.lit("Yes").alias("label"), F.lit(1).alias("label_id")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("action"), F.lit("No").alias("label"), F.lit(0).alias("label_id")),
    )
    df = pairs.withColumn("_s", F.explode(both))
    return df.select(
        "pair_id", "episode_id", "step_id", F.col("screenshot_before").alias("image"), F.col("task").alias("instruction"), "screen_size", "negative_type", "negative_source", "negative_subtype",
        F.concat_ws(":", "pair_id", "_s.side").alias("sample_id"), F.col("_s.action").alias("candidate_action"), action_text(F.col("_s.action")).alias("candidate_action_text"),
        F.col("_s.label").alias("label"), F.col("_s.label_id").alias("label_id"),
    )


def with_prompt(rows: DataFrame, question: str = QUESTION) -> DataFrame:
    return rows.withColumn("prompt", prompt(F.col("instruction"), F.col("candidate_action_text"), question))


def messages(system: str, text: Column, image: Column, reply: Column | None = None) -> Column:
    """Chat messages as JSON: system, user (image and text) and, with ``reply``, the assistant."""
    part = "array<struct<type:string,text:string,image:string>>"
    say = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).cast(part).alias("content"))
    words = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("string").alias("image"))
    picture = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image"))
    out = [say("system", words(F.lit(system))), say("user", picture, words(text))]
    return F.to_json(F.array(*out, *([say("assistant", words(reply))] if reply is not None else [])))


def resolved(path: Column, root: str) -> Column:
    """An image's path below ``root``, unless it is absolute; null without one."""
    return F.when(path.startswith("/"), path).when(path != "", F.concat(F.lit(root.rstrip("/") + "/"), path))


def needed_image(path: Column, root: str) -> Column:
    """The path of an image that has to be there: below ``root`` unless it is absolute (the root itself if blank); null raises."""
    missing = F.raise_error("a row has no image").cast("string")
    root = root.rstrip("/")
    return F.when(path.isNull(), missing).when(path.startswith("/"), path).when(path == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), path))


def scorer_summary(rows: DataFrame) -> DataFrame:
    """Counts over all scorer rows, in one row."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == "Yes").alias("n_yes"),
        F.count_if(F.col("label") == "No").alias("n_no"),
        F.count_distinct(identity(F.lower(F.trim(F.coalesce("instruction", F.lit("")))))).alias("n_instructions"),
        F.count_distinct("episode_id").alias("n_episodes"),
        F.count("image").alias("n_images"),
    )


def missing_images(rows: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Image paths of ``rows`` that ``files`` (path) lacks, with the number of rows that name them (n)."""
    paths = rows.select(resolved(F.col("image"), root).alias("path")).where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return paths.join(files.select("path"), "path", "left_anti")


def scorer_histograms(rows: DataFrame) -> DataFrame:
    """(dim, value, n) of scorer rows: labels, negative types of those labelled No, candidate action types."""
    no = F.col("label") == "No"
    return histograms(rows, {
        "label": F.coalesce("label", F.lit("")),
        "negative_type": F.when(no, F.coalesce("negative_type", F.lit(""))),
        "candidate_action_type": F.coalesce(F.col("candidate_action.type"), F.lit("unknown")),
    })
