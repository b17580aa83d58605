"""Parts that no query of the catalogue runs, on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from stepwise.functions import geometry as G
from stepwise.operators import profile, rewards, scorer
from stepwise.sources import episodes, jsonl

ACTION = episodes.ACTION


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_messages_are_chat_turns(spark):
    row = one(spark, asked=scorer.messages("be brief", F.lit("is it right?"), F.lit("a.png")), told=scorer.messages("be brief", F.lit("is it right?"), F.lit("a.png"), F.lit("Yes")))
    system = {"role": "system", "content": [{"type": "text", "text": "be brief"}]}
    user = {"role": "user", "content": [{"type": "image", "image": "a.png"}, {"type": "text", "text": "is it right?"}]}
    assert json.loads(row["asked"]) == [system, user]
    assert json.loads(row["told"]) == [system, user, {"role": "assistant", "content": [{"type": "text", "text": "Yes"}]}]


def test_ranked_lists_follow_scores_then_input(spark):
    rows = [("s1", 0, "a", 0.5), ("s1", 1, "b", 0.9), ("s1", 2, "c", 0.5), ("s2", 0, "d", None), ("s2", 1, "e", 0.1)]
    df = spark.createDataFrame(rows, "step string, pos int, name string, score double")
    got = {r["step"]: [(x["name"], x["score"]) for x in r["ranked"]] for r in rewards.ranked_lists(df, ["step"], ["name"]).collect()}
    assert got["s1"] == [("b", 0.9), ("a", 0.5), ("c", 0.5)] and {n for n, _ in got["s2"]} == {"d", "e"}


def test_margins_of_components(spark):
    rows = [("x", 1.0, 0.5, 0.2), ("x", 0.5, 0.5, 0.4), ("y", 0.2, 0.6, None)]
    df = spark.createDataFrame(rows, "kind string, c double, r double, d double")
    got = {r["kind"]: r for r in rewards.pair_report(df, "c", "r", ["kind"], {"text": F.col("d")}).collect()}
    assert (got["x"]["n"], got["x"]["win_rate"], got["x"]["tie_rate"]) == (2, 0.5, 0.5) and got["x"]["margin_text"] == pytest.approx(0.3)
    assert got["y"]["margin_text"] is None and got[None]["mean_margin"] == pytest.approx(0.1 / 3)


def test_presets_weigh_their_own_components(spark):
    click = lambda x: F.struct(F.lit("click").alias("type"), G.point(F.lit(x), F.lit(0.0)).alias("point"), *[F.lit(None).cast(t).alias(k) for k, t in (("start_point", episodes.POINT), ("end_point", episodes.POINT), ("text", "string"), ("direction", "string"))], F.lit("pixel").alias("coordinate_space"))
    screen = F.struct(F.lit(100).alias("width"), F.lit(100).alias("height"))
    box = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double,coordinate_space:string>")
    row = one(spark, **{k: rewards.preset(k, click(80.0), click(0.0), screen, box, F.lit(0.5)) for k in rewards.PRESETS})
    near = 2.718281828459045**-1
    assert row["grounding"]["total"] == pytest.approx((0.25 + near) / 1.25) and row["grounding"]["components"].asDict().keys() == {"format", "coordinate"}
    assert row["action_prediction"]["total"] == pytest.approx((0.5 + 1 + near + 1) / 3.5)
    assert row["full_audit"]["total"] == pytest.approx((0.5 + 1 + near + 1 + 0.5) / 4)


def test_slices_of_runs(spark, tmp_path):
    for run, a in (("one", 0.5), ("two", 0.75)):
        (tmp_path / f"{run}.json").write_text(json.dumps({"accuracy": a, "by_negative_type_no_only": {"shifted": {"accuracy": a, "n": 3}, **({"typed": {"accuracy": 1.0}} if run == "two" else {})}}))
    reports = jsonl.read_reports(spark, [f"{k}={tmp_path}/{k}.json" for k in ("one", "two")])
    got = {tuple(r) for r in profile.run_slices(reports, ["one", "two"], "negative_type").collect()}
    assert got == {("shifted", 0.5, 0.75), ("typed", None, 1.0)}


def test_markdown_has_a_section_a_row(spark, tmp_path):
    jsonl.write_markdown(spark.createDataFrame([(3, "ü")], "case_index int, text string"), str(tmp_path / "x.md"), "Review")
    assert (tmp_path / "x.md").read_text() == "# Review\n\n## Case 3\n\n- case_index: 3\n- text: ü\n"


def test_paths_of_needed_images(spark):
    df = spark.createDataFrame([("a.png",), ("/b.png",), ("",)], "p string")
    assert [r[0] for r in df.select(scorer.needed_image(F.col("p"), "/root/")).collect()] == ["/root/a.png", "/b.png", "/root"]
    with pytest.raises(Exception, match="no image"):
        spark.range(1).select(scorer.needed_image(F.lit(None).cast("string"), "/root")).collect()


def test_labels_and_listed_boxes(spark):
    element = lambda text, index: F.struct(F.lit(text).alias("text"), F.lit("TEXT").alias("ui_type"), F.lit(index).cast("int").alias("index"))
    b = G.box(F.lit(1.25), F.lit(2.0), F.lit(3.35), F.lit(4.0))
    row = one(spark, a=G.element_label(element(" Add to the shopping cart now ", 3)), b=G.element_label(element("  ", None)), c=G.listed(b, F.lit('say "x"')))
    assert row["a"] == "3:TEXT:Add to the shopping cart" and row["b"] == "None:TEXT"
    assert json.loads(row["c"]) == [1.2, 2.0, 3.4, 4.0, 'say "x"']


def test_images_of_steps(spark):
    """The first alias that is there names the image: an object by its path, a text as it is; anything else is none."""
    rows = ['{"image": {"path": "a.png"}}', '{"screenshot": "b.png"}', '{"image_path": 3}', '{"screenshot_before": null, "image": "c.png"}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(episodes.before_image(F.parse_json("t"))).collect()] == ["a.png", "b.png", None, "c.png", None]
