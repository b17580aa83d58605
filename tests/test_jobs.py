"""End-to-end jobs on small records, and metadata that steps and actions carry."""

import json

import pytest
from pyspark.sql import functions as F

from stepwise.functions.maps import entries, merged
from stepwise.functions.text import action_text, number_text
from stepwise.operators import errors, profile
from stepwise.plans import jobs
from stepwise.sources import episodes, jsonl


def record(i: int) -> dict:
    boxes = [0.2, 0.3, 0.1, 0.4, 0.6, 0.5, 0.1, 0.5]
    touch = [0.2, 0.3] if i % 2 else [0.6, 0.5]
    return {
        "ep_id": f"r{i // 3}", "step_id": i % 3, "goal_info": f"find shop number {i // 3}", "results_action_type": (4, 4, 7)[i % 3], "results_yx_touch": touch, "results_yx_lift": touch,
        "image_encoded": {"size": [500, 1000], "path": f"{i}.png"}, "device_type": "phone",
        "image_ui_annotations_positions": boxes, "image_ui_annotations_text": ["Search", "Add to cart"], "image_ui_annotations_ui_types": ["TEXT", "BUTTON"],
    }


@pytest.fixture
def raw(tmp_path):
    path = tmp_path / "shop_raw.jsonl"
    path.write_text("\n".join(json.dumps(record(i)) for i in range(30)) + "\n")
    return str(path)


def test_jobs_end_to_end(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    assert jobs.tag_of(raw) == "shop"
    done = jobs.prepare_scorer(spark, raw, out, selected=5)
    assert (done["num_steps"], done["num_pairs"], done["num_scorer_rows"]) == (30, 120, 240)
    assert sum(done["splits"].values()) == 240
    read = lambda name: spark.read.json(f"{out}/shop_{name}")
    assert read("selected").count() == 5 and read("audited").count() == 30
    assert {r["action"]["coordinate_space"] for r in read("steps_normalized").collect()} == {"normalized_1000"}
    assert read("census").where("dim = 'record'").first()["n"] == 30
    assert read("pair_profile").where("dim = 'negative_type'").agg(F.sum("n")).first()[0] == 120
    decisions = jobs.filter_pairs(spark, f"{out}/shop_pairs", f"{out}/filter", per_decision=3)
    assert sum(decisions.values()) == 120
    variants = jobs.ablation(spark, f"{out}/shop_pairs", f"{out}/filter/decisions", f"{out}/variants")
    dropped = {"clean_filter": decisions.get("filter", 0), "ambiguous_removed": decisions.get("filter", 0) + decisions.get("ambiguous", 0)}
    assert {k: v["num_scorer_rows"] for k, v in variants.items()} == {k: 2 * (120 - n) for k, n in dropped.items()}


def test_metadata_of_parsed_steps(spark, raw):
    rows = episodes.coded_episodes(jsonl.read_records(spark, raw)).collect()
    enter = next(r for r in rows if r["action"]["metadata"]["action_code"] == "7")
    assert enter["action"]["type"] == "wait" and enter["action"]["metadata"]["semantic"] == "press_enter"
    assert enter["metadata"] == {"source": "coded", "current_activity": None, "device_type": "phone", "episode_length": None} and enter["history"] == []


def test_two_level_records(spark):
    raw = [
        {"id": 7, "goal": "whole", "screen_size": [10, 20], "steps": [{"low_level_instruction": "part", "action": "scroll(down)"}, {"action_type": "click", "x": 1, "y": 2}]},
        {"episode_id": None, "goal": "none", "steps": [], "actions": [{"action": "back"}]},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string").select(F.parse_json("raw").alias("raw"))
    rows = sorted(episodes.two_level_episodes(df).collect(), key=lambda r: r["step_id"])
    assert [(r["episode_id"], r["task"], r["action"]["type"], r["action"]["metadata"]["raw_action"]) for r in rows] == [("7", "part", "scroll", "scroll(down)"), ("7", "whole", "wait", None)]
    assert rows[0]["metadata"] == {"source": "two_level", "high_level_instruction": "whole"} and rows[0]["ui_elements"] == []


def test_boxes_and_maps(spark):
    texts = ('{"x1":1,"y1":2,"x2":3,"y2":4,"coordinate_space":"normalized_1"}', '{"left":1,"top":2,"right":3,"bottom":4}', "[1,2,3,4,5]", '{"x1":1}', "[1,2]")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(episodes.as_box(F.parse_json("t")).alias("b"))
    assert [r["b"] and tuple(r["b"]) for r in df.collect()] == [(1, 2, 3, 4, "normalized_1"), (1, 2, 3, 4, "pixel"), (1, 2, 3, 4, "pixel"), None, None]
    row = spark.range(1).select(merged(entries(a="1", b="2"), entries(b="3")).alias("m"), merged(F.lit(None).cast("map<string,string>"), entries(c="4")).alias("n")).first()
    assert row["m"] == {"a": "1", "b": "3"} and row["n"] == {"c": "4"}


def test_numbers_and_actions_as_text(spark):
    numbers = [0.0, 1.0, -2.5, 0.1, 1e-3, 1.2e-4, 1e-5, 1.25e-12, 1e7, 123456789.125, 1e15, 1e16, 1.5e20, 1e100]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(number_text(F.col("x")).alias("t")).collect()]
    assert got == list(map(repr, numbers))
    scroll = episodes.string_action(F.lit("scroll(down)"))
    want = {"type": "scroll", "point": None, "start_point": None, "end_point": None, "text": None, "direction": "down", "coordinate_space": "pixel", "metadata": {"raw_action": "scroll(down)"}}
    assert spark.range(1).select(action_text(scroll)).first()[0] == repr(want)


def walk(value, path=""):
    if isinstance(value, dict):
        for key, item in value.items():
            inner = f"{path}.{key}" if path else key
            yield inner, item
            yield from walk(item, inner)
    elif isinstance(value, list):
        yield path, value
        for item in value[: profile.CENSUS_ITEMS]:
            yield f"{path}[]", item
            yield from walk(item, f"{path}[]")


def test_census_equals_a_plain_walk(spark):
    names = {type(None): "null", bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "dict"}
    records = [{"a": [1, 2.5, None, True], "b": {"c": [[1], {"d": []}], "action": {"type": "", "action_type": "tap"}}, "e": {}}, {"a": "x", "b": None}]
    want = {}
    for r in records:
        for path, value in walk(r):
            key = (path, names[type(value)])
            want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "raw string")
    assert {(r["path"], r["type"]): r["n"] for r in profile.json_census(df).collect()} == want
    said = profile.record_census(df).where("dim = 'action_like'").collect()
    assert {r["value"]: r["n"] for r in said} == {"tap": 2}
    with pytest.raises(Exception, match="more than 2 levels"):
        profile.json_census(df, depth=2).collect()


def test_screens_and_markers(spark):
    size = "struct<width:int,height:int>"
    row = spark.range(1).select(
        errors.aspect_ratio(F.lit(None).cast(size)).alias("none"), errors.aspect_ratio(F.struct(F.lit(3).alias("width"), F.lit(0).alias("height"))).alias("part")
    ).first()
    assert tuple(row) == ("720 / 1520", "3 / 1520")
