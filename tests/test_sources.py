"""Parsers, sinks and streams on small records."""

import json

import pytest
from pyspark.sql import functions as F

from stepwise.functions import geometry as G
from stepwise.operators.audit import audited
from stepwise.sources import episodes, jsonl
from stepwise.streaming.steps import audited_stream, stream_jsonl, write_stream

RECORDS = [
    {"episode_id": "e1", "task": "open the shop", "screen_size": {"width": 1080, "height": 2400}, "steps": [{"action": "click(45, 310)"}, {"action": {"action_type": "tap", "x": 3100, "y": 9}}, {"action": {"type": "type", "text": ""}}]},
    {"ep_id": "e2", "goal_info": "go", "results_action_type": 4, "results_yx_touch": [0.2, 0.1], "results_yx_lift": [0.2, 0.13], "image_encoded": {"size": [100, 200], "path": "a.png"}},
    {"episode_id": "e3", "steps": []},
]


@pytest.fixture
def path(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n\n".join(map(json.dumps, RECORDS)) + "\n")
    return str(folder)


def test_parser_and_audit(spark, path):
    steps = audited(episodes.parser("coded")(jsonl.read_records(spark, f"{path}/a.jsonl")))
    got = {(r["episode_id"], r["step_id"]): (r["action"]["type"], r["audit"]["quality_score"]) for r in steps.collect()}
    assert got == {("e1", 0): ("click", 1.0), ("e1", 1): ("click", 0.75), ("e1", 2): ("type", 0.75), ("e2", 0): ("click", 0.75)}
    with pytest.raises(ValueError, match="known: coded"):
        episodes.parser("other")


def test_tap_distance_and_spaces(spark):
    row = spark.range(1).select(
        episodes.is_tap(G.point(F.lit(0.1), F.lit(0.1)), G.point(F.lit(0.1), F.lit(0.139))).alias("near"),
        episodes.is_tap(G.point(F.lit(0.1), F.lit(0.1)), G.point(F.lit(0.1), F.lit(0.15))).alias("far"),
        G.to_pixel(G.point(F.lit(500), F.lit(500)), F.struct(F.lit(1080).alias("width"), F.lit(2400).alias("height")), F.lit("normalized_1000")).alias("p"),
    ).first()
    assert row["near"] and not row["far"] and tuple(row["p"]) == (540.0, 1200.0)


def test_stream_equals_batch(spark, path, tmp_path):
    out = str(tmp_path / "out")
    write_stream(audited_stream(stream_jsonl(spark, path), "coded"), out, str(tmp_path / "cp")).awaitTermination(120)
    batch = audited(episodes.coded_episodes(jsonl.read_jsonl(spark, path)))
    assert sorted(spark.read.parquet(out).select("episode_id", "step_id", "audit.quality_score").collect()) == sorted(batch.select("episode_id", "step_id", "audit.quality_score").collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü"), (2, None)], "a int, b string")
    jsonl.write_jsonl(df, str(tmp_path / "x.jsonl"), ["a"])
    assert sorted((r["a"], r["b"]) for r in spark.read.json(str(tmp_path / "x.jsonl")).collect()) == [(1, "ü"), (2, None)]
    jsonl.write_csv(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b")
    jsonl.write_report(str(tmp_path / "r.json"), {"n": 1})
    assert jsonl.read_reports(spark, [f"one={tmp_path}/r.json"]).first()["run"] == "one"
    with pytest.raises(ValueError, match="NAME=PATH"):
        jsonl.read_reports(spark, ["broken"])


def test_csv_has_all_rows(spark, tmp_path):
    jsonl.write_csv(spark.range(10_050), str(tmp_path / "x.csv"))
    assert sorted(map(int, (tmp_path / "x.csv").read_text(encoding="utf-8-sig").split()[1:])) == list(range(10_050))
    jsonl.write_csv(spark.range(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text(encoding="utf-8-sig").split() == ["case_index,review_label,notes,sample_id"]
