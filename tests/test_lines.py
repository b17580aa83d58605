"""Places of lines, checked scans, and jobs that follow the order of their input."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_jobs import raw, record  # noqa: F401

from stepwise.operators import pair_filter
from stepwise.plans import jobs
from stepwise.sources import jsonl, lines


@pytest.fixture
def small_splits(spark):
    """Many splits a file, and several files a task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_have_their_places(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = []
    for name in ("a", "b", "c", "d"):
        rows = ["" if rng.random() < 0.2 else "  " if rng.random() < 0.1 else f"{name}{i} " + "x" * rng.randrange(60) for i in range(rng.choice([3, 40, 200]))]
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + rng.choice(["", "\n"]))
        want += [(name, i, r) for i, r in enumerate(r for r in rows if r.strip())]
    (tmp_path / "e.txt").write_text("\n \n")
    df = lines.numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4 and "Exchange hashpartitioning(file" not in df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    got = sorted(df.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(len(want)))
    assert [(r["file"][-5], r["record"], r["value"]) for r in got] == want
    assert {r["value"] for r in lines.first_lines(spark, str(tmp_path), 50).collect()} == {v for _, _, v in want[:50]}
    assert lines.numbered_lines(spark, str(tmp_path / "e.txt")).count() == 0


def test_limits_take_the_first_records(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"n": {100 * k + i}}}\n\n' for i in range(100)))
    for limit in (1, 130, 250):
        assert {r["n"] for r in jsonl.read_jsonl(spark, str(tmp_path), "n int", limit).collect()} == set(range(limit))
        assert jsonl.read_jsonl(spark, str(tmp_path), limit=limit).select(F.variant_get("raw", "$.n", "int").alias("n")).agg(F.max("n")).first()[0] == limit - 1


def test_bad_lines_are_rejected_or_raise(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "a.jsonl").write_text('{"n": 1, "t": "x"}\n{"n": 2, "t":\n\n{"n": "no", "t": "y"}\n[1]\n{"n": -1, "t": "z"}\n{"t": "w"}\n{}\n7\n')
    schema = StructType.fromDDL("n int, t string")
    checked = lines.checked_lines(spark, str(tmp_path), schema, {"n": F.col("n") >= 0, "t": F.col("t").isNotNull()})
    assert [tuple(r) for r in lines.accepted(checked).collect()] == [(1, "x", 0)]
    got = {(r["record"], r["reason"]) for r in lines.rejected(checked).collect()}
    assert got == {(1, "malformed"), (2, "malformed"), (3, "malformed"), (4, "n"), (5, "n"), (6, "n"), (7, "malformed")}
    assert lines.rejected(checked).where("record = 1").first()["value"] == '{"n": 2, "t":'
    with pytest.raises(Exception, match="bad record"):
        lines.strict(checked).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        lines.typed_lines(spark, str(tmp_path), schema).collect()


def test_pairs_are_checked(spark, raw, tmp_path):  # noqa: F811
    jobs.prepare_pairs(spark, raw, str(tmp_path / "out"), selected=3)
    folder = tmp_path / "out" / "shop_pairs"
    rows = [json.loads(x) for f in sorted(folder.glob("*.json")) for x in f.read_text().splitlines()]
    broken = [{**rows[0], "pair_id": None}, {**rows[1], "step_id": -1}, {**rows[2], "screen_size": {"width": 0, "height": 5}}, {**rows[3], "chosen": {**rows[3]["chosen"], "type": "jump"}}]
    broken += [{**rows[4], "rejected": {**rows[4]["rejected"], "coordinate_space": "feet"}}, {**rows[5], "step_id": "five"}]
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows[6:]) + "\n" + "\n".join(json.dumps(r) for r in broken) + '\n{"pair_id": \n')
    assert jobs.rejects(spark, str(path), str(tmp_path / "r")) == {"accepted": len(rows) - 6, "rejected": 7}
    said = {r["record"] - (len(rows) - 6): r["reason"] for r in spark.read.json(str(tmp_path / "r" / "rejected")).collect()}
    assert said == {0: "pair_id", 1: "step_id", 2: "screen_size", 3: "chosen type", 4: "rejected space", 5: "malformed", 6: "malformed"}
    with pytest.raises(Exception, match="bad record"):
        jobs.filter_pairs(spark, str(path), str(tmp_path / "f"))


def test_the_last_decision_counts(spark, raw, tmp_path):  # noqa: F811
    out = str(tmp_path / "out")
    jobs.prepare_pairs(spark, raw, out, selected=3)
    ids = sorted(r["pair_id"] for r in spark.read.json(f"{out}/shop_pairs").collect())
    rng = random.Random(3)
    folder = tmp_path / "decisions"
    folder.mkdir()
    last = {}
    for name in "abc":
        rows = []
        for i in ids if name == "a" else rng.choices(ids, k=70):
            said = {"pair_id": i, "decision": rng.choice(["keep", "filter", "ambiguous"]), "reason": f"r{rng.randrange(3)}", "major_category": rng.choice(["x", None]), "target_region_kind": "t", "candidate_region_kind": None}
            rows.append(said)
            last[i] = said
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    done = jobs.ablation(spark, f"{out}/shop_pairs", str(folder), f"{out}/variants")
    for name, drops in pair_filter.VARIANTS.items():
        kept = {i for i in ids if last[i]["decision"] not in drops}
        assert done[name]["num_pairs"] == len(kept) and done[name]["num_scorer_rows"] == 2 * len(kept) == sum(done[name]["splits"].values())
        pairs = {r["pair_id"]: r["filter_metadata"].asDict() for r in spark.read.json(f"{out}/variants/{name}_pairs").collect()}
        assert set(pairs) == kept
        for i, told in pairs.items():
            assert told == {k: last[i][c] for k, c in pair_filter.FILTER_KEYS.items()}
        report = {(r["dim"], r["value"]): r["n"] for r in spark.read.json(f"{out}/variants/{name}_summary").collect()}
        gone = [last[i] for i in ids if i not in kept]
        assert report["num_pairs", "all"] == len(kept) and report["num_dropped_pairs", "all"] == len(gone)
        for reason in {g["reason"] for g in gone}:
            assert report["dropped_reasons", reason] == sum(g["reason"] == reason for g in gone)
        assert sum(n for (dim, _), n in report.items() if dim == "dropped_by_negative_type_reason") == len(gone)
        assert report["kept_major_categories", "unknown"] == sum(last[i]["major_category"] is None for i in kept)


def test_first_cases_follow_the_pairs(spark, raw, tmp_path):  # noqa: F811
    out = str(tmp_path / "out")
    jobs.prepare_pairs(spark, raw, out, selected=3)
    jobs.filter_pairs(spark, f"{out}/shop_pairs", f"{out}/filter", per_decision=4)
    order = [r["pair_id"] for r in sorted(lines.typed_lines(spark, f"{out}/shop_pairs", "pair_id string").collect(), key=lambda r: r["pos"])]
    said = {r["pair_id"]: r["decision"] for r in spark.read.json(f"{out}/filter/decisions").collect()}
    want = {d: [i for i in order if said[i] == d][:4] for d in set(said.values())}
    got = {}
    for r in sorted(spark.read.json(f"{out}/filter/decision_samples").collect(), key=lambda r: r["rn"]):
        got.setdefault(r["decision"], []).append(r["pair_id"])
    assert got == want


def test_more_splits_than_are_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(lines, "SPLITS", 2)
    (tmp_path / "a.txt").write_text("\n".join(map(str, range(1000))))
    assert sorted((r["pos"], r["value"]) for r in lines.numbered_lines(spark, str(tmp_path)).collect()) == [(i, str(i)) for i in range(1000)]
