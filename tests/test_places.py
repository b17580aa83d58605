"""Places by counted ranges, large selections, and the review sink."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from stepwise.operators import places, selection
from stepwise.sources import jsonl


def test_places_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(places, "RANGE_ROWS", 50)
    rng = random.Random(2)
    # Ten values of the first column, one of them in most rows, and nulls.
    rows = [(rng.choice(["a"] * 20 + list("bcdefghi") + [None]), rng.choice([None, *range(500)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = places.numbered(df, ["k", "v", "i"], "place").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["place"])] == order and {r["place"] for r in got} == set(range(1, 3001))
    assert places.numbered(df.where("false"), ["k"], "place").count() == 0


def plain_selection(rows, k, per_action):
    by = {}
    for key, kind, difficulty in rows:
        by.setdefault(kind or "unknown", []).append((difficulty is not None, difficulty or 0, key))
    by = {t: sorted(v, reverse=True)[: per_action or k] for t, v in by.items()}
    out, turn = [], 1
    while len(out) < k and any(len(v) >= turn for v in by.values()):
        out += [(turn, t, by[t][turn - 1][2]) for t in sorted(by) if len(by[t]) >= turn]
        turn += 1
    return out[:k]


@pytest.mark.parametrize(("k", "per_action"), [(100, None), (1500, None), (1501, 400), (2999, 650), (10**5, None)])
def test_large_selections_equal_small_ones(spark, monkeypatch, k, per_action):
    rng = random.Random(k)
    rows = [(f"k{i}", rng.choice(["click"] * 8 + ["swipe", "swipe", "type", None]), rng.choice([None, round(rng.random(), 2)])) for i in range(3000)]
    df = spark.createDataFrame([(*r, "high") for r in rows], "key string, action_type string, difficulty double, bucket string").repartition(4)
    want = plain_selection(rows, k, per_action)
    for limit in (50, 10**6):
        monkeypatch.setattr(selection, "GROUP_LIMIT", limit)
        monkeypatch.setattr(places, "RANGE_ROWS", 100)
        got = selection.select_diverse(df, k, per_action=per_action).collect()
        assert [(r["turn"], r["action_type"], r["key"]) for r in got] == want


def test_csv_has_the_bytes_of_one_writer(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice('ab ,"\n\rü€') for _ in range(9)) or None, rng.random(), rng.choice([True, False, None])) for i in range(2000)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "case_index int, text string, x double, ok boolean").repartition(7)
    jsonl.write_csv(df, str(tmp_path / "x.csv"))
    text = io.StringIO(newline="")
    out = csv.writer(text)
    out.writerow(df.columns)
    out.writerows(rows)
    assert (tmp_path / "x.csv").read_bytes() == ("﻿" + text.getvalue()).encode()
    jsonl.write_csv(df.where("case_index < 2"), str(tmp_path / "x.csv"))
    assert len((tmp_path / "x.csv").read_text(encoding="utf-8-sig").splitlines()) >= 3 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["x.csv"]
    assert "toLocalIterator" not in open(jsonl.__file__).read()
