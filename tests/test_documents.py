"""JSON documents that are read by many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stepwise.sources import documents, jsonl


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    text = "".join(rng.choice('ab {}[],:"\\/\n\tü€漢') for _ in range(rng.randrange(12)))
    if kind < 4:
        return [text, rng.randrange(-99, 99), None, True][kind]
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {text + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def tiny_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path):
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in jsonl.read_records(spark, str(path)).select(F.to_json("raw")).collect())


def wanted(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records)


@pytest.mark.parametrize("seed", range(3))
def test_many_ranges_give_the_same_records(spark, tmp_path, tiny_ranges, seed):
    rng = random.Random(seed)
    records = [{"id": i, "steps": [value(rng) for _ in range(rng.randrange(5))]} for i in range(60)] + [{"long": "}{]" * 400}, {}, {"": {"episodes": [1]}}]
    indent = [None, 1, None][seed]
    (tmp_path / "list.json").write_text(json.dumps(records, indent=indent, ensure_ascii=seed == 1))
    (tmp_path / "object.json").write_text(json.dumps({"info": {"episodes": [9], "x": "}"}, "more": [[7], {"a": 1}], "episodes": records[:40], "last": [{"b": [2]}]}, indent=indent) + "\n")
    for size in (150, 4000):
        tiny_ranges(size)
        assert read(spark, tmp_path / "list.json") == wanted(records)
        assert read(spark, tmp_path / "object.json") == wanted(records[:40])
    tiny_ranges(150)
    n = (tmp_path / "list.json").stat().st_size // 150
    tasks = documents.ranges(spark, str(tmp_path / "list.json")).rdd.getNumPartitions()
    assert tasks > n // 2 > 10


def test_small_documents(spark, tmp_path):
    for i, (text, want) in enumerate((("[]", []), ("[ ]", []), ("{}", [{}]), (' {"a": [1]}', [{"a": [1]}]), ('{"episodes": {"a": 1}}', [{"episodes": {"a": 1}}]), ('{"episodes": []}', []), ('[{"a": 1}]\n', [{"a": 1}]), ('[1, "}", [2]]', [1, "}", [2]]))):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert read(spark, path) == wanted(want), text
    (tmp_path / "bad.json").write_text('"text"')
    with pytest.raises(ValueError, match="a list or an object"):
        read(spark, tmp_path / "bad.json")
