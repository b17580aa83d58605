"""How event rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.operators import negatives, regions
from stepwise.plans import fixtures


def test_a_task_joins_few_texts(spark, monkeypatch):
    """Rows of one text are written with one copy of it only where a task's texts fit a Parquet dictionary."""
    monkeypatch.setattr(fixtures, "TASK_TEXTS", 4)
    sf_dir = "/root/testdata/sf0.001"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    want = max(n, min(-(-docs // 4), fixtures.MORE_TASKS * n))
    assert want > n
    tasks = fixtures.steps(spark, sf_dir).select(F.length("task")).rdd.getNumPartitions()
    assert tasks == want


def test_texts_of_users_take_their_tasks_whatever_the_shuffle(spark, monkeypatch):
    """However few partitions a shuffle has, a task joins no more users' texts than fit a Parquet dictionary."""
    monkeypatch.setattr(fixtures, "TASK_TEXTS", 1)
    monkeypatch.setattr(fixtures, "MORE_TASKS", 1)
    sf_dir = "/root/testdata/sf0.001"
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < users < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert fixtures.steps(spark, sf_dir).select(F.length("task")).rdd.getNumPartitions() == users


def test_shifts_are_looked_up_only_until_one_is_off_all_elements(spark):
    """No row carries all shifts; another element's shift is worked out only where none is off all elements."""
    rows = negatives.with_sampling(regions.with_pixel_boxes(fixtures.steps(spark, "/root/testdata/sf0.001", texts=False)))
    assert "_landed" not in rows.columns
    assert rows.where("_off is not null and _other is not null").isEmpty() and not rows.where("_off is not null").isEmpty()
