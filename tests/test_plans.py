"""What plans hold: no interpreted generators, no expression repeated, no wide rows shuffled."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stepwise.functions.geometry import once
from stepwise.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _generators(df) -> list[str]:
    return [line for line in _plan(df).splitlines() if re.search(r"\bGenerate (inline|explode|posexplode)", line)]


def test_once_generates_columns_only(spark):
    df = once(spark.range(3), a=F.transform(F.array("id"), lambda x: x + 1))
    assert all("lambda" not in g for g in _generators(df))
    assert [r["a"] for r in df.orderBy("id").collect()] == [[1], [2], [3]]


def test_generators_of_pairs_hold_no_lambda(spark):
    assert all("lambda" not in g for g in _generators(QUERIES["pair_decisions"](spark, DATA)))


def test_a_screen_region_is_found_once(spark):
    assert _plan(QUERIES["screen_regions"](spark, DATA)).count("search_or_suggestion_row") == 2  # the search region and, of it, the wider one


def test_no_boxes_are_shuffled_for_error_facts(spark):
    joins = _plan(QUERIES["error_join"](spark, DATA)).split("LeftSemi")
    assert len(joins) == 2 and "rejected_element" not in joins[0]


def test_variants_count_pairs_once(spark):
    assert "sum(times" in _plan(QUERIES["ablation_summary"](spark, DATA))


def test_lists_of_elements_are_not_read_for_each_number(spark):
    # Once in the projection, twice in the filter that Spark infers from the explode.
    assert _plan(QUERIES["ui_elements_flat"](spark, DATA)).count("$.image_ui_annotations_positions") <= 3
