"""Snapshots in buckets, directories of days, and ORC files: what their plans leave out."""

import os

import pytest

from catalogue import snapshots

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture()
def explained(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_bucketed_snapshots_are_compared_without_an_exchange(spark, explained):
    shown = explained(snapshots.plan_orders_bucketed(spark, SF_DIR))
    assert "Exchange" not in shown and "SelectedBucketsCount: 8 out of 8" in shown


def test_scope_reaches_orc_files(spark, explained):
    shown = explained(snapshots.plan_orc(spark, SF_DIR))
    assert shown.count("Format: ORC") == 2 and shown.count("GreaterThan(k,0)") == 2


def test_directories_of_other_days_are_not_read(spark, explained):
    joined = snapshots.partition_read_joined(spark, SF_DIR)
    shown = explained(joined)
    assert "dynamicpruning" in shown and "PartitionFilters: [isnotnull(year" in shown
