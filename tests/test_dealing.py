"""Rows are dealt to tasks by their number, so that a task's memory does not grow with the table."""

import pytest

from pulsegrid.operators import dealing
from pulsegrid.plans import bindings, catalog, scope_queries

DIR = "/root/testdata/sf0.001"


def test_partitions_grow_with_rows_and_keep_keys_together(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    df = spark.range(3000).selectExpr("id % 50 AS k", "id")
    got = dealing.dealt(df, ["k"])
    assert got.rdd.getNumPartitions() == 30
    held = got.rdd.glom().map(lambda rows: sorted({r.k for r in rows})).collect()
    assert sum(map(len, held)) == 50 and sum(got.rdd.glom().map(len).collect()) == 3000
    assert dealing.dealt(df.limit(0), ["k"]).rdd.getNumPartitions() == 1
    assert dealing.dealt(df.where("id < 7"), ["k"], df).rdd.getNumPartitions() == 30


@pytest.mark.parametrize("name", ["unique_key_pairing", "spearman", "setting_recommendation"])
def test_queries_are_dealt_by_rows(spark, monkeypatch, name):
    monkeypatch.setattr(dealing, "TASK_ROWS", 150)
    want = -(-bindings.trials(spark, DIR).count() // 150)
    assert catalog.QUERIES[name].run(spark, DIR).rdd.getNumPartitions() == want


def test_pulses_do_not_join_a_run_with_what_comes_of_it(spark, capsys):
    """Samples meet their run, and nothing else is joined: every join of them holds sort memory in the same task."""
    scope_queries.found(spark, DIR).explain()
    plan = capsys.readouterr().out
    assert plan.count("Join") == 1
