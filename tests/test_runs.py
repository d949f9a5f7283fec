"""Runs of failures: by stretches as by whole keys, and as a loop counts them."""

import random

from pyspark.sql import functions as F

from spanloom.streaming import state


def counted(rows):
    out, run = {}, {}
    for k, i, ok in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run[k] = 0 if ok else run.get(k, 0) + (ok is False)
        out[(k, i)] = run[k]
    return out


def test_stretches_agree_with_a_loop(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([True, False, False, False, None])) for i in range(600)] + [("never", i, False) for i in range(40)] + [("once", 7, None)]
    e = spark.createDataFrame(rows, "k string, i int, ok boolean")
    want = counted(rows)
    for stretch in (None, F.floor(F.col("i") / 7), F.floor(F.col("i") / 100), F.col("i"), F.lit(0)):
        r = state.failure_runs(e, "k", ["i"], "ok", 3, stretch)
        assert r.columns == ["k", "i", "ok", "streak", "open"]
        got = r.collect()
        assert {(x.k, x.i): x.streak for x in got} == want and all(x.open == (x.streak >= 3) for x in got) and len(got) == len(rows)


def test_no_events(spark):
    assert state.failure_runs(spark.createDataFrame([], "k string, i int, ok boolean"), "k", ["i"], "ok", 3, F.col("i")).count() == 0


def test_events_are_dealt_by_stretches(spark):
    e = spark.range(1000).selectExpr("id % 3 AS k", "id AS i", "id % 5 = 0 AS ok")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.failure_runs(e, "k", ["i"], "ok", 3, F.floor(F.col("i") / 10))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = [plan[: at].rsplit("Exchange", 1)[1].splitlines()[0] for at in range(len(plan)) if plan.startswith("Range (", at)]
    assert len(above) == 2 and all(x.startswith(" hashpartitioning(_k#") for x in above), plan  # events on either side of the join: by key and stretch, never by key
