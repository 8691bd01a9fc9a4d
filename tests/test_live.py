"""Live diagnostics against the batch operators, and percentiles by selection against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from anamnex.operators import diagnostics, selection
from anamnex.streaming import live


def ranked(values, share):
    own = sorted(v for v in values if v is not None)
    return own[max(1, math.ceil(share * len(own))) - 1] if own else None


SHARES = {"low": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "all": 1.0}


@pytest.mark.parametrize("most", [40, 700, 100_000])
def test_selection_equals_sorting(spark, most):
    r = random.Random(most)
    shapes = {
        "even": lambda: r.random(), "ties": lambda: float(r.choice([0, 1])), "heavy": lambda: 5.0 if r.random() < 0.97 else r.gauss(0, 9), "same": lambda: 3.0,
        "steps": lambda: float(int(r.paretovariate(1))), None: lambda: r.choice([None, r.gauss(0, 1), -0.5]), "few": lambda: r.random(), "none": lambda: None,
    }
    data = {k: [make() for _ in range(3 if k == "few" else 2500)] for k, make in shapes.items()}
    rows = [(k, v) for k, values in data.items() for v in values]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "n string, v double").withColumn("share", F.lit("clash"))
    got = {x["n"]: x.asDict() for x in diagnostics.with_percentiles(df.select("n").distinct(), df, "v", SHARES, ["n"], most).collect()}
    assert got == {k: {"n": k, **{s: ranked(v, p) for s, p in SHARES.items()}} for k, v in data.items()}
    assert selection.percentiles(df.limit(0), "v", SHARES, "n", most=most).count() == 0


def test_a_counter_of_a_million_distinct_values_in_bounded_groups(spark, monkeypatch):
    """What a task ranks exactly never exceeds the bound, however many values a counter has."""
    n, most, held = 1_000_000, 5_000, []
    kept = selection.written

    def spied(df):
        out = kept(df)
        if out.columns == ["g__", "of", "v"]:
            held.append(out.groupBy("g__", "of").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(selection, "written", spied)
    df = spark.range(0, n, 1, 8).select(F.lit("hot").alias("counter"), (F.pmod(F.col("id") * 7919, F.lit(n)) + 1).cast("double").alias("value"))
    assert selection.percentiles(df, "value", {"p50": 0.5, "p99": 0.99}, "counter", most=most).collect() == [("hot", 500_000.0, 990_000.0)]
    assert held and held[-1] <= most and held[0] <= n // 25


def test_large_groups_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(selection, "HOT_ROWS", 10)
    rows = [("hot", float(k)) for k in range(900)] + [(f"g{k % 300}", float(k)) for k in range(900)]
    monkeypatch.setattr(selection, "BROADCAST_GROUPS", 4)
    got = dict(selection.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", {"p50": 0.5}, "k", most=2).collect())
    assert got == {k: ranked([v for c, v in rows if c == k], 0.5) for k, _ in rows}


@pytest.mark.parametrize("seconds", [5, 60, 100_000])
def test_bursts_across_stretches(spark, seconds):
    r = random.Random(seconds)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), 1_700_000_000 + t, r.random() < r.choice([0.2, 0.8])) for t in sorted(r.sample(range(4000), 900))]
    want = []
    for host in ("hot", "b", None):
        run = []
        for _, t, lost in [x for x in rows if x[0] == host] + [(host, None, False)]:
            if lost:
                run.append(t)
            else:
                want += [(host, run[0], len(run))] if len(run) >= 2 else []
                run = []
    df = spark.createDataFrame(rows, "host string, t long, lost boolean").select("host", F.timestamp_seconds("t").alias("ts"), "lost").repartition(3)
    got = diagnostics.loss_bursts(df, "host", seconds=seconds).select("host", F.unix_seconds("start"), "losses").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def feed(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(str(folder))


def test_runs_cross_batches_and_restarts_and_late_lines_are_counted(spark, tmp_path):
    folder, own = tmp_path / "in", live.with_rocksdb(spark)
    host = F.regexp_extract("value", r"h=(\w+)", 1)
    at = "2026-01-01 00:00:"

    def run():
        stream = live.loss_runs(live.live_samples(own, str(folder), "20 seconds", host))
        live.appended(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(live.RUNS).parquet(str(tmp_path / "out")).select("host", F.date_format("start", "ss"), "losses").collect())

    feed(spark, folder, [at + "00.000 h=a time=3ms", at + "01.000 h=a timed out", at + "03.000 h=a timed out", "noise", at + "05.000 timed out"])
    assert run() == []
    feed(spark, folder, [at + "04.000 h=a General failure", at + "02.000 h=a time=1ms", at + "06.000 h=b timed out", at + "06.000 h=b timed out", at + "10.000 h=a time=9ms", at + "40.000 h=a timed out"])
    assert run() == [("a", "03", 2)]  # 01 stands alone since a late 02 answered
    feed(spark, folder, [at + "59.000 h=b time<1ms", at + "07.000 h=b timed out", "2026-01-01 00:09:00.000 h=x time<1ms"])  # 07 is too late
    assert run() == [("a", "03", 2), ("b", "06", 2)]
