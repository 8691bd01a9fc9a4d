"""Log diagnostics: ping samples with stall markers, performance counters, percentiles, bursts and interval joins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .selection import MOST_HELD, percentiles

STALL_SECONDS = 30


def ping_lines(lines: DataFrame, line: str = "value", **more: Column) -> DataFrame:
    """(ts, ms, lost, marker, note) of log lines `yyyy-MM-dd HH:mm:ss.SSS rest`, and further columns of a line; other lines are passed over."""
    head = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+(.*)$"
    df = lines.select(F.try_to_timestamp(F.regexp_extract(line, head, 1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), F.regexp_extract(line, head, 2).alias("rest"), *(c.alias(n) for n, c in more.items()))
    stall = r"###\s*STALL MARKER\s*###\s*(.*)$"
    marker = F.col("rest").rlike(stall)
    ms = F.when(~marker, F.regexp_extract("rest", r"time[=<](\d+)\s*ms", 1).try_cast("double"))
    failed = F.col("rest").rlike("(?i)timed out|unreachable|General failure|transmit failed|could not find host")
    lost = ~marker & ms.isNull() & failed
    df = df.select("ts", ms.alias("ms"), lost.alias("lost"), marker.alias("marker"), F.when(marker, F.trim(F.regexp_extract("rest", stall, 1))).alias("note"), *more)
    return df.where(F.col("ts").isNotNull() & (F.col("ms").isNotNull() | F.col("lost") | F.col("marker")))


def micros(column: str) -> Column:
    """Microseconds of a timestamp with or without a zone; only differences are used."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def ping_summary(samples: DataFrame, *by: str, most: int = MOST_HELD) -> DataFrame:
    """Counts of samples and losses, and round-trip times; percentiles are exact, and no task holds all times of a group."""
    out = samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if("lost").alias("lost"), F.round(100.0 * F.count_if("lost") / F.count("*"), 2).alias("loss_pct"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
    )
    return with_percentiles(out, samples, "ms", {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, by, most)


def with_percentiles(out: DataFrame, rows: DataFrame, value: str, shares: dict[str, float], by, most: int) -> DataFrame:
    """out, a row for each group of rows, with the percentiles of a value; null where a group has no value."""
    if not by:
        found = percentiles(rows.withColumn("__all", F.lit(0)), value, shares, "__all", most=most)
        return out.withColumn("__all", F.lit(0)).join(found, "__all", "left").drop("__all")
    key = F.struct(*by).alias("__by")  # groups with null keys meet too
    found = percentiles(rows.withColumn("__by", F.struct(*by)), value, shares, "__by", most=most)
    return out.select("*", key).join(found, "__by", "left").drop("__by")


def worst(samples: DataFrame, value: str = "ms", limit: int = 10) -> DataFrame:
    """The largest samples (a top-k report); ties by time."""
    return samples.where(F.col(value).isNotNull()).orderBy(F.desc(value), "ts").limit(limit)


#: Seconds of samples that are searched for runs at once.
BURST_SECONDS = 3600


def loss_bursts(samples: DataFrame, *by: str, least: int = 2, order=("ts",), seconds: int = BURST_SECONDS) -> DataFrame:
    """Runs of consecutive lost samples: their start and length. order begins with ts.

    Runs are found within stretches of time, so that a host of any size is many tasks; of each stretch only the runs at its
    ends, at most two, go on to be joined with those of the stretch before and after.
    """
    stretch = F.floor(micros("ts") / F.lit(seconds * 1_000_000)).alias("stretch")
    own = samples.select(*by, "ts", *(c for c in order if c != "ts"), "lost", stretch)
    all_ = Window.partitionBy(*by, "stretch").orderBy(*order)
    lost = Window.partitionBy(*by, "stretch", "lost").orderBy(*order)
    whole = Window.partitionBy(*by, "stretch")
    own = own.withColumn("k", F.row_number().over(all_)).withColumn("island", F.col("k") - F.row_number().over(lost)).withColumn("n", F.count("*").over(whole))
    runs = own.where("lost").groupBy(*by, "stretch", "n", "island").agg(F.min("ts").alias("start"), F.count("*").alias("losses"), F.min("k").alias("first"), F.max("k").alias("last"))
    runs = runs.withColumn("from_start", F.col("first") == 1).withColumn("to_end", F.col("last") == F.col("n"))
    inner = runs.where(~F.col("from_start") & ~F.col("to_end")).select(*by, "start", "losses")
    # stretches without a lost sample at an end matter too: they part the runs around them
    stretches = own.select(*by, "stretch").distinct().withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("stretch")))
    same = reduce(lambda a, c: a & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), [*by, "stretch"], F.lit(True))
    ends = runs.where("from_start OR to_end").alias("a").join(stretches.alias("b"), same).select("a.*", "b.nth")
    before = Window.partitionBy(*by).orderBy("nth", "first")
    goes_on = F.col("from_start") & (F.lag("nth").over(before) == F.col("nth") - 1) & F.lag("to_end").over(before)
    ends = ends.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("chain", F.sum("new").over(before))
    joined = ends.groupBy(*by, "chain").agg(F.min("start").alias("start"), F.sum("losses").alias("losses")).drop("chain")
    return inner.unionByName(joined).where(F.col("losses") >= least)


def near(markers: DataFrame, samples: DataFrame, seconds: int = STALL_SECONDS, *by: str) -> DataFrame:
    """Samples within some seconds of a marker (marker_id, marker_ts): an equi-join on time buckets of that width, then the exact test."""
    width = F.lit(seconds * 1_000_000)
    at, mark = micros("ts"), micros("marker_ts")
    spread = markers.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(mark / width) + k)))
    joined = spread.join(samples.withColumn("bucket", F.floor(at / width)), [*by, "bucket"])
    return joined.where(F.abs(at - mark) <= width).drop("bucket")


def stall_windows(markers: DataFrame, samples: DataFrame, seconds: int = STALL_SECONDS, *by: str) -> DataFrame:
    """Loss and round-trip times around each marker; markers without samples have zero of them.

    Samples go to the time buckets of their marker's width whose windows can hold them, at most three; there they are sorted
    once for all markers, so that what is shuffled grows with the samples and not with their pairs with markers. A task
    holds the samples of three buckets. Markers that share an id are one window of all their pairs, made as in near().
    """
    width = seconds * 1_000_000
    alone = markers.withColumn("__n", F.count("*").over(Window.partitionBy("marker_id")))
    shared = alone.where("__n > 1").drop("__n")
    bucket = lambda at: F.floor(at / F.lit(width))
    given = reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.lit(True))
    asked = alone.where(given & (F.col("__n") == 1) & F.col("marker_ts").isNotNull()).select(*by, bucket(micros("marker_ts")).alias("bucket"), "marker_id", micros("marker_ts").alias("at"))
    # a window's ends are 1.0 widths away: it reaches into the buckets beside its own, and no further
    at = micros("ts")
    held = samples.where(given & F.col("ts").isNotNull()).select(*by, F.explode(F.array(*(bucket(at) + k for k in (-1, 0, 1)))).alias("bucket"), at.alias("at"), F.col("ms").cast("double").alias("ms"), F.coalesce("lost", F.lit(False)).alias("lost"))
    kind = markers.schema["marker_id"].dataType
    schema = StructType([StructField("marker_id", kind), *(StructField(n, LongType()) for n in ("samples", "lost")), *(StructField(n, DoubleType()) for n in ("p95_ms", "max_ms"))])

    def meet(own: pa.Table, near_: pa.Table) -> pa.Table:
        return _windows(own, near_, width)

    found = asked.groupBy(*by, "bucket").cogroup(held.groupBy(*by, "bucket")).applyInArrow(meet, schema)
    found = found.select("marker_id", "samples", "lost", F.round(100.0 * F.col("lost") / F.col("samples"), 1).alias("loss_pct"), "p95_ms", "max_ms")
    pairs = _window_stats(near(shared, samples.withColumn("ms", F.col("ms").cast("double")), seconds, *by))
    out = markers.join(found.unionByName(pairs), "marker_id", "left")
    return out.na.fill(0, ["samples", "lost"]).na.fill(0.0, ["loss_pct"])


def _windows(markers: pa.Table, samples: pa.Table, width: int) -> pa.Table:
    """Counts, nearest-rank p95 and largest value of the samples around each marker of a bucket; values that are no number are the largest, as in Spark."""
    rows = []
    if markers.num_rows and samples.num_rows:
        at = samples["at"].to_numpy()
        order = np.argsort(at, kind="stable")
        at, ms, lost = at[order], samples["ms"].to_numpy()[order], samples["lost"].to_numpy()[order]
        there = samples["ms"].is_valid().to_numpy()[order]
        losses, known = (np.concatenate(([0], np.cumsum(x))) for x in (lost, there))
        values, made = ms[there], {}
        for id_, mark in zip(markers["marker_id"].to_pylist(), markers["at"].to_pylist()):
            if mark not in made:
                a, b = np.searchsorted(at, mark - width, "left"), np.searchsorted(at, mark + width, "right")
                own = values[known[a] : known[b]]
                k = max(0, math.ceil(0.95 * len(own)) - 1)
                made[mark] = (int(b - a), int(losses[b] - losses[a]), float(np.partition(own, k)[k]) if len(own) else None, float(own.max()) if len(own) else None)
            if made[mark][0]:
                rows.append((id_, *made[mark]))
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (markers.schema.field("marker_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("marker_id", "samples", "lost", "p95_ms", "max_ms"), columns, kinds)})


def around(markers: DataFrame, pairs: DataFrame) -> DataFrame:
    """stall_windows() of samples that were met with their markers before. A window holds some seconds of samples, which one task can sort."""
    out = markers.join(_window_stats(pairs), "marker_id", "left")
    return out.na.fill(0, ["samples", "lost"]).na.fill(0.0, ["loss_pct"])


def _window_stats(pairs: DataFrame) -> DataFrame:
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms")
    return pairs.groupBy("marker_id").agg(
        F.count("*").alias("samples"), F.count_if("lost").alias("lost"), F.round(100.0 * F.count_if("lost") / F.count("*"), 1).alias("loss_pct"), p95, F.max("ms").alias("max_ms")
    )


def unpivoted_counters(wide: DataFrame) -> DataFrame:
    """(ts, counter, value) of a counter table whose first column is the time, as MM/dd/yyyy HH:mm:ss.SSS."""
    first, *rest = wide.columns
    ts = F.try_to_timestamp(F.col(f"`{first}`"), F.lit("MM/dd/yyyy HH:mm:ss.SSS")).alias("ts")
    made = wide.select(ts, *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in rest))
    return made.unpivot(["ts"], [F.col(f"`{c}`") for c in rest], "counter", "value").where("value IS NOT NULL")


def counter_stats(values: DataFrame, *by: str, most: int = MOST_HELD) -> DataFrame:
    """n, mean, p95, p99, largest value and its first time by counter; percentiles are exact, and no task holds all values of one."""
    peak = F.struct(F.col("value"), (-micros("ts")).alias("t"))
    out = values.groupBy(*by, "counter").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.max_by("ts", peak).alias("max_at"))
    return with_percentiles(out, values, "value", {"p95": 0.95, "p99": 0.99}, [*by, "counter"], most)


def short_name(counter: Column) -> Column:
    return F.regexp_replace(counter, r"^\\\\[^\\]+", "")


def is_process(counter: Column) -> Column:
    return counter.rlike(r"\\Process\(.*% Processor Time") & ~counter.rlike(r"\((_Total|Idle)\)")


def red_flags(stats: DataFrame, seconds: float = 0.05) -> DataFrame:
    """Disk latencies whose p99 is above the limit."""
    return stats.where(F.col("counter").rlike(r"Avg\. Disk sec/") & (F.col("p99") > seconds))


def top_processes(stats: DataFrame, limit: int = 15) -> DataFrame:
    """The busiest processes by p99 (a top-k report)."""
    return stats.where(is_process(F.col("counter"))).orderBy(F.desc("p99"), "counter").limit(limit)


def counters_at_stalls(markers: DataFrame, values: DataFrame, seconds: int = STALL_SECONDS, top: int = 8) -> DataFrame:
    """For each marker the counters whose window maximum stands out most against their p95 of the whole run."""
    run = percentiles(values, "value", {"run_p95": 0.95}, "counter")
    found = near(markers, values, seconds).groupBy("marker_id", "counter").agg(F.max("value").alias("window_max"))
    found = found.join(run, "counter")
    ratio = F.when(F.coalesce("run_p95", F.lit(0.0)) != 0, F.col("window_max") / F.greatest("run_p95", F.lit(1e-9))).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("marker_id").orderBy(F.desc("ratio"), "counter"))
    return found.withColumn("ratio", ratio).withColumn("rank", rank).where(F.col("rank") <= top)


def report(summary: DataFrame, bursts: DataFrame) -> str:
    """A short text of one run's summary and bursts; both are small."""
    r = summary.first()
    lines = [f"Packet loss {r['lost']} / {r['samples']} = {r['loss_pct']}%", f"RTT median {r['median_ms']} ms, p95 {r['p95_ms']} ms, p99 {r['p99_ms']} ms, max {r['max_ms']} ms"]
    return "\n".join(lines + [f"burst at {b['start']}: {b['losses']} losses" for b in bursts.orderBy("start").collect()])
