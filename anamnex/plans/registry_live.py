"""Registered queries of a live log, fed in several micro-batches with late lines, and of percentiles by selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics
from ..streaming import live
from . import sql
from .bridge import view
from .registry import query
from .scratch import fresh_dir

#: Stretches of time in which the lines come, and files of each.
STRETCHES, FILES = 3, 4
WINDOW = 6 * 3600


def _host() -> Column:
    return F.regexp_extract("value", r"host=(\S+)", 1)


def _log(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A folder of log files, written stretch by stretch, and the delay of its lines: what was lost is told one stretch late.

    At the end each host answers once more, too late for any marker's window, and long after that one line of another host
    moves the watermark past it.
    """
    samples = view(spark, sf_dir, "sample")
    first, last = samples.select(F.unix_millis(F.min("ts").cast("timestamp")), F.unix_millis(F.max("ts").cast("timestamp"))).first()
    step = (last - first) // STRETCHES + 1
    stamp = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
    answer = F.when(F.col("lost"), "Request timed out.").otherwise(F.concat(F.lit("Reply: time="), F.floor("ms").cast("string"), F.lit("ms")))
    head = F.concat(stamp(F.col("ts")), F.lit("  host="), F.col("host").cast("string"), F.lit(" "))
    nth = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - first) / step)
    lines = samples.select((nth + F.col("lost").cast("int")).alias("batch"), F.concat(head, answer).alias("value"))
    marks = samples.where("marker").select(nth.alias("batch"), F.concat(head, F.lit("### STALL MARKER ### "), F.col("sample_id").cast("string")).alias("value"))
    after = lambda ms: stamp(F.timestamp_millis(F.lit(last + ms)))
    closed = 1000 * WINDOW + 1000
    closing = samples.select("host").distinct().select(F.lit(STRETCHES + 1).alias("batch"), F.concat(after(closed), F.lit("  host="), F.col("host").cast("string"), F.lit(" Reply: time=1ms")).alias("value"))
    end = spark.range(1).select(F.lit(STRETCHES + 2).alias("batch"), F.concat(after(closed + 4 * step), F.lit("  host=end Reply: time=1ms")).alias("value"))
    log = lines.unionByName(marks).unionByName(closing).unionByName(end)
    folder = f"{fresh_dir(spark)}/log"
    for batch in range(STRETCHES + 3):
        log.where(F.col("batch") == batch).select("value").repartition(FILES).write.mode("append").text(folder)
    return folder, f"{2 * step // 1000 + 1} seconds"


_LOGGED = "logged AS (SELECT sample_id, host, epoch_us(ts) // 1000 AS t, lost, CASE WHEN NOT lost THEN floor(ms) END AS ms, marker FROM sample)"


@query(sql.with_views(f""", {_LOGGED} SELECT CAST(host AS VARCHAR) AS host, min(t) AS start_ms, count(*) AS losses
  FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, lost) - row_number() OVER (PARTITION BY host, lost ORDER BY t) AS island FROM logged) WHERE lost GROUP BY host, island HAVING count(*) >= 2""", "sample"))  # fmt: skip
def live_loss_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of losses told while the log comes in, across micro-batches, with all losses a stretch late."""
    folder, delay = _log(spark, sf_dir)
    out, own = fresh_dir(spark), live.with_rocksdb(spark)
    live.appended(live.loss_runs(live.live_samples(own, folder, delay, _host(), FILES)), f"{out}/runs", f"{out}/state").awaitTermination()
    return spark.read.schema(live.RUNS).parquet(f"{out}/runs").select("host", F.unix_millis("start").alias("start_ms"), "losses")


@query(sql.with_views(f""", {_LOGGED} SELECT m.sample_id AS marker_id, count(*) AS samples, count(*) FILTER (WHERE s.lost) AS lost, round(100.0 * count(*) FILTER (WHERE s.lost) / count(*), 1) AS loss_pct,
  quantile_disc(s.ms, 0.95) AS p95_ms, max(s.ms) AS max_ms FROM logged m JOIN logged s ON m.host = s.host AND abs(m.t - s.t) <= {WINDOW * 1000} WHERE m.marker GROUP BY 1""", "sample"))  # fmt: skip
def live_stall_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples around each marker of the same host, by a join of two live streams."""
    folder, delay = _log(spark, sf_dir)
    out, own = fresh_dir(spark), live.with_rocksdb(spark)
    stream = lambda: live.live_samples(own, folder, delay, _host(), FILES)
    live.appended(live.stalls(live.marker_stream(stream()), stream(), WINDOW), f"{out}/pairs", f"{out}/state").awaitTermination()
    pairs = spark.read.schema("host string, marker_ts timestamp, note string, ts timestamp, ms double, lost boolean").parquet(f"{out}/pairs").withColumn("marker_id", F.col("note").cast("long"))
    return diagnostics.around(pairs.select("marker_id").distinct(), pairs.drop("note"))


_BY_HOST = "SELECT host AS of, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM (SELECT user_id AS host, value FROM events WHERE value IS NOT NULL) GROUP BY 1"


@query(f"SELECT CAST(of AS VARCHAR) AS of, n, p50, p95, p99 FROM ({_BY_HOST}) UNION ALL SELECT * FROM ({_BY_HOST.replace('user_id AS host', 'event_type AS host')})")
def percentiles_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each host and each counter by selection, with at most 50 and 500 values of a group held at once."""
    events, shares = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}

    def of(column: str, most: int) -> DataFrame:
        rows = events.select(F.col(column).cast("string").alias("of"), "value")
        return diagnostics.with_percentiles(rows.groupBy("of").agg(F.count("*").alias("n")), rows, "value", shares, ["of"], most)

    return of("user_id", 50).unionByName(of("event_type", 500))
