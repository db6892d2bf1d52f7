"""Recordings made of the driver tables.

``line``: a sample for each order (order keys are dense), five channels, gaps
where an order has no lines. ``events``: hourly means of the event types as
channels, a site for each third of the users, a measurement for each half of
the month, gaps where an hour has no event.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.operators.params import DecimationSetup, Recording, WindowSetup
from tellura.operators.timeops import InterpolateNans, RemoveMean, TimeData

FS, FIRST, REF = 16.0, "2024-01-01 00:00:10", "2024-01-01 00:00:00"
CHANS = ("Ex", "Ey", "Hx", "Hy", "Hz")
HOURS = {"click": "Hx", "error": "Hy", "purchase": "Hz", "signup": "Ex", "view": "Ey"}
SETUP = DecimationSetup(n_levels=1, per_level=5)
EVENT_FS = 1 / 3600
#: Rows of orders and lines that a task which takes their means gets on average. With more than 200 tasks (``bypassMergeThreshold``) those that deal the rows hold their split's in memory.
TASK_ROWS = 3 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> TimeData:
    """Rows are dealt by order before any mean is taken: partial means of a split would hold an entry for each order the split has a line of."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n_orders = orders.count()
    n_parts = max(spark.sparkContext.defaultParallelism, -(-(n_orders + lines.count()) // TASK_ROWS))
    means = lines.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").repartition(n_parts, "l_orderkey").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("Ex"), (F.avg("l_extendedprice") / 977).alias("Ey"), (F.avg("l_discount") * 100).alias("Hx"), (F.avg("l_tax") * 100).alias("Hy")
    )
    totals = orders.select("o_orderkey", (F.col("o_totalprice") / 9973).alias("Hz")).repartition(n_parts, "o_orderkey")
    wide = totals.join(means, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    chans = F.array(*[F.struct(F.lit(c).alias("chan"), F.coalesce(F.col(c), F.lit(float("nan"))).alias("value")) for c in CHANS])
    df = wide.select(F.lit("line").alias("site"), F.lit("all").alias("meas"), F.lit(0).alias("level"), F.explode(chans).alias("c"), F.col("o_orderkey").alias("sample"))
    df = df.select("site", "meas", "level", "c.chan", "sample", "c.value")
    return TimeData(df, (Recording("line", "all", FS, n_orders, FIRST, CHANS),))


def line_clean(spark: SparkSession, sf_dir: str) -> TimeData:
    return RemoveMean().run(InterpolateNans().run(line(spark, sf_dir)))


@lru_cache(maxsize=8)
def window_sizes() -> tuple[int, int]:
    sized = WindowSetup().run(1, [FS])
    return sized.win_size(0), sized.olap_size(0)


def events(spark: SparkSession, sf_dir: str) -> TimeData:
    """Days 1 to 15 are measurement m0, 16 to 30 m1; site s<user modulo 3>; a sample each hour."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200 * 1_000_000) / (3600 * 1_000_000)).cast("long")
    rows = table(spark, sf_dir, "events").where("ts is not null").select(F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("site"), hour.alias("hour"), "event_type", "value")
    kind = F.lit(None).cast("string")
    for event, chan in HOURS.items():
        kind = F.when(F.col("event_type") == event, chan).otherwise(kind)
    half = F.least(F.floor(F.col("hour") / 360), F.lit(1))
    means = rows.withColumn("chan", kind).withColumn("half", half).groupBy("site", "half", "chan", "hour").agg(F.avg("value").alias("value"))
    # the spine: every hour of every recording
    spark_rows = [(f"s{s}", h, c) for s in range(3) for h in range(2) for c in CHANS]
    spine = F.broadcast(spark.createDataFrame(spark_rows, "site string, half long, chan string"))  # 30 rows
    hours = spine.withColumn("hour", F.explode(F.sequence(F.col("half") * 360, F.col("half") * 360 + 359)))
    df = hours.join(means, ["site", "half", "chan", "hour"], "left").select(
        "site", F.concat(F.lit("m"), F.col("half")).alias("meas"), F.lit(0).alias("level"), "chan", (F.col("hour") - F.col("half") * 360).alias("sample"), F.coalesce("value", F.lit(float("nan"))).alias("value")
    )
    starts = {0: "2024-01-01 00:00:00", 1: "2024-01-16 00:00:00"}
    return TimeData(df, tuple(Recording(f"s{s}", f"m{h}", EVENT_FS, 360, starts[h], CHANS) for s in range(3) for h in range(2)))
