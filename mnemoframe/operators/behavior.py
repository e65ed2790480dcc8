"""Behaviour over time: drift, absence, cycles, sessions, transitions, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def drift(events: DataFrame, now: str, least_short: int = 10, least_long: int = 20) -> DataFrame:
    """Jensen-Shannon divergence (bits) of a user's last 7 days' topics from the last 30 days'."""
    at = F.lit(now).cast("timestamp")
    recent = events.where((F.col("ts") > at - F.expr("interval 30 days")) & (F.col("ts") <= at))
    counts = recent.groupBy("user_id", "event_type").agg(F.count(F.when(F.col("ts") > at - F.expr("interval 7 days"), 1)).alias("s"), F.count("*").alias("l"))
    by = Window.partitionBy("user_id")
    p, q = F.col("s") / F.col("ts_"), F.col("l") / F.col("tl_")
    m = (p + q) / 2
    rows = counts.withColumn("ts_", F.sum("s").over(by)).withColumn("tl_", F.sum("l").over(by)).where((F.col("ts_") >= least_short) & (F.col("tl_") >= least_long))
    return rows.groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.when(F.col("s") > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + 0.5 * q * F.log2(q / m)))), 6).alias("jsd"))


def absences(events: DataFrame, now: str) -> DataFrame:
    """Topics of a user with none in the last two weeks though two or more in weeks before; per-week average."""
    at = F.lit(now).cast("timestamp")
    age = F.datediff(at, F.col("ts"))
    out = events.groupBy("user_id", "event_type").agg(F.count(F.when(age < 14, 1)).alias("recent"), F.count(F.when(age.between(14, 55), 1)).alias("earlier")).where("recent = 0 and earlier >= 3")
    return out.select("user_id", "event_type", "earlier", F.round(F.col("earlier") / 6, 6).alias("per_week"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Gap sessions of each user: number, start, end and size."""
    new = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_user())) > gap_minutes * 60) | F.lag("ts").over(by_user()).isNull()
    rows = events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(by_user()))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))


def transitions(events: DataFrame, least: int = 3) -> DataFrame:
    """A to B counts (A other than B) and the boost 1 + P(B | A) / 2 where counted ``least`` times."""
    steps = events.select("event_type", F.lead("event_type").over(by_user()).alias("to")).where("`to` is not null and event_type <> `to`").groupBy(F.col("event_type").alias("from"), "to").agg(F.count("*").alias("n"))
    return steps.withColumn("boost", F.round(F.when(F.col("n") >= least, 1 + 0.5 * F.col("n") / F.sum("n").over(Window.partitionBy("from"))).otherwise(1.0), 6))


def learning_curve(events: DataFrame, size: int = 5) -> DataFrame:
    """Power law of a user's mean value over windows of ``size`` events: log-log least squares slope."""
    rows = events.where("value > 0").withColumn("_k", F.row_number().over(by_user()) - 1).groupBy("user_id", F.floor(F.col("_k") / size).alias("w")).agg(F.avg("value").alias("v"), F.count("*").alias("n")).where(F.col("n") == size)
    return rows.groupBy("user_id").agg(F.round(F.regr_slope(F.log("v"), F.log(F.col("w") + 1)), 6).alias("slope"), F.count("*").alias("n_windows")).where("n_windows >= 3")


def exponential_average(events: DataFrame, alpha: float = 0.15, last: int = 20) -> DataFrame:
    """EWMA over each user's last ``last`` values, oldest first, beginning with the oldest."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = events.where("value is not null").withColumn("_r", rank).where(F.col("_r") <= last)
    n = F.max("_r").over(Window.partitionBy("user_id"))
    weight = F.when(F.col("_r") == n, F.pow(F.lit(1 - alpha), n - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("_r") - 1))
    return rows.withColumn("_w", weight).groupBy("user_id").agg(F.round(F.sum(F.col("_w") * F.col("value")), 6).alias("ewma"))


def cycles(events: DataFrame) -> DataFrame:
    """Weekday peaks of a topic: five events or more, the peak at least three and over twice the daily mean."""
    days = events.groupBy("user_id", "event_type", F.weekday("ts").alias("day")).agg(F.count("*").alias("n"))
    out = days.groupBy("user_id", "event_type").agg(F.sum("n").alias("total"), F.max("n").alias("peak"), F.max_by("day", F.struct("n", -F.col("day"))).alias("peak_day")).where("total >= 5 and peak >= 3 and peak > 2 * total / 7")
    return out.withColumn("confidence", F.round(F.least(F.lit(0.9), (F.col("peak") / F.col("total") - 1 / 7) * 3), 6))


def hour_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "hour"))).where("rank <= 3")


def mood_trend(events: DataFrame) -> DataFrame:
    """Mean of the later half of a user's values minus that of the earlier half."""
    half = F.ntile(2).over(by_user())
    rows = events.where("value is not null").withColumn("_h", half)
    delta = F.avg(F.when(F.col("_h") == 2, F.col("value"))) - F.avg(F.when(F.col("_h") == 1, F.col("value")))
    return rows.groupBy("user_id").agg(F.round(delta, 6).alias("delta")).withColumn("trend", F.when(F.col("delta") > 0.15, "rising").when(F.col("delta") < -0.15, "falling").otherwise("stable"))


def usage_rollup(events: DataFrame) -> DataFrame:
    """Events and value per day, with a total row of null day."""
    return events.rollup(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value"))


def domain_quality(events: DataFrame) -> DataFrame:
    """Mean value, Laplace rate of low values, and weak domains."""
    out = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("quality"), F.count(F.when(F.col("value") < 10, 1)).alias("low"))
    return out.withColumn("rate", F.round(100 * (F.col("low") + 1) / (F.col("n") + 2), 6)).withColumn("weak", (F.col("n") >= 5) & (F.col("rate") > 10))


def style_entropy(events: DataFrame, bins: int = 8, top: float = 400.0) -> DataFrame:
    """Shannon entropy (bits) of a user's values in equal bins."""
    counts = events.where("value is not null").groupBy("user_id", F.least(F.lit(bins - 1), F.floor(F.col("value") * bins / top)).alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("user_id"))).groupBy("user_id").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


def trigram_succession(events: DataFrame) -> DataFrame:
    """Order-2 contexts: counts of the third topic after two, at least two times."""
    one, two = F.lag("event_type", 2).over(by_user()), F.lag("event_type", 1).over(by_user())
    return events.select(one.alias("a"), two.alias("b"), F.col("event_type").alias("c")).where("a is not null").groupBy("a", "b", "c").agg(F.count("*").alias("n")).where("n >= 2")
