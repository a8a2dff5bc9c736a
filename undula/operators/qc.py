"""Delivery quality control: measurements of tracks against target profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delivery targets (lufs range, true peak ceiling, least loudness range, head silence ms, tail silence s, rate, least bit depth).
TARGETS = [
    ("spotify", -15.0, -13.0, -1.0, 0.0, 100.0, 700.0, 1.0, 3.0, None, None),
    ("apple_music", -17.0, -15.0, -1.0, 0.0, 100.0, 700.0, 1.0, 3.0, None, None),
    ("youtube", -15.0, -13.0, -1.0, 0.0, 0.0, 1000.0, 0.0, 5.0, None, None),
    ("broadcast_ebu_r128", -23.5, -22.5, -1.0, 4.0, 0.0, 1000.0, 0.0, 5.0, None, None),
    ("cd_master", -12.0, -8.0, -0.3, 0.0, 0.0, 500.0, 2.0, 5.0, 44100, 16),
]
TARGET_SCHEMA = "target string, lufs_lo double, lufs_hi double, peak_max double, lra_min double, head_lo double, head_hi double, tail_lo double, tail_hi double, rate_is int, depth_min int"


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, TARGET_SCHEMA)


def ladder(ok: Column, near: Column, worst: str = "FAIL") -> Column:
    return F.when(ok, "PASS").when(near, "WARN").otherwise(worst)


def checks(measured: DataFrame) -> DataFrame:
    """measured (track, lufs, true_peak, lra, clipped, dc, n_clicks, phase_negative_pct, imbalance_db, head_ms, tail_sec, rate,
    depth) against every target: track, target, name, value, status. Measures that don't apply give no row."""
    c = F.col
    inside = lambda v, lo, hi: (v >= lo) & (v <= hi)
    rows = [
        ("integrated_lufs", c("lufs"), F.lit(True), F.when(c("lufs").isNull(), "FAIL").otherwise(ladder(inside(c("lufs"), c("lufs_lo"), c("lufs_hi")), inside(c("lufs"), c("lufs_lo") - 0.5, c("lufs_hi") + 0.5)))),
        ("true_peak_dbtp", c("true_peak"), F.lit(True), F.when(c("true_peak").isNull(), "PASS").otherwise(ladder(c("true_peak") <= c("peak_max"), c("true_peak") <= c("peak_max") + 0.3))),
        ("loudness_range_lu", F.coalesce("lra", F.lit(0.0)), c("lra_min") > 0, F.when(F.coalesce("lra", F.lit(0.0)) >= c("lra_min"), "PASS").otherwise("WARN")),
        ("clipping_samples", c("clipped").cast("double"), F.lit(True), ladder(c("clipped") == 0, c("clipped") < 5)),
        ("dc_offset", c("dc"), F.lit(True), ladder(c("dc") < 0.001, c("dc") < 0.01)),
        ("clicks", c("n_clicks").cast("double"), F.lit(True), ladder(c("n_clicks") == 0, c("n_clicks") < 3)),
        ("phase_correlation", c("phase_negative_pct"), c("phase_negative_pct").isNotNull(), ladder(c("phase_negative_pct") < 5, c("phase_negative_pct") < 20)),
        ("channel_imbalance_db", c("imbalance_db"), c("imbalance_db").isNotNull(), ladder(F.abs("imbalance_db") < 0.5, F.abs("imbalance_db") < 1.5)),
        ("head_silence_ms", c("head_ms"), F.lit(True), F.when(c("head_ms").isNull(), "FAIL").otherwise(F.when(inside(c("head_ms"), c("head_lo"), c("head_hi")), "PASS").otherwise("WARN"))),
        ("tail_silence_sec", c("tail_sec"), F.lit(True), F.when(c("tail_sec").isNull(), "FAIL").otherwise(F.when(inside(c("tail_sec"), c("tail_lo"), c("tail_hi")), "PASS").otherwise("WARN"))),
        ("sample_rate", c("rate").cast("double"), c("rate").isNotNull() & c("rate_is").isNotNull(), F.when(c("rate") == c("rate_is"), "PASS").otherwise("FAIL")),
        ("bit_depth", c("depth").cast("double"), c("depth").isNotNull() & c("depth_min").isNotNull(), F.when(c("depth") >= c("depth_min"), "PASS").otherwise("FAIL")),
    ]
    made = F.array(*(F.when(applies, F.struct(F.lit(name).alias("name"), value.alias("value"), status.alias("status"))) for name, value, applies, status in rows))
    joined = measured.crossJoin(F.broadcast(targets(measured.sparkSession)))  # five profiles
    return joined.select("track", "target", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("c")).select("track", "target", "c.*")


def verdicts(found: DataFrame) -> DataFrame:
    """track, target, verdict (the worst status), n_pass, n_warn, n_fail."""
    n = lambda s: F.count_if(F.col("status") == s)
    d = found.groupBy("track", "target").agg(n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail"))
    return d.withColumn("verdict", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))
