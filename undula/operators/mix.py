"""Mixing of tracks, gain recommendation and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.functions.columns import from_db
from undula.operators.edits import pan_factor

#: Instrument groups in order with their keywords, levels within a group, balance between groups.
KEYWORDS = [
    ("drums", "kick snare tom hihat hi-hat hat overhead oh cymbal ride crash clap room drum tambourine shaker perc"), ("bass", "bass"), ("guitars", "gtr guitar elecgtr acougtr"),
    ("keys", "keys piano organ synth pad rhodes"), ("vocals", "vox vocal leadvox backing chorus bv"),
]
LEVELS = {
    "drums": {"kick": 0.0, "snare": -3.0, "tom": -5.0, "overhead": -8.0, "hihat": -10.0, "cymbal": -10.0, "ride": -10.0, "crash": -10.0, "clap": -6.0, "room": -12.0, "tambourine": -12.0, "shaker": -14.0, "perc": -10.0, "": -6.0},
    "vocals": {"lead": 0.0, "leadvox": 0.0, "": -4.0},
}
BALANCE = {"drums": 0.0, "bass": 2.0, "guitars": 0.0, "keys": -6.0, "vocals": 4.0, "other": -8.0}
#: Band levels of reference mixes (sub, low, mid, high), by profile.
PROFILES = {
    "electronica": (-25.5, -28.4, -29.3, -33.1),
    "pop": (-25.6, -25.9, -27.3, -35.3),
    "rock": (-25.3, -25.9, -27.6, -36.2),
    "default": (-25.4, -26.6, -28.0, -35.1),
    "yt_rock": (-25.0, -32.6, -36.9, -47.8),
    "yt_bright_pop": (-26.1, -27.1, -32.0, -46.9),
    "yt_hiphop": (-25.0, -37.6, -45.3, -54.4),
    "yt_mid_scoop": (-25.2, -29.6, -41.1, -54.1),
    "yt_low_heavy_vocal": (-30.7, -25.3, -36.1, -50.6),
    "yt_high_dr": (-25.1, -31.6, -36.8, -48.4),
    "yt_ballad": (-44.0, -26.0, -31.7, -51.6),
    "yt_dark_lofi": (-27.3, -30.7, -45.1, -70.8),
    "archive_techno_standard": (-25.0, -36.7, -42.6, -51.8),
    "archive_sub_kick_driven": (-25.0, -43.9, -47.5, -57.3),
    "archive_minimal_sub": (-25.0, -42.3, -53.7, -57.0),
    "archive_groovy_low": (-26.0, -27.9, -37.2, -49.3),
    "archive_dub_techno": (-25.3, -41.0, -56.8, -78.8),
    "archive_midrange_ambient": (-42.5, -26.1, -31.2, -49.4),
}
MIN_GAIN, MAX_GAIN = -24.0, 12.0


def active(config: DataFrame) -> DataFrame:
    """config (mix, track, mute, solo, ...) without muted tracks; if a mix has soloed ones, only these. Mute beats solo."""
    solo = F.max("solo").over(Window.partitionBy("mix"))
    return config.withColumn("any_solo", solo).filter(~F.col("mute") & (F.col("solo") | ~F.col("any_solo"))).drop("any_solo")


def mixed(samples: DataFrame, config: DataFrame) -> DataFrame:
    """mix, channel, i, x: tracks shifted, weighted and summed. Sums are taken on the map side first."""
    on = active(config).select("mix", "track", "gain_db", "pan", "shift")
    factor = from_db(F.col("gain_db")) * pan_factor(F.col("pan"), F.col("channel"))
    d = samples.join(on, "track").select("mix", "channel", (F.col("i") + F.col("shift")).alias("i"), (F.col("x") * factor).alias("x"))
    return d.groupBy("mix", "channel", "i").agg(F.sum("x").alias("x"))


def clip_flags(mix: DataFrame) -> DataFrame:
    """mix, peak, clipped (peak above full scale)."""
    return mix.groupBy("mix").agg(F.max(F.abs("x")).alias("peak")).withColumn("clipped", F.col("peak") > 1.0)


def plain(name):
    """A track name as keywords are matched in it."""
    return F.regexp_replace(F.lower(name), "[-_ ]", "")


def classified(tracks: DataFrame) -> DataFrame:
    """tracks (name, ...) with group: the first one, in order, with a keyword in the name, else other."""
    name, group = plain(F.col("name")), F.lit(None).cast("string")
    for kind, words in KEYWORDS:
        hit = F.lit(False)
        for w in words.split():
            hit = hit | name.contains(w)
        group = F.coalesce(group, F.when(hit, kind))
    return tracks.withColumn("group", F.coalesce(group, F.lit("other")))


def relative_levels(spark: SparkSession) -> DataFrame:
    rows = [(g, k, v, i) for g, levels in LEVELS.items() for i, (k, v) in enumerate(levels.items())]
    return F.broadcast(spark.createDataFrame(rows, "group string, keyword string, level double, place int"))  # two dozen rows


def with_relative(tracks: DataFrame) -> DataFrame:
    """tracks (group, name, ...) with relative: the level of the longest keyword in the name, the first of equals, else the group's own."""
    levels = relative_levels(tracks.sparkSession)
    best = tracks.join(levels, "group", "left").filter(F.col("keyword").isNull() | plain(F.col("name")).contains(F.col("keyword")))
    keys = tracks.columns
    order = Window.partitionBy("mix", "track").orderBy(F.length("keyword").desc_nulls_last(), "place")
    return best.withColumn("k", F.row_number().over(order)).filter("k = 1").select(*keys, F.coalesce("level", F.lit(0.0)).alias("relative"))


def power(db) -> object:
    return F.pow(F.lit(10.0), db / 10)


def recommended(tracks: DataFrame, levels: DataFrame, target: list[float], grouped: bool = True) -> DataFrame:
    """mix, track, group, gain_db (one digit), exact (unrounded). tracks: mix, track, name, rms_db; levels: mix, track, power over
    all bands. Within a group to its loudest plus the relative level, groups to the balance against drums (else the loudest group),
    everything to the target's power; clipped. Not grouped: every track to its share of the target."""
    total = sum(10 ** (t / 10) for t in target)
    d = tracks.join(levels.select("mix", "track", "power"), ["mix", "track"])
    mix = Window.partitionBy("mix")
    if not grouped:
        d = d.withColumn("g", F.when(F.col("power") > 1e-20, 10 * F.log10(F.lit(total) / F.count("*").over(mix) / F.col("power"))).otherwise(0.0)).withColumn("group", F.lit(None).cast("string"))
    else:
        d = with_relative(classified(d))
        group = Window.partitionBy("mix", "group")
        d = d.withColumn("g", F.max("rms_db").over(group) + F.col("relative") - F.col("rms_db"))
        d = d.withColumn("group_db", 10 * F.log10(F.greatest(F.sum(power(F.col("rms_db") + F.col("g"))).over(group), F.lit(1e-20))))
        drums = F.max(F.col("group") == "drums").over(mix)
        place = F.element_at(F.create_map(*(F.lit(x) for i, g in enumerate([*(k for k, _ in KEYWORDS), "other"]) for x in (g, i))), F.col("group"))
        top = F.max(F.struct("group_db", (-place).alias("p"), "group")).over(mix)
        d = d.withColumn("ref", F.when(drums, "drums").otherwise(top["group"]))
        d = d.withColumn("ref_db", F.max(F.when(F.col("group") == F.col("ref"), F.col("group_db"))).over(mix))
        balance = F.create_map(*(F.lit(x) for pair in BALANCE.items() for x in pair))
        d = d.withColumn("g", F.col("g") + F.when(F.col("group") == F.col("ref"), 0.0).otherwise(balance[F.col("group")] - balance[F.col("ref")] - (F.col("group_db") - F.col("ref_db"))))
        d = d.withColumn("mix_power", F.sum(F.col("power") * power(F.col("g"))).over(mix))
        d = d.withColumn("g", F.col("g") + F.when(F.col("mix_power") > 1e-20, 10 * F.log10(F.lit(total) / F.col("mix_power"))).otherwise(0.0))
    exact = F.greatest(F.lit(MIN_GAIN), F.least(F.lit(MAX_GAIN), F.col("g")))
    return d.select("mix", "track", "group", F.round(exact, 1).alias("gain_db"), exact.alias("exact"))


def residual(gains: DataFrame, band_levels: DataFrame, target: dict[str, float]) -> DataFrame:
    """mix, residual_db: mean squared distance of the mix's band powers from the target's, by the unrounded gains."""
    goal = F.create_map(*(F.lit(x) for pair in target.items() for x in pair))
    bands = band_levels.join(gains.select("mix", "track", "exact"), ["mix", "track"]).groupBy("mix", "band").agg(F.sum(power(F.col("level") + F.col("exact"))).alias("p"))
    return bands.groupBy("mix").agg((10 * F.log10(F.greatest(F.avg(F.pow(F.col("p") - power(goal[F.col("band")]), 2)), F.lit(1e-20)))).alias("residual_db"))


def pink_profile(edges: list[tuple[float, float]], level: float = -20.0) -> list[float]:
    """3 dB less per octave, from the first band's centre (geometric mean)."""
    import math

    centre = [math.sqrt(a * b) for a, b in edges]
    return [level - 10 * math.log10(c / centre[0]) for c in centre]


def target_levels(name: str, bands: list[tuple[float, float, str]], level: float = -20.0) -> dict[str, float]:
    """Band levels to aim at: those of a profile, else pink noise at a level."""
    values = PROFILES.get(name) or pink_profile([b[:2] for b in bands], level)
    return {b[2]: float(v) for b, v in zip(bands, values, strict=True)}


def measured_target(band_levels: DataFrame, track) -> dict[str, float]:
    """The band levels of a reference track, a handful of rows, to aim at."""
    return {r["band"]: r["level"] for r in band_levels.filter(F.col("track") == track).select("band", "level").collect()}


def recommendation(tracks: DataFrame, band_levels: DataFrame, target: dict[str, float], grouped: bool = True) -> tuple[DataFrame, DataFrame]:
    """(gains, mixes): the whole recommendation. gains: mix, track, group, gain_db, exact, rms_db and a column for each band, one
    digit; mixes: mix, residual_db (one digit), n. tracks: mix, track, name, rms_db; band_levels: mix, track, band, level."""
    total = band_levels.groupBy("mix", "track").agg(F.sum(power(F.col("level"))).alias("power"))
    gains = recommended(tracks, total, list(target.values()), grouped)
    wide = band_levels.groupBy("mix", "track").agg(*(F.round(F.max(F.when(F.col("band") == b, F.col("level"))), 1).alias(b) for b in target))
    own = tracks.select("mix", "track", F.round("rms_db", 1).alias("rms_db"))
    mixes = residual(gains, band_levels, target).select("mix", F.round("residual_db", 1).alias("residual_db")).join(gains.groupBy("mix").agg(F.count("*").alias("n")), "mix")
    return gains.join(own, ["mix", "track"]).join(wide, ["mix", "track"]), mixes


def mixdown(samples: DataFrame, config: DataFrame, gains: DataFrame, latency: int = 0) -> DataFrame:
    """mix, channel, i, x: the mix with each track at its recommended gain (its own where there is none), moved back by the latency of the master chain."""
    from undula.operators.edits import delay_compensated

    given = gains.select("mix", "track", F.col("gain_db").alias("_given"))
    own = config.join(given, ["mix", "track"], "left").withColumn("gain_db", F.coalesce("_given", "gain_db")).drop("_given")
    return delay_compensated(mixed(samples, own).withColumnRenamed("mix", "track"), latency).withColumnRenamed("track", "mix")


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Gains joined by trimmed name, else by the name as it is: mix, name, ours, theirs, diff."""
    a = ours.withColumn("key", F.trim("name"))
    t = theirs.select("mix", F.trim("name").alias("key"), F.col("gain_db").alias("theirs")).dropDuplicates(["mix", "key"])
    raw = theirs.select("mix", F.col("name").alias("name"), F.col("gain_db").alias("raw")).dropDuplicates(["mix", "name"])
    d = a.join(t, ["mix", "key"], "left").join(raw, ["mix", "name"], "left").withColumn("theirs", F.coalesce("theirs", "raw"))
    return d.filter("theirs is not null").select("mix", "name", F.col("gain_db").alias("ours"), "theirs", (F.col("gain_db") - F.col("theirs")).alias("diff"))


def errors(pairs: DataFrame, near: float = 3.0) -> DataFrame:
    """mix, n, mean_abs, max_abs, within_pct (differences of at most `near`)."""
    return pairs.groupBy("mix").agg(F.count("*").alias("n"), F.avg(F.abs("diff")).alias("mean_abs"), F.max(F.abs("diff")).alias("max_abs"), (100 * F.avg(F.when(F.abs("diff") <= near, 1.0).otherwise(0.0))).alias("within_pct"))


def ranked(pairs: DataFrame, worst: int = 15, closest: int = 5) -> DataFrame:
    """The worst and the closest pairs of each mix: mix, kind, place, name, diff. A top-k report."""
    by = lambda *o: F.row_number().over(Window.partitionBy("mix").orderBy(*o))
    a = pairs.withColumn("place", by(F.abs("diff").desc(), "name")).filter(F.col("place") <= worst).withColumn("kind", F.lit("worst"))
    b = pairs.withColumn("place", by(F.abs("diff"), "name")).filter(F.col("place") <= closest).withColumn("kind", F.lit("closest"))
    return a.unionByName(b).select("mix", "kind", "place", "name", "diff")


def imported(tracks: DataFrame, gains: DataFrame) -> DataFrame:
    """tracks (mix, name, gain_db) with saved gains by name where there are any, and whether there was one."""
    saved = gains.select("name", F.col("gain_db").alias("saved")).dropDuplicates(["name"])
    return tracks.join(saved, "name", "left").withColumn("matched", F.col("saved").isNotNull()).withColumn("gain_db", F.coalesce("saved", "gain_db")).drop("saved")
