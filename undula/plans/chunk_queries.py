"""Queries of signals held as chunk tables, and of a whole mixdown. Embeddings are arrays already: clips and reels need no sample rows at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import chunks as H
from undula.operators import edits as E
from undula.operators import mix as M
from undula.operators import response as P
from undula.operators import spectral as S
from undula.plans import device_queries as D
from undula.plans import mix_queries as X
from undula.plans import views as V
from undula.plans.measure_queries import HOP, RATE, rounded
from undula.plans.measure_queries import SIZE as FRAME
from undula.plans.registry import SQL, query

#: Samples in a chunk of the views: short, so that frames, windows and shifts cross many borders.
SIZE = 64


def series(spark: SparkSession, d: str) -> DataFrame:
    return H.from_samples(V.series(spark, d), SIZE)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return H.from_samples(V.lines(spark, d), SIZE)


@query("a2_frame_metrics_chunks", SQL["a2_frame_metrics"])
def a2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.frame_metrics(series(spark, d), FRAME, HOP, SIZE), 6, "rms", "peak", "zcr")


@query("a12_clipping_chunks", SQL["a12_clipping"])
def a12(spark: SparkSession, d: str) -> DataFrame:
    found = H.clipping(lines(spark, d), size=SIZE)
    return found.select("track", "clipped", F.coalesce(F.array_join(F.transform("places", lambda v: v.cast("string")), ","), F.lit("")).alias("places"))


@query("a14_correlation_chunks", SQL["a14_correlation"])
def a14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(H.correlation(V.reel_chunks(spark, d), 256, SIZE), 4, "overall", "least", "mean"), 2, "negative_pct")


@query("a15_imbalance_chunks", SQL["a15_imbalance"])
def a15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.imbalance(V.reel_chunks(spark, d)), 2, "imbalance_db")


@query("a16_head_tail_silence_chunks", SQL["a16_head_tail_silence"])
def a16(spark: SparkSession, d: str) -> DataFrame:
    return H.head_tail_silence(series(spark, d), RATE, -6.0, SIZE)


@query("j1_mix_chunks", SQL["j1_mix"])
def j1(spark: SparkSession, d: str) -> DataFrame:
    mix = H.mixed(H.stereo(lines(spark, d)), V.mix_tracks(spark, d), SIZE)
    return rounded(H.to_samples(mix.withColumnRenamed("mix", "track"), SIZE).withColumnRenamed("track", "mix"), 6, "x")


@query("p1_mono_chunks", f"with {V.REELS} select track, i, round(avg(x), 6) x from reels group by all")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.to_samples(H.mono(V.reel_chunks(spark, d)), SIZE).select("track", "i", "x"), 6, "x")


@query("p3_mid_side_chunks", f"with {V.REELS} select track, channel, i, round(x, 5) x from reels")
def p3(spark: SparkSession, d: str) -> DataFrame:
    """There and back."""
    return rounded(H.to_samples(H.from_mid_side(H.to_mid_side(V.reel_chunks(spark, d))), SIZE), 5, "x")


@query("p4_p5_gain_pan_chunks", f"with {V.REELS} select track, channel, i, round(x * pow(10, -6 / 20.0::double) * case when channel = 0 then cos(1.5 * pi() / 4) else sin(1.5 * pi() / 4) end, 5) x from reels")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.to_samples(H.pan(H.gain(V.reel_chunks(spark, d), -6.0), 0.5), SIZE), 5, "x")


@query("j11_neighbourhoods", f"""with {V.LINES}, e as (select track, i "at" from lines where x >= 0.999)
select e.track, "at", min(b.i) "start", count(*) n, round(sum(b.x), 6) total, round(max(abs(b.x)), 6) peak from e join lines b on b.track = e.track and b.i >= "at" - 12 and b.i < "at" + 12 group by all""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """What stands around every sample at full scale."""
    s = V.lines(spark, d)
    found = H.neighbourhoods(s.filter("x >= 0.999").select("track", F.col("i").alias("at")), H.from_samples(s, SIZE), 12, 12, SIZE)
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
    peak = F.array_max(F.transform("xs", lambda x: F.abs(x)))
    return rounded(found.select("track", "at", "start", F.size("xs").cast("long").alias("n"), total.alias("total"), peak.alias("peak")), 6, "total", "peak")


@query(
    "j2_mixdown_recommended",
    f"""with {X.GAINS}, {D.MEASURED.removeprefix(f'with {V.CLIPS}, ')}, late as (select cast(sum(used) as bigint) l from us where track in (1, 2)),
    mx as (select gx.mix, ch.ch channel, i, sum(x * pow(10, round(exact, 1) / 20) * case when ch.ch = 0 then cos(pi() / 4) else sin(pi() / 4) end) x from clips join gx using (track), (select unnest([0, 1]) ch) ch group by all)
    select a.mix, a.channel, a.i, round(coalesce(b.x, 0), 5) x from mx a cross join late left join mx b on b.mix = a.mix and b.channel = a.channel and b.i = a.i + l""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Mixes of the clips at their recommended gains, moved back by what a chain of two devices delays them."""
    clips = V.clips(spark, d)
    tracks, _, bands = X.level_rows(spark, d)
    gains, _ = M.recommendation(tracks, bands, M.target_levels("rock", S.MIX_BANDS))
    config = tracks.select("mix", "track", F.lit(0.0).alias("gain_db"), F.lit(0.0).alias("pan"), F.lit(False).alias("mute"), F.lit(False).alias("solo"), F.lit(0).alias("shift"))
    late = P.chain_latency(D.m10(spark, d), clips.select(F.lit(1).alias("chain"), "track").distinct().filter("track in (1, 2)").withColumn("step", F.col("track")))
    return rounded(M.mixdown(E.stereo(clips), config, gains, int(late.first()["total"])), 5, "x")
