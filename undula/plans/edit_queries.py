"""Queries of the time-line operators (P1 to P21) over the signal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import edits as E
from undula.plans import views as V
from undula.plans.registry import query

Q6 = lambda d: d.select("track", "channel", "i", F.round("x", 6).alias("x"))
OUT = "select track, channel, i, round(x, 6) x from"
RATE = 1000


@query("p1_mono", f"with {V.REELS} select track, 0 channel, i, round(avg(x), 6) x from reels group by track, i")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.mono(V.reels(spark, d)))


@query("p2_stereo", f"with {V.SERIES}, c as (select unnest([0, 1]) channel) select track, cast(c.channel as int) channel, i, round(x, 6) x from series, c")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.stereo(V.series(spark, d)))


@query("p3_mid_side", f"with {V.REELS} select l.track, l.i, round((l.x + r.x) / 2, 6) mid, round((l.x - r.x) / 2, 6) side from reels l join reels r on l.track = r.track and l.i = r.i and l.channel = 0 and r.channel = 1")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return E.to_mid_side(V.reels(spark, d)).select("track", "i", F.round("mid", 6).alias("mid"), F.round("side", 6).alias("side"))


@query("p3_from_mid_side", f"with {V.REELS} {OUT} reels")
def p3_back(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.from_mid_side(E.to_mid_side(V.reels(spark, d))))


@query("p4_gain", f"with {V.CLIPS} select track, channel, i, round(x * pow(10, -6 / 20.0::double), 6) x from clips")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.gain(V.clips(spark, d), -6.0))


@query("p5_pan", f"with {V.REELS} select track, channel, i, round(x * case when channel = 0 then cos((least(1, greatest(-1, (track - 5) / 4.0::double)) + 1) * pi() / 4) else sin((least(1, greatest(-1, (track - 5) / 4.0::double)) + 1) * pi() / 4) end, 6) x from reels")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.pan(V.reels(spark, d), (F.col("track") - 5) / 4.0))


@query("p6_trim", f"with {V.CLIPS} select track, channel, i - 8 i, round(x, 6) x from clips where i >= 8 and i < 40")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.trim(V.clips(spark, d), 8, 40))


@query("p7_pad", f"with {V.CLIPS}, t as (select distinct track from clips) {OUT} (select track, channel, i + 3 i, x from clips union all select track, 0, unnest([0, 1, 2, 67, 68]), 0.0 from t)")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.pad(V.clips(spark, d), 3, 2))


FADES = {
    "linear": "{x}", "cosine": "0.5 * (1 - cos(pi() * {x}))", "equal_power": "sqrt({x})",
    "exponential": "(pow(10, ({x} - 1) * 3) - pow(10, -3)) / (1 - pow(10, -3))", "logarithmic": "(1 - pow(10, -3 * {x})) / (1 - pow(10, -3))",
}
for kind, formula in FADES.items():

    @query(f"p8_fade_in_{kind}", f"with {V.CLIPS} select track, channel, i, round(case when i < 16 then x * {formula.format(x='(i / 15.0::double)')} else x end, 6) x from clips")
    def p8_in(spark: SparkSession, d: str, kind: str = kind) -> DataFrame:
        return Q6(E.fade_in(V.clips(spark, d), 16, kind))

    @query(f"p8_fade_out_{kind}", f"with {V.CLIPS} select track, channel, i, round(case when i >= 48 then x * {formula.format(x='((63 - i) / 15.0::double)')} else x end, 6) x from clips")
    def p8_out(spark: SparkSession, d: str, kind: str = kind) -> DataFrame:
        return Q6(E.fade_out(V.clips(spark, d), 16, kind))


@query("p9_dc_offset", f"with {V.REELS} select track, channel, round(avg(x), 6) dc from reels group by all")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return E.dc_offset(V.reels(spark, d)).withColumn("dc", F.round("dc", 6))


@query("p9_remove_dc", f"with {V.REELS} select track, channel, i, round(x - avg(x) over (partition by track, channel), 6) x from reels")
def p9_remove(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.remove_dc(V.reels(spark, d)))


@query(
    "p10_cut_region",
    f"""with {V.CLIPS}, p as (select track, channel, i, x * case when i >= 12 then 1 - (i - 12) / 7.0::double else 1 end x from clips where i < 20
    union all select track, channel, i - 40 + 12, x * case when i < 48 then (i - 40) / 7.0::double else 1 end from clips where i >= 40) select track, channel, i, round(sum(x), 6) x from p group by all""",
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.cut_region(V.clips(spark, d), 20, 40, 8))


def clip_of(spark: SparkSession, d: str) -> DataFrame:
    """The first ten samples of each clip at half level, as a clip to splice."""
    return E.gain(E.trim(V.clips(spark, d), 0, 10), -6.0)


SHORT = "k as (select track, channel, i + 20 i, x * pow(10, -6 / 20.0::double) x from clips where i < 10)"


@query("p11_splice_insert", f"with {V.CLIPS}, {SHORT} {OUT} (select track, channel, case when i >= 20 then i + 10 else i end i, x from clips union all select * from k)")
def p11_insert(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.splice(V.clips(spark, d), clip_of(spark, d), 20, "insert"))


@query(
    "p11_splice_crossfade",
    f"""with {V.CLIPS}, {SHORT}, b as (select track, channel, case when i < 20 then i else i + 2 end i, case when i between 16 and 19 then x * (1 - (i - 16) / 3.0::double) when i between 20 and 23 then x * ((i - 20) / 3.0::double) else x end x from clips),
    m as (select track, channel, i - 4 i, case when i < 24 then x * ((i - 20) / 3.0::double) when i >= 26 then x * (1 - (i - 26) / 3.0::double) else x end x from k)
    select track, channel, i, round(sum(x), 6) x from (select * from b union all select * from m) group by all""",
)
def p11_crossfade(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.splice(V.clips(spark, d), clip_of(spark, d), 20, "insert", crossfade=4))


@query("p11_splice_overwrite", f"with {V.CLIPS}, {SHORT} select track, channel, i, round(coalesce(k.x, clips.x), 6) x from clips left join k using (track, channel, i)")
def p11_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.splice(V.clips(spark, d), clip_of(spark, d), 20, "overwrite"))


@query("p11_splice_mix", f"with {V.CLIPS}, {SHORT} select track, channel, i, round(clips.x + coalesce(k.x, 0), 6) x from clips left join k using (track, channel, i)")
def p11_mix(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.splice(V.clips(spark, d), clip_of(spark, d), 20, "mix"))


@query(
    "p12_concat",
    f"""with {V.CLIPS}, e as (select cast(label as bigint) track, vec_id part, channel, i, x, dense_rank() over (partition by label order by vec_id) - 1 k, min(vec_id) over (partition by label) lo, max(vec_id) over (partition by label) hi from clips join embeddings on track = vec_id)
    select track, channel, k * 60 + i i, round(sum(x * case when part > lo and i < 4 then i / 3.0::double else 1 end * case when part < hi and i >= 60 then 1 - (i - 60) / 3.0::double else 1 end), 6) x from e group by all""",
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    of = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("part"), F.col("label").cast("long").alias("label"))
    parts = V.clips(spark, d).withColumnRenamed("track", "part").join(of, "part").withColumnRenamed("label", "track")
    return Q6(E.concat(parts, 4))


@query("p13_normalize_peak", f"with {V.CLIPS}, p as (select track, max(abs(x)) p from clips group by track) select track, channel, i, round(case when p < 1e-10 then x else x * (pow(10, -1 / 20.0::double) / p) end, 6) x from clips join p using (track)")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.normalize(V.clips(spark, d), -1.0))


@query("p13_normalize_rms", f"with {V.CLIPS}, p as (select track, sqrt(avg(x * x)) p from clips group by track) select track, channel, i, round(case when p < 1e-10 then x else x * (pow(10, -20 / 20.0::double) / p) end, 6) x from clips join p using (track)")
def p13_rms(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.normalize(V.clips(spark, d), None, -20.0))


@query(
    "p14_trim_silence",
    f"""with {V.REELS}, m as (select track, i, avg(x) x from reels group by all), r as (select track, min(i) filter (abs(x) > pow(10, -18 / 20.0::double)) f, max(i) filter (abs(x) > pow(10, -18 / 20.0::double)) l, max(i) + 1 n from m group by track)
    select track, channel, i - coalesce(greatest(f - 2, 0), 0) i, round(x, 6) x from reels join r using (track) where i >= coalesce(greatest(f - 2, 0), 0) and i <= coalesce(l + 2, n)""",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.trim_silence(V.reels(spark, d), -18.0, 2))


@query(
    "p15_gate",
    f"""with recursive {V.SERIES}, n as (select track, max(i) + 1 n from series group by track),
    h as (select a.track, a.i // 4 h, n.n from series a join n using (track) where a.i % 4 = 0),
    q as (select h.track, h.h, case when h.h * 4 + 16 <= h.n and sqrt((select sum(b.x * b.x) from series b where b.track = h.track and b.i >= h.h * 4 and b.i < h.h * 4 + 16) / 16) < pow(10, -5 / 20.0::double) then 0 else 1 end o from h),
    g as (select s.track, s.i, s.x, cast(q.o as double) o from series s join q on s.track = q.track and s.i // 4 = q.h),
    y as (select track, i, x, o y from g where i = 0 union all select g.track, g.i, g.x, y.y + (g.o - y.y) * case when g.o > y.y then 1 / 3.0::double else 1 / 6.0::double end from y join g on g.track = y.track and g.i = y.i + 1)
    select track, 0 channel, i, round(x * y, 6) x from y""",
)
def p15(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.gate(V.series(spark, d), -5.0, 3, 6, 16, 4))


@query("p16_latency", f"with {V.CLIPS} select track, channel, i, round(coalesce((select b.x from clips b where b.track = a.track and b.i = a.i + 5), 0), 6) x from clips a")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.delay_compensated(V.clips(spark, d), 5))


@query("p18_units", f"with {V.SERIES} select track, i, cast(round_even(x * 1000, 0) as bigint) samples, round(20 * log10(greatest(abs(x), 1e-12)), 6) db, round(10 * log10(greatest(x * x, 1e-12)), 6) power_db from series")
def p18(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return V.series(spark, d).select("track", "i", C.seconds_to_samples(x, RATE).alias("samples"), F.round(C.to_db(F.abs(x)), 6).alias("db"), F.round(C.power_db(x * x), 6).alias("power_db"))


OPS = [("trim", {"start_sec": 0.004, "end_sec": 0.056}), ("remove_dc", {}), ("fade_in", {"duration_sec": 0.008}), ("gain", {"db": -3.0}), ("pad", {"head_ms": 2, "tail_sec": 0.003})]


@query(
    "p19_render",
    f"""with {V.CLIPS}, a as (select track, channel, i - 4 i, x from clips where i >= 4 and i < 56), b as (select track, channel, i, x - avg(x) over (partition by track, channel) x from a),
    c as (select track, channel, i + 2 i, case when i < 8 then x * (i / 7.0::double) else x end * pow(10, -3 / 20.0::double) x from b), t as (select distinct track from c)
    {OUT} (select * from c union all select track, 0, unnest([0, 1, 54, 55, 56]), 0.0 from t)""",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.render(V.clips(spark, d), OPS, RATE))


SPLICES = [("trim", {"start_sec": 0.0, "end_sec": 0.04}), ("splice", {"clip": "head", "position_sec": 0.02, "mode": "insert"}), ("splice", {"clip": "head", "position_sec": 0.005, "mode": "mix"}), ("gain", {"db": -3.0})]


@query(
    "p19_render_splices",
    f"""with {V.CLIPS}, h as (select track, channel, i, x * pow(10, -6 / 20.0::double) x from clips where i < 10),
    a as (select track, channel, case when i >= 20 then i + 10 else i end i, x from clips where i < 40 union all select track, channel, i + 20 i, x from h)
    select a.track, a.channel, a.i, round((a.x + coalesce(h.x, 0)) * pow(10, -3 / 20.0::double), 6) x from a left join h on h.track = a.track and h.channel = a.channel and h.i + 5 = a.i""",
)
def p19_splices(spark: SparkSession, d: str) -> DataFrame:
    return Q6(E.render(V.clips(spark, d), SPLICES, RATE, clips={"head": (clip_of(spark, d), RATE)}))


@query("p21_delivery_loudness")
def p21_loudness(spark: SparkSession, d: str) -> DataFrame:
    """Reels prepared for delivery at -23 LUFS, and what they then measure."""
    from undula.operators import loudness as L

    out = E.render(V.reels(spark, d), E.delivery_operations(True, 100, 0.2, 20, 0.05, -23.0), RATE)
    return L.report(out, RATE, 3)


NEED = "map {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]::varchar[]" for k, v in E.OPERATIONS.items()) + "}"


@query(
    "p20_validate",
    f"""with o as (select user_id source, event_id op_no, case event_id % 4 when 0 then 'gain' when 1 then 'trim' when 2 then 'fade_in' else 'warp' end type, case event_id % 3 when 0 then ['db'] when 1 then ['start_sec', 'end_sec'] else ['start_sec'] end ks from events)
    select source, op_no, type, type <> 'warp' "known", array_to_string(list_filter(coalesce({NEED}[type], []), lambda k: not list_contains(ks, k)), ',') missing from o""",
)
def p20(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    entry = lambda *names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit("1") for _ in names)))
    ops = V.read(spark, d, "events").select(
        F.col("user_id").alias("source"), k.alias("op_no"), F.when(k % 4 == 0, "gain").when(k % 4 == 1, "trim").when(k % 4 == 2, "fade_in").otherwise("warp").alias("type"),
        F.when(k % 3 == 0, entry("db")).when(k % 3 == 1, entry("start_sec", "end_sec")).otherwise(entry("start_sec")).alias("params"),
    )
    return E.validated(ops).select("source", "op_no", "type", "known", F.array_join("missing", ",").alias("missing"))
