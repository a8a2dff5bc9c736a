"""Queries of frames, regions, quality control, spectra and loudness over the signal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import edits as E
from undula.operators import frames as M
from undula.operators import loudness as L
from undula.operators import measures as A
from undula.operators import qc as Q
from undula.operators import regions as R
from undula.operators import spectral as S
from undula.plans import views as V
from undula.plans.registry import query

SIZE, HOP, RATE = 16, 4, 1000


def rounded(d: DataFrame, digits: int, *names: str) -> DataFrame:
    return d.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in d.columns))


NS = "n as (select track, max(i) + 1 n from series group by track)"
FRAMES = f"""{V.SERIES}, {NS}, st as (select track, i, x, abs(sign(x) - sign(lag(x) over (partition by track order by i))) d from series),
f as (select a.track, a.i // 4 frame_no, a.i start from series a join n using (track) where a.i % 4 = 0 and a.i + 16 <= n.n),
fm as (select f.track, f.frame_no, f.start, sqrt(sum(b.x * b.x) / 16) rms, max(abs(b.x)) peak, coalesce(sum(b.d) filter (b.i > f.start), 0) / 32.0::double zcr from f join st b on b.track = f.track and b.i >= f.start and b.i < f.start + 16 group by all)"""


@query("a1_statistics", f"with {V.REELS} select track, max(i) + 1 frames, count(distinct channel) channels, (max(i) + 1) / 1000.0::double duration, max(abs(x)) peak, round(sqrt(avg(x * x)), 6) rms from reels group by track")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.statistics(V.reels(spark, d), RATE), 6, "rms")


@query("a2_frame_metrics", f"with {FRAMES} select track, frame_no, start, round(rms, 6) rms, round(peak, 6) peak, round(zcr, 6) zcr from fm")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.frame_metrics(V.series(spark, d), SIZE, HOP), 6, "rms", "peak", "zcr")


@query("a4_summary", f"with {FRAMES}, u as (select track, unnest(['rms', 'peak', 'zcr']) metric, unnest([rms, peak, zcr]) v from fm), t as (select distinct track, unnest(['rms', 'peak', 'zcr']) metric from series) select track, metric, coalesce(round(avg(v), 4), 0) mean, coalesce(round(min(v), 4), 0) min, coalesce(round(max(v), 4), 0) max, coalesce(round(stddev_pop(v), 4), 0) std from t left join u using (track, metric) group by all")
def a4(spark: SparkSession, d: str) -> DataFrame:
    s = V.series(spark, d)
    out = M.summary(M.frame_metrics(s, SIZE, HOP), s, ["rms", "peak", "zcr"])
    names = ["mean", "min", "max", "std"]
    return rounded(rounded(out, 12, *names), 4, *names)  # 12 digits first: the order of the sums must not decide what lies exactly between


CLIP = "c as (select track, i from lines where abs(x) >= 0.999), t as (select distinct track from lines)"


@query("a12_clipping", f"with {V.LINES}, {CLIP} select t.track, (select count(*) from c where c.track = t.track) clipped, coalesce((select string_agg(i, ',' order by i) from (select i from c where c.track = t.track order by i limit 10)), '') places from t")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return M.clipping(V.lines(spark, d)).select("track", "clipped", F.coalesce(F.array_join(F.transform("places", lambda v: v.cast("string")), ","), F.lit("")).alias("places"))


RATIOS = f"""{V.SERIES}, {NS}, e as (select a.track, a.i, abs(lead(x) over (partition by a.track order by a.i) - x) step, least(32, n) w, n from series a join n using (track)),
r as (select e.track, e.i, e.step / sqrt(greatest((select avg(b.x * b.x) from series b where b.track = e.track and b.i >= greatest(0, least(e.i - greatest((e.w - 2) // 2, 0), e.n - e.w)) and b.i < greatest(0, least(e.i - greatest((e.w - 2) // 2, 0), e.n - e.w)) + e.w), 1e-12)) ratio from e where step is not null)"""



@query("a13_clicks", f"with recursive {RATIOS}, o as (select track, i, row_number() over (partition by track order by i) k from r where ratio > 2), g as (select track, k, i kept, true keep from o where k = 1 union all select o.track, o.k, case when o.i - g.kept > 5 then o.i else g.kept end, o.i - g.kept > 5 from g join o on o.track = g.track and o.k = g.k + 1), t as (select track, round(max(ratio), 6) max_ratio from r group by track) select t.track, coalesce(cast(count(kept) filter (keep) as int), 0) n_clicks, coalesce(string_agg(kept, ',' order by kept) filter (keep), '') places, max_ratio from t left join g using (track) group by all")
def a13(spark: SparkSession, d: str) -> DataFrame:
    out = M.clicks(V.series(spark, d), RATE, 2.0, 32.0, 5.0)
    return rounded(out.select("track", "n_clicks", F.array_join(F.transform("places", lambda v: v.cast("string")), ",").alias("places"), "max_ratio"), 6, "max_ratio")


LR = f"{V.REELS}, lr as (select l.track, l.i, l.x l, r.x r from reels l join reels r on l.track = r.track and l.i = r.i and l.channel = 0 and r.channel = 1)"


@query(
    "a14_correlation",
    f"""with {LR}, o as (select track, corr(l, r) o, max(i) + 1 n from lr group by track), w as (select track, i // 256 w, corr(l, r) c from lr group by all having stddev_pop(l) >= 1e-8 and stddev_pop(r) >= 1e-8),
    a as (select w.track, min(c) a, avg(c) m, 100 * avg(case when c < 0 then 1.0::double else 0 end) p, count(*) k from w join o using (track) where (w.w + 1) * 256 <= n group by w.track)
    select o.track, round(coalesce(o, 0), 4) overall, round(coalesce(a, o), 4) least, round(m, 4) mean, round(coalesce(p, 0), 2) negative_pct, coalesce(k, 0) windows from o left join a using (track)""",
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(M.correlation(V.reels(spark, d), 256), 4, "overall", "least", "mean"), 2, "negative_pct")


@query("a15_imbalance", f"with {V.REELS} select track, round(20 * log10(sqrt(avg(x * x) filter (channel = 0)) / sqrt(avg(x * x) filter (channel = 1))), 2) imbalance_db from reels group by track")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.imbalance(V.reels(spark, d)), 2, "imbalance_db")


@query("a16_head_tail_silence", f"with {V.SERIES}, a as (select track, min(i) filter (abs(x) > pow(10, -6 / 20.0::double)) a, max(i) filter (abs(x) > pow(10, -6 / 20.0::double)) b, max(i) l from series group by track) select track, round(a / 1000.0::double * 1000, 1) head_ms, round((l - b) / 1000.0::double, 3) tail_sec, a is null all_silence from a")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return M.head_tail_silence(V.series(spark, d), RATE, -6.0)


@query("a31_overview", f"with {V.SERIES}, {NS}, c as (select track, i // greatest(1, n // 8) col, coalesce(sqrt(avg(x * x) filter (x >= 0)), 0) a, coalesce(sqrt(avg(x * x) filter (x < 0)), 0) b from series join n using (track) where i // greatest(1, n // 8) < 8 group by all), m as (select track, greatest(max(a), max(b), 1e-10) m from c group by track) select track, col, round(a / m, 6) above, round(b / m, 6) below from c join m using (track)")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.overview(V.series(spark, d), 8), 6, "above", "below")


@query("a32_resampled", f"with {FRAMES}, k as (select track, max(frame_no) + 1 n from fm group by track), p as (select track, cast(c as int) col, c * (n - 1) // 5 frame_no from k, (select unnest(range(6)) c)), j as (select track, col, rms v from p join fm using (track, frame_no)) select track, col, round((v - min(v) over w) / case when max(v) over w > min(v) over w then max(v) over w - min(v) over w else 1 end, 6) v from j window w as (partition by track)")
def a32(spark: SparkSession, d: str) -> DataFrame:
    fm = M.frame_metrics(V.series(spark, d), SIZE, HOP).select("track", F.col("frame_no").alias("k"), F.col("rms").alias("v"))
    return rounded(M.resampled(fm, 6), 6, "v")


QUIET = "pow(10, -2::double / 20)"
RUNS = f"""rn as (select track, frame_no, start, q, sum(ch) over (partition by track order by frame_no) run from (select track, frame_no, start, rms < {QUIET} q, case when (rms < {QUIET}) = lag(rms < {QUIET}) over (partition by track order by frame_no) then 0 else 1 end ch from fm)),
isl as (select track, run, q, min(start) a, max(start) z, count(*) k from rn group by all)"""


@query("r1_silence", f"with {FRAMES}, {RUNS}, l as (select track, q, a, lead(a) over (partition by track order by a) nx from isl) select track, a, coalesce(nx, n) b from l join n using (track) where q and coalesce(nx, n) - a >= 8")
def r1(spark: SparkSession, d: str) -> DataFrame:
    s = V.series(spark, d)
    return R.silence(M.frame_metrics(s, SIZE, HOP), E.lengths(s), -2.0, 8)


R2 = f"""g0 as (select track, frame_no, start, rms, sum(ch) over (partition by track order by frame_no) run from (select *, case when (rms > 0.83) = lag(rms > 0.83) over (partition by track order by frame_no) then 0 else 1 end ch from fm)),
ev as (select track, min(start) a, max(start) + 16 b, max(rms) score from g0 group by track, run having bool_and(rms > 0.83) and max(start) + 16 - min(start) >= 20),
mg as (select *, sum(nw) over (partition by track order by a, b) grp from (select *, case when a - max(b) over (partition by track order by a, b rows between unbounded preceding and 1 preceding) <= 6 then 0 else 1 end nw from ev)),
me as (select track, min(a) a, max(b) b, max(score) score from mg group by track, grp)"""


@query("r2_mask_events", f"with {FRAMES}, {R2} select track, a, b, round(score, 6) score from me")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.mask_events(M.frame_metrics(V.series(spark, d), SIZE, HOP), F.col("rms") > 0.83, SIZE, 20, 6, F.col("rms")), 6, "score")


@query("r3_first_events", f"with {FRAMES}, {R2} select track, k, a, b from (select track, a, b, cast(row_number() over (partition by track order by a) as int) k from me) where k <= 2")
def r3(spark: SparkSession, d: str) -> DataFrame:
    ev = R.mask_events(M.frame_metrics(V.series(spark, d), SIZE, HOP), F.col("rms") > 0.83, SIZE, 20, 6, F.col("rms"))
    return R.first_of(ev, 2).select("track", "k", "a", "b")


@query("r5_thinned", f"with recursive {V.LINES}, o as (select track, i, row_number() over (partition by track order by i) k from lines where abs(x) >= 0.95), g as (select track, k, i kept, true keep from o where k = 1 union all select o.track, o.k, case when o.i - g.kept > 12 then o.i else g.kept end, o.i - g.kept > 12 from g join o on o.track = g.track and o.k = g.k + 1) select track, kept from g where keep")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return M.kept_places(V.lines(spark, d).filter(F.abs("x") >= 0.95).select("track", "i"), 12).withColumnRenamed("i", "kept")


SP = f"{V.SPEECH}, sp as (select * from speech where kind = 'speech'), ends as (select track, max(b) n from speech group by track)"
NOISE = "cur as (select track, coalesce(max(b) over (partition by track order by a, b rows between unbounded preceding and 1 preceding), 0) a, a b from sp union all select ends.track, coalesce(max(sp.b), 0), n from ends left join sp using (track) group by ends.track, n), noise as (select * from cur where a < b)"


def speech_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = V.speech(spark, d)
    return s.filter("kind = 'speech'"), s.groupBy("track").agg(F.max("b").alias("n"))


@query("u1_noise", f"with {SP}, {NOISE} select track, a, b from noise")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return R.complement(*speech_of(spark, d))


@query("u2_timeline", f"with {SP}, {NOISE}, al as (select track, a, b, 'speech' kind from sp union all select track, a, b, 'noise' from noise) select track, a, b, kind, cast(row_number() over (partition by track order by a, b) as int) place from al")
def u2(spark: SparkSession, d: str) -> DataFrame:
    sp, ends = speech_of(spark, d)
    return R.timeline(sp, R.complement(sp, ends))


@query("a33_segment_summary", f"with {SP} select track, count(*) filter (kind = 'speech') n_speech, count(*) filter (kind = 'noise') n_noise, cast(coalesce(sum(b - a) filter (kind = 'speech'), 0) as bigint) speech, cast(coalesce(sum(b - a) filter (kind = 'noise'), 0) as bigint) noise, round(coalesce(coalesce(sum(b - a) filter (kind = 'speech'), 0) / nullif(sum(b - a), 0)::double, 0), 6) ratio from speech group by track")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.segment_summary(V.speech(spark, d)), 6, "ratio")


@query(
    "d8_speech_segments",
    f"""with {FRAMES}, g0 as (select track, frame_no, rms, sum(ch) over (partition by track order by frame_no) run from (select *, case when (rms > 0.82) = lag(rms > 0.82) over (partition by track order by frame_no) then 0 else 1 end ch from fm)),
    ev as (select track, min(frame_no) * 4 a, (max(frame_no) + 1) * 4 b from g0 group by track, run having bool_and(rms > 0.82)),
    mg as (select *, sum(nw) over (partition by track order by a, b) grp from (select *, case when a - max(b) over (partition by track order by a, b rows between unbounded preceding and 1 preceding) <= 7 then 0 else 1 end nw from ev)),
    me as (select track, min(a) a, max(b) b from mg group by track, grp having max(b) - min(a) >= 8), e as (select track, (max(frame_no) + 1) * 4 n from fm group by track)
    select track, greatest(greatest(a - 3, coalesce((lag(b) over w + a) // 2, 0)), 0) a, least(least(b + 3, coalesce((b + lead(a) over w) // 2, n)), n) b from me join e using (track) window w as (partition by track order by a)""",
)
def d8(spark: SparkSession, d: str) -> DataFrame:
    return R.speech_segments(M.frame_metrics(V.series(spark, d), SIZE, HOP), F.col("rms") > 0.82, HOP, 8, 8, 3)


# Spectra: one frame of 64 samples per clip at 48 kHz, as a plain DFT in SQL.
DFT = f"""{V.CLIPS}, bins as (select cast(unnest(range(33)) as int) bin), dft as (select track, bin, bin * 750.0::double freq, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * cos(2 * pi() * bin * i / 64)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * sin(2 * pi() * bin * i / 64)), 2) power from clips, bins group by all)"""


def spectrum(spark: SparkSession, d: str) -> DataFrame:
    return S.long_term_spectrum(V.clips(spark, d), 48_000, 64, 64, 0.0)


@query("a3_frame_spectra", f"with {DFT}, p as (select track, freq, sqrt(power) m, sum(sqrt(power)) over (partition by track) t from dft) select track, cast(0 as bigint) frame_no, round(sum(freq * m) / max(t), 3) centroid, round(-sum(case when m / t > 1e-10 then m / t * log2(m / t) else 0 end), 6) entropy from p group by track")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(S.frame_spectra(V.clips(spark, d), 48_000, 64, 64).drop("channel"), 3, "centroid"), 6, "entropy")


@query("a5_long_term_spectrum", f"with {DFT} select track, bin, freq, round(power, 6) power, cast(1 as bigint) frames from dft")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum(spark, d), 6, "power")


VALUES = lambda name, rows, cols: f"{name}({cols}) as (values {', '.join(str(r) for r in rows)})"
OCT = VALUES("oct", S.OCTAVES, "lo, hi, band")


@query("a6_band_energy", f"with {DFT}, {OCT}, t as (select track, sum(power) t from dft group by track), e as (select track, band, sum(power) e from dft join oct on freq >= lo and freq < hi group by all) select t.track, oct.band, round(100 * coalesce(e, 0) / t, 4) percent, round(10 * log10(coalesce(e, 0) / t + 1e-30), 2) db from t cross join oct left join e on e.track = t.track and e.band = oct.band")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(S.band_energy(spectrum(spark, d)), 4, "percent"), 2, "db")


@query("a7_dominant", f"with recursive {DFT}, o as (select track, freq, power, row_number() over (partition by track order by power desc, freq desc) k from dft where freq >= 20), g as (select track, cast(0 as bigint) k, [0.0::double][:0] c from (select distinct track from o) union all select g.track, o.k, case when len(g.c) >= 4 or len(list_filter(g.c, lambda s: abs(s - o.freq) < 2000)) > 0 then g.c else list_append(g.c, o.freq) end from g join o on o.track = g.track and o.k = g.k + 1), l as (select track, c from g where k = 32) select track, cast(p - 1 as int) place, c[p] \"at\" from (select track, c, unnest(range(1, len(c) + 1)) p from l)")
def a7(spark: SparkSession, d: str) -> DataFrame:
    v = spectrum(spark, d).filter("freq >= 20").select("track", F.col("freq").alias("at"), F.col("power").alias("v"))
    return R.spaced_top(v, 4, 2000.0).select("track", "place", "at")


CANDS = [1500.0, 3000.0, 9100.0]


@query("a8_hum", f"with {DFT}, c as (select unnest({CANDS}::double[]) candidate), nb as (select track, candidate, arg_min(bin, (abs(freq - candidate), bin)) \"at\" from dft, c group by all), s as (select nb.track, nb.candidate, \"at\", any_value(e.power) e, median(d.power) f from nb join dft d using (track) join dft e on e.track = nb.track and e.bin = nb.at where (d.bin - \"at\" >= -20 and d.bin - \"at\" < -3) or (d.bin - \"at\" >= 3 and d.bin - \"at\" < 20) group by all) select track, candidate, round(10 * log10(e / f), 2) snr_db, 10 * log10(e / f) > 6 is_hum from s")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.hum(spectrum(spark, d), CANDS, 6.0), 2, "snr_db")


@query("a9_slope", f"with {DFT}, a as (select track, avg(power) filter (freq between 1000 and 3000) m, avg(power) filter (freq between 10000 and 16000) h from dft group by track) select track, round(10 * log10(m + 1e-30), 2) mid_db, round(10 * log10(h + 1e-30), 2) high_db, round(10 * log10(h + 1e-30) - 10 * log10(m + 1e-30), 2) slope_db from a")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.slope(spectrum(spark, d)), 2, "mid_db", "high_db", "slope_db")


@query("a10_diagnostics", f"with {DFT}, {OCT}, t as (select track, sum(power) t, max(bin) filter (power > 0) top from dft group by track), e as (select track, count(distinct band) n_bands from dft join oct on freq >= lo and freq < hi group by track), m as (select track, arg_max(freq, (power, freq)) peak from dft where freq >= 20 group by track) select track, n_bands, peak from e join m using (track)")
def a10(spark: SparkSession, d: str) -> DataFrame:
    r = S.diagnostics(spectrum(spark, d), 5)
    heard = F.size(F.filter("bands", lambda b: b["percent"] > 0)).cast("long")
    return r.select("track", heard.alias("n_bands"), F.get("dominant", F.lit(0))["at"].alias("peak"))


@query("a11_spectrogram", f"with {DFT} select track, cast(0 as bigint) frame_no, bin, round(20 * log10(greatest(sqrt(power), 1e-10)), 3) db from dft")
def a11(spark: SparkSession, d: str) -> DataFrame:
    s = S.spectrogram(V.clips(spark, d), 64, 64)
    return rounded(s.select("track", "frame_no", F.posexplode("db").alias("bin", "db")), 3, "db")


MB = VALUES("mb", S.MIX_BANDS, "lo, hi, band")


def biquad_sql(c: list[float]) -> str:
    """Squared magnitude of c0 + c1 z + c2 z^2 at angle w."""
    a, b, e = map(float, c)
    return f"pow({a!r} + {b!r} * cos(w) + {e!r} * cos(2 * w), 2) + pow({b!r} * sin(w) + {e!r} * sin(2 * w), 2)"


def k_sql() -> str:
    from undula.functions import kernels as K

    return f"case when bin = 0 then 0 else ({biquad_sql(K.K_B1)}) * ({biquad_sql(K.K_B2)}) / (({biquad_sql(K.K_A1)}) * ({biquad_sql(K.K_A2)})) end"


LEVELS = f"""{DFT}, {MB}, kd as (select track, bin, freq, power * pow(2 / 64.0::double, 2) * {k_sql()} p from (select *, 2 * pi() * least(freq, 23999) / 48000 w from dft)),
bp as (select track, band, sum(p) p from kd join mb on freq >= lo and freq < hi group by all), lv as (select t.track, mb.band, case when coalesce(p, 0) >= 1e-20 then 20 * log10(greatest(sqrt(p), 1e-10)) else -120.0::double end level from (select distinct track from clips) t cross join mb left join bp on bp.track = t.track and bp.band = mb.band)"""


@query("a26_band_levels", f"with {LEVELS} select track, band, round(level, 4) level from lv")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.mix_band_levels(V.clips(spark, d), 48_000, 64, 64), 4, "level")


# Loudness from unweighted energies, which SQL can follow; the weighting itself is tested against a plain filter.
EN = f"""{V.REELS}, pe as (select track, channel, i // 100 hop, sum(x * x) / 100 e from reels group by all having count(*) = 100), en as (select track, hop, sum(e) e from pe group by all),
bl as (select track, hop, p, -0.691 + 10 * log10(p) l from (select track, hop, sum(e) over w / 4 p, count(*) over w k from en window w as (partition by track order by hop rows between current row and 3 following)) where k = 4),
g1 as (select track, -0.691 + 10 * log10(avg(p)) - 10 g from bl where l > -70 group by track), lu as (select track, -0.691 + 10 * log10(avg(p)) lufs from bl join g1 using (track) where l > -70 and l > g group by track),
st as (select track, hop, -0.691 + 10 * log10(p) lufs from (select track, hop, sum(e) over w / 3 p, count(*) over w k from en window w as (partition by track order by hop rows between current row and 2 following)) where k = 3),
lr as (select track, case when count(lufs) >= 2 then quantile_cont(lufs, 0.95) - quantile_cont(lufs, 0.10) else 0 end lra from st group by track)"""


def energy(spark: SparkSession, d: str) -> DataFrame:
    return L.energies(V.reels(spark, d), RATE, weighted=False)


@query("a17_integrated", f"with {EN} select t.track, round(lufs, 4) lufs from (select distinct track from en) t left join lu using (track)")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.integrated(energy(spark, d)), 4, "lufs")


@query("a18_short_term", f"with {EN} select track, hop, round(lufs, 4) lufs from st")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.short_term(energy(spark, d), 3), 4, "lufs")


@query("a19_range", f"with {EN} select track, round(lra, 4) lra from lr")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.loudness_range(L.short_term(energy(spark, d), 3)), 4, "lra")


@query("a20_true_peak")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.true_peak(V.reels(spark, d)), 4, "true_peak_db")


@query("a21_sample_peak", f"with {V.CLIPS} select track, round(case when max(abs(x)) > 0 then 20 * log10(max(abs(x))) end, 4) peak_db from clips group by track")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.sample_peak(V.clips(spark, d)), 4, "peak_db")


@query("a22_loudness_report")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return L.report(V.reels(spark, d), RATE, 3)


@query("a23_loudness_normalize")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.normalized(V.reels(spark, d), RATE, -14.0, -1.0), 6, "x")


@query("a24_level_utterances")
def a24(spark: SparkSession, d: str) -> DataFrame:
    s = V.reels(spark, d)
    segments = E.lengths(s).select("track", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(450).cast("long").alias("b")), F.struct(F.lit(500).cast("long").alias("a"), F.lit(700).cast("long").alias("b")))).alias("s")).select("track", "s.a", "s.b")
    return rounded(L.level_utterances(s, RATE, segments, min_ms=100.0), 6, "x")


def measured(spark: SparkSession, d: str, weighted: bool = False) -> DataFrame:
    """Everything quality control asks of the reels; unweighted, SQL can follow: energies as they are and sample peaks for true peaks."""
    return A.measured(V.reels(spark, d), A.Asked(RATE, weighted, clip=0.4, window=256, short=3), depth=24)


TG = VALUES("tg", [tuple("null" if v is None else v for v in r) for r in Q.TARGETS], "target, lufs_lo, lufs_hi, peak_max, lra_min, head_lo, head_hi, tail_lo, tail_hi, rate_is, depth_min").replace("'null'", "null")
MEASURED = f"""{EN}, ml as (select l.track, l.i, l.x l, r.x r from reels l join reels r on l.track = r.track and l.i = r.i and l.channel = 0 and r.channel = 1), mo as (select track, i, avg(x) x from reels group by all),
mn as (select track, max(i) + 1 n from mo group by track), me as (select a.track, a.i, abs(lead(x) over (partition by a.track order by a.i) - x) step, least(50, n) w, n from mo a join mn using (track)),
mr as (select me.track, me.i, me.step / sqrt(greatest((select avg(b.x * b.x) from mo b where b.track = me.track and b.i >= greatest(0, least(me.i - greatest((me.w - 2) // 2, 0), me.n - me.w)) and b.i < greatest(0, least(me.i - greatest((me.w - 2) // 2, 0), me.n - me.w)) + me.w), 1e-12)) ratio from me where step is not null),
co as (select track, i, row_number() over (partition by track order by i) k from mr where ratio > 6), cg as (select track, k, i kept, true keep from co where k = 1 union all select co.track, co.k, case when co.i - cg.kept > 5 then co.i else cg.kept end, co.i - cg.kept > 5 from cg join co on co.track = cg.track and co.k = cg.k + 1),
pw as (select track, i // 256 w, corr(l, r) c from ml group by all having stddev_pop(l) >= 1e-8 and stddev_pop(r) >= 1e-8),
pn as (select pw.track, round(100 * avg(case when c < 0 then 1.0::double else 0 end), 2) v from pw join mn using (track) where (pw.w + 1) * 256 <= n group by pw.track),
ms as (select track, (select round(lufs, 2) from lu where lu.track = t.track) lufs, (select round(lra, 2) from lr where lr.track = t.track) lra, (select round(20 * log10(max(abs(x))), 2) from reels where reels.track = t.track) tp,
  (select count(distinct i) from reels where reels.track = t.track and abs(x) >= 0.4) clipped, (select round(max(abs(dc)), 6) from (select avg(x) dc from reels where reels.track = t.track group by channel)) dc, (select count(*) from cg where cg.track = t.track and keep) clicks,
  coalesce((select v from pn where pn.track = t.track), 0) pn, (select round(20 * log10(sqrt(avg(x * x) filter (channel = 0)) / sqrt(avg(x * x) filter (channel = 1))), 2) from reels where reels.track = t.track) imb,
  (select round(min(i) filter (abs(x) > 0.001) / 1000.0::double * 1000, 1) from mo where mo.track = t.track) head, (select round((max(i) - max(i) filter (abs(x) > 0.001)) / 1000.0::double, 3) from mo where mo.track = t.track) tail from (select distinct track from reels) t), {TG},
ck as (select track, target, unnest([
  {{'name': 'integrated_lufs', 'value': lufs, 'ok': true, 'status': case when lufs is null then 'FAIL' when lufs between lufs_lo and lufs_hi then 'PASS' when lufs between lufs_lo - 0.5 and lufs_hi + 0.5 then 'WARN' else 'FAIL' end}},
  {{'name': 'true_peak_dbtp', 'value': tp, 'ok': true, 'status': case when tp is null or tp <= peak_max then 'PASS' when tp <= peak_max + 0.3 then 'WARN' else 'FAIL' end}},
  {{'name': 'loudness_range_lu', 'value': coalesce(lra, 0), 'ok': lra_min > 0, 'status': case when coalesce(lra, 0) >= lra_min then 'PASS' else 'WARN' end}},
  {{'name': 'clipping_samples', 'value': clipped::double, 'ok': true, 'status': case when clipped = 0 then 'PASS' when clipped < 5 then 'WARN' else 'FAIL' end}},
  {{'name': 'dc_offset', 'value': dc, 'ok': true, 'status': case when dc < 0.001 then 'PASS' when dc < 0.01 then 'WARN' else 'FAIL' end}},
  {{'name': 'clicks', 'value': clicks::double, 'ok': true, 'status': case when clicks = 0 then 'PASS' when clicks < 3 then 'WARN' else 'FAIL' end}},
  {{'name': 'phase_correlation', 'value': pn, 'ok': pn is not null, 'status': case when pn < 5 then 'PASS' when pn < 20 then 'WARN' else 'FAIL' end}},
  {{'name': 'channel_imbalance_db', 'value': imb, 'ok': imb is not null, 'status': case when abs(imb) < 0.5 then 'PASS' when abs(imb) < 1.5 then 'WARN' else 'FAIL' end}},
  {{'name': 'head_silence_ms', 'value': head, 'ok': true, 'status': case when head is null then 'FAIL' when head between head_lo and head_hi then 'PASS' else 'WARN' end}},
  {{'name': 'tail_silence_sec', 'value': tail, 'ok': true, 'status': case when tail is null then 'FAIL' when tail between tail_lo and tail_hi then 'PASS' else 'WARN' end}},
  {{'name': 'sample_rate', 'value': 1000.0::double, 'ok': rate_is is not null, 'status': case when rate_is = 1000 then 'PASS' else 'FAIL' end}},
  {{'name': 'bit_depth', 'value': 24.0::double, 'ok': depth_min is not null, 'status': case when 24 >= depth_min then 'PASS' else 'FAIL' end}}]) c from ms, tg)"""


@query("j12_checks", f"with recursive {MEASURED} select track, target, c.name \"name\", cast(c.value as double) \"value\", c.status status from ck where c.ok")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return Q.checks(measured(spark, d))


@query("a25_quality_control", f"with recursive {MEASURED} select track, target, count(*) filter (c.status = 'PASS') n_pass, count(*) filter (c.status = 'WARN') n_warn, count(*) filter (c.status = 'FAIL') n_fail, case when count(*) filter (c.status = 'FAIL') > 0 then 'FAIL' when count(*) filter (c.status = 'WARN') > 0 then 'WARN' else 'PASS' end verdict from ck where c.ok group by track, target")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return Q.verdicts(Q.checks(measured(spark, d)))


@query("a17_integrated_weighted")
def a17_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.integrated(L.energies(V.reels(spark, d), RATE)), 4, "lufs")


@query("a25_quality_control_weighted")
def a25_weighted(spark: SparkSession, d: str) -> DataFrame:
    """As a25, by K-weighted loudness and oversampled true peaks."""
    return Q.verdicts(Q.checks(measured(spark, d, weighted=True)))
