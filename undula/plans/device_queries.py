"""Queries of responses, screening, meters and file work over the signal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import deconvolution as D
from undula.operators import edits as E
from undula.operators import response as P
from undula.operators import screen as N
from undula.operators import spectral as S
from undula.plans import views as V
from undula.plans.measure_queries import DFT, rounded, spectrum
from undula.plans.registry import query
from undula.sources import wav as W
from undula.streaming import meters as T

RATE, SIZE = 48_000, 64


def responses(spark: SparkSession, d: str) -> DataFrame:
    return P.frequency_response(V.clips(spark, d), RATE, SIZE)


@query("m1_response", f"with {DFT} select track, bin, freq, round(20 * log10(sqrt(power) + 1e-10), 4) magnitude_db from dft")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(responses(spark, d).select("track", "bin", "freq", "magnitude_db"), 4, "magnitude_db")


def places_sql(places: list[tuple[int, int, int]]) -> str:
    return "pl(o, lo, hi) as (values " + ", ".join(map(str, places)) + ")"


HARMONICS = P.harmonic_places(2250.0, RATE, SIZE, 8)


@query("m2_distortion", f"with {DFT}, {places_sql(HARMONICS)}, p as (select track, o, max(sqrt(power)) pk from dft join pl on bin >= lo and bin < hi group by all), b as (select track, max(pk) filter (o = 1) f, coalesce(sum(pk * pk) filter (o > 1), 0) h from p group by track), t as (select track, sum(power) t from dft group by track) select track, round(20 * log10(f + 1e-10), 3) fundamental_db, round(100 * sqrt(h) / (f + 1e-10), 3) thd, round(100 * sqrt(greatest(0, t - f * f)) / (f + 1e-10), 3) thd_n from b join t using (track)")
def m2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.distortion(responses(spark, d), 2250.0, RATE, SIZE, 8), 3, "fundamental_db", "thd", "thd_n")


SIDES = [(0, 5, 11)] + [(s * n, max(0, 8 + s * n * 2 - 2), min(33, 8 + s * n * 2 + 3)) for n in range(1, 4) for s in (-1, 1) if 0 < 8 + s * n * 2 < 33]


@query("m3_intermodulation", f"with {DFT}, {places_sql(SIDES)}, p as (select track, o, max(sqrt(power)) pk from dft join pl on bin >= lo and bin < hi group by all) select track, round(100 * sqrt(sum(pk * pk) filter (o <> 0)) / (max(pk) filter (o = 0) + 1e-10), 3) imd from p group by track")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.intermodulation(responses(spark, d), 1500.0, 6000.0, RATE, SIZE, 3), 3, "imd")


@query("m4_sweep")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.sweep(V.reels(spark, d), 1000, 20.0, 400.0, 64, 32), 3, "freq", "peak_hz", "level_db", "thd")


@query("m5_level_ramp", f"with {V.SERIES}, o as (select track, i // 10 k, round(20 * log10(max(abs(x)) + 1e-10), 2) out_db from series group by all) select track, k, -30.0::double + k * 2.5 in_db, out_db, round(out_db - (-30 + k * 2.5::double), 2) change from o")
def m5(spark: SparkSession, d: str) -> DataFrame:
    """Every step of every track."""
    return P.level_ramp(V.series(spark, d), -30.0, 2.5, 10)


@query("m6_envelope", f"with {V.SERIES}, n as (select track, max(i) + 1 n from series group by track), b as (select track, i // 8 k, sqrt(avg(x * x)) e from series group by all) select track, k, round(20 * log10(e + 1e-10), 2) db from b join n using (track) where k * 8 < n - 8")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return P.envelope(V.series(spark, d), 8)


PAIR = "pr as (select user_id track, (round(value) - 250) / 250 x_in, (value - 250) / 250 * 0.8 x_out from events), po as (select track, x_in, avg(x_out) x_out from pr group by all), gr as (select distinct track, k, -1 + 2.0::double * k / 15 x_in from po, (select cast(unnest(range(16)) as int) k)), lo as (select gr.track, k, max(po.x_in) xl from gr left join po on po.track = gr.track and po.x_in <= gr.x_in group by all), hi as (select gr.track, k, min(po.x_in) xh from gr left join po on po.track = gr.track and po.x_in > gr.x_in group by all), ws as (select gr.track, gr.k, gr.x_in, case when xl is null then h.x_out when xh is null then l.x_out else l.x_out + (gr.x_in - xl) / (xh - xl) * (h.x_out - l.x_out) end x_out from gr join lo using (track, k) join hi using (track, k) left join po l on l.track = gr.track and l.x_in = xl left join po h on h.track = gr.track and h.x_in = xh)"


def curve(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events").select(F.col("user_id").alias("track"), ((F.round("value") - 250) / 250).alias("x_in"), ((F.col("value") - 250) / 250 * 0.8).alias("x_out"))
    return P.waveshape(e, 16)


@query("m7_waveshape", f"with {PAIR} select track, k, round(x_in, 6) x_in, round(x_out, 6) x_out from ws")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curve(spark, d), 6, "x_in", "x_out")


@query("m7_shape_summary", f"with {PAIR}, s as (select a.track, avg(abs(a.x_out + b.x_out)) y from ws a join ws b on b.track = a.track and b.k = 15 - a.k group by a.track), c as (select track, corr(x_in, x_out) c from ws group by track) select track, round(c, 4) linearity, round(y, 4) asymmetry from s join c using (track)")
def m7_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.shape_summary(curve(spark, d)), 4, "linearity", "asymmetry")


@query("m8_equalizer")
def m8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.equalizer_response(V.clips(spark, d), 0, RATE, SIZE), 3, "db", "phase")


@query("m9_sweep_summary", f"with {DFT}, c as (select track, freq, round(10 * log10(power + 1e-20), 6) db from dft where freq between 20 and 20000) select track, min(db) least_db, max(db) most_db, arg_max(freq, (db, -freq)) most_hz from c group by track")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return P.sweep_summary(spectrum(spark, d).withColumn("db", F.round(10 * F.log10(F.col("power") + 1e-20), 6)))


@query("m9_level_dependence", f"with {DFT}, c as (select track % 10 setting, track // 10 lv, bin, 10 * log10(power + 1e-20) db from dft), r as (select setting, bin, arg_min(db, lv) rf from c group by all) select setting, round(max(abs(db - rf)), 4) deviation, max(abs(db - rf)) > 0.5 nonlinear from c join r using (setting, bin) group by setting")
def m9_levels(spark: SparkSession, d: str) -> DataFrame:
    c = spectrum(spark, d).select((F.col("track") % 10).alias("setting"), F.floor(F.col("track") / 10).alias("level"), "bin", (10 * F.log10(F.col("power") + 1e-20)).alias("db"))
    return rounded(P.level_dependence(c), 4, "deviation")


@query("m10_latency", f"with {V.CLIPS}, t as (select track, arg_max(i, (abs(x), -i)) m, max(abs(x)) p from clips group by track), f as (select t.track, avg(abs(x)) f from t join clips using (track) where i < m - 8 or i >= m + 8 group by t.track), c as (select t.track, m, case when coalesce(f, 0) > 0 then greatest(0, least(1, (p / f - 1) / 19)) when p > 1e-6 then 1 else 0 end c from t left join f using (track)) select track, m measured, round(c, 4) confidence, case when c >= 0.5 or track % 3 <= 0 then m else track % 3 end used from c")
def m10(spark: SparkSession, d: str) -> DataFrame:
    s = V.clips(spark, d)
    reported = s.select("track").distinct().withColumn("reported", F.col("track") % 3)
    return P.latency(s, reported, 8)


MEASURED = f"with {V.CLIPS}, t as (select track, arg_max(i, (abs(x), -i)) m, max(abs(x)) p from clips group by track), f as (select t.track, avg(abs(x)) f from t join clips using (track) where i < m - 8 or i >= m + 8 group by t.track), c as (select t.track, m, case when coalesce(f, 0) > 0 then greatest(0, least(1, (p / f - 1) / 19)) when p > 1e-6 then 1 else 0 end c from t left join f using (track)), us as (select track, case when c >= 0.5 or track % 3 <= 0 then m else track % 3 end used from c)"


@query("m10_chain_latency", f"{MEASURED} select track % 12 chain, count(*) steps, sum(used) total from us group by 1")
def m10_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every twelfth device stands in one chain."""
    used = m10(spark, d).withColumn("used", F.col("used").cast("long"))
    return P.chain_latency(used, used.select((F.col("track") % 12).alias("chain"), F.col("track").alias("step"), "track"))


@query("m7_cycles", f"with {V.REELS}, s as (select l.track, l.i, l.x x_in, r.x x_out from reels l join reels r on l.track = r.track and l.i = r.i and l.channel = 0 and r.channel = 1), c as (select track, (i - 16) // 16 \"cycle\", (i - 16) % 16 step, x_in, x_out from s where i >= 16 and i < 64) select track, step, round(avg(x_in), 6) x_in, round(avg(x_out), 6) x_out from c group by all")
def m7_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Left as what went in, right as what came out: three periods of 16 samples, the first left out."""
    s = V.reels(spark, d)
    left = s.filter("channel = 0").select("track", "i", F.col("x").alias("x_in"))
    both = left.join(s.filter("channel = 1").select("track", "i", F.col("x").alias("x_out")), ["track", "i"]).withColumn("level", F.lit(0.0))
    return rounded(D.cycles(both, 1600, 100.0).select("track", "step", "x_in", "x_out"), 6, "x_in", "x_out")


@query("m8_deconvolved")
def m8_deconvolved(spark: SparkSession, d: str) -> DataFrame:
    """The reels as recordings of one short sweep, relative to the first of them; tests have planted filters."""
    inverse = D.inverse_sweep(1000, 0.5, 20.0, 450.0)
    s = V.reels(spark, d)
    first = s.agg(F.min("track")).first()[0]
    curve, verdict = D.equalizer_response(s, first, 1000, inverse, 256)
    return rounded(curve.join(verdict, "track").select("track", "bin", "freq", "db", "minimum_phase"), 3, "db")


@query("j13_curve_difference", f"with {DFT}, a as (select track // 2 pair, track % 2 side, bin, 10 * log10(power + 1e-20) db from dft) select x.pair, round(max(abs(x.db - y.db)), 4) largest from a x join a y on x.pair = y.pair and x.bin = y.bin and x.side = 0 and y.side = 1 group by x.pair")
def j13(spark: SparkSession, d: str) -> DataFrame:
    c = spectrum(spark, d).select(F.floor(F.col("track") / 2).alias("pair"), (F.col("track") % 2).alias("side"), "bin", (10 * F.log10(F.col("power") + 1e-20)).alias("db"), F.lit(0.0).alias("phase"))
    found = P.curve_difference(c.filter("side = 0"), c.filter("side = 1"), ["pair"])
    return P.largest_difference(found, ["pair"]).select("pair", F.round("db", 4).alias("largest"))


@query("j10_nearest_bin", f"with {DFT}, c as (select unnest([1000.0::double, 1875.0::double, 5000.0::double]) candidate) select track, candidate, arg_min(bin, (abs(freq - candidate), bin)) bin from dft, c group by all")
def j10(spark: SparkSession, d: str) -> DataFrame:
    c = F.broadcast(spark.createDataFrame([(1000.0,), (1875.0,), (5000.0,)], "candidate double"))
    return spectrum(spark, d).crossJoin(c).groupBy("track", "candidate").agg(F.min_by("bin", F.struct(F.abs(F.col("freq") - F.col("candidate")), "bin")).alias("bin"))


@query("j9_bins_in_bands", f"with {DFT}, b(lo, hi, band) as (values {', '.join(map(str, S.OCTAVES))}) select band, count(*) n, round(sum(power), 4) power from dft join b on freq >= lo and freq < hi group by band")
def j9(spark: SparkSession, d: str) -> DataFrame:
    sp = spectrum(spark, d).join(S.bands(spark, S.OCTAVES), (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi")))
    return sp.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("power"), 4).alias("power"))


# Screening on the reels and lines, whose nominal rate makes every detector's frames fit.
EVENT = ["track", "type", "a", "b", "score"]


@query("d1_clicks")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return N.click_events(V.lines(spark, d), 1000, 2.0).select(EVENT)


@query("d2_hum", f"with {DFT}, c as (select unnest([1500.0::double, 3000.0::double, 9100.0::double]) candidate), nb as (select track, candidate, arg_min(bin, (abs(freq - candidate), bin)) b from dft, c group by all), s as (select nb.track, nb.candidate, b, any_value(e.power) e, median(d.power) f from nb join dft d using (track) join dft e on e.track = nb.track and e.bin = nb.b where (d.bin - b >= -20 and d.bin - b < -3) or (d.bin - b >= 3 and d.bin - b < 20) group by all) select track, 'hum' type, 0::bigint a, 64::bigint b, round(10 * log10(e / f), 3) score from s where 10 * log10(e / f) > 6")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.hum_events(V.clips(spark, d), RATE, 64, [1500.0, 3000.0, 9100.0], 6.0).select(EVENT), 3, "score")


def planted(kind: str, *bits: int) -> str:
    """SQL: the takes in which something is planted that a detector must find, once each."""
    where = " or ".join(f"s_suppkey % 8 = {b} or s_suppkey // 8 % 8 = {b}" for b in bits)
    return f"select s_suppkey track, '{kind}' \"type\" from supplier where {where}"


def found(events: DataFrame) -> DataFrame:
    return events.select("track", "type")


@query("d3_sibilance", planted("sibilance", 4))
def d3(spark: SparkSession, d: str) -> DataFrame:
    return found(N.sibilance(V.takes(spark, d), V.TAKE_RATE))


@query("d4_breath", planted("breath", 5))
def d4(spark: SparkSession, d: str) -> DataFrame:
    return found(N.breath(V.takes(spark, d), V.TAKE_RATE))


@query("d5_background_noise", planted("background_noise", 6))
def d5(spark: SparkSession, d: str) -> DataFrame:
    return found(N.background_noise(V.takes(spark, d), V.TAKE_RATE))


@query("d6_rf_tones", f"select track, type, hz from ({planted('rf_noise', 7)}), (values (3000.0::double), (5000.0::double)) t(hz)")
def d6(spark: SparkSession, d: str) -> DataFrame:
    """A tone counts from the edge of its peak on, so its place is given to 10 Hz."""
    e = N.rf_tones(V.takes(spark, d), V.TAKE_RATE)
    return e.select("track", "type", F.explode("detail.tones").alias("t")).select("track", "type", F.round("t.frequency_hz", -1).alias("hz"))


@query("d7_mouth_clicks", f"select track, type, a from ({planted('mouth_click', 1)}), (values (5999)) p(a) union all select track, type, a from ({planted('mouth_click', 2)}), (values (8999)) p(a)")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return N.mouth_clicks(V.takes(spark, d), V.TAKE_RATE).select("track", "type", "a")


KINDS = [("click", [1]), ("hum", [3]), ("mouth_click", [1, 2]), ("sibilance", [4]), ("breath", [5]), ("background_noise", [6]), ("rf_noise", [7])]
COUNTS = " union all ".join(
    f"select s_suppkey track, '{kind}' issue, " + " + ".join(f"cast(s_suppkey % 8 = {b} or s_suppkey // 8 % 8 = {b} as bigint)" for b in bits) + " n from supplier" for kind, bits in KINDS
)


@query("u3_issue_counts", COUNTS + " union all select s_suppkey, 'unheard_of', 0 from supplier")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """All seven detectors over takes with known defects: events of each issue, zeros and an unknown one included."""
    takes = V.takes(spark, d)
    asked = ["Click", "hum", "mouth-de-click", "ess", "breath", "background noise", "rf", "click", " ", "unheard of"]
    return N.issue_counts(N.screened(takes, V.TAKE_RATE, asked), takes, asked)


#: Where each planted defect's event begins; whole-track events at 0.
STARTS = [("hum", 3, 0), ("rf_noise", 7, 0), ("click", 1, 5999), ("mouth_click", 1, 5999), ("mouth_click", 2, 8999), ("sibilance", 4, 1), ("breath", 5, 2), ("background_noise", 6, 3)]


@query("r7_event_order", "with e(track, type, a) as (" + " union all ".join(f"select s_suppkey, '{kind}', {a if a in (0, 5999, 8999) else 20000 + a} from supplier where s_suppkey % 8 = {b} or s_suppkey // 8 % 8 = {b}" for kind, b, a in STARTS) + ") select track, cast(row_number() over (partition by track order by a, type) as int) place, type from e")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return N.in_order(N.screened(V.takes(spark, d), V.TAKE_RATE)).select("track", "place", "type")


@query("a30_fingerprints")
def a30(spark: SparkSession, d: str) -> DataFrame:
    f = N.fingerprints(V.reels(spark, d), 1000, 0.128, 64, 32)
    return f.select("track", "spot", "window", F.round("level", 4).alias("level"), F.transform("mfcc", lambda v: F.round(v, 3)).alias("mfcc"))


@query("p17_resample")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.resampled(V.reels(spark, d), 48_000, 32_000, 240), 6, "x")


@query("p21_delivery", f"with {V.CLIPS}, b as (select track, channel, i, x - avg(x) over (partition by track, channel) x from clips), c as (select track, channel, i + 4 i, x * case when i < 8 then i / 7.0::double else 1 end * case when i >= 48 then (63 - i) / 15.0::double else 1 end x from b), t as (select distinct track from c) select track, channel, i, round(x, 6) x from (select * from c union all select track, 0, unnest([0, 1, 2, 3, 68, 69]), 0.0 from t)")
def p21(spark: SparkSession, d: str) -> DataFrame:
    ops = E.delivery_operations(True, 4.0, 0.002, 8.0, 0.016)
    return rounded(E.render(V.clips(spark, d), ops, 1000), 6, "x")


@query("x1_user_function", f"with {V.CLIPS} select track, channel, i, round(greatest(-0.05, least(0.05, x * 2)), 6) x from clips")
def x1(spark: SparkSession, d: str) -> DataFrame:
    chunks = S.chunked(V.clips(spark, d), 32).withColumn("rate", F.lit(RATE))
    out = W.apply_chunks(chunks, lambda x, rate: (x * 2).clip(-0.05, 0.05))
    return rounded(out.select("track", "channel", "start", F.posexplode("xs").alias("k", "x")).select("track", "channel", (F.col("start") + F.col("k")).alias("i"), "x"), 6, "x")


@query("s2_wav_round_trip", f"with {V.CLIPS} select cast(track as varchar) track, channel, i, round(round(greatest(-1, least(1, x)) * 8388607) / 8388608, 5) x from clips")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Clips as 24-bit WAV bytes and read again."""
    files = W.wav_files(V.clips(spark, d), RATE).withColumnRenamed("track", "path")
    return rounded(W.samples_of(W.read_wav(files)), 5, "x")


@query("s3_wav_info", f"with {V.CLIPS} select cast(track as varchar) path, 48000 rate, 1 channels, count(*) frames, count(*) / 48000.0::double duration, 'PCM_24' subtype, 24 bit_depth from clips group by track")
def s3(spark: SparkSession, d: str) -> DataFrame:
    files = W.wav_files(V.clips(spark, d), RATE).withColumnRenamed("track", "path").withColumn("length", F.octet_length("content"))
    return W.wav_info(files).select("path", "rate", "channels", "frames", "duration", "subtype", "bit_depth")


@query("s4_wav_sizes", f"with {V.CLIPS} select cast(track as varchar) track, 44 + 3 * count(*) bytes from clips group by track")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """One 24-bit file per track."""
    return W.wav_files(V.clips(spark, d), RATE).select("track", F.octet_length("content").cast("long").alias("bytes"))


@query("s11_changed_sources", "select cast(doc_id as varchar) path, doc_id % 5 = 0 changed from documents where text is not null")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sources; every fifth was another when its edits were made."""
    t = V.read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    edits = t.select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("older").cast("binary"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return W.changed_sources(t, edits).select("path", "changed")


# Meters: the stream's results are those of its batch twin, which SQL follows. Complete mode, so no window is left open.
def streamed(spark: SparkSession, d: str, job) -> DataFrame:
    """In append mode, closed at the end."""
    return T.finished(T.events(spark, d), job)


LIVE = "ev as (select user_id track, ts, (value - 250) / 250 x from events)"


@query("t1_block_meter", f"with {LIVE} select track, date_trunc('day', ts) \"start\", round(sqrt(avg(x * x)), 6) rms, round(max(abs(x)), 6) peak, count(*) filter (abs(x) >= 1) clipped from ev group by 1, 2")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(streamed(spark, d, T.block_meter), 6, "rms", "peak")


@query("t1_mix_meter", f"with {LIVE} select -1::bigint track, date_trunc('day', ts) \"start\", round(sqrt(avg(x * x)), 6) rms, round(max(abs(x)), 6) peak, count(*) filter (abs(x) >= 1) clipped from ev group by 2")
def t1_mix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(streamed(spark, d, T.mix_meter), 6, "rms", "peak")


@query("t2_short_term_level", f"with {LIVE} select track, date_trunc('day', ts) - to_days(cast(k as int)) \"start\", round(10 * log10(greatest(avg(x * x), 1e-12)), 4) \"level\" from ev, (select unnest([0, 1, 2]) k) group by 1, 2")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(streamed(spark, d, T.short_term_level), 4, "level")


@query("t3_activity", f"with {LIVE}, a as (select * from ev where abs(x) > 0.5), g as (select *, sum(nw) over (partition by track order by ts) grp from (select *, case when ts - lag(ts) over (partition by track order by ts) < interval 6 hours then 0 else 1 end nw from a)) select track, min(ts) \"start\", max(ts) \"end\", count(*) n from g group by track, grp having max(ts) - min(ts) >= interval 1 hour")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, lambda s: T.activity(s, 0.5))


@query(
    "t4_carried_state",
    f"""with recursive {LIVE}, o as (select *, row_number() over w k, coalesce(ts - lag(ts) over w > interval 1 hour, true) fresh from ev window w as (partition by track order by ts, x)),
    f as (select track, ts, k, 0.2 * abs(x) y from o where k = 1 union all select o.track, o.ts, o.k, case when o.fresh then 0 else f.y end * 0.8 + 0.2 * abs(o.x) from f join o on o.track = f.track and o.k = f.k + 1)
    select track, ts, round(y, 6) y from f""",
)
def t4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(streamed(spark, d, T.in_order), 6, "y")
