"""Queries of mixing, gains, catalogs, texts and set operations over the views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import catalogs as K
from undula.operators import edits as E
from undula.operators import layers as Y
from undula.operators import mix as X
from undula.operators import regions as R
from undula.operators import spectral as S
from undula.operators.histories import histories
from undula.plans import views as V
from undula.plans.measure_queries import LEVELS, rounded
from undula.plans.registry import query


def supplier_signal(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's order lines, as stereo."""
    return E.stereo(V.lines(spark, d))


ON = f"{V.MIX}, act as (select * from (select *, bool_or(solo) over (partition by mix) s from mix_tracks) where not mute and (solo or not s))"
MIXED = f"{V.LINES}, {ON}, c as (select cast(unnest([0, 1]) as int) ch), mx as (select mix, c.ch channel, i + shift i, sum(x * pow(10, gain_db / 20) * case when c.ch = 0 then cos((greatest(-1, least(1, pan)) + 1) * pi() / 4) else sin((greatest(-1, least(1, pan)) + 1) * pi() / 4) end) x from lines join act using (track), c group by all)"


@query("j1_mix", f"with {MIXED} select mix, channel, i, round(x, 6) x from mx")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.mixed(supplier_signal(spark, d), V.mix_tracks(spark, d)), 6, "x")


@query("j1_clip_flags", f"with {MIXED} select mix, round(max(abs(x)), 6) peak, max(abs(x)) > 1 clipped from mx group by mix")
def j1_flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.clip_flags(X.mixed(supplier_signal(spark, d), V.mix_tracks(spark, d))), 6, "peak")


NAMES = ["Kick In", "snare_top", "Lead-Vox", "Bass DI", "acou gtr", "Room L", "Pad", "FX riser", "backing vox 2", "Hi-Hat"]
NAME_SQL = "case track % 10 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(NAMES)) + " end"
PLAIN = "replace(replace(replace(lower(nm), '-', ''), '_', ''), ' ', '')"


def group_sql(name: str = PLAIN) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({name}, '{w}')" for w in words.split()) + f" then '{g}'" for g, words in X.KEYWORDS) + " else 'other' end"


def named(d: DataFrame, key: str = "track") -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col(key) % 10 + 1).cast("int"))
    return d.withColumn("name", name)


@query("f5_groups", f"with {V.MIX}, t as (select mix, track, {NAME_SQL} nm from mix_tracks) select mix, track, {group_sql()} \"group\" from t")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return X.classified(named(V.mix_tracks(spark, d))).select("mix", "track", "group")


REL = "rel(g, kw, lv, pl) as (values " + ", ".join(f"('{g}', '{k}', {v}::double, {i})" for g, levels in X.LEVELS.items() for i, (k, v) in enumerate(levels.items())) + ")"
RELATIVE = f"{V.MIX}, {REL}, t as (select mix, track, {NAME_SQL} nm from mix_tracks), tg as (select *, {group_sql()} grp from t), rl as (select mix, track, grp, coalesce((select lv from rel where g = grp and contains({PLAIN}, kw) order by length(kw) desc, pl limit 1), 0) rel from tg)"


@query("f6_relative", f"with {RELATIVE} select mix, track, rel relative from rl")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return X.with_relative(X.classified(named(V.mix_tracks(spark, d)))).select("mix", "track", "relative")


def level_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips as tracks of 20 mixes: names with RMS, total band power, band levels."""
    s = V.clips(spark, d)
    bands = S.mix_band_levels(s, 48_000, 64, 64).withColumn("mix", (F.col("track") % 20).cast("int"))
    rms = s.groupBy("track").agg((20 * F.log10(F.greatest(F.sqrt(F.avg(F.col("x") * F.col("x"))), F.lit(1e-10)))).alias("rms_db"))
    tracks = named(rms.withColumn("mix", (F.col("track") % 20).cast("int")).withColumn("key", F.floor(F.col("track") / 20)), "key").drop("key")
    return tracks, bands.groupBy("mix", "track").agg(F.sum(X.power(F.col("level"))).alias("power")), bands


TOTAL = sum(10 ** (v / 10) for v in X.PROFILES["rock"])
BAL = "map {" + ", ".join(f"'{k}': {v}::double" for k, v in X.BALANCE.items()) + "}"
PLACE = "map {" + ", ".join(f"'{k}': {i}" for i, k in enumerate([*(g for g, _ in X.KEYWORDS), "other"])) + "}"
GAINS = f"""{LEVELS}, {REL}, tw as (select track, sum(pow(10, level / 10)) pw from lv group by track), tr as (select track, cast(track % 20 as int) mix, 20 * log10(greatest(sqrt(avg(x * x)), 1e-10)) rms, {NAME_SQL.replace('track % 10', '(track // 20) % 10')} nm from clips group by track),
tg as (select *, {group_sql()} grp from tr join tw using (track)), rl as (select *, coalesce((select lv from rel where g = grp and contains({PLAIN}, kw) order by length(kw) desc, pl limit 1), 0) rel from tg),
g1 as (select *, max(rms) over (partition by mix, grp) + rel - rms g from rl), g2 as (select *, 10 * log10(greatest(sum(pow(10, (rms + g) / 10)) over (partition by mix, grp), 1e-20)) gdb from g1),
g3 as (select *, case when bool_or(grp = 'drums') over (partition by mix) then 'drums' else arg_max(grp, (gdb, -{PLACE}[grp])) over (partition by mix) end ref from g2), g4 as (select *, max(case when grp = ref then gdb end) over (partition by mix) refdb from g3),
g5 as (select * replace (g + case when grp = ref then 0 else {BAL}[grp] - {BAL}[ref] - (gdb - refdb) end as g) from g4), g6 as (select *, sum(pw * pow(10, g / 10)) over (partition by mix) mp from g5),
gx as (select mix, track, grp, greatest(-24, least(12, g + case when mp > 1e-20 then 10 * log10({TOTAL!r}::double / mp) else 0 end)) exact from g6)"""


@query("a28_gains", f"with {GAINS} select mix, track, grp \"group\", round(exact, 1) gain_db from gx")
def a28(spark: SparkSession, d: str) -> DataFrame:
    tracks, power, _ = level_rows(spark, d)
    return X.recommended(tracks, power, list(X.PROFILES["rock"])).select("mix", "track", "group", "gain_db")


@query("a28_flat_gains", f"with {LEVELS}, tw as (select track, cast(track % 20 as int) mix, sum(pow(10, level / 10)) pw from lv group by track) select mix, track, round(greatest(-24, least(12, case when pw > 1e-20 then 10 * log10({TOTAL!r}::double / count(*) over (partition by mix) / pw) else 0 end)), 1) gain_db from tw")
def a28_flat(spark: SparkSession, d: str) -> DataFrame:
    tracks, power, _ = level_rows(spark, d)
    return X.recommended(tracks, power, list(X.PROFILES["rock"]), grouped=False).select("mix", "track", "gain_db")


GOAL = "map {" + ", ".join(f"'{b[2]}': {v}::double" for b, v in zip(S.MIX_BANDS, X.PROFILES["rock"], strict=True)) + "}"


@query("a29_residual", f"with {GAINS}, b as (select mix, band, sum(pow(10, (level + exact) / 10)) p from lv join gx using (track) group by all) select mix, round(10 * log10(greatest(avg(pow(p - pow(10, {GOAL}[band] / 10), 2)), 1e-20)), 3) residual_db from b group by mix")
def a29(spark: SparkSession, d: str) -> DataFrame:
    tracks, power, bands = level_rows(spark, d)
    goal = {b[2]: v for b, v in zip(S.MIX_BANDS, X.PROFILES["rock"], strict=True)}
    return rounded(X.residual(X.recommended(tracks, power, list(goal.values())), bands, goal), 3, "residual_db")


@query("a29_recommendation", f"with {GAINS} select gx.mix, gx.track, gx.grp \"group\", round(gx.exact, 1) gain_db, round(any_value(tr.rms), 1) rms_db, " + ", ".join(f"round(max(level) filter (band = '{b[2]}'), 1) {b[2]}" for b in S.MIX_BANDS) + " from gx join tr using (track) join lv using (track) group by all")
def a29_whole(spark: SparkSession, d: str) -> DataFrame:
    """Gains with the table of band levels that they come from."""
    tracks, _, bands = level_rows(spark, d)
    gains, _ = X.recommendation(tracks, bands, X.target_levels("rock", S.MIX_BANDS))
    return gains.drop("exact")


@query("a29_reference_track", f"with {LEVELS}, g as (select band, level goal from lv where track = 7), own as (select track, band, level from lv) select track, round(sum(abs(level - goal)), 3) distance from own join g using (band) group by track")
def a29_reference(spark: SparkSession, d: str) -> DataFrame:
    """How far every track's bands are from those of a reference track."""
    _, _, bands = level_rows(spark, d)
    goal = X.measured_target(bands, 7)
    table = F.create_map(*(F.lit(v) for pair in goal.items() for v in pair))
    return bands.groupBy("track").agg(F.round(F.sum(F.abs(F.col("level") - table[F.col("band")])), 3).alias("distance"))


PROF = ", ".join(f"('{k}', '{b[2]}', {v}::double)" for k, vs in X.PROFILES.items() for b, v in zip(S.MIX_BANDS, vs, strict=True))
PINK = ", ".join(f"({i}, '{b[2]}', {b[0]}::double, {b[1]}::double)" for i, b in enumerate(S.MIX_BANDS))


@query("a27_profiles", f"with {LEVELS}, p(profile, band, target) as (values {PROF}), k(i, band, lo, hi) as (values {PINK}), al as (select * from p union all select 'pink', band, -20 - 10 * log10(sqrt(lo * hi) / sqrt(20.0::double * 200)) from k), own as (select band, avg(level) m from lv group by band) select profile, band, round(target, 4) target, round(m - target, 4) distance from al join own using (band)")
def a27(spark: SparkSession, d: str) -> DataFrame:
    """Every profile against the mean band levels of all clips."""
    rows = [(k, b[2], v) for k, vs in X.PROFILES.items() for b, v in zip(S.MIX_BANDS, vs, strict=True)]
    rows += [("pink", b[2], v) for b, v in zip(S.MIX_BANDS, X.pink_profile([b[:2] for b in S.MIX_BANDS]), strict=True)]
    table = F.broadcast(spark.createDataFrame(rows, "profile string, band string, target double"))
    own = S.mix_band_levels(V.clips(spark, d), 48_000, 64, 64).groupBy("band").agg(F.avg("level").alias("m"))
    return own.join(table, "band").select("profile", "band", F.round("target", 4).alias("target"), F.round(F.col("m") - F.col("target"), 4).alias("distance"))


@query("j2_mixdown", f"with {V.LINES}, {V.MIX}, rg as (select track, -6 - 20 * log10(greatest(sqrt(avg(x * x)), 1e-10)) g from lines group by track), act as (select * from (select *, bool_or(solo) over (partition by mix) s from mix_tracks) where not mute and (solo or not s)), c as (select cast(unnest([0, 1]) as int) ch), mx as (select mix, c.ch channel, i + shift i, sum(x * pow(10, (gain_db + g) / 20) * case when c.ch = 0 then cos((greatest(-1, least(1, pan)) + 1) * pi() / 4) else sin((greatest(-1, least(1, pan)) + 1) * pi() / 4) end) x from lines join act using (track) join rg using (track), c group by all), e as (select mix, channel, max(i) + 1 n from mx group by all) select mix, channel, i, round(x, 5) x from (select mix, channel, i - 3 i, x from mx where i >= 3 union all select mix, channel, n - 3 + unnest([0, 1, 2]), 0.0 from e)")
def j2(spark: SparkSession, d: str) -> DataFrame:
    s = supplier_signal(spark, d)
    own = V.lines(spark, d).groupBy("track").agg((-6 - 20 * F.log10(F.greatest(F.sqrt(F.avg(F.col("x") * F.col("x"))), F.lit(1e-10)))).alias("g"))
    config = V.mix_tracks(spark, d).join(own, "track").withColumn("gain_db", F.col("gain_db") + F.col("g"))
    out = E.delay_compensated(X.mixed(s, config).withColumnRenamed("mix", "track"), 3)
    return rounded(out.withColumnRenamed("track", "mix"), 5, "x")


THEIRS = "th as (select mix, case when track % 3 = 0 then ' ' || name || ' ' else name end name, gain_db + (track % 9 - 4) * 1.1::double gain_db from mix_tracks where track % 4 <> 1)"
PAIRS = f"{V.MIX}, {THEIRS}, pr as (select o.mix, o.name, o.gain_db ours, coalesce(a.gain_db, b.gain_db) theirs, o.gain_db - coalesce(a.gain_db, b.gain_db) diff from mix_tracks o left join th a on a.mix = o.mix and trim(a.name) = trim(o.name) left join th b on b.mix = o.mix and b.name = o.name where coalesce(a.gain_db, b.gain_db) is not null)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    m = V.mix_tracks(spark, d)
    k = F.col("track")
    theirs = m.filter(k % 4 != 1).select("mix", F.when(k % 3 == 0, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.col("name")).alias("name"), (F.col("gain_db") + (k % 9 - 4) * 1.1).alias("gain_db"))
    return X.compared(m.select("mix", "name", "gain_db"), theirs)


@query("j3_compare", f"with {PAIRS} select mix, count(*) n, round(avg(abs(diff)), 6) mean_abs, round(max(abs(diff)), 6) max_abs, round(100 * avg(case when abs(diff) <= 3 then 1.0::double else 0 end), 4) within_pct from pr group by mix")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(X.errors(pairs(spark, d)), 6, "mean_abs", "max_abs"), 4, "within_pct")


@query("r6_ranked", f"with {PAIRS}, r as (select mix, 'worst' kind, cast(row_number() over (partition by mix order by abs(diff) desc, name) as int) place, name, diff from pr union all select mix, 'closest', cast(row_number() over (partition by mix order by abs(diff), name) as int), name, diff from pr) select mix, kind, place, name, round(diff, 6) diff from r where place <= case when kind = 'worst' then 15 else 5 end")
def r6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.ranked(pairs(spark, d)), 6, "diff")


@query("j14_import_gains", f"with {V.MIX}, sv as (select name, 1.5::double g from mix_tracks where track % 2 = 0) select mix, track, coalesce(g, gain_db) gain_db, g is not null matched from mix_tracks left join sv using (name)")
def j14(spark: SparkSession, d: str) -> DataFrame:
    m = V.mix_tracks(spark, d)
    saved = m.filter(F.col("track") % 2 == 0).select("name", F.lit(1.5).alias("gain_db"))
    return X.imported(m.select("mix", "track", "name", "gain_db"), saved).select("mix", "track", "gain_db", "matched")


# Catalogs and texts.
SHORT = r"""regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace("name", '^RX\s+[0-9]+\s+', ''), '(?i)^(iZotope|Waves|FabFilter|Sonnox)\s+', ''))), '\s+', '-', 'g'), '-+', '-', 'g')"""
CATALOG = f"{V.PLUGINS}, cat as (select *, {SHORT} short from plugins)"


@query("f1_short_names", f"with {CATALOG} select key, short from cat")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return K.with_short_names(V.plugins(spark, d)).select("key", "short")


LAST = "lst as (select * from (select *, row_number() over (partition by short, format order by key desc) k from cat) where k = 1)"
SCAN = f"{CATALOG}, {LAST}, sc as (select short, key, vendor, format, path from lst where format = 'vst3' union all select short, key, vendor, format, path from lst where format = 'au' and short not in (select short from lst where format = 'vst3'))"


def scan(spark: SparkSession, d: str) -> DataFrame:
    c = K.with_short_names(V.plugins(spark, d))
    return K.scanned(c.filter("format = 'vst3'"), c.filter("format = 'au'"))


@query("j4_scan", f"with {SCAN} select short, key, vendor, format, path from sc")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d).select("short", "key", "vendor", "format", "path")


ASKED = "ask as (select distinct q \"name\" from (select short q from sc where key % 5 = 0 union all select 'alias-' || key from sc where key % 5 = 1 union all select substr(short, 1, greatest(length(short) - 1, 4)) from sc where key % 5 = 2 union all select 'nothing-' || key from sc where key % 5 = 3))"


@query("j5_resolve", f"with {SCAN}, {ASKED}, al as (select 'alias-' || key \"name\", short from sc), pt as (select ask.\"name\", case when count(distinct short) = 1 then min(short) end p from ask join sc on contains(short, ask.\"name\") group by 1) select ask.\"name\", coalesce(e.short, al.short, p) short from ask left join sc e on e.short = ask.\"name\" left join al on al.\"name\" = ask.\"name\" left join pt on pt.\"name\" = ask.\"name\"")
def j5(spark: SparkSession, d: str) -> DataFrame:
    c = scan(spark, d).withColumn("aliases", F.array(F.concat(F.lit("alias-"), F.col("key").cast("string"))))
    k, s = F.col("key") % 5, F.col("short")
    part = F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(4)))
    asked = c.select(F.when(k == 0, s).when(k == 1, F.element_at("aliases", 1)).when(k == 2, part).when(k == 3, F.concat(F.lit("nothing-"), F.col("key").cast("string"))).alias("name")).filter("name is not null")
    return K.resolved(asked, c)


@query("j6_still_there", f"with {CATALOG} select key, path from cat where key in (select l_partkey from lineitem where l_suppkey % 3 = 0)")
def j6(spark: SparkSession, d: str) -> DataFrame:
    paths = V.read(spark, d, "lineitem").filter("l_suppkey % 3 = 0").select(F.concat(F.lit("/plugins/"), F.col("l_partkey").cast("string")).alias("path"))
    return K.still_there(V.plugins(spark, d), paths).select("key", "path")


@query("j7_listed", f"with {CATALOG} select key, vendor, format from cat where format = 'au' and contains(lower(vendor), '#1')")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return K.listed(V.plugins(spark, d), "au", "#1").select("key", "vendor", "format")


GAINED = f"{V.REELS}, sg(a, b, g) as (values (0, 100, -6.0::double), (100, 250, 2.0::double), (300, 700, -1.0::double))"


@query("j8_segment_gains", f"with {GAINED}, w as (select *, coalesce(lag(g) over (order by a), 0) p from sg) select track, channel, i, round(x * case when i - a < 20 and abs(pow(10, g / 20) - pow(10, p / 20)) > 1e-6 then pow(10, p / 20) + (pow(10, g / 20) - pow(10, p / 20)) * ((i - a) / 19.0::double) else pow(10, g / 20) end, 6) x from reels join w on i >= a and i < b")
def j8(spark: SparkSession, d: str) -> DataFrame:
    from undula.operators import loudness as L

    s = V.reels(spark, d)
    segments = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(g).alias("gain_db"), F.lit(p).alias("was_db")) for a, b, g, p in ((0, 100, -6.0, 0.0), (100, 250, 2.0, -6.0), (300, 700, -1.0, 2.0))))
    gains = s.select("track").distinct().select("track", F.explode(segments).alias("s")).select("track", "s.*")
    return rounded(L.apply_gains(s, gains, 20, 256), 6, "x")


@query("j15_grid", "select s_suppkey source, cast(r as int) ratio, t threshold, k knee from supplier, (select unnest([2, 4, 8]) r), (select unnest([-30.0::double, -20.0::double]) t), (select unnest(['hard', 'soft']) k)")
def j15(spark: SparkSession, d: str) -> DataFrame:
    base = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source"))
    return K.grid(base, {"ratio": [2, 4, 8], "threshold": [-30.0, -20.0], "knee": ["hard", "soft"]})


@query("f2_parameters", r"""select event_id, list_extract(list_filter(string_split(s, ';'), lambda p: starts_with(p, 'mode=')), 1)[6:] "mode", cast(list_extract(list_filter(string_split(s, ';'), lambda p: starts_with(p, 'gain=')), 1)[6:] as double) gain, event_id % 2 = 0 "on", 1 bad from (select event_id, 'mode=' || event_type || ';gain=' || value || ';on=' || case when event_id % 2 = 0 then 'true' else 'False' end || ';odd' s from events)""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    items = F.array(F.concat(F.lit("mode="), "event_type"), F.concat(F.lit("gain="), F.col("value").cast("string")), F.concat(F.lit("on="), F.when(k % 2 == 0, "true").otherwise("False")), F.lit("odd"))
    t = V.read(spark, d, "events").select("event_id", C.parameters(items).alias("p"), F.size(C.bad_parameters(items)).alias("bad"))
    return t.select("event_id", C.typed(F.col("p")["mode"])["text"].alias("mode"), C.typed(F.col("p")["gain"])["num"].alias("gain"), C.typed(F.col("p")["on"])["flag"].alias("on"), "bad")


@query("f3_chain", "select event_id, cast(p as int) step, case p when 0 then 'denoise' when 1 then event_type else 'gate' end plugin, case p when 0 then cast(user_id as varchar) when 1 then 'x' end a from events, (select unnest([0, 1, 2]) p)")
def f3(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("denoise:a="), F.col("user_id").cast("string"), F.lit(";b=2, ,"), "event_type", F.lit(":a=x,gate,"))
    t = V.read(spark, d, "events").select("event_id", F.posexplode(C.chain_steps(text)).alias("step", "s"))
    return t.select("event_id", "step", "s.plugin", F.col("s.params")["a"].alias("a"))


ALIASES = "al(name, issue) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in C.ISSUE_ALIASES.items()) + ")"


@query(
    "f4_issues",
    f"""with {ALIASES}, raw as (select event_id, unnest([event_type, ' De-Ess', 'de_ess', 'Mouth-De-Click', 'mouth_de_click', 'rf', 'RF-Noise', 'Background Noise', 'noise', 'ess', 'mouth-click', 'clicks', ' ', event_type]) s, unnest(range(14)) k from events),
    named as (select event_id, k, coalesce(issue, replace(lower(trim(s)), ' ', '_')) issue from raw left join al on name = replace(lower(trim(s)), ' ', '_') where trim(s) <> ''),
    once as (select event_id, issue, min(k) k from named group by all)
    select event_id, string_agg(issue, ',' order by k) names, string_agg(issue, ',' order by k) filter (issue not in ({", ".join(f"'{i}'" for i in C.ISSUES)})) unsupported from once group by event_id""",
)
def f4(spark: SparkSession, d: str) -> DataFrame:
    asked = ["event_type", *map(F.lit, (" De-Ess", "de_ess", "Mouth-De-Click", "mouth_de_click", "rf", "RF-Noise", "Background Noise", "noise", "ess", "mouth-click", "clicks", " ")), "event_type"]
    n = C.issue_names(F.array(*asked))
    return V.read(spark, d, "events").select("event_id", F.array_join(n, ",").alias("names"), F.array_join(C.unsupported_issues(n), ",").alias("unsupported"))


@query("f7_overlay", "select event_id, event_type \"mode\", cast(value as varchar) gain, case when event_id % 3 = 0 then 'user' else 'preset' end who from events")
def f7(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("mode"), F.lit("none"), F.lit("gain"), F.lit("0"), F.lit("who"), F.lit("preset"))
    over = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("mode"), "event_type", F.lit("gain"), F.col("value").cast("string"), F.lit("who"), F.lit("user"))).otherwise(F.create_map(F.lit("mode"), "event_type", F.lit("gain"), F.col("value").cast("string")))
    m = C.overlaid(base, over)
    return V.read(spark, d, "events").select("event_id", m["mode"].alias("mode"), m["gain"].alias("gain"), m["who"].alias("who"))


@query("s5_output_paths", "select p_partkey key, '/out/' || p_brand || '/' || p_partkey || '_v2.flac' path from part")
def s5(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".wav"))
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("key"), C.output_path(path, "/in", "/out", "_v2", ".flac").alias("path"))


NOTES = f"{V.CLIPS}, nt as (select track, i frame, round(60 + x * 12, 3) \"value\", 4 + i % 3 duration from clips)"


@query("s7_headers", f"with {NOTES} select track, 'instants' kind, 1 dimensions, count(*) n, cast(0 as bigint) \"start\", max(frame) \"end\", null::double least, null::double most, null::int bins from nt group by track union all select track, 'values', 2, count(*), 0, max(frame), min(value), max(value), null from nt group by track union all select track, 'notes', 3, count(*), 0, max(frame + duration), min(value), max(value), null from nt group by track union all select cast(label as bigint), 'dense', 3, count(*), 0, null, round(min(list_min(embedding)::double), 6), round(max(list_max(embedding)::double), 6), 64 from embeddings group by label")
def s7(spark: SparkSession, d: str) -> DataFrame:
    """The headers of all four kinds of layers."""
    points = notes(spark, d)
    dense = V.read(spark, d, "embeddings").select(F.col("label").cast("long").alias("track"), F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("bins"))
    heads = [Y.headers(points, kind) for kind in ("instants", "values", "notes")]
    return reduce(DataFrame.unionByName, heads).unionByName(rounded(Y.headers(dense, "dense"), 6, "least", "most"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    return V.clips(spark, d).select("track", F.col("i").alias("frame"), F.round(60 + F.col("x") * 12, 3).alias("value"), (4 + F.col("i") % 3).alias("duration"))


@query("s7_layer_lines", f"""with {NOTES}, ln as (select track, 1 part, frame k, '<point frame="' || frame || '" label=""/>' line from nt
union all select track, 0, 0, '<sv><data><model id="0" name="instants" sampleRate="48000" start="0" end="' || max(frame) || '" type="sparse" dimensions="1" resolution="512" dataset="0"/><dataset id="0" dimensions="1">' from nt group by track
union all select distinct track, 2, 0, '</dataset></data></sv>' from nt) select track, cast(row_number() over (partition by track order by part, k, line) - 1 as int) place, line from ln""")
def s7_lines(spark: SparkSession, d: str) -> DataFrame:
    return Y.lines(notes(spark, d), "instants", 48_000)


@query("s8_sessions", f"with {V.MIX}, o as (select mix, track, row_number() over (partition by mix order by track) - 1 k, case when mix % 5 = 0 then 'output' end err, gain_db, pan, mute, solo, shift from mix_tracks) select mix session, err error, cast(k as int) k, case when track % 4 = 0 then '/abs/' || track || '.wav' else '/sessions/' || mix || '/in/' || track || '.wav' end path, case when track % 2 = 0 then gain_db else 0 end gain_db, pan, case when track % 3 = 0 then mute else false end mute, false solo, shift \"offset\" from o")
def s8(spark: SparkSession, d: str) -> DataFrame:
    m, k = V.mix_tracks(spark, d), F.col("track")
    one = F.struct(k.alias("n"), F.concat(F.when(k % 4 == 0, "/abs/").otherwise("./in//"), k.cast("string"), F.lit(".wav")).alias("path"), F.when(k % 2 == 0, F.col("gain_db")).alias("gain_db"), "pan", F.when(k % 3 == 0, F.col("mute")).alias("mute"), F.col("shift").alias("offset_samples"))
    texts = m.groupBy(F.col("mix").alias("session")).agg(F.max("mix").alias("mix"), F.sort_array(F.collect_list(one)).alias("t")).select("session", F.to_json(F.struct(F.when(F.col("mix") % 5 != 0, "out.wav").alias("output"), F.col("t").alias("tracks"))).alias("body"))
    return K.session_tracks(texts.withColumn("file", F.concat(F.lit("/sessions/"), F.col("session").cast("string"), F.lit("/set.json"))))


@query("s9_presets", "select event_type plugin, 'user' || user_id \"name\", ts created, value from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) k from events) where k = 1 and event_id % 6 <> 0")
def s9(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "events").select(F.col("event_type").alias("plugin"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("created"), F.when(F.col("event_id") % 6 == 0, "delete").otherwise("save").alias("action"), "value")
    return K.presets(t)


@query("s10_edit_lists", "select user_id source, event_id % 10 = 0 refused, cast(p as int) op_no, case p when 0 then 'gain' else 'trim' end type, case p when 0 then cast(event_id as varchar) end db from (select user_id, max(event_id) event_id from events group by user_id), (select unnest([0, 1]) p)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(F.max("event_id").alias("k"))
    body = F.concat(F.lit('{"version": '), F.when(F.col("k") % 10 == 0, "2").otherwise("1"), F.lit(', "ops": [{"type": "gain", "db": "'), F.col("k").cast("string"), F.lit('"}, {"type": "trim", "start_sec": "0"}]}'))
    t = K.edit_lists(e.select("source", body.alias("body")))
    return t.select("source", "refused", "op_no", "type", F.col("params")["db"].alias("db"))


@query("s12_dump", "select event_type plugin, count(*) n, string_agg(u || '=' || v, ',' order by u) params from (select event_type, 'p' || lpad(user_id::varchar, 4, '0') u, count(*) v from events where contains(event_type, 'c') group by all) group by 1")
def s12(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "events").groupBy(F.col("event_type").alias("plugin"), F.concat(F.lit("p"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("name")).agg(F.count("*").cast("string").alias("value"))
    return K.dumped(t, "c").select("plugin", "n", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("params"))


@query("x2_extractor_rows", f"with {V.CLIPS} select track, cast(round_even(i * 0.01::double * 48000, 0) as bigint) frame, round(x, 6) v from clips")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """A feature vector (step 0.01 s) as rows."""
    e = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.lit(0.01).alias("step"), F.col("embedding").alias("values"))
    return Y.vector_rows(e, 48_000).select("track", "frame", F.round("value", 6).alias("v"))


@query("x2_extractor_lists", "select user_id track, count(*) n, min(cast(round_even(event_id * 0.25::double * 100, 0) as bigint)) first_frame, round(sum(case when event_id % 3 = 0 then 0 else value end), 4) total, count(*) filter (event_id % 5 = 0) unlabelled from events group by 1")
def x2_lists(spark: SparkSession, d: str) -> DataFrame:
    """Events with a time, values (some have none) and a label (some have none)."""
    e = F.struct((F.col("event_id") * 0.25).alias("timestamp"), F.when(F.col("event_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array("value")).alias("values"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("label"))
    results = V.read(spark, d, "events").groupBy(F.col("user_id").alias("track")).agg(F.collect_list(e).alias("events"))
    return Y.list_rows(results, 100).groupBy("track").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("label") == "").alias("unlabelled"))


@query("x2_extractor_matrices", "select cast(label as bigint) track, count(*) n, 480 hop, round(sum(list_sum(embedding::double[])), 4) total from embeddings group by label")
def x2_matrices(spark: SparkSession, d: str) -> DataFrame:
    results = V.read(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("track")).agg(F.collect_list("embedding").alias("rows")).withColumn("step", F.lit(0.01))
    r = Y.matrix_rows(results, 48_000)
    total = F.aggregate("bins", F.lit(0.0), lambda a, x: a + x)
    return r.groupBy("track").agg(F.count("*").alias("n"), F.max("hop").cast("int").alias("hop"), F.round(F.sum(total), 4).alias("total"))


@query(
    "t5_histories",
    """with recursive log as (select user_id source, row_number() over (partition by user_id order by ts, event_id) k, 'op' || event_id op,
      case when event_type in ('click', 'purchase') then 'add' when event_type = 'view' then 'undo' when event_type = 'error' then 'redo' else 'clear' end action from events),
    walked as (
      select source, cast(0 as bigint) k, [{'n': cast(0 as bigint), 'op': ''}] past, [{'n': cast(0 as bigint), 'op': ''}][:0] future from (select distinct source from log)
      union all
      select w.source, l.k,
        case when action = 'add' then list_append(past, {'n': past[-1].n + 1, 'op': l.op}) when action = 'clear' then list_append(past, {'n': cast(0 as bigint), 'op': ''})
          when action = 'undo' and len(past) >= 2 then past[:-2] when action = 'redo' and len(future) > 0 then list_append(past, future[-1]) else past end,
        case when action in ('add', 'clear') then future[:0] when action = 'undo' and len(past) >= 2 then list_append(future, past[-1])
          when action = 'redo' and len(future) > 0 then future[:-2] else future end
      from walked w join log l on l.source = w.source and l.k = w.k + 1)
    select source, past[-1].n n_ops, len(past) - 1 undo, len(future) redo, past[-1].op "last" from (select *, row_number() over (partition by source order by k desc) r from walked) where r = 1""",
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    """The list of every user after the last step: its length, its last operation, and how often undo and redo can go on."""
    act = F.col("event_type")
    action = F.when(act.isin("click", "purchase"), "add").when(act == "view", "undo").when(act == "error", "redo").otherwise("clear")
    log = V.read(spark, d, "events").select(F.col("user_id").alias("source"), F.struct("ts", "event_id").alias("k"), action.alias("action"), F.concat(F.lit("op"), F.col("event_id").cast("string")).alias("op"))
    found = histories(log)
    return found.select("source", F.size("ops").cast("long").alias("n_ops"), "undo", "redo", F.coalesce(F.try_element_at("ops", F.lit(-1)), F.lit("")).alias("last"))


@query("r4_spaced_top", f"with recursive {V.CLIPS}, o as (select track, i, x, row_number() over (partition by track order by x desc, i desc) k from clips), g as (select track, cast(0 as bigint) k, [0::bigint][:0] c from (select distinct track from o) union all select g.track, o.k, case when len(g.c) >= 3 or len(list_filter(g.c, lambda s: abs(s - o.i) < 5)) > 0 then g.c else list_append(g.c, o.i) end from g join o on o.track = g.track and o.k = g.k + 1), l as (select track, c from g where k = 64) select track, cast(p - 1 as int) place, cast(c[p] as double) \"at\" from (select track, c, unnest(range(1, len(c) + 1)) p from l)")
def r4(spark: SparkSession, d: str) -> DataFrame:
    v = V.clips(spark, d).select("track", F.col("i").cast("double").alias("at"), F.col("x").alias("v"))
    return R.spaced_top(v, 3, 5.0).select("track", "place", "at")
