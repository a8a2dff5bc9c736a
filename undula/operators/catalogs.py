"""Catalogs of plugins and presets, sessions, parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.columns import short_name


def with_short_names(found: DataFrame) -> DataFrame:
    return found.withColumn("short", short_name(F.col("name")))


def scanned(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two scans (short, key, ...): in each the last row of a short name stays; the second adds only names the first lacks."""
    last = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("short").orderBy(F.desc("key")))).filter("k = 1").drop("k")
    a = last(first)
    return a.unionByName(last(second).join(a.select("short"), "short", "left_anti").select(a.columns))


def resolved(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """asked (name) with short: the entry of that short name, else with that alias, else the only one whose name contains it.

    Partial matches are asked only of what nothing else matched; the catalog's names are spread over it, as it may be large."""
    a = asked.select("name").distinct()
    exact = a.join(catalog.select(F.col("short").alias("name"), F.col("short").alias("e")), "name", "left")
    aliases = catalog.select(F.explode("aliases").alias("name"), "short").groupBy("name").agg(F.min("short").alias("l"))
    both = exact.join(aliases, "name", "left")
    open_ = both.filter("e is null and l is null").select("name")
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    pieces = catalog.select("short", F.explode(F.array_distinct(F.concat(*(grams(F.col("short"), n) for n in (1, 2, 3))))).alias("gram"))
    partial = open_.select("name", F.substring("name", 1, 3).alias("gram")).join(pieces, "gram").filter(F.col("short").contains(F.col("name"))).groupBy("name").agg(F.count_distinct("short").alias("n"), F.min("short").alias("p"))
    out = both.join(partial.filter("n = 1").select("name", "p"), "name", "left")
    return out.select("name", F.coalesce("e", "l", "p").alias("short"))


def still_there(cached: DataFrame, paths: DataFrame) -> DataFrame:
    return cached.join(paths.select("path").distinct(), "path", "left_semi")


def listed(catalog: DataFrame, kind: str | None = None, vendor: str | None = None) -> DataFrame:
    out = catalog if kind is None else catalog.filter(F.col("format") == kind)
    return out if vendor is None else out.filter(F.lower("vendor").contains(vendor.lower()))


def presets(log: DataFrame) -> DataFrame:
    """The preset store after a log of (plugin, name, created, action, parameters): the last save of each key, unless deleted since."""
    order = Window.partitionBy("plugin", "name").orderBy(F.desc("created"), F.desc("action"))
    return log.withColumn("k", F.row_number().over(order)).filter("k = 1 and action = 'save'").drop("k", "action")


def dumped(parameters: DataFrame, keyword: str | None = None) -> DataFrame:
    """One row per plugin: its parameters as a map and their number."""
    d = parameters if keyword is None else parameters.filter(F.lower("plugin").contains(keyword.lower()))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
    return d.groupBy("plugin").agg(entries.alias("params"), F.count("*").alias("n"))


def grid(base: DataFrame, swept: dict[str, list]) -> DataFrame:
    """base rows with every combination of the swept values, which are parameters of the call."""
    return reduce(lambda d, item: d.withColumn(item[0], F.explode(F.array(*map(F.lit, item[1])))), swept.items(), base)


def seen_from(path: Column, base: Column) -> Column:
    """A path as seen from the folder `base`, unless it is absolute or a URI; `./` and doubled slashes go."""
    joined = F.when(path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))
    return F.regexp_replace(F.regexp_replace(joined, r"/(\./)+", "/"), r"(?<!:)/{2,}", "/")


def outcomes(results: DataFrame, by: str) -> DataFrame:
    """results (a row for each item or part of one, with path and error) to by, ok, failed, errors: items that were read and that weren't, and what was wrong, each once."""
    items = results.groupBy(by, "path").agg(F.max("error").alias("error"))
    return items.groupBy(by).agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sort_array(F.collect_set("error")).alias("errors"))


def session_tracks(sessions: DataFrame) -> DataFrame:
    """sessions (session, body: JSON text, and perhaps file, where that text stands) to one row per track with defaults; error says
    what a bad session lacks. Relative paths are seen from the session file's folder."""
    track = "struct<path:string,gain_db:double,pan:double,mute:boolean,solo:boolean,offset_samples:bigint>"
    d = sessions.withColumn("s", F.from_json("body", f"output string, tracks array<{track}>"))
    error = F.when(F.col("s.output").isNull(), "output").when(F.coalesce(F.size("s.tracks"), F.lit(0)) == 0, "tracks").when(F.exists("s.tracks", lambda t: t["path"].isNull()), "path")
    d = d.withColumn("error", error).select("session", *(["file"] if "file" in sessions.columns else []), "s.output", "error", F.posexplode_outer("s.tracks").alias("k", "t"))
    zero, no = F.lit(0.0), F.lit(False)
    path = seen_from(F.col("t.path"), F.regexp_replace("file", "/[^/]*$", "")) if "file" in sessions.columns else F.col("t.path")
    return d.select("session", "error", "k", path.alias("path"), F.coalesce("t.gain_db", zero).alias("gain_db"), F.coalesce("t.pan", zero).alias("pan"), F.coalesce("t.mute", no).alias("mute"), F.coalesce("t.solo", no).alias("solo"), F.coalesce("t.offset_samples", F.lit(0).cast("long")).alias("offset"))


def edit_lists(texts: DataFrame, newest: int = 1) -> DataFrame:
    """texts (source, body: JSON) to one row per operation; a list of a newer version is refused."""
    d = texts.withColumn("e", F.from_json("body", "version int, ops array<map<string,string>>")).withColumn("refused", F.coalesce(F.col("e.version") > newest, F.lit(True)))
    ops = d.select("source", "refused", F.posexplode_outer("e.ops").alias("op_no", "op"))
    return ops.select("source", "refused", "op_no", F.col("op")["type"].alias("type"), F.map_filter("op", lambda k, _: k != "type").alias("params"))
