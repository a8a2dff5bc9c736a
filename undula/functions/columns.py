"""Column expressions: levels, times, names, parameter texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_db(v: Column, floor: float = 1e-12) -> Column:
    """A level in dB with a floor."""
    return 20 * F.log10(F.greatest(v, F.lit(floor)))


def power_db(v: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(v, F.lit(floor)))


def from_db(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)


def seconds_to_samples(sec: Column, rate: Column | int) -> Column:
    """Half-even rounding, as edit lists count."""
    return F.bround(sec * rate, 0).cast("long")


#: What plugin names carry in front and short names drop.
SERIES_PREFIX, VENDOR_PREFIX = r"^RX\s+[0-9]+\s+", r"(?i)^(iZotope|Waves|FabFilter|Sonnox)\s+"


def short_name(name: Column) -> Column:
    """Lower case without series and vendor in front, runs of blanks and hyphens as one hyphen."""
    out = F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, SERIES_PREFIX, ""), VENDOR_PREFIX, "")))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), "-+", "-")


def typed(raw: Column) -> Column:
    """A parameter's text as a struct (text, num, flag): quoted stays text, then true/false, then a number, else text."""
    t = F.trim(raw)
    quoted = t.rlike(r"""^(".*"|'.*')$""")
    flag = F.when(~quoted & F.lower(t).isin("true", "false"), F.lower(t) == "true")
    num = F.when(~quoted & flag.isNull() & t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.cast("double"))
    text = F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).when(flag.isNull() & num.isNull(), t)
    return F.struct(text.alias("text"), num.alias("num"), flag.alias("flag"))


def parameters(items: Column) -> Column:
    """Map of name to raw value from an array of `name=value`; items without = are left out (bad_parameters lists them)."""
    good = F.filter(items, lambda s: F.instr(s, "=") > 1)
    pairs = F.transform(good, lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)), F.trim(F.substring(s, F.instr(s, "=") + 1, F.length(s)))))
    return F.map_from_entries(pairs)


def bad_parameters(items: Column) -> Column:
    return F.filter(items, lambda s: F.instr(s, "=") <= 1)


def chain_steps(text: Column) -> Column:
    """Steps of `a:k=v;k2=v2,b` as an array of (plugin, params); blank steps are skipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")

    def one(s: Column) -> Column:
        rest = F.when(F.instr(s, ":") > 0, F.substring(s, F.instr(s, ":") + 1, F.length(s))).otherwise(F.lit(""))
        return F.struct(F.trim(F.substring_index(s, ":", 1)).alias("plugin"), parameters(F.split(rest, ";")).alias("params"))

    return F.transform(parts, one)


#: The screening issues and their other names.
ISSUES = ("click", "hum", "mouth_click", "sibilance", "breath", "background_noise", "rf_noise")
ISSUE_ALIASES = {
    "de_ess": "sibilance",
    "de-ess": "sibilance",
    "ess": "sibilance",
    "mouth-click": "mouth_click",
    "mouth_de_click": "mouth_click",
    "mouth-de-click": "mouth_click",
    "noise": "background_noise",
    "background-noise": "background_noise",
    "rf": "rf_noise",
    "rf-noise": "rf_noise",
}


def issue_names(names: Column) -> Column:
    """Names trimmed, lower-cased, blanks as underscores, aliases replaced, each once in first order; blank names are left out."""
    known = F.create_map(*(F.lit(x) for pair in ISSUE_ALIASES.items() for x in pair))
    clean = F.transform(names, lambda s: F.replace(F.lower(F.regexp_replace(s, r"^\s+|\s+$", "")), F.lit(" "), F.lit("_")))
    return F.array_distinct(F.transform(F.filter(clean, lambda s: s != ""), lambda s: F.coalesce(known[s], s)))


def unsupported_issues(names: Column) -> Column:
    return F.array_except(names, F.array(*map(F.lit, ISSUES)))


def overlaid(base: Column, over: Column) -> Column:
    """A parameter map with another one's values on top."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def output_path(path: Column, in_dir: str, out_dir: str, suffix: str = "", extension: str | None = None) -> Column:
    """The output path of an input: same sub-directory under out_dir, suffix before the extension, extension perhaps changed."""
    relative = F.regexp_replace(path, "^" + in_dir.rstrip("/") + "/", "")
    stem, ext = F.regexp_replace(relative, r"\.[^./]*$", ""), F.regexp_extract(relative, r"(\.[^./]*)$", 1)
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), stem, F.lit(suffix), F.lit(extension) if extension else ext)
