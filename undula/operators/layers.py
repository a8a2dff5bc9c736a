"""Results of feature extractors as rows, and annotation layers for a viewer: instants, values, notes, dense rows.

A layer is a header row for each track (what the viewer's model element names) and a point row for each event. lines() writes both
as XML lines in order, which any text sink stores; no track is gathered in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_of(seconds: Column, rate: int) -> Column:
    """Half-even, as extractors count."""
    return F.bround(seconds.cast("double") * rate, 0).cast("long")


def vector_rows(results: DataFrame, rate: int) -> DataFrame:
    """results (track, step in seconds, values) to track, frame, value."""
    d = results.select("track", "step", F.posexplode("values").alias("k", "value"))
    return d.select("track", frame_of(F.col("k") * F.col("step"), rate).alias("frame"), F.col("value").cast("double").alias("value"))


def list_rows(results: DataFrame, rate: int) -> DataFrame:
    """results (track, events: array of timestamp, values, label) to track, k, frame, value (the first, 0 if there is none), label (empty if null)."""
    d = results.select("track", F.posexplode("events").alias("k", "e"))
    value = F.coalesce(F.try_element_at("e.values", F.lit(1)).cast("double"), F.lit(0.0))
    return d.select("track", "k", frame_of(F.coalesce("e.timestamp", F.lit(0.0)), rate).alias("frame"), value.alias("value"), F.coalesce("e.label", F.lit("")).alias("label"))


def matrix_rows(results: DataFrame, rate: int) -> DataFrame:
    """results (track, step in seconds, rows: array of arrays) to track, n, hop (samples), bins."""
    d = results.select("track", "step", F.posexplode("rows").alias("n", "bins"))
    return d.select("track", "n", frame_of(F.col("step"), rate).alias("hop"), F.col("bins").cast("array<double>").alias("bins"))


#: Of each kind: dimensions, the model's name, the attributes of a point.
KINDS = {"instants": (1, "instants", ("frame", "label")), "values": (2, "analysis", ("frame", "value", "label")), "notes": (3, "notes", ("frame", "value", "duration", "level", "label")), "dense": (3, "spectrogram", ())}


def defaults(points: DataFrame, kind: str) -> DataFrame:
    """points with all columns of the kind: labels are empty and levels 1 unless given."""
    for c, v in (("label", F.lit("")), ("level", F.lit(1.0)), ("duration", F.lit(0).cast("long"))):
        if c in KINDS[kind][2] and c not in points.columns:
            points = points.withColumn(c, v)
    return points


def headers(points: DataFrame, kind: str) -> DataFrame:
    """track, kind, dimensions, n, start, end, least, most, bins: the end of notes is where the last of them ends; least and most are null for instants."""
    dimensions = F.lit(KINDS[kind][0]).alias("dimensions")
    none = F.lit(None).cast("double")
    if kind == "dense":
        d = points.groupBy("track").agg(F.count("*").alias("n"), F.min(F.array_min("bins")).alias("least"), F.max(F.array_max("bins")).alias("most"), F.max(F.size("bins")).alias("bins"))
        return d.select("track", F.lit(kind).alias("kind"), dimensions, "n", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "least", "most", "bins")
    d = defaults(points, kind)
    end = F.max(F.col("frame") + F.col("duration")) if kind == "notes" else F.max("frame")
    least, most = (none, none) if kind == "instants" else (F.min("value"), F.max("value"))
    d = d.groupBy("track").agg(F.count("*").alias("n"), end.cast("long").alias("end"), least.alias("least") if kind != "instants" else F.max(none).alias("least"), most.alias("most") if kind != "instants" else F.max(none).alias("most"))
    return d.select("track", F.lit(kind).alias("kind"), dimensions, "n", F.lit(0).cast("long").alias("start"), "end", "least", "most", F.lit(None).cast("int").alias("bins"))


def escaped(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


def attributes(*pairs: tuple[str, Column]) -> Column:
    """name="value" of what isn't null."""
    return F.concat_ws(" ", *(F.when(v.isNotNull(), F.concat(F.lit(f'{name}="'), escaped(v.cast("string")), F.lit('"'))) for name, v in pairs))


def lines(points: DataFrame, kind: str, rate: int, resolution: int = 512, units: str | None = None) -> DataFrame:
    """track, place, line: the layer of each track as XML lines, place from 0."""
    size, name, fields = KINDS[kind]
    h = headers(points, kind)
    model = attributes(
        ("id", F.lit(0)), ("name", F.lit(name)), ("sampleRate", F.lit(rate)), ("start", F.col("start")), ("end", F.col("end")), ("type", F.lit("dense" if kind == "dense" else "sparse")), ("dimensions", F.lit(size)),
        ("subtype", F.lit("note" if kind == "notes" else None).cast("string")), ("resolution", F.lit(resolution)), ("yBinCount", F.col("bins")), ("minimum", F.col("least")), ("maximum", F.col("most")), ("units", F.lit(units).cast("string")), ("dataset", F.lit(0)),
    )
    top = h.select("track", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(F.lit("<sv><data><model "), model, F.lit(f'/><dataset id="0" dimensions="{size}">')).alias("line"))
    if kind == "dense":
        body = points.select("track", F.lit(1).alias("part"), F.col("n").cast("long").alias("k"), F.concat(F.lit("<row "), attributes(("n", F.col("n"))), F.lit(">"), F.array_join(F.transform("bins", lambda v: F.format_string("%.6f", v)), " "), F.lit("</row>")).alias("line"))
    else:
        d = defaults(points, kind)
        body = d.select("track", F.lit(1).alias("part"), F.col("frame").cast("long").alias("k"), F.concat(F.lit("<point "), attributes(*((c, F.col(c)) for c in fields)), F.lit("/>")).alias("line"))
    foot = h.select("track", F.lit(2).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("</dataset></data></sv>").alias("line"))
    every = top.unionByName(body).unionByName(foot)
    return every.select("track", (F.row_number().over(Window.partitionBy("track").orderBy("part", "k", "line")) - 1).alias("place"), "line")
