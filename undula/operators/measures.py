"""All that quality control asks of a track, in one pass over the samples.

Samples are dealt once, by (track, chunk), with a halo on both sides. A numpy kernel reads one chunk with all its channels and
yields a record: sums by channel, energies of its hops, counts of its correlation windows, its loud ends and its click
candidates. A hop, window or step belongs to the chunk in which it starts; the halo holds what it reaches beyond. Only records,
some hundred values for each chunk, are dealt by track, and everything after that is an aggregate of them.

A chunk and its halo are what a task holds of a track. Samples that are null or missing count for no channel; hops and windows
that lack one are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import kernels as K
from undula.operators.edits import CHUNK
from undula.operators.frames import dealt, kept_places
from undula.operators.loudness import CHANNEL_WEIGHTS, SHORT, integrated, loudness_range, short_term
from undula.sources.shared import stored

RECORD = (
    "chunk long, peak double, clipped long, channels array<int>, sums array<double>, squares array<double>, counts array<long>, pairs long, windows long, negative long, "
    "hops array<long>, energies array<double>, first long, last long, end long, clicks array<long>"
)
#: Samples on both sides of a chunk that oversampling needs.
REACH = 24


@dataclass(frozen=True)
class Asked:
    """What is measured. weighted: K-weighted loudness and oversampled peaks; else energies and peaks of the samples as they are."""

    rate: int
    weighted: bool = True
    clip: float = 0.999
    window: int = 19_200
    sensitivity: float = 6.0
    click_ms: float = 50.0
    apart_ms: float = 5.0
    silence_db: float = -60.0
    short: int = SHORT

    @property
    def step(self) -> int:
        return self.rate // 10

    @property
    def click_window(self) -> int:
        return max(int(self.click_ms / 1000 * self.rate), 16)

    @property
    def halo(self) -> tuple[int, int]:
        return max(self.click_window, K.k_tail(self.rate) if self.weighted else 0, REACH), max(self.click_window + 1, self.step, self.window, REACH)


def spans(start: int, stop: int, end: int, size: int) -> range:
    """Numbers of the spans of `size` samples that start in [start, stop) and end by `end`."""
    return range(-(-start // size), min(-(-stop // size), end // size))


def record(i: np.ndarray, channel: np.ndarray, x: np.ndarray, start: int, chunk: int, asked: Asked) -> dict | None:
    """The record of the chunk at `start`; None if only a halo is here."""
    low, end = int(i.min()), int(i.max()) + 1
    if end <= start:
        return None
    names, row = np.unique(channel, return_inverse=True)
    grid = np.full((len(names), end - low), np.nan)
    grid[row, i - low] = x
    stop = min(start + chunk, end)
    own, known = grid[:, start - low : stop - low], ~np.isnan(grid)
    filled, n = np.nan_to_num(grid), known.sum(0)
    mono = np.where(n > 0, filled.sum(0) / np.maximum(n, 1), np.nan)
    size = np.abs(own)
    rim = filled[:, max(start - low - REACH, 0) : stop - low + REACH]
    peak = max(map(K.oversampled_peak, rim)) if asked.weighted else float(np.nanmax(size, initial=0.0))
    loud = np.flatnonzero(np.abs(mono[start - low : stop - low]) > 10 ** (asked.silence_db / 20)) + start
    places, ratios = K.click_ratios(mono, low, start, stop, asked.click_window)

    hops, energies = [], []
    signals = [(CHANNEL_WEIGHTS[c], K.k_filtered(v, 0, asked.rate) if asked.weighted else v, k) for c, v, k in zip(names, filled, known, strict=True) if 0 <= c < len(CHANNEL_WEIGHTS)]
    for hop in spans(start, stop, end, asked.step):
        at = slice(hop * asked.step - low, (hop + 1) * asked.step - low)
        full = [w * float((y[at] ** 2).mean()) for w, y, k in signals if k[at].all()]
        if full:
            hops.append(hop)
            energies.append(sum(full))

    pairs = windows = negative = 0
    if {0, 1} <= set(names.tolist()):
        left, right = (int(np.flatnonzero(names == c)[0]) for c in (0, 1))
        both = known[left] & known[right]
        pairs = int(both[start - low : stop - low].sum())
        for w in spans(start, stop, end, asked.window):
            at = slice(w * asked.window - low, (w + 1) * asked.window - low)
            if both[at].all():
                l, r = grid[left, at] - grid[left, at].mean(), grid[right, at] - grid[right, at].mean()
                if min(l.std(), r.std()) >= 1e-8:
                    windows, negative = windows + 1, negative + int((l * r).sum() < 0)

    return {
        "peak": peak, "clipped": int((size >= asked.clip).any(0).sum()), "channels": names.tolist(), "sums": np.nansum(own, 1).tolist(), "squares": np.nansum(own * own, 1).tolist(), "counts": (~np.isnan(own)).sum(1).tolist(),
        "pairs": pairs, "windows": windows, "negative": negative, "hops": hops, "energies": energies,
        "first": int(loud[0]) if len(loud) else None, "last": int(loud[-1]) if len(loud) else None, "end": stop - 1, "clicks": places[ratios > asked.sensitivity].tolist(),
    }


def records(samples: DataFrame, asked: Asked, chunk: int = CHUNK) -> DataFrame:
    """track and the record of every chunk."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["chunk"].iloc[0])
        found = record(pdf["i"].to_numpy(), pdf["channel"].to_numpy(), pdf["x"].to_numpy(float), number * chunk, chunk, asked)
        return pd.DataFrame([{"track": pdf["track"].iloc[0], "chunk": number, **found}] if found else [], columns=["track", *names], dtype=object)

    kind = samples.schema["track"].dataType.simpleString()
    return dealt(samples, chunk, *asked.halo).groupBy("track", "chunk").applyInPandas(run, f"track {kind}, {RECORD}")


def measured(samples: DataFrame, asked: Asked, depth: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per track, as qc.checks takes it: lufs, true_peak, lra, clipped, dc, n_clicks, phase_negative_pct, imbalance_db, head_ms, tail_sec, rate, depth."""
    d = stored(records(samples, asked, chunk), "records").repartition("track")  # else each measure below would run the kernel again
    db = lambda v: F.when(v > 0, 20 * F.log10(v))
    whole = d.groupBy("track").agg(
        F.round(db(F.max("peak")), 2).alias("true_peak"), F.sum("clipped").alias("clipped"),
        F.when(F.sum("pairs") > 0, F.round(F.coalesce(100 * F.sum("negative") / F.when(F.sum("windows") > 0, F.sum("windows")), F.lit(0.0)), 2)).alias("phase_negative_pct"),
        F.round(F.min("first") / asked.rate * 1000, 1).alias("head_ms"), F.round((F.max("end") - F.max("last")) / asked.rate, 3).alias("tail_sec"),
    )
    sides = d.select("track", F.explode(F.arrays_zip("channels", "sums", "squares", "counts")).alias("s")).groupBy("track", F.col("s.channels").alias("channel"))
    sides = sides.agg((F.sum("s.sums") / F.sum("s.counts")).alias("dc"), F.sqrt(F.sum("s.squares") / F.sum("s.counts")).alias("rms"))
    rms = lambda c: F.max(F.when(F.col("channel") == c, F.col("rms")))
    stereo = (F.max("channel") == 1) & (rms(0) > 0) & (rms(1) > 0)
    sides = sides.groupBy("track").agg(F.round(F.max(F.abs("dc")), 6).alias("dc"), F.when(stereo, F.round(20 * F.log10(rms(0) / rms(1)), 2)).alias("imbalance_db"))
    e = d.select("track", F.explode(F.arrays_zip("hops", "energies")).alias("h")).select("track", F.col("h.hops").alias("hop"), F.col("h.energies").alias("e"))
    loud = integrated(e).select("track", F.round("lufs", 2).alias("lufs"))
    spread = loudness_range(short_term(e, asked.short)).select("track", F.round("lra", 2).alias("lra"))
    clicks = kept_places(d.select("track", F.explode("clicks").alias("i")), max(int(asked.apart_ms / 1000 * asked.rate), 1)).groupBy("track").agg(F.count("*").alias("n"))
    out = whole
    for part in (sides, loud, spread, clicks):
        out = out.join(part, "track", "left")
    return out.withColumn("n_clicks", F.coalesce("n", F.lit(0))).drop("n").withColumn("rate", F.lit(asked.rate)).withColumn("depth", F.lit(depth).cast("int"))
