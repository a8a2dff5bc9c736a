"""Preparing tracks for delivery: named profiles with overrides, their edit lists, and rendering followed by quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators import edits as E
from undula.operators import measures as A
from undula.operators import qc as Q

#: What each profile does to a track.
PROFILES = {
    "spotify": {"head_pad_ms": 200, "tail_pad_sec": 2.0, "fade_in_ms": 5, "fade_out_ms": 200, "fade_curve": "cosine", "target_lufs": -14.0, "max_true_peak_dbtp": -1.0},
    "apple_music": {"head_pad_ms": 200, "tail_pad_sec": 2.0, "fade_in_ms": 5, "fade_out_ms": 200, "fade_curve": "cosine", "target_lufs": -16.0, "max_true_peak_dbtp": -1.0},
    "youtube": {"head_pad_ms": 200, "tail_pad_sec": 2.0, "fade_in_ms": 5, "fade_out_ms": 200, "fade_curve": "cosine", "target_lufs": -14.0, "max_true_peak_dbtp": -1.0},
    "broadcast_ebu_r128": {"head_pad_ms": 500, "tail_pad_sec": 2.0, "fade_in_ms": 10, "fade_out_ms": 300, "fade_curve": "cosine", "target_lufs": -23.0, "max_true_peak_dbtp": -1.0},
    "cd_master": {"head_pad_ms": 0, "tail_pad_sec": 3.0, "fade_in_ms": 0, "fade_out_ms": 500, "fade_curve": "cosine", "target_lufs": None, "max_true_peak_dbtp": -0.3},
}


def settings(profile: str, **overrides) -> dict:
    """A profile's values with those overrides that aren't None; ValueError for an unknown profile or value."""
    if profile not in PROFILES or not set(overrides) <= set(PROFILES[profile]):
        raise ValueError(f"unknown profile or value: {profile}, {sorted(overrides)}")
    return PROFILES[profile] | {k: v for k, v in overrides.items() if v is not None}


def operations(values: dict, remove_dc: bool = True) -> list[tuple[str, dict]]:
    """The edit list of these settings: offset, padding, fades, and loudness last."""
    ops: list[tuple[str, dict]] = [("remove_dc", {})] if remove_dc else []
    ops.append(("pad", {"head_ms": values["head_pad_ms"], "tail_sec": values["tail_pad_sec"]}))
    ops += [("fade_in", {"duration_sec": values["fade_in_ms"] / 1000, "curve": values["fade_curve"]})] if values["fade_in_ms"] > 0 else []
    ops += [("fade_out", {"duration_sec": values["fade_out_ms"] / 1000, "curve": values["fade_curve"]})] if values["fade_out_ms"] > 0 else []
    loud = {"target_lufs": values["target_lufs"], "max_true_peak_dbtp": values["max_true_peak_dbtp"]}
    return ops + ([("loudness_normalize", loud)] if values["target_lufs"] is not None else [])


def prepared(samples: DataFrame, rate: int, profile: str = "spotify", remove_dc: bool = True, **overrides) -> DataFrame:
    """The tracks after a profile's edit list."""
    return E.render(samples, operations(settings(profile, **overrides), remove_dc), rate)


def verified(samples: DataFrame, rate: int, profile: str = "spotify", target: str | None = None, depth: int | None = None, asked: A.Asked | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    """(checks, verdicts) of the prepared tracks against a target of quality control: the profile's own unless another is named,
    spotify's if there is none of that name."""
    known = {t[0] for t in Q.TARGETS}
    wanted = target or profile
    wanted = wanted if wanted in known else "spotify"
    measured = A.measured(prepared(samples, rate, profile, **overrides), asked or A.Asked(rate), depth)
    found = Q.checks(measured).filter(F.col("target") == wanted)
    return found, Q.verdicts(found)
