"""Whole reports: delivery profiles, mix recommendations, spectrum records, layers, paths and outcomes, fingerprints."""

import math
from xml.etree import ElementTree

import numpy as np
import pytest

from undula.operators import catalogs as K
from undula.operators import delivery as L
from undula.operators import layers as Y
from undula.operators import measures as A
from undula.operators import mix as X
from undula.operators import response as P
from undula.operators import screen as N
from undula.operators import spectral as S

SAMPLES = "track string, channel int, i long, x double"


def signal(spark, **tracks):
    return spark.createDataFrame([(t, 0, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], SAMPLES)


def test_profiles_with_overrides():
    ops = L.operations(L.settings("spotify", fade_in_ms=0, target_lufs=-9.0, head_pad_ms=None))
    assert [k for k, _ in ops] == ["remove_dc", "pad", "fade_out", "loudness_normalize"]
    assert ops[1][1] == {"head_ms": 200, "tail_sec": 2.0} and ops[-1][1] == {"target_lufs": -9.0, "max_true_peak_dbtp": -1.0}
    assert [k for k, _ in L.operations(L.settings("cd_master"), remove_dc=False)] == ["pad", "fade_out"]
    for bad in (lambda: L.settings("nothing"), lambda: L.settings("spotify", colour=1)):
        with pytest.raises(ValueError):
            bad()


def test_prepared_tracks_are_verified(spark):
    """Offset goes, pads and fades are there, loudness is near the target, and quality control names the target asked for."""
    rate, t = 8000, np.arange(16_000) / 8000
    d = signal(spark, a=0.05 * np.sin(2 * math.pi * 997 * t) + 0.01)
    x = np.array([r["x"] for r in L.prepared(d, rate, "youtube").orderBy("i").collect()])
    assert len(x) == 16_000 + 1600 + 16_000 and np.abs(x[:1600]).max() < 1e-9 and abs(x.mean()) < 1e-3 and 0.1 < np.abs(x).max() <= 10 ** (-1 / 20) + 1e-6
    asked = A.Asked(rate, weighted=True)
    found, verdicts = L.verified(d, rate, "youtube", asked=asked)
    got = {r["name"]: r for r in found.collect()}
    assert {r["target"] for r in got.values()} == {"youtube"} and abs(got["integrated_lufs"]["value"] + 14) < 0.5 and got["dc_offset"]["status"] == "PASS"
    assert verdicts.count() == 1
    other, _ = L.verified(d, rate, "youtube", target="unknown", asked=asked, target_lufs=-30.0)
    assert {r["target"] for r in other.collect()} == {"spotify"} and other.filter("name = 'integrated_lufs'").first()["status"] == "FAIL"


def test_recommendation_and_mixdown(spark):
    bands = [b[2] for b in S.MIX_BANDS]
    levels = spark.createDataFrame([(1, t, b, -30.0 - 3 * k - t) for t in (1, 2) for k, b in enumerate(bands)], "mix int, track int, band string, level double")
    tracks = spark.createDataFrame([(1, 1, "Kick", -20.04), (1, 2, "Lead Vox", -26.0)], "mix int, track int, name string, rms_db double")
    assert len(X.PROFILES) == 18 and X.target_levels("pink", S.MIX_BANDS)["sub"] == -20.0
    assert X.measured_target(levels, 2) == {b: -32.0 - 3 * k for k, b in enumerate(bands)}
    gains, mixes = X.recommendation(tracks, levels, X.target_levels("yt_ballad", S.MIX_BANDS))
    got = {r["track"]: r for r in gains.collect()}
    assert (got[1]["group"], got[1]["rms_db"], got[1]["sub"], got[2]["high"]) == ("drums", -20.0, -31.0, -41.0) and mixes.first()["n"] == 2
    d = spark.createDataFrame([(t, c, i, 1.0 if i == 4 else 0.0) for t in (1, 2) for c in (0, 1) for i in range(8)], "track int, channel int, i long, x double")
    config = spark.createDataFrame([(1, t, 0.0, 0.0, False, False, 0) for t in (1, 2)], "mix int, track int, gain_db double, pan double, mute boolean, solo boolean, shift int")
    out = {(r["channel"], r["i"]): r["x"] for r in X.mixdown(d, config, gains, 3).collect()}
    want = sum(10 ** (got[t]["gain_db"] / 20) for t in (1, 2)) * math.sqrt(0.5)
    assert len(out) == 16 and abs(out[0, 1] - want) < 1e-9 and sum(map(abs, out.values())) == pytest.approx(2 * want)


def test_latency_of_chains_and_largest_differences(spark):
    used = spark.createDataFrame([(1, 10), (2, 5)], "track int, used long")
    chains = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 1), ("b", 0, 9)], "chain string, step int, track int")
    assert {r["chain"]: (r["steps"], r["total"]) for r in P.chain_latency(used, chains).collect()} == {"a": (3, 25), "b": (1, 0)}
    d = spark.createDataFrame([("p", 0, 1.0, -9.0), ("p", 1, -4.0, 9.0), ("q", 0, 0.5, 0.0)], "pair string, bin int, db double, phase double")
    got = {r["pair"]: tuple(r)[1:] for r in P.largest_difference(d, ["pair"]).collect()}
    assert got == {"p": (4.0, 1, 9.0, 0), "q": (0.5, 0, 0.0, 0)}


def test_spectrum_record_finds_planted_hum_and_peaks(spark):
    rate, t = 8000, np.arange(40_000) / 8000
    noise = np.random.default_rng(1).normal(0, 1e-3, len(t))
    r = S.diagnostics(S.long_term_spectrum(signal(spark, a=0.1 * np.sin(2 * math.pi * 60 * t) + 0.3 * np.sin(2 * math.pi * 2000 * t) + noise), rate), 3).first()
    assert [h["candidate"] for h in r["hum"] if h["is_hum"]] == [60.0] and abs(r["dominant"][0]["at"] - 2000) < 1 and abs(r["dominant"][1]["at"] - 60) < 1
    assert r["frames"] == 3 and {b["band"] for b in r["bands"]} == {b[2] for b in S.OCTAVES} and abs(sum(b["percent"] for b in r["bands"]) - 100) < 1


def test_fingerprints_weigh_and_have_ten_bands(spark):
    rate, t = 48_000, np.arange(9600) / 48_000
    x = np.concatenate([0.5 * np.sin(2 * math.pi * 1000 * t), 0.1 * np.sin(2 * math.pi * 3000 * t), np.zeros(9600)])
    got = {r["spot"]: r for r in N.fingerprints(signal(spark, a=x), rate, 0.2).collect()}
    assert (got["loud"]["window"], got["quiet"]["window"]) == (0, 1) and len(got["loud"]["bands10"]) == 10
    assert int(np.argmax(got["loud"]["bands10"])) == 5 and int(np.argmax(got["quiet"]["bands10"])) == 7 and got["loud"]["level"] > got["quiet"]["level"]


def test_layers_are_xml_in_order(spark):
    points = spark.createDataFrame([("a", 9, 61.5, 4, 'x"<&'), ("a", 2, 60.0, 20, "y")], "track string, frame long, value double, duration long, label string")
    for kind, size, end in (("instants", 1, "9"), ("values", 2, "9"), ("notes", 3, "22")):
        rows = Y.lines(points, kind, 44_100, units="Hz").orderBy("place").collect()
        assert [r["place"] for r in rows] == list(range(len(rows)))
        root = ElementTree.fromstring("".join(r["line"] for r in rows))
        model, found = root.find("data/model"), root.findall("data/dataset/point")
        assert model.get("dimensions") == str(size) and model.get("end") == end and [p.get("frame") for p in found] == ["2", "9"] and found[1].get("label") == 'x"<&'
        assert (model.get("minimum") is None) == (kind == "instants") and (found[0].get("level") == "1.0") == (kind == "notes")
    dense = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [0.5, -1.0])], "track string, n long, bins array<double>")
    root = ElementTree.fromstring("".join(r["line"] for r in Y.lines(dense, "dense", 44_100).orderBy("place").collect()))
    assert root.find("data/model").get("yBinCount") == "2" and [r.text for r in root.findall("data/dataset/row")] == ["1.000000 2.000000", "0.500000 -1.000000"]
    assert Y.lines(points.limit(0), "notes", 1).count() == 0


def test_extractor_forms(spark):
    lists = spark.createDataFrame([("a", [(0.25, [2.0, 3.0], "k"), (None, [], None)])], "track string, events array<struct<timestamp: double, values: array<double>, label: string>>")
    assert [tuple(r) for r in Y.list_rows(lists, 10).orderBy("k").collect()] == [("a", 0, 2, 2.0, "k"), ("a", 1, 0, 0.0, "")]
    matrix = spark.createDataFrame([("a", 0.5, [[1.0], [2.0]])], "track string, step double, rows array<array<double>>")
    assert [tuple(r) for r in Y.matrix_rows(matrix, 10).orderBy("n").collect()] == [("a", 0, 5, [1.0]), ("a", 1, 5, [2.0])]


def test_paths_and_outcomes(spark):
    body = '{"output": "o.wav", "tracks": [{"path": "./in//a.wav"}, {"path": "/abs/b.wav"}, {"path": "s3://x/c.wav"}, {"path": "../d.wav"}]}'
    s = spark.createDataFrame([("s", body, "/music/set/session.json")], "session string, body string, file string")
    assert [r["path"] for r in K.session_tracks(s).orderBy("k").collect()] == ["/music/set/in/a.wav", "/abs/b.wav", "s3://x/c.wav", "/music/set/../d.wav"]
    results = spark.createDataFrame([("x", "p", None), ("x", "p", None), ("x", "q", "bad"), ("x", "r", "bad"), ("y", "s", None)], "batch string, path string, error string")
    assert {r["batch"]: tuple(r)[1:] for r in K.outcomes(results, "batch").collect()} == {"x": (1, 2, ["bad"]), "y": (1, 0, [])}
