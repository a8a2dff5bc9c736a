"""WAV files by byte ranges: any cut gives the same samples, heads read no sample, writing commits or leaves nothing."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import chunks as H
from undula.sources import wav_ranges as W

SAMPLES = "track string, channel int, i long, x double"


def wav(channels, rate, code, bits, body, extra=b""):
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    parts = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("wav")
    draw = np.random.default_rng(2)
    long = draw.integers(-32768, 32767, 2 * 5000).astype("<i2")
    note = b"LIST" + struct.pack("<I", 300_001) + b"n" * 300_002  # a long chunk, padded, before the samples
    os.makedirs(base / "sub")
    for name, data in {
        "a.wav": wav(2, 8000, 1, 16, long.tobytes(), note), "b.WAV": wav(1, 44_100, 3, 64, draw.uniform(-1, 1, 70).astype("<f8").tobytes()), "c.wav": b"RIFFnothing", "d.wav": b"",
        "e.wav": wav(1, 8000, 1, 24, b"\0\0\x40" * 5)[:-6], "f.wav": wav(1, 8000, 7, 8, b"\0" * 9), "sub/g.wav": wav(1, 8000, 1, 8, bytes(range(256))), "h.txt": b"text", "z.wav": wav(1, 8000, 1, 16, b""),
    }.items():
        (base / name).write_bytes(data)
    return str(base), long.reshape(-1, 2) / 32768


def samples(d, chunk):
    out = {}
    for r in d.filter("error is null").collect():
        for k, x in enumerate(r["xs"]):
            out[os.path.basename(r["track"]), r["channel"], r["chunk"] * chunk + k] = x
    return out


@pytest.mark.parametrize(("size", "chunk"), [(1 << 20, 8192), (5000, 256), (777, 100), (40, 7)])
def test_any_cut_gives_the_same_samples(folder, size, chunk):
    base, long = folder
    reader = W.WavReader({"path": base, "range_bytes": str(size), "chunk": str(chunk)})
    seen, errors = {}, {}
    for part in reader.partitions():
        assert len(part.ranges) == 1 or sum(h - a for _, _, a, h in part.ranges) <= size
        for b in reader.read(part):
            for r in b.to_pylist():
                name = os.path.basename(r["track"])
                if r["error"]:
                    assert name not in errors
                    errors[name] = r["error"]
                for k, x in enumerate(r["xs"] or []):
                    key = (name, r["channel"], r["chunk"] * chunk + k)
                    assert key not in seen
                    seen[key] = x
    assert {(c, i): x for (n, c, i), x in seen.items() if n == "a.wav"} == {(c, i): long[i, c] for i in range(5000) for c in range(2)}
    assert sum(n == "b.WAV" for n, *_ in seen) == 70 and {n for n, *_ in seen} == {"a.wav", "b.WAV", "e.wav"}
    assert [x for (n, *_), x in seen.items() if n == "e.wav"] == [0.5, 0.5, 0.5] and set(errors) == {"c.wav", "d.wav", "f.wav"}


def test_one_file_is_read_by_many_tasks(spark, folder):
    base, long = folder
    d = W.read_chunks(spark, f"{base}/a.wav", range_bytes=100_000, chunk=256)
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() >= 1
    assert d.rdd.getNumPartitions() == 4
    d = W.read_chunks(spark, base, recursive=True, range_bytes=6000, chunk=256)
    tasks = d.filter("track like '%a.wav'").select(F.spark_partition_id().alias("p")).distinct().count()
    got = samples(d, 256)
    assert tasks >= 4 and got["a.wav", 1, 4999] == long[4999, 1] and got["g.wav", 0, 255] == 127 / 128


class Counted:
    def __init__(self, file):
        self.file, self.n = file, 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        out = self.file.read(n)
        self.n += len(out)
        return out


def test_heads_read_no_sample(spark, folder):
    base, _ = folder
    with open(f"{base}/a.wav", "rb") as f:
        counted = Counted(f)
        head = W.head_of(counted, os.path.getsize(f"{base}/a.wav"))
    assert counted.n < 64 and (head.rate, head.channels, head.frames, head.bits) == (8000, 2, 5000, 16)
    got = {os.path.basename(r["path"]): r for r in W.read_heads(spark, base, True).collect()}
    assert (got["b.WAV"]["subtype"], got["b.WAV"]["frames"], got["b.WAV"]["bit_depth"]) == ("DOUBLE", 70, 64)
    assert got["z.wav"]["frames"] == 0 and got["c.wav"]["error"] == "not a RIFF WAVE file" and len(got) == 8


@pytest.mark.parametrize("chunk", [64, 8192])
def test_written_chunks_come_back(spark, tmp_path, chunk):
    draw = np.random.default_rng(3)
    rows = [(t, c, i, float(v)) for t, n, channels in (("x/one", 300, 2), ("two", 65, 1)) for c in range(channels) for i, v in enumerate(np.round(draw.uniform(-1, 1, n), 4))]
    rows = [r for r in rows if not (r[0] == "x/one" and 64 <= r[2] < 200) and r[:3] != ("x/one", 1, 299)]  # a gap of whole chunks, a shorter side
    d = H.from_samples(spark.createDataFrame(rows, SAMPLES), chunk)
    for _ in range(2):  # written again, the files are replaced
        W.write_chunks(d, str(tmp_path), 8000, 24, chunk)
    assert sorted(os.path.relpath(os.path.join(p, f), tmp_path) for p, _, fs in os.walk(tmp_path) for f in fs) == ["two.wav", "x/one.wav"]
    assert os.path.getsize(tmp_path / "x/one.wav") == 44 + 300 * 2 * 3 and os.path.getsize(tmp_path / "two.wav") == 44 + 65 * 3
    got = samples(W.read_chunks(spark, str(tmp_path), True, chunk=chunk), chunk)
    assert len(got) == 665 and got["one.wav", 0, 100] == 0 and got["one.wav", 1, 299] == 0
    assert all(abs(got[f"{os.path.basename(t)}.wav", c, i] - x) < 2e-7 for t, c, i, x in rows)


def test_a_failed_write_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = W.WavWriter({"path": str(tmp_path), "rate": "8000", "chunk": "4"})
    batch = lambda track: pa.RecordBatch.from_pylist([{"track": track, "n": 4, "chunk": 0, "xs": [[0.1, 0.2, 0.3, 0.4]]}])

    def broken():
        yield batch("a")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert os.listdir(tmp_path) == []
    message = writer.write(iter([batch("a"), batch("b")]))
    assert all(f.endswith(".part") for f in os.listdir(tmp_path))
    writer.abort([message, None])
    assert os.listdir(tmp_path) == []
    writer.commit([writer.write(iter([batch("a")])), None])
    assert os.listdir(tmp_path) == ["a.wav"]


@pytest.mark.parametrize("most", [1, 7, 50])
def test_small_ranges_share_a_bounded_number_of_parts(folder, most):
    base, _ = folder
    options = {"path": base, "range_bytes": "777", "chunk": "100"}
    reader = W.WavReader({**options, "parts": str(most)})
    found = reader.partitions()
    assert len(found) <= 2 * most and len(W.WavReader(options).partitions()) > 400
    for part in found:  # ranges of a file that follow each other are one
        assert len({r[0] for r in part.ranges}) == len(part.ranges)
    rows = lambda r: sorted((x["track"], x["channel"] or 0, x["chunk"] or 0, x["error"] or "", tuple(x["xs"] or ())) for p in r.partitions() for b in r.read(p) for x in b.to_pylist())
    assert rows(reader) == rows(W.WavReader(options))


def test_a_table_of_many_ranges_has_few_tasks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.wav").write_bytes(wav(1, 8000, 1, 16, np.arange(60_000).astype("<i2").tobytes()))
    d = W.read_chunks(spark, str(tmp_path), range_bytes=100, chunk=5000)
    assert W.PARTS // 2 < d.rdd.getNumPartitions() <= 2 * W.PARTS  # 3,600 ranges
