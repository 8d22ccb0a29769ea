"""Signals, segments and streaming against plain Python."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import signal as S
from foliant.sources import readers as R
from foliant.streaming import speech


def brute_cuts(x, rate, target, longest, overlap, quiet_s, frame_s):
    """Sample by sample."""
    n, frame = len(x), max(1, int(frame_s * rate))
    size, most, over, quiet = int(target * rate), int(longest * rate), int(overlap * rate), int(quiet_s * rate)
    rms = [np.float32(np.sqrt(np.mean(np.float64(x[i : i + frame]) ** 2))) for i in range(0, n, frame)]
    limit = max(np.float32(0.008), sorted(rms)[len(rms) // 2] * np.float32(0.35))
    silent = lambda p: p // frame < len(rms) and rms[p // frame] < limit
    out, begin = [], 0
    while begin < n:
        end = min(n, begin + size)
        if end < n:
            for p in range(end, end - quiet if end > quiet else begin, -1):
                if silent(p):
                    q = p
                    while q > begin and silent(q):
                        q -= 1
                    if end - q >= quiet // 2:
                        end = max(begin + frame, min(n, q + quiet // 4))
                        break
        end = min(end, begin + most)
        end = min(n, begin + frame) if end <= begin else end
        out.append((begin, end))
        if end >= n:
            break
        nxt = end - over if over and end > begin + over else end
        begin = end if nxt <= begin else nxt
    return out


def test_cuts():
    rng = np.random.default_rng(5)
    for k in range(60):
        parts = [rng.standard_normal(rng.integers(5, 60)) * (0.0 if rng.random() < 0.4 else 0.5) for _ in range(rng.integers(1, 12))]
        x = np.concatenate(parts).astype(np.float32)
        how = (10, float(rng.choice([2.0, 4.0])), float(rng.choice([3.0, 8.0])), 0.5, float(rng.choice([0.4, 1.2])), 0.2)
        assert S.cuts(x, *how[:1], *how[1:]) == brute_cuts(x, *how), k
    assert S.cuts(np.zeros(0, np.float32)) == []


def test_frames_and_resampling(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([3, 4, 0, 0, 1])]
    df = spark.createDataFrame(rows, "clip string, i long, x double")
    got = {r["frame"]: r["rms"] for r in S.frame_rms(df, 2).collect()}
    assert got == {0: pytest.approx(12.5**0.5), 1: 0.0, 2: 1.0}
    assert S.silence_threshold(S.frame_rms(df, 2)).first()["median"] == 1.0
    x = np.array([3, 4, 0, 0, 1], float)
    for a, b in ((2, 3), (3, 2), (1, 1), (5, 1), (10, 1)):
        m = max(1, len(x) * b // a)
        pos = np.arange(m) * a / b
        i = np.minimum(pos.astype(int), len(x) - 1)
        want = x[i] + (x[np.minimum(i + 1, len(x) - 1)] - x[i]) * (pos - pos.astype(int))
        got = [r["x"] for r in S.resample(df, a, b).orderBy("i").collect()]
        assert np.allclose(got, want), (a, b)


def test_time_conversion(one):
    assert one(S.ms_to_frames(F.lit(1), 44_100)) == 45 and one(S.frames_to_ms(F.lit(45), 44_100)) == 1


def test_segments():
    loud, quiet = 0.1, 0.0
    assert speech.segments([quiet] * 100) == []
    out = speech.segments([quiet] * 50 + [loud] * 100 + [quiet] * 60)
    assert out == [("PARTIAL", 1, 800, 2800, 0, False), ("FINAL", 1, 800, 3800, 0, False)]
    # a pause after the rolling target closes the segment there, without a bridge
    out = [e for e in speech.segments([loud] * 1500 + [quiet] * 10 + [loud] * 100) if e[0] == "FINAL"]
    assert out[0] == ("FINAL", 1, 0, 30_200, 0, False) and out[1][2] == 30_200 and out[1][4] == 0
    # without any pause it is cut at its weakest window in the last six seconds, and bridged
    x = [loud] * 2400
    x[2100] = 0.05
    out = [e for e in speech.segments(x) if e[0] == "FINAL"]
    assert out[0] == ("FINAL", 1, 0, 42_020, 0, True) and out[1][2] == 42_020 - 1600 and out[1][4] == 1
    with pytest.raises(ValueError):
        speech.Params(threshold=2.0).check()


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    energies = {c: [0.1 if rng.random() < (0.9 if (i // 60) % 2 else 0.05) else 0.0 for i in range(400)] for c in ("a", "b")}
    rows = [(c, i, x) for c, own in energies.items() for i, x in enumerate(own)]
    for k in range(0, 400, 100):
        part = [r for r in rows if k <= r[1] < k + 100] + ([(c, 400, -1.0) for c in energies] if k == 300 else [])
        spark.createDataFrame(part, "clip string, frame long, rms double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    stream = spark.readStream.schema("clip string, frame long, rms double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = speech.segment_stream(stream).writeStream.outputMode("append").format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.sql("select * from segments").collect():
        got.setdefault(r["clip"], []).append(tuple(r)[1:])
    for c, own in energies.items():
        assert sorted(got[c]) == sorted(speech.segments(own))
    batch = speech.segment_clips(spark.createDataFrame(rows, "clip string, frame long, rms double"))
    assert {tuple(r) for r in batch.collect()} == {(c, *e) for c, own in energies.items() for e in speech.segments(own)}
    assert speech.latest(batch).where("kind = 'PARTIAL'").count() == 0


def test_ended_clips_leave_no_state(spark, tmp_path):
    """After the end, or a cancelling window, a clip begins anew; a cancelled one has no FINAL of what was open."""
    loud = [0.1] * 20
    parts = [[("a", i, x) for i, x in enumerate(loud)] + [("a", 20, speech.FINISH)] + [("b", i, x) for i, x in enumerate(loud)] + [("b", 20, speech.CANCEL)], [(c, i, x) for c in "ab" for i, x in enumerate(loud)] + [(c, 20, speech.FINISH) for c in "ab"]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "clip string, frame long, rms double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("clip string, frame long, rms double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = speech.segment_stream(stream).writeStream.outputMode("append").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r)[:5] for r in spark.sql("select * from ended where kind = 'FINAL'").collect())
    assert got == [("a", "FINAL", 1, 0, 400), ("a", "FINAL", 1, 0, 400), ("b", "FINAL", 1, 0, 400)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_rolled_stream_texts(spark):
    rows = [("c", 1, 0, True, "今天天气非常好，我们去公园散步聊天"), ("c", 2, 1, False, "去公园散步聊天吧。然后回家"), ("c", 3, 0, False, "x")]
    out = {r["segment"]: r for r in speech.rolled_texts(spark.createDataFrame(rows, "clip string, segment int, parent int, bridged boolean, text string")).collect()}
    assert out[1]["shown"] == "今天天气非常好，" and out[2]["body"] == "吧。然后回家" and out[3]["shown"] == "x"


def wav(samples, bits=16, channels=1, rate=8000, kind=1):
    width = bits // 8
    if kind == 3:
        body = np.asarray(samples, "<f4").tobytes()
    elif bits == 8:
        body = bytes(int(s) + 128 for s in samples)
    else:
        body = b"".join(int(s).to_bytes(width, "little", signed=True) for s in samples)
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * width * channels, width * channels, bits)
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_wav(spark, tmp_path):
    for bits, scale in ((8, 128), (16, 32768), (24, 1 << 23), (32, 1 << 31)):
        rate, x = R.wav_samples(wav([0, scale // 2, -scale // 4, 1], bits))
        assert rate == 8000 and np.allclose(x[:, 0], [0, 0.5, -0.25, 1 / scale])
    assert np.allclose(R.wav_samples(wav([0.25, -1.0], 32, kind=3))[1][:, 0], [0.25, -1])
    (tmp_path / "a.wav").write_bytes(wav([100, 300, -200, 200], channels=2))
    (tmp_path / "b.WAV").write_bytes(b"RIFFxxxxWAVEnothing")
    (tmp_path / "c.txt").write_text("x")
    files = R.read_audio(spark, str(tmp_path))
    out = {r["path"].rsplit("/", 1)[1]: r for r in R.decode_wav(files).collect()}
    assert set(out) == {"a.wav", "b.WAV"} and np.allclose(out["a.wav"]["samples"], [200 / 32768, 0.0]) and out["b.WAV"]["error"]
    kinds = {r["path"].rsplit("/", 1)[1]: r["k"] for r in files.select("path", R.sniff_audio(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.wav": "wav", "b.WAV": "wav"}
