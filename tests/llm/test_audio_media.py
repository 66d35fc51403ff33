import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quern.llm import audio_media as am


def test_resampling_keeps_tones_below_the_new_limit():
    t = np.arange(16000) / am.RATE
    low = am.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32))
    assert len(low) == 12000
    want = np.sin(2 * np.pi * 1000 * (np.arange(12000) / 12000))
    lag = max(range(-8, 9), key=lambda k: np.dot(low[100:-100], np.roll(want, k)[100:-100]))
    assert np.abs(low[100:-100] - np.roll(want, lag)[100:-100]).max() < 0.3
    high = am.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32))
    assert np.abs(high[100:-100]).max() < 0.2
    # each block of outputs by the definition
    x = np.random.default_rng(0).normal(size=40).astype(np.float32)
    bank = am._filters()[0]
    padded = np.r_[np.zeros(am.TAPS // 2), x, np.zeros(60)]
    want = [sum(padded[4 * q + i] * bank[i, r] for i in range(len(bank))) for q in range(10) for r in range(3)]
    assert np.allclose(am.resample(x), want, atol=1e-4)


def test_mels_peak_where_the_tone_is():
    t = np.arange(12000) / 12000
    mels = am.log_mels(np.sin(2 * np.pi * 2000 * t).astype(np.float32))
    assert mels.shape == (1 + -(-(12000 - 256) // 128), am.MELS)
    bins = np.argmax(am._filters()[2], axis=0) * 12000 / 256
    assert abs(bins[mels.mean(0).argmax()] - 2000) < 200
    # blocks do not matter
    long = np.random.default_rng(1).normal(size=128 * 5000).astype(np.float32)
    a = am.log_mels(long)
    assert np.allclose(a[4000:4200], am.log_mels(long[4000 * 128 :])[:200], atol=1e-3)


def test_hysteresis():
    energy = np.array([0, 0, 0, 5, 2, 2, 0.5, 2, 2, 4, 0, 0, 0], float)
    assert am.loud_segments(energy - 0.0).tolist() == [[3, 6], [9, 10]] or np.median(energy) > 0
    energy = np.r_[np.zeros(20), 5, 2, 2, 0.5, 2, 4, 0]
    assert am.loud_segments(energy).tolist() == [[20, 23], [25, 26]]
    assert am.loud_segments(np.zeros(3)).tolist() == []


def test_round_trip_and_digests(spark):
    texts = [None, "", "a", "é" * 31 + "xx", "é" * 32, "z" * 5000, "same", "same", "line\n" * 4000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = am.describe(am.store(docs)).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        r, data = by_id[i if i != 3 else None], (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(payload) + 44)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(am.to_wav(payload)).hexdigest()
    assert by_id[6].feature == by_id[7].feature and by_id[0].feature == by_id[1].feature
    assert am.describe(am.store(docs.limit(0))).count() == 0


def test_tensors_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 30000), (2, "hello")], "doc_id long, text string")
    manifest = am.write_tensors(am.store(docs), f"file://{tmp_path}/tensors")
    tables = [pq.read_table(r.path) for r in manifest.collect()]
    table = pa.concat_tables(tables).sort_by([("doc_id", "ascending"), ("tile", "ascending")])
    assert isinstance(table.schema.field("mels").type, pa.FixedShapeTensorType)
    assert table.schema.field("mels").type.shape == [am.FRAMES, am.MELS]
    spans = table.select(["doc_id", "tile", "start_ms", "end_ms"]).to_pylist()
    assert spans[-1]["doc_id"] == 2 and spans[0]["start_ms"] == 0 and spans[1]["start_ms"] == spans[0]["end_ms"]
    assert abs(spans[-2]["end_ms"] - 30016 / 16) < 30


def test_features_are_derived_from_stored_tensors(spark, tmp_path, monkeypatch):
    texts = [None, "", "hello", "hello", "z" * 30000, "é line\n" * 4000]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    folder = f"file://{tmp_path}/tensors"
    monkeypatch.setattr(am, "shared_path", lambda session, tag: folder)
    media = am.store(docs)
    described = am.describe(media)
    want = {r.media_sha256: am.analyse(bytes(r.media)).summary() for r in media.selectExpr("sha2(media, 256) AS media_sha256", "media").collect()}
    assert {r.media_sha256: r.feature for r in described.collect()} == want
    stored = pa.concat_tables([pq.read_table(f) for f in (tmp_path / "tensors").glob("*.parquet")])
    assert isinstance(stored.schema.field("mels").type, pa.FixedShapeTensorType)
    assert stored.num_rows == sum(len(am.analyse(bytes(r.media)).tiles()) for r in media.collect())
    for f in (tmp_path / "tensors").glob("*.parquet"):  # other tensors give other features
        t = pq.read_table(f)
        lower = pa.FixedShapeTensorArray.from_numpy_ndarray(t["mels"].combine_chunks().to_numpy_ndarray() - 7)
        pq.write_table(t.set_column(t.schema.get_field_index("mels"), "mels", lower), f)
    assert all(r.feature != want[r.media_sha256] for r in described.collect())


def slow_feature(text):
    """The feature by its definition: zero-stuffing and convolution, a Fourier matrix, triangles, a walk over the frames."""
    payload = text + bytes(-len(text) % 64 or (64 if not text else 0))
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    place = np.arange(36) - 17.5
    taps = np.sinc(place / 4) / 4 * np.hamming(36) * 3
    y = np.zeros(-(-len(x) // 4) * 3)
    for m in range(len(y)):
        for i in range(max(0, (4 * m - 20) // 3), min(len(x), (4 * m + 15) // 3 + 1)):
            if 0 <= 4 * m - 3 * i + 15 < 36:
                y[m] += x[i] * taps[4 * m - 3 * i + 15]
    n = 1 + max(0, -(-(len(y) - 256) // 128))
    y = np.r_[y, np.zeros(max(0, (n - 1) * 128 + 256 - len(y)))]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    fourier = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(129)) / 256)
    mel, hertz = lambda f: 1127 * np.log(1 + f / 700), lambda m: 700 * (np.exp(m / 1127) - 1)
    edges = [hertz(mel(40) + k * (mel(6000) - mel(40)) / 33) for k in range(34)]
    weights = np.zeros((129, 32))
    for k in range(32):
        a, b, c = edges[k : k + 3]
        for j in range(129):
            f = j * 12000 / 256
            weights[j, k] = max(0, min((f - a) / (b - a), (c - f) / (c - b)))
        weights[next(j for j in range(129) if j * 12000 / 256 >= b), k] += 1e-3
    mels = np.array([10 * np.log10(np.abs((y[128 * t : 128 * t + 256] * window) @ fourier) ** 2 @ weights + 1e-10) for t in range(n)])
    energy, on, segments, loud = mels.mean(1), False, 0, 0
    for e in energy:
        was, on = on, e > np.median(energy) + 3 or on and e >= np.median(energy) + 1
        segments += on and not was
        loud += on
    return n, segments, loud * 128 / 12, mels.mean(0)


def test_features_match_their_definition():
    rng = np.random.default_rng(3)
    loud = b"".join(bytes(rng.integers(32, 127, 700, dtype=np.uint8)) + b" " * 900 for _ in range(3))
    for text in (b"", b"hello", b"It was a dark and stormy night. " * 40, loud, bytes(rng.integers(0, 256, 3001, dtype=np.uint8))):
        frames, segments, ms, mels = am.analyse(am.to_wav(am.payload_of(text))).summary().split(";")
        want = slow_feature(text)
        assert (int(frames), int(segments)) == want[:2] and abs(float(ms) - want[2]) < 0.06
        assert np.abs(np.array(mels.split(","), float) - want[3]).max() < 0.15
