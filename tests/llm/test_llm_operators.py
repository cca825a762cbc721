"""Each corpus operator against brute force, the library it must equal, or held-out rows, with the awkward rows in."""

import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import common, dartminhash, dedup, langid, lmscore, media, packing, quality, spieces, topk, urlrules, warc
from symloom.llm.queries import QUERIES, _pieces

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string"
LONG = "wort und noch ein wort " * 4000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, "clash") for i, t, lang in rows], DOC)


AWKWARD = [(1, None, "en"), (2, "", None), (3, "!!! 123 ...", "en"), (4, LONG, "de"), (5, "That it.", "en"), (5, "That it.", "en"), (None, "no id here", "en"), (6, "x", None), (7, "é́🙂\x00\n\t", "fr")]


def empty(spark):
    return docs(spark, []).where("false")


# --- 1 top-k


def brute_topk(rows, every, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if qi % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi)[:k]
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 0.1, 3.0])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, [0.5] * 3), (705, []), (None, [0.1] * 8)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a third of all rows are one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("clash"))
    got = topk.search(topk.integers(df), F.col("vec_id") % 50 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk([(i, v) for i, v in rows], 50, 5)


def test_topk_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 2.0]), (50, [0.0, -1.0])], schema)
    got = topk.search(topk.integers(few), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 32768), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, -131072)]
    assert topk.search(topk.integers(few.where("false")), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_stops_early(spark):
    """Rows that were multiplied, of all that could be: clusters are left out, and so are far annuli of the own cluster."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 6)) * 20
    v = [(centre[i % 30] * (1 + 0.2 * rng.random()) + 0.02 * rng.normal(size=6)).tolist() for i in range(6000)]
    df = topk.integers(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"))
    ask = F.col("vec_id") % 50 == 0
    work = topk.scanned(df, ask, 5).agg(F.sum("work")).first()[0]
    assert 0 < work < 0.1 * 120 * 6000
    got = sorted(map(tuple, topk.search(df, ask, 5).collect()))
    assert got == brute_topk(list(enumerate(v)), 50, 5)
    space = topk.Space(np.array([[0, 0]]), 2, 1e6, 1000)
    rows = np.stack([np.arange(1000), np.zeros(1000, int)], 1)  # a line: one cell, annuli far from the query are never seen
    d = space.to_pivots(space.lift(rows))[:, 0]
    order = np.argsort(d)
    cell = topk.cells(np.zeros(1000, int), d[order], rows[order], order)
    front = topk.Front(space, rows[[999]], np.array([999]), np.array([topk._NONE]), 3)
    front.search(cell)
    assert front.i.tolist() == [[998, 997, 996]] and front.touched < 500
    with pytest.raises(ValueError):
        topk.search(topk.integers(spark.createDataFrame([(0, [1e9, 1e9])], "vec_id long, embedding array<double>")), ask)


# --- 2 near-duplicates


def weighted_jaccard(a, b):
    x, y = (dict(zip(*dedup.elements(t))) for t in (a, b))
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in x) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys()))


@pytest.mark.parametrize("real", [False, True])
def test_signatures_estimate_weighted_jaccard(real):
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**62, 250).astype(np.uint64)
    w = rng.random(250) * 4 if real else rng.integers(1, 5, 250).astype(float)
    for keep in (250, 200, 120, 40):
        w2 = np.where(np.arange(250) < keep, w, rng.random(250) if real else 1.0)
        a, b = dartminhash.signatures([(e, w), (e, w2)], 4096)
        assert abs(dartminhash.estimate(a, b) - np.minimum(w, w2).sum() / np.maximum(w, w2).sum()) < 0.035


def test_signature_of_tiny_and_empty_sets():
    one = (np.array([5], np.uint64), np.array([1.0]))
    none = (np.zeros(0, np.uint64), np.zeros(0))
    a, b, c = dartminhash.signatures([one, none, one], 64)
    assert b is None and (a == c).all() and len(a) == 64


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "be", "lor", "tis", "que", "mo", "ra"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())


def test_classes_against_all_pairs(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(40, 200)) for _ in range(25)]
    rows = list(enumerate(base))
    rows += [(100 + i, edited(rng, base[i % 10], 0.02)) for i in range(30)]
    rows += [(200 + i, base[3]) for i in range(40)]
    rows += [(300 + i, prose(rng, 60) + " " + " ".join(base[20].split()[:15])) for i in range(8)]  # shares a short passage
    got = {r["doc_id"]: r for r in dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a == b or weighted_jaccard(a, b) >= 0.6:
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i, _ in rows}
    assert got[200]["n_copies"] == 41 and got[300]["n_links"] == 0 and got[100]["n_links"] > 0
    kept = sorted(r["doc_id"] for r in dedup.keep_one(docs(spark, [(i, t, None) for i, t in rows])).collect())
    assert kept == sorted({find(i) for i, _ in rows})


def test_texts_of_one_template_stay_apart(spark):
    rng = random.Random(11)
    template = prose(rng, 60)
    rows = [(i, template + " " + prose(rng, 40)) for i in range(400)]
    rows += [(1000 + i, edited(rng, rows[i][1], 0.01)) for i in range(20)]
    assert 0.3 < weighted_jaccard(rows[0][1], rows[1][1]) < 0.5
    keys = [set(dedup.band_keys(s, dedup.BANDS, dedup.ROWS).tolist()) for s in dartminhash.signatures([dedup.elements(t) for _, t in rows[:400]], 256)]
    assert any(a & b for a, b in itertools.combinations(keys, 2))  # candidates that aren't near-duplicates
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert dedup.keep_one(docs(spark, [(i, t, None) for i, t in rows])).count() == 400


def test_links_are_counted_as_texts(spark):
    rng = random.Random(13)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 0.01)) for i in range(150)] + [(500, one := prose(rng, 100)), (501, one + " " + prose(rng, 1)), (502, prose(rng, 90))]
    texts = sorted({t for _, t in rows})
    sketch = [s.astype(np.uint8) for s in dartminhash.signatures([dedup.elements(t) for t in texts], 256)]
    keys = [set(dedup.band_keys(s.astype(np.uint64), dedup.BANDS, dedup.ROWS).tolist()) for s in sketch]
    want = dict.fromkeys(texts, 0)
    for i, j in itertools.combinations(range(len(texts)), 2):
        if keys[i] & keys[j] and (sketch[i] == sketch[j]).mean() >= dedup.SIMILARITY:
            want[texts[i]] += 1
            want[texts[j]] += 1
    got = {r["doc_id"]: r for r in dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert {i: got[i]["n_links"] for i, _ in rows} == {i: want[t] for i, t in rows}
    assert got[0]["n_links"] > 64 and got[500]["n_links"] == 1 < got[500]["n_shared_keys"] <= 64 and got[502]["n_links"] == 0


def test_parts_of_a_hot_key_lose_no_link(spark, monkeypatch):
    rng = random.Random(17)
    base = prose(rng, 120)
    rows = docs(spark, [(i, edited(rng, base, 0.03), None) for i in range(60)] + [(100 + i, prose(rng, 50), None) for i in range(5)])
    found = []
    for part in (4096, 7, 1):
        monkeypatch.setattr(dedup, "PART", part)
        found.append(sorted(map(tuple, dedup.near_duplicates(rows).collect())))
    assert found[0] == found[1] == found[2] and max(r[2] for r in found[0]) > 30


def test_recall_on_the_corpus(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(d).collect()}
    sets = {}
    for r in d.collect():
        sets.setdefault(r["text"] or "", (r["doc_id"], dict(zip(*(x.tolist() for x in dedup.elements(r["text"] or ""))))))
    holders = {}
    for n, (i, x) in enumerate(sets.values()):
        for e in x:
            holders.setdefault(e, []).append(n)
    every, near, kept = list(sets.values()), 0, 0
    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        (i, x), (j, y) = every[a], every[b]
        low = sum(min(n, y.get(e, 0)) for e, n in x.items())
        if low >= 0.7 * (sum(x.values()) + sum(y.values()) - low):
            near, kept = near + 1, kept + (got[i] == got[j])
    assert near > 20 and kept / near >= 0.97


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(60) if i != 30] + [(90, 80), (80, 85)]
    random.Random(1).shuffle(pairs)
    got = {r[0]: r[1] for r in dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 80: 80, 85: 80, 90: 80}


def test_dedup_awkward_rows(spark):
    rows = dedup.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[None]["class_id"] is None and by[5]["n_copies"] == 2
    kept = dedup.keep_one(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, AWKWARD).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, 7, None]
    assert dedup.near_duplicates(empty(spark)).count() == 0 and dedup.keep_one(empty(spark)).count() == 0


def test_keeping_one_of_repeated_ids(spark):
    kind = "doc_id long, text string, _gone string, _key string, n int, `a.b` string, out map<string,int>"
    rows = [(1, "A a", "z", None, 1, "x", {}), (1, "A a", "y", None, 2, "x", {"k": 1}), (1, "B b", "q", "k", 3, None, {}), (1, "B b", "q", "k", 3, None, {}), (2, "A a", "a", None, 0, "x", {}), (None, "A a", None, None, 0, None, {})]
    df = spark.createDataFrame(rows, kind)
    kept = dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["_gone"], r["n"]) for r in kept.collect()), key=str) == sorted([(1, "A a", "y", 2), (1, "B b", "q", 3), (None, "A a", None, 0)], key=str)
    two = dedup.keep_one(df.select("doc_id", "text"))
    assert sorted(map(tuple, two.collect()), key=str) == [(1, "A a"), (1, "B b"), (None, "A a")]


def test_one_id_with_two_texts(spark):
    rows = [(1, "alpha beta gamma delta", None), (1, "entirely other words here", None), (2, "alpha beta gamma delta", None)]
    assert sorted(r["text"] for r in dedup.keep_one(docs(spark, rows)).collect()) == sorted({t for _, t, _ in rows})


# --- 3 packing


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 8)
        lengths = sorted(rng.sample(range(1, 40), n))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)

        def cost(ends):
            return sum(c * min(e for e in ends if e >= x) for x, c in zip(lengths, counts))

        best = min(cost((*c, lengths[-1])) for r in range(min(k, n)) for c in itertools.combinations(lengths[:-1], r))
        got = packing.bounds(lengths, counts, k)
        assert cost(got) == best and len(got) == min(k, n)


@pytest.mark.parametrize("shard", [200_000, 7])
def test_packing_is_whole(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard)
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 2, 3, 50, 51, 400]), None) for i in range(80)] + [(99, "same size " * 3, None)] * 20 + [(i, t, lang) for i, t, lang in AWKWARD]
    out = packing.pack(docs(spark, rows), buckets=3, max_len=300, budget=1000).collect()
    want = sorted((i if i is not None else -1, len([x for x in (t or "").split()])) for i, t, _ in rows)
    got = {}
    assert sum(r["n_tokens"] for r in out) == sum(n for _, n in want)
    for r in out:
        if r["n_tokens"] == 0:
            assert r["bucket"] is None and r["batch"] is None
            continue
        assert r["n_tokens"] <= r["bucket_len"] <= 300
        got.setdefault((r["bucket"], r["batch"]), []).append(r)
    sizes = {}
    for (b, n), rs in got.items():
        size = max(1, 1000 // rs[0]["bucket_len"])
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len(rs) <= size
        sizes.setdefault(b, {})[n] = (len(rs), size)
    for by in sizes.values():
        assert sorted(by) == list(range(len(by))) and all(by[n][0] == by[n][1] for n in list(sorted(by))[:-1])
    assert packing.pack(empty(spark)).count() == 0


def test_packing_order_is_the_same_at_every_size(spark, monkeypatch):
    rng = random.Random(8)
    ids = [None, None, -5, 2**63 - 1, *rng.sample(range(10**6), 120), *[7] * 30]
    rows = docs(spark, [(i, "w " * rng.choice([0, 1, 2, 3, 50, 51, 400, 900]), None) for i in ids])
    found = []
    for size in (200_000, 7):
        monkeypatch.setattr(packing, "SHARD_ROWS", size)
        found.append(sorted(map(tuple, packing.pack(rows, buckets=3, max_len=300, budget=1000).collect()), key=str))
    assert found[0] == found[1]
    by = {}
    for doc, piece, n, bucket, _, batch, slot in found[1]:
        if n:
            by.setdefault(bucket, []).append((batch, slot, (doc is not None, doc or 0, piece, n)))
    for placed in by.values():  # DuckDB's order, as in the oracle
        assert [x[2] for x in sorted(placed)] == sorted(x[2] for x in placed)


# --- 4 audio


def test_audio_round_trip(spark):
    rows = AWKWARD + [(20, "ab" * 288, "en"), (21, "ab" * 288, "de"), (22, "ab" * 288 + "c", "de")]
    out = [r.asDict() for r in media.digests(docs(spark, rows)).collect()]
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t, _ in rows:
        data = (t or "").encode()
        n = 576 * max(1, -(-len(data) // 576))
        full = data + b"\xff" * (n - len(data))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), n)
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-32:])
        assert r["media_bytes"] == n + 44 and r["media_sha256"] == hashlib.sha256(media.wav(full)).hexdigest()
    assert by[20]["feature"] == by[21]["feature"] != by[22]["feature"]
    assert media.digests(empty(spark)).count() == 0


def test_resampling_equals_the_definition():
    x = np.random.default_rng(0).normal(size=101).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2), (1, 1)):
        bank = media.filter_bank(up, down, 8)
        n = -(-len(x) * up // down)
        want = [sum(bank[i * down % up, k] * x[i * down // up - k] for k in range(8) if 0 <= i * down // up - k < len(x)) for i in range(n)]
        assert np.allclose(media.resample(x, bank, down), want, atol=1e-5)


def test_hysteresis():
    e = np.array([0, 5, 9, 5, 0, 5, 5, 0, 9, 0.0])
    assert media.hysteresis(e, 8, 4).tolist() == [[1, 4], [8, 9]]
    assert len(media.hysteresis(np.zeros(3), 8, 4)) == 0


def slow_features(payload):
    """Tensors, spans and segments by the definitions, one frame and one sum at a time."""
    x = [(v - 128) / 128 for v in payload]
    bank = media.filter_bank().astype(float)
    up, taps = bank.shape
    y = [sum(bank[i * media.DOWN % up, k] * x[i * media.DOWN // up - k] for k in range(taps) if 0 <= i * media.DOWN // up - k < len(x)) for i in range(-(-len(x) * up // media.DOWN))]
    rate = media.RATE * up / media.DOWN
    n = max(1, -(-max(0, len(y) - media.FRAME) // media.HOP) + 1)
    y += [0.0] * ((n - 1) * media.HOP + media.FRAME - len(y))
    t = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / media.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), t) / media.FRAME)
    hz = np.arange(media.FRAME // 2 + 1) * rate / media.FRAME
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = [700 * (10 ** (top * i / (media.MELS + 1) / 2595) - 1) for i in range(media.MELS + 2)]
    grid, energy = [], []
    for i in range(n):
        f = np.array(y[i * media.HOP : i * media.HOP + media.FRAME]) * window
        power = abs(waves @ f) ** 2
        mel = [sum(p * max(0, min((h - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - h) / (edge[m + 2] - edge[m + 1]))) for p, h in zip(power, hz)) for m in range(media.MELS)]
        grid.append([100 * np.log(v + media.FLOOR) for v in mel])
        energy.append(10 * np.log10((f * f).mean() + media.FLOOR))
    grid += [[round(100 * np.log(media.FLOOR))] * media.MELS] * (-n % media.PATCH)
    mean, step, segments, begin, high = sum(energy) / n, media.HOP / rate, [], None, False
    for i, e in enumerate([*energy, -1e9]):
        if e >= mean + media.LOWER_DB:
            begin, high = i if begin is None else begin, high or e >= mean + media.UPPER_DB
        elif begin is not None:
            segments += [(begin * step, i * step)] if high else []
            begin, high = None, False
    spans = [(a * step, (min(a + media.PATCH, n) - 1) * step + media.FRAME / rate) for a in range(0, n, media.PATCH)]
    return np.array(grid).reshape(-1, media.PATCH, media.MELS), spans, segments


def test_features_equal_the_definitions(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "short", prose(rng, 400), "~" * 700 + prose(rng, 300) + " " * 2500 + "Zz!" * 600, "é🙂" * 1200]
    rows = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    digests = {r["doc_id"]: r for r in media.digests(rows).collect()}
    monkeypatch.setattr(media, "HELD", 1000)  # clips are written in several blocks
    clips = {r["doc_id"]: r for r in media.features(media.store(rows)).collect()}
    assert sorted(clips) == sorted(digests) == list(range(len(texts)))
    for i, t in enumerate(texts):
        r = clips[i]
        payload = media.payload_of(t or "")[0]
        tensors, spans, segments = slow_features(payload)
        got = np.array([p["tensor"] for p in r["patches"]], np.int16).reshape(-1, media.PATCH, media.MELS)
        assert got.shape == tensors.shape and np.abs(got - tensors).max() < 2  # single precision, hundredths
        assert np.allclose([(p["begin"], p["end"]) for p in r["patches"]], spans) and np.allclose(np.array([(x["begin"], x["end"]) for x in r["segments"]]).reshape(-1, 2), np.array(segments).reshape(-1, 2))
        f = media.Features(got, np.array(spans), np.array([(x["begin"], x["end"]) for x in r["segments"]]).reshape(-1, 2))
        assert digests[i]["feature"] == f.digest() and (digests[i]["n_patches"], digests[i]["n_segments"]) == (len(spans), len(segments))
    assert any(clips[i]["segments"] for i in clips) and len({r["feature"] for r in digests.values()}) == len(texts) - 1


def test_tone_lands_in_its_band_and_tensors_are_stored(spark):
    import pyarrow.parquet as pq

    t = np.arange(16000) / media.RATE
    clip = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    f = media.analyze(clip, media.RATE)
    rate = media.RATE * media.UP / media.DOWN
    want = media.mel_bank(rate)[int(np.argmin(np.abs(np.fft.rfftfreq(media.FRAME, 1 / rate) - 1000)))].argmax()
    assert f.tensors[0, 5].argmax() == want
    files, _ = media.write_tensors(media.store(docs(spark, [(1, "hello " * 9000, None), (2, None, None)])))
    tables = [pq.read_table(r["path"]) for r in files.collect()]
    assert str(tables[0].schema.field("tensor").type).startswith("extension<arrow.fixed_shape_tensor") and sum(r["clips"] for r in files.collect()) == 2
    assert sum(map(len, tables)) > 2 and media.features(media.store(empty(spark))).count() == 0


# --- 5 URLs


def test_url_rules_equal_trying_all(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/1", "https://a.example.net/de/2", "https://example.net/EN/2", "https://x.org/fr/track/pixel.html", "https://x.org/de/a?page=2&ref=x", "https://ads.x.org/en/b", "https://badads.x.org/en/b", "https://x.org/en/c.html", "https://x.org/banner", "https://x.org/banners", "https://blog.y.org/es/9", "https://www.y.org/fr9/#top", "http://x.net?q=/", "http://x.net", "http://É.Org/fr/", "https://x.org/" + "long/" * 3000]
    urls += [f"https://s{i % 7}.example.{'com net org'.split()[i % 3]}/{'en de fr es'.split()[i % 4]}/{i}{['', '.html', '?page=2&ref=x', '#top'][i % 4]}" for i in range(84)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    out = urlrules.judge(df).collect()
    assert len(out) == len(urls) + 1
    index = urlrules.build(df, urlrules.PATTERN_RULES)
    every = urlrules.Index({}, list(range(len(index.rules))), index.rules)
    for r in out:
        url = urls[r["page_id"]]
        host, path = urlrules.split_url(url)
        assert (r["host"], r["path"]) == (host, path)
        fits = [(len(h + p), h + p, v) for h, p, v in urlrules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else every.match(url or "")[0])
        assert r["candidates"] < len(urlrules.PATTERN_RULES)
    assert urlrules.judge(df.where("false")).count() == 0


def fits(pattern, url):
    """A matcher of its own: characters one by one, ``*`` by trying every place."""
    url, p = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pattern.removeprefix("@@"))
    anchor = "label" if p.startswith("||") else "start" if p.startswith("|") else ""
    p = p.lstrip("|")
    end = p.endswith("|")
    p = p[:-1] if end else p

    def at(i, j):
        if j == len(p):
            return i == len(url) or not end
        if p[j] == "*":
            return any(at(n, j + 1) for n in range(i, len(url) + 1))
        if p[j] == "^":
            if i == len(url):
                return at(i, j + 1)
            return not (url[i] in "abcdefghijklmnopqrstuvwxyz0123456789_.%-") and at(i + 1, j + 1)
        return i < len(url) and url[i] == p[j] and at(i + 1, j + 1)

    if anchor == "start":
        return at(0, 0)
    if not anchor:
        return any(at(i, 0) for i in range(len(url) + 1))
    head, sep, rest = url.partition("://")
    if not sep or any(c in "/?#" for c in head):
        return False
    host = len(head) + 3
    stop = next((i for i in range(host, len(url)) if url[i] in "/?#"), len(url))
    return any(at(i, 0) for i in range(host, stop + 1) if i == host or url[i - 1] == ".")


def test_generated_url_rules_equal_another_matcher(spark):
    rng = random.Random(21)
    words = ["ads", "track", "x1", "img", "a", "banner", "shop", "zz9"]
    piece = lambda: rng.choice([*words, "*", "^", ".", "/", "?", "=", "-"])
    rules = list(dict.fromkeys(rng.choice([*[""] * 8, "|", *["||"] * 3, "@@", "@@||"]) + piece() + rng.choice(words) + "".join(piece() for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "|", "^"]) for _ in range(400)))
    rules = [r for r in rules if r.removeprefix("@@").strip("|")]
    urls = [rng.choice(["http://", "https://", "", "HTTP://"]) + ".".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + "".join(rng.choice("/?=.-&") + rng.choice(words).upper() for _ in range(rng.randrange(0, 5))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlrules.judge(df, [], rules).collect()
    for r in out:
        hits = [p.startswith("@@") for p in rules if fits(p, urls[r["page_id"]])]
        assert r["verdict"] == ("allow" if not hits or any(hits) else "block"), urls[r["page_id"]]
    assert {r["verdict"] for r in out} == {"allow", "block"} and max(r["candidates"] for r in out) < len(rules)


# --- 6 SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=_pieces(None))


TRICKY = ["", " ", "  a", "a  b ", "Hello world\n\nfoo\tbar", "▁x", "x▁▁y", "日本𝄞", "\x00a", "<s>hi</s><0x41>", "\n", "  \n  ", "a" * 3000, "ab " * 200, "ﬁ Å", "é", "\xa0x", "　x", "🙂🙂", "((((" * 30, "﻿bom", "a▁"]


def test_pieces_equal_the_library(spark, library):
    e = spieces.Encoder(_pieces(None))
    texts = TRICKY + [r[0] for r in spark.read.parquet(DATA + "/documents.parquet").select("text").collect()]
    for t in texts:
        ids = library.encode(t)
        assert e.ids(t) == ids and e.decode(ids) == library.decode(ids) == e.decode_fast(ids)
    for t in TRICKY:
        spans = e.encode(t)
        assert [p[0] for p in spans] == library.encode(t)
        data, at = t.encode(), 0
        for _, _, a, b in spans:  # spans cover the source from the left to the right, without gaps
            assert at in (a, b)
            at = max(at, b)
        assert at == len(data) or not spans


def test_decoding_random_ids(library):
    e, rng = spieces.Encoder(_pieces(None)), random.Random(3)
    for _ in range(1500):
        ids = [rng.randrange(0, 259 if rng.random() < 0.5 else 32000) for _ in range(rng.randrange(9))]
        if 0 in ids:
            continue
        assert e.decode(ids) == library.decode(ids) == e.decode_fast(ids)


def double_array(words):
    """A small double array over byte strings: {prefix: offset of its replacement}."""
    trie = {}
    for w, v in words.items():
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[None] = v
    units, taken = {0: 0}, {0}

    def place(node, at):
        # children sit at base ^ label; a leaf's value sits at base itself
        base = next(b for b in range(256, 1 << 20, 256) if not ({b ^ (c or 0) for c in node} | {b}) & taken)
        taken.update({b for b in ({base} | {base ^ c for c in node if c is not None})})
        units[at] = units[at] & 0xFF | ((base ^ at) << 10) | ((1 << 8) if None in node else 0)
        if None in node:
            units[base] = node[None] | 1 << 31
        for c, sub in node.items():
            if c is not None:
                units[base ^ c] = c
                place(sub, base ^ c)

    place(trie, 0)
    return [units.get(i, 0x80000000 | 1) for i in range(max(units) + 1)]


def test_longest_prefix_normalisation_keeps_the_alignment():
    import struct

    strings, words = b"", {}
    for source, to in {"ﬁ": "fi", "Å": "Å", "Å": "Å", "A": "a", "　": " ", "\t": " ", "​": ""}.items():
        words[source.encode()] = len(strings)
        strings += to.encode() + b"\0"
    units = double_array(words)
    blob = struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + strings
    n = spieces.Normalizer(blob, dummy_prefix=True, squeeze=True, escape=True)
    assert n.longest("Åx".encode(), 0) == ("Å".encode(), 3) and n.longest(b"Ax", 0) == (b"a", 1)
    text = "  ﬁn　\t Å​A  "
    norm, source = n.normalize(text)
    assert norm == "▁fin▁Åa"
    data = text.encode()
    at = [source[i] for i in range(len(norm.encode()))]
    assert at == sorted(at) and source[-1] == len(data.rstrip(b" ")) and data[source[3] : source[3] + 3] == "ﬁ".encode()
    plain = spieces.Normalizer(b"", True, False, True)
    assert plain.normalize("a b") == ("▁a▁b", [0, 0, 0, 0, 1, 1, 1, 2, 3])


def test_sentencepiece_query(spark, library):
    rows = docs(spark, AWKWARD)
    out = spieces.digests(rows, _pieces(None)).collect()
    want = [(i, len(x := library.encode(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, t, _ in AWKWARD]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    spans = {r["doc_id"]: r["pieces"] for r in spieces.spans(rows, _pieces(None)).collect()}
    assert spans[1] == [] and spans[5][-1]["end"] == len("That it.")
    assert spieces.digests(empty(spark), _pieces(None)).count() == 0


def test_sentencepiece_query_has_the_spans(spark):
    e = spieces.Encoder(_pieces(None))
    bare = spieces.Encoder(_pieces(None))
    bare.fallback = False
    assert [(i, *x) for i, x in zip(*(v.tolist() for v in bare.placed("a 日b")))] == [(p[0], *p[2:]) for p in bare.encode("a 日b")]
    rows = spark.read.parquet(DATA + "/documents.parquet").select("doc_id", "text").limit(60).collect()
    for t in TRICKY + [r["text"] or "" for r in rows]:
        norm, source = e.normalizer.normalize(t)
        got = e.normalizer.aligned(t)
        assert (got[0], got[1].tolist()) == (norm, source)
        ids, at = e.placed(t)
        want = e.encode(t)
        assert ids.tolist() == [p[0] for p in want] == e.ids(t) and at.tolist() == [[p[2], p[3]] for p in want]
    out = {r["doc_id"]: r["spans_sha256"] for r in QUERIES["op6_sentencepiece"](spark, DATA).collect()}
    for r in rows:
        at = np.array([[p[2], p[3]] for p in e.encode(r["text"] or "")], "<i8")
        assert out[r["doc_id"]] == hashlib.sha256(at.tobytes()).hexdigest()


# --- 7 LM scoring


def brute_scores(rows, good, model):
    e = spieces.Encoder(model)
    v = len(e.pieces)
    seen = [(i, [1, *e.ids(t or "")]) for i, t, _ in rows]

    def learn(which):
        big, uni, hist = {}, np.zeros(v), {}
        for i, ids in seen:
            if which(i):
                for h, w in zip(ids, ids[1:]):
                    big[h, w] = big.get((h, w), 0) + 1
                    uni[w] += 1
        for (h, _), n in big.items():
            c, k = hist.get(h, (0, 0))
            hist[h] = (c + n, k + 1)

        def loss(h, w):
            single = (uni[w] + 1) / (uni.sum() + v)
            c, k = hist.get(h, (0, 0))
            return -np.log(single if not c else (max(big.get((h, w), 0) - 0.75, 0) + 0.75 * k * single) / c)

        return loss

    t, b = learn(lambda i: i in good), learn(lambda i: True)
    return sorted(((i, len(x) - 1, *(np.mean([m(h, w) for h, w in zip(x, x[1:])]) if len(x) > 1 else None for m in (t, b))) for i, x in seen), key=lambda r: (str(r[0]), r[1]))


def test_losses_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [*AWKWARD, *((30 + i, prose(rng, 30), None) for i in range(12))]
    good = {5, 30, 31, 32}
    target = spark.createDataFrame([(i,) for i in [*good, 30, 999]], "doc_id long")
    want = brute_scores(rows, good, _pieces(None))
    first = None
    for table_rows in (lmscore.TABLE_ROWS, 100, 7):
        got = sorted(map(tuple, lmscore.score(docs(spark, rows), target, _pieces(None), table_rows).collect()), key=lambda r: (str(r[0]), r[1]))
        first = first or got
        assert got == first and len(got) == len(want)  # the number of parts changes no bit
    for g, w in zip(first, want):
        assert g[:2] == w[:2]
        if w[1]:
            assert np.allclose(g[2:4], w[2:], atol=2e-9) and np.isclose(g[4], w[2] - w[3], atol=2e-9)
        else:
            assert g[2:] == (None, None, None)
    assert lmscore.score(empty(spark), target, _pieces(None)).count() == 0
    assert lmscore.score(empty(spark), target, _pieces(None), 1).count() == 0


# --- 8 WARC


def test_warc_round_trip(spark):
    html = ["<p>one</p>", None, "", "<p>two</p>" * 9000, "<p>one</p>", "é\r\n\r\n<p>", "<p>one</p>", "z"]
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(7, "http://x/7", "z"), (40, "bad\r\nurl: x\x00", "q"), (41, None, "q"), (None, "http://none", "<p>one</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    out = warc.round_trip(df).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i != first[h or ""]
        want.append((i, len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    files, home = warc.write(df)
    bodies = {r["page_id"]: bytes(r["payload"]) for r in warc.scan(files, home).where("record_type = 'response'").collect()}
    assert bodies == {i: (h or "").encode() for i, _, h in rows if i == first[h or ""]}
    assert warc.round_trip(df.where("false")).count() == 0
    long = warc.write(df.where("page_id in (0, 4)"), min_bytes=100)
    assert {r["record_type"] for r in warc.scan(*long).collect()} == {"response"}


def test_many_repeats_are_salted(spark, monkeypatch):
    html = ["", "a", "b"]
    df = spark.createDataFrame([(i, None, html[min(i % 5, 2)]) for i in range(200)], "page_id long, url string, html string")
    want = sorted(map(tuple, warc.round_trip(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, warc.round_trip(df).collect())) == want and sum(r[3] == "response" for r in want) == 3


def gz(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_reader_goes_by_pieces(monkeypatch, step):
    monkeypatch.setattr(warc, "BLOCK", step)
    bodies = [b"", b"x", b"\r\n\r\n", bytes(range(256)) * (400 if step > 1 else 4)]
    data = b"".join(warc.encode(i, "http://x", x, None, False) for i, x in enumerate(bodies))
    sizes = [len(p) for m in warc.members(io.BytesIO(data)) for p in m]
    assert max(sizes) <= step
    assert [r.payload for r in warc.read(io.BytesIO(data))] == bodies
    assert [(r.payload, r.length) for r in warc.read(io.BytesIO(data), bodies=False)] == [(None, len(x)) for x in bodies]


def test_reader_finds_damage(spark):
    good = [warc.encode(i, "http://x", b"body %d" % i, None, False) for i in range(3)] + [warc.encode(9, "http://x", b"body 1", 1, True)]
    assert [r.payload for r in warc.read(io.BytesIO(b"".join(good)))] == [b"body 0", b"body 1", b"body 2", b""]
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(b"".join(good)[:-5])))
    text = zlib.decompress(good[0], 31)
    length = text[text.rindex(b"Content-Length:", 0, text.index(b"\r\n\r\n")) :].split(b"\r\n")[0]
    broken = [text.replace(b"body 0", b"body X"), text.replace(length, length[:-1] + b"%d" % ((int(length[-1:]) + 1) % 10)), text[:-1], text + b"x", b"WARC/1.1\r\n", text.replace(b"WARC/1.1", b"WARX/1.1"), text.replace(b"sha1:", b"sha1:A", 1)]
    assert len({*broken, text}) == 8
    for x in broken:
        with pytest.raises(ValueError):
            list(warc.read(io.BytesIO(gz(x))))
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = [(1, 3, "D", "response", None), (2, 3, "D", "revisit", 1)]
    assert warc.checked(spark.createDataFrame(rows, kind)).count() == 2
    for bad in ((3, 3, "E", "revisit", 1), (3, 4, "D", "revisit", 1), (3, 3, "D", "revisit", 2)):
        with pytest.raises(ValueError):
            warc.checked(spark.createDataFrame([*rows, bad], kind))


# --- 9 and 10 classifiers


def test_sample_has_the_smallest_hashes(spark):
    ids = [*range(6000), *[5] * 3000, *range(9000, 9020), None]
    rows = spark.createDataFrame([(i, None if i is None else "rare" if i >= 9000 else "many", "clash") for i in ids], "doc_id long, lang string, _label string")
    got = {}
    for r in common.sample_per_class(rows, "lang", 50).collect():
        got.setdefault(r["lang"], []).append(r["doc_id"])
    order = [r[0] for r in spark.range(6000).select("id").orderBy(F.shiftrightunsigned(F.xxhash64("id"), 11)).limit(50).collect()]
    assert sorted(got["rare"]) == list(range(9000, 9020)) and sorted(got["many"]) == sorted(order)
    assert common.sample_per_class(rows.where("false"), "lang", 50).count() == 0


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.normal(size=quality.WIDTH).astype(np.float32), rng.normal(size=(quality.WIDTH, 8)).astype(np.float32) * 0.1, np.zeros(quality.STATS), np.ones(quality.STATS))
    x = np.zeros((2, quality.WIDTH), np.float32)
    x[0, [3, 70, 4100]], x[1, [3, 9]] = [0.5, 1.0, -2.0], [1.0, 1.0]
    for row in range(2):
        on = np.flatnonzero(x[row])
        want = 0.3 + x[row] @ m.linear + sum(m.factors[i] @ m.factors[j] * x[row, i] * x[row, j] for i, j in itertools.combinations(on, 2))
        assert np.isclose(m.margin(x)[row], want, atol=1e-3)


def test_classifiers_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r for r in d.select("doc_id", "lang").collect()}
    out = langid.predict(d, langid.fit(d)).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == d.count() and 250 < len(held) < 420
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([truth[r["doc_id"]]["lang"] == r["lang_pred"] for r in held]) > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = quality.predict(d, quality.fit(d, labels)).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] in good]
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) > 0.96 and all(r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_language_kernel_equals_brute_force(spark, monkeypatch):
    """Sets of n-grams, their kernel, and ridge regression on the landmarks in its dual form, without the map."""
    monkeypatch.setattr(langid, "LANDMARKS", 30)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in d.collect() if r["text"]]

    def grams(text):
        out, blank, keep = set(), True, " "
        for c in text.lower():
            k = common.char_classes()[ord(c)]
            if k in (common.LOWER, common.UPPER):
                keep, blank = keep + c, False
            elif not blank:
                keep, blank = keep + " ", True
        keep += " "
        for n in (1, 2, 3):
            for i in range(len(keep) - n + 1):
                h = (ord(keep[i]) * 40503 + 1) % 2**32
                for c in keep[i + 1 : i + n]:
                    h = h * 16777619 % 2**32 ^ ord(c)
                out.add((h + (n if n > 1 else 0)) * 2654435761 % 2**32 >> 32 - langid.BITS)
        return out

    sets = {r["doc_id"]: grams(r["text"]) for r in rows}
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    learnt = sorted((r["lang"], r["doc_id"]) for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and any(c.isalpha() for c in r["text"]))
    langs = sorted({x for x, _ in learnt})
    marks = [i for x in langs for i in [i for y, i in learnt if y == x][: max(4, 30 // len(langs))]]
    knm = np.array([[k(sets[i], sets[j]) for j in marks] for _, i in learnt])
    kmm = np.array([[k(sets[i], sets[j]) for j in marks] for i in marks])
    w = np.array([1 / sum(y == x for y, _ in learnt) for x, _ in learnt])
    target = np.array([[1.0 if x == y else -1.0 for y in langs] for x, _ in learnt])
    beta = np.linalg.solve((knm * w[:, None]).T @ knm + 1e-2 / len(langs) * kmm, (knm * w[:, None]).T @ target)
    out = {r["doc_id"]: r for r in langid.predict(d, langid.fit(d)).collect()}
    for r in rows:
        s = np.array([k(sets[r["doc_id"]], sets[j]) for j in marks]) @ beta
        p = np.exp(langid._SHARP * (s - s.max()))
        got = out[r["doc_id"]]
        if got["lang_pred"] != "und":
            assert got["lang_pred"] == langs[int(s.argmax())] or np.sort(s)[-1] - np.sort(s)[-2] < 1e-3
            assert abs(got["score"] - (p / p.sum()).max()) < 5e-3


def test_classifiers_ignore_held_out_labels(spark):
    rows = [(i, "the and of that with this" if i % 2 else "der die und das mit nicht", "en" if i % 2 else "de") for i in range(60)]
    flip = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    model, other = langid.fit(docs(spark, rows)), langid.fit(docs(spark, flip))
    assert model.langs == other.langs == ["de", "en"] and np.array_equal(model.weights, other.weights)
    lab = lambda f: spark.createDataFrame([(i, f(i), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = quality.fit(docs(spark, rows), lab(lambda i: i % 2)), quality.fit(docs(spark, rows), lab(lambda i: 1 - i % 2 if zlib.crc32(str(i).encode()) % 3 == 1 else i % 2))
    assert np.array_equal(a.linear, b.linear) and a.bias == b.bias


def test_classifiers_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    out = langid.predict(d, langid.fit(d)).collect()
    assert len(out) == len(AWKWARD) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    kept = langid.keep(d, langid.fit(d))
    assert kept.schema == d.schema and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    assert {r["lang_pred"] for r in langid.predict(d, langid.fit(empty(spark))).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.predict(d, quality.fit(d, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (5, None, 1), (6, 1, 1), (6, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.predict(d, quality.fit(d, one)).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.keep(d, quality.fit(d, none)).columns == d.columns
    assert langid.predict(empty(spark), None).count() == 0 and quality.predict(empty(spark), quality.fit(d, none)).count() == 0


# --- registration and the pipeline


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    d = spark.read.parquet(DATA + "/documents.parquet")
    labels = spark.read.parquet(DATA + "/labels.parquet")
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sorted(map(tuple, d.select(cols).collect()))
    lang = langid.fit(d)
    one = lang.predict([r[1] or "" for r in rows])
    rows = [r for r, k, s in zip(rows, *one) if k != "und" and s >= langid.REJECT]
    df = spark.createDataFrame(rows, d.select(cols).schema)
    model = quality.fit(df, labels)
    rows = [r for r, s in zip(rows, model.score([r[1] or "" for r in rows])) if s >= 0.5]
    sketch = [None if s is None else s.astype(np.uint8) for s in dartminhash.signatures([dedup.elements(r[1]) for r in rows], dedup.BANDS * dedup.ROWS)]
    keys = [set(dedup.band_keys(s.astype(np.uint64), dedup.BANDS, dedup.ROWS).tolist()) if s is not None else set() for s in sketch]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] == rows[j][1] or keys[i] & keys[j] and (sketch[i] == sketch[j]).mean() >= dedup.SIMILARITY:
            root[max(find(i), find(j))] = min(find(i), find(j))
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    out = corpus_pipeline.run(spark, DATA).collect()
    want = {r[0]: len(r[1].split()) for r in rows}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == want and len(want) < d.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    df = d.select(cols)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, DATA).columns == df.columns


def test_pipeline_stages_take_awkward_rows(spark):
    import corpus_pipeline

    rows = [*AWKWARD, *((100 + i, f"Das ist der Text und noch ein Wort {i}", "de") for i in range(8)), *((200 + i, f"This is the text and one more word {i}", "en") for i in range(8))]
    d = docs(spark, rows).withColumns({"_gone": F.lit(1), "n": F.lit("x"), "quality": F.lit(0), "lang_pred": F.lit("z"), "bucket": F.lit(None).cast("int")})
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        for some in (d, d.where("false"), d.where("text is null"), d.where("doc_id = 5")):
            out = stage(spark, some, DATA)
            assert name == "packing" or out.columns == d.columns
            got.setdefault(name, []).append(out.collect())
        assert got[name][1] == []
    ids = lambda name, k=0: sorted((r["doc_id"] for r in got[name][k]), key=str)
    assert not {1, 2, 3} & set(ids("language")) and {*range(100, 108), *range(200, 208)} <= set(ids("language")) and ids("language", 2) == []
    assert len(got["quality"][2]) in (0, 1) and len(got["quality"][3]) in (0, 2)
    assert ids("near_duplicates").count(5) == 1 and 2 not in ids("near_duplicates") and ids("near_duplicates", 2) == [1] and ids("near_duplicates", 3) == [5] and None in ids("near_duplicates")
    assert [(r["n_tokens"], r["bucket"]) for r in got["packing"][2]] == [(0, None)] and len(got["packing"][3]) == 2


def test_shared_folder_is_the_configured_one(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
