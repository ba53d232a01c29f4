"""The training-data operators: edge cases for all, and brute force, round trips or accuracy for each."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skiplens.llm import common, components, embed_dedup, jpeg, langid, line_dedup, media, mixing, ngram_join, quality, sentencepiece_codec, suffix_dedup, toxicity
from skiplens.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, key string, id long, hash long, row string, n_lines long"
_WORDS = [f"w{k}" for k in range(60)]


def _text(rng, n):
    return " ".join(rng.choice(_WORDS) for _ in range(n))


def _corpus():
    """Nulls, empty and long texts, copies, near copies, shared passages and lines, repeated rows and ids."""
    rng = random.Random(5)
    base = [_text(rng, 80) for _ in range(12)]
    texts = [None, "", "   \n\n", "one", "One  TWO", "one two", "é" * 60, "a" * 300, "a" * 300, *base, base[0], base[0], base[0].replace("w1 ", "X "), base[1] + " tail", base[2][:200] + _text(rng, 60), _text(rng, 40) + base[2][100:260]]
    line = "This Line is long enough to be counted as a line of many documents"
    texts += [f"{_text(rng, 5)}\n \t{line}\n{line.upper()}\n{k}" for k in range(7)]
    texts += [" ".join(base[3].split()[k:] + [f"z{k}"] * (k % 3)) for k in range(6)]
    texts.append(" ".join(_text(rng, 50) for _ in range(200)))
    rows = [(k * 3 + 7, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "s3")[k % 4], 1) for k, t in enumerate(texts)]
    rows += [rows[9], rows[10], (rows[12][0], base[5], "en", "s1", 1), (None, base[0], "en", "s1", None)]
    return [(*r, 3, 0.5, "k", 9, 8, "r", 4) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], k % 2, (k // 2) % 2) for k, r in enumerate(_corpus())] + [(None, 1, 1), (7, None, None), (999_999, 1, 0)], "doc_id long, quality int, toxic int")


def _all(docs, labels, vocab):
    return {
        1: langid.identify(docs), 2: line_dedup.digest(line_dedup.dedup_lines(docs)), 3: ngram_join.similar_documents(docs), 4: toxicity.detect(docs, labels),
        5: media.digest(media.store_media(docs)), 7: quality.classify(docs, labels), 8: sentencepiece_codec.digest(docs, vocab), 9: mixing.mix_sources(docs), 10: suffix_dedup.digest(suffix_dedup.remove_repeats(docs)),
    }


def test_edges(spark, docs, labels):
    """A row for each row, whatever it holds; an empty table gives an empty result."""
    vocab = sentencepiece_codec.Vocabulary.load()
    n = docs.count()
    for k, df in _all(docs, labels, vocab).items():
        rows = df.collect()
        assert len(rows) == n, k
        for r in rows:
            if "score" in df.columns:
                assert 0 <= r["score"] <= 1, k
    none = docs.limit(0)
    for k, df in _all(none, labels.limit(0), vocab).items():
        assert df.count() == 0, k


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_ngram_join(docs):
    rows = [(r["doc_id"], _sets(r["text"])) for r in docs.collect()]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    repeated = {i for i, c in collections.Counter(i for i, _ in rows).items() if c > 1}
    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                parent[b_] = a_
    got = ngram_join.similar_documents(docs).collect()
    want = collections.Counter((i, len(s)) for i, s in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == want
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] not in repeated:
            assert r["component_id"] == root(r["doc_id"])
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("hubs", [0, 1])
def test_ngram_join_of_large_groups(spark, monkeypatch, hubs):
    """Chains and clusters in one group that is split into many blocks, against all pairs."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 9)
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(words[2 * i : 2 * i + 60]) for i in range(110) if i not in (40, 41, 42, 43, 44)]
    for _ in range(60):
        x = words[:60]
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(60)] = rng.choice("abcdef")
        texts.append(" ".join(x))
    sets = [_sets(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    name = dict(zip(*(v.tolist() for v in components.forest(np.array([i for i, _ in links]), np.array([j for _, j in links]))), strict=True))
    assert len({name.get(i, i) for i in range(len(sets))}) > 2
    got = ngram_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: name.get(i, i) for i in range(len(sets))}


def _stages(spark, group, run):
    """What run() returns, and the number of stages that its jobs have."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    return out, len({k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds})


@pytest.mark.parametrize("local", [1_000_000, 20])
def test_connected_components(spark, monkeypatch, local):
    """A chain, a star and pairs, by one task and by rounds; nulls, loops and repeated links change nothing, few links take few stages."""
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    rng = random.Random(3)
    ids = rng.sample(range(-(10**12), 10**12), 300)
    links = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[100], ids[i]) for i in range(101, 200)] + [(ids[i], ids[i + 1]) for i in range(200, 280, 2)]
    links = [x[:: rng.choice((1, -1))] for x in rng.sample(links, len(links))]
    want = dict(zip(*(v.tolist() for v in components.forest(*np.array(links).T)), strict=True))
    want |= {v: v for v in want.values()}
    assert len(set(want.values())) == 42
    rows = links + [(None, ids[0]), (ids[290], None), (None, None), (ids[291], ids[291]), links[0], links[1][::-1]]
    got, stages = _stages(spark, f"components {local}", lambda: components.connected_components(spark.createDataFrame(rows, "a long, b long").repartition(7)).collect())
    assert len(got) == len(want) and {r["vertex"]: r["component"] for r in got} == want
    assert stages <= 8 or local < len(links)
    assert components.connected_components(spark.createDataFrame(rows[-6:-2], "a long, b long")).collect() == []


def test_links_of_a_task_are_merged_in_parts(monkeypatch):
    monkeypatch.setattr(components, "LOCAL_LINKS", 30)
    rng = np.random.default_rng(2)
    links = rng.integers(0, 120, (100, 2))
    parts = list(components._local(pa.RecordBatch.from_arrays([pa.array(x) for x in part.T.copy()], names=["u", "v"]) for part in np.split(links, [0, 13, 55, 60, 90])))
    assert len(parts) == 3
    (got,) = components._stars(iter(parts))
    vertex, low = components.forest(*links.T)
    assert dict(zip(got["vertex"].to_pylist(), got["component"].to_pylist(), strict=True)) == dict(zip(vertex.tolist(), low.tolist(), strict=True)) | {x: x for x in low.tolist()}


@pytest.mark.parametrize("chain", [0, 30])
def test_ngram_join_of_large_groups_takes_few_stages(spark, monkeypatch, chain):
    """A large group with and without rows that its blocks leave outside its largest component."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 9)
    monkeypatch.setattr(ngram_join, "HUBS", 100 if not chain else 1)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*words[:60], f"end{i}"]) for i in range(40)] + [" ".join(words[60 + 2 * i : 120 + 2 * i]) for i in range(chain)]
    ran = []
    monkeypatch.setattr(ngram_join, "_remaining", lambda *a, f=ngram_join._remaining: ran.append(f(*a)) or ran[-1])
    got, stages = _stages(spark, f"large groups {chain}", lambda: ngram_join.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect())
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 40 else 40 for i in range(len(texts))}
    assert len(ran) == 1 and (ran[0] is None) == (not chain)
    assert stages <= 100


def test_group_links_are_complete():
    """Spanning links against all pairs, on chains and clusters."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = np.sort(rng.choice(10_000, 40, replace=False))
        sets = [np.unique(np.concatenate([base[rng.random(40) < 0.9], rng.choice(10_000, rng.integers(0, 6))])).astype(np.uint64) for _ in range(25)]
        n = np.array([len(s) for s in sets])
        links = [(i, j) for i in range(25) for j in range(i) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (n[i] + n[j] - o)]
        a, b = ngram_join.link_group(sets, n, 75)
        name = lambda x, y: dict(zip(*(v.tolist() for v in components.forest(np.array(x, np.int64), np.array(y, np.int64))), strict=True))
        assert name([i for i, _ in links], [j for _, j in links]) == name(a, b)


def test_suffix_dedup(docs):
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, b in rows:
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want = collections.Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_suffix_dedup_hot_anchor(spark, docs, monkeypatch):
    """One passage in many different surroundings: the same result by the route for hot anchors."""
    rng = random.Random(8)
    passage = _text(rng, 30)
    many = spark.createDataFrame([(k, f"{_text(rng, 12)} {passage} {_text(rng, 12)}") for k in range(150)], "doc_id long, text string").coalesce(2)
    plain = {tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(many)).collect()}
    monkeypatch.setattr(suffix_dedup, "TASK_CONTEXTS", 10**9)
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", 10**9)
    assert {tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(many)).collect()} == plain
    assert sum(r[2] > 100 for r in plain) == 149


def test_merge_sort():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 600)
    seg = np.sort(rng.integers(0, 5, 500))
    at = rng.integers(0, 550, 500)
    from skiplens.llm.common import prefix_hash

    order = suffix_dedup.merge_sort(data, prefix_hash(data), at, seg, 50)
    keys = [(int(s), data[a : a + 50].tobytes()) for s, a in zip(seg[order], at[order], strict=True)]
    assert keys == sorted(keys) and sorted(order) == list(range(500))


def test_line_dedup(docs):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    lined = sorted(i for i, r in ((r["doc_id"], r) for r in docs.collect()) if r["text"] and "\n \tThis" in r["text"])
    assert [out[i]["n_dropped"] for i in lined] == [2] * 6 + [0]
    assert "This Line" not in out[lined[0]]["text"]


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= share
    taken = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in rows if r["source"] == s) * 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mixed_rows(docs).count() == sum(r["copies"] for r in rows)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 64))
    near = base[:300] / np.linalg.norm(base[:300], axis=1, keepdims=True)
    noise = rng.normal(size=near.shape)
    noise -= (noise * near).sum(axis=1, keepdims=True) * near
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.88, 1.0, (300, 1))
    x = np.concatenate([base, cos * near + np.sqrt(1 - cos * cos) * noise, base[:40]]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] + [1.0] * 63, 1), (5003, [None] * 64, 1), (5004, [1.0, 2.0], 1), (None, x[0].tolist(), 1), (5005, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    u = embed_dedup.unit_rows(x)
    truth = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (found <= truth).all() and found.sum() >= 0.9 * truth.sum()
    for k, _, _ in odd:
        assert got[k]["n_links"] == 0 and got[k]["component_id"] == k
    low = np.arange(len(x))
    while True:
        new = np.array([low[row].min() for row in u @ u.T >= 0.9])
        if (new == low).all():
            break
        low = new
    assert [got[k]["component_id"] for k in range(len(x))] == low.tolist() and all(got[k]["kept"] == (low[k] == k) for k in range(len(x)))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_blocks(spark, monkeypatch):
    """Cells split into blocks give the same links."""
    rng = np.random.default_rng(6)
    c = rng.normal(size=(4, 16))
    x = np.repeat(c, 30, axis=0) + rng.normal(size=(120, 16)) * 0.25
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 20)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df, margin=2.0).collect())) == want
    u = embed_dedup.unit_rows(x.astype(np.float32))
    assert [r[1] for r in want] == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()


def test_embeddings_recall_of_two_levels(spark, monkeypatch):
    """Queries are the ids divisible by 20; small cells in two levels, doubles that floats can't hold, repeated ids."""
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 25)
    monkeypatch.setattr(embed_dedup, "MAX_TOP", 12)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 48))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 1.0, (1500, 1))
    x = np.concatenate([base, cos * unit + np.sqrt(1 - cos * cos) * noise]) * 1e60
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df).collect()}
    u = embed_dedup.unit_rows(x)
    truth = (u @ u.T >= 0.9).sum(axis=1) - 1
    q = np.arange(0, len(x), 20)
    found = np.array([got[k] for k in q.tolist()])
    assert (found <= truth[q]).all() and found.sum() >= 0.9 * truth[q].sum()
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(twice).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_jpeg_round_trip():
    for n in (0, 1, 64, 65, 5000):
        p = media.padded(os.urandom(n))
        raw = jpeg.write_dense(media.to_image(p))
        assert media.from_image(jpeg.read(raw)) == p and len(p) % 64 == 0 and len(p) > 0


def _general(img, restart=0):
    """A plain progressive encoder with runs, zeros, new coefficients in refinements, and restarts."""
    out = [b"\xff\xd8", jpeg._segment(jpeg.DQT, bytes([0]) + bytes([2] * 64))]
    comps = img.components
    out.append(jpeg._segment(jpeg.SOF2, bytes([8]) + img.height.to_bytes(2, "big") + img.width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([c.ident, c.h << 4 | c.v, 0]) for c in comps)))
    dc = jpeg.Huffman.of({s: 4 for s in range(12)})
    ac = jpeg.Huffman.of({r << 4 | s: 8 for r in range(16) for s in range(11) if (r, s) != (14, 0)})
    out += [jpeg._segment(jpeg.DHT, bytes([0]) + dc.segment), jpeg._segment(jpeg.DHT, bytes([16]) + ac.segment)]
    if restart:
        out.append(jpeg._segment(jpeg.DRI, restart.to_bytes(2, "big")))
    across, down = img.layout()

    def put(bits, value, n):
        bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def code(bits, table, s):
        put(bits, *table.code[s])

    def signed(bits, v, s):
        put(bits, v if v > 0 else v + (1 << s) - 1, s)

    def close(parts):
        return b"".join(jpeg.pack_bits(np.array(b)).replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, b in enumerate(parts))

    orders = [jpeg._order(c, across, down, len(comps) == 1).reshape(across * down, -1) for c in comps]
    for before in (0, 1):
        parts = []
        for u in range(across * down):
            if not parts or restart and u % restart == 0:
                parts.append([])
                last = [0] * len(comps)
            for k, c in enumerate(comps):
                for b in orders[k][u]:
                    v = int(c.coef[b, 0])
                    if before:
                        parts[-1].append(v & 1)
                        continue
                    d = (v >> 1) - last[k]
                    last[k] = v >> 1
                    code(parts[-1], dc, s := abs(d).bit_length())
                    if s:
                        signed(parts[-1], d, s)
        out.append(jpeg._segment(jpeg.SOS, bytes([len(comps)]) + b"".join(bytes([c.ident, 0]) for c in comps) + bytes([0, 0, before << 4 | (0 if before else 1)])) + close(parts))
    for before in (0, 1):
        for c in comps:
            parts = []
            for u, b in enumerate(jpeg._order(c, across, down, True)):
                if not parts or restart and u % restart == 0:
                    parts.append([])
                x, bits = c.coef[b].astype(int), parts[-1]
                high = np.sign(x) * (np.abs(x) >> 1)
                run, pending = 0, []
                live = [k for k in range(1, 64) if (high[k] if not before else x[k] and not high[k])]
                for k in range(1, (live[-1] if live else 0) + 1):
                    if before and high[k]:
                        pending.append(abs(x[k]) & 1)
                    elif k in live:
                        s = abs(high[k]).item().bit_length() if not before else 1
                        code(bits, ac, run << 4 | s)
                        signed(bits, int(high[k]) if not before else int(x[k]), s)
                        bits += pending
                        run, pending = 0, []
                    else:
                        run += 1
                        if run == 16:
                            code(bits, ac, 15 << 4)
                            bits += pending
                            run, pending = 0, []
                if not live or live[-1] < 63:
                    code(bits, ac, 0)
                    bits += pending + [abs(x[k]) & 1 for k in range((live[-1] if live else 0) + 1, 64) if before and high[k]]
            out.append(jpeg._segment(jpeg.SOS, bytes([1, c.ident, 0, 1, 63, before << 4 | (0 if before else 1)])) + close(parts))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_general_files(restart):
    rng = np.random.default_rng(restart)
    comps = [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)]
    img = jpeg.Image(37, 21, comps, {0: np.full(64, 2)})
    img.layout()
    for c in comps:
        c.coef = (rng.integers(-40, 40, (c.wide * c.high, 64)) * (rng.random((c.wide * c.high, 64)) < 0.15)).astype(np.int16)
        seen = np.zeros((c.high, c.wide), bool)
        seen[: c.seen_high, : c.seen_wide] = True
        c.coef[~seen.ravel(), 1:] = 0  # such blocks are in no scan of one component
    got = jpeg.read(_general(img, restart))
    for a, b in zip(got.components, comps, strict=True):
        assert np.array_equal(a.coef, b.coef)
    tensor = jpeg.decode(_general(img, restart))
    assert tensor.shape == (21, 37, 3)
    flat = jpeg.inverse(np.eye(1, 64, dtype=np.int16) * 80, np.full(64, 2))
    assert (flat == 148).all()


def test_sentencepiece_matches_the_library():
    import sentencepiece

    c = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load())
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc deTion  \n\t▁é你好🙂\0́ß.,!?019") for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["", " ", "x" * 300, " " * 40]
    ids = c.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert [c.decode(x) for x in ids] == [lib.decode(x.tolist()) for x in ids]


def test_sentencepiece_many_characters_and_little_memory():
    """More characters than a byte numbers, texts of no known character, and a memory that is soon full."""
    import sentencepiece

    c = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load())
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    assert [x.tolist() for x in c.encode(["\n", "\n\n", "\ue000"])] == lib.encode(["\n", "\n\n", "\ue000"])
    c.batch = 400
    rng = random.Random(3)
    known = [chr(i) for i in range(0x21, 0x2500) if c.matcher.char[i]]
    assert len(known) > 300
    words = ["international", "responsibilities", "²", "²..", "12²3", "x_1", "__", "Straße", "наука", "don't"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", rng.choice(known), "".join(rng.choices(known, k=5))]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for k in range(0, 300, 25):
        part = texts[k : k + 25] + texts[:5]
        ids = c.encode(part)
        assert [x.tolist() for x in ids] == lib.encode(part)
        assert [c.decode(x) for x in ids] == [lib.decode(x.tolist()) for x in ids]


def test_sentencepiece_unigram():
    """The best path of a small unigram vocabulary, against all segmentations."""
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"a", "▁"})
    pieces = [p for p in pieces if not re.search("[^▁]▁", p)]
    score = {p: -rng.random() * 5 - 1 for p in pieces}
    v = sentencepiece_codec.Vocabulary(sentencepiece_codec.UNIGRAM, [(k + 1, p, score[p]) for k, p in enumerate(pieces)], [], 0, [b""] + [p.encode() for p in pieces])
    m = sentencepiece_codec.Matcher(v)
    low = min(score.values()) - 10

    def best(w):
        t = [0.0] + [-1e18] * len(w)
        for e in range(1, len(w) + 1):
            t[e] = max([t[s] + score[w[s:e]] for s in range(e) if w[s:e] in score] + ([t[e - 1] + low] if w[e - 1] not in score else []))
        return t[-1]

    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    for w, ids in zip(words, m.segment(words), strict=True):
        assert sum(score[pieces[i - 1]] if i else low for i in ids) == pytest.approx(best(w))


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_accuracy(spark, small):
    """Held-out rows of the small tables."""
    lang = q.op1_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    truth = spark.read.parquet(f"{small}/labels.parquet")
    for f, label in ((q.op4_toxicity, "toxic"), (q.op7_quality, "quality")):
        r = f(spark, small).join(truth, "doc_id").where("held_out")
        assert r.agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0] > 0.95


@pytest.mark.parametrize("long_labels", [False, True])
def test_toxicity_of_long_texts(spark, long_labels):
    """Clean texts of megabytes are kept and one toxic sentence in them is found, also where all labelled documents are long."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    sentence = lambda bad=False: " ".join([*rng.choices(words, k=6), *(["vileword", "filth"] if bad else []), *rng.choices(words, k=3)]) + "."
    n, size = (60, 1_100) if long_labels else (400, 30)
    body = [[sentence(bad=k % 5 == 0 and i == size // 2) for i in range(size)] for k in range(n)]
    docs = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(body)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(n)], "doc_id long, toxic int")
    assert not long_labels or docs.where("length(text) <= 60000").count() == 0
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).join(labels, "doc_id").where("predicted <> toxic").count() == 0
    long = [sentence() for _ in range(100_000)]
    texts = {0: long[:50_000], 1: [*long[:20_000], sentence(True), *long[20_000:50_000]], 2: long, 3: [sentence(True), *long]}
    big = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert big.agg(F.min(F.length("text"))).first()[0] > 3_000_000
    got = {r["doc_id"]: (r["predicted"], len(r["offending"])) for r in toxicity.score(big, model).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (0, 0), 3: (1, 1)}
    assert {r["doc_id"] for r in toxicity.drop_toxic(big, model).select("doc_id").collect()} == {0, 2}
    few = toxicity.fit(docs, labels, size=docs.agg(F.sum(F.octet_length("text"))).first()[0] // 2)
    assert len(few.hashes)  # fewer documents, not only shorter ones


def _parse(t, sample):
    n = k = 0
    while k < len(t):
        e = k + 1
        while e <= len(t) and t[k:e] in sample:
            e += 1
        k, n = max(e - 1, k + 1), n + 1
    return n


@pytest.mark.parametrize(("piece", "pieces"), [(512, 4096), (16, 3), (7, 1)])
def test_langid_phrases(monkeypatch, piece, pieces):
    """The lockstep parse, over any pieces, against a plain greedy one of whole texts."""
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "PIECES", pieces)
    rng = random.Random(3)
    samples = ["".join(rng.choice("abc ") for _ in range(n)).encode() for n in (300, 900)]
    a = langid.Automata(samples)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.choice((0, 1, 16, 32, rng.randint(0, 1500))))).encode() for _ in range(30)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = a.phrases(np.frombuffer(b"".join(texts), np.uint8), starts)
    assert [g.tolist() for g in got] == [[_parse(t, s) for t in texts] for s in samples]


def test_langid_query(docs):
    """op1 in plain Python, given the training passages."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    assert sorted(model) == ["de", "en"] and all(len(v) <= langid.TRAIN_BYTES for v in model.values())
    texts = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = collections.Counter()
    for (i, t), n in texts.items():
        t = t or ""
        raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", t.lower().encode())
        bits = {k: _parse(raw, v) * np.log2(max(2, len(v))) for k, v in sorted(model.items())}
        want[i, min(bits, key=bits.get) if any(c.isalpha() for c in t) else "und"] += n
    assert collections.Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).collect()) == want


def test_toxicity_query(docs, labels):
    """op4 in plain Python, given the weights of the features."""
    from skiplens.llm.common import TextSlice

    fold = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, labels, ~fold)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def of_word(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return sum(weight.get(int(h), 0.0) for h in toxicity.features(TextSlice(None, 0, raw, np.array([0, len(raw)])))[1])

    cache = {}
    for r in docs.select("doc_id", "text").distinct().collect():
        clean = 1.0
        for sentence in re.split("[.!?\n]", (r["text"] or "").lower()):
            z = model.bias + sum(cache.setdefault(w, of_word(w)) for w in re.findall("[0-9a-z\x80-\U0010ffff]+", sentence))
            clean *= min(1.0, (1 + np.exp(model.bias)) / (1 + np.exp(z)))
        cache[r["doc_id"], r["text"]] = 1 - clean
    got = toxicity.score(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("text").alias("text")).where("n = 1"), "doc_id").collect()
    assert len(got) > 30
    for r in got:
        assert r["score"] == pytest.approx(cache[r["doc_id"], r["text"]], abs=1e-9)


def test_labelled_rows_are_bounded(spark):
    """Many rows of one labelled id are one training document, and training sees no other rows of it."""
    from skiplens.llm.labelled import labelled_sample

    many = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    lab = spark.createDataFrame([(5, 1), (5, 0), (6, 1)], "doc_id long, toxic int")
    rows = labelled_sample(many, lab, "toxic", F.lit(True), 100, "x").collect()
    assert len(rows) == 1 and rows[0]["label"] == 1


def test_quality_query(docs, labels):
    """op7's scores against densities from plain linear algebra."""
    x, y = np.random.default_rng(3).normal(size=(300, len(quality.FEATURES))), np.arange(300) % 3 > 0
    x[y] *= 1.5
    m = quality.train(x, y.astype(int))
    z = np.clip((x - m.centre) / m.scale, -8, 8)
    logp = []
    for k in (0, 1):
        cov = np.linalg.inv(m.inverse[k].T @ m.inverse[k])
        d = z - m.mean[k]
        logp.append(m.prior[k] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -60, 60))))
    rows = quality.classify(docs, labels).collect()
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_media_query(docs):
    """op5's columns against hashlib and zlib, and its tensors against a decoder of the whole file."""
    import zlib

    want = collections.Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        p = media.padded(raw)
        img = jpeg.write_dense(media.to_image(p))
        rgb = jpeg.decode(img)
        want[r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(img), hashlib.sha256(img).hexdigest(), rgb.size, hashlib.sha256(rgb.tobytes()).hexdigest()] += 1
    got = media.digest(media.store_media(docs)).drop("feature").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_sentencepiece_query(docs):
    """op8 against the library, and one long run of letters."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    want = collections.Counter()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, sentencepiece_codec.digest(docs, sentencepiece_codec.Vocabulary.load()).collect())) == want
    rng = random.Random(4)
    c = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load())
    for t in ("".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "a" * 50_000):
        assert c.encode([t])[0].tolist() == lib.encode(t)


def test_line_dedup_long_text(spark):
    """A text of 400,000 equal lines, twice, and one of as many different lines."""
    line = "This line is certainly longer than forty characters, it is."
    rows = [(0, "\n".join([line] * 400_000))] * 2 + [(1, "\n".join(f"{line}{i}" for i in range(400_000)))] + [(k, line + "\nx") for k in range(5, 11)] + [(20, None), (21, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.length("text")).collect()
    want = [(0, 400_000, 400_000, 0)] * 2 + [(1, 400_000, 0, len(rows[2][1]))] + [(k, 2, 1, 1) for k in range(5, 10)] + [(10, 2, 0, len(line) + 2), (20, 1, 0, None), (21, 1, 0, 0)]
    assert sorted(map(tuple, got)) == want


def _in_process(rows, bits=6):
    """The stages of suffix dedup without Spark: {document: bytes kept}."""

    def dealt(batches):
        out = collections.defaultdict(list)
        for b in batches:
            for k, n in zip(b["key"].to_pylist(), range(b.num_rows), strict=True):
                out[k].append(pa.Table.from_batches([b]).slice(n, 1))
        return [pa.concat_tables(x) for x in out.values()]

    def batch(**more):
        base = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.binary()), "tag": pa.array(range(len(rows)), pa.int64())}
        return pa.RecordBatch.from_pydict(base | {k: pa.array([v.get(i) for i, _ in rows], pa.binary()) for k, v in more.items()})

    def told(tables, column):
        return {i: x for t in map(suffix_dedup._answers, tables) for i, x in zip(t["id"].to_pylist(), t[column].to_pylist(), strict=True) if x}

    one = [b for k in range(2) for b in suffix_dedup._deal(bits)(iter([batch().slice(k * len(rows) // 2, len(rows) // 2 + 1 if k else len(rows) // 2)]))]
    met = dealt(b for t in dealt(one) for b in suffix_dedup._meet(bits)(t).to_batches())
    asked = batch(asked=told(met, "asked"))
    sent = dealt(suffix_dedup._send_contexts(bits)(iter([asked.filter(asked["asked"].is_valid())])))
    more = dealt(b for t in sent for b in suffix_dedup._sort_windows(bits)(t).to_batches())
    done = suffix_dedup._remove(iter([batch(spans=told(met, "spans"), more=told(more, "spans"))]))
    return {i: x for b in done for i, x in zip(b["doc_id"].to_pylist(), b["kept"].to_pylist(), strict=True)}


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_dedup_collisions(monkeypatch, collide):
    """Hashes of three bits change no result: what goes is decided by bytes."""
    if collide:
        real = suffix_dedup.range_hash
        monkeypatch.setattr(suffix_dedup, "range_hash", lambda *x: real(*x) & np.uint64(7))
    rng = random.Random(6)
    base = [_text(rng, 40) for _ in range(5)]
    texts = [*base, base[0], base[1][20:150] + _text(rng, 8), _text(rng, 10) + base[2][5:90] + base[3][:70], "x" * 130, "x" * 90, base[4] + base[4][:60], *(f"{_text(rng, 3)} {base[0][30:110]} {k}" for k in range(6))]
    rows = [(k, t.encode()) for k, t in enumerate(texts)]
    first, want = {}, {}
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        want[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    assert _in_process(rows) == want and sum(map(len, want.values())) < sum(len(b) for _, b in rows) * 0.8


def test_powers_of_long_slices(monkeypatch):
    """They are made once for all hashes of a slice or group, and not kept after it."""
    monkeypatch.setattr(common, "_POW", {})
    monkeypatch.setattr(common, "KEPT_POWERS", common.SLICE_BYTES // 2)
    n = common.SLICE_BYTES + 100
    data = np.tile(np.arange(50, 57, dtype=np.uint8), n // 7 + 1)[:n]
    prefix = common.prefix_hash(data)
    made = common.powers(n + 1)[0].base
    assert common.range_hash(prefix, np.array([0]), np.array([70])) == common.range_hash(prefix, np.array([n - n % 7 - 70]), np.array([n - n % 7]))
    assert common.powers(n + 1)[0].base is made
    common.give_back()
    assert "long" not in common._POW
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n, "y"]})
    seen = []
    for s in common.text_slices([batch]):
        seen.append("long" in common._POW)
        common.prefix_hash(s.data)
    assert seen == [False, False]
    assert "long" not in common._POW


def test_line_dedup_many_lines(docs, monkeypatch):
    """Totals too many to be broadcast give the same result."""
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    want = sorted(line_dedup.dedup_lines(docs).collect(), key=key)
    monkeypatch.setattr("skiplens.llm.common.FEW_ROWS", 0)
    assert sorted(line_dedup.dedup_lines(docs).collect(), key=key) == want
