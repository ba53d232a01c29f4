"""The pipeline against plain Python, row by row, and its stages on odd tables."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from skiplens.llm import toxicity
from tests.llm.test_llm import SCHEMA, _corpus, _sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, copies, near copies, repeated ids and rows, long texts and clashing names; labels of the words w1 and w2."""
    root = str(tmp_path_factory.mktemp("odd"))
    rows = _corpus()
    rows += [rows[10], rows[10], (rows[12][0], rows[14][1], *rows[12][2:])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], 0, int(k % 9 == 0)) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def _lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    holders[key(x)].add(i)
    out = []
    for r in rows:
        if r[0] is None or r[1] is None:
            out.append(r if r[1] is None else (*r[:4], len(r[1]), *r[5:]))
            continue
        kept = [x for x in r[1].split("\n") if not (len(h := holders.get(key(x), ())) >= 5 and max(h) != r[0])]
        text = "\n".join(kept)
        out.append((r[0], text, r[2], r[3], len(text), *r[5:]))
    return out


def _groups(rows):
    """Positions by group of linked rows; rows without shingles or id are in none."""
    sets = [_sets(r[1]) if r[0] is not None else set() for r in rows]
    low = list(range(len(rows)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    out = collections.defaultdict(list)
    for k, x in enumerate(sets):
        if x:
            out[root(k)].append(k)
    return out.values()


def _mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    name = [":".join([*([str(r[0])] if r[0] is not None else []), *([str(len(r[1]))] if r[1] is not None else [])]) for r in rows]
    hashes = [int(hashlib.md5(n.encode()).hexdigest()[:15], 16) for n in name]
    of = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        of[r[3]] += n
    names = sorted(of, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, rest = {}, 1.5 * sum(size), set(names)
    while rest and (full := {s for s in rest if left * weight[s] / sum(weight[t] for t in rest) >= 2 * of[s]}):
        target |= {s: 2.0 * of[s] for s in full}
        left -= sum(target[s] for s in full)
        rest -= full
    target |= {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
    out = []
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[3] == s]
        ratio = target[s] / of[s] if of[s] else 0.0
        whole = int(ratio + 1e-12)
        budget, below, cut = max(target[s] - whole * of[s], 0.0), 0, 0
        for h in sorted({hashes[k] for k in mine}):
            here = sum(size[k] for k in mine if hashes[k] == h)
            if below + here > budget:
                cut = h + ((budget - below) * 2 >= here)
                break
            below += here
        out += [rows[k] for k in mine for _ in range(whole + (hashes[k] < cut))]
    return out


def test_run(spark, folder):
    import sentencepiece

    docs = cp.documents(spark, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~cp.held_out(F.col("doc_id"), 4, 2))
    toxic = {(r["doc_id"], r["score"]): r["predicted"] for r in toxicity.score(docs, model).collect()}
    kept = cp.drop_toxic(spark, docs, folder)
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(rows) == sum(r["predicted"] == 0 for r in toxicity.score(docs, model).collect()) and toxic
    lines = cp.drop_lines(spark, kept, folder)
    want = _lines(rows)
    assert lines.columns == docs.columns and collections.Counter(map(tuple, lines.collect())) == collections.Counter(want)
    one = cp.one_of_each(spark, lines, folder)
    got = collections.Counter(map(tuple, one.collect()))
    grouped = {k for g in _groups(want) for k in g}
    for g in _groups(want):
        least = min(want[k][0] for k in g)
        stays = [r for r in {want[k] for k in g} if got[r]]
        assert len(stays) == 1 and got[stays[0]] == 1 and stays[0][0] == least
    assert sum(got.values()) == len(list(_groups(want))) + len(want) - len(grouped)
    mixed = cp.mix(spark, one, folder)
    chosen = _mix([tuple(r) for r in one.collect()])
    assert mixed.columns == docs.columns and collections.Counter(map(tuple, mixed.collect())) == collections.Counter(chosen)
    lib = sentencepiece.SentencePieceProcessor(model_file=cp.sentencepiece_codec.MODEL_PATH)
    ids = [(r[0], lib.encode(r[1] or "")) for r in chosen]
    final = collections.Counter((i, len(x), tuple(x), hashlib.sha256(lib.decode(x).encode()).hexdigest()) for i, x in ids)
    assert collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in cp.run(spark, folder).collect()) == final


def test_empty(spark, folder):
    docs = cp.documents(spark, folder).limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "SentencePiece" or out.columns == docs.columns), name
