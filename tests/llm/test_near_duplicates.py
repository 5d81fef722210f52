import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import components, minhash, rabitq
from tests.llm.conftest import document_rows, some_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def reachable(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def expected_documents(rows):
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    part = reachable(len(rows), links)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        if not sets[i]:
            low = r[0]
        out.append((r[0], len(sets[i]), low, r[0] is not None and r[0] == low))
    return sorted(out, key=repr)


def test_documents_match_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == expected_documents(rows)


def test_near_copies_around_the_threshold(make_docs, monkeypatch):
    """A large group of copies with different edits: links come through some pairs only."""
    rng = np.random.default_rng(3)
    base = some_words(rng, 90).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
            w[k] = f"edit{i}_{k}"
        rows.append((1000 - i, " ".join(w), "en", "a", 1))
    got = sorted((tuple(r) for r in minhash.near_duplicates(make_docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == expected_documents([r[:2] for r in rows])
    assert any(not r[3] for r in got)


def test_blocks_of_an_open_group_miss_no_link(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 8)
    monkeypatch.setattr(minhash, "BAND_BLOCK", 6)
    test_near_copies_around_the_threshold(make_docs, monkeypatch)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 4096)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 500)
    test_near_copies_around_the_threshold(make_docs, monkeypatch)


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_intersections_match_sets(limit):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200)))) for _ in range(40)]
    row, column = np.repeat(np.arange(40), [len(x) for x in sets]), np.concatenate(sets)
    shared = minhash.intersections(row, column, 40, limit)
    for i in range(40):
        assert shared(i, np.arange(40)).tolist() == [len(np.intersect1d(sets[i], x)) for x in sets]


def test_one_document_of_each_group_stays(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r["doc_id"] for r in minhash.near_duplicates(docs).where("kept").collect()}


def test_stage_links_from_its_own_threshold(spark, make_docs):
    """41 shared shingles of a union of 50 (0.82): near-duplicates for the pipeline's stage, not for op10's contract."""
    import corpus_pipeline

    rows = []
    for i in range(30):
        w = [f"t{i}w{k}" for k in range(54)]
        rows += [(2 * i, " ".join(w[:49]), "en", "a", 1), (2 * i + 1, " ".join(w[:45] + [f"new{i}n{k}" for k in range(5)]), "en", "a", 1)]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert (len(a & b), len(a | b)) == (41, 50)
    docs = make_docs(rows)
    assert minhash.near_duplicates(docs).where("not kept").count() == 0
    kept = sorted(r["doc_id"] for r in corpus_pipeline.minhash_stage(spark, docs, "").collect())
    assert kept == [2 * i for i in range(30)]


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100)])
def test_bands_miss_hardly_a_pair_at_the_threshold(threshold):
    bands, rows = minhash.layout(threshold)
    assert bands * rows <= minhash.PERMS and (1 - (threshold[0] / threshold[1]) ** rows) ** bands < 1e-6


def test_empty_tables(empty, spark):
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.keep_one(empty).collect() == []
    assert rabitq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_estimates_and_forest():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 600, dtype=np.uint64)
    same = []
    for _ in range(60):
        cut = int(rng.integers(300, 600))
        one, two = np.unique(a), np.unique(np.concatenate([a[:cut], rng.integers(0, 2**64, 600 - cut, dtype=np.uint64)]))
        j = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        s = [np.frombuffer(minhash.pack(minhash.minima(x)), np.uint64) for x in (one, two)]
        same.append(float(minhash.estimate(s[0], s[1][None])[0]) - j)
    assert abs(np.mean(same)) < 0.03
    sig = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)
    sig[20:30] = sig[5]
    x, y = minhash.forest(sig, 0.8)
    part = components.roots(x, y, 40)
    assert (part[20:30] == part[5]).all()


def test_estimates_of_small_sets_stay_above_the_floor():
    """Pairs of 6 against 7 shingles (0.857): the kept bits of different minima are independent, so none falls below the floor."""
    rng = np.random.default_rng(11)
    floor, low, spread = minhash.floor_of(minhash.THRESHOLD), 1.0, []
    for _ in range(4000):
        x = rng.integers(0, 2**64, 7, dtype=np.uint64)
        s = [np.frombuffer(minhash.pack(minhash.minima(np.sort(y))), np.uint64) for y in (x, x[:6])]
        spread.append(float(minhash.estimate(s[0], s[1][None])[0]))
        low = min(low, spread[-1])
    match = 6 / 7 + 1 / 28
    assert low >= floor
    assert np.std(spread) < 1.1 * np.sqrt(match * (1 - match) / minhash.PERMS) / 0.75


def test_components_of_chains_and_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(300, 300), (7, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {i: i // 50 * 50 for i in range(200)}
    for limit in (500_000, 20):
        monkeypatch.setattr(components, "ONE_TASK_EDGES", limit)
        got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
        assert {k: v for k, v in got.items() if k < 200} == want


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((120, 16))
    x[20:40] = x[3] + 0.12 * rng.standard_normal((20, 16))
    x[40:44] = x[9]
    x[44] = 3 * x[9]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] * 16)]
    return rows + [rows[41], (None, rows[9][1])]


def expected_vectors(rows):
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links.append((i, j))
    part = reachable(len(rows), links)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((r[0], sum(i in x for x in links), low, r[0] is not None and r[0] == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 8])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cls", "label", "key", "size", "code")})
    got = sorted((tuple(r) for r in rabitq.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert got == expected_vectors(rows)


@pytest.mark.parametrize("classes", [1000, 100_000, 1_000_000])
def test_tables_miss_hardly_a_pair_at_the_threshold(classes):
    bits, tables = rabitq.plan(classes)
    assert (1 - (1 - np.arccos(rabitq.THRESHOLD) / np.pi) ** bits) ** tables <= 1e-6


@pytest.mark.parametrize("dim", [64, 100])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(5)
    a = rabitq.unit(rng.standard_normal((400, dim)))
    b = rabitq.unit(0.92 * a + np.sqrt(1 - 0.92**2) * rabitq.unit(rng.standard_normal((400, dim))))
    turn = rabitq.rotation(dim, 0)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    code, factor, _, _ = rabitq.encode(a)
    _, _, planes, scale = rabitq.encode(b)
    above = np.diagonal(rabitq.upper_bounds(dim, code, factor, planes, scale)) - (a * b).sum(axis=1)
    room = (rabitq.EPS * np.sqrt((1 - factor**2) / (dim - 1)) + rabitq.ROUNDING / np.sqrt(12) * scale[:, 1]) / factor
    assert (above >= 0).all() and abs((above - room).mean()) < 0.01
    packed = rabitq._unpacked(rabitq._packed(a), dim)
    for x, y in zip(packed, rabitq.encode(a), strict=True):
        assert np.allclose(x, y, rtol=1e-6)
    # most pairs that have nothing to do with each other are ruled out
    assert (rabitq.upper_bounds(dim, code, factor, planes, scale) >= 0.9).mean() < 0.004
