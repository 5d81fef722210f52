import collections
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import mixing, packing, topk
from tests.llm.conftest import some_words


def expected_top(rows, every=50, k=5):
    use = [(i, np.floor(256 * np.array(v, dtype=float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    dim = max((len(v) for _, v in use), default=0)
    use = [(i, np.concatenate([v, np.zeros(dim - len(v))])) for i, v in use]
    out = []
    for q, x in {i: v for i, v in reversed(use)}.items():
        if q % every == 0:
            found = sorted(((-int(x @ v), i) for i, v in use if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("lengths", ["one", "many"])
def test_top_products_match_brute_force(spark, monkeypatch, lengths):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk, "SEEDS", 20)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8))
    if lengths == "many":
        x *= rng.lognormal(0, 1.5, (400, 1))
        x[100:140] = x[50] * rng.uniform(0.5, 1, (40, 1)) + 0.01 * rng.standard_normal((40, 8))
    x[300:310] = x[20]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(450, None), (500, [None] * 8), (550, [float("nan")] * 8), (None, [1.0] * 8), (600, [0.0] * 8), (650, [0.5, 0.25]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("rank", "score", "bucket", "block", "norm")})
    got = sorted(tuple(r) for r in topk.top_products(df.repartition(3)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == expected_top(rows)


def test_blocks_hold_queries_of_about_as_many_buckets():
    first, many, most = topk.blocks({7: 5, 6: 1, 5: 30, 2: 3, 0: 1}, 7, 10)
    assert (first[7], first[6], first[5], first[2], first[0]) == (0, 0, 0, 4, 4)
    assert many[7] == 4 and most == [7, 7, 7, 7, 4]
    assert topk.blocks({}, 0) == ([0], [1], [0])


def test_top_products_of_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_products(make([])).collect() == []
    assert topk.top_products(make([(0, [1.0])])).collect() == []
    assert [tuple(r) for r in topk.top_products(make([(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1, 1, 131072)]


@pytest.mark.parametrize("copies", [2, 7])
def test_rows_of_the_query_take_no_place_of_candidates(spark, copies):
    """A queried vec_id that repeats: its own rows have the highest products, and k others are found all the same."""
    rows = [(0, [10.0, 0.0])] * copies + [(i, [1.0 + i / 64, 1.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_products(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, n, 40 - n, 2560 * (256 + 4 * (40 - n))) for n in range(1, 6)]


@pytest.mark.parametrize("copies", [2, 7])
def test_search_finds_k_others_of_a_step(copies):
    rng = np.random.default_rng(7)
    v = np.floor(rng.standard_normal((200, 8)) * 256)
    q = v[:1] * 3
    v, ids = np.concatenate([np.repeat(q, copies, axis=0), v]), np.concatenate([np.zeros(copies, int), np.arange(1, 201)])
    order = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
    v, ids = v[order], ids[order]
    _, at, score = topk.search(np.zeros(1, int), q, np.full(1, -np.inf), ids, v, 5)
    best = np.sort((v @ q[0])[ids != 0])[::-1][:5]
    assert sorted(score, reverse=True) == best.tolist() and 0 not in ids[at]


def test_huge_components_are_exact(spark):
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])
    assert topk.products(q, v)[0] == 2**60 + 3 and float(2**60 + 3) != 2**60 + 3
    # scores of 2**60 + 3, 2**60 + 5 and a tie, whose doubles are all the same, among others
    x = 2.0**-8
    rows = [(0, [2.0**40 * x, x]), (1, [2.0**20 * x, 3 * x]), (2, [2.0**20 * x, 5 * x]), (3, [2.0**20 * x, 3 * x]), (4, [x, x])]
    rows += [(i, [-x, i * x]) for i in range(5, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_products(df).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2**60 + 5), (0, 2, 1, 2**60 + 3), (0, 3, 3, 2**60 + 3), (0, 4, 4, 2**40 + 1), (0, 5, 29, 29 - 2**40)]


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    x = 2.0**-8
    rows = [(0, [2.0**50 * x, x]), (1, [2.0**40 * x, 3 * x]), (2, [2.0**40 * x, 7 * x]), (3, [-(2.0**40) * x, 0.0]), (4, [1e300, 0.0]), (5, [1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_products(df).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 1, 2**63 - 1), (0, 4, 3, -(2**63))]


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while True:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)


def test_mix_meets_targets(docs):
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = expected_targets(sizes)
    got = mixing.mix(docs, ("source",)).collect()
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(x for x in rows if x[0] is not None) or len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((a, n) for a, _, n in rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    largest = collections.Counter()
    for _, s, n in rows:
        largest[s] = max(largest[s], n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    assert sum(taken.values()) <= sum(sizes.values())


def test_rows_that_are_alike_are_dealt_out(spark, make_docs, monkeypatch):
    """A third of all rows without id and one row many times: the plain queue gives the same words, and texts stay whole."""
    monkeypatch.setattr(mixing, "RUN", 4)
    rows = [(i, f"text number {i} " + "w " * (i % 9), "en", ["a", "b", "c"][i % 3], 1) for i in range(60)]
    rows += [(None, f"no id {i}", "en", "a", 1) for i in range(30)] + [(7, "the same row", "en", "b", 1)] * 30
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len(r[1].split())) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 12 for s, t in expected_targets(sizes).items())
    out = mixing.mixed(docs).collect()
    assert len(out) == sum(r["copies"] for r in got)
    texts = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    assert set(texts) <= {(r[0], r[1], r[3]) for r in rows}
    assert sum(n * len(t[1].split()) for t, n in texts.items()) == sum(r["taken"] for r in got)


def test_mix_is_the_same_again_and_empty_tables_work(docs, empty):
    key = lambda df: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7)))
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_mixed_rows_follow_copies(docs):
    copies = collections.Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == +copies


def test_targets_of_capped_sources(spark):
    sizes = {"a": 10, "b": 10, "c": 1000, None: 5, "Z": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = expected_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def pieces(df):
    found = collections.defaultdict(list)
    for r in df.collect():
        found[r["sequence_id"]].append(r)
    return {k: sorted(v, key=lambda r: r["offset"]) for k, v in found.items()}


def test_pack_gives_every_id_once(docs):
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs, with_ids=True)
    by_doc = collections.defaultdict(list)
    for sequence in pieces(got).values():
        at = 0
        for r in sequence:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
            assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
            by_doc[r["doc_id"]].append(r)
        assert at <= 2048
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r["doc_id"]].append(packing.encode(r["text"] or "").tolist())
    for doc_id, want in texts.items():
        if len(want) == 1:
            found = sorted(by_doc[doc_id], key=lambda r: r["start"])
            assert [x for r in found for x in r["ids"]] == want[0] and all(r["doc_tokens"] == len(want[0]) for r in found)
        assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, want))


def test_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "Hello  world.\n\n\tfoo", "über Straße 漢字 \U0001f600", "a <|endoftext|> b", "x" * 3000, "\x00 \x7f"):
        assert packing.encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def padding(n, length):
    return 0 if n & (n - 1) == 0 else length - n


def brute_cost(pos, penalty, length):
    best = {0: 0}
    for j in range(1, len(pos)):
        found = [best[i] + padding(pos[j] - pos[i], length) + penalty[j] for i in range(j) if i in best and pos[j] - pos[i] <= length]
        if found:
            best[j] = min(found)
    return best[len(pos) - 1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 12, rng.integers(1, 40)))])
        points, penalty = packing.cut_points([pos[1:]], 16)
        penalty = [0, *rng.integers(0, 20, len(points) - 1).tolist()]
        cuts = packing.best_cuts(points, penalty, 16)
        at = {p: i for i, p in enumerate(points)}
        assert cuts[0] == 0 and cuts[-1] == points[-1] and max(np.diff(cuts)) <= 16
        assert sum(padding(b - a, 16) + penalty[at[b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == brute_cost(points, penalty, 16)


def test_windows_of_a_power_of_two_need_no_padding():
    assert packing.best_cuts([0, 1024, 2000, 3072], [0, 0, 0, 0]) == [0, 1024, 3072]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_ids_of_real_texts_are_the_tokenizers():
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (text,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        assert packing.encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_padding_is_small_and_empty_tables_work(make_docs, empty):
    rng = np.random.default_rng(8)
    rows = [(i, ". ".join(some_words(rng, 9) for _ in range(int(rng.integers(1, 40)))), "en", "a", 1) for i in range(400)]
    got = pieces(packing.pack(make_docs(rows).coalesce(1)))
    length = [sum(r["length"] for r in s) for s in got.values()]
    assert sum(padding(n, 2048) for n in length[:-1]) / sum(length) < 0.03
    assert packing.pack(empty).collect() == []
