import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat, labelled, licenses, quality, substrings, suffixes, toxicity
from tests.llm.conftest import some_words

# ---- repeated passages


def expected_removed(rows):
    texts = [(t or "").encode() for _, t in rows]
    where = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - 199):
            where.setdefault(t[s : s + 200], []).append((i, s))
    covered = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                covered[i][s : s + 200] = True
    out = []
    for (doc_id, _), t, c in zip(rows, texts, covered, strict=True):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        out.append((doc_id, len(t), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,shard", [(4096, 1 << 19), (4096, 300), (3, 300), (1, 1 << 19), (0, 1 << 19)])
def test_removed_bytes_match_brute_force(docs, hot, shard):
    """Hot anchors: from 3, 1 or 0 different pieces on; some parts then have that many different ones too."""
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.removed(docs, hot, shard).collect()), key=repr)
    assert got == expected_removed(rows)
    assert sum(r[2] for r in got) > 1000


def test_passages_in_many_contexts(spark, make_docs):
    """One passage of 260 bytes in 60 contexts, which begin and end alike in part: all levels of a hot anchor."""
    rng = np.random.default_rng(8)
    passage = some_words(rng, 100)[:260]
    rows = [(i, some_words(rng, 40) + "shared start"[: i % 13] + passage + "x" * (i % 7) + some_words(rng, 40), "en", "a", 0) for i in range(60)]
    rows += [(100 + i, passage[30:250] + str(i % 3), "en", "a", 0) for i in range(6)]
    want = expected_removed([r[:2] for r in rows])
    for hot in (4096, 20, 2):
        assert sorted((tuple(r) for r in substrings.removed(make_docs(rows), hot).collect()), key=repr) == want


def test_anchors_do_not_depend_on_steps(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [some_words(rng, int(n)).encode() for n in rng.integers(1, 900, 12)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = substrings.anchors(data, offsets)
    monkeypatch.setattr(substrings, "STEP", 700)
    for one, other in zip(whole[:1], substrings.anchors(data, offsets)[:1], strict=True):
        assert set(one.tolist()) == set(other.tolist())


def test_texts_without_repeats(docs, empty):
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r for r in substrings.removed(docs).collect() if r["doc_id"] is not None}
    for r in out.where("doc_id is not null").collect():
        if r["text"] is not None and r["text"].isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]]["kept_sha256"]
    assert substrings.removed(empty).collect() == [] and substrings.without_repeats(empty).collect() == []


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(150):
        x = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 60)))
        if trial % 5 == 0:
            x = np.tile(x[:4], 8)
        t = np.append(x, 0).tolist()
        sa = suffixes.suffix_array(np.array(t), 8)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffixes.common_prefixes(np.array(t, dtype=np.uint8), sa, np.arange(len(t), 0, -1), 24)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while n < 24 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n


def test_window_minima():
    rng = np.random.default_rng(1)
    for n in (5, 17, 100):
        v = rng.integers(0, 50, n).astype(np.uint64)
        assert substrings.window_minima(v, 5).tolist() == [int(v[i : i + 5].min()) for i in range(n - 4)]


# ---- classifiers


def labelled_tables(spark, make_docs, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(400):
        words = some_words(rng, 60).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            words[10:10] = ["vile", "brute"]
        if i % 3 == 0:
            words[5:5] = ["muslim", "women"] if toxic or rng.random() < 0.6 else ["christian", "men"]
        if junk:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 0 if junk else 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "some text", "en", "a", 9), (902, "word " * 30000, "en", "a", 1), rows[3]]
    labels += [(None, 1, 1), (3, 1, 0), (4, None, None), (950, 1, 1)]
    return make_docs(rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels[:400]}


@pytest.mark.parametrize("module,column", [(quality, 1), (toxicity, 2)])
def test_held_out_accuracy(spark, make_docs, module, column):
    docs, labels, known = labelled_tables(spark, make_docs)
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    import zlib

    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.CUT)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in known and r["doc_id"] != 4:
            right.append(known[r["doc_id"]][column] == r["predicted"])
    assert len(right) > 50 and np.mean(right) > 0.95


def test_samples_are_bounded(spark, make_docs):
    """Ids that repeat give one row each, whatever their number; texts are taken whole up to a number of bytes."""
    rows = [(i % 4, f"text {i}", "en", "a", 6) for i in range(4000)] + [(i, "long " * 50, "en", "a", 250) for i in range(10, 90)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in [*range(4), *range(10, 90)]], "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    assert labelled.sample(docs, labels, "toxic", 10).count() <= 20
    got = labelled.sample(docs, labels, "toxic", 4000, 1000).collect()
    for y in (0, 1):
        assert 0 < sum(len(r["text"]) for r in got if r["y"] == y) <= 1000
    # copies of one row are one example
    again = make_docs(rows + [rows[0]] * 3000)
    held = labelled.fit_in_one_task(labelled.sample(again, labels, "toxic"), toxicity.with_counterfactuals, lambda rows, y, part: len(rows))
    import zlib

    assert held == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in [*range(4), *range(10, 90)])


def test_terms_in_capitals_are_terms():
    texts = ["MÄNNER und Frauen", "m\u00e4nner", "JÜDISCH"]
    assert all(len(x) for x in toxicity.counterfactuals(*_joined(texts)))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_every_score_is_the_same(spark, docs, empty, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in module.classify(docs, none).collect()}) == 1
    assert module.classify(empty, none).collect() == []
    one = spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in module.classify(docs, one).collect()}) == 1


def test_clean_keeps_all_columns(spark, make_docs):
    docs, labels, known = labelled_tables(spark, make_docs)
    out = toxicity.clean(docs, labels)
    assert out.columns == docs.columns
    left = {r["doc_id"] for r in out.collect()}
    assert sum(i in left for i, r in known.items() if r[2] == 1) <= 4 and sum(i not in left for i, r in known.items() if r[2] == 0) <= 4


def test_counterfactuals_hold_identity_terms_back():
    """Terms that go with toxic labels in the sample move the score less with the penalty than without."""
    rng = np.random.default_rng(2)
    term, other = (int(toxicity._named((w,))[0]) for w in ("muslim", "christian"))
    insult = 77
    rows, y = [], []
    for _ in range(600):
        bad = rng.random() < 0.4
        r = set(rng.integers(1000, 1400, 20).tolist())
        if bad:
            r.add(insult)
        if rng.random() < (0.8 if bad else 0.1):
            r.add(term)
        elif rng.random() < 0.3:
            r.add(other)
        rows.append(np.array(sorted(r)))
        y.append(int(bad))
    w, _ = toxicity.fit(rows, np.array(y), np.zeros(len(y)))
    keep, toxicity.PENALTY = toxicity.PENALTY, 0.0
    try:
        free, _ = toxicity.fit(rows, np.array(y), np.zeros(len(y)))
    finally:
        toxicity.PENALTY = keep
    assert w[insult] > 1 and w[term] - w[other] < 0.5 * (free[term] - free[other])


def _joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_counterfactuals_are_features_of_swapped_texts():
    texts = ["Muslim words and womenfolk", "plain words", "", "she saw women and WOMEN"]
    for t, x in zip(texts, toxicity.counterfactuals(*_joined(texts)), strict=True):
        found = {w.lower() for w in t.split()} & {w for g in toxicity.IDENTITY for w in g}
        if not found:
            assert not len(x)
            continue
        wanted = [t.lower()]
        for w in found:
            group = next(g for g in toxicity.IDENTITY if w in g)
            wanted = [" ".join(o if v == w else v for v in s.split()) for s in wanted for o in group if o != w]
        assert any(np.array_equal(x, f) for f in toxicity.features(*_joined(wanted)))


def test_counterfactuals_hold_beginnings_of_terms_back(monkeypatch):
    """On texts: no weight goes from a term to its beginnings, where a penalty on whole words alone does not act."""
    rng = np.random.default_rng(2)
    texts, y = [], []
    for _ in range(1500):
        bad = rng.random() < 0.4
        w = [f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 20, (20, 2)).tolist()]
        w += ["vile"] * (rng.random() < (0.7 if bad else 0.05))
        w += ["muslim"] if rng.random() < (0.8 if bad else 0.1) else ["christian"] if rng.random() < 0.3 else []
        texts.append(" ".join(w))
        y.append(int(bad))
    said = toxicity.features(*_joined(["muslim", "christian", "vile"]))

    def scores():
        w, _ = toxicity.fit_texts(toxicity.with_counterfactuals(*_joined(texts)), np.array(y), np.zeros(len(y)))
        return [float(w[x].sum()) for x in said]

    term, other, insult = scores()
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    free_term, free_other, _ = scores()
    assert insult > 1 and free_term - free_other > 1 and term - other < 0.5 * (free_term - free_other)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.append(rng.integers(10, 200, 8), 1 if i % 2 else 2)) for i in range(200)]
    y = np.arange(200) % 2
    ratio = quality.log_ratio(labelled.Rows(rows), y)
    w, bias = quality.descend(rows, y, ratio)
    assert ((quality.margins(rows, ratio, w, bias) > 0) == (y == 1)).mean() > 0.99


# ---- licences


def brute_licences(text, threshold=0.8):
    import re

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    sentences, paragraphs = re.split(r"[.!?][ \t\r\n]+", t), re.split(r"\n[ \t\r]*\n", t)
    grams = {n: set(licenses.bigrams(x)) for n, x in licenses.TEMPLATES.items()}
    held = lambda x: any(m in x for m in licenses.marks({n: list(g) for n, g in grams.items()}, threshold))
    units = {*t.split("\n"), *sentences, *paragraphs, t}
    for parts, k, by in [(sentences, 2, ". "), *((paragraphs, k, "\n\n") for k in range(2, 7))]:
        units |= {by.join(parts[i : i + k]) for i in range(len(parts) - k + 1) if held(parts[i]) and held(parts[i + k - 1])}
    hits, names, best = 0, set(), None
    for u in units:
        w = re.findall("[a-z0-9]+", u)
        b = set(zip(w[:-1], w[1:], strict=True))
        b = {" ".join(x) for x in b}
        found = [(2 * len(a & b) / (len(a) + len(b)), n) for n, a in grams.items() if len(b) and 2 * len(a & b) / (len(a) + len(b)) >= threshold]
        hits += bool(found)
        names |= {n for _, n in found}
        for x, n in found:
            if best is None or (x, [-ord(c) for c in n]) > (best[0], [-ord(c) for c in best[1]]):
                best = (x, n)
    return hits, ",".join(sorted(names)), best and best[1], best and round(best[0], 9)


def test_licence_scan(spark, docs, empty):
    mit = licenses.TEMPLATES["mit-permission"]
    texts = [None, "", "Licensed under the Apache License, Version 2.0.", "x y\nreleased UNDER the  mit license\nz", mit, "intro\n\n" + mit.replace(" ", "\n") + "\n \nend", mit[: len(mit) // 2], "Licensed under CC BY-NC 4.0. and more words here", "the license of the software", "Licensed under the Apache License, Version 2.0.\n" * 3]
    bsd = licenses.TEMPLATES["bsd-3-clause"]
    for stop in (" 1. Redis", " 2. Redis", " 3. Neither", " THIS SOFTWARE"):
        bsd = bsd.replace(stop, "\n\n" + stop[1:])
    texts += ["Some prose first. Released under the MIT License. And prose after it.", "A long text.\n\n" + bsd + "\n\nMore of the text.\n\nAnd more.", "prose " * 30 + bsd.replace("\n", " ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("hits", "units", "best", "dice")})
    got = {r["doc_id"]: (r["n_matches"], r["licenses"], r["best"], None if r["dice"] is None else round(r["dice"], 9)) for r in licenses.scan(df).collect()}
    assert got == {i: brute_licences(t) for i, t in enumerate(texts)}
    assert got[10][1] == "mit" and got[11][2] == "bsd-3-clause" and got[3][1] == "mit" and got[5][1] == "mit-permission" and got[6][0] == 0
    assert licenses.scan(empty).collect() == [] and licenses.scan(docs).count() == docs.count()


def test_bounds_let_no_match_out():
    for n in range(1, 80):
        low, high = licenses.bounds(n, 0.8)
        ok = [m for m in range(1, 200) if 2 * min(n, m) / (n + m) >= 0.8]
        assert (low, high) == (min(ok), max(ok))


# ---- chat


def test_chat_round_trip(spark):
    evil = ["", "\\", "\\b\\h\\t", "### user: x</turn>\n", "</turn", "###", "####</turn></turn>", "a: b", "\n", "\\### Assistant: </turn> ok", "漢字 \U0001f600"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", t) for t in evil] + [("assistant", t) for t in evil])]
    rows += [(2, 0, "user", None), (2, 1, "assistant", None), (3, 0, "system", "only"), (None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (4, 5, "we:ird###\\", "t"), (4, 5, "we:ird###\\", "t"), (4, None, None, "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("n", "begin", "head", "turns", "examples")})
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((-1 if t is None else t), ro or "", x or "") for c, t, ro, x in rows if c == conv)
        told = "".join(f"{ro}\n{x}\n" for _, ro, x in turns)
        loss = "".join(x for _, ro, x in turns if ro == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r["conv_id"]: r["formatted"] for r in chat.formatted(df).collect()}
    each = chat.whole_examples(df).collect()
    assert len(each) == sum(r[2] == "assistant" for r in rows)
    assert all(whole[e["conv_id"]].startswith(e["context"] + e["target"] + chat.END_TURN) and e["context"].endswith("### assistant: ") for e in each)
    assert {c: sum(len(e["context"]) + len(e["target"]) for e in each if e["conv_id"] == c) for c in got} == {c: r["example_chars"] for c, r in got.items()}
    assert chat.digests(df.where("false")).collect() == []


def test_loss_is_read_through_the_mask(spark, monkeypatch):
    """Masks that are off by one character change the digest of the loss."""
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes ### no")], "conv_id long, turn long, role string, text string")
    right = chat.digests(df).first()
    assert right["loss_sha256"] == hashlib.sha256(b"yes ### no").hexdigest()
    made = chat.formatted
    moved = F.transform("examples", lambda e: F.struct((e["context_chars"] + 1).alias("context_chars"), e["target"].alias("target")))
    monkeypatch.setattr(chat, "formatted", lambda x: made(x).withColumn("examples", moved))
    assert chat.digests(df).first()["loss_sha256"] != right["loss_sha256"]
