"""Toxicity classifier with counterfactual regularisation.

Logistic regression over indicators of words (runs of letters) and of their beginnings. For each labelled sentence with an identity term, the
sentence with its terms swapped for others of their group is a counterfactual: the squared difference of the two scores
(before the sigmoid) is penalised, so a term alone moves no score and neutral mentions are not taken for toxic ones.
Words are swapped with all their features, beginnings too. Sentences of a document are swapped together, as labels are
of documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LETTERS, LOWER, mix, powers, prefix_hash, table, words
from .labelled import DIMENSIONS, Rows, fit_in_one_task, fold, kept, prior_shift, sample, scored, sigmoid

CUT = 0.5
#: Weight of the counterfactual penalty and of the squared weights; steps of the optimiser.
PENALTY, RIDGE, STEPS = 5.0, 5e-6, 2500
#: Value of the likelihood ratio's root below which a feature is not used; bytes of the word beginnings that are features.
LEAST_Z = 3.0
BEGINNINGS = (4, 5, 6)
#: Groups within which a term may take another's place (English, German, French, Spanish).
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("she", "he", "sie", "er", "elle", "il", "ella", "él"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "muslimisch", "christlich", "jüdisch", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "african", "european", "schwarz", "weiß", "noir", "blanc", "negro", "blanco"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    ("immigrant", "native", "refugee", "foreigner", "migrant", "citizen"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
)
_SHIFT = np.uint64(64 - DIMENSIONS.bit_length() + 1)


def _named(terms: tuple[str, ...]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    offsets = np.cumsum([0, *map(len, raw)])
    return (words(np.frombuffer(b"".join(raw), np.uint8), offsets, LETTERS)[2] >> _SHIFT).astype(np.int64)


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its features, itself first and then its beginnings; the first word of each text."""
    starts, ends, word, bounds = words(data, offsets, LETTERS)
    found = [word]
    if len(word):
        h, back = prefix_hash(LOWER[data]), powers(len(data) + 1)[1]
        for n in BEGINNINGS:
            # of shorter words, the word itself once more
            found.append(np.where(ends - starts > n, mix((h[np.minimum(starts + n, ends)] - h[starts]) * back[starts] + np.uint64(n)), word))
    return np.stack(found, axis=1), bounds


def _hashed(parts: np.ndarray) -> np.ndarray:
    return np.unique((parts >> _SHIFT).astype(np.int64))


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct hashed words and beginnings of words of each text."""
    parts, bounds = _parts(data, offsets)
    return [_hashed(parts[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _listed(terms: tuple[str, ...]) -> np.ndarray:
    """_parts() of terms, a row each."""
    raw = [t.encode() for t in terms]
    return _parts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0]


def counterfactuals(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """features() of each text with its identity terms swapped, as if the words were written anew; empty where it has none.

    All mentions of a term in a text become the same other term, chosen by a hash of the term and the text's words.
    """
    others: dict[int, np.ndarray] = {}
    for group in IDENTITY:
        names = _listed(group)
        others |= {int(n[0]): names[names[:, 0] != n[0]] for n in names}
        # only A-Z is lower-cased in words: a term with other capitals is the same term
        capitals = _listed(tuple("".join(c if c.isascii() else c.upper() for c in t) for t in group))
        others |= {int(c[0]): others[int(n[0])] for n, c in zip(names, capitals, strict=True)}
    terms = np.array(sorted(others), dtype=np.uint64)
    parts, bounds = _parts(data, offsets)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        held = np.unique(parts[a:b, 0][np.isin(parts[a:b, 0], terms)])
        swapped_parts = parts[a:b].copy()
        for h, pick in zip(held.tolist(), mix(held + parts[a:b, 0].sum(dtype=np.uint64)).tolist(), strict=True):
            swapped_parts[parts[a:b, 0] == h] = others[h][pick % len(others[h])]
        out.append(_hashed(swapped_parts) if len(held) else np.zeros(0, np.int64))
    return out


def with_counterfactuals(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """features() of each text, and as ~feature those of its counterfactual."""
    return [np.concatenate([~x, r]) for r, x in zip(features(data, offsets), counterfactuals(data, offsets), strict=True)]


def fit_texts(rows: list[np.ndarray], y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, float]:
    """fit() of rows that with_counterfactuals made."""
    return fit([r[r >= 0] for r in rows], y, part, [~r[r < 0] for r in rows])


def swapped(rows: list[np.ndarray], seed: int = 23) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(with, without): what each row that holds identity terms gains and loses when they are swapped; of rows that are sets of whole words."""
    rng = np.random.Generator(np.random.PCG64(seed))
    place: dict[int, np.ndarray] = {}
    for group in IDENTITY:
        names = _named(group)
        place |= {int(n): names for n in names}
    terms = np.array(sorted(place))
    gains, losses = [], []
    for r in rows:
        held = r[np.isin(r, terms)]
        if len(held):
            other = np.array([int(rng.choice(place[int(h)][place[int(h)] != h])) for h in held])
            gains.append(np.unique(other[~np.isin(other, r)]))
            losses.append(held)
    return gains, losses


def evidence(x: Rows, y: np.ndarray) -> np.ndarray:
    """How far a feature may be trusted, 0 to 1: from the root of its likelihood ratio between the classes.

    Words of a few documents that happen to be toxic have small values beside those of telling words (the tenth
    largest is the measure); without this they would be learned by heart.
    """
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    d1, d0 = x.back((y == 1).astype(float)), x.back((y == 0).astype(float))
    share = (d1 + d0) / (n1 + n0)

    def part(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    z = np.sqrt(np.maximum(0, 2 * (part(d1, n1 * share) + part(d0, n0 * share) + part(n1 - d1, n1 * (1 - share)) + part(n0 - d0, n0 * (1 - share)))))
    best = np.sort(z)[-10]
    return np.where(z < LEAST_Z, 0.0, np.minimum(1.0, (z / max(best, LEAST_Z)) ** 2))


def fit(rows: list[np.ndarray], y: np.ndarray, part: np.ndarray, others: list[np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) by accelerated gradient descent. others: the counterfactuals of the rows; without them rows are sets of whole words."""
    del part
    distinct = list({hashlib.blake2b(r.tobytes(), digest_size=16).digest(): i for i, r in enumerate(rows)}.values())  # copies say nothing new
    rows, y, others = [rows[i] for i in distinct], y[distinct], others and [others[i] for i in distinct]
    if len(set(y.tolist())) < 2:
        return np.zeros(DIMENSIONS), float(np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1)))
    if others is None:
        gains, losses = swapped(rows)
    else:
        pairs = [(r, x) for r, x in zip(rows, others, strict=True) if len(x)]
        gains, losses = ([np.setdiff1d(x, r) for r, x in pairs], [np.setdiff1d(r, x) for r, x in pairs])
    trust = evidence(Rows(rows), y)
    terms = np.concatenate([_named(g) for g in IDENTITY])
    used = np.union1d(np.flatnonzero(trust), terms if gains else terms[:0])
    x, up, down = (Rows([np.searchsorted(used, r[np.isin(r, used)]) for r in z]) for z in (rows, gains, losses))
    scale = np.maximum(trust[used], 0.01)
    n = len(used)
    weight = 1 / len(y)
    # of the gradient's slope: rows of indicators, the constant, the penalty
    longest = max(float(x.dot(scale**2).max()) + 1, 1.0)
    slope = 0.25 * longest + RIDGE + (2 * PENALTY * float((up.dot(scale**2) + down.dot(scale**2)).max()) if gains else 0.0)
    w = ahead = np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        v = ahead[:n] * scale
        g = weight * (sigmoid(x.dot(v) + ahead[n]) - y)
        grad = x.back(g, n)
        if gains:
            gap = up.dot(v) - down.dot(v)
            grad += 2 * PENALTY / len(gains) * (up.back(gap, n) - down.back(gap, n))
        step = np.append(grad * scale + RIDGE * ahead[:n], g.sum()) / slope
        new = ahead - step
        ahead = new + (t - 1) / (t + 2) * (new - w)
        w = new
    out = np.zeros(DIMENSIONS)
    out[used] = w[:n] * scale
    return out, float(w[n])


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """A function of (bytes, offsets) that scores texts: the estimated probability that a text is toxic."""
    w, bias = fit_in_one_task(sample(docs, labels, label), with_counterfactuals, fit_texts)
    bias += prior_shift(labels, label)
    w = w.astype(np.float32)
    return lambda data, offsets: sigmoid(np.array([float(w[r].sum()) + bias for r in features(data, offsets)]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text).

    A null text scores as an empty one; a null id is not held out. Without labels of both classes every score is the
    same. Rows of fold 0, ids without exactly one label and null labels are not learned from. An empty table gives no
    rows. Other columns are ignored.
    """
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that aren't predicted toxic, with all columns. learn_from: the documents that the labels are of."""
    return kept(docs, trained(learn_from if learn_from is not None else docs, labels), lambda s: s < CUT)


def op8_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
