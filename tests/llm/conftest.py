import numpy as np
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names clash with those that operators make.
CLASH = ("cls", "key", "keys", "sig", "part", "root", "node", "size", "range", "target", "label", "score", "id", "a", "b", "copies", "runs", "n", "rank", "spots", "anchors")


def some_words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 6))) for _ in range(n))


def document_rows(seed=0, many=60):
    """Texts of all sorts: null, empty, blank, short, copies, near copies, shared passages, one very long."""
    rng = np.random.default_rng(seed)
    base = [some_words(rng, int(rng.integers(1, 120))) for _ in range(many)]
    passage = some_words(rng, 60)
    rows = [None, "", " \t\n", "one", "one", "ONE", "a b c d", "A b\nc  d", "é ü ñ 漢字 " * 30, "aaaa" * 120, "x " * 300, some_words(rng, 8000)]
    rows += base + base[:6] + [base[0].upper()]
    for t in base[10:20]:
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append(" ".join(w))
    rows += [some_words(rng, 20) + " " + passage + " " + some_words(rng, 20) for _ in range(5)]
    return [(i, t, "en", [None, "b", "a", "Z"][i % 4], None if t is None else len(t)) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=False):
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(make_docs):
    """Documents with repeated rows, null ids and clashing columns."""
    rows = document_rows()
    rows += [rows[15], (None, "no id here at all", "en", "a", 17), (None, None, None, None, None)]
    return make_docs(rows, clash=True)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
