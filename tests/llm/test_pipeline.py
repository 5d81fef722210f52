import collections

import corpus_pipeline
from lumenfold.llm import common, minhash, mixing, packing, substrings
from tests.llm.test_text_operators import labelled_tables


def test_stages_hand_on_their_decisions(spark, make_docs, tmp_path):
    docs, labels, known = labelled_tables(spark, make_docs)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    here = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "mix_sources", "pack_sequences"]
    x = common.table(spark, here, "documents")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        x = common.materialise(stage(spark, x, here))
        assert x.columns == docs.columns
        seen.append(x)
    toxic, unique, cut, mixed = seen
    assert toxic.count() < docs.count()
    ids = [r["doc_id"] for r in unique.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({r["doc_id"] for r in minhash.near_duplicates(toxic).where("kept").collect()})
    assert substrings.removed(cut).agg({"n_bytes": "sum"}).first()[0] <= substrings.removed(unique).agg({"n_bytes": "sum"}).first()[0]
    copies = sum(r["copies"] for r in mixing.mix(cut).collect())
    assert mixed.count() == copies
    last = corpus_pipeline.run(spark, here).collect()
    tokens = sum(len(packing.encode(r["text"] or "")) for r in mixed.collect())
    assert sum(r["length"] for r in last) == tokens
    again = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in last)
    assert again == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, here).collect())


def python_steps(node):
    """The most Python steps that one task of a plan runs, each in a worker of its own."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return python_steps(node.initialPlan())
    children = node.children()
    below = [python_steps(children.apply(i)) for i in range(children.size())]
    if name == "Exchange":
        return 0
    return (max if name == "Union" else sum)(below or [0]) + (name == "MapInArrow")


def test_a_task_of_substring_removal_has_one_python_worker(docs, monkeypatch):
    """Workers are kept: where one task had two, they held an executor's memory through all later stages."""
    plans = []
    monkeypatch.setattr(substrings, "materialise", lambda df: plans.append(python_steps(df._jdf.queryExecution().executedPlan())) or common.materialise(df))
    out = substrings.without_repeats(docs)
    plans.append(python_steps(out._jdf.queryExecution().executedPlan()))
    assert max(plans) == 1


def test_workers_give_back_what_they_freed(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    for x in common.tidy(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2])):
        assert seen[-1] == x
    assert seen == [1, 2, "back"]


def test_empty_corpus(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
