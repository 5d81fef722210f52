import pytest
from pyspark.sql import Row, functions as F

from lumenfold import specs
from lumenfold.functions import engineered, preprocess
from lumenfold.operators import quality, split
from lumenfold.sources import scans


def frame(spark, n=60, positive=(), **changes):
    """Rows in the shape of the contract: features (row + column) mod 7."""
    rows = []
    for i in range(n):
        r = {"sample_id": f"sample-{i:06d}", "Class": int(i in positive), "source_id": "ab"[i % 2], "group_id": f"group-{i:06d}", "first_seen_at": f"2024-01-01 00:{i % 60:02d}:00", "label_confidence": 1.0}
        for o, f in enumerate(specs.BASE):
            r[f.name] = float((i + o) % 2) if f.kind == "boolean" else 1000.0 + 17 * i if f.name == "pdf_size" else float((i + o) % 7)
        rows.append(r | {k: v for (k, at), v in changes.get("at", {}).items() if at == i})
    schema = ", ".join(f"{c} {'string' if c in ('sample_id', 'source_id', 'group_id', 'first_seen_at') else 'int' if c == 'Class' else 'double'}" for c in specs.EXPECTED)
    return spark.createDataFrame([tuple(r[c] for c in specs.EXPECTED) for r in rows], schema).withColumn("first_seen_at", F.to_timestamp("first_seen_at"))


def test_aliases_resolve_and_ambiguity_fails():
    names = ["JS" if n == "js_count" else "PDF size" if n == "pdf_size" else n for n in specs.BASE_NAMES]
    assert specs.resolve(names)["js_count"] == "JS" and specs.resolve(names)["pdf_size"] == "PDF size"
    with pytest.raises(specs.ContractError, match="ambiguous"):
        specs.resolve([*specs.BASE_NAMES, "js"])
    assert specs.resolve([*specs.BASE_NAMES, "js"], {"js_count": "js"})["js_count"] == "js"
    with pytest.raises(specs.ContractError, match="no column"):
        specs.resolve(specs.BASE_NAMES[1:])


def test_columns_are_checked(spark):
    assert specs.check_columns(specs.EXPECTED) == []
    assert specs.check_columns([*specs.EXPECTED, "raw_text"]) == ["unexpected_columns", "unsafe_content_columns"]
    assert specs.check_columns(specs.EXPECTED[1:]) == ["missing_columns"]
    with pytest.raises(specs.ContractError, match="raw content"):
        quality.canonicalise(frame(spark, 2).withColumn("payload_x", F.lit(1)))


def test_reasons_in_rule_order(spark):
    nan, inf = float("nan"), float("inf")
    changes = {("Class", 0): 3, ("sample_id", 1): " ", ("sample_id", 2): "https://x/y", ("label_confidence", 3): 1.5, ("obj_count", 4): 0.5, ("pdf_size", 5): None, ("pdf_size", 6): inf, ("has_text", 7): 2.0, ("obj_count", 8): -1.0, ("obj_count", 9): 3e9, ("obj_count", 10): nan, ("Class", 11): None, ("pdf_size", 11): -2.0}
    got = [r["reason"] for r in quality.with_reasons(frame(spark, 14, at=changes)).orderBy(F.substring("group_id", 7, 6)).collect()]
    assert got == ["invalid_label", "empty_sample_id", "non_opaque_sample_id", "invalid_label_confidence", "non_integral_count:obj_count", "missing_required:pdf_size", "non_finite:pdf_size", "above_maximum:has_text", "below_minimum:obj_count", "count_overflow:obj_count", "", "invalid_label;below_minimum:pdf_size", "", ""]
    flow = quality.row_flow(quality.with_reasons(frame(spark, 14, at=changes))).first()
    assert flow == Row(received=14, schema_valid=5, label_valid=12, fully_valid=3)


def test_a_text_column_fails_every_row(spark):
    df = frame(spark, 3).withColumn("page_count", F.lit("x"))
    assert {r["reason"] for r in quality.with_reasons(df).collect()} == {"feature_type:page_count"}


def test_duplicates_and_conflicts(spark):
    rows = [("a", 0, 2), ("a", 0, 1), ("b", 0, 1), ("b", 1, 2), ("c", 1, 1), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "k string, label int, t int")
    assert sorted(tuple(r) for r in split.deduplicate(df, "k", "label", ("t",)).collect()) == [("a", 0, 1), ("c", 1, 1)]
    s = split.dedup_statistics(df, "k", "label").first()
    assert (s["n_rows"], s["conflict_keys"], s["conflict_rows"], s["duplicate_rows"], s["kept_rows"]) == (6, 1, 2, 2, 2)


def test_partitions_keep_groups_whole(spark):
    df = spark.createDataFrame([(g, g * 10 + k, g % 2) for g in range(40) for k in range(4)], "group_id int, first_seen_at int, label int")
    p = split.assign(df)
    assert p.groupBy("group_id").agg(F.count_distinct("partition").alias("k")).where("k > 1").count() == 0
    s = {r["partition"]: r for r in split.partition_statistics(p).collect()}
    assert (s["train"]["n_rows"], s["validation"]["n_rows"], s["test"]["n_rows"]) == (128, 16, 16)
    assert split.in_strict_order(split.partition_statistics(p)).first() == Row(train_before_validation=True, validation_before_test=True)


def test_nulls_in_engineered_features(spark):
    df = frame(spark, 1, at={(n, 0): None for n in specs.BASE_NAMES if n not in ("pdf_size", "header_valid")})
    r = engineered.engineer(df).first()
    assert r["log1p__obj_count"] is None and r["javascript_per_object"] is None
    assert r["truncated_structure"] == 1 and r["invalid_xref"] == 0 and r["openaction_x_javascript"] == 0
    assert r["structural_token_entropy"] == 0 and len(r) == 69
    with pytest.raises(specs.ContractError):
        engineered.engineer(df, status=True)
    assert len(specs.engineered_lineage()) == 69


def test_preprocessing_is_fitted_on_train_only(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (float("nan"), 5.0), (9.0, 5.0)], "a double, b double")
    with pytest.raises(specs.ContractError):
        preprocess.fit(df, ("a",), "test")
    f = preprocess.fit(df, ("a", "b"))
    assert f.active == ("a",) and f.values["a"]["median"] == 2.0
    out = preprocess.transform(df, f)
    assert out.columns == ["a", "a__missing", "b__missing"] and [r["a__missing"] for r in out.collect()] == [0, 0, 1, 1, 0]


def test_tables_in_and_out(spark, tmp_path):
    df = quality.canonical_types(frame(spark, 9))
    scans.write(df, f"{tmp_path}/t", scans.contract_schema())
    back = scans.read(spark, f"{tmp_path}/t")
    assert back.count() == 9 and dict(back.dtypes)["obj_count"] == "int" and dict(back.dtypes)["header_valid"] == "tinyint"
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        scans.write(df, f"{tmp_path}/t")
    files = scans.inventory(spark, f"{tmp_path}/t").collect()
    assert sum(r["n_rows"] for r in files) == 9 and all(len(r["sha256"]) == 64 for r in files)
    df.limit(3).coalesce(1).write.csv(f"{tmp_path}/c.csv", header=True)
    assert set(dict(scans.read(spark, f"{tmp_path}/c.csv").dtypes).values()) == {"string"}
    assert scans.cast(scans.read(spark, f"{tmp_path}/c.csv"), scans.contract_schema()).where("obj_count is not null").count() == 3
    df.limit(2).write.json(f"{tmp_path}/j.jsonl")
    assert scans.read(spark, f"{tmp_path}/j.jsonl", ("sample_id",), limit=1).count() == 1
    with pytest.raises(specs.ContractError):
        scans.table_format("x.xlsx")
    scans.write_clean_and_quarantine(quality.with_reasons(frame(spark, 6, at={("Class", 2): 9})), f"{tmp_path}/clean", f"{tmp_path}/bad")
    assert scans.count(spark, f"{tmp_path}/clean") == 5 and scans.read(spark, f"{tmp_path}/bad").first()["sample_id"].startswith("q-")


def test_bytes_are_bounded(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.pdf").write_bytes(b"x" * 100)
    got = {r["length"]: r["content"] for r in scans.read_bytes(spark, str(tmp_path), 50, "*.pdf").collect()}
    assert got == {10: bytearray(b"x" * 10), 100: None}


def test_refusals():
    with pytest.raises(NotImplementedError):
        quality.not_supported("a random split")
