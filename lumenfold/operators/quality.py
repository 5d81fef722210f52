"""Validation: reason codes, quarantine, quality statistics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..specs import BASE, CONTENT_TOKENS, EXPECTED, METADATA, ContractError, Feature, check_columns, resolve

INT_MAX = 2147483647
URL_LIKE = r"(?i)(^[a-z][a-z0-9+.-]*://|[\\/])"
LOW_CONFIDENCE, REVIEW_ROWS = 0.80, 1000
_NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def canonicalise(df: DataFrame, overrides: dict[str, str] | None = None, metadata: dict[str, str] | None = None, keep_extra: bool = False) -> DataFrame:
    """A source in canonical names and order; extra columns are an error unless kept."""
    found = resolve(df.columns, overrides)
    for name in METADATA:
        source = (metadata or {}).get(name, name)
        if source not in df.columns:
            raise ContractError(f"metadata column {name} is absent (as {source})")
        found[name] = source
    extra = [c for c in df.columns if c not in found.values()]
    if extra and not keep_extra:
        unsafe = [c for c in extra if any(t in c.lower() for t in CONTENT_TOKENS)]
        raise ContractError(f"raw content columns: {unsafe}" if unsafe else f"unexpected columns: {extra}")
    return df.select(*[F.col(found[c]).alias(c) for c in EXPECTED], *extra)


def feature_reasons(f: Feature, kind: str) -> list[Column]:
    """Codes of one feature of a row, in order; a column that isn't numeric fails as such on every row."""
    if kind not in _NUMERIC:
        return [F.lit(f"feature_type:{f.name}")]
    x = F.col(f.name).cast("double")
    known = x.isNotNull() & ~F.isnan(x)
    infinite = known & (F.abs(x) == float("inf"))
    usable = known & ~infinite
    out = [F.when(infinite, f"non_finite:{f.name}")]
    if f.required:
        out.append(F.when(~known, f"missing_required:{f.name}"))
    out.append(F.when(usable & (x < 0), f"below_minimum:{f.name}"))
    if f.maximum is not None:
        out.append(F.when(usable & (x > f.maximum), f"above_maximum:{f.name}"))
    if f.kind != "continuous":
        out.append(F.when(usable & (F.abs(x - F.rint(x)) > 1e-6), f"non_integral_{f.kind}:{f.name}"))
    if f.kind == "count":
        out.append(F.when(usable & (x > INT_MAX), f"count_overflow:{f.name}"))
    return out


def metadata_reasons(df: DataFrame) -> list[Column]:
    kinds = dict(df.dtypes)
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    label = F.when(F.col("Class").isNull() | ~F.col("Class").isin(0, 1), "invalid_label") if kinds["Class"] in _NUMERIC else F.lit("label_type")
    confidence = F.col("label_confidence")
    bad = F.when(confidence.isNull() | F.isnan(confidence.cast("double")) | ~confidence.between(0, 1), "invalid_label_confidence") if kinds["label_confidence"] in _NUMERIC else F.lit("label_confidence_type")
    seen = F.col("first_seen_at") if kinds["first_seen_at"].startswith("timestamp") else F.try_to_timestamp(F.col("first_seen_at").cast("string"))
    return [
        label,
        *[F.when(blank(c), f"empty_{c}") for c in ("sample_id", "source_id", "group_id")],
        F.when(F.col("sample_id").cast("string").rlike(URL_LIKE), "non_opaque_sample_id"),
        F.when(seen.isNull(), "invalid_first_seen_at"),
        bad,
    ]


def with_reasons(df: DataFrame, features: tuple[Feature, ...] = BASE, name: str = "reason", metadata: bool = True) -> DataFrame:
    """df with its row reason codes joined by ';', in rule order; '' for a valid row. Column problems fail every row alike."""
    if metadata and features is BASE and (problems := check_columns(df.columns)):
        return df.withColumn(name, F.lit(";".join(problems)))
    kinds = dict(df.dtypes)
    codes = metadata_reasons(df) if metadata else []
    for f in features:
        codes += feature_reasons(f, kinds[f.name])
    return df.withColumn(name, F.array_join(F.array(*codes), ";"))


def reason_counts(df: DataFrame, name: str = "reason") -> DataFrame:
    return df.where(F.col(name) != "").select(F.explode(F.split(name, ";")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))


def row_flow(df: DataFrame, name: str = "reason") -> DataFrame:
    """received, schema_valid, label_valid, fully_valid: codes of the label don't count against the schema."""
    codes = F.filter(F.split(name, ";"), lambda c: c != "")
    of_label = lambda c: c.startswith("label_") | c.startswith("invalid_label")
    return df.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(~F.exists(codes, lambda c: ~of_label(c))).alias("schema_valid"),
        F.count_if(~F.exists(codes, lambda c: c.isin("label_type", "invalid_label"))).alias("label_valid"),
        F.count_if(F.col(name) == "").alias("fully_valid"),
    )


def opaque_id(c: Column | str) -> Column:
    return F.concat(F.lit("q-"), F.sha2(F.col(c).cast("string") if isinstance(c, str) else c, 256))


def quarantine(df: DataFrame, columns: tuple[str, ...], ids: tuple[str, ...] = ("sample_id", "group_id"), name: str = "reason") -> DataFrame:
    """Rejected rows: canonical columns only, ids hashed, with their reasons.

    Rows are dropped by exploding the reason, so its long expression is evaluated once, not in a filter and a projection.
    """
    reason = F.explode(F.filter(F.array(name), lambda x: x != "")).alias(name)
    return df.select(*[opaque_id(c).alias(c) if c in ids else F.col(c) for c in columns], reason)


def canonical_types(df: DataFrame) -> DataFrame:
    base = {f.name: f.spark_type for f in BASE} | {"sample_id": "string", "Class": "tinyint", "source_id": "string", "group_id": "string", "first_seen_at": "timestamp", "label_confidence": "float"}
    return df.select(*[F.col(c).cast(base[c]).alias(c) if c in base else F.col(c) for c in df.columns])


def frame_report(df: DataFrame, features: tuple[Feature, ...], label: str = "Class", ids: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """code, column, n_rows of whole-table rules: one aggregation, then unpivoted."""
    rules: list[tuple[str, str, Column]] = [("invalid_label", label, F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)))]
    for c in ids:
        rules.append(("empty_identifier", c, F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))))
        rules.append(("duplicate_identifier", c, F.count(c) - F.count_distinct(F.col(c))))
    for f in features:
        x = F.col(f.name).cast("double")
        rules.append(("feature_missing", f.name, F.count_if(x.isNull() | F.isnan(x))))
        rules.append(("feature_below_minimum", f.name, F.count_if(x < 0)))
        if f.maximum is not None:
            rules.append(("feature_above_maximum", f.name, F.count_if(x > f.maximum)))
        if f.kind != "continuous":
            rules.append(("feature_not_integral", f.name, F.count_if(F.abs(x - F.rint(x)) > 1e-6)))
    row = df.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(f"r{i}") for i, (_, _, x) in enumerate(rules)])
    each = F.array(*[F.struct(F.lit(a).alias("code"), F.lit(b).alias("column"), F.col(f"r{i}").alias("n_rows")) for i, (a, b, _) in enumerate(rules)])
    return row.select(F.inline(each))


def feature_quality(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, n_missing, missing_fraction, low, high, constant: finite values only, one aggregation."""
    aggregates = []
    for f in features:
        x = F.col(f).cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        aggregates += [F.count_if(x.isNull()).alias(f"{f}__n"), F.min(x).alias(f"{f}__low"), F.max(x).alias(f"{f}__high")]
    row = df.agg(F.count(F.lit(1)).alias("all__"), *aggregates)
    each = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"{f}__n").alias("n_missing"),
                (F.col(f"{f}__n") / F.col("all__")).alias("missing_fraction"),
                F.col(f"{f}__low").alias("low"),
                F.col(f"{f}__high").alias("high"),
                F.coalesce(F.col(f"{f}__low") == F.col(f"{f}__high"), F.lit(True)).alias("constant"),
            )
            for f in features
        ]
    )
    return row.select(F.inline(each))


def source_label_counts(df: DataFrame, source: str = "source_id", label: str = "label") -> DataFrame:
    """Counts by label, by source and by both, in one pass of grouping sets."""
    df = df.select(source, label)
    return df.groupingSets([[label], [source], [source, label]], source, label).agg(F.count(F.lit(1)).alias("n_rows"))


def coverage(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("group_id").alias("n_groups"),
        F.count_distinct("source_id").alias("n_sources"),
        F.min("first_seen_at").alias("first_time"),
        F.max("first_seen_at").alias("last_time"),
        F.avg(F.col("label").cast("double")).alias("positive_share"),
    )


def gates(counts: DataFrame, required: dict[str, float]) -> DataFrame:
    """gate, actual, required, passed: of a one-row table of counts."""
    each = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("actual"), F.lit(float(v)).alias("required"), (F.col(k) >= v).alias("passed")) for k, v in required.items()])
    return counts.select(F.inline(each))


def leading_number(c: str) -> Column:
    """The number that a text begins with ('29(2)' gives 29); null if negative or none."""
    x = F.regexp_extract(F.trim(F.col(c)), r"^([+-]?[0-9]+(\.[0-9]+)?)", 1).try_cast("double")
    return F.when(x >= 0, x)


def yes_no(c: str) -> Column:
    t = F.lower(F.trim(F.col(c)))
    return F.when(t == "yes", 1.0).when(t.isin("no", "0"), 0.0)


def review_queue(df: DataFrame, order: tuple[str, ...], confidence: str = "label_confidence", cap: int = REVIEW_ROWS) -> DataFrame:
    """The first rows with a low confidence, at most cap."""
    return df.where(F.col(confidence) < LOW_CONFIDENCE).orderBy(*order).limit(cap)


def mask(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.lit(None).cast(t).alias(c) if c in features else F.col(c) for c, t in df.dtypes])


def distinct_rows(df: DataFrame, subset: tuple[str, ...]) -> DataFrame:
    return df.select(*subset).distinct()


def without_constants(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """df without the features that hold one value only."""
    row = df.agg(*[(F.min(f) == F.max(f)).alias(f) for f in features]).first()
    return df.drop(*[f for f in features if row[f]])


def envelope(content: str = "content", maximum: int = 50 * 1024 * 1024) -> Column:
    """Why bytes aren't a document, or 'ok': empty, too_large, missing_header, missing_eof."""
    c = F.col(content)
    text = lambda x: F.decode(x, "ISO-8859-1")
    return (
        F.when(c.isNull() | (F.length(c) == 0), "empty")
        .when(F.length(c) > maximum, "too_large")
        .when(~F.contains(text(F.substring(c, 1, 1024)), F.lit("%PDF-")), "missing_header")
        .when(~F.contains(text(F.expr(f"substring({content}, greatest(1, length({content}) - 2047), 2048)")), F.lit("%%EOF")), "missing_eof")
        .otherwise("ok")
    )


def not_supported(what: str):
    raise NotImplementedError(f"{what} would leak or invent data and is refused")
