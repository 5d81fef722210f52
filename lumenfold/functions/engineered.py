"""Deterministic engineered features: one select over the base features, nulls treated as documented for each family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..specs import BASE, BASE_NAMES, STATUS, ContractError

SCRIPT = ("js_count", "javascript_count")
ACTIVE = ("js_count", "javascript_count", "openaction_count", "action_count", "aa_count", "launch_count", "uri_count", "submitform_count")
MIXTURE = (*ACTIVE, "stream_count", "objstm_count", "filter_count", "embedded_file_count")
#: Pairs whose counts should agree, and the names of their gaps.
GAPS = {
    "object_end_gap": ("obj_count", "endobj_count"),
    "stream_end_gap": ("stream_count", "endstream_count"),
    "xref_startxref_gap": ("xref_count", "startxref_count"),
    "xref_trailer_gap": ("xref_count", "trailer_count"),
    "scanner_parser_object_gap": ("obj_count", "obj_count_total"),
}


def d(name: str) -> Column:
    return F.col(name).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / (max(b, 0) + 1); null if either is."""
    return F.when(b.isNotNull(), a / (F.when(b > 0, b).otherwise(F.lit(0.0)) + 1.0))


def known_sum(names: tuple[str, ...]) -> Column:
    """Sum of what is known; 0 if nothing is."""
    return reduce(lambda a, b: a + b, (F.coalesce(d(n), F.lit(0.0)) for n in names))


def positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def flag(c: Column) -> Column:
    return c.cast("int").cast("double")


def entropy(names: tuple[str, ...]) -> Column:
    """Shannon entropy of the counts' shares over ln of their number; unknown and negative counts are 0; 0 without counts."""
    counts = F.array(*[F.greatest(F.coalesce(d(n), F.lit(0.0)), F.lit(0.0)) for n in names])
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    parts = F.transform(counts, lambda x: x / total)
    sums = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log(p + F.lit(1e-30)))
    return F.when(total > 0, -sums / F.log(F.lit(float(len(names))))).otherwise(F.lit(0.0))


def concentration(names: tuple[str, ...]) -> Column:
    counts = [F.greatest(F.coalesce(d(n), F.lit(0.0)), F.lit(0.0)) for n in names]
    total = reduce(lambda a, b: a + b, counts)
    return F.when(total > 0, F.greatest(*counts) / total).otherwise(F.lit(0.0))


def catalogue() -> list[tuple[str, str, tuple[str, ...], Column]]:
    """(name, family, base features, expression) of all engineered features, in order."""
    out: list[tuple[str, str, tuple[str, ...], Column]] = []
    for f in BASE:
        if f.kind != "boolean":
            x = d(f.name)
            out.append((f"log1p__{f.name}", "scale_stable", (f.name,), F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))))
    active, script = known_sum(ACTIVE), d(SCRIPT[0]) + d(SCRIPT[1])
    density = (
        ("active_actions_per_object", ACTIVE, active, "obj_count_total"),
        ("javascript_per_object", SCRIPT, script, "obj_count_total"),
        ("javascript_per_kib", SCRIPT, script * 1024.0, "pdf_size"),
        ("streams_per_object", ("stream_count",), d("stream_count"), "obj_count_total"),
        ("embedded_files_per_page", ("embedded_file_count",), d("embedded_file_count"), "page_count"),
        ("filters_per_stream", ("filter_count",), d("filter_count"), "stream_count"),
        ("obfuscations_per_object", ("obfuscation_count",), d("obfuscation_count"), "obj_count_total"),
        ("images_per_page", ("image_count",), d("image_count"), "page_count"),
        ("fonts_per_page", ("font_obj_count",), d("font_obj_count"), "page_count"),
        ("text_richness_per_page", ("has_text",), d("has_text"), "page_count"),
    )
    out += [(name, "density", (*parents, below), ratio(top, d(below))) for name, parents, top, below in density]
    for name, (a, b) in GAPS.items():
        gap = F.abs(d(a) - d(b))
        out.append((f"abs__{name}", "structural_consistency", (a, b), gap))
        out.append((f"normalized__{name}", "structural_consistency", (a, b), gap / (d(a) + d(b) + 1.0)))
    has_script = positive(script)
    interaction = (
        ("openaction_x_javascript", ("openaction_count", *SCRIPT), positive(d("openaction_count")) & has_script),
        ("aa_x_javascript", ("aa_count", *SCRIPT), positive(d("aa_count")) & has_script),
        ("launch_x_embedded", ("launch_count", "embedded_file_count"), positive(d("launch_count")) & positive(d("embedded_file_count"))),
        ("xfa_acroform_x_script", ("xfa_count", "acroform_count", *SCRIPT), positive(d("xfa_count") + d("acroform_count")) & has_script),
        ("filters_x_obfuscation", ("filter_count", "obfuscation_count"), positive(d("filter_count")) & positive(d("obfuscation_count"))),
        ("encryption_x_active_content", ("is_encrypted", *ACTIVE), positive(d("is_encrypted")) & positive(active)),
    )
    out += [(name, "interaction", parents, flag(x)) for name, parents, x in interaction]
    out += [
        ("object_stream_density", "complexity", ("objstm_count", "obj_count_total"), ratio(d("objstm_count"), d("obj_count_total"))),
        ("metadata_file_ratio", "complexity", ("metadata_size", "pdf_size"), ratio(d("metadata_size"), d("pdf_size"))),
        ("embedded_media_share", "complexity", ("embedded_file_count", "avg_embedded_media_size", "pdf_size"), ratio(d("embedded_file_count") * d("avg_embedded_media_size"), d("pdf_size"))),
        ("structural_token_entropy", "complexity", MIXTURE, entropy(MIXTURE)),
        ("structural_count_concentration", "complexity", MIXTURE, concentration(MIXTURE)),
    ]
    # an unknown count differs from everything; an unknown count isn't 0
    unequal = lambda a, b: F.coalesce(d(a) != d(b), F.lit(True))
    zero = lambda a: F.coalesce(d(a) == 0, F.lit(False))
    gap = F.abs(d("obj_count") - d("obj_count_total"))
    out += [
        ("truncated_structure", "parser_health", ("obj_count", "endobj_count", "stream_count", "endstream_count"), flag(unequal("obj_count", "endobj_count") | unequal("stream_count", "endstream_count"))),
        ("invalid_header", "parser_health", ("header_valid",), F.when(d("header_valid").isNotNull(), 1.0 - F.least(F.greatest(d("header_valid"), F.lit(0.0)), F.lit(1.0)))),
        ("invalid_xref", "parser_health", ("startxref_count", "xref_count", "objstm_count"), flag(zero("startxref_count") | (zero("xref_count") & zero("objstm_count")))),
        ("parser_disagreement", "parser_health", ("obj_count", "obj_count_total"), gap / (d("obj_count") + d("obj_count_total") + 1.0)),
    ]
    return out


def engineer(df: DataFrame, keep: tuple[str, ...] = (), families: tuple[str, ...] = (), status: bool = False, base: bool = False) -> DataFrame:
    """keep columns, base features if asked for, and the engineered features (of the families named; all by default), as float.

    status: parser status columns are passed through; one that is absent is an error.
    """
    if status and (absent := sorted(set(STATUS) - set(df.columns))):
        raise ContractError(f"status columns are absent: {absent}")
    made = [x.cast("float").alias(n) for n, family, _, x in catalogue() if not families or family in families]
    first = [d(n).cast("float").alias(n) for n in BASE_NAMES] if base else []
    last = [d(n).cast("float").alias(n) for n in STATUS] if status else []
    return df.select(*keep, *first, *made, *last)
