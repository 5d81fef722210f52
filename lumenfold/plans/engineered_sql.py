"""The engineered features in SQL, written from their definitions, to check the DataFrame expressions."""

from __future__ import annotations

from ..functions.engineered import ACTIVE, GAPS, MIXTURE
from ..specs import BASE


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} IS NOT NULL THEN ({a}) / (greatest({b}, 0) + 1.0) END"


def _positive(x: str) -> str:
    return f"coalesce(({x}) > 0, false)"


def family(name: str) -> list[tuple[str, str]]:
    """(feature, expression) over the base features of a family."""
    active = "(" + " + ".join(f"coalesce({n}, 0)" for n in ACTIVE) + ")"
    script = "(js_count + javascript_count)"
    if name == "scale_stable":
        return [(f"log1p__{f.name}", f"CASE WHEN {f.name} IS NOT NULL THEN ln(1 + greatest({f.name}, 0)) END") for f in BASE if f.kind != "boolean"]
    if name == "density":
        return [
            ("active_actions_per_object", _ratio(active, "obj_count_total")),
            ("javascript_per_object", _ratio(script, "obj_count_total")),
            ("javascript_per_kib", _ratio(f"{script} * 1024.0", "pdf_size")),
            ("streams_per_object", _ratio("stream_count", "obj_count_total")),
            ("embedded_files_per_page", _ratio("embedded_file_count", "page_count")),
            ("filters_per_stream", _ratio("filter_count", "stream_count")),
            ("obfuscations_per_object", _ratio("obfuscation_count", "obj_count_total")),
            ("images_per_page", _ratio("image_count", "page_count")),
            ("fonts_per_page", _ratio("font_obj_count", "page_count")),
            ("text_richness_per_page", _ratio("has_text", "page_count")),
        ]
    if name == "structural_consistency":
        return [x for g, (a, b) in GAPS.items() for x in ((f"abs__{g}", f"abs({a} - {b})"), (f"normalized__{g}", f"abs({a} - {b}) / ({a} + {b} + 1)"))]
    if name == "interaction":
        both = {
            "openaction_x_javascript": f"{_positive('openaction_count')} AND {_positive(script)}",
            "aa_x_javascript": f"{_positive('aa_count')} AND {_positive(script)}",
            "launch_x_embedded": f"{_positive('launch_count')} AND {_positive('embedded_file_count')}",
            "xfa_acroform_x_script": f"{_positive('xfa_count + acroform_count')} AND {_positive(script)}",
            "filters_x_obfuscation": f"{_positive('filter_count')} AND {_positive('obfuscation_count')}",
            "encryption_x_active_content": f"{_positive('is_encrypted')} AND {_positive(active)}",
        }
        return [(n, f"CAST(({x}) AS INTEGER)") for n, x in both.items()]
    if name == "complexity":
        total = "(" + " + ".join(f"greatest(coalesce({n}, 0), 0)" for n in MIXTURE) + ")"
        p = [f"(greatest(coalesce({n}, 0), 0) / {total})" for n in MIXTURE]
        return [
            ("object_stream_density", _ratio("objstm_count", "obj_count_total")),
            ("metadata_file_ratio", _ratio("metadata_size", "pdf_size")),
            ("embedded_media_share", _ratio("embedded_file_count * avg_embedded_media_size", "pdf_size")),
            ("structural_token_entropy", f"CASE WHEN {total} > 0 THEN -({' + '.join(f'{x} * ln({x} + 1e-30)' for x in p)}) / ln(12.0::DOUBLE) ELSE 0 END"),
            ("structural_count_concentration", f"CASE WHEN {total} > 0 THEN greatest({', '.join(f'coalesce({n}, 0)' for n in MIXTURE)}) / {total} ELSE 0 END"),
        ]
    return [
        ("truncated_structure", "CAST(coalesce(obj_count <> endobj_count, true) OR coalesce(stream_count <> endstream_count, true) AS INTEGER)"),
        ("invalid_header", "1 - least(greatest(header_valid, 0), 1)"),
        ("invalid_xref", "CAST(coalesce(startxref_count = 0, false) OR (coalesce(xref_count = 0, false) AND coalesce(objstm_count = 0, false)) AS INTEGER)"),
        ("parser_disagreement", "abs(obj_count - obj_count_total) / (obj_count + obj_count_total + 1)"),
    ]
