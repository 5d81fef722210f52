"""The versioned feature contract: base features, metadata columns, engineered families."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

SCHEMA_VERSION = "2.0.0"


class ContractError(ValueError):
    """A table doesn't fit the contract."""


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str = "count"  # count, boolean or continuous
    aliases: tuple[str, ...] = ()
    required: bool = False

    @property
    def maximum(self) -> float | None:
        return 1.0 if self.kind == "boolean" else None

    @property
    def spark_type(self) -> str:
        return {"boolean": "tinyint", "count": "int", "continuous": "float"}[self.kind]


# Names, order, kinds and accepted source names of the base features.
BASE = (
    Feature("obj_count", aliases=("obj", "object_declaration_count")),
    Feature("endobj_count", aliases=("endobj",)),
    Feature("stream_count", aliases=("stream", "streams")),
    Feature("endstream_count", aliases=("endstream", "endstreams")),
    Feature("xref_count", aliases=("xref",)),
    Feature("trailer_count", aliases=("trailer",)),
    Feature("startxref_count", aliases=("startxref",)),
    Feature("js_count", aliases=("js",)),
    Feature("javascript_count", aliases=("javascript",)),
    Feature("action_count", aliases=("action",)),
    Feature("openaction_count", aliases=("open_action",)),
    Feature("aa_count", aliases=("aa", "additional_action_count")),
    Feature("launch_count", aliases=("launch",)),
    Feature("uri_count", aliases=("uri",)),
    Feature("submitform_count", aliases=("submit_form",)),
    Feature("acroform_count", aliases=("acro_form",)),
    Feature("xfa_count", aliases=("xfa",)),
    Feature("richmedia_count", aliases=("rich_media",)),
    Feature("jbig2decode_count", aliases=("jbig2decode", "jbig2")),
    Feature("colors_count", aliases=("colors",)),
    Feature("objstm_count", aliases=("objstm", "object_stream_count")),
    Feature("filter_count", aliases=("filter", "filters")),
    Feature("obfuscation_count", aliases=("obfuscations", "name_obfuscation_count")),
    Feature("avg_stream_size", "continuous", ("average_stream_size", "stream_avg_size")),
    Feature("indirect_obj_count", aliases=("indirect_objects", "indirect_object_count")),
    Feature("pdf_size", "continuous", ("file_size",), required=True),
    Feature("title_chars", aliases=("title_length", "title characters")),
    Feature("is_encrypted", "boolean", ("encryption", "encrypted")),
    Feature("metadata_size", "continuous", ("meta_size",)),
    Feature("page_count", aliases=("pages", "page number")),
    Feature("has_text", "boolean", ("contains_text", "text")),
    Feature("image_count", aliases=("images", "image number")),
    Feature("obj_count_total", aliases=("object_number", "total_objects", "object count")),
    Feature("font_obj_count", aliases=("font_objects", "font count")),
    Feature("embedded_file_count", aliases=("embedded_files", "EmbeddedFile")),
    Feature("avg_embedded_media_size", "continuous", ("average_embedded_media_size", "embedded_media_avg_size")),
    Feature("header_valid", "boolean", ("header", "valid_header", "header validity"), required=True),
)
METADATA = ("sample_id", "Class", "source_id", "group_id", "first_seen_at", "label_confidence")
#: Parts of column names that raw content goes by.
CONTENT_TOKENS = ("raw_bytes", "file_bytes", "payload", "script_body", "javascript_body", "document_text", "raw_text", "sample_url", "download_url", "sample_path")
STATUS = ("parse_failure", "recovery_mode", "invalid_eof", "extraction_limit_reached", "extraction_timeout", "file_too_large")
# End of fixed values.

BASE_NAMES = tuple(f.name for f in BASE)
EXPECTED = (*METADATA, *BASE_NAMES)


def normalised(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def resolve(columns: Iterable[str], overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Base feature -> the one source column that goes by its name or an alias; overrides win; none or several is an error."""
    by_name: dict[str, set[str]] = {}
    given = list(columns)
    for c in given:
        by_name.setdefault(normalised(c), set()).add(c)
    overrides = overrides or {}
    if absent := sorted(set(overrides.values()) - set(given)):
        raise ContractError(f"overrides name absent columns: {absent}")
    out, wrong = {}, []
    for f in BASE:
        found = {overrides[f.name]} if f.name in overrides else set().union(*(by_name.get(normalised(n), set()) for n in (f.name, *f.aliases)))
        if len(found) == 1:
            out[f.name] = found.pop()
        else:
            wrong.append(f"{f.name}: {'ambiguous ' + str(sorted(found)) if found else 'no column'}")
    if wrong:
        raise ContractError("; ".join(wrong))
    return out


def check_columns(columns: Iterable[str], allow_extra: bool = False) -> list[str]:
    """Problems of a set of columns: codes duplicate_columns, missing_columns, unsafe_content_columns, unexpected_columns."""
    given = list(columns)
    extra = [c for c in given if c not in EXPECTED]
    unsafe = [c for c in extra if any(t in c.lower() for t in CONTENT_TOKENS)]
    found = []
    if len(set(given)) < len(given):
        found.append("duplicate_columns")
    if set(EXPECTED) - set(given):
        found.append("missing_columns")
    if unsafe:
        found.append("unsafe_content_columns")
    if extra and not allow_extra:
        found.append("unexpected_columns")
    return sorted(found)


def engineered_lineage() -> dict[str, tuple[str, ...]]:
    """Engineered feature -> the base features that it is made of."""
    from .functions.engineered import catalogue

    return {name: parents for name, _, parents, _ in catalogue()}
