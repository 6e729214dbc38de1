"""Weighted search fields and embedding texts of entities and artifacts. Absent columns are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"name": 5.0, "signature": 3.0, "doc_summary": 2.5, "body_preview": 1.5, "import_context": 1.4, "surface_context": 2.2, "file_origin": 0.0, "kind": 1.0}
ARTIFACT_WEIGHTS = {"kind": 3.0, "path": 0.0, "preview": 2.0, "mime": 1.4, "label": 1.0, "language": 1.2, "counts": 0.8, "declarations": 2.4, "imports": 1.6}
DOC_CHARS = 8000


def field_kind(kind: Column) -> Column:
    out = F.concat_ws("", F.transform(F.split(kind, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))))
    return out


def embed_kind(kind: Column) -> Column:
    return F.when(kind == "trait_def", "trait").when(kind == "enum_def", "enum").otherwise(kind)


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _keep(pairs: list[tuple[Column, float]]) -> Column:
    all_ = F.array(*[F.struct(t.cast("string").alias("text"), F.lit(w).cast("double").alias("weight")) for t, w in pairs])
    return F.filter(all_, lambda f: f["text"].isNotNull() & (f["text"] != ""))


def entity_fields(df: DataFrame, path_weight: float = 0.0, extra: list[tuple[Column, float]] | None = None) -> Column:
    """array<struct<text, weight>>: empties are left out, the path too unless it has weight."""
    pairs = [(_col(df, "name"), WEIGHTS["name"]), (_col(df, "signature"), WEIGHTS["signature"])]
    pairs += [(F.trim(_col(df, c)), WEIGHTS[c]) for c in ("doc_summary", "body_preview", "import_context", "surface_context")]
    if path_weight > 0:
        pairs.append((_col(df, "file_origin"), path_weight))
    pairs.append((field_kind(F.col("kind")), WEIGHTS["kind"]))
    return _keep(pairs + [(F.trim(t), w) for t, w in extra or []])


def structured_artifact_fields(path_weight: float = 0.0) -> Column:
    """The path is a field even at weight 0."""
    return _keep([(F.col("kind"), 3.0), (F.col("file_id"), path_weight), (F.trim("text_preview"), 2.0)])


def opaque_artifact_fields(path_weight: float = 0.0) -> Column:
    return _keep([(F.lit("opaque_artifact"), 1.0), (F.col("file_id"), path_weight), (F.trim("mime_type"), 1.4), (F.trim("text_preview"), 2.0)])


def shallow_file_fields(path_weight: float = 0.0) -> Column:
    counts = F.format_string("declarations %d imports %d", F.col("declaration_count"), F.col("import_count"))
    return _keep(
        [(F.lit("shallow_file"), 1.0), (F.col("file_id"), path_weight), (F.trim("language_hint"), 1.2), (counts, 0.8), (F.array_join("declaration_names", " "), 2.4), (F.array_join("import_paths", " "), 1.6)]
    )


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def entity_text(df: DataFrame, context: Column | None = None) -> Column:
    """Lines in fixed order: kind, path, name, signature, doc (at most 8000 characters), three metadata texts, context lines."""
    doc = F.substring(_filled(F.trim(_col(df, "doc_summary"))), 1, DOC_CHARS)
    parts = [embed_kind(F.col("kind")), _col(df, "file_origin"), _filled(_col(df, "name")), _filled(_col(df, "signature")), doc]
    parts += [_filled(_col(df, c)) for c in ("body_preview", "import_context", "surface_context")]
    return F.concat_ws("\n", *parts, *([] if context is None else [context]))


def short_text(name: Column, signature: Column, body: Column) -> Column:
    return F.concat_ws(" ", _filled(name), _filled(signature), _filled(body))


def structured_artifact_text() -> Column:
    return F.concat_ws("\n", F.lit("structured_artifact"), F.concat(F.lit("kind="), "kind"), F.concat(F.lit("file="), "file_id"), _filled(F.trim("text_preview")))


def opaque_artifact_text() -> Column:
    return F.concat_ws("\n", F.lit("opaque_artifact"), F.concat(F.lit("file="), "file_id"), F.concat(F.lit("mime_type="), _filled(F.trim("mime_type"))), _filled(F.trim("text_preview")))


def shallow_file_text() -> Column:
    lists = [F.concat(F.lit(f"{k}="), _filled(F.array_join(c, " "))) for k, c in (("declarations", "declaration_names"), ("imports", "import_paths"))]
    counts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("declaration_count", "import_count")]
    return F.concat_ws("\n", F.lit("shallow_file"), F.concat(F.lit("file="), "file_id"), F.concat(F.lit("language_hint="), "language_hint"), *counts, *lists)


def prefixed(text: Column, model: str, query: bool) -> Column:
    """Retrieval models of some families want a task prefix."""
    low = model.lower()
    if "nomic" in low:
        return F.concat(F.lit("search_query: " if query else "search_document: "), text)
    if "swerank" in low and query:
        return F.concat(F.lit("Represent this query for searching relevant code: "), text)
    return text
