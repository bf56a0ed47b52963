"""A release of a judged-score database that is safe to publish: which rows belong to it, what happens to each text column, and the export.

The layout below is data: where a table's rows come from (a column that holds the release's id, or ids that other tables of the release refer to, or
the whole table) and its text columns by treatment. ``build`` turns it into frames; ``export`` writes them as SQLite with a
metadata table, a view and a packed copy, or as Parquet where tables are large.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.sources import files, sqlite


@dataclass(frozen=True)
class Member:
    """A table of a release. One of: ``release`` (its column with the release's id), ``used`` (references (table, column) to its id), or neither: all its rows.

    plain: texts that lose local paths; json, packets: JSON that is sanitized, packets strictly; renamed: published under another name."""

    release: str | None = None
    used: tuple[tuple[str, str], ...] = ()
    plain: tuple[str, ...] = ()
    json: tuple[str, ...] = ()
    packets: tuple[str, ...] = ()
    renamed: dict[str, str] = field(default_factory=dict)


#: Tables and columns of the published database (fixed values).
LAYOUT = {
    "benchmark_releases": Member(release="id", plain=("manifest_path", "notes"), renamed={"manifest_path": "manifest_path_redacted"}),
    "release_questions": Member(release="release_id"),
    "responses": Member(release="benchmark_release_id", packets=("raw_metadata",), renamed={"raw_metadata": "raw_metadata_redacted"}),
    "evaluations": Member(release="benchmark_release_id", plain=("overall_rationale", "scholarly_credibility"), json=("per_dimension_scores", "factual_errors", "anachronisms", "confusions", "error_flags", "trap_caps_applied")),
    "questions": Member(used=(("release_questions", "question_id"),), plain=("ground_truth", "retired_reason"), json=("expected_characteristics",), packets=("source_refs",)),
    "domains": Member(used=(("questions", "domain_id"),)),
    "question_categories": Member(used=(("questions", "category_id"),)),
    "question_subcategories": Member(used=(("questions", "subcategory_id"),)),
    "models": Member(used=(("responses", "model_id"),), plain=("notes",)),
    "benchmark_runs": Member(used=(("responses", "benchmark_run_id"),), plain=("description", "notes")),
    "rubrics": Member(used=(("evaluations", "rubric_id"),)),
    "prompt_templates": Member(plain=("template_text", "description")),
    "reference_authoring_runs": Member(release="release_id", plain=("workspace_path", "batch_manifest_path", "notes"), renamed={"workspace_path": "workspace_path_redacted", "batch_manifest_path": "batch_manifest_path_redacted"}),
    "question_reference_answer_versions": Member(release="release_id", plain=("bundle_path", "uncertainty_notes"), json=("expected_characteristics_json",), renamed={"bundle_path": "bundle_path_redacted"}),
    "question_source_resolution": Member(release="release_id", plain=("reviewer_notes",), packets=("source_refs_raw", "candidate_sources_json", "resolved_sources_json", "unresolved_refs_json")),
    "question_corpus_context": Member(release="release_id", plain=("retrieval_notes",), packets=("packet_json",), renamed={"packet_json": "packet_json_public_redacted"}),
    "question_grounding_audit": Member(release="release_id", plain=("reviewer",), json=("findings_json",)),
    "response_grounding_audits": Member(release="benchmark_release_id", json=("claim_manifest_json", "hallucination_flags_json", "unsupported_but_noncentral_claims_json", "fatal_audit_errors_json"), packets=("source_material_hashes_json",)),
}
POLICY = "Rows of one release only. Accounts, worker claims and raw source bodies are left out; local paths are redacted; hashes and structured provenance stay."


def scoped(tables: dict[str, DataFrame], release_id: int, layout: dict[str, Member] = LAYOUT) -> dict[str, DataFrame]:
    """Each table's rows that belong to the release; tables that are not given are left out."""
    out: dict[str, DataFrame] = {}
    for name, member in sorted(layout.items(), key=lambda x: (bool(x[1].used), _depth(x[0], layout))):
        if name not in tables:
            continue
        df = tables[name]
        if member.release:
            df = df.where(F.col(member.release) == release_id)
        elif member.used:
            ids = [out[t].select(F.col(c).alias("_id")) for t, c in member.used if t in out]
            every = ids[0] if ids else df.select(F.col("id").alias("_id")).limit(0)
            for more in ids[1:]:
                every = every.unionAll(more)
            df = df.join(every, F.col("id") == F.col("_id"), "left_semi")
        out[name] = df
    return {name: out[name] for name in layout if name in out}


def _depth(name: str, layout: dict[str, Member]) -> int:
    return 1 + max((_depth(t, layout) for t, _ in layout[name].used), default=-1)


def treatments(member: Member, columns: list[str]) -> Iterator[tuple[str, Column]]:
    """(column, what is published of it); columns that a table lacks are passed over."""
    ways = ((member.plain, T.redact_paths), (member.json, T.sanitize_json), (member.packets, lambda c: T.sanitize_json(c, strict=True)))
    for names, way in ways:
        for c in names:
            if c in columns:
                yield c, way(T.clean_utf8(F.col(c)))


def build(tables: dict[str, DataFrame], release_id: int, layout: dict[str, Member] = LAYOUT) -> dict[str, DataFrame]:
    """The release's tables as they are published."""
    out = {}
    for name, df in scoped(tables, release_id, layout).items():
        out[name] = df.withColumns(dict(treatments(layout[name], df.columns))).withColumnsRenamed(layout[name].renamed)
    return out


def metadata(built: dict[str, DataFrame], release_id: int, label: str, source: str | None = None) -> dict[str, str]:
    counted = {f"rows_{n}": str(built[n].count()) for n in ("responses", "evaluations", "release_questions", "response_grounding_audits") if n in built}
    origin = {"source_filename": Path(source).name, "source_sha256": files.file_sha256(source)} if source else {}
    return {"created_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "release_label": label, "release_id": str(release_id), "publication_safety_policy": POLICY, **counted, **origin}


def export(tables: dict[str, DataFrame], label: str, path: str | Path, source: str | None = None, layout: dict[str, Member] = LAYOUT) -> dict[str, str]:
    """Write a release (by its label) to an SQLite file with a metadata table and a view of scored responses, and a packed copy; returns what the metadata table says and the hashes."""
    found = tables["benchmark_releases"].where(F.col("release_label") == label).select("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} releases are called {label}")
    built, target = build(tables, found[0].id, layout), Path(path)
    target.unlink(missing_ok=True)
    told = metadata(built, found[0].id, label, source)
    spark = next(iter(tables.values())).sparkSession
    sqlite.write_tables({**built, "publication_export_metadata": spark.createDataFrame(sorted(told.items()), "key string, value string")}, str(target))
    if {"responses", "evaluations"} <= set(built):
        with sqlite3.connect(target) as db:
            db.execute("CREATE VIEW scored_responses AS SELECT r.*, e.id AS evaluation_id, e.rubric_id FROM responses r JOIN evaluations e ON e.response_id = r.id")
    packed, digest = files.gzip_file(target)
    return {**told, "sha256": files.file_sha256(target), "packed": str(packed), "packed_sha256": digest}
