"""Text: counts, previews, hashes, and redaction of paths and of nested JSON."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Callable, Sequence
from contextlib import suppress
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A local path runs to white space, a quote or a closing sign (fixed value).
LOCAL_PATH = r"""/Users/[^\s"',;)]+"""
#: Keys whose values are paths, and keys whose values are source text (fixed values).
PATH_KEYS = ("path", "local_path", "workspace_path", "bundle_path", "manifest_path", "approval_decision_memo", "batch_manifest_path")
TEXT_KEYS = ("source_text", "passage_text", "text_content", "quote", "quotation", "snippet", "source_passage", "translated_text", "translation", "ocr_text", "body")
LONG_TEXT = 1200


def word_count(text: Column) -> Column:
    """Stretches without white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def space_count(*known: Column, text: Column) -> Column:
    """The first known count, or the text's spaces and one more."""
    return F.coalesce(*known, (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)).cast("long")


def clean_utf8(raw: Column) -> Column:
    """Bytes or text as text, what is no character replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def contains_any(text: Column, patterns: Sequence[str]) -> Column:
    """Does the text hold one of the strings?"""
    return reduce(lambda a, b: a | b, (text.contains(p) for p in patterns), F.lit(False))


def basename(path: Column) -> Column:
    """A path's last part; slashes at its end do not count."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def parsed_json(text: Column, schema: str) -> Column:
    """JSON as the schema says; null where the text is none."""
    return F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, schema))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and one space after signs; null where the text is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for t in texts:
            try:
                out.append(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True) if isinstance(t, str) else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def preview(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def redact_paths(text: Column) -> Column:
    """Each local path becomes its last part in a mark; of a path that ends in slashes the part before them."""
    inner = r"""/Users/(?:[^\s"',;)/]*/+)*([^\s"',;)/]+)/*(?=[\s"',;)]|$)"""
    return F.regexp_replace(text, inner, "[redacted-local-path:$1]")


def _redact(value: str) -> str:
    return re.sub(LOCAL_PATH, lambda m: f"[redacted-local-path:{m.group().rstrip('/').rsplit('/', 1)[-1]}]", value)


@dataclass(frozen=True)
class Rule:
    """Strings for which ``applies(lower-case key, string, strict)`` holds become a record of the reason, what ``keeps`` tells, and a hash."""

    reason: str
    applies: Callable[[str, str, bool], bool]
    keeps: Callable[[str], dict[str, Any]]

    def record(self, value: str) -> dict[str, Any]:
        return {"redacted": True, "reason": self.reason, **self.keeps(value), "sha256": hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()}


def _last_part(path: str) -> str | None:
    return posixpath.basename(path.rstrip("/")) if "/" in path else None


#: The first rule that applies decides; reasons are fixed values.
RULES = (
    Rule("local filesystem path removed", lambda key, value, strict: any(k in key for k in PATH_KEYS), lambda value: {"basename": _last_part(value)}),
    Rule("raw source/context body omitted from publication-safe export", lambda key, value, strict: strict and (len(_redact(value)) > LONG_TEXT or any(k in key for k in TEXT_KEYS)), lambda value: {"char_count": len(value)}),
)


def _published(key: str, value: Any, strict: bool) -> Any:
    """What a member's value becomes: strings by the rules, lists string by string; records inside were met before."""
    if isinstance(value, list):
        return [_published(key, x, strict) for x in value]
    if not isinstance(value, str):
        return value
    low = key.lower()
    return next((r.record(value) for r in RULES if r.applies(low, value, strict)), None) or _redact(value)


def sanitized(text: str, strict: bool) -> Any:
    """JSON text read with every object's members published as the parser closes it, innermost first."""
    return _published("", json.loads(text, object_pairs_hook=lambda members: {k: _published(k, v, strict) for k, v in members}), strict)


def sanitize(value: Any, strict: bool) -> Any:
    """The same of a value that JSON can hold."""
    return sanitized(json.dumps(value), strict)


def sanitize_json(text: Column, strict: bool = False) -> Column:
    """Sanitized JSON with sorted keys; what isn't JSON (or is null) is redacted as plain text; null stays null."""

    def one(text: str) -> str:
        with suppress(ValueError):
            if (clean := sanitized(text, strict)) is not None:
                return json.dumps(clean, ensure_ascii=False, sort_keys=True)
        return _redact(text)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return run(text)
