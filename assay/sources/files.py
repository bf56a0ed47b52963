"""Small results to files: JSON, CSV, Markdown, SVG, gzip with a hash; and key-value and JSON scans."""

from __future__ import annotations

import csv
import gzip
import hashlib
import json
import math
import shutil
import subprocess
from html import escape
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(value: Any, places: int = 4) -> Any:
    """Python's rounding of the exact binary value, half to even; NaN and infinities become null."""
    if isinstance(value, float):
        return round(value, places) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: rounded(v, places) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [rounded(v, places) for v in value]
    return value


def rows(df: DataFrame, most: int = 100_000) -> list[dict]:
    """A small result's rows; more than ``most`` is an error, not a sample."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write them with df.write")
    return [r.asDict(recursive=True) for r in got]


def write_json(path: str | Path, bundle: Any, sort_keys: bool = True) -> None:
    Path(path).write_text(json.dumps(bundle, indent=2, sort_keys=sort_keys, ensure_ascii=False) + "\n")


def write_csv(path: str | Path, records: list[dict], fields: list[str] | None = None) -> None:
    """Without fields those of the first record; no record and no fields make an empty file."""
    names = fields or (list(records[0]) if records else [])
    with open(path, "w", newline="") as f:
        if names:
            out = csv.DictWriter(f, names, extrasaction="ignore", lineterminator="\n")
            out.writeheader()
            out.writerows(records)


def read_key_values(df: DataFrame, key: str = "key", value: str = "value") -> dict[str, str]:
    got = df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value).cast("string")))).alias("m")).first()
    return got.m or {}


def read_json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object {name: record} as rows (name, record's fields)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>"))).select(F.col("key").alias("name"), "value.*")


def markdown_table(records: list[dict], fields: list[str] | None = None) -> str:
    names = fields or (list(records[0]) if records else [])
    said = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(said(r.get(n)) for n in names) + " |" for r in records])


def markdown_report(title: str, sections: dict[str, list[dict]], notes: dict[str, str] | None = None) -> str:
    parts = [f"# {title}"]
    for name, records in sections.items():
        parts += [f"## {name}", (notes or {}).get(name, ""), markdown_table(records) if records else "No rows."]
    return "\n\n".join(p for p in parts if p) + "\n"


def _scale(low: float, high: float, a: float, b: float):
    return lambda v: a + (v - low) / ((high - low) or 1) * (b - a)


def scatter_svg(points: list[tuple[str, float, float]], line: tuple[float, float] | None = None, title: str = "", width: int = 640, height: int = 400) -> str:
    """Labelled points and, given (slope, intercept), a trend line."""
    xs, ys = [p[1] for p in points] or [0, 1], [p[2] for p in points] or [0, 1]
    sx, sy = _scale(min(xs), max(xs), 50, width - 20), _scale(min(ys), max(ys), height - 40, 30)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{escape(title)}</title>']
    if line:
        (a, b), x0, x1 = line, min(xs), max(xs)
        out.append(f'<line x1="{sx(x0):.1f}" y1="{sy(a * x0 + b):.1f}" x2="{sx(x1):.1f}" y2="{sy(a * x1 + b):.1f}" stroke="gray"/>')
    for name, x, y in points:
        out.append(f'<circle cx="{sx(x):.1f}" cy="{sy(y):.1f}" r="4"/><text x="{sx(x) + 6:.1f}" y="{sy(y):.1f}" font-size="10">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def bar_svg(bars: list[tuple[str, float]], title: str = "", width: int = 640, bar: int = 18) -> str:
    """Horizontal bars from 0, to either side."""
    low, high = min([0.0, *(v for _, v in bars)]), max([0.0, *(v for _, v in bars)])
    sx = _scale(low, high, 160, width - 60)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{bar * len(bars) + 30}"><title>{escape(title)}</title>']
    for i, (name, v) in enumerate(bars):
        y, a, b = 20 + i * bar, *sorted((sx(0), sx(v)))
        out.append(f'<text x="4" y="{y + bar - 6}" font-size="10">{escape(name)}</text><rect x="{a:.1f}" y="{y}" width="{b - a:.1f}" height="{bar - 4}"/><text x="{b + 4:.1f}" y="{y + bar - 6}" font-size="10">{v:.3f}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def file_sha256(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def gzip_file(path: str | Path) -> tuple[Path, str]:
    """The packed file (level 9, no time stamp) and its hash."""
    to = Path(f"{path}.gz")
    with open(path, "rb") as f, open(to, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", compresslevel=9, mtime=0) as out:
        shutil.copyfileobj(f, out)
    return to, file_sha256(to)


def git_state(folder: str = ".") -> dict[str, str | bool | None]:
    def run(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    changed = run("status", "--porcelain")
    return {"commit": run("rev-parse", "HEAD"), "changed": None if changed is None else bool(changed)}
