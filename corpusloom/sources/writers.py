"""Sinks: JSON, JSON lines, write-once tables, manifests, CSV, Markdown, locks."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(path: str | Path, value: object) -> None:
    """Sorted keys, two spaces, a final line break, no escapes: one byte sequence per value."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n", encoding="utf-8")


def write_jsonl(rows: DataFrame, path: str, order: list[Column], single: bool = False) -> None:
    """Compact JSON lines in a total order; ``single`` for a release small enough for one file."""
    ordered = rows.orderBy(*order).select(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))
    (ordered.coalesce(1) if single else ordered).write.mode("errorifexists").text(path)


def write_once(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet at a path that must not exist."""
    w = rows.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def require_absent(path: str | Path) -> Path:
    if Path(path).exists():
        raise FileExistsError(str(path))
    return Path(path)


def consume_once(lock: str | Path) -> None:
    """Create a lock file exclusively; a second call raises FileExistsError."""
    with open(lock, "x", encoding="utf-8") as f:
        f.write("consumed\n")


def digests(spark, path: str) -> DataFrame:
    """path, digest of every file below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def write_manifest(root: str | Path, name: str = "SHA256SUMS") -> Path:
    """"digest, two spaces, path" of every file below root but the manifest, sorted; files are read in parts."""
    root, out = Path(root), []
    for p in sorted(x for x in root.rglob("*") if x.is_file() and x.name != name and not x.name.startswith(".")):
        with p.open("rb") as f:
            out.append(f"{hashlib.file_digest(f, 'sha256').hexdigest()}  {p.relative_to(root).as_posix()}\n")
    (root / name).write_text("".join(out), encoding="utf-8")
    return root / name


def read_manifest(path: str | Path) -> dict[str, str]:
    return {p: d for d, p in (line.rstrip("\n").split("  ", 1) for line in Path(path).read_text("utf-8").splitlines() if line)}


def verify_manifest(root: str | Path, name: str = "SHA256SUMS") -> dict[str, list[str]]:
    """missing, extra and mismatched paths."""
    root = Path(root)
    known = read_manifest(root / name)
    there = {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("*") if p.is_file() and p.name != name and not p.name.startswith(".")}
    return {"missing": sorted(known.keys() - there.keys()), "extra": sorted(there.keys() - known.keys()), "mismatched": sorted(k for k in known.keys() & there.keys() if known[k] != there[k])}


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    rows.select(*fields).write.mode("errorifexists").csv(path, header=True)


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A report table of small aggregates; more than ``most`` rows raise."""
    cells = rows.limit(most + 1).collect()
    if len(cells) > most:
        raise ValueError("a report table is for aggregates")
    out = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(out + ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", "<br>") for v in r) + " |" for r in cells]) + "\n"


def promote(source: str | Path, target: str | Path, manifest: str = "SHA256SUMS") -> None:
    """Copy a verified release to a new place, verify the copy, make it read-only."""
    import shutil

    if any(verify_manifest(source, manifest).values()):
        raise ValueError("the source differs from its manifest")
    require_absent(target)
    shutil.copytree(source, target)
    if any(verify_manifest(target, manifest).values()):
        raise ValueError("the copy differs from its manifest")
    for p in Path(target).rglob("*"):
        if p.is_file():
            p.chmod(0o444)
