"""Paths on the driver's side: file discovery, patterns and names."""

from __future__ import annotations

import glob
import re
from pathlib import Path


def json_files(path: str) -> list[str]:
    """The file itself if it ends in .json or .jsonl; of a folder all .jsonl below it, then all .json, each in order."""
    at = Path(path)
    if at.is_file():
        return [str(at)] if at.suffix in (".json", ".jsonl") else []
    return [str(p) for suffix in ("jsonl", "json") for p in sorted(at.rglob(f"*.{suffix}"))]


def expand(patterns: list[str], base: str) -> list[str]:
    """Distinct files that match any pattern, relative ones below base, in order; ValueError if there is none."""
    found: set[Path] = set()
    for pattern in patterns:
        own = pattern if Path(pattern).is_absolute() else str(Path(base) / pattern)
        found |= {Path(m).resolve() for m in glob.glob(own, recursive=True)}
    files = sorted(str(p) for p in found if p.is_file())
    if not files:
        raise ValueError(f"no file matches {patterns}")
    return files


def shown(path: str, base: str) -> str:
    """The path below base, or as it is outside of it."""
    at = Path(path)
    return at.relative_to(base).as_posix() if at.is_relative_to(base) else str(at)


def next_shard(folder: str, split: str) -> int:
    """The number after the last of {split}_*.bin; 0 without any."""
    numbers = [int(m[1]) for p in Path(folder).glob(f"{split}_*.bin") if (m := re.fullmatch(rf"{re.escape(split)}_(\d+)\.bin", p.name))]
    return max(numbers, default=-1) + 1
