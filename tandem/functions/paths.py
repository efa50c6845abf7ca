"""Column functions over path names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names that mark a broad change.
BROAD_NAMES = (
    "Cargo.lock", "Cargo.toml", "package-lock.json", "package.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock", "uv.lock",
    "README.md", "CHANGELOG.md", "rust-toolchain.toml",
)
BROAD_FOLDER = ".github/workflows/"


def normalised(path: Column) -> Column:
    """Without empty and `.` components."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"(?s)/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Text after the basename's last dot; null if there is none."""
    found = F.regexp_extract(path, r"(?s)\.([^./]+)$", 1)
    return F.when(found != "", found)


def tokens(path: Column) -> Column:
    """array<struct<token,weight>>: name parts by count, the folder with weight 3, the extension with 0.5."""
    low = F.lower(path)
    parts = F.filter(F.split(low, "[^a-z0-9]+"), lambda p: F.length(p) >= 2)
    counted = F.transform(F.array_distinct(parts), lambda t: F.struct(t.alias("token"), F.size(F.filter(parts, lambda p: p == t)).cast("double").alias("weight")))
    folder, ext = dirname(low), extension(low)

    def extra(keep: Column, token: Column, weight: float) -> Column:
        made = F.array(F.struct(token.alias("token"), F.lit(weight).alias("weight")))
        return F.when(keep, made).otherwise(F.array().cast("array<struct<token:string,weight:double>>"))

    return F.concat(counted, extra(folder != ".", F.concat(F.lit("dir:"), folder), 3.0), extra(ext.isNotNull(), F.concat(F.lit("ext:"), ext), 0.5))


def matches_pattern(path: Column, pattern: str) -> Column:
    """A pattern without `*` equals the path, its end behind a slash, or its basename; `*` spans anything, slashes too."""
    name = basename(path)
    if "*" not in pattern:
        return (path == pattern) | path.endswith("/" + pattern) | (name == pattern)
    whole = "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
    return path.rlike(whole) | name.rlike(whole)


def excluded(path: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | matches_pattern(path, pattern)
    return out


def is_broad(path: Column) -> Column:
    """Lock files, manifests, release documents and workflow files."""
    return basename(path).isin(*BROAD_NAMES) | path.startswith(BROAD_FOLDER)
