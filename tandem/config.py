"""Defaults and options that shape every result."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

# Fixed values of the data contract.
MAX_ITEMS = 80
MAX_BASKETS = 1000
HALF_LIFE_DAYS = 365.0
TOP = 20
AUDIT_TOP = 5
TEST_BASKETS, TRAIN_BASKETS = 200, 1000
MEDIUM_FROM, HIGH_FROM = 2, 25
ALPHA, STEPS = 0.85, 30
MODES = ("direct", "pagerank", "path", "hot")
BANDS = ("low", "medium", "high")
#: History backends, each with its other names; `fast` and `exact` accuracy stand for two of them.
BACKENDS = {
    "hybrid": ("git-gix", "gix-git"), "gix": ("gitoxide",), "git": ("git-cli", "cli"), "git-remove-empty": ("remove-empty",), "git-batch": ("batch",),
    "git-batch-parallel": ("batch-parallel",), "git-diff-tree": ("diff-tree",), "git-diff-tree-parallel": ("diff-tree-parallel",), "git-rev-list": ("rev-list",),
    "pack-fast": ("pack", "git-pack", "pack-auto"), "pack-scan": ("pack-full", "pack-walk"),
}
ACCURACY = {"fast": "pack-fast", "exact": "git"}
EXIT_OK, EXIT_ERROR, EXIT_FINDINGS = 0, 1, 3


class UsageError(ValueError):
    """An option that no query accepts."""


@dataclass(frozen=True)
class Options:
    """One query's options; `max_baskets` 0 is unlimited, `since` is epoch seconds or None."""

    max_items: int = MAX_ITEMS
    max_baskets: int = MAX_BASKETS
    half_life_days: float = HALF_LIFE_DAYS
    evidence: int = 0
    since: int | None = None
    top: int = TOP
    mode: str = "direct"
    exclude: tuple[str, ...] = ()
    min_confidence: str = "medium"
    fail_on_confidence: str | None = None
    backend: str = "pack-fast"
    scan_commits: int = 0
    jobs: int = 1

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise UsageError(f"unknown history backend {self.backend!r}; use {', '.join(BACKENDS)}")
        if self.jobs <= 0:
            raise UsageError("jobs must be positive")
        if min(self.scan_commits, self.max_baskets, self.evidence) < 0:
            raise UsageError("scan_commits, max_baskets and evidence must not be negative")
        if self.mode not in MODES:
            raise UsageError(f"mode must be one of {', '.join(MODES)}, got {self.mode!r}")
        for band in (self.min_confidence, self.fail_on_confidence or "high"):
            if band not in BANDS:
                raise UsageError(f"confidence must be one of {', '.join(BANDS)}, got {band!r}")
        if self.fail_on_confidence and BANDS.index(self.fail_on_confidence) < BANDS.index(self.min_confidence):
            raise UsageError("the enforced confidence must not be below the minimum confidence")
        if self.max_items <= 0:
            raise UsageError("max_items must be positive")
        if not (math.isfinite(self.half_life_days) and self.half_life_days > 0):
            raise UsageError("half_life_days must be finite and positive")

    def but(self, **changes) -> Options:
        return replace(self, **changes)

    @property
    def query_top(self) -> int | None:
        """Rows a query keeps before exclusion: all of them if something is to be excluded."""
        return None if self.exclude else self.top


def backend_of(accuracy: str | None, backend: str | None) -> str:
    """The backend that either option names; both together are an error."""
    if accuracy and backend:
        raise UsageError("accuracy and history-backend exclude each other")
    if accuracy and accuracy not in ACCURACY:
        raise UsageError(f"unknown accuracy {accuracy!r}; use {', '.join(ACCURACY)}")
    named = ACCURACY[accuracy] if accuracy else backend or "pack-fast"
    return next((name for name, others in BACKENDS.items() if named == name or named in others), named)


def seed_budget(top: int) -> int:
    """Candidates kept for each seed of an audit, before the eligibility filter."""
    return max(64, 8 * top)


def parse_excludes(text: str | None) -> tuple[str, ...]:
    return tuple(p for p in (x.strip() for x in (text or "").split(",")) if p)
