"""Run parameters with their permitted ranges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

# Permitted range of each numeric parameter.
RANGES = {
    "lookback_days": (1, 365),
    "relevance_threshold": (0.0, 1.0),
    "min_paragraph_length": (10, 1000),
}

# Parameters without an upper limit; a cap may be off (None).
AT_LEAST_ONE = (
    "scoring_concurrency", "requests_per_call", "calls_per_task", "calls_in_flight", "max_issues_per_run", "max_listing_pages")

DEDUP_KEYS = {
    "anchor": ("issue_number", "anchor"),
    "content_hash": ("issue_number", "content_hash"),
}


@dataclass(frozen=True)
class MonitorConfig:
    lookback_days: int = 30
    relevance_threshold: float = 0.50
    # No cap: all issues of the window. With one, the rest stays open for the next run.
    max_issues_per_run: int | None = None
    min_paragraph_length: int = 30
    scoring_concurrency: int = 5
    # Requests a scorer is given at once, and model calls a lost task repeats at most.
    requests_per_call: int = 64
    calls_per_task: int = 10_000
    # Model calls that each of the `scoring_concurrency` tasks has under way.
    calls_in_flight: int = 1
    keyword_filter_enabled: bool = True
    base_url: str = "https://magyarkozlony.hu"
    max_listing_pages: int | None = None
    # Which columns say "this was reported before".
    dedup_key: str = "anchor"
    # Drop repeats of a key inside one run, not only against earlier runs.
    dedupe_within_batch: bool = False
    # Look the key up before the model call. False gives the order
    # score -> dedupe, whose counters include rows that are dropped later.
    dedupe_before_scoring: bool = True
    # How long an issue that could not be finished waits; doubled with every attempt, up to a day.
    retry_after: timedelta = timedelta(0)
    subject_prefix: str = "[HR riport]"
    email_from: str = "monitor@localhost"
    email_to: str = "you@example.com"
    report_name: str = "report"
    product_name: str = "lawtide"
    # The report as attached files with a cover text, or as the message itself.
    attachment: bool = True
    html_attachment: bool = True

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is outside {low}..{high}")
        for name in AT_LEAST_ONE:
            value = getattr(self, name)
            if value is not None and value < 1:
                raise ValueError(f"{name}={value} is less than 1")
        if self.dedup_key not in DEDUP_KEYS:
            raise ValueError(f"dedup_key={self.dedup_key!r}, expected one of {sorted(DEDUP_KEYS)}")

    @property
    def key_columns(self) -> list[str]:
        return list(DEDUP_KEYS[self.dedup_key])
