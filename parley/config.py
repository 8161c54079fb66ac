from __future__ import annotations

from dataclasses import dataclass

# The synthetic "root" parent id used by chat exports.
SENTINEL_ROOT = "00000000-0000-4000-8000-000000000000"


@dataclass(frozen=True)
class Config:
    """Report configuration.

    tz               wall-clock zone for hour / weekday / local month columns.
    approx_quantiles use percentile_approx instead of exact quantiles (opt-in, inexact).
    approx_accuracy  accuracy parameter of percentile_approx.
    quantile_mode    "bounded": bounded-memory exact quantiles (sketch bracket + exact pass), the
                     same plan at every size; "exact": Spark's `percentile`, whose map of values
                     is merged in one task (for comparison on small data).
    bounded_accuracy sketch accuracy of the bounded exact mode.
    quantile_levels  narrowing passes for groups too large for one sketch; none is run below
                     5 * 10^9 rows a group, whatever the number.
    approx_distinct  approx_count_distinct (HyperLogLog++) for the distinct totals of m11
                     (opt-in, inexact; exact counts by default).
    fanout_m07       reproduce the attachment x file join fan-out of the monthly counts.
    merge_by_name    group the m13 top-3 lists by (name, message_count) instead of id.
    window_chunk_rows  conversations above this many rows are split into ordered chunks for
                     lag / rank / next-row windows (hot-key protection).
    """

    tz: str = "Europe/Istanbul"
    approx_quantiles: bool = False
    approx_accuracy: int = 100000
    quantile_mode: str = "bounded"
    bounded_accuracy: int = 10000
    quantile_levels: int = 1
    approx_distinct: bool = False
    fanout_m07: bool = False
    merge_by_name: bool = False
    window_chunk_rows: int = 2_000_000

    def __post_init__(self):
        if self.quantile_mode not in ("exact", "bounded"):
            raise ValueError(f"quantile_mode must be exact or bounded, not {self.quantile_mode!r}")
        for name in ("approx_accuracy", "bounded_accuracy", "window_chunk_rows"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
