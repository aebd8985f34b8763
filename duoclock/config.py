"""Settings of an analysis; months are counted as year * 12 + month - 1."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DelayConfig:
    """Cohorts t0..cutoff, delays 0..max_delay; all windows count months and include both ends."""

    t0: int = 1995 * 12
    cutoff: int = 2026 * 12 + 5
    max_delay: int = 36
    window: int = 60
    short_window: int = 24
    max_lag: int = 24
    day_cap: int = 3650
    channels: tuple[str, ...] = ("VOQ", "EVOQ", "IVOQ", "MAVQ")
    eras: tuple[tuple[int, int], ...] = ((1995, 2004), (2005, 2014), (2015, 2023))
    horizons: tuple[int, ...] = (1, 3, 6, 12, 24)
    first_origin: int = 2018 * 12
    last_origin: int = 2023 * 12 + 5
    last_training_origin: int = 2020 * 12 + 11
    top_families: int = 8
    min_group: int = 100
    draws: int = 500
    seed: int = 41
    base_years: int = 5
    z_threshold: float = 3.0
    min_stream_rows: int = 60
    min_stream_peak: int = 30
    peak_months: int = 24
    burst_count: int = 20
    burst_ratio: float = 10.0
    days_per_month: float = 30.44

    @property
    def mature_until(self) -> int:
        return self.cutoff - self.max_delay


#: Fits the driver's order tables, which hold 80 cohorts and few records a stream: at the bars above no stream would be judged.
ORDERS = DelayConfig(
    t0=1995 * 12, cutoff=2001 * 12 + 7, max_delay=12, window=24, short_window=12, max_lag=12,
    channels=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), eras=((1995, 1996), (1997, 1998), (1999, 2000)), horizons=(1, 3, 6, 12),
    first_origin=1998 * 12, last_origin=2000 * 12 + 7, last_training_origin=1999 * 12 + 5, draws=200, burst_count=8, burst_ratio=3.0,
    z_threshold=1.5, min_stream_rows=30, min_stream_peak=10,
)
