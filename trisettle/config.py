"""Thresholds of a run, frozen."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    auto_threshold: str = "0.94"
    tolerance_abs_paise: int = 100
    #: A fraction, as decimal text.
    tolerance_pct: str = "0.0005"
    rounding_drift_paise: int = 1
    max_subset_n: int = 40
    dispute_window_days: int = 30
    missing_in_bank_sla_days: int = 2
    max_rechecks: int = 3
    recheck_interval_days: int = 2
    typed_confirm_paise: int = 5_000_000
    bank_ledger_names: tuple[str, ...] = ("Main Bank",)


DEFAULT = Config()
