"""Default parameters of the operators, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    fs: int = 256
    window_s: float = 10.0
    step_s: float = 2.5
    label_share: float = 0.60
    var_order: int = 5
    resolution: int = 256
    bands: tuple = (("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 45.0))
    channels: int = 18
    threshold: float = 0.0
    k: int = 3
    k_sweep: tuple = (2, 3, 4)
    before_s: float = 30.0
    after_s: float = 60.0
    merge_gap_s: float = 90.0
    max_event_s: float = 300.0
    budget: int = 10_000
    strata: int = 50
    weight_power: float = 0.5
    imag_tolerance: float = 1e-6
    mrmr_floor: float = 1e-3
    strong_d: float = 0.8
    strong_auc: float = 0.2
    folds: int = 5
    seed: int = 42

    @property
    def window(self) -> int:
        return int(self.window_s * self.fs)

    @property
    def step(self) -> int:
        return int(self.step_s * self.fs)


DEFAULT = Config()
