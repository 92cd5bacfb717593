"""Parameters in layers, and the strict run configuration."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields


class Params:
    """Named values, local over global; typed on access."""

    def __init__(self, *layers: dict):
        self.values: dict = {}
        for layer in layers:
            self.values |= {k.lower(): v for k, v in (layer or {}).items() if v is not None}

    def scalar(self, name: str, default: float | None = None) -> float:
        value = self.values.get(name.lower(), default)
        if value is None:
            raise KeyError(name)
        value = value[0] if isinstance(value, (list, tuple)) else value
        return float(value)

    def text(self, name: str, default: str = "") -> str:
        return str(self.values.get(name.lower(), default)).strip().lower()

    def flag(self, name: str, default: bool = False) -> bool:
        value = self.text(name, "y" if default else "n")
        if value not in ("y", "n", "yes", "no", "true", "false", "1", "0", "1.0", "0.0"):
            raise ValueError(f"{name} must be y or n")
        return value in ("y", "yes", "true", "1", "1.0")

    def vector(self, name: str) -> list[float]:
        value = self.values.get(name.lower(), [])
        return [float(v) for v in (value if isinstance(value, (list, tuple)) else [value])]

    def indices(self, name: str) -> list[int]:
        """One-based positions as zero-based; zeros and NaN name nothing."""
        return sorted({int(v) - 1 for v in self.vector(name) if math.isfinite(v) and v >= 1})


#: Branches that are refused, by parameter: what value they would need.
REFUSED = {"small_baseline_flag": "n", "unwrap_patch_phase": "n", "unwrap_hold_good_values": "n", "subtr_tropo": "n", "scn_kriging_flag": "n"}


def refuse(params: Params) -> None:
    for name, value in REFUSED.items():
        if params.text(name, value) != value:
            raise ValueError(f"{name}={params.text(name)} is not supported")
    if params.text("scla_method", "l2") != "l2":
        raise ValueError("scla_method must be L2")
    if params.scalar("merge_resample_size", 0) != 0:
        raise ValueError("merge_resample_size must be 0")
    if params.text("unwrap_method", "3d") not in ("3d", "3d_quick"):
        raise ValueError("unwrap_method must be 3D")


@dataclass(frozen=True)
class RunConfig:
    root: str
    start_step: int = 1
    end_step: int = 8
    resume: bool = True
    dry_run: bool = False
    grid_scale: float = 1.0
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.start_step <= self.end_step <= 8:
            raise ValueError("steps go from 1 to 8")
        if not 1 <= self.grid_scale <= 20:
            raise ValueError("grid_scale goes from 1 to 20")

    @classmethod
    def parse(cls, text: str) -> RunConfig:
        """JSON, or YAML where that library is there; unknown fields are refused."""
        try:
            values = json.loads(text)
        except ValueError:
            import yaml

            values = yaml.safe_load(text)
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return cls(**values)
