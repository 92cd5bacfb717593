"""Kernels by name, with aliases and a fall-back, and their registration as SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scatterlake.operators import fit


class Kernels:
    def __init__(self):
        self._known: dict[str, dict[str, Callable]] = {}
        self._alias: dict[str, str] = {}

    def add(self, name: str, kernel: Callable, provider: str = "numpy", *aliases: str) -> None:
        self._known.setdefault(name, {})[provider] = kernel
        self._alias |= dict.fromkeys(aliases, name)

    def get(self, name: str, provider: str | None = None) -> Callable:
        """The provider's kernel, else any other's; unknown names are an error."""
        name = self._alias.get(name, name)
        if name not in self._known:
            raise KeyError(f"no kernel {name}; known: {sorted(self._known)}")
        kernels = self._known[name]
        return kernels.get(provider) or next(iter(kernels.values()))

    def describe(self) -> list[tuple[str, str]]:
        return sorted((n, p) for n, ps in self._known.items() for p in ps)


def default_kernels() -> Kernels:
    from scatterlake.operators import spacetime, spectral, unwrap, weed

    k = Kernels()
    for name, f in {
        "topofit": fit.fit_rows, "random_histogram": fit.random_histogram, "psquare": fit.psquare_weights, "clap": spectral.clap, "goldstein": spectral.goldstein, "delaunay": weed.delaunay,
        "edge_noise": weed.temporal_noise, "adjacent": weed.adjacent_groups, "smooth_series": spacetime.smooth_series, "edge_slopes": spacetime.edge_slopes, "unwrap": unwrap.unwrap_grid,
    }.items():
        k.add(name, f)
    return k


def register_sql(spark: SparkSession) -> None:
    """wrap_phase(angle), phase_fit(re, im, bperp, wraps): usable from SQL text."""

    @F.pandas_udf("k double, c double, coh double")
    def phase_fit(re: pd.Series, im: pd.Series, bperp: pd.Series, wraps: pd.Series) -> pd.DataFrame:
        out = [fit.fit_rows(a + 1j * b, x, w)[:3] for a, b, x, w in zip(re, im, bperp, wraps, strict=True)]
        return pd.DataFrame([[float(v[0]) for v in o] for o in out], columns=["k", "c", "coh"])

    spark.udf.register("phase_fit", phase_fit)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION wrap_phase(angle DOUBLE) RETURNS DOUBLE RETURN pmod(angle + pi(), 2 * pi()) - pi()")
