"""Adaptive spectral filters of complex grids, one patch and interferogram a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def low_pass_response(size: int, cell: float, wavelength: float, order: int = 5) -> np.ndarray:
    """Separable Butterworth response in FFT order."""
    f = np.fft.fftfreq(size, cell)
    one = 1 / (1 + (np.abs(f) * wavelength) ** (2 * order))
    return np.outer(one, one)


def gaussian_kernel(size: int = 7, alpha: float = 2.5) -> np.ndarray:
    half = (size - 1) / 2
    g = np.exp(-0.5 * (alpha * (np.arange(size) - half) / half) ** 2)
    return np.outer(g, g)


def _kernel(window: int) -> np.ndarray:
    """Seven taps, fewer in windows that don't hold them."""
    return gaussian_kernel(min(7, window - 1 + window % 2))


def smooth(spectrum: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Cyclic smoothing of a centred magnitude spectrum, by the transform itself."""
    pad = np.zeros_like(spectrum)
    k = kernel.shape[0]
    pad[:k, :k] = kernel
    pad = np.roll(pad, (-(k // 2), -(k // 2)), (0, 1))
    return np.fft.ifft2(np.fft.fft2(spectrum) * np.fft.fft2(pad)).real


def clap_window(z: np.ndarray, alpha: float, beta: float, low: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Combined low-pass and adaptive phase filter of one window."""
    f = np.fft.fft2(z)
    h = smooth(np.abs(f), kernel)
    middle = np.median(h)
    h = h / middle if middle else h
    h = np.maximum(h**alpha - 1, 0)
    return np.fft.ifft2(f * (h * beta + low))


def goldstein_window(z: np.ndarray, alpha: float, kernel: np.ndarray) -> np.ndarray:
    f = np.fft.fft2(z)
    h = smooth(np.abs(f), kernel)
    middle = np.median(h)
    h = h / middle if middle else h
    return np.fft.ifft2(f * np.maximum(h, 0) ** alpha)


def window_weight(size: int, floor: float = 1e-6) -> np.ndarray:
    up = np.minimum(np.arange(size) + 1, size - np.arange(size)).astype(float)
    return np.outer(up, up) / up.max() ** 2 + floor


def filtered(grid: np.ndarray, size: int, step: int, window, weight: np.ndarray) -> np.ndarray:
    """Weighted overlap of filtered windows; the last ones are moved back to the edge; grids under a window give zeros."""
    rows, cols = grid.shape
    out, total = np.zeros_like(grid, complex), np.zeros(grid.shape)
    if rows < size or cols < size:
        return out
    starts = [sorted({*range(0, n - size + 1, step), n - size}) for n in grid.shape]
    for i in starts[0]:
        for j in starts[1]:
            out[i : i + size, j : j + size] += window(grid[i : i + size, j : j + size]) * weight
            total[i : i + size, j : j + size] += weight
    return out / np.where(total > 0, total, 1)


def clap(grid: np.ndarray, size: int = 32, alpha: float = 1.0, beta: float = 0.3, cell: float = 50.0, wavelength: float = 800.0) -> np.ndarray:
    low, kernel = low_pass_response(size, cell, wavelength), _kernel(size)
    return filtered(np.nan_to_num(grid), size, max(1, size // 4), lambda z: clap_window(z, alpha, beta, low, kernel), window_weight(size))


def goldstein(grid: np.ndarray, size: int = 32, alpha: float = 0.8, keep_amplitude: bool = True, low_pass: bool = False, cell: float = 50.0, wavelength: float = 800.0):
    """Adaptive filter whose result keeps the input's amplitude; optionally with the low-pass of the grid."""
    if min(grid.shape) < size:
        raise ValueError("the grid is smaller than a window")
    kernel = _kernel(size)
    out = filtered(np.nan_to_num(grid), size, max(1, size // 2), lambda z: goldstein_window(z, alpha, kernel), window_weight(size, 2.0 / size))
    if keep_amplitude:
        out = np.abs(grid) * np.exp(1j * np.angle(out)) * (grid != 0)
    if not low_pass:
        return out
    response = low_pass_response(size, cell, wavelength)
    return out, filtered(np.nan_to_num(grid), size, max(1, size // 2), lambda z: np.fft.ifft2(np.fft.fft2(z) * response), window_weight(size))


def without_own_cell(grid: np.ndarray, at: tuple[int, int], size: int, **how) -> complex:
    """Filtered value at a cell of the window around it, the cell itself emptied; 0 if the grid is smaller than a window."""
    if min(grid.shape) < size:
        return 0j
    i, j = (min(max(0, a - size // 2), max(0, n - size)) for a, n in zip(at, grid.shape, strict=True))
    z = grid[i : i + size, j : j + size].copy()
    a, b = at[0] - i, at[1] - j
    z[a, b] = 0
    low, kernel = low_pass_response(size, how.get("cell", 50.0), how.get("wavelength", 800.0)), _kernel(size)
    return complex(clap_window(z, how.get("alpha", 1.0), how.get("beta", 0.3), low, kernel)[a, b])


def filter_stack(cells: DataFrame, kind: str = "clap", size: int = 8, **how) -> DataFrame:
    """(patch_id, ifg_ix, gi, gj, re, im) filtered plane by plane; parallel over patches and interferograms."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["gi"].to_numpy(), p["gj"].to_numpy()
        n, m = max(size, i.max() + 1), max(size, j.max() + 1)
        grid = np.zeros((n, m), complex)
        grid[i, j] = p["re"].to_numpy() + 1j * p["im"].to_numpy()
        out = (clap if kind == "clap" else goldstein)(grid, size, **how)
        return p[["patch_id", "ifg_ix", "gi", "gj"]].assign(re=out[i, j].real, im=out[i, j].imag)

    return cells.groupBy("patch_id", "ifg_ix").applyInPandas(run, "patch_id int, ifg_ix long, gi int, gj int, re double, im double")


def without_own_cells(cells: DataFrame, wanted: DataFrame, size: int = 8, **how) -> DataFrame:
    """(patch_id, ifg_ix, gi, gj, re, im) of the wanted cells (patch_id, gi, gj), each refiltered in its window without itself; a patch and a date are a group."""
    marked = cells.join(wanted.select("patch_id", "gi", "gj").distinct().withColumn("wanted", F.lit(True)), ["patch_id", "gi", "gj"], "left")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((p["gi"].max() + 1, p["gj"].max() + 1), complex)
        grid[p["gi"], p["gj"]] = p["re"] + 1j * p["im"]
        asked = p[p["wanted"].notna()]
        z = np.array([without_own_cell(grid, (int(i), int(j)), size, **how) for i, j in zip(asked["gi"], asked["gj"], strict=True)], complex)
        return asked[["patch_id", "ifg_ix", "gi", "gj"]].assign(re=z.real, im=z.imag)

    return marked.groupBy("patch_id", "ifg_ix").applyInPandas(run, "patch_id int, ifg_ix long, gi int, gj int, re double, im double")
