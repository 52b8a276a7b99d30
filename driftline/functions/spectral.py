"""The three small numeric kernels that have no built-in form, as Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = 8


def eigenvalues(triangles: np.ndarray, size: int, top: int = 5) -> np.ndarray:
    """`top_eigenvalues` of matrices given by a row of cells each."""
    upper = np.triu_indices(size)
    tri = np.nan_to_num(triangles)
    m = np.zeros((len(tri), size, size))
    m[:, upper[0], upper[1]] = tri
    m[:, upper[1], upper[0]] = tri
    eig = np.linalg.eigvalsh(m)[:, ::-1][:, :top]
    return np.pad(eig, ((0, 0), (0, max(0, top - size))))


def top_eigenvalues(cells: Sequence[Column | str], size: int, top: int = 5) -> Column:
    """Largest eigenvalues, descending, zero-padded, of a matrix given by its upper triangle row by row."""
    @F.pandas_udf("array<double>")
    def values(flat: pd.Series) -> pd.Series:
        if not len(flat):
            return pd.Series([], dtype=object)
        return pd.Series(list(eigenvalues(np.stack([np.asarray(v, dtype=float) for v in flat]), size, top)))

    return values(F.array(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) for c in cells]))


def band_energies(signal: Column, bands: int = BANDS) -> Column:
    """log10(energy + 1) in equal-width bands of the one-sided spectrum."""

    @F.pandas_udf("array<double>")
    def energies(batch: pd.Series) -> pd.Series:
        out = []
        for v in batch:
            power = np.abs(np.fft.rfft(np.asarray(v, dtype=float))) ** 2
            edges = np.linspace(0, len(power), bands + 1, dtype=int)
            out.append(np.log10(np.array([power[a:b].sum() for a, b in zip(edges[:-1], edges[1:])]) + 1.0))
        return pd.Series(out)

    return energies(signal)
