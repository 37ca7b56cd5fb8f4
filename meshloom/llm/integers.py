"""Exact arithmetic on integer vectors: floors of scaled components, products, nearest rows and sums by row."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components are held within this bound, so that a squared distance over 64 of them fits a long.
BOUND = 1 << 27


def finite(col: str) -> Column:
    """True for a vector that isn't null and has only finite components (zeros are fine)."""
    return F.coalesce(~F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64; values beyond ``BOUND`` become the bound."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -BOUND, BOUND).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact. In doubles where every partial sum is a whole number under 2^53, which is exact too and faster; in int64 otherwise."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x``, the first of its nearest rows of ``c`` and the squared distance, both exact: |x|^2 - 2xc + |c|^2 in int64."""
    which, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    length = np.einsum("ij,ij->i", c, c)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = length - 2 * product(part, c)
        i = d.argmin(axis=1)
        which[at : at + step] = i
        far[at : at + step] = d[np.arange(len(part)), i] + np.einsum("ij,ij->i", part, part)
    return which, far


def add_rows(total: np.ndarray, count: np.ndarray, which: np.ndarray, x: np.ndarray) -> None:
    """Add each row of ``x`` to the row ``which`` of ``total``, and one to its count."""
    if len(x):
        order = np.argsort(which, kind="stable")
        w = which[order]
        at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        total[w[at]] += np.add.reduceat(x[order], at, axis=0)
        count[w[at]] += np.diff(np.r_[at, len(w)])


def digest(rows: np.ndarray) -> str:
    """sha256 of all components in order, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, rows.ravel().tolist())).encode()).hexdigest()


def as_long(total: Column) -> Column:
    """A sum kept in a decimal as a long; beyond its range, the greatest long."""
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
