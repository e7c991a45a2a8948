"""Subspaces of a bank's few rows, worked out on the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np

from probewise.functions.kernels import unit_rows


@dataclass(frozen=True)
class Coverage:
    """How much of a bank a projection holds."""

    bank_rows: int
    width: int
    rank: int
    kept: int
    filled: int       # directions added outside the bank's span
    exact: bool       # every direction of the bank is kept
    gram_error: float  # largest change of a dot product between bank rows

    def columns(self) -> dict:
        return asdict(self)


def orthonormal(directions: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Orthonormal rows spanning ``directions``; dependent ones are dropped."""
    basis = np.empty((0, directions.shape[1]))
    for v in unit_rows(np.asarray(directions, dtype=np.float64)):
        rest = v - basis.T @ (basis @ v)
        length = np.linalg.norm(rest)
        if length > tolerance:
            basis = np.vstack([basis, rest / length])
    return basis


def principal_directions(unit: np.ndarray, tolerance: float) -> np.ndarray:
    """Orthonormal rows of the span of ``unit``, the one with most of it first.

    Eigenvectors of the small matrix of dot products between rows say how to combine the
    rows. Each direction points to the side on which the rows' sum lies.
    """
    power, mix = np.linalg.eigh(unit @ unit.T)
    power, mix = power[::-1], mix[:, ::-1]
    strong = np.sqrt(np.maximum(power, 0.0)) > tolerance * np.sqrt(max(power[0], 1e-300))
    found = orthonormal((mix[:, strong] / np.sqrt(power[strong])).T @ unit, 1e-3)
    side = np.where(found @ unit.sum(axis=0) < -1e-12, -1.0, 1.0)
    return found * side[:, None]


def complement(basis: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` orthonormal rows at right angles to ``basis``, at random."""
    drawn = np.random.default_rng(seed).standard_normal((count, basis.shape[1]))
    for _ in range(2):  # the second time removes what rounding has left
        drawn -= (drawn @ basis.T) @ basis
        drawn = np.linalg.qr(drawn.T)[0].T
    return drawn


def row_span_projection(rows: np.ndarray, dim: int = 128, seed: int = 0, tolerance: float = 1e-6,
                        complete: bool = True) -> tuple[np.ndarray, Coverage]:
    """At most ``dim`` orthonormal rows; dot products with the bank survive if they cover its rank."""
    rows = np.asarray(rows, dtype=np.float64)
    if rows.ndim != 2 or 0 in rows.shape:
        raise ValueError("a projection needs a bank with at least one row and one component")
    unit, width = unit_rows(rows), rows.shape[1]
    wanted = max(1, min(dim, width))
    span = principal_directions(unit, max(tolerance, 1e-7))
    weight = span[:wanted]
    filled = wanted - len(weight) if complete else 0
    if filled:
        weight = np.vstack([weight, complement(weight, filled, seed)])
    seen = unit @ weight.T
    change = np.abs(unit @ unit.T - seen @ seen.T).max()
    return weight, Coverage(len(unit), width, len(span), len(weight) - filled, filled, len(span) <= wanted, float(change))
