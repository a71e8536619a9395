"""Which physical form a fit of cells takes.

G  sufficient statistics: one distributed pass, then iterations on the driver over P x R and R x R matrices.
D  dense: the whole (small) matrix on the driver.
P  one distributed pass per iteration over sample blocks; the basis goes with the tasks, samples' coefficients stay in the blocks.
"""

from __future__ import annotations

DENSE_CELLS = 5_000_000


def choose(method: str, has_covariates: bool, weighted: bool, n_features: int, n_samples: int, dense_cells: int = DENSE_CELLS) -> str:
    if method == "EU" and has_covariates and not weighted:
        return "G"
    return "D" if n_features * n_samples <= dense_cells else "P"
