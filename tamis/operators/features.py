"""Parameters of random feature maps, from hashed draws."""

from __future__ import annotations

import numpy as np

from ..functions import rng


def fourier_parameters(seed: str, features: int, dim: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(W, b) of random Fourier features of a Gaussian kernel with bandwidth sigma."""
    return rng.gaussian_matrix(seed, features, dim) / sigma, 2 * np.pi * rng.uniform_vector(f"{seed}b", features)


def unit_projections(seed: str, n: int, dim: int) -> np.ndarray:
    """n random directions of length 1."""
    g = rng.gaussian_matrix(seed, n, dim)
    return g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
