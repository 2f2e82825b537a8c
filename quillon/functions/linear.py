"""Leading eigenvectors of a symmetric operator that is only known by what it makes of a block of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _adds(block: np.ndarray, span: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to span (orthogonalised twice)."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - span @ (span.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def eigenvectors(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, keep: int = 8, passes: int = 400, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k leading eigenvalues, eigenvectors as columns, residuals) of the symmetric d x d operator `times`.

    Every pass multiplies one block of at most `block` vectors. QR and Rayleigh-Ritz take the best of the span of all blocks so far,
    up to `keep` of them, and the residuals are the next block; then the span restarts from its best vectors (keep = 1 is
    plain subspace iteration). Ends when the first k residuals are at most `tolerance` of the largest eigenvalue, or the span
    is everything or has nothing to add. Raises if `passes` do not do.
    """
    k, block = min(k, d), min(d, block)
    new = np.linalg.qr(np.random.default_rng(11).normal(size=(d, block)))[0]
    span, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(passes):
        span, image = np.concatenate([span, new], 1), np.concatenate([image, times(new)], 1)
        t = span.T @ image
        e, u = np.linalg.eigh((t + t.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        ritz, its_image = span @ u, image @ u
        residual = its_image - ritz * e
        size = np.linalg.norm(residual[:, :k], axis=0)
        new = _adds(residual[:, :block], ritz)
        if len(e) >= k and (size.max() <= tolerance * max(e[0], 0) or not new.size or span.shape[1] == d):
            return e[:k], ritz[:, :k], size
        if span.shape[1] + new.shape[1] > keep * block:
            span = np.linalg.qr(ritz[:, :block])[0]
            image = its_image[:, :block] @ (ritz[:, :block].T @ span)
            if keep == 1:
                new = np.linalg.qr(its_image[:, :block])[0]
                span, image = np.zeros((d, 0)), np.zeros((d, 0))
        else:
            span, image = ritz, its_image
    raise RuntimeError(f"residuals {size} after {passes} passes")
