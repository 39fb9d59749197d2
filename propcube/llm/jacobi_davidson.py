"""Largest eigenpairs of a symmetric matrix that is only known by products.

Jacobi-Davidson in blocks: Ritz pairs of a growing subspace give residuals;
for each wanted pair that has not converged, inner MINRES solves the projected
correction equation (I - QQ')(A - theta I)(I - QQ') t = -r, Q holding the locked
vectors and the pair's own; the corrections extend the subspace. The equations
of a round advance in step, so one product with a block of vectors serves all of
them. Converged pairs are locked and the search goes on beside them.

Everything here has the size of one vector or of the small subspace; the caller
does the products, wherever the rows lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]
INNER, ROUNDS = 5, 200
START, BESIDE = 4, 4  # first vectors of the subspace for each wanted pair; pairs corrected besides the wanted ones
#: A residual counts as double precision below this many roundings of the norm.
ROUNDINGS = 64


def _apart(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``x`` without its parts along the orthonormal columns of ``base``."""
    for _ in range(2):
        x = x - base @ (base.T @ x)
    return x


def _extend(base: np.ndarray, more: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that extend ``base`` by the directions of ``more``;
    one that adds nothing gives way to a random one, as far as there is room."""
    new = np.zeros((base.shape[0], 0))
    for j in range(more.shape[1]):
        have = np.hstack([base, new])
        if have.shape[1] >= base.shape[0]:
            break
        size = np.linalg.norm(more[:, j])
        x = _apart(more[:, j] / size if size else more[:, j], have)
        while np.linalg.norm(x) < 1e-8:
            x = _apart(rng.normal(size=base.shape[0]), have)
        x = _apart(x / np.linalg.norm(x), have)
        new = np.hstack([new, (x / np.linalg.norm(x))[:, None]])
    return new


def _residuals(u: np.ndarray, au: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Rayleigh quotients, residuals, their norms) of unit vectors ``u``."""
    theta = (u * au).sum(axis=0)
    residual = au - theta * u
    return theta, residual, np.linalg.norm(residual, axis=0)


def minres(product: Product, shift: np.ndarray, project: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray,
           accuracy: float, steps: int = INNER) -> np.ndarray:
    """Solutions t (columns) of P_j (A - shift_j) P_j t_j = rhs_j, each to
    ``accuracy`` of its right side or ``steps`` steps, all by common products."""
    b = project(rhs)
    beta = np.linalg.norm(b, axis=0)
    first, eta, x = beta.copy(), beta.copy(), np.zeros_like(b)
    v0, v1 = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    beta = np.zeros_like(beta)
    w0, w1 = np.zeros_like(b), np.zeros_like(b)
    c0 = c1 = np.ones_like(beta)
    s0 = s1 = np.zeros_like(beta)
    live = first > 0
    for _ in range(steps):
        if not live.any():
            break
        p = np.zeros_like(b)
        p[:, live] = product(v1[:, live])
        p = project(p - shift * v1)
        alpha = (v1 * p).sum(axis=0)
        p = p - alpha * v1 - beta * v0
        after = np.linalg.norm(p, axis=0)
        r0 = c1 * alpha - c0 * s1 * beta
        r1 = np.hypot(r0, after)
        safe = np.where(r1 > 0, r1, 1)
        w2 = (v1 - (s0 * beta) * w0 - (s1 * alpha + c0 * c1 * beta) * w1) / safe
        c2, s2 = r0 / safe, after / safe
        x = x + np.where(live & (r1 > 0), c2 * eta, 0) * w2
        eta = np.where(live, -s2 * eta, eta)
        live = live & (np.abs(eta) > accuracy * first) & (after > 1e-14 * np.maximum(np.abs(shift), 1e-300))
        v0, v1, beta = v1, p / np.where(after > 0, after, 1), after
        w0, w1, c0, c1, s0, s1 = w1, w2, c1, c2, s1, s2
    return project(x)


def largest(product: Product, dim: int, k: int, rank: int, most: int | None = None,
            seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the min(k, dim)
    largest pairs. ``rank`` bounds the rank of the matrix from above; the subspace
    holds at most ``most`` vectors before it is folded into its best ones."""
    k = min(k, dim, max(rank, 0))
    if k == 0:
        return np.zeros(0), np.zeros((dim, 0))
    most = min(dim, most or max(48, 10 * k))
    rng = np.random.default_rng(seed)
    basis = _extend(np.zeros((dim, 0)), rng.normal(size=(dim, min(dim, START * k))), rng)
    image = product(basis)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    accuracy = 0.1
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        want = min(k - len(values), basis.shape[1])
        # pairs beyond the wanted ones ride along: a product costs a pass, not a vector
        u, au = basis @ y[:, :want + BESIDE], image @ y[:, :want + BESIDE]
        theta_u, residual, size = _residuals(u, au)
        top = max(np.abs(theta).max(), np.abs(values).max(initial=0), 1e-300)
        fine = ROUNDINGS * np.finfo(float).eps * top
        n = 0
        if size[0] <= 16 * fine:  # by a product of its own, not by sums of earlier ones
            u /= np.linalg.norm(u, axis=0)
            theta_u, residual, size = _residuals(u, _apart(product(u), locked))
            good = np.append(size[:want] <= fine, False)
            n = int(np.argmin(good))  # in order of falling value
        if n:
            locked = np.hstack([locked, u[:, :n]])
            values = np.append(values, theta_u[:n])
            # the Ritz vectors left stay the basis, clear of what is locked
            basis = basis @ y[:, n:]
            image = image @ y[:, n:]
            if len(values) == k:
                break
            if not basis.shape[1]:
                basis = _extend(locked, rng.normal(size=(dim, START * k)), rng)
                image = _apart(product(basis), locked)
                continue
            u, residual, theta_u, size = u[:, n:], residual[:, n:], theta_u[n:], size[n:]
        if basis.shape[1] + u.shape[1] > most and basis.shape[1] > 2 * k:
            if not n:
                basis, image = basis @ y, image @ y
            basis, image = basis[:, :2 * k], image[:, :2 * k]
        if basis.shape[1] + locked.shape[1] >= dim:
            # the subspace is whole: only roundings are left, take products anew
            basis = _extend(locked, basis, rng)
            image = _apart(product(basis), locked)
            continue
        if not u.shape[1]:
            continue

        def project(x, u=u):
            for _ in range(2):
                x = x - locked @ (locked.T @ x)
                x = x - (u * x).sum(axis=0) * u
            return x

        step = minres(product, theta_u, project, -residual, accuracy)
        accuracy = max(accuracy / 2, 1e-4)
        more = _extend(np.hstack([locked, basis]), step, rng)
        basis, image = np.hstack([basis, more]), np.hstack([image, _apart(product(more), locked)])
    else:
        raise ArithmeticError(f"residuals {size} stay above {ROUNDINGS} roundings of {top}")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]
