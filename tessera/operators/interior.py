"""Linear programs of a few thousand sparse rows by a primal-dual interior point method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Relative residuals and gap at which an iterate is optimal, and at which one that gets no better still counts.
TOLERANCE, ACCEPTED = 1e-10, 1e-7
STEPS = 120
#: Stands for a missing bound, times the largest finite number of the model; a solution half as far out is unbounded.
FAR = 1e5
_PANEL = 256


@dataclass
class Sparse:
    """Entries of a matrix."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * x[self.columns], self.shape[0])

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * y[self.rows], self.shape[1])


class Normal:
    """A D A' of a sparse A for changing D: pairs of entries of a column are listed once."""

    def __init__(self, a: Sparse) -> None:
        self.m = a.shape[0]
        order = np.argsort(a.columns, kind="stable")
        rows, columns, values = a.rows[order], a.columns[order], a.values[order]
        counts = np.bincount(columns, minlength=a.shape[1])
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        left = np.repeat(np.arange(len(rows)), counts[columns])
        right = first[columns[left]] + np.arange(len(left)) - np.repeat(np.cumsum(counts[columns]) - counts[columns], counts[columns])
        self.at, self.product, self.column = rows[left] * self.m + rows[right], values[left] * values[right], columns[left]

    def factor(self, d: np.ndarray) -> np.ndarray:
        """Lower triangle; the diagonal is raised as little as rows that depend on others need."""
        matrix = np.bincount(self.at, self.product * d[self.column], self.m * self.m).reshape(self.m, self.m)
        diagonal = matrix.ravel()[:: self.m + 1]
        raised = 1e-13 * max(diagonal.max(initial=0.0), 1e-300)
        for _ in range(12):
            diagonal += raised
            try:
                return np.linalg.cholesky(matrix)
            except np.linalg.LinAlgError:
                raised *= 100
        raise np.linalg.LinAlgError("the normal matrix isn't positive")


def _substitute(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with L L' x = b, panel by panel."""
    x, n = b.copy(), len(b)
    panels = [(i, min(i + _PANEL, n)) for i in range(0, n, _PANEL)]
    for i, j in panels:
        x[i:j] = np.linalg.solve(lower[i:j, i:j], x[i:j] - lower[i:j, :i] @ x[:i])
    for i, j in reversed(panels):
        x[i:j] = np.linalg.solve(lower[i:j, i:j].T, x[i:j] - lower[j:, i:j].T @ x[j:])
    return x


def _equilibrated(a: Sparse) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """(matrix, factors of rows, factors of columns) with greatest entries of rows and columns near one."""
    row, column, values = np.ones(a.shape[0]), np.ones(a.shape[1]), np.abs(a.values)
    for _ in range(8):
        now = values * row[a.rows] * column[a.columns]
        by_row, by_column = np.zeros(a.shape[0]), np.zeros(a.shape[1])
        np.maximum.at(by_row, a.rows, now)
        np.maximum.at(by_column, a.columns, now)
        row /= np.sqrt(np.where(by_row > 0, by_row, 1.0))
        column /= np.sqrt(np.where(by_column > 0, by_column, 1.0))
    return Sparse(a.rows, a.columns, a.values * row[a.rows] * column[a.columns], a.shape), row, column


def _path(q: np.ndarray, a: Sparse, r: np.ndarray, w: np.ndarray) -> tuple[bool, np.ndarray]:
    """(converged, y) of min q y with a y = r and 0 <= y <= w: predictor and corrector steps."""
    n = len(q)
    y, s = w / 2, w / 2
    size = max(1.0, np.abs(q).max(initial=0.0))
    z, t, dual = np.full(n, size), np.full(n, size), np.zeros(a.shape[0])
    normal = Normal(a)
    best, result = np.inf, y

    def longest(x: np.ndarray, dx: np.ndarray) -> float:
        down = dx < 0
        return min(1.0, float((x[down] / -dx[down]).min(initial=np.inf)))

    for _ in range(STEPS):
        rp, ru, rd = r - a.times(y), w - y - s, q - a.transposed_times(dual) - z + t
        gap = float(y @ z + s @ t)
        error = max(np.abs(rp).max(initial=0.0) / (1 + np.abs(r).max(initial=0.0)), np.abs(rd).max(initial=0.0) / (1 + size), gap / (1 + abs(q @ y)))
        if error < best:
            best, result = error, y
        if error < TOLERANCE or not np.isfinite(error):
            break
        with np.errstate(over="ignore"):
            d = 1 / (z / y + t / s)
        try:
            lower = normal.factor(d)
        except np.linalg.LinAlgError:
            break

        def step(rz: np.ndarray, rt: np.ndarray) -> tuple[np.ndarray, ...]:
            with np.errstate(over="ignore", invalid="ignore"):
                g = rz / y - (rt - t * ru) / s - rd  # noqa: B023
                target = rp - a.times(d * g)  # noqa: B023
            move = _substitute(lower, target)  # noqa: B023
            for _ in range(2):  # refined against what raising the diagonal changed
                move = move + _substitute(lower, target - a.times(d * a.transposed_times(move)))  # noqa: B023
            dy = d * (a.transposed_times(move) + g)  # noqa: B023
            ds = ru - dy  # noqa: B023
            return dy, ds, (rz - z * dy) / y, (rt - t * ds) / s, move  # noqa: B023

        dy, ds, dz, dt, _ = step(-y * z, -s * t)
        p, k = min(longest(y, dy), longest(s, ds)), min(longest(z, dz), longest(t, dt))
        after = float((y + p * dy) @ (z + k * dz) + (s + p * ds) @ (t + k * dt))
        aim = (after / gap) ** 3 * gap / (2 * n)
        dy, ds, dz, dt, move = step(aim - y * z - dy * dz, aim - s * t - ds * dt)
        p, k = 0.9995 * min(longest(y, dy), longest(s, ds)), 0.9995 * min(longest(z, dz), longest(t, dt))
        y, s, z, t, dual = y + p * dy, s + p * ds, z + k * dz, t + k * dt, dual + k * move
    return best < ACCEPTED, result


def maximize_sparse(c: np.ndarray, a: Sparse, b: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> tuple[str, np.ndarray]:
    """(status, x) of max c x with a x = b and lb <= x <= ub.

    Memory is that of a full matrix of a's rows, squared. Where several x are optimal it is one inside of them, not a vertex. A model
    that has no solution is told by how near a second program comes to one.
    """
    n = len(c)
    if np.any(lb > ub):
        return "infeasible", np.full(n, np.nan)
    finite = np.concatenate([x[np.isfinite(x)] for x in (lb, ub, b)] + [np.ones(1)])
    far = FAR * np.abs(finite).max()
    low, high = np.where(np.isfinite(lb), lb, -far), np.where(np.isfinite(ub), ub, far)
    low, high = np.minimum(low, high - np.where(np.isfinite(lb), 0, far)), np.maximum(high, low + np.where(np.isfinite(ub), 0, far))
    free = np.flatnonzero(high > low)
    place = np.full(n, -1)
    place[free] = np.arange(len(free))
    keep = place[a.columns] >= 0
    inner, row, column = _equilibrated(Sparse(a.rows[keep], place[a.columns[keep]], a.values[keep], (a.shape[0], len(free))))
    r, w = row * (b - a.times(low)), (high - low)[free] / column
    used = np.bincount(inner.rows, minlength=a.shape[0]) > 0
    scale = max(1.0, np.abs(r).max(initial=0.0), np.abs(w).max(initial=0.0) / FAR)
    if np.abs(r[~used]).max(initial=0.0) > 1e-9 * scale:
        return "infeasible", np.full(n, np.nan)
    number = np.cumsum(used) - 1
    inner = Sparse(number[inner.rows], inner.columns, inner.values, (int(used.sum()), len(free)))
    r = r[used]
    if not len(free):
        return "optimal", low
    q = -c[free] * column
    if inner.shape[0]:
        done, y = _path(q / np.abs(q).max() if q.any() else q, inner, r / scale, w / scale)
    else:
        done, y = True, np.where(q < 0, w / scale, 0.0)
    if not done:
        # how near a x comes to b: each row may be missed upward and downward at a price
        m, extra = inner.shape[0], np.arange(inner.shape[0])
        slack = Sparse(np.concatenate([inner.rows, extra, extra]), np.concatenate([inner.columns, len(free) + extra, len(free) + m + extra]), np.concatenate([inner.values, np.ones(m), -np.ones(m)]), (m, len(free) + 2 * m))
        most = 2 * (np.abs(r / scale).max(initial=0.0) + np.bincount(inner.rows, np.abs(inner.values) * (w / scale)[inner.columns], m).max(initial=1.0))
        price = np.concatenate([np.zeros(len(free)), np.ones(2 * m)])
        _, missed = _path(price, slack, r / scale, np.concatenate([w / scale, np.full(2 * m, most)]))
        if price @ missed > 1e-6:
            return "infeasible", np.full(n, np.nan)
        return "iterations", np.full(n, np.nan)
    x = low.copy()
    x[free] += y * scale * column
    out = (~np.isfinite(lb) & (x < -far / 2)) | (~np.isfinite(ub) & (x > far / 2))
    return ("unbounded" if np.any(out & (c != 0)) or (out.any() and abs(c @ x) > far / 2) else "optimal"), x
