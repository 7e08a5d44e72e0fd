"""Regularised inversion of one image into planes, and the proximal steps it takes.

The forward model sums the planes' spectra after propagation (`optics.forward`); objective = |A x - b|^2 / 2 + l1 |x|_1
(components) + tv TV(x).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .optics import adjoint, forward


@dataclass
class Trace:
    objective: list[float] = field(default_factory=list)
    sparsity: list[float] = field(default_factory=list)
    step: list[float] = field(default_factory=list)
    backtracks: list[int] = field(default_factory=list)


def soft(x: np.ndarray, t: float) -> np.ndarray:
    """Each component towards zero by t."""
    if np.iscomplexobj(x):
        return soft(np.ascontiguousarray(x).view(float), t).view(complex)
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def soft_power(x: np.ndarray, t: float) -> np.ndarray:
    y = np.maximum(np.abs(x) ** 2 - t, 0)
    return x * (y / (y + t)) if t > 0 else x


def _rolled(x: np.ndarray, by: int, axis: int) -> np.ndarray:
    """np.roll by one step, which takes a fifth of its time on small arrays."""
    out, lead = np.empty_like(x), (slice(None),) * axis
    if by > 0:
        out[(*lead, slice(1, None))], out[(*lead, 0)] = x[(*lead, slice(None, -1))], x[(*lead, -1)]
    else:
        out[(*lead, slice(None, -1))], out[(*lead, -1)] = x[(*lead, slice(1, None))], x[(*lead, 0)]
    return out


def differences(x: np.ndarray, axes: tuple[int, ...]) -> list[np.ndarray]:
    """Periodic backward differences."""
    return [x - _rolled(x, 1, a) for a in axes]


def divergence(g: list[np.ndarray], axes: tuple[int, ...]) -> np.ndarray:
    """The adjoint of `differences`."""
    return sum(p - _rolled(p, -1, a) for p, a in zip(g, axes, strict=True))


def total_variation(x: np.ndarray, axes: tuple[int, ...]) -> float:
    return float(np.sqrt(sum(np.abs(d) ** 2 for d in differences(x, axes))).sum())


def tv_denoise(x: np.ndarray, weight: float, axes: tuple[int, ...], steps: int = 5) -> np.ndarray:
    """argmin |u - x|^2 / 2 + weight TV(u) by projected gradients on the dual."""
    if weight <= 0:
        return x
    if np.iscomplexobj(x):
        # both parts at once, as a last axis
        x = np.ascontiguousarray(x)
        return np.ascontiguousarray(tv_denoise(x.view(float).reshape(*x.shape, 2), weight, axes, steps)).view(complex)[..., 0]
    g = [np.zeros_like(x) for _ in axes]
    rate = 1 / (4 * len(axes))
    for _ in range(steps):
        u = x - weight * divergence(g, axes)
        g = [p + rate / weight * d for p, d in zip(g, differences(u, axes), strict=True)]
        size = np.maximum(1, np.sqrt(sum(p * p for p in g)))
        g = [p / size for p in g]
    return x - weight * divergence(g, axes)


def prox(x: np.ndarray, step: float, l1: float, tv: float, how: str, inner: int, turn: int = 0) -> np.ndarray:
    """Of planes (..., depth, h, w). l1: soft threshold; fused2d, fused3d, fused1d: total variation in planes, volumes or along z, and then the threshold; alternate: planes and z in turns."""
    if how != "l1" and tv > 0:
        axes = {"fused2d": (1, 2), "fused3d": (0, 1, 2), "fused1d": (0,), "alternate": (1, 2) if turn % 2 == 0 else (0,)}[how]
        x = tv_denoise(x, step * tv, tuple(a + x.ndim - 3 for a in axes), inner)
    return soft(x, step * l1)


class Problem:
    def __init__(self, image: np.ndarray, depths, wavelength: float, resolution: float, l1: float, tv: float, how: str, inner: int):
        self.b, self.depths, self.optics, self.l1, self.tv, self.inner = image, list(depths), (wavelength, resolution), l1, tv, inner
        self.how = "l1" if tv == 0 else how  # without a weight there is nothing to fuse

    def a(self, x):
        return forward(x, self.depths, *self.optics)

    def at(self, r):
        return adjoint(r, self.depths, *self.optics)

    def zero(self):
        *lead, h, w = self.b.shape
        return np.zeros((*lead, len(self.depths), h, w), complex)

    def smooth(self, r):
        return 0.5 * float((r * r).sum())

    def total(self, x, r):
        reg = self.l1 * float(np.abs(x.real).sum() + np.abs(x.imag).sum())
        if self.how != "l1":
            reg += self.tv * total_variation(x, {"fused3d": (0, 1, 2), "fused1d": (0,)}.get(self.how, (1, 2)))
        return self.smooth(r) + reg

    def prox(self, x, step, turn=0):
        return prox(x, step, self.l1, self.tv, self.how, self.inner, turn)


def lipschitz(p: Problem, seed: int = 0) -> float:
    """|grad f(x2) - grad f(x1)| / |x2 - x1| of two normal draws, 1e-6 at least. The bound that always holds is the number of planes."""
    rng = np.random.default_rng(seed)
    x1, x2 = (rng.standard_normal(p.zero().shape) + 0j for _ in range(2))
    change = p.at(p.a(x2) - p.a(x1))
    return max(1e-6, float(np.linalg.norm(change) / np.linalg.norm(x2 - x1)))


def fasta(p: Problem, outer: int, backtracks: int = 2, shrink: float = 0.5, step: float | None = None, window: int = 10) -> tuple[np.ndarray, Trace]:
    """Forward-backward splitting with backtracking, restarts and momentum; the step starts at 1 / planes."""
    x0, trace = p.zero(), Trace()
    y0, t0 = x0, 1.0
    step = step or 1.0 / len(p.depths)
    r = p.a(y0) - p.b
    g, seen = p.at(r), [p.smooth(r)]
    for it in range(outer):
        tries = 0
        while True:
            x1 = p.prox(y0 - step * g, step, it)
            r1 = p.a(x1) - p.b
            move = x1 - y0
            bound = max(seen[-window:]) + float((move.real * g.real + move.imag * g.imag).sum()) + float((np.abs(move) ** 2).sum()) / (2 * step)
            if p.smooth(r1) <= bound + 1e-12 * max(1.0, abs(bound)) or tries >= backtracks:
                break
            step, tries = step * shrink, tries + 1
        back, ahead = y0 - x1, x1 - x0
        if float((back.real * ahead.real + back.imag * ahead.imag).sum()) > 0:
            t0 = 1.0
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        y1 = x1 + (t0 - 1) / t1 * ahead
        x0, y0, t0 = x1, y1, t1
        r = p.a(y0) - p.b
        g = p.at(r)
        seen.append(p.smooth(r))
        trace.objective.append(p.total(x1, r1))
        trace.sparsity.append(float((x1 != 0).mean()))
        trace.step.append(step)
        trace.backtracks.append(tries)
    return x0, trace


def fista(p: Problem, outer: int, monotone: bool = False) -> tuple[np.ndarray, Trace]:
    step, trace = 1.0 / max(lipschitz(p), len(p.depths)), Trace()
    x = y = p.zero()
    t, low = 1.0, np.inf
    for it in range(outer):
        z = p.prox(y - step * p.at(p.a(y) - p.b), step, it)
        f = p.total(z, p.a(z) - p.b)
        new = x if monotone and f > low else z
        low = min(low, f)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + t / t1 * (z - new) + (t - 1) / t1 * (new - x)
        x, t = new, t1
        trace.objective.append(low if monotone else f)
        trace.sparsity.append(float((x != 0).mean()))
        trace.step.append(step)
        trace.backtracks.append(0)
    return x, trace


def fista_together(p: Problem, outer: int) -> np.ndarray:
    """What `fista` gives for each image of a problem (n, h, w), without the trace. Its steps don't depend on the image, so all are taken at once."""
    one = Problem(np.zeros(p.b.shape[-2:]), p.depths, *p.optics, p.l1, p.tv, p.how, p.inner)
    step = 1.0 / max(lipschitz(one), len(p.depths))
    x = y = p.zero()
    t = 1.0
    for it in range(outer):
        new = p.prox(y - step * p.at(p.a(y) - p.b), step, it)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t1 * (new - x)
        x, t = new, t1
    return x


def twist(p: Problem, outer: int, lam1: float = 1e-4, tolerance: float = 1e-6) -> tuple[np.ndarray, Trace]:
    """Two-step shrinkage: x = (alpha - beta) x_1 + (1 - alpha) x_2 + beta prox(...); one-step where that doesn't lower the objective."""
    rho = (1 - lam1) / (1 + lam1)
    alpha = 2 / (1 + np.sqrt(1 - rho * rho))
    beta = 2 * alpha / (lam1 + 1)
    step, trace = 1.0 / max(lipschitz(p), len(p.depths)), Trace()
    x2 = x1 = p.zero()
    low = p.total(x1, p.a(x1) - p.b)
    for it in range(outer):
        s = p.prox(x1 - step * p.at(p.a(x1) - p.b), step, it)
        new = (alpha - beta) * x1 + (1 - alpha) * x2 + beta * s if it else s
        f = p.total(new, p.a(new) - p.b)
        if f > low:
            new, f = s, p.total(s, p.a(s) - p.b)
        x2, x1 = x1, new
        trace.objective.append(f)
        trace.sparsity.append(float((x1 != 0).mean()))
        trace.step.append(step)
        trace.backtracks.append(0)
        if abs(low - f) <= tolerance * max(1e-30, abs(low)):
            break
        low = min(low, f)
    return x1, trace


SOLVERS = {"fasta": fasta, "fista": fista, "twist": twist}
#: Those whose steps are the same for all images.
TOGETHER = {"fista": fista_together}
