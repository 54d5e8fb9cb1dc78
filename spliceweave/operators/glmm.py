"""Binomial mixed models of many sites: penalised quasi-likelihood with average-information REML.

logit(pi) = X a + u[donor] + e, u ~ N(0, tau_g K), e ~ N(0, tau_o I). Metacells of a donor share
their row of K, so every solve is done in donor space, for many models in one array. This is the task-side helper of
``null_model`` and ``context``; Spark groups and feeds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOW, HIGH = 1e-6, 1.0 - 1e-6


@dataclass
class Fit:
    status: str
    alpha: np.ndarray
    cov: np.ndarray
    pi: np.ndarray
    tau_g: float
    tau_o: float


@dataclass
class Fits:
    """The same of many models, models first."""

    status: np.ndarray
    alpha: np.ndarray
    cov: np.ndarray
    pi: np.ndarray
    tau_g: np.ndarray
    tau_o: np.ndarray


def _expit(eta):
    return np.clip(1.0 / (1.0 + np.exp(-np.clip(eta, -30, 30))), LOW, HIGH)


def _pinv(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverses of symmetric matrices (models x p x p); NaN for those that aren't finite."""
    good = np.isfinite(a).all(axis=(1, 2))
    out = np.full(a.shape, np.nan)
    out[good] = np.linalg.pinv(a[good], rcond=a.shape[-1] * np.finfo(float).eps, hermitian=True)
    return out


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares solutions of symmetric systems (models x p x p, models x p), of smallest norm; NaN for those that aren't finite."""
    good = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    out = np.full(b.shape, np.nan)
    size, axes = np.linalg.eigh(a[good])
    large = np.abs(size) > a.shape[-1] * np.finfo(float).eps * np.max(np.abs(size), axis=1, keepdims=True)
    along = (axes.transpose(0, 2, 1) @ b[good][:, :, None])[:, :, 0]
    out[good] = (axes @ np.where(large, along / np.where(large, size, 1.0), 0.0)[:, :, None])[:, :, 0]
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems (models x families x s x s); NaN for a model with a singular one."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full(b.shape, np.nan)
        return np.concatenate([_solve(a[i:i + 1], b[i:i + 1]) for i in range(len(a))])


def _of(x: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Designs of some models; a design that all share stays one."""
    return x if len(x) == 1 else x[models]


def fit_fixed_many(y, n, x, max_iter=50, tol=1e-8) -> Fits:
    """Plain binomial logistic regressions by reweighted least squares, as ``fit_many`` takes them.

    A status is Fixed, or Unsettled if ``max_iter`` steps (a documented limit) did not bring the change below ``tol``.
    """
    models, p = len(y), x.shape[1]
    alpha, done = np.zeros((models, p)), np.zeros(models, bool)
    rate = np.clip(y.sum(axis=1) / n.sum(axis=1), 1e-3, 1 - 1e-3)
    eta = np.repeat(np.log(rate / (1 - rate))[:, None], y.shape[1], axis=1)
    left = np.arange(models)
    for _ in range(max_iter):
        xs, pi = _of(x, left), _expit(eta[left])
        w = n[left] * pi * (1 - pi)
        xw = xs * w[:, None, :]
        z = eta[left] + np.divide(y[left] - n[left] * pi, w, out=np.zeros(w.shape), where=w > 0)
        pull = (xw @ z[:, :, None])[:, :, 0]
        new = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(xw @ xs.transpose(0, 2, 1), pull, strict=True)])
        done[left] = np.max(np.abs(new - alpha[left]), axis=1) < tol
        alpha[left], eta[left] = new, (new[:, None, :] @ xs)[:, 0]
        left = left[~done[left]]
        if not len(left):
            break
    pi = _expit(eta)
    cov = _pinv((x * (n * pi * (1 - pi))[:, None, :]) @ x.transpose(0, 2, 1))
    return Fits(np.where(done, "Fixed", "Unsettled").astype(object), alpha, cov, pi, np.full(models, -1.0), np.full(models, -1.0))


class Families:
    """Block-diagonal relatedness: for each family size the members (families x size) and their matrices (families x size x size).

    Memory and time follow the sum of squared family sizes; nothing is donors x donors.
    """

    def __init__(self, n: int, stacks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n, self.stacks = n, stacks

    @classmethod
    def whole(cls, kin: np.ndarray) -> Families:
        return cls(len(kin), [(np.arange(len(kin))[None, :], np.asarray(kin, float)[None])])

    @classmethod
    def unrelated(cls, n: int) -> Families:
        return cls(n, [(np.arange(n)[:, None], np.ones((n, 1, 1)))])

    @classmethod
    def of(cls, family: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> Families:
        """From a family label of each donor and the entries inside families; entries are averaged with their mirror image."""
        n = len(family)
        _, code, sizes = np.unique(family, return_inverse=True, return_counts=True)
        order = np.argsort(code, kind="stable")
        start = np.cumsum(sizes) - sizes
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(start, sizes)
        nth = np.empty(len(sizes), np.int64)
        stacks = []
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            nth[mine] = np.arange(len(mine))
            stacks.append((order[start[mine][:, None] + np.arange(size)], np.zeros((len(mine), size, size))))
        of_size = sizes[code]
        for members, kin in stacks:
            here = (of_size[rows] == members.shape[1]) & (code[rows] == code[cols])
            r, c = rows[here], cols[here]
            kin[nth[code[r]], place[r], place[c]] = values[here]
            kin += kin.transpose(0, 2, 1).copy()
            kin /= 2.0
        return cls(n, stacks)

    def touching(self, donors: np.ndarray) -> tuple[Families, np.ndarray]:
        """The families that hold any of ``donors``, and the new index of every old one (-1: left out).

        Members without samples change no solve: their rows weigh nothing.
        """
        seen, local, at, kept = np.zeros(self.n, bool), np.full(self.n, -1), 0, []
        seen[donors] = True
        for members, kin in self.stacks:
            hit = seen[members].any(axis=1)
            if hit.any():
                new = at + np.arange(hit.sum() * members.shape[1]).reshape(-1, members.shape[1])
                local[members[hit]] = new
                kept.append((new, kin[hit]))
                at += new.size
        return Families(at, kept), local

    def times_many(self, v: np.ndarray, blocks: list[np.ndarray] | None = None) -> np.ndarray:
        """Products of the matrices, or of others of each model, with columns: ``v`` is models x columns x donors."""
        out = np.zeros(v.shape)
        for (members, kin), m in zip(self.stacks, blocks or [k[None] for _, k in self.stacks], strict=True):
            if members.shape[1] == 1:
                out[:, :, members[:, 0]] = m[:, None, :, 0, 0] * v[:, :, members[:, 0]]
            else:
                out[:, :, members] = (m @ v[:, :, members].transpose(0, 2, 3, 1)).transpose(0, 3, 1, 2)
        return out


class Projectors:
    """P = V^-1 - V^-1 X (X' V^-1 X)^-1 X' V^-1 of many models at once, V = diag(d) + tau_g Z K Z', solved family by family.

    Vectors are models x columns x samples. ``inv`` is 1 / d, zero where a model has no such sample; ``donor`` is ascending.
    """

    def __init__(self, inv, donor, kin: Families, tau_g, x):
        self.inv, self.donor, self.kin, self.x, self.tau_g = inv, donor, kin, x, tau_g
        self.first = np.flatnonzero(np.r_[True, donor[1:] != donor[:-1]])
        self.a = self.to_donor(inv[:, None, :])[:, 0]
        self.m = []
        for members, k in kin.stacks:
            a, tk = self.a[:, members], tau_g[:, None, None, None] * k
            s = members.shape[1]
            self.m.append(tk / (1 + tk * a[..., None]) if s == 1 else _solve(np.eye(s) + tk * a[:, :, None, :], tk))
        self.vix = self.solve(np.broadcast_to(x, (len(inv), *x.shape[1:])))
        self.cov = _pinv(x @ self.vix.transpose(0, 2, 1))

    def of(self, models: np.ndarray) -> Projectors:
        return Projectors(self.inv[models], self.donor, self.kin, self.tau_g[models], _of(self.x, models))

    def to_donor(self, u):
        out = np.zeros((*u.shape[:2], self.kin.n))
        out[:, :, self.donor[self.first]] = np.add.reduceat(u, self.first, axis=2)
        return out

    def solve(self, u):
        u2 = u * self.inv[:, None, :]
        return u2 - self.inv[:, None, :] * self.kin.times_many(self.to_donor(u2), self.m)[:, :, self.donor]

    def apply(self, u):
        v = self.solve(u)
        return v - (self.cov @ (self.x @ v.transpose(0, 2, 1))).transpose(0, 2, 1) @ self.vix

    def traces(self):
        """tr(P) and tr(P Z K Z') of each model."""
        a2 = self.to_donor(self.inv[:, None, :] ** 2)[:, 0]
        t_o = self.inv.sum(axis=1) - np.sum(self.cov * (self.vix @ self.vix.transpose(0, 2, 1)), axis=(1, 2))
        t_g = np.zeros(len(t_o))
        for (members, kin), m in zip(self.kin.stacks, self.m, strict=True):
            a = self.a[:, members]
            t_o -= (np.einsum("bfii->bfi", m) * a2[:, members]).sum(axis=(1, 2))
            t_g += (np.einsum("fii->fi", kin) * a).sum(axis=(1, 2)) - np.einsum("fij,bfi,bfij,bfj->b", kin, a, m, a, optimize=True)
        zx = self.to_donor(self.vix)
        return t_o, t_g - np.sum(self.cov * (zx @ self.kin.times_many(zx).transpose(0, 2, 1)), axis=(1, 2))


def _variance_steps(tau: np.ndarray, step: np.ndarray) -> np.ndarray:
    """New variances of each model: a step that would make one negative is halved, or left out for a variance that is zero already."""
    new = tau + step
    while (bad := np.any(new < 0, axis=1) & (np.max(np.abs(step), axis=1) > 1e-8)).any():
        edge = (tau < 1e-8) & (step < 0)
        step = np.where(bad[:, None], np.where(edge, 0.0, step * 0.5), step)
        new = np.where(bad[:, None], tau + step, new)
    return np.where(new < 1e-10, 0.0, new)


def fit_many(y, n, x, donor, kin: Families, max_iter=30, tol=1e-3, max_effect=50.0, max_tau=1e3) -> Fits:
    """Mixed fits of many models on one list of samples; a model falls back to ``fit_fixed_many`` (its status, tau -1) when it does not converge.

    ``y`` and ``n`` are models x samples, with ``n`` zero where a model lacks a sample; ``x`` is models (or one for all) x columns x samples, ``donor``
    the ascending index of each sample in ``kin``. A model counts as diverging, and falls back as well, once a coefficient
    exceeds ``max_effect`` or a variance ``max_tau``. Models that are done leave the arrays, so late ones cost no more than their own steps.
    """
    fits = fit_fixed_many(y, n, x)
    alpha, eta = fits.alpha.copy(), np.log(fits.pi / (1 - fits.pi))
    tau = np.full((len(y), 2), 0.1)  # genetic, observation-level
    left = np.arange(len(y))
    with np.errstate(all="ignore"):  # a model whose numbers leave the range is found by them not being finite
        for _ in range(max_iter):
            xs, ys, ns = _of(x, left), y[left], n[left]
            pi, seen = _expit(eta[left]), ns > 0
            w = ns * pi * (1 - pi)
            z = np.where(seen, eta[left] + (ys - ns * pi) / w, 0.0)
            p = Projectors(w / (1 + tau[left, 1:] * w), donor, kin, tau[left, 0], xs)
            pz = p.apply(z[:, None, :])
            kz = kin.times_many(p.to_donor(pz))[:, :, donor]
            pgo = p.apply(np.concatenate([kz, pz], axis=1))
            dot = lambda u, v: np.sum(u * v, axis=-1)
            pz, kz, pg, po = pz[:, 0], kz[:, 0], pgo[:, 0], pgo[:, 1]
            t_o, t_g = p.traces()
            score = 0.5 * np.stack([dot(pz, kz) - t_g, dot(pz, pz) - t_o], axis=1)
            info = 0.5 * np.stack([dot(kz, pg), dot(kz, po), dot(kz, po), dot(pz, po)], axis=1).reshape(-1, 2, 2)
            new_tau = _variance_steps(tau[left], _least(info, score))
            new_alpha = (p.cov @ (p.vix @ z[:, :, None]))[:, :, 0]
            new_eta = np.where(seen, z - pz / w, 0.0)
            moved = np.maximum(np.max(np.abs(new_alpha - alpha[left]) / (np.abs(new_alpha) + np.abs(alpha[left]) + tol), axis=1),
                               np.max(np.abs(new_tau - tau[left]) / (new_tau + tau[left] + tol), axis=1))
            sound = np.isfinite(new_eta).all(axis=1) & (np.max(np.abs(new_alpha), axis=1) <= max_effect) & (np.max(new_tau, axis=1) <= max_tau)
            alpha[left], tau[left], eta[left] = new_alpha, new_tau, new_eta
            done = sound & (2 * moved < tol)
            over = left[done]
            if len(over):
                pi = _expit(eta[over])
                w = n[over] * pi * (1 - pi)
                fits.alpha[over], fits.pi[over], fits.status[over] = alpha[over], pi, "Converged"
                fits.tau_g[over], fits.tau_o[over] = tau[over].T
                fits.cov[over] = Projectors(w / (1 + tau[over, 1:] * w), donor, kin, tau[over, 0], _of(x, over)).cov
            left = left[sound & ~done]
            if not len(left):
                break
    return fits


def at_once(samples: int, columns: int, kin: Families, room: int = 1 << 23) -> int:
    """How many models share arrays of ``room`` numbers or so; one at least."""
    return max(1, room // (samples * (4 * columns + 16) + kin.n * (columns + 8) + 4 * sum(k.size for _, k in kin.stacks)))


def fit_mixed(y, n, x, donor, kin, max_iter=30, tol=1e-3, max_effect=50.0, max_tau=1e3) -> Fit:
    """``fit_many`` for one model with samples in any order, x as samples x columns and ``kin`` a ``Families`` over the values of ``donor`` or a plain matrix."""
    kin = kin if isinstance(kin, Families) else Families.whole(kin)
    order = np.argsort(donor, kind="stable")
    fits = fit_many(y[None, order], n[None, order], x[order].T[None], np.asarray(donor)[order], kin, max_iter, tol, max_effect, max_tau)
    pi = np.empty(len(y))
    pi[order] = fits.pi[0]
    return Fit(fits.status[0], fits.alpha[0], fits.cov[0], pi, float(fits.tau_g[0]), float(fits.tau_o[0]))
