"""Filter steps for many series at once: arrays whose first axis is the series.

Each method is a class: prepare at construction, start() from the first observation, step() for the next ones.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np

from tidefold.errors import CovarianceError, FilterError, InvertibilityError, ParamError
from tidefold.functions.rng import normals, uniforms
from tidefold.operators import sigma
from tidefold.plans.models import Model

log = logging.getLogger(__name__)
OK, BAD_COVARIANCE, BAD_INNOVATION = 0, 1, 2
# What fails as a covariance or as a matrix to invert, and how many steps without weights in a row are told.
WORST_CONDITION, WORST_ASYMMETRY, LEAST_DETERMINANT, WORST_RESIDUAL = 1e12, 1e-5, 1e-15, 1e-5
MOST_LOST = 5
ERRORS = {BAD_COVARIANCE: CovarianceError, BAD_INNOVATION: InvertibilityError}


@dataclass
class State:
    x: np.ndarray
    p: np.ndarray
    y: np.ndarray
    k: np.ndarray
    status: np.ndarray
    more: dict = field(default_factory=dict)

    def take(self, rows) -> State:
        return State(self.x[rows], self.p[rows], self.y[rows], self.k[rows], self.status[rows], {k: v[rows] for k, v in self.more.items()})

    def put(self, rows, other: State) -> None:
        for name in ("x", "p", "y", "k", "status"):
            getattr(self, name)[rows] = getattr(other, name)
        for k, v in other.more.items():
            self.more[k][rows] = v


def symmetric(m: np.ndarray) -> np.ndarray:
    return (m + np.swapaxes(m, -1, -2)) / 2


def regularised(p: np.ndarray) -> np.ndarray:
    """p made symmetric, with a multiple of the identity added where an eigenvalue isn't positive or the condition is 1e12 or worse."""
    p = symmetric(p)
    low_high = np.linalg.eigvalsh(p)
    low, high = low_high[:, 0], low_high[:, -1]
    need = np.where(low <= 1e-10, np.abs(low) + 1e-9, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((low <= 0) | (high / low >= 1e12), np.maximum(need, high / 1e12 - low), need)
    return p + 10 * need[:, None, None] * np.eye(p.shape[-1])


def unsound(p: np.ndarray) -> np.ndarray:
    """Which finite matrices are no covariances: asymmetric, an eigenvalue or diagonal element that isn't positive, or a condition of 1e12 or worse."""
    if p.shape[-1] == 1:
        return p[:, 0, 0] <= 0
    values = np.linalg.eigvalsh(symmetric(p))
    low, high = values[:, 0], values[:, -1]
    top = np.abs(p).max((1, 2))
    skew = np.abs(p - np.swapaxes(p, 1, 2)).max((1, 2)) > WORST_ASYMMETRY * top
    return (low <= 0) | (np.einsum("nii->ni", p) <= 0).any(1) | (high >= WORST_CONDITION * low) | skew


def invertible(s: np.ndarray) -> np.ndarray:
    """Which matrices can be inverted: finite, of full rank, not too small a determinant, a condition below 1e12, and an inverse that gives the identity."""
    if s.shape[1] == 1:
        size = np.abs(s[:, 0, 0])
        return (size > LEAST_DETERMINANT) & (size < np.inf)
    fine = np.isfinite(s).all((1, 2))
    safe = np.where(fine[:, None, None], s, np.eye(s.shape[1]))
    values = np.linalg.svd(safe, compute_uv=False)
    fine &= (np.prod(values, 1) > LEAST_DETERMINANT) & (values[:, 0] < WORST_CONDITION * values[:, -1])
    # Below this condition the residual is far from its bound.
    odd = np.flatnonzero(fine & (values[:, 0] > 1e8 * values[:, -1]))
    if len(odd):
        left = np.eye(s.shape[1]) - safe[odd] @ np.linalg.inv(safe[odd])
        fine[odd] = np.linalg.norm(left, axis=(1, 2)) < WORST_RESIDUAL
    return fine


def factor(p: np.ndarray) -> np.ndarray:
    """Lower Cholesky factors; where one fails, of p with 1e-12 added to its diagonal, and at last of its nearest positive part."""
    try:
        return np.linalg.cholesky(p)
    except np.linalg.LinAlgError:
        out = np.empty_like(p)
        for i, m in enumerate(p):
            for more in (0.0, 1e-12):
                try:
                    out[i] = np.linalg.cholesky(m + more * np.eye(len(m)))
                    break
                except np.linalg.LinAlgError:
                    continue
            else:
                w, v = np.linalg.eigh(symmetric(m))
                out[i] = v * np.sqrt(np.maximum(w, 1e-12))
        return out


class Gaussian:
    """What the linear, extended and unscented filters share: the first estimate, the update and its guards."""

    def __init__(self, model: Model):
        self.model = model

    def first_gain(self) -> np.ndarray:
        k, prior = self.model.dim_x, self.model.prior
        cross, own = prior[:k, k:], prior[k:, k:]
        return np.linalg.solve(own.T, cross.T).T if np.linalg.matrix_rank(own) == len(own) else cross @ np.linalg.pinv(own)

    def start(self, y: np.ndarray, streams: np.ndarray) -> tuple[State, dict]:
        m, n = self.model, len(y)
        k = m.dim_x
        cross, gain = m.prior[:k, k:], self.first_gain()
        x = m.mean[:k] + (y - m.mean[k:]) @ gain.T
        p = np.broadcast_to(m.prior[:k, :k] - gain @ cross.T, (n, k, k)).copy()
        state = State(x, p, y.copy(), np.zeros(n, np.int64), np.zeros(n, np.int8), self.extra(n, streams))
        eye = np.broadcast_to(np.eye(k), (n, k, k))
        out = {"x_pred": np.zeros((n, k)), "p_pred": eye, "innov": np.zeros((n, m.dim_y)), "s": np.broadcast_to(np.eye(m.dim_y), (n, m.dim_y, m.dim_y)), "gain": np.zeros((n, k, m.dim_y)), "x_upd": x, "p_upd": p}
        return state, out

    def extra(self, n: int, streams: np.ndarray) -> dict:
        return {}

    def predict(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        """(mean, covariance) of the next (x, y)."""
        raise NotImplementedError

    def step(self, state: State, y: np.ndarray, streams: np.ndarray) -> tuple[State, dict]:
        k = self.model.dim_x
        with np.errstate(all="ignore"):
            z, p = self.predict(state)
            innov, s, cross = y - z[:, k:], p[:, k:, k:], p[:, :k, k:]
            status = state.status.copy()
            fine = invertible(s)
            status[(status == OK) & ~fine] = BAD_INNOVATION
            safe = np.where(fine[:, None, None], s, np.eye(s.shape[1]))
            gain = np.swapaxes(np.linalg.solve(np.swapaxes(safe, 1, 2), np.swapaxes(cross, 1, 2)), 1, 2)
            x = z[:, :k] + np.einsum("nij,nj->ni", gain, innov)
            j = np.concatenate([np.broadcast_to(np.eye(k), (len(y), k, k)), -gain], 2)
            after = j @ p @ np.swapaxes(j, 1, 2)
            finite = np.isfinite(after).all((1, 2))
            status[(status == OK) & ~finite] = BAD_COVARIANCE
            after = np.where(finite[:, None, None], after, np.eye(k))
            if self.model.form != "augmented":
                ill = unsound(after)
                if ill.any():
                    after = np.where(ill[:, None, None], regularised(after), after)
        bad = status != OK
        if bad.any():
            x, after = np.where(bad[:, None], np.nan, x), np.where(bad[:, None, None], np.nan, after)
        out = {"x_pred": z[:, :k], "p_pred": p[:, :k, :k], "innov": innov, "s": s, "gain": gain, "x_upd": x, "p_upd": after}
        return State(x, after, y.copy(), state.k + 1, status), out


class Extended(Gaussian):
    """Extended filter; on a linear model it is the linear one.

    Without guards (nonlinear models of one state and one observation): sums in the order of the filter's SQL, and nothing made
    sound or NaN. Where a series diverges its rounding grows, so only the same sums in the same order give SQL's digits. The
    status still tells, from the first estimate that isn't finite or whose covariance isn't positive on.
    """

    def __init__(self, model: Model, guards: bool = True):
        super().__init__(model)
        if not guards and (model.linear or (model.dim_x, model.dim_y) != (1, 1)):
            raise FilterError("only nonlinear models of one state and one observation go without guards")
        self.guards = guards

    def first_gain(self) -> np.ndarray:
        k, prior = self.model.dim_x, self.model.prior
        return super().first_gain() if self.guards else prior[:k, k:] @ np.linalg.pinv(prior[k:, k:])

    def step(self, state: State, y: np.ndarray, streams: np.ndarray) -> tuple[State, dict]:
        return super().step(state, y, streams) if self.guards else self.unguarded(state, y)

    def unguarded(self, state: State, y: np.ndarray) -> tuple[State, dict]:
        m, two = self.model, range(2)
        with np.errstate(all="ignore"):
            z, by_z, by_v = m.jacobians_numpy(np.concatenate([state.x, state.y], 1))
            a, b = [by_z[:, i, 0] for i in two], [[by_v[:, i, j] for j in two] for i in two]
            q = [[sum(b[i][c] * m.noise[c, e] * b[j][e] for c in two for e in two if m.noise[c, e]) for j in two] for i in two]
            ap = [a[i] * state.p[:, 0, 0] for i in two]
            h = [[ap[i] * a[j] + q[i][j] for j in two] for i in two]
            innov = y[:, 0] - z[:, 1]
            gain = h[0][1] * (1 / h[1][1])
            x = z[:, 0] + gain * innov
            p = h[0][0] - gain * h[1][0] - h[0][1] * gain + gain * h[1][1] * gain
        status = state.status.copy()
        status[(status == OK) & ~(np.isfinite(x) & (p > 0) & (p < np.inf))] = BAD_COVARIANCE
        vector, matrix = lambda v: v[:, None], lambda v: v[:, None, None]
        out = {"x_pred": z[:, :1], "p_pred": matrix(h[0][0]), "innov": vector(innov), "s": matrix(h[1][1]), "gain": matrix(gain), "x_upd": vector(x), "p_upd": matrix(p)}
        return State(out["x_upd"], out["p_upd"], y.copy(), state.k + 1, status), out

    def predict(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        m, k = self.model, self.model.dim_x
        z, a, b = m.jacobians_numpy(np.concatenate([state.x, state.y], 1))
        ax = a[:, :, :k]
        return z, symmetric(ax @ state.p @ np.swapaxes(ax, 1, 2) + b @ m.noise @ np.swapaxes(b, 1, 2))


class Linear(Extended):
    def __init__(self, model: Model):
        if not model.linear:
            raise FilterError("pkf needs a linear model")
        super().__init__(model)


class Unscented(Gaussian):
    """Unscented filter on the joint state and noise, for any form of model."""

    def __init__(self, model: Model, sigma_set: str = "wan2000", alpha: float = sigma.ALPHA, beta: float = sigma.BETA, kappa: float = sigma.KAPPA):
        super().__init__(model)
        self.unit, self.wm, self.wc = sigma.points(sigma_set, model.dim_x + model.dim, alpha, beta, kappa)
        self.noise_factor = factor(model.noise[None])[0]

    def predict(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        m, k = self.model, self.model.dim_x
        points = state.x[:, None] + self.unit[:, :k] @ np.swapaxes(factor(state.p), 1, 2)
        y = np.broadcast_to(state.y[:, None], (*points.shape[:2], m.dim_y))
        moved = m.g_numpy(np.concatenate([points, y], 2), np.broadcast_to(self.unit[:, k:] @ self.noise_factor.T, (len(points), len(self.unit), m.dim)))
        z = np.einsum("s,nsi->ni", self.wm, moved)
        d = moved - z[:, None]
        return z, symmetric(np.einsum("s,nsi,nsj->nij", self.wc, d, d))


class UnscentedClassic(Gaussian):
    """Unscented filter with separate state and measurement steps; not for pairwise models."""

    def __init__(self, model: Model, sigma_set: str = "wan2000", alpha: float = sigma.ALPHA, beta: float = sigma.BETA, kappa: float = sigma.KAPPA):
        if model.pairwise:
            raise FilterError("ukf can't run a pairwise model")
        super().__init__(model)
        self.unit, self.wm, self.wc = sigma.points(sigma_set, model.dim_x, alpha, beta, kappa)
        k, q = model.dim_x, model.noise
        self.qx, self.r, self.cross, self.h = q[:k, :k], q[k:, k:], None, None
        if model.linear:
            bx, by = model.B[:k, :k], model.B[k:, k:]
            self.qx, self.r, self.cross = bx @ q[:k, :k] @ bx.T, by @ q[k:, k:] @ by.T, bx @ q[:k, k:] @ by.T
            inner = model.A[:k, :k]
            if np.linalg.matrix_rank(inner) == k:
                self.h = model.A[k:, :k] @ np.linalg.inv(inner)

    def predict(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        spread = lambda x, p: x[:, None] + self.unit @ np.swapaxes(factor(p), 1, 2)
        moved = m.f_numpy(spread(state.x, state.p))
        x = np.einsum("s,nsi->ni", self.wm, moved)
        d = moved - x[:, None]
        pxx = symmetric(np.einsum("s,nsi,nsj->nij", self.wc, d, d) + self.qx)
        again = spread(x, pxx)
        seen = again @ self.h.T if self.h is not None else m.h_numpy(again)
        y = np.einsum("s,nsi->ni", self.wm, seen)
        dx, dy = again - x[:, None], seen - y[:, None]
        pyy = symmetric(np.einsum("s,nsi,nsj->nij", self.wc, dy, dy) + self.r)
        pxy = np.einsum("s,nsi,nsj->nij", self.wc, dx, dy)
        if self.cross is not None and self.h is not None:
            hm = self.h @ self.cross
            pxy, pyy = pxy + self.cross, pyy + hm + hm.T
        return np.concatenate([x, y], 1), np.block([[pxx, pxy], [np.swapaxes(pxy, 1, 2), pyy]])


def normalised_weights(log_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights by row that sum to 1, whether the row was degenerate): NaN counts as no weight; a row of none is uniform."""
    lw = np.where(np.isnan(log_weights), -np.inf, log_weights)
    top = lw.max(1, keepdims=True)
    lost = ~np.isfinite(top[:, 0])
    with np.errstate(invalid="ignore"):
        w = np.exp(lw - np.where(np.isfinite(top), top, 0.0))
    w[lost] = 1.0
    return w / w.sum(1, keepdims=True), lost


RESAMPLERS = ("multinomial", "systematic", "stratified", "residual")


def resample(weights: np.ndarray, method: str, u: np.ndarray) -> np.ndarray:
    """Chosen particles (rows, n) for weights (rows, n) and uniform numbers u (rows, n)."""
    if method not in RESAMPLERS:
        raise ParamError(f"there is no resampling method {method!r}")
    rows, n = weights.shape
    out = np.empty((rows, n), np.int64)
    for i, w in enumerate(weights):
        total = np.cumsum(w)
        total[-1] = 1.0
        if method == "systematic":
            out[i] = np.searchsorted(total, (np.arange(n) + u[i, 0]) / n, "right")
        elif method == "stratified":
            out[i] = np.searchsorted(total, (np.arange(n) + u[i]) / n, "right")
        elif method == "multinomial":
            out[i] = np.searchsorted(total, u[i], "left")
        else:
            copies = np.floor(n * w).astype(np.int64)
            sure = np.repeat(np.arange(n), copies)
            left = n * w - copies
            if len(sure) < n:
                rest = np.cumsum(left / left.sum())
                rest[-1] = 1.0
                sure = np.concatenate([sure, np.searchsorted(rest, u[i, : n - len(sure)], "left")])
            out[i] = sure[:n]
    return np.minimum(out, n - 1)


class Particles(Gaussian):
    """Bootstrap particle filter; pairwise models and singular measurement noise can't be run.

    Random numbers come from the seed, the series' stream and the step: results don't depend on partitions.
    """

    weighs_next = True

    def __init__(self, model: Model, n_particles: int = 300, resampling: str = "stratified", threshold: float = 0.5, clip: float = 1e6, seed: int = 0):
        super().__init__(model)
        if resampling not in RESAMPLERS:
            raise ParamError(f"there is no resampling method {resampling!r}")
        if n_particles < 1:
            raise ParamError("n_particles must be positive")
        self.check_form()
        k, q = model.dim_x, model.noise
        r = q[k:, k:]
        if abs(np.linalg.det(r)) <= 1e-15:
            raise InvertibilityError("the measurement noise is singular")
        self.n, self.resampling, self.threshold, self.clip, self.seed = n_particles, resampling, threshold, clip, seed
        self.r_inverse = np.linalg.inv(r)
        self.constant = -0.5 * (model.dim_y * np.log(2 * np.pi) + np.linalg.slogdet(r)[1])
        self.slope = q[:k, k:] @ self.r_inverse
        self.factor = factor(regularised((q[:k, :k] if self.weighs_next else q[:k, :k] - self.slope @ q[:k, k:].T)[None]))[0]

    def check_form(self) -> None:
        if self.model.pairwise:
            raise ParamError("pf can't run a pairwise model")

    def extra(self, n: int, streams: np.ndarray) -> dict:
        m, k = self.model, self.model.dim_x
        z = normals(self.seed, streams, np.zeros(n), 1, self.n, k)
        return {"cloud": m.mean[:k] + z @ factor(m.prior[None, :k, :k])[0].T, "weights": np.full((n, self.n), 1 / self.n), "lost": np.zeros(n, np.int64)}

    def before(self, cloud: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.einsum("np,npi->ni", weights, cloud)
        d = cloud - mean[:, None]
        return mean, np.einsum("np,npi,npj->nij", weights, d, d)

    def moved(self, state: State, y: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(new cloud, innovations, the points that the estimate averages, covariance to add)."""
        cloud = self.model.f_numpy(state.more["cloud"], noise @ self.factor.T)
        innov = y[:, None] - self.model.h_numpy(cloud)
        cloud = np.clip(np.where(np.isfinite(cloud), cloud, 0.0), -self.clip, self.clip)
        return cloud, innov, cloud, np.zeros((cloud.shape[2],) * 2)

    def step(self, state: State, y: np.ndarray, streams: np.ndarray) -> tuple[State, dict]:
        k = self.model.dim_x
        with np.errstate(all="ignore"):
            x_pred, p_pred = self.before(state.more["cloud"], state.more["weights"])
            noise = normals(self.seed, streams, state.k + 1, 2, self.n, k)
            cloud, innov, points, add = self.moved(state, y, noise)
            fit = -0.5 * np.einsum("npi,ij,npj->np", innov, self.r_inverse, innov)
            weights, lost = normalised_weights(np.log(np.maximum(state.more["weights"], 1e-12)) + fit + self.constant)
            x = np.einsum("np,npi->ni", weights, points)
            d = points - x[:, None]
            p = np.einsum("np,npi,npj->nij", weights, d, d) + add
        few = 1 / (weights**2).sum(1) < self.threshold * self.n
        if few.any():
            u = uniforms(self.seed, streams[few], state.k[few] + 1, 7, self.n)
            chosen = resample(weights[few], self.resampling, u)
            cloud[few] = np.take_along_axis(cloud[few], chosen[:, :, None], 1)
            weights[few] = 1 / self.n
        status = state.status.copy()
        status[(status == OK) & ~np.isfinite(p).all((1, 2))] = BAD_COVARIANCE
        run = np.where(lost, state.more["lost"] + 1, 0)
        if (run == MOST_LOST + 1).any():
            log.error("no particle of %d series has had any weight for %d steps, the last of them step %s", int((run == MOST_LOST + 1).sum()), MOST_LOST + 1, int(state.k[run == MOST_LOST + 1][0]) + 1)
        new = State(x, p, y.copy(), state.k + 1, status, {"cloud": cloud, "weights": weights, "lost": run})
        return new, {"x_pred": x_pred, "p_pred": p_pred, "innov": None, "s": None, "gain": None, "x_upd": x, "p_upd": p, "n_degenerate": run}


class PairwiseParticles(Particles):
    """Particle filter that conditions each particle on the new observation before it draws."""

    weighs_next = False

    def check_form(self) -> None:
        pass

    def before(self, cloud: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = cloud.mean(1)
        d = cloud - mean[:, None]
        return mean, np.einsum("npi,npj->nij", d, d) / max(1, self.n - 1)

    def moved(self, state: State, y: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m, k = self.model, self.model.dim_x
        cloud = state.more["cloud"]
        z = m.g_numpy(np.concatenate([cloud, np.broadcast_to(state.y[:, None], (*cloud.shape[:2], m.dim_y))], 2), np.zeros(m.dim))
        innov = y[:, None] - z[:, :, k:]
        points = z[:, :, :k] + innov @ self.slope.T
        new = points + noise @ self.factor.T
        whole = np.isfinite(new).all(2)
        if not whole.all():
            for i in np.flatnonzero(~whole.all(1)):
                new[i, ~whole[i]] = np.median(new[i, whole[i]], axis=0) if whole[i].any() else cloud[i].mean(0)
        return np.clip(new, -self.clip, self.clip), innov, points, self.factor @ self.factor.T


METHODS = {"pkf": Linear, "epkf": Extended, "upkf": Unscented, "ukf": UnscentedClassic, "pf": Particles, "ppf": PairwiseParticles}
_OPTIONS = {"pkf": (), "epkf": ("guards",), "upkf": ("sigma_set", "alpha", "beta", "kappa"), "ukf": ("sigma_set", "alpha", "beta", "kappa"), "pf": ("n_particles", "resampling", "threshold", "clip", "seed"), "ppf": ("n_particles", "resampling", "threshold", "clip", "seed")}


def build(method: str, model: Model, **options) -> Gaussian:
    if method not in METHODS:
        raise ParamError(f"there is no filter {method!r}")
    extra = set(options) - set(_OPTIONS[method])
    if extra:
        raise ParamError(f"{method} has no option {sorted(extra)[0]!r}")
    return METHODS[method](model, **options)


def register(name: str, kernel: type[Gaussian], options: tuple[str, ...] = ()) -> None:
    """Adds a filter of one's own: a class of the kind above, and the names of its options. A name that is taken is an error."""
    if name in METHODS:
        raise ParamError(f"filter {name!r} exists")
    METHODS[name], _OPTIONS[name] = kernel, tuple(options)
