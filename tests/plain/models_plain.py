"""Plain versions of the model operators, to compare with."""

import numpy as np
from dataclasses import dataclass

LOG_ZERO = -1e10


@dataclass
class Gmm:
    """Gaussian mixture with diagonal covariance."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """rows x components of weighted log densities."""
        base = np.log(self.weights) - 0.5 * (np.log(self.variances).sum(axis=1) + self.means.shape[1] * np.log(2 * np.pi))
        return base - 0.5 * ((x[:, None, :] - self.means) ** 2 / self.variances).sum(axis=2)

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        p = self.logs(x)
        m = p.max(axis=1)
        return np.maximum(m + np.log(np.exp(p - m[:, None]).sum(axis=1)), LOG_ZERO)

    def bic(self, x: np.ndarray) -> float:
        k, d = self.means.shape
        return -2 * float(self.log_likelihood(x).sum()) + (2 * k * d + k - 1) * np.log(len(x))

    def adapt(self, x: np.ndarray, relevance: float = 16.0, rounds: int = 5) -> "Gmm":
        """Maximum a posteriori means; weights and variances stay."""
        g = Gmm(self.weights, self.means.copy(), self.variances)
        for _ in range(rounds):
            r = np.exp(g.logs(x) - g.log_likelihood(x)[:, None])
            g.means = (r.T @ x + relevance * g.means) / (r.sum(axis=0) + relevance)[:, None]
        return g

    def mix(self, other: "Gmm") -> "Gmm":
        return Gmm(np.concatenate([self.weights, other.weights]) / 2, np.concatenate([self.means, other.means]), np.concatenate([self.variances, other.variances]))

    def select(self, index, invert: bool = False) -> "Gmm":
        keep = np.isin(np.arange(len(self.weights)), index) ^ invert
        return Gmm(self.weights[keep] / self.weights[keep].sum(), self.means[keep], self.variances[keep])


def gmm_fit(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100, tol: float = 1e-4, floor: float = 1e-3) -> Gmm:
    """Expectation maximisation from k-means++ seeds; components that vanish or collapse are dropped."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    g = Gmm(np.full(k, 1 / k), np.array(centres, float), np.tile(np.maximum(x.var(axis=0), floor), (k, 1)))
    last = -np.inf
    for _ in range(rounds):
        ll = g.log_likelihood(x)
        r = np.exp(g.logs(x) - ll[:, None])
        n = r.sum(axis=0)
        alive = n > 1e-6
        r, n = r[:, alive], n[alive]
        means = (r.T @ x) / n[:, None]
        variances = np.maximum((r.T @ (x * x)) / n[:, None] - means**2, floor)
        g = Gmm(n / n.sum(), means, variances)
        if abs(ll.mean() - last) < tol:
            break
        last = ll.mean()
    return g


@dataclass
class Hmm:
    """Left-right model: transition matrix and a mixture for each state."""

    transitions: np.ndarray
    states: list[Gmm]

    def log_b(self, x: np.ndarray) -> np.ndarray:
        return np.stack([s.log_likelihood(x) for s in self.states], axis=1)

    def forward(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-probability and the log forward table; the first frame is in state 0."""
        b = self.log_b(x)
        with np.errstate(divide="ignore"):
            a = np.log(self.transitions)
        f = np.full(b.shape, -np.inf)
        f[0, 0] = b[0, 0]
        for t in range(1, len(x)):
            f[t] = np.logaddexp.reduce(f[t - 1][:, None] + a, axis=0) + b[t]
        return float(np.logaddexp.reduce(f[-1])), f

    def backward(self, x: np.ndarray) -> np.ndarray:
        b = self.log_b(x)
        with np.errstate(divide="ignore"):
            a = np.log(self.transitions)
        g = np.zeros(b.shape)
        for t in range(len(x) - 2, -1, -1):
            g[t] = np.logaddexp.reduce(a + (b[t + 1] + g[t + 1])[None, :], axis=1)
        return g

    def learn(self, x: np.ndarray, rounds: int = 10, tol: float = 1e-3, tau: float = 20.0) -> "Hmm":
        """Baum-Welch transitions in the log domain, then adapted means."""
        h, last = self, -np.inf
        for _ in range(rounds):
            p, f = h.forward(x)
            g, b = h.backward(x), h.log_b(x)
            with np.errstate(divide="ignore"):
                a = np.log(h.transitions)
            xi = np.logaddexp.reduce(f[:-1, :, None] + a[None] + (b[1:] + g[1:])[:, None, :] - p, axis=0)
            gamma = np.logaddexp.reduce(f[:-1] + g[:-1] - p, axis=0)
            with np.errstate(invalid="ignore"):
                t = np.exp(xi - gamma[:, None])
            t = np.triu(np.nan_to_num(t))
            sums = t.sum(axis=1, keepdims=True)
            h = Hmm(np.where(sums > 0, t / np.where(sums > 0, sums, 1), h.transitions), h.states)
            if abs(p - last) < tol:
                break
            last = p
        p, f = h.forward(x)
        r = np.exp(f + h.backward(x) - p)
        states = []
        for s, w in zip(h.states, r.T):
            q = np.exp(s.logs(x) - s.log_likelihood(x)[:, None]) * w[:, None]
            states.append(Gmm(s.weights, (q.T @ x + tau * s.means) / (q.sum(axis=0) + tau)[:, None], s.variances))
        return Hmm(h.transitions, states)


def left_right(n: int, stay: float = 0.6) -> np.ndarray:
    a = np.diag(np.full(n, stay)) + np.diag(np.full(n - 1, 1 - stay), 1)
    a[-1, -1] = 1.0
    return a


def kernel_matrix(x: np.ndarray, y: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3) -> np.ndarray:
    if kind == "linear":
        return x @ y.T
    if kind == "poly":
        return (gamma * (x @ y.T) + 1) ** degree
    return np.exp(-gamma * ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def kernel_kmeans(k: np.ndarray, n: int, weights: np.ndarray | None = None, seed: int = 0, rounds: int = 50, tol: float = 1e-5) -> np.ndarray:
    """Labels from a kernel matrix; stops when few labels change.  An empty cluster is an error."""
    w = np.ones(len(k)) if weights is None else weights
    labels = np.random.default_rng(seed).integers(0, n, len(k))
    for _ in range(rounds):
        d = np.zeros((len(k), n))
        for c in range(n):
            m = labels == c
            if not m.any():
                raise ValueError(f"cluster {c} is empty")
            total = w[m].sum()
            d[:, c] = (w[m][:, None] * w[m] * k[np.ix_(m, m)]).sum() / total**2 - 2 * (w[m] * k[:, m]).sum(axis=1) / total
        new = d.argmin(axis=1)
        changed = (new != labels).mean()
        labels = new
        if changed < tol:
            break
    return labels


def adf(x: np.ndarray, max_lag: int | None = None) -> tuple[float, int]:
    """Augmented Dickey-Fuller statistic with a constant, and the lag with the least AIC."""
    x = np.asarray(x, float)
    most = int(np.ceil(12 * (len(x) / 100) ** 0.25)) if max_lag is None else max_lag
    most = min(most, len(x) // 2 - 2)
    dx = np.diff(x)

    def fit(lag: int, first: int):
        y = dx[first:]
        columns = [x[first:-1], *(dx[first - j : len(dx) - j] for j in range(1, lag + 1)), np.ones(len(y))]
        a = np.stack(columns, axis=1)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rest = y - a @ beta
        ll = -len(y) / 2 * (np.log(2 * np.pi * (rest @ rest) / len(y)) + 1)
        cov = np.linalg.pinv(a.T @ a) * (rest @ rest) / (len(y) - a.shape[1])
        return beta[0] / np.sqrt(cov[0, 0]), 2 * a.shape[1] - 2 * ll

    lag = min(range(most + 1), key=lambda j: fit(j, most)[1])
    return float(fit(lag, lag)[0]), lag
