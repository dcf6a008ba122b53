"""The haplotype-cluster model's ordered recursion, for all samples of a tile at once. Pure numpy, no Spark.

Shapes: n samples, S sites, G grids, C clusters, K ancestries. Both haplotypes are alike, so what is known of two clusters is
symmetric: arrays hold the P = C (C + 1) / 2 unordered pairs, each with the value of one of its orders. Arrays over grids have
the grid first, so that a step works on one (n, P) block that stays in cache, and sums over clusters are matrix products with
the few tables of ``Pairs``. ``rates`` is (G, 3): no, one given, both haplotypes jump.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: No emission is less likely.
FLOOR = 1e-10


class Pairs:
    """Pairs (a, b), a <= b: ``weight`` orders each has; ``first`` and ``second`` (P, C) mark a, and b where it differs."""

    def __init__(self, clusters: int) -> None:
        self.a, self.b = np.triu_indices(clusters)
        self.weight = np.where(self.a == self.b, 1.0, 2.0)
        self.first = np.eye(clusters)[self.a]
        self.second = np.where((self.a == self.b)[:, None], 0.0, np.eye(clusters)[self.b])
        self.marginal = self.first + self.second  # sums over the other cluster
        self.spread = np.ascontiguousarray((self.first + np.eye(clusters)[self.b]).T)  # x_a + x_b of a pair
        self.square = np.zeros((clusters, clusters), np.int64)
        self.square[self.a, self.b] = self.square[self.b, self.a] = np.arange(len(self.a))

    def times(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Pairs (..., P) as a symmetric matrix times a vector (..., C)."""
        return (x * v[..., self.b]) @ self.first + (x * v[..., self.a]) @ self.second

    def whole(self, x: np.ndarray) -> np.ndarray:
        """(..., P) as (..., C, C)."""
        return x[..., self.square]


@lru_cache
def pairs_of(clusters: int) -> Pairs:
    return Pairs(clusters)


def rates_of(er: np.ndarray) -> np.ndarray:
    return np.stack([er * er, er * (1 - er), (1 - er) * (1 - er)], -1)


def allele_pairs(p: np.ndarray) -> np.ndarray:
    """(S, 3, P): probability of 0, 1 and 2 alternate alleles for two clusters of alternate frequencies ``p`` (S, C)."""
    k = pairs_of(p.shape[1])
    a, b = p[:, k.a], p[:, k.b]
    return np.stack([(1 - a) * (1 - b), a * (1 - b) + (1 - a) * b, a * b], 1)


def site_emission(gl: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(S, n, P), not floored, from likelihoods (n, S, 3)."""
    return np.matmul(gl.transpose(1, 0, 2), allele_pairs(p))


def grid_emission(site: np.ndarray, weight: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Floored emissions by site, or by grid if ``starts`` has the first site of each: products, normalised over the states."""
    if starts is None or len(starts) == len(site):
        return np.maximum(site, FLOOR)
    e = np.multiply.reduceat(site, starts, axis=0)
    return np.maximum(e / (e @ weight)[..., None], FLOOR)


def emission(gl: np.ndarray, p: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    return grid_emission(site_emission(gl, p), pairs_of(p.shape[1]).weight, starts)


def forward(e: np.ndarray, rates: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled probabilities of the pairs given the data up to each grid (G, n, P), and 1 / their sums before scaling (G, n).

    ``pi`` is (G, C), or (G, n, C) where it differs by sample. A step costs O(C^2) a sample.
    """
    k = pairs_of(pi.shape[-1])
    alpha, scale = np.empty_like(e), np.empty(e.shape[:2])
    shared = pi.ndim == 2
    # One haplotype jumps to where the other is, or both do: pi (x) t + t (x) pi, a product with a table where pi is shared.
    spread = np.einsum("pc,gp->gcp", k.first, pi[:, k.b]) + np.einsum("cp,gp->gcp", np.eye(pi.shape[-1])[:, k.b], pi[:, k.a]) if shared else None
    for s in range(len(e)):
        own = pi[s]
        if s == 0:
            a = e[0] * (own[..., k.a] * own[..., k.b])
        else:
            t = alpha[s - 1] @ k.marginal
            t *= rates[s, 1]
            t += (rates[s, 2] / 2) * own
            a = t @ spread[s] if shared else t[:, k.a] * own[:, k.b] + t[:, k.b] * own[:, k.a]
            a += rates[s, 0] * alpha[s - 1]
            a *= e[s]
        np.divide(1.0, a @ k.weight, out=scale[s])
        np.multiply(a, scale[s][:, None], out=alpha[s])
    return alpha, scale


def backward(e: np.ndarray, rates: np.ndarray, pi: np.ndarray, scale: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From the last grid to the first: its number, beta (alpha * beta sums to 1) and emission * beta * scale, (n, P) each."""
    k = pairs_of(pi.shape[-1])
    shared = pi.ndim == 2
    onto = k.first * pi[:, k.b, None] + k.second * pi[:, k.a, None] if shared else None  # (G, P, C)
    beta = np.ones(e.shape[1:])
    for s in range(len(e) - 1, -1, -1):
        x = e[s] * beta
        x *= scale[s][:, None]
        yield s, beta, x
        if s:
            one = x @ onto[s] if shared else k.times(x, pi[s])
            both = one @ pi[s] if shared else (one * pi[s]).sum(1)
            one *= rates[s, 1]
            one += (rates[s, 2] / 2) * both[:, None]
            beta = one @ k.spread
            beta += rates[s, 0] * x


@dataclass
class Passes:
    alpha: np.ndarray  # (G, n, P), scaled to sum 1 at each grid
    beta: np.ndarray  # alpha * beta sums to 1 at each grid
    scale: np.ndarray  # (G, n)

    @property
    def gamma(self) -> np.ndarray:
        return self.alpha * self.beta

    @property
    def loglik(self) -> np.ndarray:
        return -np.log(self.scale).sum(0)


def passes(e: np.ndarray, rates: np.ndarray, pi: np.ndarray) -> Passes:
    """Forward and backward recursions, both kept."""
    alpha, scale = forward(e, rates, pi)
    beta = np.empty_like(e)
    for s, own, _ in backward(e, rates, pi, scale):
        beta[s] = own
    return Passes(alpha, beta, scale)


def expand(starts: np.ndarray | None, sites: int) -> np.ndarray:
    """Each site's grid."""
    if starts is None:
        return np.arange(sites)
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, sites)))


def allele_counts(weighed: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected reference and alternate alleles of each cluster, (S, C) each; together 1 a sample and site.

    ``weighed`` (S, 3, P) is the sum over samples of a genotype's likelihood times the pair's probability over its emission.
    """
    k = pairs_of(p.shape[1])
    w0, w1, w2 = weighed[:, 0], weighed[:, 1], weighed[:, 2]
    a, b = p[:, k.a], p[:, k.b]
    ref = ((1 - a) * (w0 * (1 - b) + w1 * b)) @ k.first + ((1 - b) * (w0 * (1 - a) + w1 * a)) @ k.second
    alt = (a * (w1 * (1 - b) + w2 * b)) @ k.first + (b * (w1 * (1 - a) + w2 * a)) @ k.second
    return ref, alt


class Weighing:
    """Sums of ``allele_counts``, a grid at a time."""

    def __init__(self, gl: np.ndarray, site: np.ndarray, starts: np.ndarray | None) -> None:
        self.gl, self.site = np.ascontiguousarray(gl.transpose(1, 2, 0)), site
        self.stops = np.append(np.arange(len(site)) if starts is None else starts, len(site))
        self.sums = np.empty((len(site), 3, site.shape[2]))

    def add(self, grid: int, gamma: np.ndarray) -> None:
        for s in range(self.stops[grid], self.stops[grid + 1]):
            self.sums[s] = self.gl[s] @ (gamma / np.maximum(self.site[s], FLOOR))


def impute_counts(gl: np.ndarray, p: np.ndarray, starts: np.ndarray | None, rates: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Log-likelihood of each sample, and sums over samples: expected alleles ``ref`` and ``alt`` (S, C), ``jump`` (G, C), jumps of
    one haplotype into each cluster (at the first grid, where it starts), and ``hap`` (G, C), haplotypes in each cluster."""
    k = pairs_of(p.shape[1])
    site = site_emission(gl, p)
    e = grid_emission(site, k.weight, starts)
    alpha, scale = forward(e, rates, pi)
    alleles, hap, jump = Weighing(gl, site, starts), np.empty((len(e), len(k.a))), np.empty(pi.shape)
    at = np.arange(len(k.a))
    for s, beta, x in backward(e, rates, pi, scale):
        gamma = alpha[s] * beta
        hap[s] = gamma.sum(0)
        alleles.add(s, gamma)
        if s:
            into = rates[s, 1] * (alpha[s - 1] @ k.marginal) + rates[s, 2] * pi[s]  # of the other haplotype: it stays or jumps
            z = x.T @ into
            jump[s] = pi[s] * (z[at, k.b] @ k.first + z[at, k.a] @ k.second)
    hap = hap @ k.marginal
    jump[0] = hap[0]
    ref, alt = allele_counts(alleles.sums, p)
    return -np.log(scale).sum(0), {"ref": ref, "alt": alt, "jump": jump, "hap": hap}


def posteriors(gl: np.ndarray, p: np.ndarray, gamma: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """(n, S, 3) genotype posteriors, which sum to 1, from pair probabilities (G, n, P)."""
    w = gamma[expand(starts, gl.shape[1])] / np.maximum(site_emission(gl, p), FLOOR)
    w *= pairs_of(p.shape[1]).weight
    found = gl * np.matmul(w, allele_pairs(p).transpose(0, 2, 1)).transpose(1, 0, 2)
    return found / found.sum(2, keepdims=True)


def pair_prior(rates: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """(G, P): probability of a pair of clusters before any data."""
    k = pairs_of(pi.shape[1])
    out = pi[:, k.a] * pi[:, k.b]
    for s in range(1, len(pi)):
        t = rates[s, 1] * (out[s - 1] @ k.marginal) + (rates[s, 2] / 2) * pi[s]
        out[s] = rates[s, 0] * out[s - 1] + t[k.a] * pi[s, k.b] + t[k.b] * pi[s, k.a]
    return out


def used_prior(hap: np.ndarray) -> np.ndarray:
    """(G, P): pair probabilities from how much clusters are used (G, C), as if haplotypes were independent."""
    k, share = pairs_of(hap.shape[1]), hap / hap.sum(1, keepdims=True)
    return share[:, k.a] * share[:, k.b]


def cluster_likelihoods(gamma: np.ndarray, prior: np.ndarray, clusters: int) -> np.ndarray:
    """Likelihood of each pair of clusters given the data, (n, G, P), scaled to sum 1 over both orders at each grid."""
    raw = gamma / prior[:, None]
    raw /= (raw @ pairs_of(clusters).weight)[..., None]
    return np.ascontiguousarray(raw.transpose(1, 0, 2))


def mixture(q: np.ndarray, f: np.ndarray) -> np.ndarray:
    """(n, G, C): each sample's cluster probabilities, from ancestry shares q (n, K) and cluster frequencies f (K, G, C)."""
    return (q @ f.reshape(len(f), -1)).reshape(len(q), *f.shape[1:])


def admixture_step(likely: np.ndarray, q: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood (n), expected ancestry-cluster counts (K, G, C) over samples, and expected ancestries (n, K) over grids.

    The other haplotype is summed out first, so a step costs C^2 + CK a sample and grid, not C^2 K^2.
    """
    n, k = q.shape
    h = mixture(q, f)
    other = pairs_of(f.shape[2]).times(likely, h)
    total = (h * other).sum(2)
    other /= total[:, :, None]
    share = other.reshape(n, -1)
    return np.log(total).sum(1), 2 * f * (q.T @ share).reshape(f.shape), 2 * q * (share @ f.reshape(k, -1).T)


def admixture_counts(gl: np.ndarray, p: np.ndarray, starts: np.ndarray, rates: np.ndarray, pi: np.ndarray, prior: np.ndarray, q: np.ndarray, f: np.ndarray, least_prior: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``admixture_step``, from genotype likelihoods: each grid's cluster likelihoods are used as the recursion comes by."""
    k = pairs_of(p.shape[1])
    e = emission(gl, p, starts)
    alpha, scale = forward(e, rates, pi)
    loglik, counts, own = np.zeros(len(q)), np.empty(f.shape), np.zeros_like(q)
    for s, beta, _ in backward(e, rates, pi, scale):
        likely = alpha[s] * beta
        likely /= prior[s]
        likely /= (likely @ k.weight)[:, None]
        if least_prior:
            likely[:, prior[s] < least_prior] = 0
        fs = f[:, s]
        h = q @ fs
        share = k.times(likely, h)
        total = (h * share).sum(1)
        share /= total[:, None]
        loglik += np.log(total)
        counts[:, s] = fs * (q.T @ share)
        own += share @ fs.T
    return loglik, 2 * counts, 2 * q * own


def haplotype_prior(er: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """(G, C): a haplotype's cluster before any data, of cluster shares (..., G, C)."""
    out = pi.copy()
    for s in range(1, pi.shape[-2]):
        out[..., s, :] += er[s] * (out[..., s - 1, :] - pi[..., s, :])
    return out


def unread_loglik(sites: int, grids: int, clusters: int) -> float:
    """Of a sample without reads: every pair of clusters emits alike, a third at a site, or its share of all at a grid of some sites."""
    return -sites * np.log(3.0) if grids == sites else -2.0 * grids * np.log(clusters)


def unread_counts(p: np.ndarray, starts: np.ndarray, rates: np.ndarray, pi: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """What ``impute_counts`` gives for one sample without reads: clusters are as before any data, alleles as the clusters have them."""
    er = rates[:, 0] + rates[:, 1]
    hap = haplotype_prior(er, pi)
    jump = (1 - er)[:, None] * pi
    jump[0] = hap[0]
    at = hap[expand(starts, len(p))]
    return unread_loglik(len(p), len(starts), pi.shape[1]), {"ref": at * (1 - p), "alt": at * p, "jump": jump, "hap": hap}


def unread_posteriors(p: np.ndarray, starts: np.ndarray, rates: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """(S, 3): genotype posteriors of a sample without reads."""
    alt = (haplotype_prior(rates[:, 0] + rates[:, 1], pi)[expand(starts, len(p))] * p).sum(1)
    return np.stack([(1 - alt) ** 2, 2 * alt * (1 - alt), alt**2], 1)


def unread_joint(p: np.ndarray, rates: np.ndarray, f: np.ndarray, q: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ref``, ``alt`` and ``counts`` of ``joint_counts``, summed over samples without reads: what they have is linear in their shares,
    of which ``q`` (K) is the sum, but for the first site's counts, which go by the sum ``squares`` (K, K) of products of two shares."""
    er = rates[:, 0] + rates[:, 1]
    at = np.tensordot(q, haplotype_prior(er, f), 1)
    counts = f * q[:, None, None] * (1 - er)[:, None]
    counts[:, 0] = squares @ f[:, 0]
    return at * (1 - p), at * p, counts


@dataclass
class Joint:
    loglik: np.ndarray  # (n)
    ref: np.ndarray  # (S, C)
    alt: np.ndarray
    counts: np.ndarray  # (K, S, C), ancestry-cluster jumps over samples
    own: np.ndarray  # (n, K), expected ancestries over sites
    gamma: np.ndarray | None = None  # (S, n, P)
    ancestry: np.ndarray | None = None  # (n, S, K), which sum to 1
    jumps: np.ndarray | None = None  # (n, S, K, C), what counts sums


def joint_counts(gl: np.ndarray, p: np.ndarray, rates: np.ndarray, q: np.ndarray, f: np.ndarray, each: bool = False) -> Joint:
    """The joint model's sums, and with ``each`` what every sample has at every site."""
    k = pairs_of(p.shape[1])
    site, h = site_emission(gl, p), np.ascontiguousarray(mixture(q, f).transpose(1, 0, 2))
    e = grid_emission(site, k.weight)
    alpha, scale = forward(e, rates, h)
    alleles, counts, own = Weighing(gl, site, None), np.empty(f.shape), np.zeros_like(q)
    gammas, ys, zs = (np.empty_like(e), np.empty((*q.shape, len(e))), np.empty((len(q), len(e), *f[:, 0].shape))) if each else (None, None, None)
    for s, beta, x in backward(e, rates, h, scale):
        gamma, fs = alpha[s] * beta, f[:, s]
        alleles.add(s, gamma)
        if s:
            before = alpha[s - 1] @ k.marginal
            x_before, x_h = k.times(x, before), k.times(x, h[s])
            jumped = rates[s, 1] * x_before + rates[s, 2] * x_h  # the second haplotype stays or jumps, the first jumps
            stayed = rates[s, 0] * ((x * alpha[s - 1]) @ k.weight) + rates[s, 1] * (x_h * before).sum(1)
            counts[:, s] = fs * (q.T @ jumped)
            y = q * (jumped @ fs.T + stayed[:, None])
        else:
            jumped, fs = gamma @ k.marginal, np.ones_like(fs)
            counts[:, s] = q.T @ jumped
            y = q
        own += y
        if each:
            gammas[s], ys[:, :, s] = gamma, y
            zs[:, s] = q[:, :, None] * fs[None] * jumped[:, None, :]
    ref, alt = allele_counts(alleles.sums, p)
    return Joint(-np.log(scale).sum(0), ref, alt, counts, own, gammas, ys.transpose(0, 2, 1) if each else None, zs)
