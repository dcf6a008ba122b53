from __future__ import annotations

import numpy as np
import pytest

from lociweave.jobs import kernel


def model(seed, n=3, sites=7, c=3, k=2):
    rng = np.random.default_rng(seed)
    return rng.dirichlet([1, 1, 1], (n, sites)), rng.uniform(0.1, 0.9, (sites, c)), rng.dirichlet(np.ones(c), sites), rng.uniform(0.2, 0.95, sites), rng.dirichlet(np.ones(k), n), rng.dirichlet(np.ones(c), (k, sites))


def brute(e, er, pi):
    """Forward and backward with whole transition matrices of both haplotypes."""
    c = pi.shape[1]
    moves = [er[s] * np.eye(c) + (1 - er[s]) * np.tile(pi[s], (c, 1)) for s in range(len(pi))]
    forward = [np.outer(pi[0], pi[0]) * e[:, 0]]
    for s in range(1, len(pi)):
        forward.append(np.einsum("nab,ac,bd->ncd", forward[-1], moves[s], moves[s]) * e[:, s])
    backward = [np.ones_like(forward[0])]
    for s in range(len(pi) - 1, 0, -1):
        backward.append(np.einsum("ac,bd,ncd->nab", moves[s], moves[s], e[:, s] * backward[-1]))
    return np.stack(forward, 1), np.stack(backward[::-1], 1)


def whole(x, c=3):
    """Pairs by grid, sample and pair as (n, G, C, C)."""
    return kernel.pairs_of(c).whole(x).swapaxes(0, 1)


@pytest.mark.parametrize("seed", range(4))
def test_recursions_match_brute_force(seed):
    gl, p, pi, er, _, _ = model(seed)
    e = kernel.emission(gl, p)
    found = kernel.passes(e, kernel.rates_of(er), pi)
    forward, backward = brute(whole(e), er, pi)
    total = forward[:, -1].sum((1, 2))
    np.testing.assert_allclose(found.loglik, np.log(total))
    np.testing.assert_allclose(whole(found.gamma), forward * backward / total[:, None, None, None], atol=1e-12)
    np.testing.assert_allclose(whole(found.gamma).sum((2, 3)), 1)
    each = kernel.passes(e, kernel.rates_of(er), np.repeat(pi[:, None], len(gl), 1))
    np.testing.assert_allclose(each.gamma, found.gamma)


@pytest.mark.parametrize("seed", range(4))
def test_statistics(seed):
    gl, p, pi, er, _, _ = model(seed)
    n, sites, _ = gl.shape
    e, rates = kernel.emission(gl, p), kernel.rates_of(er)
    gamma = kernel.passes(e, rates, pi).gamma
    loglik, sums = kernel.impute_counts(gl, p, None, rates, pi)
    full = whole(gamma)
    w = full / whole(e)
    x, y = p[None, :, :, None], p[None, :, None, :]
    g0, g1, g2 = (gl[:, :, g, None, None] for g in range(3))
    np.testing.assert_allclose(sums["ref"], (w * (1 - x) * (g0 * (1 - y) + g1 * y)).sum((0, 3)))
    np.testing.assert_allclose(sums["alt"], (w * x * (g1 * (1 - y) + g2 * y)).sum((0, 3)))
    np.testing.assert_allclose((sums["ref"] + sums["alt"]).sum(1), n)
    np.testing.assert_allclose(sums["hap"], full.sum((0, 3)))
    gp = kernel.posteriors(gl, p, gamma)
    np.testing.assert_allclose(gp.sum(2), 1)
    np.testing.assert_allclose(gp[:, :, 2], (w * x * y * g2).sum((2, 3)))
    # Expected jumps of the first haplotype, with the jump as an event of its own.
    forward, backward = brute(whole(e), er, pi)
    total = forward[:, -1].sum((1, 2))
    np.testing.assert_allclose(loglik, np.log(total))
    np.testing.assert_allclose(sums["jump"][0], full[:, 0].sum((0, 2)))
    c = pi.shape[1]
    for s in range(1, sites):
        second = er[s] * np.eye(c) + (1 - er[s]) * np.tile(pi[s], (c, 1))
        want = np.einsum("nab,bd,c,ncd->nc", forward[:, s - 1], second, (1 - er[s]) * pi[s], whole(e)[:, s] * backward[:, s]) / total[:, None]
        np.testing.assert_allclose(sums["jump"][s], want.sum(0))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7])
def test_grids(size):
    gl, p, pi, er, _, _ = model(5)
    starts = np.arange(0, 7, size)
    e = whole(kernel.emission(gl, p, starts))
    site = whole(kernel.site_emission(gl, p))
    for g, s in enumerate(starts):
        product = site[:, s : s + size].prod(1)
        if size > 1:
            product = product / product.sum((1, 2), keepdims=True)
        np.testing.assert_allclose(e[:, g], np.maximum(product, kernel.FLOOR))
    assert kernel.expand(starts, 7).tolist() == [i // size for i in range(7)]
    _, sums = kernel.impute_counts(gl, p, starts, kernel.rates_of(er[starts]), pi[starts])
    assert sums["jump"].shape == (len(starts), 3) and sums["ref"].shape == (7, 3) and np.allclose((sums["hap"]).sum(1), 3)


def test_prior_is_the_marginal_without_data():
    gl, p, pi, er, _, _ = model(2)
    forward, _ = brute(np.ones((1, 7, 3, 3)), er, pi)
    np.testing.assert_allclose(kernel.pairs_of(3).whole(kernel.pair_prior(kernel.rates_of(er), pi)), forward[0])


@pytest.mark.parametrize("seed", range(3))
def test_factorised_admixture_step_is_the_four_way_one(seed):
    gl, p, pi, er, q, f = model(seed)
    rates = kernel.rates_of(er)
    likely = kernel.cluster_likelihoods(kernel.passes(kernel.emission(gl, p), rates, pi).gamma, kernel.pair_prior(rates, pi), 3)
    loglik, counts, own = kernel.admixture_step(likely, q, f)
    w = np.einsum("ngab,nk,kga,nl,lgb->nklgab", kernel.pairs_of(3).whole(likely), q, f, q, f)
    total = w.sum((1, 2, 4, 5))
    w = w / total[:, None, None, :, None, None]
    np.testing.assert_allclose(loglik, np.log(total).sum(1))
    np.testing.assert_allclose(counts, (w.sum((2, 5)) + w.sum((1, 4))).sum(0))
    np.testing.assert_allclose(own, (w.sum((2, 3, 4, 5)) + w.sum((1, 3, 4, 5))))
    np.testing.assert_allclose(own.sum(1), 2 * 7)
    for x, y in zip(kernel.admixture_counts(gl, p, np.arange(7), rates, pi, kernel.pair_prior(rates, pi), q, f), (loglik, counts, own)):
        np.testing.assert_allclose(x, y)


def test_joint_ancestries_sum_to_one_and_one_ancestry_is_the_plain_model():
    gl, p, pi, er, q, f = model(3)
    rates = kernel.rates_of(er)
    found = kernel.joint_counts(gl, p, rates, q, f, each=True)
    np.testing.assert_allclose(found.ancestry.sum(2), 1)
    assert (found.jumps >= 0).all() and (found.jumps.sum((2, 3)) <= 1 + 1e-12).all()
    np.testing.assert_allclose(found.jumps.sum(0).transpose(1, 0, 2), found.counts)
    np.testing.assert_allclose(found.ancestry.sum(1), found.own)
    one = kernel.joint_counts(gl, p, rates, np.ones((3, 1)), pi[None], each=True)
    loglik, sums = kernel.impute_counts(gl, p, None, rates, pi)
    np.testing.assert_allclose(one.gamma, kernel.passes(kernel.emission(gl, p), rates, pi).gamma)
    np.testing.assert_allclose(one.counts[0], sums["jump"])
    np.testing.assert_allclose(one.loglik, loglik)
    np.testing.assert_allclose(one.ref, sums["ref"])


def test_joint_ancestries_match_a_model_of_ancestry_and_cluster():
    """Each haplotype's state is its ancestry and cluster; a jump draws both anew."""
    gl, p, pi, er, q, f = model(4, n=2, sites=4)
    rates = kernel.rates_of(er)
    found = kernel.joint_counts(gl, p, rates, q, f, each=True)
    e = whole(kernel.emission(gl, p))
    for i in range(2):
        prior = np.array([(q[i, :, None] * f[:, s]).ravel() for s in range(4)])  # (S, K C)
        of = np.tile(np.arange(3), 2)
        moves = [er[s] * np.eye(6) + (1 - er[s]) * np.tile(prior[s], (6, 1)) for s in range(4)]
        fwd = [np.outer(prior[0], prior[0]) * e[i, 0][np.ix_(of, of)]]
        for s in range(1, 4):
            fwd.append(np.einsum("ab,ac,bd->cd", fwd[-1], moves[s], moves[s]) * e[i, s][np.ix_(of, of)])
        np.testing.assert_allclose(found.loglik[i], np.log(fwd[-1].sum()))


def test_prior_of_used_clusters_sums_to_one():
    found = kernel.pairs_of(4).whole(kernel.used_prior(np.random.default_rng(1).uniform(0.1, 3, (5, 4))))
    np.testing.assert_allclose(found.sum((1, 2)), 1)
    np.testing.assert_allclose(found, found.transpose(0, 2, 1))
