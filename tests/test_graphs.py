"""Large graphs' eigenvalues and communities against numpy and planted parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.operators import communities, spectra
from lattica.plans import graphs
from lattica.runtime import written


def planted(parts, size, inside, between, seed=1):
    rng = np.random.default_rng(seed)
    n = parts * size
    chance = np.where(np.arange(n)[:, None] // size == np.arange(n) // size, inside, between)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < chance[i, j]]


def adjacency(edges):
    ids = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for u, v in edges:
        a[at[u], at[v]] = a[at[v], at[u]] = 1
    return a


def five(values, nodes, edges):
    """The five as numpy has them."""
    lam = np.maximum(np.sort(np.abs(values))[::-1], 1e-12)
    p = lam / lam.sum()
    p = p[p > 1e-12]
    h = -(p * np.log(p)).sum()
    return {"oh": lam[0] / lam.mean(), "oh_nodes": lam[0] * nodes / lam.sum(), "eta": 1 - h / np.log(len(p)), "density": 2 * edges / nodes / (nodes - 1), "gap": (lam[0] - lam[1]) / (lam[0] + 1e-10), "xi": np.exp(h) / len(p), "lambda_1": lam[0]}


def test_leading_eigenvalues_equal_numpy(spark):
    edges = planted(4, 60, 0.3, 0.02)
    got = spectra.leading_eigenvalues(spark.createDataFrame(edges, "u long, v long"), k=12, beside=6)
    exact = np.linalg.eigvalsh(adjacency(edges))
    assert np.abs(got - exact[np.argsort(-np.abs(exact))][:12]).max() < 1e-6


def test_eigenvalues_of_small_and_degenerate_graphs(spark):
    ring = [(i, (i + 1) % 30) for i in range(29)] + [(0, 29)]
    for edges in (ring, [(1, 2)]):
        exact = np.linalg.eigvalsh(adjacency(edges))
        got = spectra.leading_eigenvalues(spark.createDataFrame([tuple(sorted(e)) for e in set(edges)], "u long, v long"))
        assert np.allclose(np.sort(got), exact, atol=1e-7)
    with pytest.raises(ValueError, match="not converged"):
        spectra.leading_eigenvalues(spark.createDataFrame(planted(3, 60, 0.1, 0.05), "u long, v long"), k=20, beside=2, steps=1)


def test_repeat_trades_spectrum_equals_numpy(spark):
    sf_dir = "/root/testdata/sf0.001"
    edges = [tuple(r) for r in graphs.repeat_trades(spark, sf_dir).collect()]
    got = graphs.repeat_trade_spectrum(spark, sf_dir).first()
    a = adjacency(edges)  # connected at this size
    values = np.linalg.eigvalsh(a)
    values = values[np.argsort(-np.abs(values))][:50]
    for name, value in five(values, len(a), len(edges)).items():
        assert got[name] == pytest.approx(value, abs=1e-6)


def test_giant_component(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (20, 21)]
    assert sorted(map(tuple, spectra.giant_component(spark.createDataFrame(edges, "u long, v long")).collect())) == [(10, 11), (11, 12), (12, 13)]


def quality(edges, label):
    m = len(edges)
    total = {}
    for e in edges:
        for x in e:
            total[label[x]] = total.get(label[x], 0) + 1
    return sum(label[a] == label[b] for a, b in edges) / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_communities_find_planted_parts(spark):
    many = {0: planted(4, 25, 0.5, 0.01), 1: planted(2, 40, 0.4, 0.02, seed=2)}
    rows = [(g, u, v, 1) for g, edges in many.items() for u, v in edges]
    rows += [(2, 0, i, 1) for i in range(1, 40)] + [(3, 2 * i, 2 * i + 1, 1) for i in range(20)]  # a star, and pairs
    edges = written(spark.createDataFrame(rows, "g long, u long, v long, w long"), "planted")
    labels = communities.find_communities(edges)
    found = {}
    for r in labels.collect():
        found.setdefault(r["g"], {})[r["id"]] = r["c"]
    told = {r["g"]: r for r in communities.modularity(communities.both_ways(edges), labels).collect()}
    assert len(set(found[2].values())) == 1 and len(set(found[3].values())) == 20
    counts = {r["g"]: (r["intra"], r["inter"]) for r in communities.split_counts(edges, labels).collect()}
    for g, own in many.items():
        size = {0: 25, 1: 40}[g]
        assert len({(x // size, c) for x, c in found[g].items()}) == len(set(found[g].values())) == {0: 4, 1: 2}[g]
        assert told[g]["modularity"] == pytest.approx(quality(own, found[g]), abs=1e-12)
        inside = sum(found[g][a] == found[g][b] for a, b in own)
        assert counts[g] == (inside, len(own) - inside)
        names = sorted(found[g])
        kernel = kernels.modularity_groups(len(names), own)
        assert told[g]["modularity"] >= quality(own, dict(zip(names, kernel.tolist(), strict=True))) - 1e-12
