"""Greedy communities by a heap are those of the plain form, which looks through all links for every merge."""

import random
import time

import pytest

from siltstone.operators import graphs


def plain(us, vs):
    m, links = float(len(us)), {}
    for u, v in zip(us, vs):
        links.setdefault(u, {})[v] = links.get(u, {}).get(v, 0) + 1
        links.setdefault(v, {})[u] = links.get(v, {}).get(u, 0) + 1
    weight, member = {n: sum(x.values()) for n, x in links.items()}, {n: [n] for n in links}
    while True:
        gain, pair = max(((c / m - weight[a] * weight[b] / (2 * m * m), (a, b)) for a in links for b, c in links[a].items() if a < b), key=lambda x: (x[0], [-i for i in x[1]]), default=(0, None))
        if gain <= 1e-12:
            return {n: min(ns) for ns in member.values() for n in ns}
        a, b = pair
        for n, c in links.pop(b).items():
            links[n].pop(b)
            if n != a:
                links[a][n] = links[n][a] = links[a].get(n, 0) + c
        weight[a] += weight.pop(b)
        member[a] += member.pop(b)


@pytest.mark.parametrize("seed", range(12))
def test_against_the_plain_form(seed):
    rng = random.Random(seed)
    n = rng.randint(5, 60)
    e = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.choice([1, 2, 4]) * n)})
    us, vs = [a for a, _ in e], [b for _, b in e]
    assert graphs._merged_greedily(us, vs) == plain(us, vs)


def test_many_links_in_little_time(spark):
    rng = random.Random(1)
    e = sorted({tuple(sorted((i, (i // 20) * 20 + rng.randrange(20)) if rng.random() < 0.9 else (i, rng.randrange(10_000)))) for i in range(10_000) for _ in range(5)})
    df = spark.createDataFrame([("g", a, b) for a, b in e if a != b], "graph string, u long, v long")
    began = time.time()
    assert graphs.greedy_communities(df, "graph").count() == 10_000 and time.time() - began < 60
