"""Jaccard join: all links are found, and each document's number of them."""
import itertools
import random

import numpy as np
import pytest

from fleetstate.llm import jaccard
from tests.llm.conftest import SCHEMA, doc, hard_rows, words


def brute_links(rows, k, percent):
    sets = []
    for r in rows:
        w = words(r[1], True)
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    n = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            n[a] += 1
            n[b] += 1
    return sorted((str(r[0]), r[1] or "", x) for r, x in zip(rows, n))


@pytest.mark.parametrize("k,percent,cell", [(4, 85, 3000), (5, 80, 4)])
def test_links_of_each_document(spark, hard, monkeypatch, k, percent, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)  # 4: cells are dealt out in parts
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = [doc(1000 + i, " ".join(base[:j] + ["other"] + base[j + 1:])) for i, j in enumerate([7 * x for x in range(25)] + [0, 0, 7])]
    out = jaccard.join(spark.createDataFrame(near, SCHEMA).repartition(3).unionByName(hard), k, percent)
    want = brute_links(near + hard_rows(), k, percent)
    assert sorted((str(r["doc_id"]), r["text"] or "", r["n_links"]) for r in out.collect()) == want
    assert sum(x for *_, x in want) > 28 * 27  # all pairs of the near copies, not a tree of them


def test_every_pair_once():
    r = random.Random(6)
    for _ in range(20):
        pool = [r.getrandbits(60) for _ in range(60)]
        sets = [np.unique(np.array(pool[: r.randint(35, 60)], np.uint64)) for _ in range(30)]
        want = {(a, b) for a, b in itertools.combinations(range(30), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        got = [tuple(sorted(x)) for x in jaccard.links(sets, 80)]
        assert len(got) == len(set(got)) and set(got) == want
