"""Substring dedup, Jaccard join, decontamination: brute force on the hard rows."""
import itertools
import random

import numpy as np
import pytest

from fleetstate.llm import cells, decontaminate, jaccard, substrings
from tests.llm.conftest import SCHEMA, doc, hard_rows, words

BIG = (1 << 63) - 1


def brute_dedup(rows, window):
    least = {}
    for r in rows:
        w, k = words(r[1]), BIG if r[0] is None else r[0]
        for i in range(len(w) - window + 1):
            t = tuple(w[i:i + window])
            least[t] = min(least.get(t, k), k)
    out = []
    for r in rows:
        w, k = words(r[1]), BIG if r[0] is None else r[0]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < k:
                gone[i:i + window] = [True] * window
        out.append((str(r[0]), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window", [8, 50])
def test_substring_dedup(hard, window):
    rows = [r for r in hard_rows() if r[0] != 50]
    out = substrings.dedup(hard.where("doc_id is null or doc_id <> 50"), window)
    assert out.columns.count("n_words") == out.columns.count("spans") == 1 and "row" in out.columns
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], " ".join(words(r["kept_text"]))) for r in got) == brute_dedup(rows, window)
    for r in got:
        assert r["n_removed"] == sum(s["to"] - s["from"] for s in r["spans"])
        if not r["n_removed"]:
            assert r["kept_text"] == r["text"]


def test_substring_dedup_empty_table(none):
    assert substrings.dedup(none).count() == 0


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(2)
    core = r.integers(0, 6, 60).astype(np.uint64)  # few words: many runs and repeats
    seen = None
    for _ in range(30):
        left, right = (r.integers(0, 6, r.integers(0, 40)).astype(np.uint64) for _ in range(2))
        w = np.concatenate([left, core, right])
        _, first, name, place = substrings.anchors(substrings.C.mix(w), np.array([0, len(w)]), 50)
        inside = (first >= len(left)) & (first <= len(left) + 10)
        own = (name[inside].tolist(), (place[inside] - len(left)).tolist())
        seen = seen or own
        assert own == seen


def brute_components(rows, k, percent):
    sets = []
    for r in rows:
        w = words(r[1], True)
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, BIG), BIG if r[0] is None else r[0])
    return sorted((str(r[0]), len(s), str(None if least[g] == BIG else least[g])) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize("k,percent,cell", [(4, 85, 3000), (5, 80, 4)])
def test_jaccard_join(hard, monkeypatch, k, percent, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)  # 4: the cell of near copies is dealt out in parts
    monkeypatch.setattr(jaccard, "RANGE_ITEMS", 5000)
    out = jaccard.join(hard, k, percent)
    assert out.columns.count("stays") == 1
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out.collect()) == brute_components(hard_rows(), k, percent)
    # one text of each group stays; rows that repeat it in full stay with it
    kept = out.where("stays").select("component_id", "doc_id", "text").distinct()
    assert kept.groupBy("component_id").count().where("count > 1 and component_id not in (30)").count() == 0


def test_jaccard_join_empty_table(none):
    assert jaccard.join(none, 4, 85).count() == 0


def test_links_find_what_brute_force_finds():
    r = random.Random(4)
    for trial in range(30):
        pool = [r.getrandbits(60) for _ in range(60)]
        sets = [np.unique(np.array(r.sample(pool, r.randint(1, 50)) if r.random() < 0.5 else pool[: r.randint(35, 60)], np.uint64)) for _ in range(25)]
        percent = r.choice([50, 80, 85])
        want = brute_group(sets, percent)
        group = list(range(len(sets)))
        for a, b in jaccard.links(sets, percent):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
        assert partition(group) == partition(want)


def brute_group(sets, percent):
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return group


def partition(group):
    return sorted(sorted(i for i, g in enumerate(group) if g == x) for x in set(group))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7 * i) for i in range(20, 25)] + [(500, 500), (601, 600), (600, 602)]
    got = {r["id"]: r["component"] for r in cells.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[7 * i] == 100 for i in range(20, 25)) and got[602] == got[601] == 600 and 500 not in got


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item, here!"), (3, None), (4, " "), (12, "SHORT item here"), (5, "solo"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def bench_words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, hard, small, monkeypatch):
    if not small:
        monkeypatch.setattr(decontaminate.hits, "__defaults__", (decontaminate.SIZE, 0))
    long_item = BENCH[0][1]
    rows = [doc(60, "see: " + long_item.upper().replace(" ", "--") + " end"), doc(61, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), doc(62, "alpha beta gamma delta epsilon zeta eta theta iota"),
            doc(63, "a short item here and short ITEM here solo"), doc(64, "short item"), doc(64, "no hit"), doc(65, long_item + " " + long_item), doc(None, "solo")]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(hard)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns.count("n_words") == 1
    want = []
    for r in rows + hard_rows():
        w, hit, items = bench_words(r[1]), set(), set()
        for i, t in BENCH:
            b = bench_words(t)
            for at in range(max(1, len(b) - 9) if b else 0):
                win = b[at:at + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        items.add("" if i is None else str(i))
        want.append((str(r[0]), len(w), len(hit), ",".join(sorted(items)), bool(hit)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"] or []), r["contaminated"]) for r in out.collect())
    assert got == sorted(want)


def test_decontamination_empty_tables(spark, hard, none):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(hard, bench.where("false")).where("contaminated or n_hit > 0").count() == 0
