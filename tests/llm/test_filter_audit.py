"""Filter interaction audit: matrix, flags and orders against plain loops."""
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from fleetstate.llm import common as C
from fleetstate.llm import filter_audit as A
from tests.llm.conftest import SCHEMA, doc, hard_rows, words


def rows_():
    r = hard_rows()
    r += [doc(100, "Aa " * 300, lang=None), doc(101, "Aa " * 300, lang=""), doc(99, "Aa " * 300, lang="de"), doc(102, "a$b " * 10, lang="de"), doc(103, "", lang="de"), doc(104, "été " * 201, lang="fr")]
    r += [doc(200 + i, "same text & more", lang="fr") for i in range(50)] + [doc(None, "same text & more", lang="fr"), doc(200, "same text & more", lang="en")]
    return r


def failed(rows):
    out = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        ids = [x[0] for x in rows if (x[1] or "") == t and x[0] is not None]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and bool(ids) and min(ids) < r[0]}
        out.append((r[0], r[2] or "", *(fails[f] for f in "ABCDE")))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    flags, out = failed(rows), {}
    for part in {f[1] for f in flags}:
        mine = [f for f in flags if f[1] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                at = 2 + "ABCDE".index(f)
                gone = [x for x in left if x[at]]
                left = [x for x in left if not x[at]]
                shapley[f] += len(gone)
                fails = [x for x in mine if x[at]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(x[2:]) == 1 for x in fails), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


LABELS = [(1, 1, 0), (10, 1, 1), (11, 0, 1), (20, 1, 0), (30, None, 1), (30, 1, None), (100, 1, 1), (205, 1, 0), (210, 0, 0), (None, 1, 1), (9999, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_flags_and_audit_equal_the_loops(spark, labels):
    rows = rows_()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    with C.Scratch(spark) as scratch:
        flags = A.document_flags(df, scratch)
        assert sorted(map(tuple, flags.collect()), key=str) == sorted(failed(rows), key=str)
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in A.audit(flags, labels).collect()}
    want = brute(rows, LABELS)
    assert len(got) == 600 * len({k[0] for k in want}) and got == want


def test_the_matrix_holds_every_word(spark):
    rows = rows_()
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").repartition(2)
    with C.Scratch(spark) as scratch:
        local = A.shards(df, ["doc_id"], scratch)
        matrix = A.term_matrix(local, ["doc_id"], scratch)
        word = {r["id"]: r["word"] for r in A.dictionary(local, scratch).collect()}
        assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)
        got = []
        for r in matrix.collect():
            starts = r["starts"]
            for i, d in enumerate(r["doc_id"]):
                cols = r["cols"][starts[i]: starts[i + 1]]
                assert cols == sorted(set(cols))
                got.append((d, sorted((word[c], n) for c, n in zip(cols, r["counts"][starts[i]: starts[i + 1]]))))
    assert sorted(got, key=str) == sorted(((r[0], sorted(Counter(words(r[1])).items())) for r in rows), key=str)


def test_long_texts_are_counted_in_stretches(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(1_300_000))
    df = spark.createDataFrame([(1, "a b a"), (2, long + " " + long), (3, None), (4, "  "), (5, "a"), (6, " " * 5_000_000 + long)], "doc_id long, text string").coalesce(1)
    with C.Scratch(spark) as scratch:
        shards = A.shards(df, ["doc_id"], scratch).collect()
    got = {}
    for r in shards:
        total = np.concatenate([[0], np.cumsum(r["counts"])])[r["starts"]]
        got |= {d: (int(n), int(k)) for d, n, k in zip(r["doc_id"], np.diff(total), np.diff(r["starts"]))}
    assert got == {1: (3, 2), 2: (2_600_000, 70_000), 3: (0, 0), 4: (0, 0), 5: (1, 1), 6: (1_300_000, 70_000)} and len(shards) > 1


def test_no_value_per_word_reaches_spark(spark):
    """Shards are written, read, sorted and joined as packed bytes, so that what the JVM holds doesn't go with the cells."""
    rows = [(i, " ".join(f"w{(i * 37 + j) % 5000}" for j in range(1500)), "en") for i in range(40)]
    with C.Scratch(spark) as scratch:
        flags = A.document_flags(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), scratch)
        assert flags.where("A or B").count() == 0 and flags.count() == 40
        made = next(p for p in scratch.paths if "/audit_shards-" in p).removeprefix("file:")
        parts = [pq.ParquetFile(f).metadata for f in Path(made).glob("*.parquet")]
        values = sum(m.row_group(g).column(c).num_values for m in parts for g in range(m.num_row_groups) for c in range(m.num_columns))
    assert 40 * 6 <= values < 40 * 10  # 60,000 cells


def test_stretches_of_a_shard_are_merged(monkeypatch):
    """A long text's words and cells are held once, not once a stretch."""
    monkeypatch.setattr(A, "HELD_WORDS", 1000)
    shard, most = A._Shard(), 0
    for k in range(60):
        text = " ".join(f"w{(k * 300 + j) % 900}" for j in range(600)).encode()
        shard.add(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        most = max(most, shard.wide, sum(map(len, shard.rows)))
    assert most <= 2 * 900 + 600
    shard.n = 1
    one = shard.batch(0, [], [])
    starts, cols, counts = A._cells(one)
    words = A._unpack_words(one.column(one.schema.get_field_index("words"))[0].as_py())
    assert starts.tolist() == [0, 900] and {words[c]: n for c, n in zip(cols, counts)} == {f"w{i}": 40 for i in range(900)}


def test_many_short_documents_are_several_shards(spark):
    rows = spark.range(0, 300_000, 1, 1).selectExpr("id as doc_id", "if(id % 3 = 0, 'a b', null) as text")
    with C.Scratch(spark) as scratch:
        got = A.shards(rows, ["doc_id"], scratch).selectExpr("size(doc_id) as n", "size(counts) as cells", "array_min(doc_id) as low", "array_max(doc_id) as high").orderBy("low").collect()
    assert len(got) > 1 and sum(r["n"] for r in got) == 300_000 and sum(r["cells"] for r in got) == 200_000
    assert [r["low"] for r in got] == [0, *(r["high"] + 1 for r in got[:-1])] and all(r["n"] == r["high"] - r["low"] + 1 for r in got)


def test_no_documents(spark, none, labels):
    with C.Scratch(spark) as scratch:
        assert A.audit(A.document_flags(none, scratch), labels).count() == 0


def test_query_on_tables(spark, tmp_path, labels):
    rows = rows_()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in A.op11_filter_audit(spark, str(tmp_path)).collect()}
    assert got == brute(rows, LABELS)
