"""Merkle manifest: trees, log and proofs against a plain recursion."""
import hashlib
import zlib

from pyspark.sql import functions as F

from fleetstate.llm import common as C
from fleetstate.llm import merkle as M
from tests.llm.conftest import SCHEMA, doc, hard_rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, s, la, n, t):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, la, n, t)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def others(tree, i):
    got = []
    for row in tree[:-1]:
        run = i - i % 3
        got += [row[x] for x in range(run, min(run + 3, len(row))) if x != i]
        i //= 3
    return got


def postorder(tree, level, j):
    """(level, index) in completion order, by recursion."""
    out = []
    if level:
        for x in range(3 * j, min(3 * j + 3, len(tree[level - 1]))):
            out += postorder(tree, level - 1, x)
    return [*out, (level, j)]


def brute(rows):
    """One (doc_id, leaf, subroot, root, proof_sha256) a row, sorted, and the sources' trees."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], leaf(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = [(d, h, trees[s][-1][0], top[-1][0], H(*others(trees[s], i), *others(top, k))) for k, s in enumerate(names) for i, (d, h) in enumerate(by[s])]
    return sorted(out, key=str), trees


def found(df):
    with C.Scratch(df.sparkSession) as scratch:
        text = F.replace("text", F.lit("\n"), F.lit(""))
        m = M.manifest(df, scratch, {"found": M.leaf_digest(*[text if c == "text" else F.col(c) for c in M.FIELDS])})
        p = M.proofs(m)
        rows = p.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("digest", "subroot", "root")], F.sha2(F.lower(F.hex("siblings")), 256).alias("p"), M.folded(F.col("digest")).alias("own"), M.folded(F.col("found")).alias("changed"), F.col("text") if "text" in p.columns else F.lit(None)).collect()
        flat = M.log(m).collect()
    return rows, flat


def check(df, rows):
    got, flat = found(df)
    want, trees = brute(rows)
    assert sorted((tuple(r[:5]) for r in got), key=str) == want
    assert all(r["own"] == r["root"] for r in got)
    line = {leaf(r[0], r[3], r[2], r[4], r[1]) for r in rows if r[1] and "\n" in r[1]}
    assert all((r["changed"] == r["root"]) == (r["digest"] not in line) for r in got)
    logs = {}
    for r in flat:
        logs.setdefault(r["key"], {})[r["position"]] = (r["level"], r["index"], r["digest"].hex())
    for s, tree in trees.items():
        mine = logs["n" if s is None else "s" + s]
        order = postorder(tree, len(tree) - 1, 0)
        assert [mine[i] for i in range(len(mine))] == [(a, b, tree[a][b]) for a, b in order]


def test_hard_rows_equal_the_recursion(hard):
    check(hard, hard_rows())


def test_trees_of_several_blocks_and_a_hot_source(spark):
    n = 2 * M.SPAN + 5  # three blocks, the last one short
    rows = [doc(i * 7 % n, f"text\n{i}" if i % 3 else f"text {i}", source="hot") for i in range(n)]
    rows += [doc(i, f"é {i}", source=f"s{i % 40}") for i in range(121)] + [doc(3, "x", source=""), doc(4, "y", source=None), doc(4, "y", source=None)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


def test_places_are_the_completion_order():
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 100]:
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        tree = levels([x.hex() for x in leaves])
        assert len(tree) - 1 == M.depth(n)
        nodes = M.append_log(leaves, M.depth(n))
        order = postorder(tree, len(tree) - 1, 0)
        assert [M.position(a, b, n) for a, b in order] == list(range(len(order)))
        assert [nodes[32 * i: 32 * i + 32].hex() for i in range(len(order))] == [tree[a][b] for a, b in order]
        for i, (siblings, path) in enumerate(M.tile_proofs(nodes, n, M.depth(n), b"", b"")):
            assert M.fold(leaves[i], siblings, path).hex() == tree[-1][0] and siblings.hex() == "".join(others(tree, i))
            assert n == 1 or M.fold(b"\0" * 32, siblings, path).hex() != tree[-1][0]


def test_no_documents_have_no_root(spark, none):
    rows, flat = found(none)
    assert rows == [] and flat == []


def test_query_on_a_table(spark, tmp_path):
    rows = [doc(i, f"a\nb{i}" if i % 2 else None, source="ab"[i % 2]) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == brute(rows)[0]
    even = lambda i: zlib.crc32(str(i).encode()) % 2 == 0
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(30) if i % 2 and even(i)}
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
