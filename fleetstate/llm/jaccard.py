"""N-gram Jaccard join by T-occurrence search.

Documents become sets of hashed word shingles; equal sets are one node. Two sets that link share a
shingle among the first few of each in any one order of all shingles (prefix filter), rare ones
first here. A shingle that no other document has can't be shared, so a set whose prefix has no
other shingles links with nothing; that leaves few sets. Nodes that share prefix shingles, directly
or by way of others, form a cell, so a link never leaves a cell. Within a cell each set queries an
inverted index of the smaller ones: with T the overlap it needs, lists are divided by DivideSkip.
The short lists are merged (by one sort, a heap's work as a vector), what occurs T minus the number
of long lists times or more is looked up in the long lists by binary search, and what reaches the
exact overlap is linked. Cells too large for a task are dealt out in pairs of parts, each a task of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstate.llm import common as C
from fleetstate.llm.blocks import Lookup, blocks, pack_numbers, parts, tally, unpack_numbers
from fleetstate.llm.cells import components

BLOCK_BYTES = 16 << 20  # a block's sets take some ten times that in a task
RANGE_ITEMS = 4_000_000  # shingles that one task counts at once
CELL = 3000  # nodes of a cell that one task takes whole; larger cells are dealt out in parts of half that
LONG_WEIGHT = 0.01  # DivideSkip's mu
LAST = (1 << 63) - 1


def sets_of(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than k are one shingle."""
    return _sets(*C.text_bytes(col), k)


def _sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    words, starts = C.hash_words(data, offs, lower=True)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out.append(np.unique(C.shingle_hashes(words[a:b], k if b - a >= k else b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """The least overlap with any set that can link: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def nodes_of(docs: DataFrame, k: int, percent: int, scratch: C.Scratch) -> DataFrame:
    """doc_key, text_key, node (hash of the set), n_shingles, and for sets that may link: prefix (the
    rarest shingles that another document has, too) and set."""
    packed = blocks(docs, ["doc_key", "text_key"], BLOCK_BYTES, scratch)

    def count(batches):
        n = sum(len(s) for batch in batches for sizes, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) for _, _, data, offs in parts(sizes, blob) for s in _sets(data, offs, k))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    total = packed.select("sizes", "bytes").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # how often documents have a shingle is asked for by this many of its bits: 256 places or more a shingle
    shift = np.uint64(max(0, 64 - (max(1, total).bit_length() + 8)))
    ranges = 1 << max(0, (total // RANGE_ITEMS).bit_length())
    range_shift = np.uint64(64 - int(shift) - (ranges.bit_length() - 1)) if ranges > 1 else None

    def ask(batches):
        for batch in batches:
            for block, sizes, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, counts = [], []
                for _, _, data, offs in parts(sizes, blob):
                    u, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(data, offs, k)]) >> shift, return_counts=True)
                    keys.append(u)
                    counts.append(c)
                u, c = tally(np.concatenate(keys), np.concatenate(counts))
                cut = np.searchsorted(u, np.arange(1, ranges, dtype=np.uint64) << range_shift) if ranges > 1 else []
                rows = [(r, pack_numbers(a, True), pack_numbers(b)) for r, (a, b) in enumerate(zip(np.split(u, cut), np.split(c, cut), strict=True)) if len(a)]
                if rows:
                    r, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(r), pa.int64()), pa.array(r, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["block", "range", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        block = table["block"].to_pylist()
        keys = [unpack_numbers(x, True) for x in table["keys"].to_pylist()]
        u, n = tally(np.concatenate(keys), np.concatenate([unpack_numbers(x) for x in table["counts"].to_pylist()]))
        u, n = u[n > 1], n[n > 1]
        out = []
        for b, own in zip(block, keys, strict=True):
            at = np.searchsorted(u, own)
            at = at[(at < len(u)) & (u[np.minimum(at, len(u) - 1)] == own)] if len(u) else at[:0]
            out.append((b, pack_numbers(u[at], True), pack_numbers(n[at])))
        b, x, y = zip(*out, strict=True)
        return pa.table([pa.array(b, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["block", "keys", "counts"])

    answers = packed.select("block", "sizes", "bytes").mapInArrow(ask, "block long, range int, keys binary, counts binary").groupBy("range").applyInArrow(merge, "block long, keys binary, counts binary")
    names = ["doc_key", "text_key", "node", "n_shingles", "prefix", "set"]

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [unpack_numbers(x, True) for x in right["keys"].to_pylist()]
        counts = [unpack_numbers(x) for x in right["counts"].to_pylist()]
        often = Lookup(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.uint64), *counts]))
        rows = []
        for i in range(left.num_rows):
            doc, text, sizes, blob = (left[c][i].as_py() for c in ("doc_key", "text_key", "sizes", "bytes"))
            for at, _, data, offs in parts(sizes, blob):
                sets = _sets(data, offs, k)
                n_all = often.get(np.concatenate([np.zeros(0, np.uint64), *sets]) >> shift, 1)
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                for j, s in enumerate(sets):
                    own = n_all[edges[j]: edges[j + 1]]
                    shared = own > 1
                    n, least = len(s), needed(len(s), percent)
                    some, mine = s[shared], own[shared]
                    able = n > 0 and len(some) >= least
                    prefix = some[np.lexsort((some, mine))[: len(some) - least + 1]] if able else None
                    node = int(C.mix(C.mix(s).sum(dtype=np.uint64, keepdims=True) * np.uint64(3) + np.uint64(n)).view(np.int64)[0]) if n else 0
                    rows.append((doc[at + j], text[at + j], node, n, None if prefix is None else prefix.view(np.int64), s.view(np.int64) if able else None))
        cols = list(zip(*rows, strict=True))
        return pa.table([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:])], names)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(choose, "doc_key long, text_key long, node long, n_shingles long, prefix array<long>, set array<long>")


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All links among ``sets`` (sorted distinct hashes), each pair once."""
    return [(x, int(y)) for x, ys in neighbours(sets, percent) for y in ys]


def neighbours(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each of ``sets`` that links with smaller ones (or earlier ones of its size), and all of those.
    With ``part``, only links between sets of different parts."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    n = len(sets)
    _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    pos = np.repeat(np.arange(n), size)
    often = np.bincount(token) > 1
    width = np.int64(n + 1)
    keys = np.sort((token * width + pos)[often[token]])  # inverted lists, one after another: (shingle, set)
    starts = np.concatenate([[0], np.cumsum(size)])
    for x in range(n):
        t = needed(int(size[x]), percent)
        low = int(np.searchsorted(size, t))  # smaller sets can't overlap enough
        if low >= x:
            continue
        own = token[starts[x]: starts[x + 1]]
        own = own[often[own]]
        if len(own) < t:
            continue
        begin, end = np.searchsorted(keys, own * width + low), np.searchsorted(keys, own * width + x)
        length = end - begin
        if (length > 0).sum() < t:
            continue
        longest = int(length.max())
        n_long = min(t - 1, int(t / (LONG_WEIGHT * np.log2(longest + 1) + 1)))
        by_length = np.argsort(length, kind="stable")
        short, long = by_length[: len(own) - n_long], by_length[len(own) - n_long:]
        spans = length[short]
        at = np.repeat(begin[short], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        found, count = np.unique(keys[at] % width, return_counts=True)
        good = count >= max(1, t - n_long)
        found, count = found[good], count[good]
        if part is not None:
            other = part[order[found]] != part[order[x]]
            found, count = found[other], count[other]
        linked = []
        for at in range(0, len(found), 64):
            some, have = found[at: at + 64], count[at: at + 64]
            probe = own[long][None, :] * width + some[:, None]
            hit = np.searchsorted(keys, probe)
            both = have + (keys[np.minimum(hit, len(keys) - 1)] == probe).sum(1)
            linked.append(some[100 * both >= percent * (size[x] + size[some] - both)])
        if sum(map(len, linked)):
            yield int(order[x]), order[np.concatenate(linked)]


def join(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: its columns, n_shingles (long), component_id, n_links (long: the
    other rows that it links with, copies included), and stays: whether the row is the one of its component to keep (the smallest id's; all of them, if rows repeat it).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles
    (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; shorter texts are one shingle). component_id is
    the smallest doc_id that links reach, its own included. Null or empty text has no shingles and
    links with nothing; so does a text of white space. A null id counts as larger than any other,
    and where it is the smallest, component_id is null. Rows of one id are documents of their own.
    Columns of the appended names are replaced.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    with C.Scratch(docs.sparkSession) as scratch:
        result = C.table(_components(base.select("doc_key", "text_key", "text").where("text is not null"), k, percent, scratch), "components")
    first = F.struct("doc_key", "text_key")
    kind = docs.schema["doc_id"].dataType
    done = base.drop("text").join(result, ["doc_key", "text_key"], "left").withColumn("least", F.coalesce("least", first))
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_shingles", "component_id", "n_links", "stays")],
                       F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("least.doc_key") != LAST, F.col("least.doc_key")).cast(kind).alias("component_id"),
                       F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       ((F.col("doc_key") == F.col("least.doc_key")) & F.col("text_key").eqNullSafe(F.col("least.text_key"))).alias("stays"))


def _components(docs: DataFrame, k: int, percent: int, scratch: C.Scratch) -> DataFrame:
    """doc_key, text_key, n_shingles, least: the smallest (doc_key, text_key) of the component, n_links."""
    member = C.table(nodes_of(docs, k, percent, scratch), "shingles", scratch)
    node = C.table(member.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_key", "text_key", "prefix", "set")).alias("first"), F.count("*").alias("copies")).select("node", "copies", "first.doc_key", "first.text_key", "first.prefix", "first.set"), "nodes", scratch)
    linked = C.table(_links(node.where("prefix is not null").select("node", "copies", "prefix", "set"), percent), "links", scratch)
    found = C.cut(components(linked.select("a", "b")).select(F.col("id").alias("node"), "component"))
    degree = linked.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    first = F.struct("doc_key", "text_key")
    least = node.select("node", first.alias("first")).join(found, "node").groupBy("component").agg(F.min("first").alias("least"))
    known = node.select("node", "copies", first.alias("first")).join(found.join(least, "component").select("node", "least"), "node", "left").join(degree, "node", "left")
    known = known.select("node", F.coalesce("least", "first").alias("least"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    return member.select("doc_key", "text_key", "node", "n_shingles").distinct().join(known, "node", "left").select("doc_key", "text_key", "n_shingles", "least", "n_links")


def _links(node: DataFrame, percent: int) -> DataFrame:
    """a: a node that links, once a task that finds links of it; b: the least node they reach there; n:
    the documents it links with there. Each pair of nodes is looked at by one task: that of its parts."""
    token = node.select("node", F.explode("prefix").alias("token"))
    hub = token.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "low")
    cell = components(token.join(hub, "token").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    cell = C.cut(cell.select(F.col("id").alias("node"), F.col("component").alias("cell")))
    total = max(1, cell.count())
    size = cell.groupBy("cell").agg(F.count("*").alias("n"))
    bins = -(-total // CELL)
    part = F.ceil(F.col("n") / (CELL // 2))
    dealt = cell.join(size, "cell").withColumn("parts", F.when(F.col("n") <= CELL, F.lit(1)).otherwise(part).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cell"), F.lit(bins))).otherwise(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    tasks = dealt.select("node", "cell", "part", "parts", other).select("node", "cell", "part", (F.col("part") != F.col("other")).alias("across"), task.alias("task"))
    queries = tasks.join(node.select("node", "copies", "set"), "node").select("task", "cell", "node", "part", "across", "copies", "set")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cells, ids = np.asarray(table["cell"]), np.asarray(table["node"])
        order = np.lexsort((ids, cells))
        order = order[np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (cells[order][1:] != cells[order][:-1])])]  # repeated rows once
        lists = table["set"].chunk(0)
        offs, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        part, across, copies = np.asarray(table["part"]), np.asarray(table["across"]), np.asarray(table["copies"])
        a, b, n = [], [], []
        for group in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            least = ids[group]  # of each set's component so far; links to it stand for the ones found
            weight, degree = copies[group], np.zeros(len(group), np.int64)
            for x, ys in neighbours([values[offs[i]: offs[i + 1]] for i in group.tolist()], percent, part[group] if across[group[0]] else None):
                degree[x] += weight[ys].sum()
                degree[ys] += weight[x]
                met = np.unique(np.append(least[ys], least[x]))
                if len(met) > 1:
                    least[np.isin(least, met)] = met[0]
            own = np.flatnonzero(degree)
            a += ids[group[own]].tolist()
            b += least[own].tolist()
            n += degree[own].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return queries.groupBy("task").applyInArrow(search, "a long, b long, n long")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85).select("doc_id", "n_shingles", "component_id")


OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
