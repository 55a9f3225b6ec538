"""Merkle manifest of a dataset, kept as a postorder append log.

Leaves of a source ascend by id; every three consecutive nodes become their parent, level by level,
up to the source's subroot, and subroots become the root in the same way. A tree is written by
aligned builders: each takes 3**LEVELS consecutive leaves and appends every node at the moment its
last child is there, which is the postorder of the block's subtree. The blocks' roots are the leaves
of the next layer's builders. As subtree sizes are known, the place of any node in a builder's slice
(``place``) and in the log of the whole tree (``position``) is a closed form of its level and index,
so that the siblings of a proof are read by address, without pointers or a search.

A builder holds one block, a proof reader one block and its documents' digests; neither grows with
the data. Digests are SHA-256; a parent hashes its children's hex texts, joined.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C

ARITY = 3
LEVELS = 7  # of a builder's block
SPAN = ARITY**LEVELS
BROADCAST_ROWS = 200_000  # offsets: one row per range partition and source, some 40 bytes
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TILE = "key string, block long, n long, held int, nodes binary, root binary"


# ---------------------------------------------------------------- closed forms

def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while ARITY**levels < n:
        levels += 1
    return levels


def height(n: int) -> int:
    """Levels above its leaves that a builder writes in a tree of ``n`` leaves."""
    return LEVELS if n > SPAN else depth(n)


def place(level: int, index: int, held: int, top: int) -> int:
    """Place, in completion order, of a node in a subtree of ``held`` leaves and ``top`` levels. It
    completes with its last leaf: after all nodes that end before that leaf, and its own ``level``
    descendants that end with it."""
    last = min((index + 1) * ARITY**level, held) - 1
    return sum(last // ARITY**i for i in range(top + 1)) + level


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the append log of its whole tree of ``n`` leaves."""
    return place(level, index, n, depth(n))


# ---------------------------------------------------------------- leaves in order

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values: ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def _number(batches):
    """Append part (range partition) and local (number of the row within its key, there)."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = batch.column(batch.schema.get_field_index("key"))
        new = np.empty(n, bool)
        new[0] = key[0].as_py() != last
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        local = at - np.maximum.accumulate(np.where(new, at, 0))
        first = int(np.argmax(new)) if new.any() else n
        local[:first] += seen
        last, seen = key[n - 1].as_py(), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local)], [*batch.schema.names, "part", "local"])


def ranked(rows: DataFrame, order: list[str], scratch: C.Scratch) -> DataFrame:
    """Append ordinal (from 0 within ``key``, by ``order``) and n (rows of the key).

    Range partitions split a key of any size; each numbers its rows, and a key's earlier partitions
    are added from a table with one row per partition and key."""
    parts = C.shuffle_parts(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    by = ["key", *order]
    local = C.table(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_number, schema), "merkle_ranked", scratch)
    of_key = Window.partitionBy("key")
    counts = local.groupBy("key", "part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = C.table(counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(of_key).alias("n")), "merkle_offsets", scratch)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return local.join(offsets, ["key", "part"]).select(*rows.columns, (F.col("before") + F.col("local")).alias("ordinal"), "n")


# ---------------------------------------------------------------- builders

def _hash(hexes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(hexes)).digest()


def append_log(leaves: list[bytes], top: int) -> bytes:
    """The nodes of the subtree of ``leaves`` and ``top`` levels in completion order, 32 bytes each."""
    out = bytearray()
    waiting: list[list[bytes]] = [[] for _ in range(top + 1)]  # nodes whose parent isn't complete
    for i, node in enumerate(leaves):
        level, end = 0, i == len(leaves) - 1
        while True:
            out += node
            waiting[level].append(node.hex().encode())
            if level == top or not (end or len(waiting[level]) == ARITY):
                break
            node, waiting[level] = _hash(waiting[level]), []
            level += 1
    return bytes(out)


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("ordinal")
    n = rows["n"][0].as_py()
    nodes = append_log(rows["digest"].to_pylist(), height(n))
    block = rows["ordinal"][0].as_py() // SPAN
    return pa.table([[rows["key"][0].as_py()], [block], [n], pa.array([rows.num_rows], pa.int32()), pa.array([nodes], pa.binary()), pa.array([nodes[-32:]], pa.binary())], ["key", "block", "n", "held", "nodes", "root"])


def layers_of(leaves: DataFrame, scratch: C.Scratch) -> list[DataFrame]:
    """The builders' slices (``TILE``), layer by layer, of the trees whose leaves are given (key,
    ordinal, n, digest). A tree of up to SPAN**k leaves has k layers."""
    layers = []
    while True:
        grouped = leaves.select("key", "ordinal", "n", "digest", F.expr(f"ordinal div {SPAN}").alias("block")).groupBy("key", "block")
        layers.append(C.table(grouped.applyInArrow(_build, TILE), "merkle_log", scratch))
        if (layers[-1].agg(F.max("n")).first()[0] or 0) <= SPAN:
            return layers
        leaves = layers[-1].where(F.col("n") > SPAN).select("key", F.col("block").alias("ordinal"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("root").alias("digest"))


def roots(layers: list[DataFrame]) -> DataFrame:
    """key and digest of the root of every tree."""
    out = None
    for tiles in layers:
        done = tiles.where(F.col("n") <= SPAN).select("key", F.col("root").alias("digest"))
        out = done if out is None else out.unionByName(done)
    return out


# ---------------------------------------------------------------- proofs

def tile_proofs(nodes: bytes, held: int, top: int, siblings: bytes, path: bytes) -> list[tuple[bytes, bytes]]:
    """(siblings, path) of each leaf of a slice whose root has the proof given. Siblings are digests
    level by level, left to right; path has a byte a level: four times the place in its run of
    siblings, plus the run's length."""
    above = [(siblings, path)]
    for level in range(top - 1, -1, -1):
        width = -(-held // ARITY**level)
        node = []
        for j in range(width):
            p = 32 * place(level, j, held, top)
            node.append(nodes[p: p + 32])
        here = []
        for j in range(width):
            run, first = j // ARITY, j - j % ARITY
            size = min(ARITY, width - first)
            others = b"".join(node[first + x] for x in range(size) if first + x != j)
            here.append((others + above[run][0], bytes([4 * (j - first) + size]) + above[run][1]))
        above = here
    return above


def fold(digest: bytes, siblings: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its proof give."""
    at = 0
    for step in path:
        left, size = 64 * (step >> 2), step & 3
        others = siblings[at: at + 32 * (size - 1)].hex()
        at += 32 * (size - 1)
        digest = hashlib.sha256((others[:left] + digest.hex() + others[left:]).encode()).digest()
    return digest


_PROOF = ["siblings", "path", "subroot", "root"]


def _spread(batches):
    """A slice's proof gives the proofs of the slices below it."""
    for batch in batches:
        for r in batch.to_pylist():
            got = tile_proofs(r["nodes"], r["held"], height(r["n"]), r["siblings"], r["path"])
            first, k = r["block"] * SPAN, len(got)
            yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * k, pa.string()), pa.array(range(first, first + k), pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary()), pa.array([r["subroot"]] * k, pa.binary()), pa.array([r["root"]] * k, pa.binary())], ["key", "block", *_PROOF])


def with_proofs(leaves: DataFrame, layers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Append siblings, path, subroot and root to ``leaves`` (key, ordinal, ...). ``top`` has the
    proof of each tree's root: key, siblings, path, subroot, root."""
    upper = None
    for tiles in reversed(layers):
        tiles = tiles.drop("root")
        whole = tiles.where(F.col("n") <= SPAN).join(top, "key")
        tiles = whole if upper is None else whole.unionByName(tiles.where(F.col("n") > SPAN).join(upper, ["key", "block"]))
        upper = tiles.mapInArrow(_spread, "key string, block long, siblings binary, path binary, subroot binary, root binary")
    names = leaves.columns

    def attach(rows: pa.Table, tile: pa.Table) -> pa.Table:
        t = tile.to_pylist()[0]
        got = tile_proofs(t["nodes"], t["held"], height(t["n"]), t["siblings"], t["path"])
        at = [x - t["block"] * SPAN for x in rows["ordinal"].to_pylist()]
        more = [pa.array([got[i][0] for i in at], pa.binary()), pa.array([got[i][1] for i in at], pa.binary()), pa.array([t["subroot"]] * len(at), pa.binary()), pa.array([t["root"]] * len(at), pa.binary())]
        return pa.table([*(rows[c] for c in names), *more], [*names, *_PROOF])

    schema = T.StructType([*leaves.schema.fields, *(T.StructField(c, T.BinaryType()) for c in _PROOF)])
    own = leaves.withColumn("block", F.expr(f"ordinal div {SPAN}")).groupBy("key", "block")
    return own.cogroup(tiles.groupBy("key", "block")).applyInArrow(attach, schema)


# ---------------------------------------------------------------- manifest of documents

@dataclass
class Manifest:
    leaves: DataFrame  # key, doc_id, digest, ordinal, n and what ``extra`` named
    layers: list[DataFrame]  # slices of the sources' logs
    sources: DataFrame  # name (the sources' keys), digest (subroot), ordinal, n; key is empty
    top: list[DataFrame]  # slices of the log above the subroots


def source_key(source: Column) -> Column:
    """Sorts as sources do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def manifest(docs: DataFrame, scratch: C.Scratch, extra: dict[str, Column] | None = None) -> Manifest:
    """The logs over ``docs`` (FIELDS). ``extra`` columns travel with the leaves, to be checked later.

    Null ids come first within their source, rows of one id by their digest; equal rows are leaves
    each. A null source is one of its own, apart from the empty text. An empty table has no root.
    Texts stay in their partition: only digests travel, however long a text is. Other columns of
    ``docs`` don't matter."""
    extra = extra or {}
    rows = docs.select(source_key(F.col("source")).alias("key"), "doc_id", leaf_digest(*map(F.col, FIELDS)).alias("digest"), *[c.alias(k) for k, c in extra.items()], F.monotonically_increasing_id().alias("row"))
    leaves = ranked(rows, ["doc_id", "digest", "row"], scratch).drop("row")
    layers = layers_of(leaves, scratch)
    subroots = roots(layers).select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    sources = ranked(subroots, ["name"], scratch)
    return Manifest(leaves, layers, sources, layers_of(sources, scratch))


def proofs(m: Manifest) -> DataFrame:
    """The manifest's leaves with siblings, path, subroot and root: all that ``fold`` needs."""
    empty = F.lit(b"")
    root = roots(m.top).select("key", empty.alias("siblings"), empty.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    of_source = with_proofs(m.sources, m.top, root)
    return with_proofs(m.leaves, m.layers, of_source.select(F.col("name").alias("key"), "siblings", "path", F.col("digest").alias("subroot"), "root"))


def log(m: Manifest) -> DataFrame:
    """The sources' append logs, flat: key, position (from 0, gapless), level, index, digest."""
    out = None
    for layer, tiles in enumerate(m.layers):
        def flat(batches, layer=layer):
            for batch in batches:
                for r in batch.to_pylist():
                    rows = []
                    for level in range(1 if layer else 0, height(r["n"]) + 1):
                        first = r["block"] * ARITY ** (LEVELS - level)
                        for j in range(-(-r["held"] // ARITY**level)):
                            p = 32 * place(level, j, r["held"], height(r["n"]))
                            rows.append((r["key"], level + layer * LEVELS, first + j, r["nodes"][p: p + 32]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["key", "level", "index", "digest"])

        part = tiles.mapInArrow(flat, "key string, level int, index long, digest binary")
        out = part if out is None else out.unionByName(part)
    sizes = m.layers[0].select("key", "n").distinct()

    @F.pandas_udf("long")
    def at(level: pd.Series, index: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([position(int(a), int(b), int(c)) for a, b, c in zip(level, index, n)], dtype="int64")

    return out.join(sizes, "key").select("key", at("level", "index", "n").alias("position"), "level", "index", "digest")


def folded(digest: Column) -> Column:
    """The root that ``digest`` folds to with its row's siblings and path, as hex."""
    @F.pandas_udf("string")
    def run(d: pd.Series, siblings: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([fold(bytes(a), bytes(b), bytes(c)).hex() for a, b, c in zip(d, siblings, path)], dtype=object)

    return run(digest, F.col("siblings"), F.col("path"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its leaf folds to after
    line feeds were deleted from the texts whose id has an even crc32 (null ids are left alone)."""
    docs = C.read_table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 != 0
    text = F.when(F.coalesce(odd, F.lit(True)), F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    found = leaf_digest(*[text if c == "text" else F.col(c) for c in FIELDS])
    with C.Scratch(spark) as scratch:
        m = manifest(docs, scratch, {"found": found})
        hexed = lambda c: F.lower(F.hex(c))
        out = proofs(m).select("doc_id", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), F.sha2(hexed("siblings"), 256).alias("proof_sha256"), folded(F.col("found")).alias("folded_root"))
        return C.table(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle_manifest")


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_TAMPERED = "sha256(" + " || ".join(_FIELD.format("text1" if c == "text" else c) for c in FIELDS) + ")"
OP13_SQL = f"""
with recursive crc as (
  select *, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end) end) % 2 = 1 as even
  from documents),
rows_ as (select *, case when coalesce(even, false) then replace(text, chr(10), '') else text end as text1 from crc),
leaves as (
  select row_number() over () as row_, doc_id, coalesce('s' || source, 'n') as src, {_LEAF} as leaf, {_TAMPERED} as tampered from rows_),
placed as (
  select *, row_number() over (partition by src order by doc_id nulls first, leaf, row_) - 1 as i, count(*) over (partition by src) as n from leaves),
nodes as (
  select src, 0 as lvl, i as j, n as w, leaf as h from placed
  union all
  select src, lvl + 1, j // 3, cast(ceil(w / 3) as bigint), sha256(string_agg(h, '' order by j)) from nodes where w > 1 group by src, lvl, j // 3, w),
subs as (select src, lvl as levels, h, row_number() over (order by src) - 1 as i, count(*) over () as n from nodes where w = 1),
tops as (
  select 0 as lvl, i as j, n as w, h from subs
  union all
  select lvl + 1, j // 3, cast(ceil(w / 3) as bigint), sha256(string_agg(h, '' order by j)) from tops where w > 1 group by lvl, j // 3, w),
every as (  -- all nodes under one numbering of levels: a source's, then those above the subroots
  select src, lvl, j, h from nodes where w > 1
  union all select s.src, s.levels + t.lvl, t.j, t.h from subs s cross join tops t where t.w > 1),
own as (  -- the node of each leaf at each level
  select p.row_, p.src, n.lvl, p.i // cast(pow(3, n.lvl) as bigint) as j from placed p join (select distinct src, lvl from nodes where w > 1) n on n.src = p.src
  union all
  select p.row_, p.src, s.levels + t.lvl, s.i // cast(pow(3, t.lvl) as bigint) from placed p join subs s on s.src = p.src cross join (select distinct lvl from tops where w > 1) t),
proof as (
  select o.row_, string_agg(e.h, '' order by e.lvl, e.j) as siblings from own o join every e on e.src = o.src and e.lvl = o.lvl and e.j // 3 = o.j // 3 and e.j <> o.j group by o.row_),
fold as (
  select row_, src, 0 as lvl, tampered as h from placed
  union all
  select f.row_, f.src, f.lvl + 1, sha256(string_agg(case when e.j = o.j then f.h else e.h end, '' order by e.j))
  from fold f join own o on o.row_ = f.row_ and o.lvl = f.lvl join every e on e.src = o.src and e.lvl = o.lvl and e.j // 3 = o.j // 3 group by f.row_, f.src, f.lvl)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, sha256(coalesce(q.siblings, '')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from placed p join subs s on s.src = p.src cross join (select h from tops where w = 1) r left join proof q on q.row_ = p.row_
join (select row_, arg_max(h, lvl) as h from fold group by row_) f on f.row_ = p.row_"""
