"""Filter interaction audit over a sparse document-term matrix.

The corpus becomes a sparse matrix of documents by words. Shards of documents are counted with a
dictionary of their own first (compressed sparse rows: row starts, columns, counts), whose words are
in the order of their hashes. A shard is a row of packed bytes: Spark never holds a value per cell or
word of it. Each shard asks for its words once, packed by hash range; a range numbers the distinct
words of all shards, and each shard's columns are renamed by these dense global ids. What moves
between tasks is words per shard, never occurrences. Row sums are a document's words and nonzero
counts its distinct words: filters A and B. The other filters are flags of the row. What the filters
do in every order follows from the number of documents with each set of failed filters.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C
from fleetstate.llm.blocks import pack_numbers, tally, unpack_numbers

SHARD_BYTES = 8 << 20  # text of a shard, with ROW_BYTES for every row
ROW_BYTES = 64  # about what a row's kept columns and numbers take
HELD_WORDS = 1 << 20  # words of a shard's stretches held apart, or twice the distinct ones
RANGE_ITEMS = 1 << 20  # words of all shards in a hash range, about
BROADCAST_ROWS = 200_000  # word counts of hash ranges: 12 bytes each
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"

_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[list(SIGNS)] = True


# ---------------------------------------------------------------- document-term matrix

def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, column and count of each distinct word of each text, and the columns' words."""
    lists = pc.ascii_split_whitespace(text)  # at 0x20 and 0x09-0x0D
    coded = lists.flatten().dictionary_encode()
    starts = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    row, col, words = np.repeat(np.arange(len(text)), np.diff(starts)), np.asarray(coded.indices, np.int64), coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()  # before the first space, after the last
    if blank >= 0:
        keep = col != blank
        row, col = row[keep], col[keep]
        col, words = col - (col > blank), words.filter(pc.not_equal(words, ""))
    wide = len(words) + 1
    cell, count = np.unique(row * wide + col, return_counts=True)
    return cell // wide, cell % wide, count, words


def _hits(found: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each text are ``found``."""
    return np.diff(np.searchsorted(np.flatnonzero(found), offs))


def _stretches(batch: pa.RecordBatch, text: int):
    """(first row, end row, texts, whether the last row goes on) of a batch in stretches of bounded
    text; a very long text comes in several, cut at white space."""
    at = 0
    for part in C.slices([batch], batch.schema.names[text]):
        data, offs = C.text_bytes(part.column(text))
        begin = 0
        while part.num_rows == 1 and len(data) - begin > 2 * C.SLICE_BYTES:
            near = data[begin + C.SLICE_BYTES: begin + 2 * C.SLICE_BYTES]
            space = np.flatnonzero(C._IS_SPACE[near])
            if not len(space):  # one very long word
                break
            end = begin + C.SLICE_BYTES + int(space[0])
            yield at, at + 1, data[begin:end], np.array([0, end - begin]), True
            begin = end
        yield at, at + part.num_rows, data[begin:], np.maximum(offs - begin, 0), False
        at += part.num_rows


class _Shard:
    """Rows counted so far: kept columns, cells, and the words of each stretch with their hashes."""

    def __init__(self):
        self.held, self.rows, self.cols, self.counts, self.keys, self.words, self.kinds = [], [], [], [], [], [], []
        self.n = self.size = self.wide = 0
        self.most = HELD_WORDS

    def add(self, first: int, data: np.ndarray, offs: np.ndarray) -> None:
        """Texts of the rows from number ``first``."""
        if self.wide > self.most:
            self._merge()
            self.most = max(HELD_WORDS, 2 * self.wide)
        n = len(offs) - 1
        text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        row, col, count, words = _words(text)
        self.rows.append((first + row).astype(np.int32))
        self.cols.append((self.wide + col).astype(np.int32))
        self.counts.append(count.astype(np.int32))
        self.keys.append(C.hash_words(*C.text_bytes(words))[0])
        self.words.append(words)
        self.wide += len(words)
        self.size += len(data) + ROW_BYTES * n
        self.kinds.append(np.vstack([first + np.arange(n), np.diff(offs) - _hits((data & 0xC0) == 0x80, offs), _hits((data >= 65) & (data <= 90), offs), _hits(_IS_SIGN[data], offs)]))

    def _merge(self) -> None:
        """The stretches so far as one: distinct words in the order of their hashes, distinct cells in theirs."""
        keys, at, rank = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
        wide = len(keys) + 1
        cell, counts = tally(np.concatenate(self.rows).astype(np.int64) * wide + rank[np.concatenate(self.cols)], np.concatenate(self.counts))
        self.rows, self.cols, self.counts = [(cell // wide).astype(np.int32)], [(cell % wide).astype(np.int32)], [counts]
        self.keys, self.words, self.wide = [keys], [pa.concat_arrays(self.words).take(pa.array(at))], len(keys)

    def batch(self, number: int, names: list[str], types: list) -> pa.RecordBatch:
        self._merge()
        n, (keys,), (counts,) = self.n, self.keys, self.counts
        cell = self.rows[0].astype(np.int64) * (self.wide + 1) + self.cols[0]
        kinds = np.zeros((3, n), np.int64)
        for k in self.kinds:
            np.add.at(kinds, (slice(None), k[0]), k[1:])
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([h[i] for h in self.held])) for i in range(len(types))]
        longs = [pa.array([k], pa.list_(pa.int64())) for k in kinds]
        own = [pa.array([x], pa.binary()) for x in (pack_numbers(cell, True), pack_numbers(counts))]
        tail = [pa.array([len(keys)], pa.int32()), pa.array([pack_numbers(keys, True)], pa.binary()), pa.array([_pack_words(self.words[0])], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *own, *longs, *tail], ["shard", *names, *_PACKED])


_KINDS = ["points", "capitals", "signs"]
_OWN = ["starts", "cols", "counts", *_KINDS, "wide", "keys", "words"]
_PACKED = ["cells", "counts", *_KINDS, "wide", "keys", "words"]  # cells: row * (wide + 1) + column, ascending


def _pack_words(words: pa.Array) -> bytes:
    if not len(words):
        return b""
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", words.type))[0].as_buffer()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_words(blob: bytes) -> list[str]:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).decode().split("\n") if blob else []


def _cells(one: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, cols and counts of a packed shard."""
    of = lambda c: one.column(one.schema.get_field_index(c))[0]
    cell, stride = unpack_numbers(of("cells").as_py(), True).astype(np.int64), of("wide").as_py() + 1
    return np.searchsorted(cell, np.arange(len(of("points")) + 1) * stride), cell % stride, unpack_numbers(of("counts").as_py()).astype(np.int64)


def _count(batches, keep: int):
    """The shards of a task."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    shard = _Shard()
    names = types = None
    for batch in batches:
        names, types, done = batch.schema.names[:keep], batch.schema.types[:keep], 0
        for first, end, data, offs, goes_on in _stretches(batch, keep):
            shard.add(shard.n + first - done, data, offs)
            if shard.size >= SHARD_BYTES and not goes_on:
                shard.held.append([batch.column(i).slice(done, end - done) for i in range(keep)])
                shard.n += end - done
                yield shard.batch(number, names, types)
                shard, number, done = _Shard(), number + 1, end
        if batch.num_rows > done:
            shard.held.append([batch.column(i).slice(done) for i in range(keep)])
            shard.n += batch.num_rows - done
    if shard.n:
        yield shard.batch(number, names, types)


def _schema(docs: DataFrame, keep: list[str], cells: list[T.StructField], words: T.DataType) -> T.StructType:
    kinds = [T.StructField(c, T.ArrayType(T.LongType())) for c in _KINDS]
    return T.StructType([T.StructField("shard", T.LongType()), *(T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in keep), *cells, *kinds, T.StructField("wide", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("words", words)])


def packed_shards(docs: DataFrame, keep: list[str], scratch: C.Scratch) -> DataFrame:
    """``shards`` as they are held and moved: cells, counts, keys and words are packed bytes."""
    schema = _schema(docs, keep, [T.StructField(c, T.BinaryType()) for c in _PACKED[:2]], T.BinaryType())
    n = len(keep)
    return C.table(docs.select(*keep, "text").mapInArrow(lambda batches: _count(batches, n), schema), "audit_shards", scratch)


def shards(docs: DataFrame, keep: list[str], scratch: C.Scratch) -> DataFrame:
    """The matrix in shards with dictionaries of their own: shard; a list of each column of ``keep``;
    starts, cols, counts; per row its code points, capitals A-Z and signs; wide (number of words),
    keys (their hashes, ascending, packed) and words. Words are told apart by 64-bit hashes."""
    schema = _schema(docs, keep, [T.StructField(c, T.ArrayType(T.IntegerType())) for c in _OWN[:3]], T.ArrayType(T.StringType()))

    def run(batches):
        for one in _singles(batches):
            col = {c: one.column(i) for i, c in enumerate(one.schema.names)}
            col |= {c: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for c, x in zip(_OWN, _cells(one), strict=False)}
            col["words"] = pa.array([_unpack_words(col["words"][0].as_py())], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([col[c] for c in schema.names], schema.names)

    return packed_shards(docs, keep, scratch).mapInArrow(run, schema)


def _singles(batches):
    """A shard a batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _closed(local: DataFrame, keep: list[str]) -> DataFrame:
    """What ``named_shards`` needs of ``shards``, packed."""
    names = ["shard", *keep, *_PACKED[:-1]]
    schema = T.StructType([T.StructField(c, T.BinaryType()) if c in ("cells", "counts") else local.schema[c] for c in names])

    def run(batches):
        for one in _singles(batches):
            col = {c: one.column(i) for i, c in enumerate(one.schema.names)}
            starts, cols, counts = (np.asarray(col[c].flatten(), np.int64) for c in _OWN[:3])
            cell = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * (col["wide"][0].as_py() + 1) + cols
            col |= {c: pa.array([x], pa.binary()) for c, x in (("cells", pack_numbers(cell, True)), ("counts", pack_numbers(counts)))}
            yield pa.RecordBatch.from_arrays([col[c] for c in names], names)

    return local.select("shard", *keep, *_OWN[:-1]).mapInArrow(run, schema)


def _ask(bits: int):
    """A shard's words by hash range: range, shard, keys."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_numbers(r["keys"], True)
                of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.diff(of)) + 1
                parts = np.split(keys, cuts)
                first = of[np.concatenate([[0], cuts])] if len(keys) else []
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array([r["shard"]] * len(parts), pa.int64()), pa.array([pack_numbers(x, True) for x in parts], pa.binary())], ["range", "shard", "keys"])

    return run


def _number(rows: pa.Table) -> pa.Table:
    """Numbers of a range's words within the range, for every shard that asked: range, shard, n (distinct words), ranks."""
    asked = [unpack_numbers(x, True) for x in rows["keys"].to_pylist()]
    every, rank = np.unique(np.concatenate(asked), return_inverse=True)
    ranks = np.split(rank.astype(np.uint64), np.cumsum([len(x) for x in asked])[:-1])
    return pa.table([rows["range"], rows["shard"], pa.array(np.full(len(asked), len(every), np.int64)), pa.array([pack_numbers(x, True) for x in ranks], pa.binary())], ["range", "shard", "n", "ranks"])


def named_shards(local: DataFrame, keep: list[str], scratch: C.Scratch) -> DataFrame:
    """The packed shards with ids: the global numbers of their words, by range (before, ranks).

    A hash range holds about RANGE_ITEMS words of all shards, so the number of ranges grows with the
    corpus; a frequent word is in it once per shard. Answers meet their shard in one row per range."""
    asked = local.agg(F.sum("wide")).first()[0] or 0
    bits = max(int(asked // RANGE_ITEMS), 1).bit_length()
    answers = C.table(local.select("shard", "keys").mapInArrow(_ask(bits), "range int, shard long, keys binary").groupBy("range").applyInArrow(_number, "range int, shard long, n long, ranks binary"), "audit_words", scratch)
    sizes = answers.groupBy("range").agg(F.max("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    offsets = C.table(sizes.select("range", before.alias("before")), "audit_offsets", scratch)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    named = answers.join(offsets, "range").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("range", "before", "ranks"))).alias("ids"))
    return local.select("shard", *keep, *_PACKED[:-2]).join(named, "shard", "left")


def _renamed(batches):
    """Each shard, and its starts, global column ids and counts."""
    for one in _singles(batches):
        ids = [unpack_numbers(x["ranks"], True).astype(np.int64) + x["before"] for x in one.column(one.schema.get_field_index("ids"))[0].as_py() or []]
        starts, cols, counts = _cells(one)
        yield one, starts, np.concatenate(ids)[cols] if len(cols) else cols, counts


def term_matrix(local: DataFrame, keep: list[str], scratch: C.Scratch) -> DataFrame:
    """The shards with global column ids in ``cols``: dense from 0 and ascending within each row."""
    names = ["shard", *keep, *_OWN[:6]]
    schema = T.StructType([T.StructField("cols", T.ArrayType(T.LongType())) if c == "cols" else local.schema[c] for c in names])

    def run(batches):
        for one, starts, cols, counts in _renamed(batches):
            col = {c: one.column(i) for i, c in enumerate(one.schema.names)}
            col |= {c: pa.array([x], pa.list_(kind)) for c, x, kind in (("starts", starts.astype(np.int32), pa.int32()), ("cols", cols, pa.int64()), ("counts", counts.astype(np.int32), pa.int32()))}
            yield pa.RecordBatch.from_arrays([col[c] for c in names], names)

    return named_shards(_closed(local, keep), keep, scratch).mapInArrow(run, schema)


def dictionary(local: DataFrame, scratch: C.Scratch) -> DataFrame:
    """word and id of all columns of the matrix: the ids of each shard's words, as ``term_matrix``
    numbers them, once each."""
    words = local.select("shard", F.array(F.lit(0)).cast("array<int>").alias("x"), F.array(F.lit(0), F.col("wide")).alias("starts"), F.when(F.col("wide") > 0, F.sequence(F.lit(0), F.col("wide") - 1)).otherwise(F.array().cast("array<int>")).alias("cols"), F.expr("transform(words, w -> 1)").alias("counts"), *(F.array(F.lit(0).cast("bigint")).alias(c) for c in _OWN[3:6]), "wide", "keys", "words")
    ids = term_matrix(words, ["x"], scratch).select("shard", "cols")
    return local.select("shard", "words").join(ids, "shard").select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("cols").alias("id")))).groupBy("id").agg(F.min("word").alias("word"))


def row_stats(local: DataFrame, keep: list[str], scratch: C.Scratch) -> DataFrame:
    """keep, n_words (row sum), n_distinct (nonzero columns), points, capitals and signs of every
    document, from the rows of its matrix in packed shards."""
    more = ["n_words", "n_distinct", *_KINDS]
    schema = T.StructType([*(T.StructField(c, local.schema[c].dataType.elementType) for c in keep), *(T.StructField(c, T.LongType()) for c in more)])

    def run(batches):
        for one, starts, cols, counts in _renamed(batches):
            flat = lambda c: one.column(one.schema.get_field_index(c)).flatten()  # noqa: E731, B023
            total = np.concatenate([[0], np.cumsum(counts)])[starts]
            fresh = np.ones(len(cols), bool)  # ids ascend within a row
            fresh[1:] = cols[1:] != cols[:-1]
            fresh[starts[:-1][np.diff(starts) > 0]] = True
            kinds = np.concatenate([[0], np.cumsum(fresh)])[starts]
            yield pa.RecordBatch.from_arrays([*(flat(c) for c in keep), pa.array(np.diff(total)), pa.array(np.diff(kinds)), *(flat(c) for c in more[2:])], schema.names)

    return named_shards(local, keep, scratch).mapInArrow(run, schema)


# ---------------------------------------------------------------- filters

def document_flags(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """doc_id, part (lang, empty if null) and the failed filters A to E of every document.

    A null text is empty: no words, so it fails A and not B. Equal texts are equal in all bytes. A
    document without an id, or whose id is the smallest of its text's (every row of it), doesn't fail
    E. Rows of one id are documents each. Very long texts are counted in stretches. Other columns of
    ``docs`` don't matter."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = ["doc_id", "part", "same"]
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"))
    stats = C.table(row_stats(packed_shards(rows, keep, scratch), keep, scratch), "audit_rows", scratch)
    first = C.table(stats.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"), "audit_copies", scratch)
    stats = stats.join(first, "same", "left")
    return stats.select("doc_id", "part", (F.col("n_words") < MIN_WORDS).alias("A"), (100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")).alias("B"),
                        (100 * F.col("capitals") > CAPITAL_PERCENT * F.col("points")).alias("C"), (F.col("signs") > 0).alias("D"), F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E"))


def _orders() -> Column:
    """The steps of all orders of the filters: filter_order, step, bit of its filter, bits before it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, per part: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    ``labels`` (doc_id, quality, toxic) may cover some documents; of several rows of an id any that
    says 1 counts. A document that fails k filters is removed by each of them in 1/k of all orders.
    No documents give no rows."""
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    groups = flags.select("doc_id", "part", mask.alias("mask")).join(label, "doc_id", "left").groupBy("part", "mask", is_("good").alias("good"), is_("bad").alias("bad")).agg(F.count("*").alias("n"))
    steps = groups.select("*", F.inline(_orders()))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    share = F.when(fails, (F.col("n") * 120 / F.bit_count("mask")).cast("long"))
    return steps.groupBy("part", "filter_order", "step").agg(
        of(~fails & ~earlier).alias("kept"), of(fails & ~earlier).alias("removed"), of(fails & earlier).alias("redundant"), of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(fails & ~earlier & F.col("good")).alias("good_lost"), of(fails & ~earlier & F.col("bad")).alias("toxic_lost"), F.coalesce(F.sum(share), F.lit(0)).cast("long").alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters on all documents, in all 120 orders, per language."""
    with C.Scratch(spark) as scratch:
        flags = document_flags(C.read_table(spark, sf_dir, "documents"), scratch)
        return C.table(audit(flags, C.read_table(spark, sf_dir, "labels")).coalesce(8), "filter_audit")


OP11_SQL = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
f as (
  select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
    (case when len(ws) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when first < w.doc_id then 16 else 0 end) as mask
  from w left join l on l.doc_id = w.doc_id),
g as (select part, mask, good, bad, count(*) as n from f group by all),
b as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, bit)),
o as (
  select a.x || b1.x || c.x || d1.x || e.x as filter_order, [a.bit, b1.bit, c.bit, d1.bit, e.bit] as bits
  from b a, b b1, b c, b d1, b e where a.bit + b1.bit + c.bit + d1.bit + e.bit = 31 and (a.bit | b1.bit | c.bit | d1.bit | e.bit) = 31),
s as (select filter_order, cast(step as int) as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step, bit, sum(case when (mask & (bit | before)) = 0 then n else 0 end)::bigint as kept,
    sum(case when (mask & bit) <> 0 and (mask & before) = 0 then n else 0 end)::bigint as removed,
    sum(case when (mask & bit) <> 0 and (mask & before) <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when (mask & bit) <> 0 and (mask & before) = 0 and good = 1 then n else 0 end)::bigint as good_lost,
    sum(case when (mask & bit) <> 0 and (mask & before) = 0 and bad = 1 then n else 0 end)::bigint as toxic_lost
  from g cross join s group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, bit)::bigint as shapley
from r"""
