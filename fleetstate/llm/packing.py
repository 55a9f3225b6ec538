"""Mixture-controlled packing: deficit round-robin over source queues.

A source is a queue, and a document is cut into pieces of ``piece`` tokens or somewhat more (under
twice as many; a shorter document is one piece). Every round adds a queue's quantum to its deficit;
the queue sends what pieces the deficit covers and carries the rest to the next round, over windows
and partitions alike. So the piece that ends at a queue's token ``b`` leaves in round
``ceil(b / quantum)``, whatever the other queues do: no partition waits for another.

Queues whose shares are within a factor of two are one account and take turns of about a piece; the
accounts, sixty at most, take turns again with their shares of a window as quanta. Thousands of small
sources therefore can't delay a large one. The place of a piece is a running sum over the order
of rounds: first within its account, then over all. Spark sorts rows that stand for pieces, not tokens.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C

WINDOW = 1024
PIECE = 256
ACCOUNTS = 60  # classes of shares; what is below the last one's counts to it
BROADCAST_BYTES = 64 << 20
CACHED_PIECES = 300_000
TOKENIZED_BYTES = 8 << 20  # text whose distinct pieces are encoded at once

_encoders: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Spaced(Exception):
    """A piece next to white space other than the one space before it."""


class Pieces(dict):
    """Ids (as bytes) of pieces that follow a space; a bounded cache that fills itself."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Spaced
        ids = self.encode(" " + piece)
        if len(self) < self.room:
            self[piece] = ids
        return ids


class Encoder:
    """Token ids as little-endian unsigned bytes, two or four an id by the vocabulary's size.

    A text may be cut before a single space between two characters that aren't white space: a
    byte-level BPE never joins tokens over such a place, so the pieces' ids are the text's ids.
    Pieces are encoded once and cached, up to a bound; ``many`` encodes those that it lacks together.
    With ``ranks``, the same vocabulary as a rank file, tiktoken encodes the pieces, which is faster;
    the ids are the same.
    """

    def __init__(self, vocabulary: str, ranks: tuple[str, str] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast, self.spans = _rank_encoder(*ranks) if ranks else (None, None)
        self.pieces = Pieces(self.text, CACHED_PIECES)

    def text(self, text: str) -> bytes:
        if self.fast and not any(t in text for t in self.special):
            return array(self.code, self.fast(text)).tobytes()
        return array(self.code, self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if not rest:
            return self.text(text)
        try:
            if not head or head[-1].isspace():
                raise _Spaced
            return self.text(head) + b"".join(map(self.pieces.__getitem__, rest))
        except _Spaced:
            return self.text(text)

    def many(self, texts: pa.Array, end: bytes) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and where each text's bytes begin."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        begin = C.offsets_of_list(lists)
        count = np.diff(begin)
        words = lists.flatten().dictionary_encode()
        n, kinds = len(texts), len(words.dictionary)
        which = np.asarray(words.indices).astype(np.int64)
        ids, spaced = self._after_space(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        heads = words.dictionary.take(pa.array(which[begin[:-1]])).to_pylist()
        # a text that can't be cut at its spaces, or has none, is encoded whole, in place of its head
        odd = spaced[which]
        odd[begin[:-1]] = False
        whole = np.logical_or.reduceat(odd, begin[:-1]) if n else odd
        whole |= (count > 1) & np.array([not h or h[-1].isspace() for h in heads], bool)
        firsts = [self.text(texts[i].as_py() if w else h) for i, (h, w) in enumerate(zip(heads, whole.tolist(), strict=True))]
        order = np.empty(len(which) + n, np.int64)
        which[np.repeat(whole, count)] = kinds + n + 1  # nothing
        which[begin[:-1]] = kinds + np.arange(n)
        order[np.arange(len(which)) + np.repeat(np.arange(n), count)] = which
        order[begin[1:] + np.arange(n)] = kinds + n
        taken = pa.array([*ids, *firsts, end, b""], pa.large_binary()).take(pa.array(order))
        return taken.buffers()[2], C.offsets_of(taken)[np.append(begin[:-1] + np.arange(n), len(order))]

    def _after_space(self, pieces: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of each piece after a space, and which pieces are empty or have white space at an end."""
        ids = list(map(self.pieces.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        spaced = np.zeros(len(pieces), bool)
        spaced[[i for i in new if not (p := pieces[i]) or p[0].isspace() or p[-1].isspace()]] = True
        bare = [i for i in new if not spaced[i]]
        for i, x in zip(bare, self._encoded([" " + pieces[i] for i in bare]), strict=True):
            ids[i] = x
            if len(self.pieces) < self.pieces.room:
                self.pieces[pieces[i]] = x
        return [b"" if x is None else x for x in ids], spaced

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with a space and may follow each other."""
        text = "".join(pieces)
        if not pieces or not self.fast or any(t in text for t in self.special):
            return [self.text(p) for p in pieces]
        ids = np.array(self.fast(text), f"<u{self.width}")
        ends = np.cumsum(self.spans[ids])
        stops = np.cumsum([len(p.encode()) for p in pieces])
        cuts = np.concatenate([[0], np.searchsorted(ends, stops) + 1])
        if len(ids) != cuts[-1] or not np.array_equal(ends[cuts[1:] - 1], stops):
            return [self.text(p) for p in pieces]
        blob, cuts = ids.tobytes(), (cuts * self.width).tolist()
        return [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _rank_encoder(path: str, pattern: str):
    """The encoder, and how many bytes each id stands for."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    spans = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    spans[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, spans


def queue_name(column: str):
    """The queue of each row: its source. Null is a queue, too, named by the empty string."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def tokenize(docs: DataFrame, vocabulary: str, queue, end_id: int = 0, ranks: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, key (one a row), queue, part, at (tokens of that queue before it in its part), n, width, ids (zstd), cut once.

    ``part`` numbers the scan's partitions. The rows are checkpointed, so every later step sees one
    assignment of rows to parts, whichever executors are lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cached = (vocabulary, ranks)
        encode = _encoders.get(cached) or _encoders.setdefault(cached, Encoder(vocabulary, ranks))
        part = TaskContext.get().partitionId()
        row = part << 33
        used: dict[str, int] = {}
        end = array(encode.code, [end_id]).tobytes()
        for batch in C.slices(batches, budget=TOKENIZED_BYTES):
            queues = batch.column(1).to_pylist()
            blob, offs = encode.many(batch.column(2), end)
            n = (np.diff(offs) // encode.width).tolist()
            at = []
            for q, k in zip(queues, n, strict=True):
                at.append(used.get(q, 0))
                used[q] = at[-1] + k
            packed = [pa.compress(blob[a:b], codec="zstd", asbytes=True) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(row, row + len(n)), pa.int64()), batch.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([encode.width] * len(n), pa.int32()), pa.array(packed, pa.binary())],
                ["doc_id", "key", "queue", "part", "at", "n", "width", "ids"])
            row += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.cut(docs.select("doc_id", queue.alias("queue"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, key long, queue string, part int, at long, n long, width int, ids binary"))


def quanta(sums: DataFrame, targets: dict[str, float] | None, piece: int) -> DataFrame:
    """queue, lane, share, account, quantum, from (queue, part, tokens).

    Queues without a target, if there are any, come after all others: lane 1. Within a lane the
    shares add up to 1. An account's quanta are above ``piece`` and at most twice that."""
    queues = sums.groupBy("queue").agg(F.sum("tokens").alias("size"))
    lane = F.lit(0)
    if targets:
        wanted = sums.sparkSession.createDataFrame([(q, float(w)) for q, w in targets.items()], "queue string, want double")
        queues = queues.join(wanted, "queue", "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
        lane = F.when(F.col("want") > 0, 0).otherwise(1)
        queues = queues.withColumn("size", F.when(F.col("want") > 0, F.col("want")).otherwise(F.col("size")))
    queues = queues.withColumn("lane", lane)
    whole = F.broadcast(queues.groupBy("lane").agg(F.sum("size").alias("whole")))  # two rows
    level = F.least(F.greatest(F.floor(-F.log2("share")), F.lit(0)), F.lit(ACCOUNTS - 1)).cast("int")
    queues = queues.join(whole, "lane").withColumn("share", F.col("size") / F.col("whole")).withColumn("level", level)
    return queues.select("queue", "lane", "share", (F.col("lane") * ACCOUNTS + F.col("level")).alias("account"),
                         (F.col("share") * F.pow(F.lit(2.0), F.col("level") + 1) * piece).alias("quantum"))


def running(rows: DataFrame, order: list[str], account: str | None = None) -> DataFrame:
    """Append ``place``: the sum of ``size`` over the rows before each in ``order``, or over those of
    its ``account``, which then comes first in ``order``. Range partitions are sorted and written
    once; a number per partition and account is all that is joined."""

    def run(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size, own = (np.asarray(batch.column(i)) for i in (batch.num_columns - 2, batch.num_columns - 1))
            ends = np.cumsum(size)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            spans = np.diff(np.append(first, len(own)))
            at = ends - size
            at -= np.repeat(at[first], spans)
            if own[0] == last:
                at[: spans[0]] += seen
            last, seen = own[-1], int(at[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(at)], [*batch.schema.names, "chunk", "at"])

    group = F.col(account).cast("int") if account else F.lit(0)
    rows = rows.select(*[c for c in rows.columns if c != "size"], "size", group.alias("group"))
    sorted_rows = rows.repartitionByRange(C.shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType()), T.StructField("at", T.LongType())])
    chunks = C.cut(sorted_rows.mapInArrow(run, schema))
    sums = chunks.groupBy("group", "chunk").agg(F.sum("size").alias("sum"))
    return chunks.join(_small(sums, before("group", "chunk", "sum")), ["group", "chunk"]).withColumn("place", F.col("base") + F.col("at")).drop("group", "chunk", "at", "base", "sum")


def before(group: str, part: str, amount: str) -> Column:
    """The sum of ``amount`` over the parts of a group before each part; a row a part."""
    return F.coalesce(F.sum(amount).over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")


def _small(sums: DataFrame, base: Column) -> DataFrame:
    """``sums`` with their ``base``; broadcast within the bound, by count."""
    sums = C.cut(sums)
    out = sums.select("*", base)
    return F.broadcast(out) if sums.count() * 64 <= BROADCAST_BYTES else out


def schedule(tokens: DataFrame, targets: dict[str, float] | None, window: int, piece: int) -> DataFrame:
    """key, start, size, place (in the packed stream) of every piece, before windows cut them."""
    sums = C.cut(tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens")))
    queues = C.cut(quanta(sums, targets, piece))
    bases = C.cut(sums.select("queue", "part", before("queue", "part", "tokens")).join(queues.drop("share"), "queue"))
    if sums.count() * 64 <= BROADCAST_BYTES:
        bases = F.broadcast(bases)
    docs = tokens.select("key", "queue", "part", "at", "n").join(bases, ["queue", "part"])
    count = F.greatest(F.lit(1), F.floor(F.col("n") / piece)).cast("long")
    cut = docs.select("key", "queue", "lane", "account", "quantum", (F.col("base") + F.col("at")).alias("first"), "n", count.alias("count"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    cut = cut.withColumn("start", F.expr("n * i div count")).withColumn("size", F.expr("n * (i + 1) div count") - F.col("start"))
    turn = F.ceil((F.col("first") + F.col("start") + F.col("size")) / F.col("quantum"))
    inner = cut.select("key", "lane", "account", turn.alias("turn"), "queue", (F.col("first") + F.col("start")).alias("t"), "start", "size")
    inner = running(inner, ["account", "turn", "queue", "t"], "account")
    shares = F.broadcast(queues.groupBy("account").agg(F.sum("share").alias("share")))  # twice ACCOUNTS rows at most
    turn = F.ceil((F.col("place") + F.col("size")) / (F.col("share") * window))
    outer = inner.join(shares, "account").select("key", "lane", turn.alias("turn"), "account", F.col("place").alias("t"), "start", "size")
    return running(outer, ["lane", "turn", "account", "t"]).select("key", "start", "size", "place")


def pack(docs: DataFrame, vocabulary: str | None = None, source: str = "source", targets: dict[str, float] | None = None,
         window: int = WINDOW, end_id: int = 0, ranks: tuple[str, str] | None = None, piece: int = PIECE) -> DataFrame:
    """Pack all documents into windows of ``window`` tokens; one row per piece.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset, queue, ids (the piece's token
    ids, little-endian unsigned 32-bit). All windows but the last are full. ``targets`` are wanted
    shares by source; without them the shares are the corpus's own and all sources end together.
    Sources without a target follow after all others. A source that runs dry leaves its place to the
    others of its account. Until then, what a source of share s has in any run of windows is off its
    share by less than 12 * piece + 2 * s * (window + piece * accounts), for as many accounts as
    there are: that is what deficits can add up to, however long the run and however many the
    sources. A document is cut into pieces of ``piece`` to 2 * piece - 1 tokens, and at the edges of
    windows.

    Null text is the empty text, which still has its end token; texts of any length are one row of
    tokens. Rows with equal or null ids are packed each on its own. A null source is a source. An
    empty table gives no pieces. Other columns of ``docs`` are not read.
    """
    tokens = tokenize(docs, vocabulary or default_vocabulary(), queue_name(source), end_id, ranks)
    kind = docs.schema["doc_id"].dataType
    first, last = F.expr(f"place div {window}"), F.expr(f"(place + size - 1) div {window}")
    cut = schedule(tokens, targets, window, piece).select("*", F.explode(F.sequence(first, last)).alias("w"))
    begin, stop = F.greatest("place", F.col("w") * window), F.least(F.col("place") + F.col("size"), (F.col("w") + 1) * window)
    cut = cut.select("key", (F.col("start") + begin - F.col("place")).alias("start"), (stop - begin).alias("length"), begin.alias("place"))
    by_doc = cut.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "place"))).alias("cuts"))  # as many as the row's own tokens make
    placed = tokens.select("key", "doc_id", "queue", "n", "width", "ids").join(by_doc, "key").select("doc_id", "queue", "n", "width", "ids", "cuts.start", "cuts.length", "cuts.place")

    def run(batches):
        for batch in C.slices(batches, "ids", 1 << 20):
            start, size, place = (np.asarray(batch.column(i).flatten()) for i in (5, 6, 7))
            row = np.repeat(np.arange(batch.num_rows), np.diff(C.offsets_of_list(batch.column(5))))
            n = np.asarray(batch.column(2))
            ids = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=k * b, codec="zstd", asbytes=True), f"<u{b}").astype("<u4")
                                  for x, k, b in zip(batch.column(4).to_pylist(), n.tolist(), batch.column(3).to_pylist(), strict=True)])
            take = pa.array(row)
            edges = pa.py_buffer(np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int64))
            blob = pa.Array.from_buffers(pa.large_binary(), len(size), [None, edges, pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(start), pa.array(size), pa.array(n[row]), pa.array(place // window), pa.array(place % window), batch.column(1).take(take), blob],
                                             ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "queue", "ids"])

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")),
                           T.StructField("queue", T.StringType()), T.StructField("ids", T.BinaryType())])
    return placed.mapInArrow(run, schema)


def default_ranks() -> tuple[str, str]:
    """The default vocabulary as ranks, and the pattern that cuts its text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(C.read_table(spark, sf_dir, "documents"), ranks=default_ranks())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
