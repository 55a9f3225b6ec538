"""LM scoring by prediction by partial matching (PPM) over bytes.

The trie of byte contexts up to ORDER bytes is kept as counts of byte n-grams. A symbol that the
longest context has not seen is reached by escapes to shorter ones (escape estimate: distinct
symbols over symbols and distinct symbols, method C), and symbols that a longer context has seen
are excluded from the shorter ones. A text's code is that of its bytes and an end mark.

Texts are packed into blocks. Each block asks for what it has: its distinct n-grams and words go to
the corpus counts and come back with their values, so no task ever holds the model, and a frequent
n-gram moves once a block, not once an occurrence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C
from fleetstate.llm.blocks import BLOCK_BYTES, Lookup, blocks, parts, tally

ORDER = 4
BUCKETS = 512  # the trie is dealt out by the last two context bytes
START, STOP = 0xFE, 0xFF  # bytes that UTF-8 never has: before a text, and its end
SYMBOLS = 256
BROADCAST_ROWS = 4_000_000  # n-grams with their values at 16 bytes: 64 MB
TALLIED = 1 << 18  # items of a block's slices that are tallied together, at least
END_WORD = np.uint64(0xE5D0F7E5D0F7E5D1)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with its ORDER context bytes as one integer, and where each text's begin."""
    n = len(offs) - 1
    buf = np.full(len(data) + n * (ORDER + 1), START, np.uint8)
    at = offs[:-1] + np.arange(n) * (ORDER + 1) + ORDER  # where each text now begins
    ends = at + np.diff(offs)
    text = np.ones(len(buf), bool)
    text[ends] = False
    text[(at[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    buf[text] = data
    buf[ends] = STOP
    g = np.zeros(len(buf) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        g <<= np.uint64(8)
        g |= buf[i: len(g) + i]
    keep = np.ones(len(g), bool)
    first = at - ORDER  # the n-gram whose symbol is the text's first
    gap = np.arange(1, ORDER + 1)
    cut = (first[1:, None] - gap[None, :]).ravel()  # those that end in the marks before the next text
    keep[cut] = False
    return g[keep], np.concatenate([[0], np.cumsum(np.diff(offs) + 1)])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, A-Z lower-cased, and then END_WORD; where each text's begin."""
    h, starts = C.hash_words(data, offs, lower=True)
    n = len(starts) - 1
    out = np.full(len(h) + n, END_WORD, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(starts))] = h
    return out, starts + np.arange(n + 1)


def _distinct(sizes, blob, held, items) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items of a block and how often its training texts have them. What the slices have is
    tallied whenever it is as much as the distinct items so far, so no more than that is held."""
    known, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts, waiting = [known], [seen], 0
    for at, to, data, offs in parts(sizes, blob):
        k, starts = items(data, offs)
        learned = np.repeat(~held[at:to], np.diff(starts))
        for u, c in (np.unique(k[learned], return_counts=True), (v := np.unique(k[~learned]), np.zeros(len(v), np.int64))):
            keys.append(u)
            counts.append(c)
            waiting += len(u)
        del k, learned
        if waiting > max(TALLIED, len(known)):
            known, seen = tally(np.concatenate(keys), np.concatenate(counts))
            keys, counts, waiting = [known], [seen], 0
    return tally(np.concatenate(keys), np.concatenate(counts)) if waiting else (known, seen)


def code_lengths(keys: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """ln P of each n-gram's symbol after its context. ``keys`` hold whole shards of the trie (all
    n-grams with the same last two context bytes), ``counts`` how often training texts have them,
    ``low`` the counts of the last context byte and symbol (256 x 256)."""
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    # of each n-gram: symbols its next longer context has seen, and what they count one order down
    seen_above = np.zeros(len(keys), np.int64)
    excluded = np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        if k >= 2:
            own = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            g, at = np.unique(own, return_inverse=True)
            n = np.bincount(at, counts)
            ctx, of = np.unique(g >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, n)[of][at], np.bincount(of, n > 0)[of][at]
            count = n[at]
        else:
            s, c = (keys & np.uint64(0xFF)).astype(np.int64), (keys >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
            table = low if k else low.sum(0, keepdims=True)
            row = c if k else np.zeros_like(c)
            count, total, kinds = table[row, s], table.sum(1)[row], (table > 0).sum(1)[row]
        left, new = total - excluded, kinds - seen_above
        can = open_ & (new > 0)
        hit = can & (count > 0)
        out[hit] += np.log(count[hit] / (left[hit] + new[hit]))
        miss = can & (count == 0)
        out[miss] += np.log(new[miss] / (left[miss] + new[miss]))
        open_ &= ~hit
        if not k:
            out[open_] -= np.log(SYMBOLS - kinds[open_])
            break
        # what the symbols seen here count one order down, by context
        if k > 2:
            n_below = _suffix_counts(keys, counts, k - 1, g)
        elif k == 2:
            n_below = low[(g >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), (g & np.uint64(0xFF)).astype(np.int64)]
        if k >= 2:
            excluded = np.bincount(of, np.where(n > 0, n_below, 0))[of][at]
        else:
            excluded = ((low > 0) * low.sum(0, keepdims=True)).sum(1)[c]
        seen_above = kinds
    return out


def _suffix_counts(keys: np.ndarray, counts: np.ndarray, k: int, g: np.ndarray) -> np.ndarray:
    """How often the order-k suffix of each n-gram in ``g`` was seen."""
    mask = np.uint64((1 << 8 * (k + 1)) - 1)
    u, at = np.unique(keys & mask, return_inverse=True)
    return np.bincount(at, counts)[np.searchsorted(u, g & mask)]


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of (doc_id, held_out,
    text); the model learns from the rows that aren't held out.

    Null text is empty; an empty text has one token, the end. Every row counts by itself, equal ids
    and texts included. With no training rows every symbol has probability 1/256, and the base
    takes N = V = 0. An empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    packed = blocks(docs, ["doc_id", "held_out"], block_bytes)

    def ask(batches):
        for batch in batches:
            for block, held, sizes, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                for kind, items in ((0, grams), (1, words)):
                    k, n = _distinct(sizes, blob, np.asarray(held, bool), items)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["block", "kind", "key", "n"])

    asked = C.table(packed.mapInArrow(ask, "block long, kind byte, key long, n long"), "asked")
    gram = asked.where("kind = 0")
    counted = C.cut(gram.groupBy("key").agg(F.sum("n").alias("n")))
    rows = counted.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    low = np.zeros((256, 256))
    for r in rows:
        low[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    shared = spark.sparkContext.broadcast(low)

    def code(table: pa.Table) -> pa.Table:
        keys, n = np.asarray(table["key"]).astype(np.uint64), np.asarray(table["n"]).astype(np.float64)
        return pa.table({"key": table["key"], "value": pa.array(code_lengths(keys, n, shared.value))})

    shard = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(BUCKETS))
    coded = C.table(counted.withColumn("shard", shard).groupBy("shard").applyInArrow(code, "key long, value double"), "trie")
    values = F.broadcast(coded) if coded.count() <= BROADCAST_ROWS else coded
    answers = gram.join(values, "key").select("block", "kind", "key", "value")
    # words: what the whole corpus has, where that isn't what the block knows itself
    by_word = Window.partitionBy("key")
    word = asked.where("kind = 1").select("block", "kind", "key", "n", F.sum("n").over(by_word).alias("all"), F.row_number().over(by_word.orderBy("block")).alias("nth"))
    word = C.table(word, "words")
    sums = word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(((F.col("nth") == 1) & (F.col("all") > 0)).cast("long")), F.lit(0)).alias("v")).first()
    answers = answers.unionByName(word.where("all <> n").select("block", "kind", "key", F.col("all").cast("double").alias("value")))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "code"]
    kind = docs.schema["doc_id"].dataType

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        which, key, value = np.asarray(right["kind"]), np.asarray(right["key"]).view(np.uint64), np.asarray(right["value"])
        trie = Lookup(key[which == 0], value[which == 0])
        found = []
        for i in range(left.num_rows):
            held, sizes, blob = (left[c][i].as_py() for c in ("held_out", "sizes", "bytes"))
            held = np.asarray(held, bool)
            own, n = _distinct(sizes, blob, held, words)
            k, v = key[which == 1], value[which == 1]
            # the corpus counts replace the block's own
            n = n.astype(np.float64)
            n[np.searchsorted(own, k)] = v
            count = Lookup(own, n)
            for at, to, data, offs in parts(sizes, blob):
                w, starts = words(data, offs)
                c = count.get(w, 0.0)
                g, begin = grams(data, offs)
                found.append((held[at:to], np.diff(starts), np.add.reduceat(c > 0, starts[:-1], dtype=np.int64), np.add.reduceat(np.log10(c + 0.1), starts[:-1]), np.add.reduceat(trie.get(g, np.nan), begin[:-1])))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)]
        ids = pa.concat_arrays([c.flatten() for c in left["doc_id"].chunks])
        return pa.table([ids, *map(pa.array, cols)], names)

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("log_counts", T.DoubleType()), T.StructField("code", T.DoubleType())])
    done = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)
    total, kinds = sums["n"], sums["v"]
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                       (F.col("log_counts") - F.col("n_tokens") * math.log10(total + 0.1 * (kinds + 1))).alias("base_score"), (F.col("code") / math.log(10)).alias("score"))


class Trie:
    """The same model, a symbol at a time: for adaptive scoring, and to check the counts against."""

    def __init__(self):
        self.contexts: dict[bytes, dict[int, int]] = {}

    def symbol(self, context: bytes, s: int) -> float:
        """ln P of ``s`` after ``context`` (its last ORDER bytes)."""
        out, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = {t: n for t, n in self.contexts.get(context[ORDER - k:], {}).items() if t not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if s in seen:
                return out + math.log(seen[s] / total)
            out += math.log(len(seen) / total)
            excluded |= seen.keys()
        return out - math.log(SYMBOLS - len(excluded))

    def learn(self, context: bytes, s: int) -> None:
        for k in range(ORDER + 1):
            row = self.contexts.setdefault(context[ORDER - k:], {})
            row[s] = row.get(s, 0) + 1

    def text(self, text: str, score: bool = True, learn: bool = True) -> float:
        raw = bytes([START] * ORDER) + text.encode() + bytes([STOP])
        total = 0.0
        for i in range(ORDER, len(raw)):
            if score:
                total += self.symbol(raw[i - ORDER: i], raw[i])
            if learn:
                self.learn(raw[i - ORDER: i], raw[i])
        return total


def score_adaptive(docs: DataFrame) -> DataFrame:
    """doc_id, score: log10 probability of each text under a model that starts empty and learns the
    text as it goes. Null text is empty. Nothing is shared between texts."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in C.slices(batches):
            got = [Trie().text(t or "") / math.log(10) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", (C.id_remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text"))
