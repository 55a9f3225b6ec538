"""Substring dedup by recompression.

Rounds name token runs and pairs: a run of one symbol becomes one symbol, and a symbol of the left
half of the alphabet merges with a following one of the right half (the halves are drawn anew each
round from the names). A name is a hash of what it stands for, so all executors give one name to
one thing without exchanging anything, and equal substrings get equal symbols everywhere but near
their ends. For each window of ``window`` words, ``anchors`` follows which symbols its own words
determine, round after round, and keeps the one of most words in the last round that has any. Equal
windows, wherever they are, so have the same anchor at the same place in them.

Anchors that two documents share reveal the candidates. Neighbouring windows with one anchor make
one occurrence; where all occurrences of an anchor carry the same text around it, its windows are
settled at once, else each of those windows is compared by the hash of its words. Both hashes, of
the anchor and of the words, have to agree: 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C

WINDOW = 50
ROUNDS = 6  # symbols of about three words; fifty words then determine about twelve of them
LAST = (1 << 63) - 1  # stands for a null id: after all others

_A, _B, _R = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_INVERSE = np.uint64(pow(int(C.BASE), -1, 1 << 64))


def anchors(words: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: the text it is in, its first word (index into ``words``), its anchor's name
    and the anchor's first word. ``starts`` are the texts' first words."""
    n = np.diff(starts)
    text = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    count = np.maximum(n - window + 1, 0)
    first = starts[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    s = words
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = np.arange(len(words), dtype=np.int32)
    name = np.zeros(len(text), np.uint64)
    place = np.zeros(len(text), np.int64)
    live = np.arange(len(text), dtype=np.int32)
    lo, hi = first.astype(np.int32), (first + window).astype(np.int32)
    for level in range(1, ROUNDS + 1):
        salt = np.uint64(level * 0x9FB21C651E98DF25 & LAST)
        joins = owner[1:] == owner[:-1]
        if level % 3 == 1:  # runs
            new = np.concatenate([[True], ~(joins & (s[1:] == s[:-1]))])
            index = (np.cumsum(new) - 1).astype(np.int32)
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(s))).astype(np.uint64)
            names = s[heads]
            long = size > 1
            names[long] = C.mix(names[long] * _R + size[long] + salt)
            new_lo, new_hi = index[lo] + 1, index[hi - 1]  # a run at an edge may go on outside
        else:  # pairs
            right = (C.mix(s + salt) >> np.uint64(40)) & np.uint64(1) == 1
            paired = np.concatenate([[False], joins & ~right[:-1] & right[1:]])
            index = (np.cumsum(~paired) - 1).astype(np.int32)
            heads = np.flatnonzero(~paired)
            names = s[heads]
            second = np.flatnonzero(paired)
            names[index[second]] = C.mix(s[second - 1] * _A + s[second] * _B + salt)
            new_lo = index[lo] + right[lo]  # a right symbol at the edge may merge with one outside
            new_hi = index[hi - 1] + right[hi - 1]
        over = new_lo >= new_hi
        if over.any():  # a long run, as a rule: the symbols of the round before stay
            best = _choose(s, at, len(words), lo[over], hi[over])
            name[live[over]] = s[best] ^ salt
            place[live[over]] = at[best]
        live, lo, hi = live[~over], new_lo[~over], new_hi[~over]
        s, owner, at = names, owner[heads], at[heads]
    best = _choose(s, at, len(words), lo, hi)
    name[live] = s[best]
    place[live] = at[best]
    return text, first, name, place


def _choose(s: np.ndarray, at: np.ndarray, words: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The symbol of most words in each range [lo, hi); of several, the one of least hash, then the first."""
    size = np.minimum(np.diff(np.append(at, words)), 255).astype(np.uint64)
    rank = ((np.uint64(255) - size) << np.uint64(56)) | (C.mix(s ^ _R) >> np.uint64(8))
    best = np.arange(len(s), dtype=np.int32)  # of the ranges that begin here and have 2 ** k symbols
    out = np.zeros(len(lo), np.int32)
    span = hi - lo
    k = 0
    while len(lo):
        some = (span >> k) == 1
        a, b = best[lo[some]], best[hi[some] - (1 << k)]
        out[some] = np.where(rank[b] < rank[a], b, a)
        if not (span >> (k + 1)).any():
            break
        step = 1 << k
        later = best[step:]
        best = best[: len(later)]
        best = np.where(rank[later] < rank[best], later, best)
        k += 1
    return out


class Sums:
    """Hash of any word range, from prefix sums."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * C.powers(len(words) + 1)[: len(words)], dtype=np.uint64)])
        self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words), _INVERSE))])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return C.mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * _R)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """key, name, lo, hi (first and last window), around (hash of all words of those windows)."""

    def run(batches):
        for batch in C.slices(batches):
            words, starts = C.hash_words(*C.text_bytes(batch.column(2)))
            text, first, name, place = anchors(words, starts, window)
            if not len(text):
                continue
            new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
            last = np.append(new[1:], len(text)) - 1
            around = Sums(words).of(first[new], first[last] + window)
            base = starts[:-1][text[new]]
            own = pa.array(text[new])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), _signed(name[new]), pa.array((first[new] - base).astype(np.int32)), pa.array((first[last] - base).astype(np.int32)), _signed(around)],
                ["doc_key", "text_key", "name", "lo", "hi", "around"])

    return docs.select("doc_key", "text_key", "text").mapInArrow(run, "doc_key long, text_key long, name long, lo int, hi int, around long")


def _prepared(docs: DataFrame) -> DataFrame:
    """Each row as ``row``, with keys that tell rows of one id but different text apart."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"),
                       F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_key, text_key, ranges (first and last window, both inclusive) of the windows whose words
    also start in a document of smaller id. ``docs`` as ``_prepared`` makes it."""
    with C.Scratch(docs.sparkSession) as scratch:
        return C.table(_ranges(docs, window, scratch), "ranges")


def _ranges(docs: DataFrame, window: int, scratch: C.Scratch) -> DataFrame:
    seen = C.table(occurrences(docs, window), "occurrences", scratch)
    # written, so that the joins have a plain shuffle on either side, which Spark can split at a hot key
    shared = C.table(seen.groupBy("name").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("most"), F.min("around").alias("a"), F.max("around").alias("b")).where("least < most").select("name", "least", (F.col("a") != F.col("b")).alias("mixed")), "shared", scratch)
    found = C.table(seen.drop("around").join(shared, "name").where("mixed or doc_key > least").select("doc_key", "text_key", "name", "lo", "hi", "mixed"), "candidates", scratch)
    mixed = found.where("mixed").groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("name", "lo", "hi")).alias("spans"))

    def windows(batches):
        for batch in C.slices(batches):
            words, starts = C.hash_words(*C.text_bytes(batch.column(2)))
            sums = Sums(words)
            spans = batch.column(3)
            owner = np.repeat(np.arange(len(spans)), np.diff(C.offsets_of_list(spans)))
            flat = spans.flatten()
            name, lo, hi = (np.asarray(flat.field(i)) for i in range(3))
            size = hi - lo + 1
            at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(owner, size)
            first = starts[:-1][row] + at
            name, hashed = np.repeat(name, size), sums.of(first, first + window).view(np.int64)
            # one row for all places of a window in a text: a text may repeat itself without end
            order = np.lexsort((at, hashed, name, row))
            row, name, hashed, at = row[order], name[order], hashed[order], at[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (name[1:] != name[:-1]) | (hashed[1:] != hashed[:-1])])) if len(row) else np.zeros(0, np.int64)
            take = pa.array(row[new])
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(name[new]), pa.array(hashed[new]), places], ["doc_key", "text_key", "name", "words", "places"])

    text = docs.select("doc_key", "text_key", "text")
    single = C.table(text.join(mixed, ["doc_key", "text_key"]).select("doc_key", "text_key", "text", "spans").mapInArrow(windows, "doc_key long, text_key long, name long, words long, places array<int>"), "windows", scratch)
    least = C.table(single.groupBy("name", "words").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("most")).where("least < most").drop("most"), "least", scratch)
    more = single.join(least, ["name", "words"]).where("doc_key > least").select("doc_key", "text_key", F.explode("places").alias("lo")).select("doc_key", "text_key", "lo", F.col("lo").alias("hi"))
    settled = found.where("not mixed").select("doc_key", "text_key", "lo", "hi")
    return settled.unionByName(more).groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document of
    smaller id. Windows are judged on the input.

    Appends n_words, n_removed (longs), spans (word ranges removed: from, to, the latter exclusive)
    and kept_text to the columns of ``docs``; columns of these names are replaced. Where nothing is
    removed kept_text is the text as it was; else the kept stretches stand on lines of their own.
    Null text has no words and stays null. A null id counts as larger than any other. Rows of one id
    don't make each other repeat. An empty table gives an empty table.
    """
    base = _prepared(docs)
    ranges = repeated(base, window)
    new = ["n_words", "n_removed", "spans", "kept_text"]
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType([base.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])

    def remove(batches):
        for batch in C.slices(batches):
            n, gone, spans, kept = [], [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                words = raw.split()  # bytes split at exactly the six separators
                out = _merged(own or [], window)
                n.append(len(words))
                gone.append(sum(b - a for a, b in out))
                spans.append([{"from": a, "to": b} for a, b in out])
                kept.append(text if not out else _without(words, raw, out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.string())], schema.names)

    done = base.drop("text").join(ranges, ["doc_key", "text_key"], "left").select("row", F.col("row.text").cast("string").alias("text"), "ranges").mapInArrow(remove, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def _merged(own: list[dict], window: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["lo"], r["hi"] + window) for r in own):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(words: list[bytes], raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The stretches between the removed word ranges, with their own white space, a line each."""
    ends = np.cumsum([len(w) for w in words])
    # where each word begins: count of solid bytes before it, mapped to places in the text
    solid = np.flatnonzero(~C._IS_SPACE[np.frombuffer(raw, np.uint8)])
    edges = [0, *(x for s in spans for x in s), len(words)]
    parts = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if a < b:
            parts.append(raw[solid[ends[a] - len(words[a])]: solid[ends[b - 1] - 1] + 1])
    return b"\n".join(parts).decode()


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return dedup(C.read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
keyed AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM win),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS least FROM keyed) WHERE least < doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
mark AS (SELECT p.doc_id, p.p, p.word, max(h.s) OVER (PARTITION BY p.doc_id ORDER BY p.p) AS last FROM pos p LEFT JOIN hit h ON h.doc_id = p.doc_id AND h.s = p.p),
agg AS (SELECT doc_id, count(*) FILTER (last IS NOT NULL AND p - last < 50) AS n_removed,
  string_agg(word, ' ' ORDER BY p) FILTER (last IS NULL OR p - last >= 50) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN agg a ON a.doc_id = d.doc_id
"""
