"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, a mask of bits for each language; the AND of an
n-gram's slots gives the masks of every language that has the n-gram. A language has eight bits, one
for each tier of share: the last says that the n-gram occurs at all, each one above it that it makes
up four times as much of the language's text or more. All n-grams of all learned texts are in the
filters, at the tiers that their shares give, so what they say doesn't hang on the corpus's size. (With
the last tier alone, stray words in a large corpus put nearly every n-gram into every language.) A
text's votes per language are the popcounts over its n-grams, each tier corrected for its false
positives; the most votes win. Spark counts the n-grams and ORs the masks by slot; only the finished
slots, of bounded size, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C

GRAM = 4  # bytes of an n-gram, over lower-cased text with all but letters as one space
TIERS = 8  # a byte of bits per language and slot
TOP_SHARE = 2.0 ** -8  # least share of the top tier; each tier below takes a quarter of it, the last any share
BLOCK = 1 << 16  # slots that one row brings to the driver
FILTER_BYTES = 64 << 20  # slots of all languages; fuller filters err more, and the votes are corrected for it


def _clean(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with ASCII non-letters as spaces, each text padded by spaces."""
    data, offs = C.text_bytes(pc.utf8_lower(col.fill_null("")))
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    n = len(offs) - 1
    pad = GRAM - 1
    # each text moves right by the padding of the texts before it
    out = np.full(len(data) + (n + 1) * pad, 32, np.uint8)
    shift = np.repeat(np.arange(1, n + 1) * pad, np.diff(offs))
    out[np.arange(len(data)) + shift] = table[data]
    return out, offs + np.arange(n + 1) * pad, data


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram with a letter as an unsigned integer, and where each text's n-grams begin."""
    buf, starts, _ = _clean(col)
    if len(buf) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
    g = np.zeros(len(buf) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        g <<= np.uint32(8)
        g |= buf[i: len(g) + i]
    blank = np.uint32(0x20202020)
    keep = np.flatnonzero(g != blank)
    return g[keep], np.searchsorted(keep, starts)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``slots`` has a byte of tiers per slot and language."""

    langs: list[str]
    slots: np.ndarray  # (slots, languages) uint8
    hashes: int
    prior: int  # the language of most learned text; taken when nothing votes

    def find(self, g: np.ndarray) -> np.ndarray:
        at = _slots(g, len(self.slots), self.hashes)
        found = self.slots[at[0]]
        for a in at[1:]:
            found &= self.slots[a]
        return found

    def false_rate(self) -> np.ndarray:
        """(languages, tiers): how often an n-gram that isn't in a tier is found there."""
        return np.array([[((self.slots[:, i] >> np.uint8(t)) & 1).mean() ** self.hashes for t in range(TIERS)] for i in range(len(self.langs))]).reshape(-1, TIERS)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(languages, 256) what a mask counts for, and (languages) what an n-gram gets by mistake."""
        false = self.false_rate()
        worth = np.where(false < 1, 1 / np.where(false < 1, 1 - false, 1), 0.0)
        bits = (np.arange(256)[:, None] >> np.arange(TIERS)) & 1
        return worth @ bits.T, (false * worth).sum(1)


def _slots(g: np.ndarray, n: int, hashes: int) -> list[np.ndarray]:
    h = C.mix(g.astype(np.uint64) + np.uint64(0x51ED270B))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(n - 1)).astype(np.int64) for i in range(hashes)]


def learn(docs: DataFrame, hashes: int = 3, bits_per_gram: int = 12, filter_bytes: int = FILTER_BYTES) -> Filters:
    """Learn the filters from ``text`` and non-null ``lang`` of every row.

    There are ``bits_per_gram`` slots for each n-gram of the language that has most, as far as the
    slots of all languages fit into ``filter_bytes``; no n-gram is left out. The driver sees a row
    per language and the slots. No rows to learn from: no languages.
    """
    rows = docs.where("lang is not null and text is not null").select("text", "lang")

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, pairs in held.items():
                g, c = _merge(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "n"])

        for batch in C.slices(batches):
            langs = batch.column(1)
            for lang in langs.unique().to_pylist():
                g, _ = grams(batch.column(0).filter(pc.equal(langs, lang)))
                u, c = np.unique(g, return_counts=True)
                held.setdefault(lang, []).append((u, c))
                size += len(u)
            if size > 2_000_000:
                held = {k: [_merge(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > 1_500_000:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    counts = C.cut(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    amounts = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    totals = {r["lang"]: (r["total"], r["kinds"]) for r in amounts.collect()}
    langs = sorted(totals)
    if not langs:
        return Filters([], np.zeros((2, 0), np.uint8), hashes, 0)
    number = {lang: (i, totals[lang][0]) for i, lang in enumerate(langs)}
    wanted = max(64, max(kinds for _, kinds in totals.values()) * bits_per_gram)
    size = 1 << max(6, min((wanted - 1).bit_length(), max(1, filter_bytes // len(langs)).bit_length() - 1))

    def place(batches):
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            own, total = (np.array([number[x][k] for x in names.dictionary.to_pylist()], np.int64)[np.asarray(names.indices)] for k in (0, 1))
            mask = masks(np.asarray(batch.column(2)) / total).astype(np.int32)
            for at in _slots(np.asarray(batch.column(1)).astype(np.uint32), size, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at), pa.array(mask)], ["language", "slot", "mask"])

    def block(key, table):
        out = np.zeros(min(BLOCK, size), np.uint8)
        out[np.asarray(table["slot"]) % BLOCK] = np.asarray(table["mask"])
        return pa.table({"language": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "slots": pa.array([pa.compress(out.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    slots = counts.mapInArrow(place, "language long, slot long, mask int").groupBy("language", "slot").agg(F.bit_or("mask").alias("mask"))
    blocks = slots.withColumn("block", F.expr(f"slot div {BLOCK}")).groupBy("language", "block").applyInArrow(block, "language long, block long, slots binary")
    filled = np.zeros((size, len(langs)), np.uint8)
    for r in blocks.collect():  # filter_bytes at most
        raw = pa.decompress(bytes(r["slots"]), decompressed_size=min(BLOCK, size), codec="zstd", asbytes=True)
        filled[r["block"] * BLOCK: r["block"] * BLOCK + len(raw), r["language"]] = np.frombuffer(raw, np.uint8)
    return Filters(langs, filled, hashes, max(range(len(langs)), key=lambda i: (totals[langs[i]][0], -i)))


def masks(share: np.ndarray) -> np.ndarray:
    """The tiers of n-grams of these shares, as bits: the last tier for all, each one above from its share on."""
    out = np.ones(len(share), np.uint8)
    for t in range(1, TIERS):
        out |= (share >= TOP_SHARE * 4.0 ** (t + 1 - TIERS)).astype(np.uint8) << np.uint8(t)
    return out


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    g = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(g) else c


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Append ``lang_pred`` and ``score`` to (doc_id, text, ...); ``text`` itself is not returned.

    ``und`` with score 0 for a null text or one without letters. ``score`` is the winner's share of
    all corrected votes. With no votes at all the language of most learned text is taken, score 0.
    Ties go to the first language in order. Nothing learned: ``und`` for every text. An empty table
    gives no rows. Very long texts are handled whole, some 30 bytes of memory a byte of text.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = [f.name for f in keep]

    def run(batches):
        f = shared.value
        worth, mistaken = f.weights()
        for batch in C.slices(batches):
            col = batch.column(batch.num_columns - 1)
            g, starts = grams(col)
            n = np.diff(starts)
            votes = np.zeros((max(1, len(f.langs)), len(n)))
            found = f.find(g)
            for i in range(len(f.langs)):
                sums = np.concatenate([[0], np.cumsum(worth[i][found[:, i]])])
                votes[i] = np.maximum(0, sums[starts[1:]] - sums[starts[:-1]] - n * mistaken[i])
            total = votes.sum(0)
            best = np.where(total > 0, votes.argmax(0), f.prior)
            lettered = np.asarray(pc.match_substring_regex(col.fill_null(""), r"\p{L}")) & bool(f.langs)
            langs = np.where(lettered, np.array([*f.langs, "und"], object)[best], "und")
            scores = np.where(lettered & (total > 0), votes.max(0) / np.maximum(total, 1e-300), 0.0)
            cols = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{n}`") for n in names], "text").mapInArrow(run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").withColumn("held_out", C.id_remainder(F.col("doc_id"), 4) == 2)
    filters = learn(docs.where("not held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), filters)
