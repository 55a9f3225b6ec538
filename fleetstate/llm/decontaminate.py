"""Benchmark decontamination: prefix-filtered set join in DataFrame operations.

A benchmark item is cut into windows of ``size`` words (a shorter item is one window). A window's
shingles of up to three words are ordered by rarity in the corpus; as a window has to be contained
whole, its prefix is the one rarest shingle. Document shingles join these prefixes; the place of the
shingle in the window gives the only place in the document where the window can begin, bounds drop
what would begin or end outside the text, and the words there are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstate.llm import common as C

SIZE = 10
SHINGLE = 3
BROADCAST_ROWS = 200_000  # windows of some 300 bytes: 60 MB at most
LAST = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def windows_of(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """w (words of the window), items (sorted ids of the items that have it, as strings)."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("all")).where("size(all) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))).alias("at")
    return item.select("item", "all", at).select("item", F.slice("all", F.col("at"), F.lit(size)).alias("w")).groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _key(words: str, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(F.col(words), at + i) for i in range(length)])


def _shingles(df: DataFrame, words: str, lengths: list[int], *keep: str) -> DataFrame:
    """``keep``, pos and key of every shingle of the lengths given; the last ones of a text that are
    cut off by its end have nulls hashed as nothing and are kept out."""
    rows = df.select(*keep, F.posexplode(words).alias("pos", "word"))
    if len(lengths) == 1:
        n = lengths[0]
        return rows.where(F.col("pos") <= F.size(words) - n).select(*keep, "pos", _key(words, F.col("pos"), n).alias("key"))
    every = F.explode(F.array(*[F.when(F.col("pos") <= F.size(words) - n, _key(words, F.col("pos"), n)) for n in lengths])).alias("key")
    return rows.select(*keep, "pos", every).where("key is not null")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_key, text_key, at (first word, from 0), length, items: every occurrence of a window."""
    window = C.cut(windows_of(benchmark, size))
    n_windows = window.count()
    small = n_windows <= small_rows
    hint = F.broadcast if small else (lambda df: df)
    parts = window.select("w", "items", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    lengths = sorted(r["k"] for r in parts.select("k").distinct().collect())  # of 1, 2 and 3
    if not lengths:
        lengths = [SHINGLE]
    by_length = None
    for n in lengths:
        one = _shingles(parts.where(F.col("k") == n), "w", [n], "w", "items")
        by_length = one if by_length is None else by_length.unionByName(one)
    by_length = C.cut(by_length)
    text = docs.select("doc_key", "text_key", words_of(F.col("text")).alias("words"))
    wanted = by_length.select("key").distinct()
    # the corpus counts of the benchmark's shingles; ten keys a window at most
    rarity = _shingles(text.select("words"), "words", lengths, "words").select("key").join(hint(wanted), "key", "left_semi").groupBy("key").agg(F.count("*").alias("often"))
    rarest = F.min_by(F.struct("key", "pos"), F.struct("often", "key", "pos"))
    # a window with a shingle that the corpus hasn't occurs nowhere
    prefix = by_length.join(rarity, "key", "left").groupBy("w", "items").agg(F.count("often").alias("found"), F.count("*").alias("all"), rarest.alias("p")).where("found = all")
    prefix = C.cut(prefix.select("w", "items", F.col("p.key").alias("key"), F.col("p.pos").alias("offset")))
    begin = F.col("pos") - F.col("offset")
    inside = (begin >= 0) & (begin + F.size("w") <= F.size("words"))
    same = F.slice("words", begin + 1, F.size("w")) == F.col("w")
    if small:
        found = _shingles(text, "words", lengths, "doc_key", "text_key", "words").join(F.broadcast(prefix), "key")
    else:  # the words stay behind while shingles and prefixes are shuffled to each other
        near = _shingles(text, "words", lengths, "doc_key", "text_key", "words").drop("words").join(prefix, "key")
        found = near.join(text.dropDuplicates(["doc_key", "text_key"]), ["doc_key", "text_key"])
    return found.where(inside).where(same).select("doc_key", "text_key", begin.alias("at"), F.size("w").alias("length"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Append n_words, spans (at, length: occurrences of benchmark windows), n_hit (words inside any),
    items (sorted ids, as strings) and contaminated to the columns of ``docs``.

    Null and empty texts have no words and no hits; neither have documents when the benchmark is
    empty. A null item id stands as an empty string. Rows of one id are looked at each on its own.
    Columns of the appended names are replaced.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = hits(base.select("doc_key", "text_key", "text"), benchmark, size)
    per_text = found.groupBy("doc_key", "text_key").agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    inside = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    per_text = per_text.withColumn("n_hit", inside.cast("long"))
    new = ["n_words", "spans", "n_hit", "items", "contaminated"]
    done = base.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long")).drop("text").join(per_text, ["doc_key", "text_key"], "left")
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], "n_words", "spans", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items", F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"), C.read_table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
