"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of its hashed character n-gram vectors (marks at both ends), a window of words is
the mean of its words, and a linear softmax reads the window. A text is as toxic as its worst
window, so one insult counts in a short text and in a very long one alike. Subwords let an unseen
spelling share the vectors of the spellings learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.llm import common as C

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
DIM = 4
SPAN = 3  # words of a window
STEP = 1
MIN_TEXTS = 4  # a subword of fewer training texts isn't learned: it would only name those texts

# Bytes of a normalised text: letters lower-cased, look-alike digits and signs as letters, other
# ASCII signs dropped, white space as one mark. Bytes above ASCII stay.
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
for a, b in zip("013457@$", "oieastas", strict=True):
    _MAP[ord(a)] = ord(b)
_DROP = np.zeros(256, bool)
_DROP[:128] = True
for x in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@$":
    _DROP[x] = False
_DROP[list(C.SPACES)] = False
_MAP[list(C.SPACES)] = 32


def _normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = ~_DROP[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    return _MAP[data[keep]], before[offs]


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes with a space around each word; word begins, word ends; words before each text."""
    b, offs = _normal(data, offs)
    n = len(offs) - 1
    out = np.full(len(b) + n + 1, 32, np.uint8)
    out[np.arange(len(b)) + np.repeat(np.arange(1, n + 1), np.diff(offs))] = b
    solid = out != 32
    edge = np.diff(solid.astype(np.int8))
    begin = np.flatnonzero(edge == 1) + 1
    end = np.flatnonzero(edge == -1) + 1
    return out, begin, end, np.searchsorted(begin, offs + np.arange(n + 1))


def subwords(out: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """For each n-gram size: bucket at every byte, and a mask of the n-grams inside one marked word."""
    solid = out != 32
    gaps = np.concatenate([[0], np.cumsum(~solid)])
    for n in SIZES:
        m = len(out) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= out[i: m + i]
        h *= np.uint32(0x9E3779B1)
        h ^= np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        # a mark may stand first or last only, with the word between
        inner = gaps[n - 1: m + n - 1] - gaps[1: m + 1] == 0
        yield n, (h & np.uint32(BUCKETS - 1)).astype(np.int64), inner


@dataclass
class Model:
    """One logit difference per subword (embedding times softmax weights) and the text calibration."""

    table: np.ndarray
    known: np.ndarray  # learned subwords; a word is the mean of those it has
    scale: float
    bias: float


def word_scores(out: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray, known: np.ndarray) -> np.ndarray:
    total = np.zeros(len(begin))
    count = np.zeros(len(begin))
    for n, bucket, inner in subwords(out, begin, end):
        # n-grams of a word begin at its opening mark or later, and end at its closing mark at most
        inner &= known[bucket]
        some = np.concatenate([[0], np.cumsum(inner)])
        part = np.concatenate([[0.0], np.cumsum(np.where(inner, table[bucket], np.float32(0)), dtype=np.float64)])
        lo = np.minimum(begin - 1, len(bucket))
        hi = np.clip(end + 1 - n + 1, lo, len(bucket))
        total += part[hi] - part[lo]
        count += some[hi] - some[lo]
    return total / np.maximum(count, 1)


def window_means(scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean score of every window of SPAN words (fewer in a shorter text), and windows before each text."""
    n = np.diff(starts)
    windows = np.where(n > 0, np.maximum(-(-(n - SPAN) // STEP) + 1, 1), 0)
    before = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(n)), windows)
    lo = starts[:-1][text] + (np.arange(before[-1]) - before[text]) * STEP
    hi = np.minimum(lo + SPAN, starts[1:][text])
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1), before


def worst(col: pa.Array, table: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The highest window mean of each text; -inf without words."""
    data, offs = C.text_bytes(col)
    out, begin, end, starts = words_of(data, offs)
    if not len(begin):
        return np.full(len(col), -np.inf)
    means, before = window_means(word_scores(out, begin, end, table, known), starts)
    top = np.full(len(col), -np.inf)
    some = np.flatnonzero(np.diff(before))
    top[some] = np.maximum.reduceat(means, before[some])
    return top


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], max_chars: int) -> DataFrame:
    """doc_id, text, y: up to ``per_class`` texts of class 0 and 1, of ``max_chars`` characters at most,
    in hash order of the id. That bounds what trains the model. Texts with both labels or a null one
    aren't taken."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    short = docs.where((F.col("text") != "") & (F.length("text") <= max_chars)).select("doc_id", F.xxhash64("doc_id").alias("h"))
    picked = None
    for y in (0, 1):
        some = one.where(F.col("y") == y).select("doc_id", "y").join(short, "doc_id").dropDuplicates(["doc_id"]).orderBy("h", "doc_id").limit(per_class[y])
        picked = some if picked is None else picked.unionAll(some)
    chosen = F.broadcast(picked.select("doc_id", "y"))  # as many ids as per_class at most
    rows = docs.select("doc_id", "text").where((F.col("text") != "") & (F.length("text") <= max_chars)).join(chosen, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").cast("int").alias("y"))


def _windows(starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of every window, and the number of windows before each text."""
    n = np.diff(starts)
    count = np.maximum(-(-(n - SPAN) // step) + 1, 1)
    before = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n), dtype=np.int32), count)
    lo = (starts[:-1][text] + (np.arange(before[-1]) - before[text]) * step).astype(np.int32)
    return text, lo, np.minimum(lo + SPAN, starts[1:][text]).astype(np.int32), before


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word number of every word, words before each text, and the distinct words."""
    parts, counts, known, spelled = [], [], {}, []
    for batch in C.slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])])):
        out, begin, end, starts = words_of(*C.text_bytes(batch.column(0)))
        counts.append(np.diff(starts))
        hashes, _ = C.hash_words(out, np.array([0, len(out)]))
        own, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        number = np.zeros(len(own), np.int32)
        for i, (h, f) in enumerate(zip(own.tolist(), first.tolist(), strict=True)):
            if h not in known:
                known[h] = len(spelled)
                spelled.append(out[begin[f]: end[f]].tobytes())
            number[i] = known[h]
        parts.append(number[at])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), spelled


def fit(texts: list[tuple[str, int]], share: float = 0.5, rounds: int = 4, steps: int = 10, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly with full-batch Adam steps.

    First round: every window has its text's label, both classes weigh the same, so words that only
    toxic texts have gain weight. Later rounds: a toxic text keeps its worst window alone, a clean
    text its few worst ones, which takes back what the first round learned from chance.
    ``share`` is the share of class 1 among the rows to score; it sets where the score passes 0.5.
    """
    texts = [t for t in texts if len(words_of(*C.text_bytes(pa.array([t[0]])))[1])]
    if len({y for _, y in texts}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool), 1.0, 10.0 if texts and texts[0][1] else -10.0)
    y = np.array([t[1] for t in texts])
    word, starts, spelled = _vocabulary([t[0] for t in texts])
    owner, bucket = [], []
    joined = np.frombuffer(b" " + b" ".join(spelled) + b" ", np.uint8)
    edge = np.flatnonzero(joined == 32)
    for n, b, inner in subwords(joined, edge[:-1] + 1, edge[1:]):
        own = (np.searchsorted(edge, np.arange(len(b)), side="right") - 1).astype(np.int32)  # an n-gram belongs to the word after the last mark at or before it
        owner.append(own[inner])
        bucket.append(b[inner].astype(np.int32))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    del joined, edge, own, b, inner
    known = _widespread(owner, bucket, word, starts)
    keep = known[bucket]
    owner, bucket = owner[keep], bucket[keep]
    per_word = np.maximum(np.bincount(owner, minlength=len(spelled)), 1)

    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM), dtype=np.float32) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, bias)]
    text, lo, hi, before = _windows(starts, STEP)

    def diff_scores() -> np.ndarray:
        """Logit difference of every window, through the scalar table."""
        table = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
        per = np.bincount(owner, table[bucket], len(spelled)) / per_word
        sums = np.concatenate([[0.0], np.cumsum(per[word])])
        return ((sums[hi] - sums[lo]) / (hi - lo)).astype(np.float32)

    step = 0
    for r in range(rounds):
        if r == 0:
            of, a, b, seen = _windows(starts, SPAN)  # side by side
            weight = 1.0 / np.diff(seen)[of]
        else:
            means = diff_scores()
            order = np.lexsort((-means, text))
            rank = np.arange(len(order)) - before[text[order]]
            use = np.sort(order[rank < np.where(y[text[order]] == 1, 1, 6)])
            del order, rank
            of, a, b = text[use], lo[use], hi[use]
            weight = 1.0 / np.bincount(of, minlength=len(y))[of]
        label = y[of]
        for cls in (0, 1):
            weight[label == cls] /= weight[label == cls].sum() * 2
        # word occurrences of the windows used
        size = b - a
        win = np.repeat(np.arange(len(a), dtype=np.int32), size)
        occ = np.repeat(a, size) + (np.arange(len(win)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        # words and subwords those windows have: the rest has no gradient
        used, at = np.unique(word[occ], return_inverse=True)
        at = at.astype(np.int32)
        some = np.zeros(len(spelled), bool)
        some[used] = True
        pick = some[owner]
        sub_owner = (np.cumsum(some, dtype=np.int32) - 1)[owner[pick]]
        live, sub_at = np.unique(bucket[pick], return_inverse=True)
        sub_at = sub_at.astype(np.int32)
        of_word = per_word[used][:, None]
        del occ, some, pick
        for _ in range(steps):
            step += 1
            e = emb[live]
            vec = np.stack([np.bincount(sub_owner, e[sub_at, d], len(used)) for d in range(DIM)], 1) / of_word
            mean = np.stack([np.bincount(win, vec[at, d], len(a)) for d in range(DIM)], 1) / size[:, None]
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(a)), label] -= 1
            p *= weight[:, None] * 1000
            g_soft, g_bias = mean.T @ p, p.sum(0)
            g_mean = (p @ soft.T) / size[:, None]
            g_vec = np.stack([np.bincount(at, g_mean[win, d], len(used)) for d in range(DIM)], 1) / of_word
            g_emb = np.stack([np.bincount(sub_at, g_vec[sub_owner, d], len(live)) for d in range(DIM)], 1)
            for i, (p_, g) in enumerate(((emb, g_emb), (soft, g_soft), (bias, g_bias))):
                m, v = state[i]
                w = live if i == 0 else slice(None)
                g = g.astype(np.float32)
                m[w] = 0.9 * m[w] + 0.1 * g
                v[w] = 0.99 * v[w] + 0.01 * g * g
                p_[w] -= (0.05 if i == 0 else 0.1) * (m[w] / (1 - 0.9 ** step)) / (np.sqrt(v[w] / (1 - 0.99 ** step)) + 1e-6)
    table = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    scale, offset = _calibrate(np.maximum.reduceat(diff_scores(), before[:-1]), y, share)
    return Model(np.where(known, table, np.float32(0)), known, scale, offset)


def _widespread(owner: np.ndarray, bucket: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Subwords that MIN_TEXTS training texts or more have."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    words = int(word.max()) + 1
    pairs = np.unique(text * words + word)  # each word of a text once, text by text
    by_word = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[by_word], np.arange(words + 1))
    texts = np.zeros(BUCKETS, np.int32)
    for part in np.array_split(pairs, len(pairs) // 200_000 + 1):  # bounds the memory of the expansion
        w, t = part % words, part // words
        size = begins[w + 1] - begins[w]
        at = np.repeat(begins[w], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        seen = np.unique(bucket[by_word[at]] * np.int64(len(starts)) + np.repeat(t, size))
        texts += np.bincount(seen // len(starts), minlength=BUCKETS).astype(np.int32)
    return texts >= MIN_TEXTS


def _calibrate(top: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic fit of a text's worst window to its label, class 1 at ``share`` of the weight."""
    mid, spread = top.mean(), top.std() + 1e-9
    x = (top - mid) / spread
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps with a very small ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = weight * (p - y)
        w = weight * p * (1 - p)
        hess = np.array([[(w * x * x).sum() + 1e-5, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-5]])
        da, db = np.linalg.solve(hess, [(g * x).sum() + 1e-5 * a, g.sum() + 1e-5 * b])
        a, b = a - da, b - db
    return float(a / spread), float(b - a * mid / spread)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` to (doc_id, ..., text); text stays as it is.

    Null texts and texts without words are as clean as the model's bias allows: score 0.
    """
    names = [f.name for f in docs.schema.fields if f.name not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select(*[F.col(f"`{n}`") for n in names])
    where = names.index("text")

    def run(batches):
        m = shared.value
        for batch in C.slices(batches):
            top = worst(batch.column(where), m.table, m.known)
            with np.errstate(over="ignore"):
                p = np.where(np.isfinite(top), 1 / (1 + np.exp(-(m.scale * np.where(np.isfinite(top), top, 0) + m.bias))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rest.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = (4000, 2000), max_chars: int = 20_000) -> Model:
    """Fit on a bounded sample: ``per_class`` rows of class 0 and 1, texts of ``max_chars`` at most.
    One task trains; the driver gets the learned subwords' weights, BUCKETS at most."""
    counts = labels.agg(F.avg(F.col(label).cast("double")).alias("share")).first()
    share = min(max(counts["share"] or 0.5, 0.02), 0.98)

    def learn(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        model = fit([(r[1], r[2]) for r in sorted(rows)], share)
        some = np.flatnonzero(model.known).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary()), pa.array([model.table[some].astype("<f4").tobytes()], pa.binary()), pa.array([model.scale]), pa.array([model.bias])], ["known", "weights", "scale", "bias"])

    row = sample(docs, labels, label, per_class, max_chars).coalesce(1).mapInArrow(learn, "known binary, weights binary, scale double, bias double").first()
    table, known = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
    if row is None:
        return Model(table, known, 1.0, -10.0)
    some = np.frombuffer(row["known"], "<i4")
    table[some], known[some] = np.frombuffer(row["weights"], "<f4"), True
    return Model(table, known, row["scale"], row["bias"])


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.read_table(spark, sf_dir, "labels")
    learn = C.id_remainder(F.col("doc_id"), 5) != 0
    model = train(docs.where(learn), labels.where(learn))
    held = docs.withColumn("held_out", C.id_remainder(F.col("doc_id"), 5) == 0)
    return score(held, model).drop("text")
