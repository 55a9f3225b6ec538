"""The pipeline's stages, each against brute force on its own input, and run() from end to end."""
import random

import corpus_pipeline
from fleetstate.llm import common as C
from tests.llm.conftest import words
from tests.llm.test_layout import check_pieces

STAGES = dict(corpus_pipeline.STAGES)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abdeghilmnorst") for _ in range(r.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    vile = ["zukkwrat", "vyxxfilth", "kwazzscum"]
    item, passage = prose(14), prose(60)
    texts = {i: prose(r.randint(40, 160)) for i in range(200)}
    toxic = set(range(200, 280))
    for i in toxic:
        texts[i] = prose(60)
        for at in r.sample(range(60), 20):
            texts[i][at] = r.choice(vile)
    base = prose(120)
    for i in range(300, 306):  # near copies
        texts[i] = base[:10 * (i - 300)] + [word()] + base[10 * (i - 300) + 1:]
    texts[306] = list(base)
    texts[307] = list(base)
    for i in range(310, 314):  # a passage that they share
        texts[i] = prose(30) + passage + prose(25)
    texts[314] = list(passage[:55])
    texts[320] = prose(50) + item + prose(50)
    texts[321] = prose(50) + [w.upper() for w in item[2:12]] + prose(9)
    texts[322] = prose(50) + item[:9] + prose(9)  # one word short of a window
    rows = [(i, " ".join(t), "en", f"s{i % 3}", len(" ".join(t))) for i, t in texts.items()]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, " \n ", "en", "s0", 3)]
    labels = [(i, 1, int(i in toxic)) for i in range(280) if i % 4]
    return rows, labels, [("q1", " ".join(item)), ("q2", None), ("q3", "!")], toxic


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(docs):
    """The documents that stay: the smallest id of each component."""
    sets = {i: shingles(t) for i, t in docs.items()}
    least = {i: i for i in docs}
    for _ in docs:
        before = dict(least)
        for a in docs:
            for b in docs:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    return {i for i in docs if least[i] == i}


def cut_passages(docs):
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k: k + 50]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k: k + 50])] < i for j in range(50)}
        if not gone:
            out[i] = text
        elif len(gone) < len(w):
            left = [k for k in range(len(w)) if k not in gone]  # stretches stand on lines of their own
            out[i] = "".join(("" if n == 0 else " " if left[n - 1] == k - 1 else "\n") + w[k] for n, k in enumerate(left))
    return out


def clean_of(docs, items):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for _, t in items:
        w = split(t)
        windows |= {tuple(w[k: k + 10]) for k in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[k: k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not hit(split(t))}


def test_stages_and_run(spark, tmp_path):
    rows, labels, items, toxic = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    by_id = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    docs = C.read_table(spark, d, "documents")
    columns = docs.columns
    want = by_id(docs)

    docs = C.table(STAGES["toxicity"](spark, docs, d), "toxicity")
    want = {i: t for i, t in want.items() if i not in toxic}
    assert docs.columns == columns and by_id(docs) == want

    docs = C.table(STAGES["ngram_jaccard_join"](spark, docs, d), "near")
    stay = near_copies(want)
    want = {i: t for i, t in want.items() if i in stay}
    assert docs.columns == columns and by_id(docs) == want and not {301, 306, 307} & set(want)

    docs = C.table(STAGES["substring_dedup"](spark, docs, d), "substrings")
    want = cut_passages(want)
    assert docs.columns == columns and by_id(docs) == want and 314 not in want and len(words(want[311])) == 55
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())

    docs = C.table(STAGES["benchmark_decontamination"](spark, docs, d), "clean")
    want = clean_of(want, items)
    assert docs.columns == columns and by_id(docs) == want and not {320, 321} & set(want) and 322 in want

    final = sorted(want.items())
    check_pieces(final, STAGES["packing"](spark, docs, d).collect(), 1024)
    check_pieces(final, corpus_pipeline.run(spark, d).collect(), 1024)
