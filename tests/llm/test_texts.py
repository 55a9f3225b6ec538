"""License scan, LM scoring, fingerprints, toxicity, language ID on the hard rows."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetstate.llm import common as C
from fleetstate.llm import fingerprint, langid, license_scan, ppm, toxicity
from fleetstate.llm.license_texts import KNOWN
from tests.llm.conftest import SCHEMA, doc, hard_rows, words


def test_word_hashes_tell_words_apart():
    texts = ["ab ba", "", "  ab\tab  ", "ba", "x" * 5000 + " ab"]
    data, offs = C.text_bytes(pa.array(texts))
    h, starts = C.hash_words(data, offs)
    assert np.diff(starts).tolist() == [2, 0, 2, 1, 2]
    assert h[0] == h[2] == h[3] == h[6] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert C.hash_words(*C.text_bytes(pa.array(["AB É"])), lower=True)[0].tolist() == C.hash_words(*C.text_bytes(pa.array(["ab É"])))[0].tolist()


def test_license_scan(spark, hard, none):
    mit = next(t for i, t in KNOWN if i == "MIT" and len(t) > 100)
    changed = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sublicence").replace(" AND ", "\nand ")
    rows = [doc(1, mit), doc(2, changed), doc(3, mit.replace("without", "with")), doc(4, "some text\nReleased under the MIT Licence!\nmore"), doc(4, "Copyright (C) 2001 A\nAll rights reserved.\n***"), doc(None, mit)]
    df = spark.createDataFrame(rows, SCHEMA).unionByName(hard)
    out = license_scan.scan(df)
    assert {"row", "doc_key", "text"} <= set(out.columns) and out.columns.count("digest") == 1
    got = {(r["doc_id"], r["text"]): (r["license_id"], r["notices"], r["n_notice_lines"]) for r in out.collect()}
    assert got[1, mit][0] == got[2, changed][0] == got[None, mit][0] == "MIT"
    assert got[3, rows[2][1]][0] is None and got[4, rows[3][1]] == (None, ["MIT"], 1) and got[4, rows[4][1]] == (None, [], 0)
    assert out.count() == len(rows) + len(hard_rows()) and got[2, None] == (None, [], 0) and got[3, ""] == (None, [], 0)
    assert license_scan.scan(none).count() == 0


def test_lm_score_equals_the_trie(hard):
    rows = [r for r in hard_rows() if r[1] is None or len(r[1]) < 3000]
    df = hard.where("text is null or length(text) < 3000").withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(True)))
    got = ppm.score(df.select("doc_id", "held_out", "text"), block_bytes=4000).collect()
    trie, count = ppm.Trie(), Counter()
    held = lambda r: r[0] is None or r[0] % 5 == 0
    tokens = lambda t: [*words(t, True), None]
    for r in rows:
        if not held(r):
            trie.text(r[1] or "", score=False)
            count.update(tokens(r[1]))
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(r[0]), held(r), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), total,
                   round(sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens(r[1])), 5), round(trie.text(r[1] or "", learn=False) / math.log(10), 5)) for r in rows)
    assert sorted((str(r[0]), *r[1:5], round(r[5], 5), round(r[6], 5)) for r in got) == want


def test_lm_score_edges(spark, none):
    assert ppm.score(none.withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text")).count() == 0
    all_held = spark.createDataFrame([(1, True, "ab")], "doc_id long, held_out boolean, text string")
    r = ppm.score(all_held).first()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and abs(r["score"] + 3 * math.log10(256)) < 1e-9
    adaptive = {r[0]: r[1] for r in ppm.score_adaptive(spark.createDataFrame([(1, "abab" * 50), (2, None), (3, "".join(map(chr, range(33, 233))))], "doc_id long, text string")).collect()}
    assert adaptive[3] < adaptive[1] < 0 and abs(adaptive[2] + math.log10(256)) < 1e-9


def test_probabilities_of_a_context_sum_to_one():
    trie = ppm.Trie()
    trie.text("the thin thing then that", score=False)
    for ctx in (b" the", b"zzzz", b"athi", bytes([ppm.START] * 4)):
        assert abs(sum(math.exp(trie.symbol(ctx, s)) for s in range(ppm.SYMBOLS)) - 1) < 1e-9


def test_fingerprints(spark, hard, none):
    rows = sorted(((r[0], r[1] or "") for r in hard_rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for parts in (1, 7):
        out = fingerprint.fingerprints(hard, parts).collect()
        got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out)
        want = []
        for i, (k, t) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            e = fingerprint.edit(t, following)
            a, b, c = fingerprint.digests([t.encode(), e.encode(), following.encode()])
            import hashlib

            want.append((str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.to_text(a), fingerprint.to_text(b), round(float(fingerprint.likeness(a, b)), 9), round(float(fingerprint.likeness(a, c)), 9)))
        assert got == sorted(want)
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([doc(1, "alone here")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    text = random.Random(1).randbytes(50_000)
    whole = fingerprint.digests([text])[0]
    monkeypatch.setattr(C, "SLICE_BYTES", 7001)
    assert (fingerprint.digests([text])[0] == whole).all()
    assert (fingerprint.from_text(fingerprint.to_text(whole)) == whole).all()


def test_toxicity(spark, hard, none):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abdeghilmnorst") for _ in range(r.randint(2, 7)))
    insults = ["zorgwit", "zorgwits", "zorgwitty", "bluffhead", "bluffheads"]
    texts = []
    for i in range(400):
        w = [word() for _ in range(r.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(insults)
        texts.append((" ".join(w), int(bad)))
    model = toxicity.fit(texts, 0.25)
    unseen = ["ab de zorgwitz ge hi", "ab de bluffheadd ge hi"]
    clean = [" ".join(word() for _ in range(100)) for _ in range(100)]
    df = spark.createDataFrame([doc(1000 + i, t) for i, t in enumerate(unseen + clean)], SCHEMA).unionByName(hard)
    out = toxicity.score(df, model)
    assert out.columns.count("score") == 1 and out.count() == 102 + len(hard_rows())
    got = {r["doc_id"]: r for r in out.where("doc_id >= 1000").collect()}
    others = sorted(got[i]["score"] for i in range(1002, 1102))
    assert min(got[1000]["score"], got[1001]["score"]) > others[90]  # spellings that training hasn't seen
    assert sum(r["predicted"] for r in out.collect()) <= 8
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.where("text is null").first()["score"] == 0.0
    assert toxicity.score(none, model).count() == 0
    # training through Spark: the sample holds one row per id, conflicting and null labels aside
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(0, 1), (1, None), (None, 1), (10_000, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(2, "second text of an id")], "doc_id long, text string")
    assert toxicity.sample(docs, labels, "toxic", (50, 20), 20_000).groupBy("y").count().orderBy("y").collect() == [(0, 50), (1, 20)]
    trained = toxicity.train(docs, labels)
    assert trained.known.any()
    assert not toxicity.train(none, labels.where("false")).known.any()


def test_language_id(spark, hard, none):
    r = random.Random(9)
    syllables = {"aa": ["ka", "mo", "ti"], "bb": ["sch", "ung", "eit"], "cc": ["ção", "lha", "ém"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    train = [(i, text(lang, 200), lang) for i, lang in enumerate(list(syllables) * 20)] + [(900, "ignored", None), (901, None, "aa")]
    filters = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert filters.langs == ["aa", "bb", "cc"] and (filters.false_rate() < 0.2).all()
    test = spark.createDataFrame([doc(i, text(lang, 30), lang) for i, lang in enumerate(list(syllables) * 5)], SCHEMA)
    out = langid.predict(test.unionByName(hard), filters)
    assert out.columns.count("score") == 1
    assert out.where("lang in ('aa', 'bb', 'cc') and lang <> lang_pred").count() == 0
    by = {r["doc_id"]: r for r in out.where("doc_id in (2, 3, 4) and lang = 'en'").collect()}
    assert {by[i]["lang_pred"] for i in (2, 3, 4)} == {"und"} and {r["lang_pred"] for r in out.collect()} <= {"aa", "bb", "cc", "und"}
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert langid.predict(none, filters).count() == 0
    empty = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(hard, empty).collect()} == {"und"}


def test_languages_beyond_one_word_of_bits(spark):
    langs = [f"l{i:03}" for i in range(70)]
    letters = [chr(0x4E00 + 40 * i) for i in range(70)]
    rows = [(i, " ".join(letters[i] * k for k in (2, 3, 4)) * 5, lang) for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df)
    assert filters.slots.shape[1] == 70
    assert langid.predict(df, filters).where("lang <> lang_pred").count() == 0


def plain_grams(text):
    text = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = b"   " + text.encode() + b"   "
    return [data[i: i + 4] for i in range(len(data) - 3) if data[i: i + 4] != b"    "]


def test_votes_are_those_of_plain_loops(spark):
    """Filters large enough not to err: every n-gram, at the tier of its share, votes as counted."""
    r = random.Random(4)
    word = lambda lang: "".join(r.choice(lang) for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word(("abcdeéf", "defgßh", "aghijk")[i % 3] if r.random() < 0.9 else "xyz") for _ in range(r.randint(0, 120))), "abc"[i % 3]) for i in range(90)]
    rows += [(100, "", "a"), (101, None, "a"), (102, "12 !", "b"), (103, "seen in no language: q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    counts = {}
    for _, text, lang in rows:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    langs = sorted(counts)
    least = [0.0] + [2.0 ** -8 / 4 ** k for k in range(6, -1, -1)]
    tier = {lang: {g: sum(n / sum(c.values()) >= x for x in least) for g, n in c.items()} for lang, c in counts.items()}
    filters = langid.learn(df, bits_per_gram=4000)
    assert filters.langs == langs and filters.false_rate().max() < 1e-8
    got = {r["doc_id"]: r for r in langid.predict(df, filters).collect()}
    for i, text, _ in rows:
        votes = [sum(tier[lang].get(g, 0) for g in plain_grams(text or "")) for lang in langs]
        if not any(map(str.isalpha, text or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] == langs[votes.index(max(votes))], i
            assert abs(got[i]["score"] - max(votes) / sum(votes)) < 1e-4


def test_full_filters_still_decide(spark):
    """Slots far too few: no n-gram is dropped, what is found by mistake is taken off the votes."""
    r = random.Random(5)
    word = lambda lang: "".join(r.choice(lang) for _ in range(r.randint(2, 6)))
    rows = [(i, " ".join(word(("abcdef", "defghi", "ghijab")[i % 3]) for _ in range(150)), "abc"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df, filter_bytes=3 << 11)
    assert filters.slots.shape == (1 << 11, 3) and filters.false_rate().max() > 0.05
    assert langid.predict(df, filters).where("lang <> lang_pred").count() <= 2


def test_held_out_languages(spark):
    docs = C.read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    out = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null")
    rows = out.collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.98


def test_long_text_is_hashed_in_stretches(monkeypatch):
    data, offs = C.text_bytes(pa.array(["ab cd  ef\n" * 500 + "z" * 3000 + " end"]))
    whole = C.hash_words(data, offs)
    monkeypatch.setattr(C, "LONG_BYTES", 777)
    cut = C.hash_words(data, offs)
    assert (whole[0] == cut[0]).all() and whole[1].tolist() == cut[1].tolist()
