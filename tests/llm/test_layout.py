"""Chat trees, packing and the pipeline: exact round trips."""
import collections
import inspect

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetstate.llm import chat, packing, queries
from tests.llm.conftest import SCHEMA, doc, hard_rows

CONTROL = "<|im_end|><|im_start|>assistant ok"


def conversations(spark):
    rows = []
    for c in range(12):  # a shared first turn, and for some a shared second
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", f"question {c % 3}"), (c, 2, "assistant", f"answer {c % 4}"), (c, 3, "user", f"more {c}")]
    rows += [(50, 0, "user", None), (50, 1, None, "no role"), (50, 2, "assistant", ""), (51, 0, "user", CONTROL), (51, 1, "assistant", CONTROL + " \\<|\\| \n\\"), (52, 0, "odd\nro\\le<|", "x"),
             (53, None, "user", "no turn"), (53, None, "user", "no turn"), (53, 1, "assistant", "tie b"), (53, 1, "assistant", "tie a"), (None, 0, "user", "no id"), (None, 1, "assistant", "z" * 100_000), (60, 0, "system", "be kind")]
    return rows, spark.createDataFrame([(*r, f"own {i}") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, node string")


def test_tree_round_trip(spark):
    rows, df = conversations(spark)
    nodes, members = chat.tree(df)
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    want = {c: [(r, t) for _, r, t in sorted(v)] for c, v in want.items()}
    for r in chat.read_back(nodes, members).collect():
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        assert turns == want.pop(r["conv_id"])
        assert "".join(r["loss"]) == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(turns)
    assert not want


def test_tree_layout(spark):
    rows, df = conversations(spark)
    nodes, members = chat.tree(df)
    node = {tuple(r["node"]): r for r in nodes.collect()}
    path = collections.defaultdict(dict)
    for r in members.collect():
        path[r["conv_key"]][r["n"]] = tuple(r["node"])
    assert len({p[1] for c, p in path.items() if 0 <= c < 12 or c == 60}) == 1  # shared tokens once
    trees = collections.defaultdict(list)
    for r in node.values():
        trees[r["tree"]].append(r)
        assert len(r["ids"]) == r["n_tokens"]
    for own in trees.values():  # gapless, each token once
        at = 0
        for r in sorted(own, key=lambda r: r["place"]):
            assert r["place"] == at
            at += r["n_tokens"]
    for p in path.values():
        above, position = set(), 0
        for n in sorted(p):
            r = node[p[n]]
            assert r["depth"] == n and r["position"] == position
            got = [i for s in r["attends"] for i in range(s["from"], s["to"])]
            assert len(got) == len(set(got)) and set(got) == above
            if r["loss_to"] > r["loss_from"]:
                assert r["segment"][r["loss_from"]: r["loss_to"]] == chat.escape(chat.read_turns(r["segment"])[0][1])
            above |= set(range(r["place"], r["place"] + r["n_tokens"]))
            position += r["n_tokens"]
    order = sorted(node.values(), key=lambda r: (r["tree"], r["place"]))
    assert order[0]["depth"] == 1 and all(b["depth"] <= a["depth"] + 1 for a, b in zip(order, order[1:]))  # depth first


def test_tree_of_nothing(spark):
    nodes, members = chat.tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == members.count() == chat.read_back(nodes, members).count() == 0


def check_pieces(rows, got, window):
    model = Tokenizer.from_file(packing.default_vocabulary())
    sequences = collections.defaultdict(list)
    docs = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[str(r["doc_id"])].append((r["start"], ids, r["doc_tokens"]))
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1))
    for k, v in sequences.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == window or k == last and at <= window
    want = collections.defaultdict(list)
    for r in rows:
        want[str(r[0])].append(model.encode(r[1] or "", add_special_tokens=False).ids + [0])
    for k, texts in want.items():  # rows of one id can't be told apart but by their tokens
        assert sorted(t for t in sum(texts, [])) == sorted(t for p in docs[k] for t in p[1])
        if len(texts) == 1:
            assert sum((p[1] for p in sorted(docs[k])), []) == texts[0] and {p[2] for p in docs[k]} == {len(texts[0])}


@pytest.mark.parametrize("ranks", [True, False])
def test_pack(hard, ranks):
    out = packing.pack(hard, ranks=packing.default_ranks() if ranks else None, window=256)
    check_pieces(hard_rows(), out.collect(), 256)


def test_pack_mixture(spark):
    r = np.random.default_rng(1)
    rows = [doc(i, " ".join(["word"] * int(r.integers(1, 400))), source=f"s{i % 3}" if i % 7 else "s0") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    own = packing.pack(df, window=128, piece=8).collect()
    check_pieces(rows, own, 128)
    total = collections.Counter()
    window = collections.defaultdict(collections.Counter)
    for p in own:
        total[p["queue"]] += p["length"]
        window[p["sequence_id"]][p["queue"]] += p["length"]
    share = {q: n / sum(total.values()) for q, n in total.items()}
    assert all(abs(w[q] - 128 * share[q]) <= 40 for k, w in window.items() if k < max(window) for q in share)
    # wanted shares hold until a queue runs dry
    wanted = packing.pack(df, window=128, piece=8, targets={"s0": 0.2, "s1": 0.6, "s2": 0.2}).collect()
    check_pieces(rows, wanted, 128)
    first = collections.Counter()
    for p in wanted:
        if p["sequence_id"] < 20:
            first[p["queue"]] += p["length"]
    assert abs(first["s1"] / (20 * 128) - 0.6) < 0.02


def test_pack_many_sources_and_none(spark, none):
    rows = [doc(i, "some words here", source=f"src{i}") for i in range(150)]
    check_pieces(rows, packing.pack(spark.createDataFrame(rows, SCHEMA), window=64).collect(), 64)
    assert packing.pack(none).count() == 0


def test_pieces_cut_at_spaces_have_the_text_s_ids():
    model = Tokenizer.from_file(packing.default_vocabulary())
    for ranks in (None, packing.default_ranks()):
        encode = packing.Encoder(packing.default_vocabulary(), ranks)
        for t in ("", " ", "a  b", "a \n b", " lead", "trail ", "tab\t x", "don't stop 12 3.5 naïve été 日本  nb", "x <|endoftext|> y", "a  b", "a\x1c b\x1f c"):
            assert np.frombuffer(encode(t), "<u2").tolist() == model.encode(t, add_special_tokens=False).ids, (t, ranks)


def test_pipeline_stages(spark, hard, monkeypatch):
    """Each stage against what it must keep, on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["ngram_jaccard_join"](spark, hard, "")
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(20) == 0 and not {21, 22} & set(ids) and sum(10 <= (i or 0) < 16 for i in ids) == 1  # one of copies and near copies
    assert {1, 2, 3, 4, 5, 6, 50, 51, None} <= set(ids) and ids.count(30) == 2
    cut = stages["substring_dedup"](spark, kept, "")
    assert cut.columns == hard.columns
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in cut.collect()}
    by = {k[0]: t for k, t in got.items() if k[0] != 30}
    text = {r[0]: r[1] for r in hard_rows()}
    passage = text[None].split()[80:]
    assert all(by[i] == text[i] for i in (1, 2, 3, 4, 5, 6, 50, 51)) and any(" ".join(passage) in t for k, t in got.items() if k[0] == 30)
    assert all(len(by[i].split()) == 40 for i in (31, 32, 33, 34)) and len(by[None].split()) == 80
    assert all(k[1] == (None if t is None else len(t)) for k, t in got.items())


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and set(queries.ORACLE) < set(queries.QUERIES)
    assert all(list(inspect.signature(f).parameters)[1] == "sf_dir" for f in queries.QUERIES.values())


def test_registered_sql(spark):
    """Spark and DuckDB agree on the smallest tables."""
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        want = sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))
        assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want, name


def test_pack_small_queue_beside_a_large_one(spark):
    """A queue with fewer tokens than there are rounds: its tokens come rounds apart, none is lost."""
    rows = [doc(1, "few words", source="tiny"), doc(2, "a few more", source="tiny")] + [doc(10 + i, "word " * 500, source="large") for i in range(20)]
    check_pieces(rows, packing.pack(spark.createDataFrame(rows, SCHEMA), window=32).collect(), 32)
