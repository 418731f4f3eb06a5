"""Problems 6 … 8: tokenization, mixing, spam pages."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import spark_rows, sql_rows, views  # noqa: E402

from lamina.llm import automaton, mixing, pages, queries, spam, suffix, tokens  # noqa: E402
from lamina.llm.boost import Blend, Boosted  # noqa: E402
from lamina.llm.flow import Network  # noqa: E402

FOLDER = automaton.default_folder()
TABLES = automaton.compiled(FOLDER)
LABELS = automaton.labels(FOLDER)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/{automaton.TOKENIZER}")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encode(text):
    return np.frombuffer(automaton.encode_text(text, automaton.chunks(TABLES, FOLDER)), "<i4").tolist()


# --- 6 ---


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60) | st.text("abe ot'sh\n\t\x1c\x85  <|endoftext|>-=", max_size=120))
def test_ids_of_any_text(reference, text):
    assert encode(text) == reference(text)
    assert b"".join(map(LABELS.__getitem__, encode(text))) == text.encode()


def test_long_and_repetitive_texts(reference):
    rng = random.Random(2)
    for text in ("a" * 5000, "-" * 3000, "ab" * 900, " " * 700, "é" * 400, "x1" * 300, "".join(rng.choice("abcdefgh") for _ in range(4000))):
        assert encode(text) == reference(text)


def test_arcs_are_the_adjacent_pairs_of_encodings(reference):
    machine = automaton.Automaton(TABLES)
    rng = random.Random(5)
    names = [i for i, b in LABELS.items() if b.isalpha() and len(b) < 6]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(3000)]
    known = [(int(k) >> 20, int(k) & 0xFFFFF) for k in rng.sample(TABLES.arcs.tolist(), 20_000)]
    pairs += [(a, b) for a, b in known if a in LABELS and LABELS[a].isalpha() and LABELS[b].isalpha()]
    for a, b in pairs:
        text = (LABELS[a] + LABELS[b]).decode("utf-8", "replace")
        assert machine.arc(a, b) == (reference(text) == [a, b]), text


def test_tables_are_closed(reference):
    """Each label's prefixes have their path in the table; nothing within the vocabulary is settled later."""
    machine = automaton.Automaton(TABLES)
    for label in list(LABELS.values())[::7]:
        assert len(machine.encode(label)) == 1
        for end in range(1, len(label)):
            assert b"".join(LABELS[i] for i in machine.encode(label[:end])) == label[:end]
    assert not machine.other


def test_small_vocabulary_against_successive_merges():
    """Against the merges applied one after another, with doubled tokens and overlaps."""
    rng = random.Random(3)
    for _ in range(60):
        tokens_, merges = list("abc"), []
        for _ in range(rng.randint(1, 12)):
            u, v = rng.choice(tokens_), rng.choice(tokens_)
            if len(u + v) < 9 and u + v not in tokens_:
                merges.append((u, v))
                tokens_.append(u + v)
        ids = {t: i for i, t in enumerate(tokens_)}
        machine = automaton.Automaton(automaton.compile_tables(merges, ids | {c: 300 + b for c, b in automaton.byte_letters().items() if c not in ids}))
        for _ in range(150):
            word = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
            path = list(word)
            for u, v in merges:
                at = 0
                while at < len(path) - 1:
                    if path[at] == u and path[at + 1] == v:
                        path[at : at + 2] = [u + v]
                    at += 1
            assert machine.encode("".join(word).encode()) == [ids[t] for t in path], (merges, word)


def test_corpus(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, sf).collect()}
    assert got == {d: reference(t) if t else [] for d, t in texts.items()}
    assert spark_rows(queries.p6_decoded(spark, sf)) == sql_rows(views(sf), queries.SQL["p6_decoded"])
    edge = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "x"), (3, "a " * 400_000, "x")], "doc_id bigint, text string, ids string")
    sizes = [len(r.ids) for r in tokens.corpus_ids(edge).collect()]
    assert sizes[:2] == [0, 0] and sizes[2] > 1 and sizes[3] == len(reference("a " * 400_000))
    assert tokens.corpus_ids(edge.where("false")).collect() == []
    assert edge.select(tokens.count(F.col("text")).alias("n")).collect()[0].n == 0


# --- 7 ---


def test_flow_is_cheapest():
    net = Network()
    cheap, dear = net.arc(0, 2, 4, 0), net.arc(0, 2, 9, 5)
    other = net.arc(0, 3, 5, 1)
    net.arc(2, 1, 7)
    net.arc(3, 2, 5)
    assert net.run(0, 1) == 7 and (net.used(cheap), net.used(other), net.used(dear)) == (4, 3, 0)


def test_overlapping_patterns_are_routed():
    targets = [mixing.Target("m", s, w, 2, 1.0) for s, w in (("a", 1.0), ("b", 1.0))]
    quota = {"a": 100, "b": 100}
    flow = mixing.route([(("a",), 20), (("a", "b"), 90)], targets, quota)
    assert sum(v for (_, s), v in flow.items() if s == "a") == 100 and sum(v for (_, s), v in flow.items() if s == "b") == 100
    assert flow[0, "a"] <= 40


def rows_of(n, rng, sources):
    return [(i, [s] if s else [], rng.choice([0, 1, 7, 50, 400])) for i, s in enumerate(rng.choices(sources, [60, 25, 10, 4, 1], k=n))]


def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 50)  # many buckets
    rng = random.Random(1)
    rows = rows_of(3000, rng, ["big", "mid", "small", "rare", None])
    sized = spark.createDataFrame(rows, "doc_id bigint, pattern array<string>, n_tokens bigint")
    targets = spark.createDataFrame([("even", " BIG", 1.0, 1, 0.3), ("even", "mid", 1.0, 2, 0.3), ("even", "small", 1.0, 3, 0.3), ("even", "rare", 1.0, 2, 0.3), ("even", "none", 1.0, 9, 0.3), ("odd", "big", 3.0, 1, 0.2), ("odd", "rare", 0.0, 5, 0.2), ("odd", None, 1.0, 5, 0.2)], "mix_name string, source string, weight double, max_repeats int, corpus_fraction double")
    mixed = mixing.mix(sized, targets)
    chosen = mixed.chosen.collect()
    total, have = sum(r[2] for r in rows), Counter()
    for _, p, n in rows:
        have.update({s: n for s in p})
    used = Counter()
    limits = {("even", "big"): 1, ("even", "mid"): 2, ("even", "small"): 3, ("even", "rare"): 2, ("odd", "big"): 1}
    for r in chosen:
        assert 0 < r.uses <= limits[r.mix_name, r.source] and r.n_tokens > 0
        used[r.mix_name, r.source] += r.uses * r.n_tokens
    assert len({(r.mix_name, r.doc_id) for r in chosen}) == len(chosen)
    shares = {(r.mix_name, r.source): r for r in mixed.shares.collect()}
    assert len(shares) == 7
    for key, r in shares.items():
        assert r.actual_tokens == used[key]
        want = min(r.quota_tokens, have[key[1]] * r.max_repeats)
        assert abs(used[key] - want) <= 400, key
    assert abs(shares["even", "big"].quota_tokens - total * 0.3 / 5) <= 1 and shares["even", "none"].short and not shares["odd", "rare"].quota_tokens
    spread = [r.uses for r in chosen if (r.mix_name, r.source) == ("even", "small")]
    assert max(spread) - min(spread) <= 1  # nothing is repeated again while others wait
    for key, r in {(r.mix_name, r.source): r for r in mixing.mix(sized, targets, keep_shares=True).shares.collect()}.items():
        assert abs(r.actual_tokens - r.quota_tokens) <= 400 or not have[key[1]], key  # every source that has documents gets there
    again = mixing.mix(sized.orderBy(F.desc("doc_id")), targets)
    assert sorted(map(tuple, again.chosen.collect())) == sorted(map(tuple, chosen))


def test_copies_belong_to_all_their_sources(spark):
    docs = spark.createDataFrame([(5, "x y", "B "), (3, "x y", "a"), (4, "x y", "a"), (9, "x z", None), (7, "", "a"), (8, None, "a")], "doc_id bigint, text string, source string")
    sized = mixing.sources_by_copies(docs)
    assert sorted((r.doc_id, r.pattern, r.n_tokens) for r in sized.collect()) == [(3, ["a", "b"], 2), (9, [], 2)]
    rows = [(i, ["a"], 10) for i in range(10)] + [(i, ["a", "b"], 10) for i in range(10, 40)]
    both = spark.createDataFrame(rows, "doc_id bigint, pattern array<string>, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 1.0), ("m", "b", 1.0, 1, 1.0)], "mix_name string, source string, weight double, max_repeats int, corpus_fraction double")
    mixed = mixing.mix(both, targets)
    assert {r.source: r.actual_tokens for r in mixed.shares.collect()} == {"a": 200, "b": 200}  # a leaves the shared documents to b
    assert mixed.chosen.count() == 40 and mixed.chosen.where("source = 'b' AND doc_id < 10").count() == 0


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id bigint, pattern array<string>, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 0.5)], "mix_name string, source string, weight double, max_repeats int, corpus_fraction double")
    mixed = mixing.mix(sized, targets)
    assert mixed.chosen.count() == 0 and [(r.actual_tokens, r.actual_share) for r in mixed.shares.collect()] == [(0, 0.0)]
    assert mixing.mix(sized, targets.where("false")).shares.count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "x", " ")], "doc_id bigint, text string, source string")
    assert [r.pattern for r in mixing.sources_of(docs).collect()] == [[], []]


# --- 8 ---


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 4))
def test_coverage_by_repeats(items, least):
    n, want = len(items), set()
    for i in range(n):
        for j in range(i + least, n + 1):
            if any(items[k : k + j - i] == items[i:j] for k in range(n - (j - i) + 1) if k != i):
                want.update(range(i, j))
    assert suffix.covered(suffix.repeats(items), [1] * n, (least,)) == [len(want)]
    if items:  # the same from the suffix array, as pages of very many words are measured
        assert suffix.covered_from(suffix.longest_repeats(items), np.ones(n, int), (least,)) == [len(want)]
        assert suffix.longest_repeats(items).max() == max(suffix.repeats(items))[0]


def test_long_pages_are_measured_alike(monkeypatch):
    rng = random.Random(4)
    items = [rng.choice("abcdefgh") for _ in range(3000)] + ["x"] * 500
    sizes = [rng.randint(1, 9) for _ in items]
    want = suffix.coverage(items, sizes, (1, 3, 6))
    monkeypatch.setattr(suffix, "AUTOMATON_ITEMS", 10)
    assert suffix.coverage(items, sizes, (1, 3, 6)) == want


def test_bulk_leaves_layout_out():
    git = "commit 0123456789abcdef\nAuthor: A <a@b>\nDate:   2024\n\n    Fix it\n\ndiff --git a/x b/x\nindex 1..2 100644\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n old\n-gone\n+++ plus\n+new\n"
    assert pages.segments(git) == (["    Fix it"], ["++ plus", "new"])
    svn = "-" * 72 + "\nr5 | who | 2024 | 3 lines\n\nTidy\nIndex: a\n" + "=" * 67 + "\n--- a\n+++ a\n@@ -1 +1 @@\n-x\n+y\n"
    assert pages.segments(svn) == (["Tidy"], ["y"])
    mail = "From 0123456789\nFrom: A\nSubject: [PATCH 1/2] Do\n---\ndiff --git a/x b/x\n@@ -1 +1 @@\n+z\n--\n2.1\n"
    assert pages.segments(mail) == (["Do"], ["z"])
    assert pages.figures(None) is None and pages.figures(" \n") is None
    assert len(pages.figures("one word")) == len(pages.FEATURES)


def test_boosting_learns_and_degenerates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    for kind in (Boosted, Blend):
        m = kind().fit(x[:400], y[:400])
        assert ((m.score(x[400:]) > 0) == y[400:]).mean() > 0.93
    assert (Boosted().fit(x, np.zeros(600)).score(x) < 0).all()
    assert len(Boosted().fit(x[:1], y[:1]).score(x)) == 600


def test_held_out_pages(spark):
    """Half of the labels train, the other half judge."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "page_labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    judged = labels.where(~half & F.col("label").isNotNull()).dropDuplicates(["doc_id"])
    model = spam.train(docs, labels.where(half))
    rows = docs.join(judged, "doc_id").select("label", spam.score(F.col("text"), model).alias("odds")).collect()
    hit = [r.label == "spam" for r in rows if r.odds is not None and r.odds > spam.THRESHOLD]
    assert sum(hit) / len(hit) > 0.95
    assert sum(hit) / sum(r.label == "spam" for r in rows) >= 0.9
    assert {"the", "and", "because"} & model.ties and len(model.ties) <= spam.TIES


def test_pages_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "buy " * 90_000, 9.0)], "doc_id bigint, text string, odds double")
    labels = spark.createDataFrame([], "doc_id bigint, label string, labelled_at timestamp_ntz")
    assert spam.found(docs, labels).count() == 0
    assert spam.explained(docs, labels).count() == 1
    assert spam.found(docs.where("false"), labels).count() == 0
