import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import langid, langmodel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=8), max_size=6), st.text("abcd", max_size=20))
def test_automaton_gives_longest_matches(words, text):
    automaton = langid.SuffixAutomaton()
    for w in words:
        automaton.add(w)
    want, at = [], 0
    while at < len(text):
        n = max((k for k in range(1, len(text) - at + 1) if any(text[at : at + k] in w for w in words)), default=1)
        want.append(n)
        at += n
    assert automaton.match_lengths(text) == want
    assert langid.phrase_count(automaton.linked(), text) == len(want)


def longest(text, passages):
    """Phrases by trying every length, and their number; sample is searched as plain text."""
    sample, at, n = "\x00".join(passages), 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def plain_letters(text):
    return "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")


def test_predictions_against_brute_force(spark, docs):
    """lang_pred and score of every text, from phrases found by search in the sample itself."""
    model = langid.training_sample(langid.trainable(docs), docs_per_language=40, passages_per_language=30)
    samples = {lang: [" ".join(plain_letters(p).split()) for p in passages] for lang, passages in model.items()}
    samples = {lang: [f" {p} " for p in passages] for lang, passages in samples.items()}
    some = docs.where(F.length("text") < 6000)
    for r in langid.identify(some.select("doc_id", "text"), model).collect():
        text = " " + "".join(f"{w} " for w in plain_letters(r["text"]).split())
        letters = len(text.replace(" ", ""))
        stretches = [text[k : k + langid.STRETCH] for k in range(0, len(text), langid.STRETCH)]
        costs = sorted((sum(longest(t, s) for t in stretches) * math.log2(sum(map(len, s))) / max(1, letters), lang) for lang, s in samples.items())
        want = (costs[0][1], 1 - costs[0][0] / costs[1][0]) if letters else ("und", 0.0)
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé .\n", max_size=40), max_size=4), st.lists(st.text("abcdéÉİ, \x00漢", max_size=5000), min_size=1, max_size=5))
def test_tables_and_dictionaries_agree(passages, texts):
    model = {"x": passages, "y": passages[:1], "z": []}
    one, other = langid.CrossParser(model), langid.CrossParser(model, most_cells=0)
    assert one.table is not None and other.table is None
    for a, b in zip(one.costs(texts), other.costs(texts)):
        assert (a == b).all()


def test_held_out_accuracy(spark, docs):
    model = langid.training_sample(langid.trainable(docs))
    rows = langid.identify(docs.select("doc_id", "text", F.col("lang").alias("true")), model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and sum(r["true"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_languages(spark, odd, none):
    model = {"en": ["one", "two", "words"], "de": ["eins", "zwei"]}
    rows = langid.identify(odd, model)
    assert set(rows.columns) == set(odd.columns) | {"lang_pred"}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows.collect()}
    assert got[2] == got[3] == got[4] == got[10] == ("und", 0.0) and got[8][0] == "en"
    assert langid.identify(none, model).collect() == [] and langid.training_sample(none) == {}
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(odd, langid.training_sample(odd)).collect()} <= {"en", "de", "fr", "und"}


def automaton_scores(texts, learn):
    """{id: (n_tokens, n_known, N, base, score)} of {id: tokens}, every n-gram counted by a dictionary."""
    grams = [Counter(tuple(texts[i][k : k + o]) for i in learn for k in range(len(texts[i]) - o + 1)) for o in (1, 2, 3)]
    one, two, three = grams
    n, v = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5

    def strength(states, counted):
        total = sum(counted.values())
        new = min(max(sum(c == 1 for c in counted.values()) / total, 0.001), 0.999) if total else 0.5
        return total / max(1, states) * new / (1 - new) or 1.0

    a, b = strength(len(one), two), strength(len(two), three)
    out = {}
    for i, w in texts.items():
        base = own = 0.0
        for k, x in enumerate(w):
            base += math.log10((one[x,] + 1) / (n + 1 * (v + 1)))
            p = (one[x,] - d) / n if one[x,] else (d * v / n if n else 1.0)
            if k > 0:
                p = (two[w[k - 1], x] + a * p) / (one[w[k - 1],] + a)
            if k > 1:
                p = (three[w[k - 2], w[k - 1], x] + b * p) / (two[w[k - 2], w[k - 1]] + b)
            own += math.log10(min(p, 1.0))
        out[i] = (len(w), sum(one[x,] > 0 for x in w), n, base, own)
    return out


def words_of(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def agree(row, want):
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == want[:3]
    assert abs(row["base_score"] - want[3]) <= 1e-9 * abs(want[3]) and abs(row["score"] - want[4]) <= 1e-9 * abs(want[4])


@pytest.mark.parametrize("shard,buckets", [(16 << 20, None), (20_000, 3)])
def test_scores_against_brute_force(docs, shard, buckets):
    rows = {r["doc_id"]: r for r in langmodel.score(docs, langmodel.trainable(F.col("doc_id")), buckets, shard).collect()}
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    want = automaton_scores(texts, learn)
    assert rows.keys() == want.keys() and all(rows[i]["held_out"] == (i not in learn) for i in rows)
    for i in rows:
        agree(rows[i], want[i])
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    """Of all continuations of a state, seen or not, unseen words being one of them."""
    texts = ["a b a c a b", "b a b", "", "c", "a a a b"]
    ends = ["", "a", "a b", "b a", "z a", "a z", "c c"]
    words = ["a", "b", "c", "z"]
    probes = [(e, w) for e in ends for w in [*words, None]]
    rows = [(k, t, True) for k, t in enumerate(texts)] + [(100 + k, " ".join(x for x in [*e.split(), w] if x), False) for k, (e, w) in enumerate(probes)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in langmodel.score(frame, F.col("learn")).collect()}
    model = automaton_scores({i: words_of(t) for i, t, _ in rows}, {i for i, _, l in rows if l})
    for i in got:
        assert abs(got[i] - model[i][4]) < 1e-9
    # P(state, w, end) over w and the end itself, divided by the end after w, must give P(state)
    one = automaton_scores({("p", e, w): [*e.split(), *([w] if w else [None])] for e, w in probes} | {("s", e): e.split() for e in ends} | {i: words_of(t) for i, t, l in rows if l}, {i for i, _, l in rows if l})
    for e in ends:
        total = sum(10 ** one["p", e, w][4] for w in [*words, None])
        assert abs(total - 10 ** one["s", e][4]) < 1e-9


def test_odd_scores(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    table = spark.read.parquet(f"{tmp_path}/odd")
    rows = langmodel.score(table, langmodel.trainable(F.col("doc_id"))).collect()
    assert len(rows) == odd.count() and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [1] and [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    none.write.parquet(f"{tmp_path}/none")
    assert langmodel.score(spark.read.parquet(f"{tmp_path}/none"), langmodel.trainable(F.col("doc_id"))).collect() == []
    untrained = langmodel.score(table, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)
    for r in langmodel.score(spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, "a")], "doc_id long, text string"), F.lit(True)).collect():
        agree(r, automaton_scores({0: words_of("a b a"), 1: words_of("a b a"), 2: words_of("a")}, {0, 1, 2})[0 if r["doc_id"] == 1 else 2])
