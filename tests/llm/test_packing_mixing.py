import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, ids, capacity=2048):
    """Every id in exactly one piece, gapless sequences; the share of padding."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for key, a in ids.items():
        want = sorted((s, n, zlib.crc32(a[s : s + n].tobytes())) for s, n, _ in ((r["start"], r["length"], 0) for r in by[key]))
        assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in by[key]) == want
        assert sum(r["length"] for r in by[key]) % len(a) == 0
    pad = 0
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_documents_are_packed_whole(docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids = {}
    for r in docs.collect():
        a = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], dtype="<u4")
        ids[r["doc_id"], len(a)] = a
    rows = packing.pack(docs, PATH).collect()
    assert checked(rows, ids) == 0
    assert rows == packing.pack(docs, PATH).collect()


def test_odd_rows(odd, none):
    rows = packing.pack(odd, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    total = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r["length"] for r in rows) == total
    assert [r for r in rows if r["doc_id"] == 2][0]["doc_tokens"] == 1
    assert packing.pack(none, PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), st.text(alphabet="aB'sßİŒ.,!<|endoftx>\x1c\x85\xa0 \n0é", max_size=40))
def test_cached_words_are_the_librarys(a, b):
    own = test_cached_words_are_the_librarys.__dict__.setdefault("own", packing.WordTokenizer(open(PATH, encoding="utf-8").read()))
    texts = [a, b, a + " " + b]
    assert [x.tolist() for x in own.ids(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_windows_fit_and_lose_nothing(lengths):
    parts = packing.windows_of(lengths, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in p) <= 100 for p in parts)


def test_differencing_is_near_equal():
    parts = packing.differenced([8, 7, 6, 5, 4], 2)
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts)
    assert sums == [14, 16]


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by giving out and taking back until none is above its height."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (left - sum(full.values())) / max(1, sum(w[s] for s in rest)) if rest else 0
        over = [s for s in rest if level * w[s] > most * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 50, "": 7}, {"a": 0, "b": 5}, {"x": 3}])
def test_targets(spark, sizes):
    rows = [(k, s, "w " * n) for k, (s, n) in enumerate(sizes.items())]
    sized = mixing.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = {r["skey"]: r["target"] for r in mixing.targets(sized, (5, 2, 1), 1.5, 2.0).collect()}
    want = {"" if s is None else f"={s}": t for s, t in water(sizes).items()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_of_documents(docs):
    rows = mixing.mix(docs).collect()
    source = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        by[source[r["doc_id"]][0]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    targets = water({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert abs(rs[0]["target"] - targets[s]) < 1e-6 * targets[s] and rs[0]["source_size"] == sum(r["size"] for r in rs)
        off = targets[s] - sum(r["taken"] for r in rs)
        whole = targets[s] >= rs[0]["source_size"]
        fits = [r for r in rs if 0 < r["size"] <= off - 1 and r["taken"] < (2 if whole or any(x["taken"] for x in rs) else 1) * r["size"]]
        assert -1 < off and (off <= 0.0006 * targets[s] + 1 or not fits)  # nothing more would fit
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in rows)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[2] == 0
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(none).collect() == [] and mixing.mixed_rows(none).collect() == []
