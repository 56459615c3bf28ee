import random
import re

import numpy as np
import pytest

from quern.llm import kernels, minhash
from quern.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """Components over ids of (id, text) rows; every pair is compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def cloud(seed, n=60, words=120, most=6):
    """Copies of one text with a few words changed, and copies of those: chains around the threshold."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    made = [base]
    for _ in range(n):
        w = list(r.choice(made) if r.random() < 0.4 else base)
        for _ in range(r.randrange(most)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [f"n{r.randrange(10**6)}"], [w[k], w[k]]])
        made.append(w)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("seed", [1, 2])
def test_clouds_against_brute_force(spark, seed):
    texts = cloud(seed) + cloud(seed + 10, 30, 40) + [f"t{k % 9} u v" for k in range(20)]
    random.Random(seed).shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == brute(rows)


def test_odd_rows(odd, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == odd.count() and by[5][2] == 1 and not by[5][3] and by[8][2] == 7
    assert by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True) and by[4][1:] == (0, 4, True)
    assert by[None][2] is None and by[None][3]
    assert minhash.near_duplicates(none).collect() == []


def test_ids_with_two_texts_join_classes(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


def test_densified_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    for n in (3, 30, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], r.integers(0, 1 << 63, n - int(0.9 * n), dtype=np.uint64) * np.uint64(2)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (minhash.sketch(np.sort(kernels.mix(s)), 1800) for s in (a, b))
        assert abs((x == y).mean() - true) < 0.25 if n < 100 else abs((x == y).mean() - true) < 0.05


def test_words_do_not_depend_on_blocks():
    text = b"ab  cd\t" * 50 + b"x" * 300 + b"\n yz"
    whole, at = kernels.words(text)
    small, at_small = kernels.words(text, block=16)
    assert (whole == small).all() and (at == at_small).all() and len(whole) == len(text.split())


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(k, k + 1) for k in range(40)], [(9, k) for k in range(20)] + [(100, 101)]])
def test_components(spark, edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def test_linked_member_that_differs_more(spark):
    """Of centre 1, member 2 (linked) differs by 170 and 3 (not linked) by 169; 2 and 3 are linked."""
    for salt in range(100):
        base, more = [f"b{salt}x{k}" for k in range(1000)], [f"m{salt}x{k}" for k in range(170)]
        least = min(base + more, key=lambda w: int(kernels.shingle_sets([w.encode()], 1)[0][0]))
        if least in base[69:]:
            break
    rows = [(1, base), (2, base + more), (3, base[69:] + more[:100])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = minhash.near_duplicates(docs, bands=1, rows=1, width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1}
