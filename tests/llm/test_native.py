import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, fingerprints, licenses

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base(text):
    w, starts, labels = TOKEN.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_places(spark):
    r = random.Random(1)
    words = "cc by all rights reserved general public license the gnu version 3 mit nc Licensed under RIGHTS x é".split()
    texts = [" ".join(r.choice(words) + r.choice(["", ",", "-", "."]) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += ["", None, "cc by", "All rights reserved. " * 200, "Licensed under CC BY-NC 4.0.", "the mit license", "Released under the MIT License."]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows}
    assert got == {k: base(t) for k, t in enumerate(texts)}
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[304] == "cc-by,cc-by-nc" and labels[306] == "mit" and all(0 <= r["score"] <= 1 for r in rows)


def test_titles_at_the_start(spark):
    """A text that opens with a licence's title, before which a template has words of its own."""
    titles = {"GNU General Public License version 2, June 1991": "gpl,gpl-2.0", "Apache License Version 2.0, January 2004": "apache-2.0",
              "GNU Lesser General Public License": "gpl,lgpl", "Mozilla Public License v. 2.0": "mpl-2.0"}
    frame = spark.createDataFrame(list(enumerate(titles)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(frame).collect()}
    assert got == dict(enumerate(titles.values()))


def test_rare_words_decide_what_is_read(spark):
    """Common key words alone bring no alignment; looking up all key words reads more and finds the same."""
    common = "the software is provided in source and binary public files with license for use "
    texts = [common * 3 + f"x{k}" for k in range(200)]
    texts += ["Redistribution and use in source and binary forms, with or without modification, are permitted", "x " * 9 + "General Public License, version 3", common + "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = licenses.BASE + licenses.KNOWN
    base = licenses.hits(frame, sorted({w for t in templates for w, _, _ in t.postings()}))
    frequency = {r["w"]: r["n"] for r in base.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rare = licenses.alignments(base, templates, frequency).count()
    every = licenses.alignments(base, templates, None).count()
    assert rare <= 10 and every >= 2 * rare
    got = licenses.scan(frame).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, licenses.scan(frame, rarest=False).collect()))
    assert {r["doc_id"]: r["labels"] for r in got if r["labels"]} == {200: "bsd", 201: "gpl,gpl-3.0", 202: "zlib"}


def test_odd_licenses(odd, none):
    rows = licenses.scan(odd).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in rows) == sorted((r["doc_id"] or -1, base(r["text"])[0]) for r in odd.collect())
    assert licenses.scan(none).collect() == []


def told(rows):
    """(all turns, all assistant texts) of (turn, role, text) rows in the operator's order."""
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, (x[1] or "").encode(), (x[2] or "").encode()))
    return [(r or "", t or "") for _, r, t in rows], "".join(t or "" for _, r, t in rows if r == "assistant")


HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<</s><<SYS>>1", "", None, "a\nb" * 50, "😀 é", "<|im_<|im_end|>end|>", "\\", "x " * 3000]


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 16), (1, 0), (64, 64)])
def test_conversations_are_read_back(spark, budget, history):
    r = random.Random(budget)
    rows = []
    for c in range(40):
        for k in range(r.randrange(1, 9)):
            role = "system" if k == 0 and c % 3 == 0 else ["user", "assistant"][k % 2] if c % 5 else r.choice(["tool\nx", None, "assistant", "<s>"])
            rows.append((c if c else None, None if r.random() < 0.05 else k, role, r.choice(HARD)))
    rows += rows[:3]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history)
    got = {x["conv_id"]: ([tuple(t) for t in x["turns"]], x["loss_text"], x["formatted_chars"]) for x in chat.read_back(made).collect()}
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    assert {c: g[:2] for c, g in got.items()} == {c: told(v) for c, v in by.items()}
    sizes = defaultdict(int)
    for w in made.withColumn("n", F.length("text")).collect():
        sizes[w["conv_id"]] += w["n"]
        body = w["text"]
        assert body.count("<|im_start|>") == body.count("<|im_end|>\n") and "[INST]" not in body
        if w["window"] and any(x[1] == "system" and x[0] == 0 for x in by[w["conv_id"]]) and not any(x[0] is None for x in by[w["conv_id"]]):
            assert body.startswith("<|im_start|>system")
    assert {c: g[2] for c, g in got.items()} == dict(sizes)


def test_windows_keep_their_budget(spark):
    """Every window holds the system turn, at most `history` tokens of repeats and, but for one long turn, fits the budget."""
    r = random.Random(5)
    rows = []
    for c in range(60):
        for k in range(r.randrange(1, 60)):
            rows.append((c, k, "system" if k == 0 and c % 2 else ["user", "assistant"][k % 2], "w " * r.choice([0, 1, 5, 30, 60, 200])))
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 128, 32)
    for w in made.collect():
        parts = w["text"].split(chat.CLOSE)[:-1]
        sizes = [p.split("\n", 1)[1].count("w") + 4 for p in parts]
        system = sizes[0] if parts[0].startswith("<|im_start|>system") else 0
        assert bool(system) == bool(w["conv_id"] % 2)
        repeats = sizes[1 if system else 0 : w["context"]] if w["window"] else []
        assert sum(repeats) <= 32 and (sum(sizes) <= 128 or system + sum(repeats) + max(sizes) >= 128 or len(sizes) - w["context"] == 1)


def test_long_conversations(spark):
    """Ten thousand turns of one conversation, read back whole."""
    turns = spark.range(10_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, repeat(' word', 60)) AS text")
    row = chat.read_back(chat.windows(turns)).collect()[0]
    want = [(["user", "assistant"][k % 2], f"turn {k}" + " word" * 60) for k in range(10_000)]
    assert [tuple(t) for t in row["turns"]] == want and row["loss_text"] == "".join(t for r, t in want if r == "assistant")


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, window int")
    assert chat.read_back(chat.windows(empty)).collect() == []


def edited(rows):
    """(n, sha256) per row in the operator's order: id, then a hash of the text, for distinct ids."""
    rows = sorted(rows, reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        other, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows_a_bucket", [10, 4000])
def test_edits(docs, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows_a_bucket)
    rows = fingerprints.edits(docs).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == edited([(r["doc_id"], r["text"]) for r in docs.collect()])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        assert by.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(by.values())) == len(by)
    assert sum(r["near_edited"] for r in rows) > 5 * sum(r["near_next"] for r in rows)


def test_edit_is_located(spark):
    rows = spark.createDataFrame([("a\nb c. d\ne", "a\nb x. d\ne")], "p string, q string")
    both = fingerprints.with_tree(fingerprints.with_tree(rows, "p", "a"), "q", "b")
    assert fingerprints.differing_paragraphs(both, "a", "b", "odd").first()["odd"] == [1]


def root(text):
    """The format by hand."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, run = [], ""
    for p in re.findall(r"[^\n]*\n|[^\n]+", text):
        d = sha("".join(sha(c) for c in re.findall(r"[^.,;:!?]{1,240}[.,;:!?]*|[.,;:!?]+", p)))
        run += d
        if d[0] in "08":
            sections, run = [*sections, sha(run)], ""
        else:
            run += ","
    sections += [sha(run)] if run else []
    return sha("".join(sections)) + "/" + "".join(s[:16] for s in sections)


def test_different_texts_have_different_roots(spark):
    """White space, marks and line ends of all kinds: equal fingerprints only for equal texts."""
    r = random.Random(4)
    texts = {"", " ", "  ", "\n", "\n\n", "Aa.  Bb. Cc", "Aa. Bb.  Cc", "Aa. Bb", "Aa.\tBb", "Aa.\n Bb", "Aa.\r\nBb", "a" * 240, "a" * 241, "a" * 480, "ab,", "ab", ",ab"}
    texts |= {"".join(r.choice("ab .,\n\t;é") for _ in range(r.randrange(14))) for _ in range(3000)}
    texts |= {"".join(r.choice("ab\n.") for _ in range(r.randrange(300))) for _ in range(100)}
    made = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    got = {x["t"]: x["f"] for x in fingerprints.with_tree(made, "t", "x").select("t", fingerprints.fingerprint("x").alias("f")).collect()}
    assert got == {t: root(t) for t in texts} and len({f[:64] for f in got.values()}) == len(texts)


def test_long_paragraphs_take_linear_time(spark):
    """A paragraph of 6,000 clauses takes about as long as the same clauses in many lines, and all are counted."""
    def took(mark):
        texts = ["".join(f"{side}{k}{mark}" for k in range(6_000)) for side in "xy"]
        made = spark.createDataFrame([tuple(texts)], "p string, q string").repartition(1)
        both = fingerprints.with_likeness(fingerprints.with_tree(fingerprints.with_tree(made, "p", "a"), "q", "b"), "a", "b", "near")
        start = time.perf_counter()
        assert both.select("a_leaves", "b_leaves", "near").first() == (6_000, 6_000, 0.0)
        return time.perf_counter() - start

    took("\n")  # compiles
    lines, paragraph = min(took("\n") for _ in range(2)), min(took(",") for _ in range(2))
    assert paragraph < 4 * lines + 2


def test_hot_ids_are_dealt_in_order(spark, monkeypatch):
    """A third of the rows with one id, nulls too: buckets rise with id and hash, and neighbours are whom sorting finds."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    monkeypatch.setattr(fingerprints, "MOST_BOUNDS", 12)
    rows = [(7 if k % 3 == 0 else None if k % 20 == 1 else k * k, f"text {k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = [(x["doc_id"], x["h"], x["bucket"]) for x in fingerprints._bucketed(frame)[0].collect()]
    order = sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    buckets = [b for _, _, b in order]
    assert buckets == sorted(buckets) and len({b for i, _, b in made if i == 7}) > 3 and len(set(buckets)) > 12
    hashes = {x["text"]: x["h"] for x in fingerprints._bucketed(frame)[0].collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    want = {t: order[k - 1][1] for k, (_, t) in enumerate(order)}
    assert {x["text"]: x["next_text"] for x in fingerprints.with_next(frame).where("own = 1").collect()} == want


def test_odd_fingerprints(odd, none, spark):
    rows = fingerprints.edits(odd).collect()
    assert len(rows) == odd.count()
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 0}) == 1
    assert fingerprints.edits(none).collect() == []
    alone = fingerprints.edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
