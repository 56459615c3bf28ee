"""Language identification by cross-parsing entropy.

Each language's labelled sample, running text, becomes a suffix automaton.  A text is parsed from its first letter to
its last into phrases, each the longest that the automaton still recognises, across words; its cost in a language is
phrases * log2(sample size) / letters, the Ziv-Merhav estimate of cross entropy, and the language of least cost wins.
Texts and samples are lower-cased, and whatever isn't a letter is one blank.  A phrase also ends after every STRETCH
characters, so the stretches of many texts, long ones too, are walked together as arrays on one table of transitions.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_batches, crc_mod, worker_held

_OTHER = regex.compile(r"\P{L}+")
UNKNOWN = "und"
#: Characters after which a phrase ends at the latest.
STRETCH = 2048


class SuffixAutomaton:
    """Recognises every substring of the strings added."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.size = 0

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, child: int, symbol: str) -> int:
        """The state of child's strings that reach it through parent by one symbol."""
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = clone
        at = parent
        while at >= 0 and self.next[at].get(symbol) == child:
            self.next[at][symbol] = clone
            at = self.link[at]
        return clone

    def add(self, string: str) -> None:
        last = 0
        for symbol in string:
            known = self.next[last].get(symbol)
            if known is not None:
                last = self._split(last, known, symbol)
                continue
            fresh, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = fresh
                at = self.link[at]
            if at >= 0:
                self.link[fresh] = self._split(at, self.next[at][symbol], symbol)
            last = fresh
        self.size += len(string)

    def match_lengths(self, string: str) -> list[int]:
        """The lengths of the phrases of the greedy parse; a symbol never seen is a phrase by itself."""
        out, at, n = [], 0, 0
        for symbol in string:
            to = self.next[at].get(symbol)
            if to is None and n:
                out.append(n)
                n, to = 0, self.next[0].get(symbol)
            n += 1
            if to is None:
                out.append(n)
                n, to = 0, 0
            at = to
        return [*out, n] if n else out

    def linked(self) -> dict:
        """The start state as a dictionary from symbols to states of the same kind: the quickest form to walk."""
        states: list[dict] = [{} for _ in self.next]
        for state, edges in zip(states, self.next):
            state.update((symbol, states[to]) for symbol, to in edges.items())
        return states[0]


def phrase_count(start: dict, string: str) -> int:
    """How many phrases match_lengths() finds, on a linked automaton."""
    at, n = start, 0
    for symbol in string:
        to = at.get(symbol)
        if to is None:
            if at is not start:
                n += 1
                to = start.get(symbol)
            if to is None:
                n += 1
                to = start
        at = to
    return n + (at is not start)


def normalised(text: str) -> str:
    """Lower-case letters, a blank at both ends and for each run of anything else."""
    return _OTHER.sub(" ", f" {text.lower()} ")


class CrossParser:
    """Phrase counts of texts in all languages of a model {language: sample passages}."""

    def __init__(self, model: dict[str, list[str]], most_cells: int = 16_000_000) -> None:
        self.languages = sorted(model)
        automata = []
        for name in self.languages:
            automaton = SuffixAutomaton()
            for passage in model[name]:
                automaton.add(normalised(passage))
            automata.append(automaton)
        self.bits = np.array([math.log2(max(2, a.size)) for a in automata])
        alphabet = sorted({symbol for a in automata for symbol in a.next[0]} | {" "})
        cells = sum(len(a.next) for a in automata) * (len(alphabet) + 1)
        self.table, self.starts = None, []
        if cells <= most_cells:
            self._tabulate(automata, alphabet)
        else:  # a large alphabet: the same phrases, one text after the other
            self.starts = [a.linked() for a in automata]

    def _tabulate(self, automata: list[SuffixAutomaton], alphabet: list[str]) -> None:
        """One row per state, one cell per symbol: where it leads (a row's first cell) and the phrases that end with it."""
        width = len(alphabet) + 1  # blank first, letters that no sample has last
        code = {symbol: k for k, symbol in enumerate(alphabet)}
        self.code = np.fromiter((width - 1 if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint16, count=0x110000)
        self.code[[ord(symbol) for symbol in alphabet]] = np.arange(len(alphabet))
        rows = np.cumsum([0, *(len(a.next) for a in automata)])
        self.table = np.empty((rows[-1], width), dtype=np.int32)
        self.roots = (rows[:-1] * width).astype(np.int32)
        for automaton, first, root in zip(automata, rows.tolist(), self.roots.tolist()):
            begin = np.full(width, root + (1 << 28), dtype=np.int32)  # an unknown symbol is a phrase by itself
            for symbol, to in automaton.next[0].items():
                begin[code[symbol]] = (first + to) * width
            part = self.table[first : first + len(automaton.next)]
            part[:] = begin + (1 << 28)  # a phrase ends and another begins
            part[0] = begin
            edges = [(state, code[symbol], (first + to) * width) for state, e in enumerate(automaton.next) for symbol, to in e.items()]
            state, symbol, to = np.array(edges, dtype=np.int64).reshape(-1, 3).T
            part[state, symbol] = to
        self.table = self.table.reshape(-1)

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its cost in every language (a row per text)."""
        letters, phrases = self._walked(texts) if self.table is not None else self._one_by_one(texts)
        return letters, phrases * self.bits / np.maximum(1, letters)[:, None]

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bare = [normalised(t) for t in texts]
        letters = np.array([len(b) - b.count(" ") for b in bare], dtype=np.int64)
        counts = [[sum(phrase_count(s, b[k : k + STRETCH]) for k in range(0, len(b), STRETCH)) for s in self.starts] for b in bare]
        return letters, np.array(counts, dtype=np.int64).reshape(len(texts), len(self.starts))

    def _walked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lowered = [f" {t.lower()} " for t in texts]
        sizes = np.array([len(t) for t in lowered], dtype=np.int64)
        joined = "".join(lowered).encode("utf-32-le", "surrogatepass")
        symbols = self.code[np.frombuffer(joined, dtype="<u4")]
        blank = symbols == 0
        begins = np.cumsum(sizes) - sizes
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[begins] = True  # one blank at the start of each text, whatever ends the text before it
        sizes = np.add.reduceat(keep, begins, dtype=np.int64)
        letters = np.add.reduceat(~blank, begins, dtype=np.int64)
        symbols = symbols[keep]
        begins = np.cumsum(sizes) - sizes
        # stretches, the longest first, so that those still under way are the first ones
        many = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), many)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = begins[owner] + turn * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - turn * STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        left = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        at = np.repeat(self.roots[:, None], len(owner), axis=1)
        phrases = np.zeros(at.shape, dtype=np.int64)
        for step, n in enumerate(left.tolist()):
            moved = self.table.take(at[:, :n] + symbols[start[:n] + step])
            at[:, :n] = moved & ((1 << 28) - 1)
            phrases[:, :n] += moved >> 28
        phrases += at != self.roots[:, None]
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        np.add.at(out, owner, phrases.T)
        return letters, out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not texts or not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        letters, costs = self.costs([t or "" for t in texts])
        order = np.argsort(costs, axis=1, kind="stable")  # ties: the first language by name
        best = np.take_along_axis(costs, order[:, :1], axis=1)[:, 0]
        second = np.take_along_axis(costs, order[:, 1:2], axis=1)[:, 0] if len(self.languages) > 1 else np.full(len(texts), math.inf)
        score = np.where(second > 0, 1.0 - best / np.where(second > 0, second, 1.0), 0.0)
        return [(self.languages[k], float(x)) if n else (UNKNOWN, 0.0) for k, x, n in zip(order[:, 0], score, letters)]


def training_sample(
    docs: DataFrame, docs_per_language: int = 300, passages_per_language: int = 200, words: int = 40, longest: int = 1000
) -> dict[str, list[str]]:
    """{language: passages}, from at most so many labelled documents of each language and so many passages of them.

    A passage is a run of `words` words of a text, no longer than `longest`.  These numbers bound what the driver gets,
    whatever the input.  The documents of a language are those of least id hash, their passages those of least hash; a
    count per language and a threshold keep all but about twice as many documents from being ranked.
    """
    labelled = docs.where("doc_id is not null and lang is not null and text is not null")
    place = (F.xxhash64("doc_id").cast("double") / 2.0**64) + 0.5
    # one number per language comes to the driver; as literals they are applied in the scan, before any shuffle
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 2.0 * docs_per_language / n)])
    near = labelled.where(place < share[F.col("lang")])
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")))
    sample = ranked.where(F.col("r") <= docs_per_language)
    letters = sample.select("lang", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(words)), lambda i: F.array_join(F.slice("w", i, F.lit(words)), " "))
    passages = letters.select("lang", F.explode(runs).alias("passage")).where(F.length("passage") <= longest).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("passage"), "passage")
    best = passages.withColumn("r", F.row_number().over(order)).where(F.col("r") <= passages_per_language)
    model: dict[str, list[str]] = {}
    for lang, passage in best.orderBy("lang", "r").select("lang", "passage").collect():
        model.setdefault(lang, []).append(passage)
    return model


def _slices(texts: pd.Series, most: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters; a longer one is alone."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


def identify(docs: DataFrame, model: dict[str, list[str]]) -> DataFrame:
    """docs with lang_pred and score added (in place of columns so named); of the columns only text is read.

    lang_pred is `und` and score 0 for a null text, one without a letter, or an empty model.  score is how far the
    best cost lies below the second, as a share of the second: 0 for a tie, 1 with a single language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = "parser " + hashlib.sha256(repr(sorted(model.items())).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("lang_pred string, score double")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = worker_held(key, lambda: CrossParser(shared.value))
        for texts in batches:
            found: list[tuple[str, float]] = []
            for part in _slices(texts):
                found += parser.predict(part)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    arrow_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "quern_parse")]
    parsed = docs.select(*others, parse(F.col("text").cast("string")).alias("quern_parse"))
    return parsed.select(*others, "quern_parse.lang_pred", "quern_parse.score")


def trainable(docs: DataFrame, left_out: int = 2, of: int = 4) -> DataFrame:
    """The rows to learn from: those whose crc32(doc_id as text) modulo `of` isn't `left_out`."""
    return docs.where(crc_mod(F.col("doc_id"), of) != left_out)
