"""Toxicity scores: a learned lexicon, misspellings by Levenshtein automata over its trie, and context windows.

The lexicon's terms are whole words and word beginnings (stems) that labelled toxic documents hold far more often than
the others; a sparse logistic regression on the labelled sample picks those that explain the labels, and each weighs by its log
likelihood ratio. They form a trie. A word is read by the trie and a Levenshtein automaton at once: a state is a set of (trie
node, edits so far), so one pass over the word finds every term within the edits that its length allows. States and
steps are made when first needed and kept. Misspelled forms have weights of their own, by their likelihood ratio. A hit's weight then depends on a window of words around it: quotation marks and
reporting words lower it, direct address raises it. The score is the logistic of the prior's logit and the hits' sum.

Edge cases: a null or empty text has no hits and scores the prior; without labelled rows of both kinds the lexicon is
empty and every score is the prior; repeated words in a text count once per term; repeated rows get the same score;
repeated labels of one id count once, toxic if any is; a label other than 0 and 1 counts as none; an empty table gives an empty result. Only text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, text_of

#: Bound of the labelled sample that is learned from; it also bounds the terms.
MAX_LABELLED = 20_000
STEMS = (4, 5, 6)
MIN_DOCS, MIN_RATIO, MIN_G2, SMOOTH = 2, 4.0, 8.0, 4.0  # of a candidate term
PENALTY, ROUNDS, LEAST_WEIGHT = 0.5, 400, 0.05  # of the regression that picks terms among the candidates
FUZZY = 0.6  # weight of a misspelled form of which nothing was learned
WINDOW = 6
QUOTED, REPORTED, ADDRESSED = 0.3, 0.6, 1.3
CACHE = 1 << 18
_EDGE = ".,;:!?\"'()[]{}<>*_~`|…“”„«»‘’%$&#+=-/\\"
#: Words that report speech, and words that address someone (fixed values).
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms phrase meaning".split())
ADDRESSING = frozenset("you your youre you're ya u du dich ihr tu toi vous tú usted".split())
_OPEN = tuple("\"“„«‘")
_CLOSE = tuple("\"”“»’")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Terms and stems with weights, as a trie, and the automaton over it that words are read by."""

    words: dict[str, float]
    stems: dict[str, float]
    forms: dict[tuple[str, int], float] = field(default_factory=dict)  # learned weights of (term, edits)

    def __post_init__(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for ends, terms in ((self.term, self.words), (self.stem, self.stems)):
            for t in terms:
                n = 0
                for c in t:
                    if c not in self.kids[n]:
                        self.kids[n][c] = len(self.kids)
                        self.kids.append({}), self.term.append(None), self.stem.append(None)
                    n = self.kids[n][c]
                ends[n] = t
        self.most = max(map(edits_allowed, self.words), default=0)
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.ends: list[list[tuple[str, int]]] = []
        self.stems_at: list[str | None] = []
        self.dead = self._state({})
        self.first = self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With what is reached by leaving out letters of a term. ``at``: node to fewest edits."""
        todo = list(at)
        while todo:
            n = todo.pop()
            if at[n] < self.most:
                for k in self.kids[n].values():
                    if at.get(k, 9) > at[n] + 1:
                        at[k] = at[n] + 1
                        todo.append(k)
        return at

    def _state(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append([(self.term[n], e) for n, e in key if self.term[n] and e <= edits_allowed(self.term[n])])
            whole = [self.stem[n] for n, e in key if e == 0 and self.stem[n]]
            self.stems_at.append(max(whole, key=self.stems.get) if whole else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for n, e in self.sets[state]:
            for letter, k in self.kids[n].items():
                cost = e + (letter != c)
                if cost <= self.most and at.get(k, 9) > cost:
                    at[k] = cost
            if e < self.most and at.get(n, 9) > e + 1:
                at[n] = e + 1
        self.steps[state][c] = to = self._state(self._closed(at))
        return to

    def read(self, word: str) -> list[tuple[str, int]]:
        """The (term, edits) that the word is within reach of, and the (stem, -1) that it begins with."""
        state, out = self.first, []
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                return out
            if self.stems_at[state]:
                out.append((self.stems_at[state], -1))
        return out + self.ends[state]

    def weight(self, term: str, edits: int) -> float:
        if (w := self.forms.get((term, edits))) is not None:
            return w
        return self.stems[term] if edits < 0 else self.words[term] * (FUZZY**edits)

    def best(self, word: str) -> tuple[str, int, float] | None:
        return max(((t, e, w) for t, e in self.read(word) if (w := self.weight(t, e)) > 0), key=lambda x: (x[2], -x[1], x[0]), default=None)


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(token: str) -> str:
    return token.strip(_EDGE)


def context(words: list[str], i: int) -> float:
    """What the window around word ``i`` makes of a hit there."""
    around = words[max(0, i - WINDOW) : i + WINDOW + 1]
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = any(w.startswith(_OPEN) for w in before)
    closed = any(w.rstrip(".,;:!?").endswith(_CLOSE) for w in after)
    plain = {bare(w) for w in around}
    factor = QUOTED if opened and closed else 1.0
    if plain & REPORTING:
        factor *= REPORTED
    if factor == 1.0 and plain & ADDRESSING:
        factor *= ADDRESSED
    return factor


def hit_sum(text: str, lexicon: Lexicon, cache: dict) -> float:
    """The hits' weights in their contexts; a term counts once, where its context weighs most."""
    words = tokens(text)
    found = {}
    for w in set(words):
        hit = cache.get(w, 0)
        if hit == 0:
            if len(cache) >= CACHE:
                cache.clear()
            hit = cache[w] = lexicon.best(bare(w))
        if hit:
            found[w] = hit
    if not found:
        return 0.0
    best: dict[str, float] = {}
    for i, w in enumerate(words):
        if w in found:
            term, _, weight = found[w]
            best[term] = max(best.get(term, 0.0), weight * context(words, i))
    return sum(best.values())


@dataclass
class Model:
    lexicon: Lexicon
    prior: float  # logit

    def score(self, text: str, cache: dict) -> float:
        z = self.prior + hit_sum(text, self.lexicon, cache)
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def features(text: str) -> set[tuple[str, int]]:
    """The words of a text (kind 0) and their beginnings (kind: their length)."""
    words = {bare(w) for w in set(tokens(text))} - {""}
    return {(w, 0) for w in words} | {(w[:k], k) for w in words for k in STEMS if len(w) > k}


def regression(rows: list, y: np.ndarray, n_terms: int) -> np.ndarray:
    """The weights (none negative) of a logistic regression with an L1 penalty, by proximal gradient steps.

    Each term's step is as long as its own frequency and the longest row allow, so the loss never rises.
    """
    lengths = np.array([len(r) for r in rows], np.int64)
    row, col = np.repeat(np.arange(len(rows)), lengths), np.fromiter((t for r in rows for t in r), np.int64, int(lengths.sum()))
    longest = int(lengths.max(initial=0)) + 1
    curve = 0.25 * longest * np.maximum(np.bincount(col, minlength=n_terms), 1)
    w, z, b = np.zeros(n_terms), np.zeros(n_terms), log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    t = 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, z[col], len(rows)), -30, 30)))
        new = np.maximum(0, z - (np.bincount(col, (p - y)[row], n_terms) + PENALTY) / curve)
        b -= float((p - y).sum()) / (0.25 * longest * len(y))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def ratio(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Log likelihood ratio, smoothed towards none."""
    base = (pos + neg + SMOOTH) / (n_pos + n_neg + SMOOTH)
    return log((pos + SMOOTH * base) / (n_pos + SMOOTH)) - log((neg + SMOOTH * (1 - base) * 0.5) / (n_neg + SMOOTH))


def _training(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``doc_id, toxic, text`` of up to ``max_labelled`` labelled documents that are not held out."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learned from the bounded sample; the driver sees the lexicon's counts only."""
    rows = kept(_training(docs, labels, max_labelled))
    sums = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n_neg = sums["p"], sums["n"] - sums["p"]
    prior = log((n_pos + 0.5) / (n_neg + 0.5)) if n_pos or n_neg else -2.0
    if not n_pos or not n_neg:
        return Model(Lexicon({}, {}), prior)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[tuple[str, int], list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                for t in features(text):
                    counts.setdefault(t, [0, 0])[toxic] += 1
            yield pd.DataFrame([(t, k, float(p), float(q)) for (t, k), (q, p) in counts.items()], columns=["term", "kind", "p", "q"])

    counts = rows.mapInPandas(terms, "term string, kind int, p double, q double").groupBy("term", "kind").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rate, base = (F.col("p") / n_pos) / ((F.col("q") + 0.5) / n_neg), n_pos / (n_pos + n_neg)
    n = F.col("p") + F.col("q")
    g2 = 2 * (F.col("p") * F.log(F.col("p") / (n * base)) + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / (n * (1 - base)))).otherwise(0.0))
    chosen = counts.filter(F.col("p") >= min(MIN_DOCS, n_pos)).filter(rate >= MIN_RATIO).withColumn("g2", g2).filter(F.col("g2") >= MIN_G2)
    chosen = sorted(chosen.select("term", "kind", "p", "q", "g2").collect(), key=lambda r: (-r["g2"], r["kind"], r["term"]))  # of a bounded sample
    number = {(r["term"], r["kind"]): i for i, r in enumerate(chosen)}

    def incidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(int(toxic), sorted(number[t] for t in features(text) if t in number)) for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True)]
            yield pd.DataFrame(out, columns=["toxic", "terms"])

    held = rows.mapInPandas(incidence, "toxic int, terms array<int>").toPandas()  # bounded: a row of term numbers a sampled document
    picked = regression(held["terms"].tolist(), held["toxic"].to_numpy(float), len(number)) > LEAST_WEIGHT
    kept_terms = {(r["term"], r["kind"]): v for r, ok in zip(chosen, picked, strict=True) if ok and (v := ratio(r["p"], r["q"], n_pos, n_neg)) > 0}
    draft = Lexicon({t: v for (t, k), v in kept_terms.items() if not k}, {t: v for (t, k), v in kept_terms.items() if k})

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, list] = {}
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                seen = set()
                for w in set(tokens(text)):
                    if w not in cache:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[w] = draft.read(bare(w))
                    seen.update(x for x in cache[w] if x[1] > 0)
                out += [(t, e, toxic) for t, e in seen]
            yield pd.DataFrame(out, columns=["term", "edits", "toxic"])

    near = rows.mapInPandas(forms, "term string, edits int, toxic int").groupBy("term", "edits").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).collect()
    learned = {(r["term"], r["edits"]): max(0.0, min(draft.words[r["term"]], ratio(r["p"], r["q"], n_pos, n_neg))) for r in near if r["q"] > 0 or r["p"] > 1}
    return Model(Lexicon(draft.words, draft.stems, learned), prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for texts in batches:
            yield pd.Series([model.score(t, cache) for t in texts], dtype="float64")

    s = F.pandas_udf(score, "double")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
