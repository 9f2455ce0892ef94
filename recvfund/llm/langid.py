"""Language ID by prediction by partial matching: one variable-order byte context tree per language.

A tree holds, for each context of up to ``ORDER`` bytes that its language's sample shows ``MIN_SEEN`` times or more, how
often each byte follows. A byte is coded in the longest such context; a byte not seen there costs an escape (method C: as
likely as the context has distinct followers) and is coded one byte shorter, bytes already ruled out left out, down to equal shares of the
bytes that the language never shows. A context's bytes also follow its suffix, so what is ruled out depends on the
context alone: with statistics frozen, every (context, byte) has one exact code length and one next context. Both go
into tables, and a text's code length is a walk. Texts are walked side by side in stretches; a stretch finds its context
from the ``ORDER`` bytes before it, so every byte of every text counts at its exact cost. A language's own code, by its share of
the labelled documents, comes on top. Digits are coded alike. The shortest code wins; the score is its posterior.

The trees learn from a bounded sample: passages of ``PASSAGE`` characters, by hash, some ``MAX_BYTES`` bytes a language in
expectation (all, if there are fewer); equal texts count once. A table holds contexts times bytes in use, 8 bytes each; both are
bounded by the sample, whatever the corpus.

Edge cases: a null text or one without a letter gives ``und`` and score 0, so does every text if nothing can be learned;
an empty table gives an empty result; null and repeated ids are rows as any other; ties go to the smaller language
value; a language is any non-null value, the empty one too. Only texts, and for learning ``lang``, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import held_out

ORDER = 5
MIN_SEEN = 32
MAX_BYTES = 1 << 20
PASSAGE = 2048
STRETCH = 1024
CHUNK_BYTES = 8 << 20
UNDETERMINED = "und"
#: Digits tell no language: all are coded as the digit 0.
FOLD = bytes(48 if 48 <= b < 58 else b for b in range(256))
DRAWS = 1 << 30


def encoded(text: str) -> bytes:
    return text.encode().translate(FOLD)


class Tree:
    """One language's frozen tables. ``next`` and ``cost`` are read at state + symbol; a state is its row times the row length."""

    def __init__(self, nodes: list[tuple[int, int, list[int], list[int]]], symbol: np.ndarray):
        """``nodes``: (order, context bytes as a number, following bytes, their counts); ``symbol``: of each byte, the last for unseen ones."""
        width = int(symbol.max()) + 1
        nodes = sorted(nodes)
        rows = {(k, c): i for i, (k, c, _, _) in enumerate(nodes)}
        count = np.zeros((len(nodes), width))
        for i, (_, _, followers, n) in enumerate(nodes):
            count[i, symbol[followers]] = n
        order = np.array([k for k, *_ in nodes])
        suffix = np.array([rows[k - 1, c & ((1 << 8 * (k - 1)) - 1)] if k else 0 for k, c, _, _ in nodes])
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            fresh = max(1, 256 - int(kinds[0, 0]))
            after = np.zeros_like(count)  # cost of a byte once the row's context has been escaped from
            after[0] = np.log2(fresh)
            for k in range(1, int(order.max()) + 1):
                at = np.flatnonzero(order == k)
                up = suffix[at]
                rest = np.where(count[at] > 0, 0, count[up])
                t, d = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
                after[at] = np.where(rest > 0, np.log2((t + d) / rest), np.where(t > 0, np.log2((t + d) / d), 0) + after[up])
            cost = np.where(count > 0, np.log2((total + kinds) / count), np.log2((total + kinds) / kinds) + after)
        step = np.zeros((len(nodes), width), np.int64)
        children: dict[int, list[tuple[int, int]]] = {}
        for (k, c), i in rows.items():
            if k:
                children.setdefault(rows[k - 1, c >> 8], []).append((int(symbol[c & 255]), i))
        for i in range(len(nodes)):  # suffixes come first
            if i:
                step[i] = step[suffix[i]]
            for s, child in children.get(i, ()):
                step[i, s] = child
        self.cost = cost.astype(np.float32).ravel()
        self.next = (step * width).astype(np.int32 if step.size < 1 << 31 else np.int64).ravel()


class Model:
    def __init__(self, trees: dict[str, list], share: dict[str, float]):
        """``trees``: each language's nodes; ``share``: its part of the labelled documents."""
        self.langs = sorted(trees)
        self.nodes, self.share = trees, share
        seen = sorted({b for nodes in trees.values() for k, _, followers, _ in nodes if not k for b in followers})
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        self.tables: list[Tree] | None = None  # made where they are used

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        if self.tables is None:
            self.tables = [Tree(self.nodes[g], self.symbol) for g in self.langs]
        out = np.tile([-np.log2(self.share[g]) for g in self.langs], (len(texts), 1))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK_BYTES):
                size += len(texts[b])
                b += 1
            out[a:b] += self._walked(texts[a:b])
            a = b
        return out

    def _walked(self, texts: list[bytes]) -> np.ndarray:
        code = self.symbol[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        parts = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, left = first[doc] + nth * STRETCH, np.minimum(STRETCH, size[doc] - nth * STRETCH)
        by = np.argsort(-left, kind="stable")
        start, left, doc, inner = start[by], left[by], doc[by], nth[by] > 0
        active = np.searchsorted(-left, -np.arange(STRETCH), "left")  # stretches with more than t bytes
        out = np.zeros((len(texts), len(self.langs)))
        for j, tree in enumerate(self.tables):
            state = np.zeros(len(doc), tree.next.dtype)
            warm = np.flatnonzero(inner)
            at = np.zeros(len(warm), tree.next.dtype)
            for t in range(-ORDER, 0):
                at = tree.next.take(at + code.take(start[warm] + t))
            state[warm] = at
            bits = np.zeros(len(doc))
            for t in range(STRETCH):
                n = int(active[t])
                if not n:
                    break
                i = state[:n] + code.take(start[:n] + t)
                bits[:n] += tree.cost.take(i)
                state[:n] = tree.next.take(i)
            out[:, j] = np.bincount(doc, bits, len(texts))
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bits = self.lengths(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return [self.langs[i] for i in best], posterior.tolist()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, rows in pdf.groupby("lang"):
            parts = []
            texts = [np.frombuffer(encoded(t), np.uint8).astype(np.int64) for t in rows["passage"]]
            for k in range(ORDER + 1):
                keys = []
                for b in texts:
                    if len(b) > k:
                        key = b[k:].copy()
                        for j in range(1, k + 1):
                            key |= b[k - j : len(b) - j] << 8 * j
                        keys.append(key)
                if keys:
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    parts.append(pd.DataFrame({"lang": lang, "k": k, "context": key >> 8, "byte": (key & 255).astype(np.int32), "n": n}))
            if parts:
                yield pd.concat(parts)


def sample(docs: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, dict[str, float]]:
    """``lang, passage`` to learn from, and each language's share of the labelled documents that are not held out."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter("bytes > 0").collect()  # a row a language
    total = sum(r["n"] for r in sizes)
    if not sizes:
        return known.select("lang", F.col("text").alias("passage")).limit(0), {}
    limit = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(DRAWS, max(1, DRAWS * max_bytes // r["bytes"])))])
    h = F.xxhash64("lang", "text")
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PASSAGE).cast("int"))
    drawn = F.filter(numbers, lambda i: F.pmod(F.xxhash64(F.col("h"), i), F.lit(DRAWS)) < F.col("most"))
    at = known.filter("length(text) > 0").select("lang", "text", h.alias("h"), F.element_at(limit, F.col("lang")).alias("most")).select("lang", "text", "h", F.explode(drawn).alias("i"))
    passages = at.select("lang", "h", "i", F.substring(F.col("text"), F.col("i") * PASSAGE + 1, F.lit(PASSAGE)).alias("passage"))
    return passages.groupBy("lang", "h", "i").agg(F.min("passage").alias("passage")).select("lang", "passage"), {r["lang"]: r["n"] / total for r in sizes}


def fit(docs: DataFrame, max_bytes: int = MAX_BYTES) -> Model:
    """Counted on the executors; the driver gets the contexts that stay, of a bounded sample."""
    passages, share = sample(docs, max_bytes)
    counts = passages.mapInPandas(_counted, "lang string, k int, context long, byte int, n long").groupBy("lang", "k", "context", "byte").agg(F.sum("n").alias("n"))
    nodes = counts.groupBy("lang", "k", "context").agg(F.sum("n").alias("seen"), F.collect_list(F.struct("byte", "n")).alias("followers")).filter((F.col("k") == 0) | (F.col("seen") >= MIN_SEEN))
    nodes = nodes.select("lang", "k", "context", F.col("followers.byte").alias("bytes"), F.col("followers.n").alias("counts"))
    trees: dict[str, list] = {}
    for r in nodes.toPandas().itertuples(index=False) if share else ():
        trees.setdefault(r.lang, []).append((int(r.k), int(r.context), np.asarray(r.bytes, np.int16), np.asarray(r.counts, np.int32)))
    return Model(trees, share)


def language_id(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs, max_bytes)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = model.predict([encoded(t) for t in texts])
            yield pd.DataFrame({"lang": lang, "score": score})

    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    said = F.pandas_udf(predict, "lang string, score double")(F.when(lettered, text).otherwise(F.lit("")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), lettered.alias("lettered"), said.alias("said"))
    return out.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("said.lang")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"), F.when(F.col("lettered"), F.col("said.score")).otherwise(F.lit(0.0)).alias("score"))
