"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming check, connected groups.

A fingerprint's bits are cut into ``max_bits + 3`` blocks. Two fingerprints that differ in ``max_bits`` bits or fewer agree
on three blocks at least, so every close pair shares the key of one choice of three blocks, some 32 bits: that keeps
chance meetings rare at any size. Equal fingerprints are one class from the start. A key that more classes share than a
set size is split again by the same rule over the bits that it does not cover, which loses no close pair and ends, as a
key over all bits has one class. Within a key the classes are linked where the Hamming distance allows, and only a
spanning star of each linked group leaves the task, never all pairs.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; repeated shingles count each time; a bit set in exactly half of the hashes is 0;
repeated rows get the same result each; a component whose ids are all null has a null id; an empty table gives an empty
result. Other columns are ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free_names, kept, text_of
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET = 512  # classes that one key may hold before it is split again
ALL_BITS = (1 << 64) - 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # bytes split at ASCII white space
    if not words:
        return 0
    n, line = len(words) - shingle + 1, b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    set_in = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return F.pandas_udf(prints, "long")(text)


def _blocks(mask: int, n: int) -> list[int]:
    """The bits that ``mask`` does not cover, in ``n`` blocks."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cuts = [round(i * len(free) / n) for i in range(n + 1)]
    return [sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def first_masks(max_bits: int) -> list[int]:
    return [sum(c) for c in combinations(_blocks(0, max_bits + 3), 3)]


def finer_masks(mask: int, max_bits: int) -> list[int]:
    """Masks over one more block each: of ``max_bits + 1`` blocks one at least is free of differences."""
    return sorted({mask | b for b in _blocks(mask, max_bits + 1)} - {mask})


def linked(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A star (member, smallest) for each group of values linked by close pairs."""
    out, rest = [], np.sort(values)
    while len(rest):
        first, todo, rest = int(rest[0]), [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= max_bits
            if near.any():
                found = rest[near]
                out += [(int(v), first) for v in found]
                todo.extend(found)
                rest = rest[~near]
    return out


def _stars(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [e for values in pdf["prints"] for e in linked(np.asarray(values, np.int64), max_bits)]
            yield pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    return run


def close_links(classes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``x, y``: links that connect all distinct ``fp`` of ``classes`` whose Hamming distance allows."""
    masks = first_masks(max_bits)
    rows = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    links = None
    while masks:
        dealt = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).repartition("mask", "value")
        counts = dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        counts = counts.select(F.col("mask").alias("of_mask"), F.col("value").alias("of_value"), "n")
        shared = kept(dealt.join(counts, (F.col("mask") == F.col("of_mask")) & (F.col("value") == F.col("of_value"))).select("fp", "mask", "value", "n"))
        few = shared.filter(F.col("n") <= bucket).groupBy("mask", "value").agg(F.collect_list("fp").alias("prints"))
        found = few.select("prints").mapInPandas(_stars(max_bits), "x long, y long")
        links = found if links is None else links.unionByName(found)
        # the rest: over one more block each
        many = shared.filter(F.col("n") > bucket)
        masks = [m for m in {r["mask"] & ALL_BITS for r in many.select("mask").distinct().collect()} if m != ALL_BITS]  # masks, not documents
        if masks:
            finer = F.create_map(*[F.lit(x) for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in finer_masks(m, max_bits)]))])
            rows = many.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
    return links.distinct()


def _grouped(prints: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """``fp, first``: of each distinct fingerprint, the first ``who`` of its component."""
    classes = kept(prints.groupBy("fp").agg(F.min("who").alias("who")))
    labels = components(close_links(classes, max_bits, bucket))
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "who", F.coalesce("label", "fp").alias("label"))
    first = named.groupBy("label").agg(F.min("who").alias("first")).withColumnRenamed("label", "of")
    return kept(named.join(first, F.col("label") == F.col("of")).select(F.col("fp").alias("its_fp"), "first"))


def _who(*more: Column) -> Column:
    """Orders rows by id, null last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), *more)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over close pairs."""
    prints = kept(docs.select("doc_id", fingerprint_of(text_of(), shingle).alias("fp")))
    groups = _grouped(prints.select("fp", _who().alias("who")), max_bits, bucket)
    return prints.join(groups, F.col("fp") == F.col("its_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` that come first in their components (by id, then by content); one of each component stays."""
    a, b = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "text", "doc_id")  # 128 bits name a row
    prints = kept(docs.select("doc_id", a.alias("a"), b.alias("b"), fingerprint_of(text_of(), shingle).alias("fp")))
    groups = _grouped(prints.select("fp", _who(F.col("a"), F.col("b")).alias("who")), max_bits, bucket)
    name, nth, stay_row = free_names(docs.columns, "row", "row_nth", "stay_row")
    stay = groups.select(F.struct(F.col("first.a"), F.col("first.b")).alias(stay_row)).distinct()
    rows = docs.withColumn(name, F.struct(a.alias("a"), b.alias("b"))).join(stay, F.col(name) == F.col(stay_row))
    one = rows.withColumn(nth, F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0)))).filter(F.col(nth) == 1)  # of equal rows
    return one.select(*docs.columns)
