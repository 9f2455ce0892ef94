"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by that key: a source's key
space is cut into equal ranges, as many as its documents need, so that a source that holds a third of all rows is
dealt over as many ranges as its size asks for. Word counts are summed per place (key, id and size) and per range, and a
running sum over the (small) table of ranges tells the range that the source's budget ends in; a running sum inside that one gives
the place. The budget is cut at exactly that place; budgets above the source's size repeat the source in whole epochs.

Edge cases: a null text or one without words has size 0 and is never taken; a null source is a source of its own, last
in order; documents with one id and source are ordered by size; of rows with one id (or none) and one size at the
budget's end, as many are taken as it needs, whatever their number, and they are equal in all that is returned here
(``mixed`` numbers them as they were written, so reruns on the same files agree); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, kept, small, text_of, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_RANGE = 5000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: ``source, n_docs, source_size, target``.

    ``sizes``: ``source, size``. The sources, by code point with null last, weigh ``weights`` in turn and share the sum
    of all sizes. A target stops at ``max_epochs`` times its source's size; what that leaves over goes to the others by
    weight until none is above. In closed form: ordered by cap per weight, the capped sources are a prefix.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", max_epochs * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = (
        s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
    )
    # levels rise up to the first source that is below its cap; its level, the highest, holds for all from there on
    s = s.withColumn("open_level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
    return s.select("source", "n_docs", "source_size", F.least("cap", F.col("weight") * F.coalesce("open_level", F.col("ratio"))).alias("target"))


def _place(size: Column) -> Column:
    """Orders a source's documents: by a hash of the id, then id and size."""
    return F.struct(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), F.col("doc_id").alias("doc_id"), size.alias("size"))


def _budgets(sizes: DataFrame, weights: Sequence[int], max_epochs: int, rows_per_range: int) -> DataFrame:
    """A row a source: ``its_source, source_size, target, epochs``, and where its last, partial epoch ends: at the documents of
    place ``end`` (null: before the first), of whose words ``left`` are taken.

    ``sizes``: ``source, size, place``. Documents of one place are summed before they are ordered, so rows without an id or of
    one id are as many as they have sizes. Only the range that the budget ends in is put in order.
    """
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.select(
        F.col("source").alias("its_source"), "n_docs", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / rows_per_range)).cast("long").alias("n_ranges"),
    )
    targets = small(kept(targets.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))))  # a row a source
    share = F.conv(F.substring("place.key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    groups = sizes.filter("size > 0").groupBy("source", "place").agg(F.sum("size").alias("words"))
    groups = kept(groups.join(targets.select("its_source", "n_ranges", "rest"), F.col("source").eqNullSafe(F.col("its_source"))).withColumn("range", F.floor(share * F.col("n_ranges")).cast("long")).drop("its_source"))
    ranges = groups.groupBy("source", "range", "rest").agg(F.sum("words").alias("words"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = ranges.withColumn("start", start).filter("start < rest and rest <= start + words")
    reached = small(kept(reached.select(F.col("source").alias("of"), F.col("range").alias("its_range"), "start")))  # a row a source
    inside = Window.partitionBy("source", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = groups.join(reached, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("its_range")))
    last = last.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0))).filter("before < rest and rest <= before + words")
    ends = last.select("of", F.col("place").alias("end"), (F.col("rest") - F.col("before")).alias("left"))
    return small(kept(targets.join(ends, F.col("its_source").eqNullSafe(F.col("of")), "left").select("its_source", "source_size", "target", "epochs", "end", "left")))


def _numbered(rows: DataFrame, source: Column, name: str) -> DataFrame:
    """``rows`` of equal places with their number in their source, from 0, as ``name``: first inside each of the partitions that
    they were written in, then over the partitions' counts, so that many copies at a budget's end meet in no one task."""
    rows = kept(rows)
    part, at, of = free_names([*rows.columns, name], "part", "at", "of")
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(of, source)
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(of, part).orderBy(F.lit(0))) - 1)
    counts = rows.groupBy(of, part).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small(counts.select(F.col(of).alias("of_source"), F.col(part).alias("of_part"), earlier.alias("offset")))
    offsets = offsets.select(F.struct("of_source", "of_part", "offset").alias(at))
    out = rows.join(offsets, F.col(of).eqNullSafe(F.col(f"{at}.of_source")) & (F.col(part) == F.col(f"{at}.of_part")))
    return out.withColumn(name, F.col(name) + F.col(f"{at}.offset")).drop(part, of, at)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken`` (words taken, repeats counted).

    The words taken of a source add up to the whole number of words in its target. The last document of the last epoch
    is taken up to the budget's end.
    """
    sizes = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    sizes = kept(sizes.withColumn("place", _place(F.col("size"))))
    budgets = _budgets(sizes, weights, max_epochs, rows_per_range)
    rows = sizes.join(budgets, F.col("source").eqNullSafe(F.col("its_source")))
    at_end = F.coalesce(F.col("place") == F.col("end"), F.lit(False))
    ended = _numbered(rows.filter(at_end), F.col("source"), "nth").withColumn("last", F.least("size", F.greatest(F.lit(0), F.col("left") - F.col("nth") * F.col("size")))).drop("nth")
    others = rows.filter(~at_end).withColumn("last", F.when(F.col("place") < F.col("end"), F.col("size")).otherwise(0))
    return others.unionByName(ended).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("last")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken; a document at the budget's end stays whole.

    A source's budget ends at one place of its order, so each row is judged by itself and no text is shuffled. Of rows that
    share that place (one id and size), as many stay as the budget needs; the others come one time less.
    """
    sizes = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    budgets = _budgets(kept(sizes.select("source", "size", _place(F.col("size")).alias("place"))), weights, max_epochs, rows_per_range)
    name, nth = free_names(docs.columns, "cut", "nth")
    cuts = small(kept(budgets.select(F.struct("its_source", "epochs", "end", "left").alias(name))))
    cut = lambda field: F.col(f"{name}.{field}")
    rows = docs.join(cuts, docs["source"].eqNullSafe(cut("its_source")))
    size, here = word_count(text_of()), _place(F.lit(0))
    same_id = (here["key"] == cut("end.key")) & here["doc_id"].eqNullSafe(cut("end.doc_id"))  # first: counts no words
    at_end = F.coalesce(same_id & (size == cut("end.size")), F.lit(False))
    ended = _numbered(rows.filter(at_end), docs["source"], nth)
    ended = ended.withColumn(nth, cut("epochs") + (F.col(nth) * cut("end.size") < cut("left")).cast("long"))
    copies = F.when(size > 0, cut("epochs") + F.coalesce((_place(size) < cut("end")).cast("long"), F.lit(0))).otherwise(0)
    every = rows.filter(~at_end).withColumn(nth, copies).unionByName(ended)
    return every.withColumn(nth, F.explode(F.array_repeat(F.lit(True), F.col(nth).cast("int")))).select(*docs.columns)
