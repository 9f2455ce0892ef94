"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Texts longer than a sequence are cut into whole sequences and a rest. A piece's text is the document's own, from its
first word up to the next piece's first word, with all white space as it stands (the first piece starts with the text,
the last ends with it), so a document's pieces join to its text. Pieces are dealt to shards by a hash of their document's
id, text and size, so rows without an id or with one id spread, too (only rows equal in all of these meet), and each shard is packed on its own, largest piece first. Open bins are kept in order of the room they have
left, and each carries two bitmaps: the sources and the duplicate clusters of its pieces. For a piece, the search starts
at the successor of its size, the bin with the least room that suffices, and goes on to the next bin while the bitmaps
show a conflict, until the tightest compatible bin is found; if there is none, a new bin is opened. So no bin holds two
pieces of one duplicate cluster, nor two of one source.

Edge cases: a null or empty text has no words and gets no piece; a null source is a source of its own; copies of a
text (white space and ASCII case aside) are one cluster; pieces of one text are one cluster, too; ties are broken by
document, then piece; repeated rows are packed each; an empty table gives an empty result. Other columns are ignored.
Memory: a shard holds some ``shard_rows`` pieces, with texts of a sequence each where they are asked for; a very long text is one
row until the JVM has cut it, so a task also needs room for its longest text.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, kept, text_of, word_count

CAPACITY = 2048
SHARD_ROWS = 4096
PACKED = "bin_id string, slot int, doc_id string, piece int, start long, n_words long, source string, cluster long, room long"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each piece (size, source, cluster), in the order given, and the room left in each bin.

    ``source`` and ``cluster`` are bit numbers; a negative one conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (room, bin)
    sources: list[int] = []
    clusters: list[int] = []
    room: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & s or clusters[b] & c):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(room)
            sources.append(0), clusters.append(0), room.append(capacity)
        sources[b] |= s
        clusters[b] |= c
        room[b] = left - size
        if room[b]:
            insort(order, (room[b], b))
        out.append(b)
    return out, room


def _piece_pattern(capacity: int) -> str:
    """A piece's words, each with the white space after it; the first piece also has what stands before its first word.

    All repeats are possessive: Java then loops over them, where it would recurse once a word otherwise.
    """
    space = r"[\x20\x09-\x0D]*+"
    return rf"((?:\A{space})?(?:{WORD}+{space}){{1,{capacity}}}+)"


def _packed(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        many = rows["cluster"].duplicated(keep=False)  # a cluster of one piece conflicts with nothing
        cluster = pd.factorize(rows["cluster"].where(many))[0]
        bins, room = best_fit(list(zip(rows["n_words"].tolist(), source.tolist(), cluster.tolist(), strict=True)), capacity)
        rows["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        rows["room"] = [room[b] for b in bins]
        rows["slot"] = rows.groupby("bin_id", sort=False).cumcount()
        return rows[[c for c in ("bin_id", "slot", "doc_id", "piece", "start", "n_words", "source", "cluster", "room", "text") if c in rows]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, with_text: bool = False) -> DataFrame:
    """Per piece: ``bin_id, slot, doc_id, piece, start, n_words, source, cluster, room`` (and ``text`` if asked for).

    ``start`` is the piece's first word in its document, ``room`` what its bin has left in the end.
    """
    plain = F.array_join(F.filter(F.split(ascii_lower(text_of()), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    sized = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("words"), F.xxhash64(plain).alias("cluster"), *([text_of().alias("text")] if with_text else []))
    sized = sized.filter("words > 0")
    sized = sized if with_text else kept(sized)
    n_pieces = sized.agg(F.coalesce(F.sum(F.ceil(F.col("words") / capacity)), F.lit(0)).alias("n")).first()["n"]  # groups hold pieces, not documents
    shards = max(1, -(-n_pieces // shard_rows))
    if with_text:
        texts = F.when(F.col("words") <= capacity, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(_piece_pattern(capacity))))
        pieces = sized.select(*[c for c in sized.columns if c != "text"], F.posexplode(texts).alias("piece", "text"))
    else:
        pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("words") / capacity).cast("int") - 1)))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "words"), F.lit(shards)).cast("int")).drop("words")
    out = pieces.groupBy("shard").applyInPandas(_packed(capacity), PACKED + (", text string" if with_text else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))  # a string inside, as pandas would make null ids floats
