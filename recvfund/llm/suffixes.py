"""Suffix-array dedup: every byte that a long string covers which also starts elsewhere is removed.

What could repeat is found first. Each window of ``LENGTH`` bytes has an anchor, the ``GRAM`` bytes in it whose hash is
least; equal windows have equal anchors. Neighbouring windows with one anchor are a run, some hundred of them; runs are
dealt by anchor, so all windows that could be equal meet, and text whose anchors are unique goes no further. Runs with
the same bytes repeat whole. Where an anchor has runs with different bytes, one of each goes to a shard, and the shard's
suffix array decides: suffixes are sorted by Larsson-Sadakane refinement (ranks by 8 bytes, then by doubling, only
groups that are still unsorted), common prefixes come from Kasai's walk over all lanes of the text at once, and windows
with a neighbour of ``LENGTH`` common bytes repeat. An anchor with too many runs for one shard is split into parts, each
with a suffix array of its own; parts are merged by binary search of each one's windows in the others' arrays.

Edge cases: a null text is empty; a text shorter than ``LENGTH`` keeps all its bytes, whatever repeats; matches never
cross documents and overlaps count, also within one text; repeated rows repeat each other, so they lose every byte that
a window covers; an empty table gives an empty result. Rows are told apart by 64 bits of hash and their length. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import stored, text_of

LENGTH = 400
GRAM = 128  # 8 times a power of 4
SEGMENT = 1 << 20  # windows of a text that are read at once
SHARD_BYTES, PART_BYTES = 2 << 20, 1 << 20
LANES = 4096
_PLACE = 24  # low bits of a key that hold a place


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on: words of 8 bytes are mixed, then the mixes of four."""
    n, step = len(raw), 8
    parts = np.ndarray((n - 7,), "<u8", raw, 0, (1,))
    while step < GRAM:
        n = len(raw) - 4 * step + 1
        h = np.zeros(n, np.uint64)
        for k in range(0, 4 * step, step):
            h += parts[k : k + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        parts, step = h, 4 * step
    return parts


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its least one (by the top bits), the leftmost of equal ones."""
    keys = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - width + 1
    pad = -len(h) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def runs_of(raw: bytes, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one anchor: (anchor hash, first window, last window, whether the anchor recurs within)."""
    out = []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        part = raw[at : at + SEGMENT + length - 1]
        h = gram_hashes(part)
        place = least_places(h, length - GRAM + 1)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        value = h[place[first]]
        new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        many = np.diff(np.append(new, len(value))) > 1
        lo = first[new]
        hi = np.append(lo[1:], len(place)) - 1
        out.append((value[new].view(np.int64), lo + at, hi + at, many))
    return out


RUNS = "m long, c long, doc_id string, h long, n long, lo long, hi long, many boolean"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, h, text in zip(pdf["doc_id"][at : at + 500], pdf["h"][at : at + 500], pdf["text"][at : at + 500], strict=True):
                raw = text.encode("utf-8", "replace")
                for m, lo, hi, many in runs_of(raw):
                    c = np.fromiter((xxh3_64_intdigest(raw[a : b + LENGTH]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo)).view(np.int64)
                    for col, v in zip(cols, (m, c, np.full(len(m), doc_id, object), np.full(len(m), h), np.full(len(m), len(raw)), lo, hi, many), strict=True):
                        col.append(v)
            if cols[0]:
                names = ("m", "c", "doc_id", "h", "n", "lo", "hi", "many")
                yield pd.DataFrame({k: np.concatenate(v) for k, v in zip(names, cols, strict=True)})


def suffix_array(text: bytes) -> np.ndarray:
    """The places of ``text``, sorted by the bytes from each on.

    Sorted to the end, not just to ``LENGTH``: Kasai's walk needs that the order of places also holds for their next ones.
    """
    n = len(text)
    first = np.ndarray((n,), ">u8", text + bytes(8), 0, (1,)).astype(np.uint64)
    sa = np.argsort(first, kind="stable")
    key = first[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is its first slot
    rank[sa] = group
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # slots of unsorted groups
    h = 8
    while len(slots):  # ranks by h bytes at i and at i + h give ranks by 2h
        at = sa[slots]
        far = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + far
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[at] = starts
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: bytes, sa: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each slot of the suffix array the bytes in common with the slot before, up to ``most``: Kasai's walk, in lanes.

    Along a lane the common prefix of place i + 1 is at least that of place i less one, so no byte is compared twice.
    """
    n = len(text)
    word = np.ndarray((n + most + 8,), "<u8", text + bytes(most + 16), 0, (1,))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    lanes = min(LANES, n)
    length = -(-n // lanes)
    start, h = np.arange(lanes) * length, np.zeros(lanes, np.int64)
    for t in range(length):
        i = start + t
        live = np.flatnonzero(i < n)
        live = live[before[i[live]] >= 0]
        h[i < n] = np.where(before[i[i < n]] >= 0, h[i < n], 0)
        todo = live
        while len(todo):
            a, b = i[todo], before[i[todo]]
            x = word[np.minimum(a + h[todo], n + most)] ^ word[np.minimum(b + h[todo], n + most)]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            h[todo] = np.minimum(h[todo] + same, np.minimum(most, n - np.maximum(a, b)))
            todo = todo[(same == 8) & (h[todo] < np.minimum(most, n - np.maximum(a, b)))]
        out[i[live]] = h[live]
        h = np.maximum(h - 1, 0)
    return out[sa]


def sorted_windows(contents: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All contents as one text; the starts of their windows in suffix order; whether each equals the one before; each start's content."""
    text = b"".join(contents)
    sizes = np.array([len(c) for c in contents], np.int64)
    owner = np.repeat(np.arange(len(contents)), sizes)
    ends = np.cumsum(sizes)
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, length)
    # equal windows are neighbours but for suffixes that start no window of their content; these are passed over
    group = np.cumsum(lcp < length)
    valid = sa + length <= ends[owner[sa]]
    starts, group = sa[valid], group[valid]
    return text, starts, np.concatenate([[False], group[1:] == group[:-1]])[: len(starts)], owner[starts]


def repeated(equal: np.ndarray) -> np.ndarray:
    """Which windows have an equal one, from whether each equals the one before."""
    return equal | np.append(equal[1:], False) if len(equal) else equal


def _cover(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that windows at ``offsets`` cover, as maximal runs."""
    at = np.unique(offsets)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist(), strict=True))


FOUND = "h long, n long, start long, end long, m long, part int, blob binary"


def _spans(rows: pd.DataFrame, starts: np.ndarray, owner: np.ndarray, dup: np.ndarray, length: int) -> list[tuple]:
    first = np.concatenate([[0], np.cumsum([len(b) for b in rows["bytes"]])])
    out = []
    hit = np.flatnonzero(dup)
    if not len(hit):
        return out
    hit = hit[np.argsort(owner[hit], kind="stable")]
    who, at = np.unique(owner[hit], return_index=True)
    for o, offsets in zip(who.tolist(), np.split(starts[hit], at[1:]), strict=True):
        r = rows.iloc[o]
        out += [(r["h"], r["n"], a + r["lo"], b + r["lo"], None, None, None) for a, b in _cover(offsets - first[o], length)]
    return out


def _frame(out: list[tuple]) -> pd.DataFrame:
    names = ("h", "n", "start", "end", "m", "part", "blob")
    cols = zip(*out, strict=True) if out else [()] * len(names)
    return pd.DataFrame({k: pd.Series(list(v), dtype="object" if k == "blob" else "Int64") for k, v in zip(names, cols, strict=True)})


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans of what repeats within the shard; of each part of a split anchor also its sorted windows."""
    rows = rows.drop_duplicates(["m", "c"]).reset_index(drop=True)
    _, starts, equal, owner = sorted_windows(rows["bytes"].tolist())
    out = _spans(rows, starts, owner, repeated(equal), LENGTH)
    for (m, part), own in rows[rows["parts"] > 1].groupby(["m", "part"]):
        own = own.reset_index(drop=True)
        text, starts, equal, owner = sorted_windows(own["bytes"].tolist())
        blob = io.BytesIO()
        np.savez(blob, text=np.frombuffer(text, np.uint8), starts=starts, equal=equal, owner=owner, h=own["h"].to_numpy(np.int64), n=own["n"].to_numpy(np.int64), lo=own["lo"].to_numpy(np.int64), size=own["bytes"].map(len).to_numpy(np.int64))
        out.append((None, None, None, None, m, part, blob.getvalue()))
    return _frame(out)


def found_in(text: bytes, windows: np.ndarray, other: bytes, sorted_starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """By binary search, the slot of ``sorted_starts`` (windows of ``other`` in order) equal to each window of ``text``, or -1."""
    a = np.ndarray((len(text),), ">u8", text + bytes(8), 0, (1,))
    b = np.ndarray((len(other),), ">u8", other + bytes(8), 0, (1,))
    chunks = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]

    def compare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sign, todo = np.zeros(len(x), np.int64), np.arange(len(x))
        for k in chunks:
            p, q = a[x[todo] + k], b[y[todo] + k]
            differ = p != q
            sign[todo[differ]] = np.where(p[differ] < q[differ], -1, 1)
            todo = todo[~differ]
            if not len(todo):
                break
        return sign

    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(sorted_starts), np.int64)
    while (open_ := low < high).any():
        i = np.flatnonzero(open_)
        mid = (low[i] + high[i]) // 2
        after = compare(windows[i], sorted_starts[mid]) > 0
        low[i] = np.where(after, mid + 1, low[i])
        high[i] = np.where(after, high[i], mid)
    inside = np.flatnonzero(low < len(sorted_starts))
    hit = compare(windows[inside], sorted_starts[low[inside]]) == 0
    out = np.full(len(windows), -1, np.int64)
    out[inside[hit]] = low[inside[hit]]
    return out


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of the windows that two parts of an anchor share."""
    for pdf in batches:
        for one, two in zip(pdf["blob"], pdf["other"], strict=True):
            out = []
            with np.load(io.BytesIO(one)) as x, np.load(io.BytesIO(two)) as y:
                x, y = dict(x), dict(y)
            heads = np.flatnonzero(~x["equal"])  # one of each group of equal windows
            slot = found_in(x["text"].tobytes(), x["starts"][heads], y["text"].tobytes(), y["starts"])
            for part, groups in ((x, np.flatnonzero(slot >= 0)), (y, np.cumsum(~y["equal"])[slot[slot >= 0]] - 1)):
                dup = np.isin(np.cumsum(~part["equal"]) - 1, groups)
                raw = part["text"].tobytes()
                ends = np.cumsum(part["size"])
                rows = pd.DataFrame({"h": part["h"], "n": part["n"], "lo": part["lo"], "bytes": [raw[e - s : e] for e, s in zip(ends, part["size"], strict=True)]})
                out += _spans(rows, part["starts"], part["owner"], dup, LENGTH)
            yield _frame(out)


def repeated_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``h, n, start, end``: for each text (by hash and bytes), stretches that repeat; they may overlap each other."""
    size = F.octet_length("text").cast("long")
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).filter(size >= LENGTH).withColumn("h", F.xxhash64("text"))
    runs = stored(texts.select("doc_id", "h", "text").mapInPandas(_runs, RUNS))
    anchors = runs.groupBy("m").agg(F.count(F.lit(1)).alias("all"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("many").alias("any_many")).filter("all > 1 or any_many")
    # written, so that the join's tasks hold nothing but the join and Spark can split a hot anchor's runs
    anchors = stored(anchors.select(F.col("m").alias("of_m"), ((F.col("all") > 1) & (F.col("c0") == F.col("c1"))).alias("whole")))
    near = stored(runs.join(anchors, F.col("m") == F.col("of_m")).drop("of_m"))
    whole = lambda df: df.select("h", "n", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    spans = whole(near.filter("whole"))
    mixed = near.filter("not whole")
    contents = stored(mixed.groupBy("m", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "h", "n", "lo", "hi")).alias("rep")).select("m", "c", "times", "rep.*"))
    again = contents.filter("times > 1").select(F.col("m").alias("of_m"), F.col("c").alias("of_c"))
    spans = spans.unionByName(whole(mixed.join(again, (F.col("m") == F.col("of_m")) & (F.col("c") == F.col("of_c")))))
    # one of each content goes to a shard; an anchor with too many is split into parts
    length = F.col("hi") - F.col("lo") + LENGTH
    total = contents.agg(F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()["b"]
    big = contents.groupBy("m").agg(F.ceil(F.sum(length) / part_bytes).cast("int").alias("parts")).filter("parts > 1").withColumnRenamed("m", "of_m")
    big = stored(big)  # few; a join with what is written is one that Spark can broadcast or split
    dealt = contents.join(big, F.col("m") == F.col("of_m"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("m", "part"), F.lit(max(1, -(-total // shard_bytes)))))
    dealt = dealt.select("m", "c", "times", F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h"), "n", "lo", "hi", "parts", "part", "shard")
    taken = texts.join(dealt, texts["doc_id"].eqNullSafe(dealt["of_doc"]) & (texts["h"] == dealt["of_h"]) & (F.octet_length("text") == F.col("n")))
    taken = taken.select("m", "c", "h", "n", "lo", "parts", "part", "shard", F.substring(F.col("text").cast("binary"), (F.col("lo") + 1).cast("int"), length.cast("int")).alias("bytes"))
    found = stored(taken.groupBy("shard").applyInPandas(_shard, FOUND))
    spans = spans.unionByName(found.filter("blob is null").select("h", "n", "start", "end"))
    parts = found.filter("blob is not null").select("m", "part", "blob")
    if parts.limit(1).count():
        other = parts.select(F.col("m").alias("of_m"), F.col("part").alias("of_part"), F.col("blob").alias("other"))
        pairs = parts.join(other, (F.col("m") == F.col("of_m")) & (F.col("part") < F.col("of_part"))).select("blob", "other")
        spans = spans.unionByName(pairs.mapInPandas(_merged, FOUND).select("h", "n", "start", "end"))
    return spans


DIGEST = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_share double, has_repeat boolean"


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
            raw = text.encode("utf-8", "replace")
            cut = merge_spans([(s["start"], s["end"]) for s in spans]) if spans is not None else []
            sha, at = hashlib.sha256(), 0
            for a, b in [*cut, (len(raw), len(raw))]:
                sha.update(raw[at:a])
                at = b
            removed = sum(b - a for a, b in cut)
            out.append((doc_id, len(raw), removed, len(cut), sha.hexdigest(), removed / max(1, len(raw)), removed > 0))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_share", "has_repeat"])


def suffix_dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of the bytes that stay; ``removed_share`` of its bytes, ``has_repeat``."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))  # pandas would make null ids floats
    size = F.octet_length("text").cast("long")
    short = texts.filter(size < LENGTH).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(0.0).alias("removed_share"), F.lit(False).alias("has_repeat"))
    spans = repeated_spans(docs, shard_bytes, part_bytes).groupBy("h", "n").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = stored(spans.select(F.col("h").alias("of_h"), F.col("n").alias("of_n"), "spans"))
    long = texts.filter(size >= LENGTH).withColumn("h", F.xxhash64("text"))
    long = long.join(spans, (F.col("h") == F.col("of_h")) & (size == F.col("of_n")), "left")
    out = long.select("doc_id", "text", "spans").mapInPandas(_digest, DIGEST).unionByName(short)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
