"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids are linked there.

A text, with a space before it, is encoded by a byte-level BPE (A) and, without it, by a sentencepiece model that adds
the space itself (B). The libraries' spans (character offsets of A; of B the spans of the immutable proto, which the installed
release gives as an offset mapping instead) are coarse cuts: they are exact where a token ends at a character's end, and
cover the whole character where a token holds only some of its bytes (split characters, byte-fallback pieces). Those are
refined by the bytes that each token decodes to. A text whose joined bytes differ from the input for A or B has no tokens. Ends that both have cut the tokens into groups; each pair of tokens
that end together is a link.

No merge of A or B crosses from a non-space to a space or line break, or from a letter to a full stop or comma, which is
checked on the vocabularies, so a text is cut there into segments; a segment is encoded once and looked up when it comes again, until the task has seen ``KEPT`` and starts anew. With vocabularies that
fail the check, texts are encoded whole. Linked ids are one another's suffixes in bytes, so the number of different pairs is bounded by
the vocabularies, whatever the corpus: the counts of pairs are summed by Spark and then held in each task.

Edge cases: null and empty texts, and those whose bytes differ, give zeros and an empty ``groups_sha256``; texts of white space only
are texts; null and repeated ids are rows as any other, each counts; an empty table gives an empty result. Special tokens' strings are
plain text. Other columns are ignored. The memory of a task grows with its longest text.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
KEPT, AT_ONCE = 3 << 18, 4096  # segments after which a task forgets all, and how many are encoded together
#: Where a text may be cut: before white space after another character (B adds no space to nothing, so a last space stays with
#: what is before), and between a Latin letter and a full stop or comma.
_CUT = re.compile(r"(?<=\S)(?=[ \n][\s\S])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,])")
_ACROSS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ][.,]|\n")  # what no piece of B may hold for that
BREAK = "\n"  # has no piece, so it merges with nothing


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def refined(coarse: np.ndarray, sizes: np.ndarray, partial: np.ndarray) -> np.ndarray:
    """Byte ends of consecutive tokens: the spans' ends, and for ``partial`` tokens, whose spans cover a character of which
    they hold some bytes, the last cut before plus the bytes decoded since. Spans that the bytes do not bear out
    (text changed before encoding) count for nothing."""
    reached = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(partial, -1, np.arange(len(sizes))))
    ends = np.where(last >= 0, coarse[last] + reached - reached[last], reached)
    return ends if np.array_equal(ends, reached) else reached


class Aligned(NamedTuple):
    """Segments' counts (no tokens of A: bytes differ), links as codes, one after the other, and groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    text: list[str]


@dataclass
class Tokenizers:
    """Both tokenizers from their files' bytes, with what each id decodes to."""

    a_json: bytes
    b_model: bytes
    rows: dict[str, int] = field(default_factory=dict)
    kept: list[Aligned] = field(default_factory=list)

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(self.a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        letters, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, t)) if letters.keys() >= set(t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, byte in zip(pieces, self.b_fallback, strict=True)]
        self.radix = len(pieces)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in v]) for v in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([[f"{i}{mark}" for mark in marks] for i in range(len(v))], object) for v, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        self.in_segments = self._parts_at_spaces(pieces)

    def _parts_at_spaces(self, pieces: list[str]) -> bool:
        """Whether nothing but byte-level splitting precedes A's merges, no piece of B holds a space after another character, and B adds a space and keeps the others."""
        spec = json.loads(self.a_json)
        level = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        if not plain or any(SPACE in p.lstrip(SPACE) or _ACROSS.search(p) for p in pieces):
            return False
        probe = "a  b. c,d" + BREAK + "e, " + BREAK + "f "
        parts = self._b_encoded(_CUT.split(" " + probe))
        return self.b.encode(probe, out_type=int) == [i for ids, _ in parts for i in ids]

    def _b_encoded(self, segments: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """B's ids and byte spans. The space that B adds is a segment's own first one; without one, a line break before the segment
        takes it, and both go again."""
        got = self.b.encode([s[1:] if s[0] == " " else BREAK + s for s in segments], return_type="offset_mapping", return_bytes=True, num_threads=1)
        return [(y["ids"], y["offsets"]) if s[0] == " " else (y["ids"][2:], y["offsets"][2:]) for s, y in zip(segments, got, strict=True)]

    @property
    def codes(self) -> int:
        """All codes are smaller."""
        return len(self.a_bytes) * self.radix

    def segments(self, text: str) -> list[str]:
        """Parts of space + text that are encoded alike alone and in the text."""
        return _CUT.split(" " + text) if self.in_segments else [" " + text]

    def encoded(self, segments: list[str]) -> Aligned:
        """Alignments of segments."""
        a = self.a.encode_batch(segments, add_special_tokens=False)
        b_ids, b_spans = map(list, zip(*self._b_encoded(segments), strict=True))
        a_ids, a_spans, raw = [x.ids for x in a], [x.offsets for x in a], [s.encode() for s in segments]
        if self._same(raw, a_ids, b_ids):
            return self._aligned(segments, raw, a_ids, b_ids, a_spans, b_spans)
        same = [i for i in range(len(segments)) if self._same(raw[i : i + 1], a_ids[i : i + 1], b_ids[i : i + 1])]
        out = Aligned(*(np.zeros(len(segments), np.int64) for _ in range(3)), np.empty(0, np.int64), [""] * len(segments))
        if same:
            found = self._aligned(*([v[i] for i in same] for v in (segments, raw, a_ids, b_ids, a_spans, b_spans)))
            for to, of in zip(out[:3], found[:3], strict=True):
                to[same] = of
            for i, t in zip(same, found.text, strict=True):
                out.text[i] = t
            out = out._replace(links=found.links)
        return out

    def _same(self, raw: list[bytes], a_ids: list, b_ids: list) -> bool:
        """Whether the tokens of each segment join to it."""
        whole, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        for of, sizes, ids in ((self.a_bytes, self.a_sizes, a_ids), (self.b_bytes, self.b_sizes, b_ids)):
            flat = list(chain.from_iterable(ids))
            if b"".join(map(of.__getitem__, flat)) != whole:
                return False
            reached = np.append(0, np.cumsum(sizes[flat])) if flat else np.zeros(1, np.int64)
            if not np.array_equal(reached[np.cumsum([len(x) for x in ids])], ends):
                return False
        return True

    def _aligned(self, segments: list[str], raw: list[bytes], a_ids: list, b_ids: list, a_spans: list, b_spans: list) -> Aligned:
        """All at once: byte positions count through the segments, laid end to end."""
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids, raw))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        flat = chain.from_iterable
        a_from, a_to = np.fromiter(flat(flat(a_spans)), np.int64, 2 * len(a)).reshape(-1, 2).T
        b_to = np.fromiter(flat(flat(b_spans)), np.int64, 2 * len(b))[1::2]
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])  # bytes before each character
        n = np.fromiter(map(len, segments), np.int64, len(segments))
        a_first, b_first = np.repeat(np.cumsum(n) - n, n_a), np.repeat(np.cumsum(size) - size, n_b)
        shared = np.append(a_from[1:] + a_first[1:] < a_to[:-1] + a_first[:-1], False)  # the next token holds a part of the same character
        a_ends = refined(chars[a_first + a_to], self.a_sizes[a], shared)
        moved = np.array([1 if s[0] == " " else -1 for s in segments])  # a space before that B added, or a break that is gone
        b_ends = refined(b_first + np.repeat(moved, n_b) + b_to, self.b_sizes[b], self.b_fallback[b])
        last_a = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True))
        last_b = np.searchsorted(b_ends, a_ends[last_a])
        # tokens of A and B in the order of the groups' text
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        a_group, b_group = np.searchsorted(last_a, at_a), np.searchsorted(last_b, at_b)
        text = np.empty(len(a) + len(b), object)
        text[at_a + np.concatenate([[0], last_b + 1])[a_group]] = self.a_text[a, (last_a[a_group] == at_a).astype(np.int8)]
        text[at_b + 1 + last_a[b_group]] = self.b_text[b, (last_b[b_group] == at_b).astype(np.int8)]
        text, to = text.tolist(), np.cumsum(n_a + n_b).tolist()
        groups = np.searchsorted(a_ends[last_a], np.cumsum(size), "right")
        return Aligned(n_a, n_b, np.diff(groups, prepend=0), a[last_a] * self.radix + b[last_b], ["".join(text[i:j]) for i, j in zip([0, *to], to)])  # noqa: B905

    def looked_up(self, segments: list[str]) -> tuple[np.ndarray, Aligned]:
        """The row of each segment, and all rows kept so far. Beyond ``KEPT`` rows, the next call starts anew."""
        if len(self.rows) > KEPT:
            self.rows, self.kept = {}, []
        new = [s for s in dict.fromkeys(segments) if s not in self.rows]
        self.kept += [self.encoded(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)]
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        if len(self.kept) > 1:
            self.kept = [Aligned(*(np.concatenate([getattr(k, c) for k in self.kept]) for c in Aligned._fields[:4]), [t for k in self.kept for t in k.text])]
        return np.fromiter(map(self.rows.__getitem__, segments), np.int64, len(segments)), self.kept[0]


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"
TEXTS_AT_ONCE = 4 << 20  # characters


def _aligner(a_json: bytes, b_model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects and no cycles among them
        t = Tokenizers(a_json, b_model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") <= TEXTS_AT_ONCE):
                    size += len(texts[b] or "")
                    b += 1
                yield _rows(t, ids.slice(a, b - a), texts[a:b])
                a = b

    return run


def _rows(t: Tokenizers, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    parts = [t.segments(x) if x else [] for x in texts]
    size = np.array([len(p) for p in parts])
    doc = np.repeat(np.arange(len(parts)), size)
    segments = list(chain.from_iterable(parts))
    rows, known = t.looked_up(segments) if segments else (doc, Aligned(*[np.empty(0, np.int64)] * 4, []))
    whole = (size > 0) & (np.bincount(doc, known.n_a[rows] == 0, len(parts)) == 0)
    counts = [np.where(whole, np.bincount(doc, n[rows], len(parts)), 0).astype(np.int64) for n in known[:3]]
    # the links of each document's segments, and how often each occurs in it
    n = np.where(whole[doc], known.n_groups[rows], 0)
    first = (np.cumsum(known.n_groups) - known.n_groups)[rows]
    links = known.links[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    keys, times = np.unique(np.repeat(doc, n) * t.codes + links, return_counts=True)
    at = pa.array(np.searchsorted(keys, np.arange(len(parts) + 1) * t.codes), pa.int32())
    lists = [pa.ListArray.from_arrays(at, v) for v in (pa.array(keys % t.codes), pa.array(times.astype(np.int32)))]
    text, rows, to = known.text, rows.tolist(), np.cumsum(size).tolist()
    groups = ["".join([text[r] for r in rows[j - n : j]])[:-1].encode() if ok else None for n, j, ok in zip(size.tolist(), to, whole, strict=True)]
    digests = pa.array(["" if g is None else hashlib.sha256(g).hexdigest() for g in groups], pa.string())
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, [*counts, counts[2]]), digests, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])


def tokenizer_files(folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[bytes, bytes]:
    """Both files' bytes, read once by the driver, so that executors need no such folder."""
    with open(f"{folder}/{a_file}", "rb") as a, open(f"{folder}/{b_file}", "rb") as b:
        return a.read(), b.read()


def alignments(docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """Per document its counts and groups, and its links as codes (A id times B's vocabulary, plus B id) with how often each occurs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_aligner(a_json, b_model), SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """``code, n``: how many links of the corpus hold each pair of ids."""
    each = links.select(F.inline(F.arrays_zip("codes", "times")))
    return each.groupBy(F.col("codes").alias("code")).agg(F.sum("times").alias("n"))


def align(docs: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    a_json, b_model = tokenizer_files(folder, a_file, b_file)
    links = stored(alignments(docs, a_json, b_model))
    radix = len(Tokenizers(a_json, b_model).b_bytes)
    counts: pd.DataFrame = pair_counts(links).toPandas().sort_values("code")  # bounded by the vocabularies
    code, n = counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    most = np.zeros(radix, np.int64)
    np.maximum.at(most, code % radix, n)
    best = n == most[code % radix]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column(6), batch.column(7)
            size = np.diff(lists.offsets.to_numpy())
            at = np.searchsorted(code, lists.flatten().to_numpy())
            k = times.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            sums = np.zeros((2, len(size)), np.int64)
            for out, v in zip(sums, (k * best[at], k * n[at]) if len(at) else (k, k), strict=True):
                np.add.at(out, row, v)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sums[0]), pa.array(sums[1]), batch.column(5)], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return links.mapInArrow(score, ", ".join(f"{c} {'string' if c == names[-1] else 'long'}" for c in names))
