"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Three base kinds are found by pattern, leftmost first and without overlap within a kind: ``assign`` (a secret's name, a
sign and a value of 6 or more characters), ``access`` (access-key ids) and ``hex`` (long runs of hex digits). A match
that is too short is dropped after it has taken its place. The method adds the kind ``entropy``: a candidate is a run of
token characters; a window moves over it, and its Shannon entropy is kept by adding one character's count and taking
away another's. Each character class (digits and hex letters; letters and digits; letters, digits and signs) has its
own limit. A span is the union of a candidate's windows above the limit. Candidates on the allow list (words, paths,
dates, counters, identifiers written in one case) are passed over, and so is what lies within a base span.

Edge cases: a null or empty text has no spans; offsets are code points, the end is exclusive; very long texts and runs
cost time in proportion to their length; repeated rows give repeated rows; an empty table gives an empty result. Other
columns are passed by.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_of

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
MIN_VALUE = 6
WINDOW = 20
#: Bits a character that a window must reach, by class; the most that a window of 20 can have is 4.32.
LIMITS = {"hex": 3.0, "alnum": 3.6, "any": 3.8}
#: A word of an identifier or path (one case, capitalised or joined so), with up to four digits; each part is taken whole, so matching is linear.
_PART = r"(?:[A-Z]{2,}+|[A-Z]?[a-z]{2,}+|[a-z])++[0-9]{0,4}+"
#: Candidates that are no secrets: such words and paths of them, dates and counters, runs of signs, digests of content.
ALLOW = re.compile(rf"[/_=+-]*+{_PART}(?:[/_=+-]++{_PART})*+[/_=+-]*+|[0-9/_=+-]+|(?:sha(?:256|384|512))[-=].*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _limit(s: str) -> float:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return LIMITS["hex"]
    return LIMITS["alnum" if s.isalnum() else "any"]


_TERM = [0.0] + [n * log2(n) for n in range(1, WINDOW + 2)]  # a window has one character more while it moves


def entropy_spans(s: str, limit: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of the windows of ``s`` with an entropy of ``limit`` or more. H = log2(w) - sum(c log2 c) / w, kept by counts."""
    term = _TERM if width == WINDOW else [0.0] + [n * log2(n) for n in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    most = width * (log2(width) - limit) + 1e-9
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= width:
            gone = s[i - width]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
        if i >= width - 1 and total <= most:
            if out and out[-1][1] >= i - width + 1:
                out[-1][1] = i + 1
            else:
                out.append([i - width + 1, i + 1])
    return [(a, b) for a, b in out]


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All spans, base and entropy, by start and kind."""
    base = base_spans(text)
    more = []
    at, reach = 0, -1  # base spans that begin no later than the span at hand, and how far they reach
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if ALLOW.fullmatch(s):
            continue
        for a, b in entropy_spans(s, _limit(s)):
            a, b = a + m.start(), b + m.start()
            while at < len(base) and base[at][0] <= a:  # entropy spans come by start
                reach = max(reach, base[at][2])
                at += 1
            if b > reach:
                more.append((a, 3, b))
    return sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find_spans(text)
        base = [x for x in spans if x[1] < 3]
        n = [sum(x[1] == k for x in base) for k in range(3)]
        rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _redact(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        spans = _merged(find_spans(text)) if text else []
        if not spans:
            return text
        ends = [0, *(b for _, b in spans)]
        return "[SECRET]".join([*(text[e:a] for e, (a, _) in zip(ends, spans, strict=False)), text[ends[-1] :]])

    return texts.map(one, na_action="ignore")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    return docs.select("doc_id", F.pandas_udf(_scan, FOUND)(text_of()).alias("found")).select("doc_id", "found.*")


def redacted(text: Column) -> Column:
    """The text with each secret (overlapping spans as one) replaced by ``[SECRET]``; null stays null."""
    return F.pandas_udf(_redact, "string")(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars``, if there, follows a text that changed."""
    (name,) = free_names(docs.columns, "new")
    rows = docs.withColumn(name, redacted(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast("long") != F.length(name)
        rows = rows.withColumn("n_chars", F.when(changed, F.length(name).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col(name)).select(*docs.columns)
