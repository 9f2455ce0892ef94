"""Language ID, token alignment and hard negatives against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from recvfund.llm import alignment, langid, negatives

from .conftest import prose


def plain_ppm(passages, text):
    """Code length of ``text`` by the book: method C with exclusion, contexts seen often enough."""
    counts = defaultdict(Counter)
    for p in passages:
        for i, b in enumerate(p):
            for k in range(min(i, langid.ORDER) + 1):
                counts[p[i - k : i]][b] += 1
    used = {c for c, n in counts.items() if not c or sum(n.values()) >= langid.MIN_SEEN}
    bits = 0.0
    for i, b in enumerate(text):
        k = next(k for k in range(min(i, langid.ORDER), -1, -1) if text[i - k : i] in used)
        out = set()
        for j in range(k, -1, -1):
            at = {s: n for s, n in counts[text[i - j : i]].items() if s not in out}
            total, kinds = sum(at.values()), len(at)
            if b in at:
                bits -= math.log2(at[b] / (total + kinds))
                break
            if total:
                bits -= math.log2(kinds / (total + kinds))
            out |= set(at)
        else:
            bits += math.log2(256 - len(out))
    return bits


def fitted(samples):
    """A model of passages by language, counted like the operator's."""
    import pandas as pd

    rows = pd.DataFrame([(g, p) for g, ps in samples.items() for p in ps], columns=["lang", "passage"])
    counts = pd.concat(list(langid._counted(iter([rows]))))
    trees = defaultdict(list)
    for (g, k, c), x in counts.groupby(["lang", "k", "context"]):
        if k == 0 or x["n"].sum() >= langid.MIN_SEEN:
            trees[g].append((k, c, x["byte"].to_numpy(), x["n"].to_numpy()))
    return langid.Model(dict(trees), {g: 1 / len(samples) for g in samples})


def test_code_lengths_are_exact():
    rng = random.Random(3)
    samples = {"x": [prose(rng, 600), "abc abc " * 40], "y": ["zorblax quint " * 60, prose(rng, 80)]}
    model = fitted(samples)
    texts = [prose(rng, 300), "", "a", "\x7f\x01 zé𝒳", "abc abc zorblax", prose(rng, 700) + "zorblax", "12 9 0", "abc " * 2000]
    got = model.lengths([langid.encoded(t) for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(model.langs):
            want = plain_ppm([langid.encoded(p) for p in samples[g]], langid.encoded(t)) + 1  # one bit for one language of two
            assert got[i, j] == pytest.approx(want, rel=1e-5, abs=1e-3)


def test_each_context_shares_out_one():
    rng = random.Random(4)
    model = fitted({"x": [prose(rng, 400)]})
    model.lengths([b"a"])
    seen = model.symbol.max()
    p = np.exp2(-model.tables[0].cost.astype(float)).reshape(-1, seen + 1)
    unseen = 256 - int((np.bincount(model.symbol, minlength=seen + 1)[:seen]).sum())
    assert np.allclose(p[:, :seen].sum(1) + unseen * p[:, seen], 1, atol=1e-4)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_language_id(spark):
    rng = random.Random(8)
    words = {"aa": "kalo mira tenu poli sade".split(), "bb": "xorg grunt zwick bläh dröhn".split(), "": "π σ ω λόγος".split()}
    text = {g: lambda n, w=w: " ".join(rng.choices(w, k=n)) for g, w in words.items()}
    rows = [(i, text[g](rng.randint(3, 60)), g) for i, g in enumerate(rng.choices(list(words), k=240))]
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(300)]  # copies: more than half of all rows
    rows += [(2000, None, "aa"), (2001, "", "bb"), (2002, "12 34 !?", "aa"), (2003, text["bb"](9000), None), (None, text["aa"](20), "aa"), (None, text["aa"](20), None), (2004, "  \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as lettered", "2 as said", "3 as h", "4 as Score")
    got = langid.language_id(docs).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    want = {i: (g if t and any(c.isalpha() for c in t) else "und") for i, t, g in rows if i is not None}
    want[2003] = "bb"
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id is not None} == want
    assert {r.lang_pred for r in got if r.doc_id is None} == {"aa"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    # what is held out, and the languages of rows to be told, change nothing
    other = spark.createDataFrame([(i, t, "zz" if held(i) else g) for i, t, g in rows], "doc_id long, text string, lang string")
    key = lambda r: repr((r.doc_id, r.lang_pred, r.score))
    assert sorted(map(key, langid.language_id(other).collect())) == sorted(map(key, got))
    # nothing to learn from, and nothing at all
    assert {(r.lang_pred, r.score) for r in langid.language_id(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {("und", 0.0)}
    assert langid.language_id(docs.limit(0)).count() == 0


def test_the_sample_is_bounded(spark):
    rng = random.Random(2)
    one = prose(rng, 4000)
    rows = [(i, one if i % 3 == 0 else prose(rng, rng.choice([30, 900])), "aa" if i % 7 else "bb") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    passages, share = langid.sample(docs, max_bytes=50_000)
    size = {r[0]: r[1] for r in passages.groupBy("lang").agg({"passage": "count"}).collect()}
    assert set(size) == set(share) == {"aa", "bb"} and all(0 < n * langid.PASSAGE < 200_000 for n in size.values())
    every, _ = langid.sample(docs, max_bytes=1 << 40)
    found = Counter((r.lang, r.passage) for r in every.collect())
    want = {(g, t[j : j + langid.PASSAGE]) for i, t, g in rows if not held(i) for j in range(0, len(t), langid.PASSAGE)}
    assert set(found) == want


@pytest.fixture(scope="module")
def pair():
    return alignment.Tokenizers(*alignment.tokenizer_files())


def plain_alignment(pair, text):
    """Counts, links and groups of a text, encoded whole, from the decoded bytes alone."""
    none = (0, 0, 0, [], "")
    if not text:
        return none
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    a_tokens, b_tokens = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if b"".join(a_tokens) != raw or b"".join(b_tokens) != raw:
        return none
    ends = {int(e): j for j, e in enumerate(np.cumsum([len(t) for t in b_tokens]))}
    links, groups, i0, j0, at = [], [], 0, 0, 0
    for i, t in enumerate(a_tokens):
        at += len(t)
        if at in ends:
            j = ends[at]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


ODD = [
    None, "", " ", "  ", "a", "x<|endoftext|>y <s> </s>", "▁a b", "a▁ b", "é日𝒳😀   x", "\n\n  a", "a \n b\t\tc  ", "\x00 � x", "I'm  he'll　日本 語 ", "a" * 500, " " * 300,
    "😀" * 50 + " 👩‍👩‍👧‍👦", "word. \x85 x", "� x", "a\r\n b",
]


def odd_texts(n):
    rng = random.Random(1)
    return ODD + ["".join(rng.choices(" .,\n\tab é日😀▁ 's1²", k=rng.randint(1, 30))) for _ in range(n)]


def test_alignment_of_odd_texts(pair):
    texts = odd_texts(1500) + [prose(random.Random(6), 3000)]
    ids = pa.array(range(len(texts)))
    got = alignment._rows(pair, ids, texts)
    for r, t in zip(got.to_pylist(), texts, strict=True):
        links = [c for c, n in zip(r["codes"], r["times"], strict=True) for _ in range(n)]
        want = plain_alignment(pair, t)
        assert (r["n_a"], r["n_b"], r["n_groups"], sorted(links), r["groups_sha256"]) == (*want[:3], sorted(a * pair.radix + b for a, b in want[3]), want[4]), t
    whole = alignment.Tokenizers(pair.a_json, pair.b_model)
    whole.in_segments = False  # as with vocabularies that cross spaces
    assert alignment._rows(whole, ids, texts).equals(got)


def test_forgetting_changes_nothing(pair, monkeypatch):
    texts = odd_texts(200)
    want = alignment._rows(pair, pa.array(range(len(texts))), texts)
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "AT_ONCE", 2)
    t = alignment.Tokenizers(pair.a_json, pair.b_model)
    parts = [alignment._rows(t, pa.array([i]), [x]) for i, x in enumerate(texts)]
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == want.to_pylist()


def test_refined_spans():
    # 1 + 4 bytes of a split character + 2; the spans of the split tokens end with the character or before it
    for coarse in ([1, 5, 5, 5, 7], [1, 1, 1, 5, 7]):
        ends = alignment.refined(np.array(coarse), np.array([1, 1, 2, 1, 2]), np.array([False, True, True, True, False]))
        assert ends.tolist() == [1, 2, 4, 5, 7]
    assert alignment.refined(np.array([2, 9]), np.array([1, 2]), np.array([False, False])).tolist() == [1, 3]  # spans of another text


def test_align(spark, pair):
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(odd_texts(60))] + [(1000 + i, prose(rng, 200)) for i in range(30)] + [(None, "the the of"), (None, None), (7, "the the of"), (7, "the the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as codes", "2 as N_A", "3 as times")
    got = alignment.align(docs).collect()
    plain = [(i, plain_alignment(pair, t)) for i, t in rows]
    n = Counter(link for _, x in plain for link in x[3])
    most = defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    want = [(i, x[0], x[1], x[2], len(x[3]), sum(n[link] == most[link[1]] for link in x[3]), sum(n[link] for link in x[3]), x[4]) for i, x in plain]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert alignment.align(docs.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(docs.filter("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def plain_negatives(rows, k=5):
    """Rows (id, label, vector) that take part; every pair scored by Python's whole numbers."""
    def least(i):
        return min((r for r in rows if r[0] == i), key=lambda r: (len(r[2]), r[1], r[2]))

    out = []
    for a in sorted({r[0] for r in rows if r[0] % 100 == 0}):
        anchor = least(a)
        rest = list(rows)
        rest.remove(anchor)
        scored = [(sum(x * y for x, y in zip(anchor[2], r[2], strict=True)), r) for r in rest if len(r[2]) == len(anchor[2])]
        positives = sorted((s for s in scored if s[1][1] == anchor[1]), key=lambda s: (-s[0], s[1][0]))[:k]
        for p, (ps, pr) in enumerate(positives, 1):
            fits = sorted(((-s, r[0]) for s, r in scored if r[1] != anchor[1] and 80 * ps <= 100 * s <= 100 * ps))[:k]
            out += [(a, pr[0], n, i, ps, -s, p) for n, (s, i) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("scale", [1.0, 4000.0])  # fields of 4 and of 8 bytes
def test_hard_negatives(spark, scale):
    rng = random.Random(17)
    nan, inf = float("nan"), float("inf")
    rows = []
    for i in range(700):
        centre = rng.choice([(1, 1, 0), (1, 0.8, 0.1), (-1, 0, 1)])
        rows.append((i, rng.choice([0, 0, 0, 0, 1, 2, 9]), [scale * (c + rng.choice([0, 0, 0.25, rng.gauss(0, 0.2)])) for c in centre]))
    rows += [(100, 0, rows[100][2]), (100, 3, [scale, scale, 0.0]), (200, rows[200][1], rows[200][2]), (333, 1, rows[300][2]), (None, 0, [scale, scale, 0.0])]
    rows += [(800, None, [1.0, 1.0, 1.0]), (900, 0, None), (1000, 0, [1.0, nan, 0.0]), (1100, 0, [inf, 0.0, 0.0]), (1200, 0, [None, 0.0, 0.0]), (1300, 0, []), (1400, 5, [1.0, 2.0]), (1401, 5, [1.0, 2.0]), (1402, 6, [0.9, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as dim", "2 as part", "3 as V", "4 as score", "5 as own")
    sound = [(i, (g + 1) % 10 if i % 7 == 0 else g, [math.floor(256 * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = plain_negatives(sound)
    assert len(want) > 50
    for shard, block in ((2048, 512), (60, 3)):
        got = negatives.hard_negatives(df, shard_rows=shard, block_rows=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 400")).count() == 0


def test_packed_products_are_exact():
    rng = np.random.default_rng(5)
    for most, dim, n in ((1, 1, 3), (300, 64, 2500), (1 << 20, 7, 1100), (1 << 40, 5, 40), (1 << 48, 64, 30)):
        x, anchors = rng.integers(-most, most, (n, dim), endpoint=True), rng.integers(-most, most, (4, dim), endpoint=True)
        packed = negatives.Packed(x, most)
        for a in anchors:
            assert [int(s) for s in packed.scores(a)] == [sum(int(p) * int(q) for p, q in zip(a, r, strict=True)) for r in x]
