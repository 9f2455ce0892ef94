"""Licence, secret, quality and URL operators against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from recvfund.llm import licenses, quality, secret_scans, urls

from .conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_license_base_places(make_docs, odd_rows):
    got = {}
    for r in licenses.license_digest(make_docs(odd_rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for i, text, _ in odd_rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        at = sorted((k, name) for name, p in phrases.items() for k in range(len(words)) if words[k : k + len(p)] == p)
        want = (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({n for _, n in at})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[i]]
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got[i])
    assert "cc-by-4.0" in got[15][0].labels


def test_license_templates(make_docs):
    texts = [t.text for t in licenses.TEMPLATES] + ["x " + t.text.upper() + " y" for t in licenses.TEMPLATES] + ["licenſe ma\u212aes mit licen\u017fe"]
    rows = licenses.license_digest(make_docs([(i, t, "a") for i, t in enumerate(texts)])).collect()
    n = len(licenses.TEMPLATES)
    for r in rows:
        if r.doc_id < 2 * n:
            assert licenses.TEMPLATES[r.doc_id % n].label in r.labels.split(",") and r.score == 1.0
        else:
            assert r.labels == ""  # other alphabets' letters do not fold into ASCII
    gap = licenses.license_digest(make_docs([(1, "apache something license version 2 0", "a"), (2, "licensed under the apache license version 2", "a")])).collect()
    assert {r.doc_id: r.labels for r in gap} == {1: "", 2: "apache-2.0"}  # key phrase broken; template cut short


def test_license_names_alone(make_docs):
    texts = {
        "MIT License": "mit", "under the MIT License.": "mit", "Mozilla Public License": "mpl", "Mozilla Public License Version 2.0": "mpl,mpl-2.0", "Mozilla Public License, v. 2.0": "mpl,mpl-2.0",
        "Mozilla Public License v2.0": "mpl,mpl-2.0", "Mozilla Public License 1.1": "mpl", "subject to the terms of the Mozilla Public License, v. 1.1": "mpl", "Eclipse Public License": "epl",
        "Creative Commons Attribution 4.0": "cc-attribution", "CC BY-NC": "cc-by,cc-by-nc", "Licensed under CC BY-NC": "cc-by,cc-by-nc", "a license of MIT": "",
    }
    common = [(1000 + i, "licensed under the terms of a license", "a") for i in range(30)]  # labels do not depend on the rest of the corpus
    for more in ([], common):
        rows = licenses.license_digest(make_docs([(i, t, "a") for i, t in enumerate(texts)] + more)).filter("doc_id < 1000").collect()
        assert {r.doc_id: r.labels for r in rows} == dict(enumerate(texts.values()))
        assert all((0 < r.score <= 1) == bool(r.labels) for r in rows)


def test_license_empty(make_docs):
    assert licenses.license_digest(make_docs([])).count() == 0


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24])


def secret_texts():
    return ["secret: token:abcdefgh", "𝒳 ToKeN = \"Zx9_Zx9\"; passwd='12345'", "AKIAAKIA" + "B" * 13 + " AKIASHORT", "e" * 24 + "g" + "0" * 23, "api_key=ſecretvalue api_key=aaaaaa", "key Zk3J9qLm2Xv8Tn5Rw7Yb4Hc6 end", "well_formed/path/names/of/things and supercalifragilisticexpialidocious", "", None]


def test_secret_base_and_entropy(make_docs, odd_rows):
    rows = [(i, t, "a") for i, t in enumerate(secret_texts())] + [(100 + i, t, s) for i, (_, t, s) in enumerate(odd_rows)]
    text = {i: t or "" for i, t, _ in rows}
    for r in secret_scans.scan_secrets(make_docs(rows)).collect():
        base = plain_base(text[r.doc_id])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        more = [s for s in r.spans.split(",") if s.startswith("entropy")]
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("entropy")) == joined
        assert bool(more) == (r.doc_id == 5) or r.doc_id == 2


def test_entropy_windows():
    s = "aaaaaaaaaaaaaaaaaaaaaaaaaZk3J9qLm2Xv8Tn5Rw7Yb4Hc6aaaaaaaaaaaaaaaaaaaaa"
    for limit in (2.5, 3.6, 4.2):
        hit = set()
        for i in range(len(s) - 19):
            c = np.array(list(Counter(s[i : i + 20]).values())) / 20
            if -(c * np.log2(c)).sum() >= limit - 1e-10:
                hit.update(range(i, i + 20))
        got = {i for a, b in secret_scans.entropy_spans(s, limit) for i in range(a, b)}
        assert got == hit


def test_allow_list():
    for secret in ("k3j9qlm2xv8tn5rw7yb4hc6a", "Zk3J9qLm2Xv8Tn5Rw7Yb4Hc6", "xK_9pQ-3vZ7/mN2=rT8wLb4yC", "aBcDeFgHiJkLmNoPqRsTuVwX"):
        assert any(k == 3 for _, k, _ in secret_scans.find_spans(f"x {secret} y")), secret
    for plain in ("this_is/a_path2/with-words", "Donaudampfschifffahrtsgesellschaft", "AVERYLONGCONSTANTNAME_OF_A_KIND", "2024-01-01/2024-12-31", "someCamelCaseIdentifierName", "========================", "z" * 5000 + "9x", "sha256-Zk3J9qLm2Xv8Tn5Rw7Yb4Hc6"):
        assert not secret_scans.find_spans(f"x {plain} y"), plain


def test_redaction(make_docs, odd_rows):
    docs = make_docs(odd_rows + [(50, "x token = abcdefgh y", "a")])
    out = secret_scans.without_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    r = out.filter("doc_id = 50").first()
    assert r.text == "x [SECRET] y" and r.n_chars == len(r.text)
    assert out.filter("doc_id = 1").first().text is None


def plain_quality(text):
    words = WORDS.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_quality_statistics(make_docs, odd_rows, spark):
    rows = odd_rows + [(60, "l one\n\n \nl one\nl two\nl one", "a"), (61, "a b c d e f g h a b c d e f g h x a b c", "a"), (62, "\x1c\x85\u00a0 x # é|", "a")]
    labels = spark.createDataFrame([(9, 1, 0), (9, 0, 0), (None, 1, 0), (10, None, 1)], "doc_id long, quality int, toxic int")
    want = sorted((repr((i, *plain_quality(t))) for i, t, _ in rows))
    got = quality.quality_rules(make_docs(rows), labels).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # one class of labels only: the fixed limits decide
    assert quality.quality_rules(make_docs([]), labels).count() == 0


def test_quality_counts_and_scores_in_one_function(make_docs, odd_rows):
    """A task holds one Python process with a batch of texts, not two."""
    rng = np.random.default_rng(4)
    x, bad = rng.uniform(0, 0.3, (200, 8)), np.zeros(200, bool)
    x[:20], bad[:20] = x[:20] + 0.6, True
    forest = quality.fit(x, bad, trees=20)
    got = quality.judged(make_docs(odd_rows), forest, "judged")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    scores = [r.judged.anomaly for r in got.orderBy("n_chars", "doc_id", "text").collect()]
    texts = [r.text or "" for r in make_docs(odd_rows).orderBy("n_chars", "doc_id", "text").collect()]
    assert scores == list(forest.scores(np.array([quality.text_stats(t)[5] for t in texts])))


def test_quality_forest_held_out(make_docs, spark):
    import random

    from .conftest import prose

    rng = random.Random(3)
    good = [prose(rng, rng.randint(30, 400)) for _ in range(260)]
    bad = [" ".join(w + rng.choice(["###", "%%%", "|", "&&"]) for w in prose(rng, rng.randint(30, 300)).split()) for _ in range(60)]
    rows = [(i, t, "a") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(rows)) if i % 2], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality.quality_rules(make_docs(rows), labels).collect() if r.doc_id % 2 == 0}
    clean, junk = [v for i, v in out.items() if i < len(good)], [v for i, v in out.items() if i >= len(good)]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.1
    docs = make_docs(rows)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(quality_kept for quality_kept in [r.kept for r in quality.quality_rules(docs, labels).collect()])


URLS = [
    "http://Example.ORG/es/1", "https://a.b.example.org/en/17?q", "https://example.org/en/2#x", "http://xexample.org/es/", "http://site.com/fr/x?y://z", "http://com/de/", "ftp://u:p@host.net:80/a//b", "nothing", None, "", "://", "http://site.org", "http://site.org?x/", "http://site.org/#",
    "http://a.com/de", "http://bad.net/en/1",
]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [(r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "k") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "k")], "page_id long, url string, html string, host string")
    bad = spark.createDataFrame([("bad.net", 1)] * 60 + [("ok.net", 0)] * 60, "host string, bad int")
    for r in urls.judge_urls(pages, bad).collect():
        host, path, rule, verdict = plain_rule(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if host == "bad.net" else "allow"))
    none = spark.createDataFrame([], "host string, bad int")
    assert {r.verdict for r in urls.judge_urls(pages, none).filter("rule is null").collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), bad).count() == 0


def test_host_reputation_shrinks(spark):
    rows = [("a.x.net", 1)] + [("b.x.net", 0)] * 50 + [("c.x.net", 1)] * 45 + [("c.x.net", 0)] * 5 + [("d.y.com", 0)] * 30
    known, unknown = urls.host_reputation(spark.createDataFrame(rows, "host string, bad int"))
    got = {r.host: r for r in known.collect()}
    assert got["c.x.net"].low > 0.5 and got["b.x.net"].mean < 0.2
    assert 0.05 < got["a.x.net"].mean < 1 and got["a.x.net"].low < 0.5 and 0 <= unknown < 0.5


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.example.org:8080", "example.org", "org"), ("", "", "")])
def test_registered_domain(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    d, s = urls.domain_of(F.lit(host))
    assert tuple(spark.range(1).select(d, s).first()) == (domain, suffix)


def test_entropy_finds_keys_that_no_base_pattern_covers():
    rng = random.Random(77)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = 0
    for _ in range(200):
        key = "".join(rng.choices(alphabet, k=40))
        text = f"{prose(rng, 30)} {key} {prose(rng, 30)}"
        assert not [s for s in secret_scans.base_spans(text) if s[0] >= text.index(key) and s[2] <= text.index(key) + 40 and s[1] == 0]
        spans = [s for s in secret_scans.find_spans(text) if s[1] == 3]
        found += any(text.index(key) <= a and b <= text.index(key) + 40 for a, _, b in spans)
    assert found >= 190
    clean = [s for _ in range(200) for s in secret_scans.find_spans(prose(rng, 120))]
    assert not clean


def test_spans_covered_by_base_ones_are_left_out():
    rng = random.Random(78)
    for _ in range(40):
        parts = [rng.choice(["token = '" + "".join(rng.choices("abcXYZ0189+/", k=50)) + "'", "".join(rng.choices("QWERTYasdfgh0123456789+/zxcvbnm", k=45)), "AKIA" + "A1B2C3D4E5F6G7H8J9K0", prose(rng, 5)]) for _ in range(30)]
        text = " ".join(parts)
        base = secret_scans.base_spans(text)
        plain = []
        for m in secret_scans._CANDIDATE.finditer(text):
            if not secret_scans.ALLOW.fullmatch(m.group()):
                for a, b in secret_scans.entropy_spans(m.group(), secret_scans._limit(m.group())):
                    a, b = a + m.start(), b + m.start()
                    if not any(x <= a and b <= y for x, _, y in base):
                        plain.append((a, 3, b))
        assert secret_scans.find_spans(text) == sorted(base + plain)


def test_hosts_worse_than_the_average_are_blocked(spark):
    """Labelled outcomes decide: a host with nearly twice the overall bad rate goes, at any overall rate; one that chance explains stays."""
    hosts = {f"h{i}.d{i}.net": (200, 40 + i % 5) for i in range(40)} | {"spam.net": (300, 110), "few.net": (3, 2), "clean.net": (300, 5)}
    rows = [(h, int(j < bad)) for h, (n, bad) in hosts.items() for j in range(n)]
    pages = spark.createDataFrame([(i, f"http://{h}/p", None) for i, h in enumerate([*hosts, "unseen.net"])], "page_id long, url string, html string")
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    blocked = lambda **k: {r.host for r in urls.judge_urls(pages, outcomes, **k).collect() if r.verdict == "block"}
    assert blocked() == {"spam.net"}
    assert not blocked(max_bad_rate=0.5) and "unseen.net" in blocked(max_bad_rate=0.0)
