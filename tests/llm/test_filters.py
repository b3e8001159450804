"""URL filter, quality rules, license scan and classifier against plain versions."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from duelwise.llm import classifier, licenses, quality, urls
from duelwise.llm.queries import URL_RULES

from .helpers import alnum, documents, odd_rows, prose

PAGES = "page_id long, url string, html string, host string, path string, rule string, good int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "", "h", "p", "r", 1) for i, u in rows], PAGES)


def some_urls():
    rng = random.Random(4)
    hosts = ["example.net", "a.example.net", "b.example.com", "example.org", "news.example.org", "xexample.net"]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice('abc')}"
                f"{rng.randrange(60)}") for i in range(400)]
    return rows + [
        (500, None), (501, ""), (502, "no scheme"), (503, "HTTP://A.EXAMPLE.NET/en/x?y://z#q"), (504, "x://"),
        (505, "http://example.net"), (506, "http://example.org?fr/"), (507, "http://example.org/fr/a\nb"),
        (508, "http://b.example.com/de/" + "q" * 50000), (503, "http://example.com/de/"), (None, "http://é.org/fr/"),
    ]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls_follow_rules_and_model(spark, monkeypatch):
    # So many slots that hardly any two contexts share one.
    monkeypatch.setattr(urls, "SLOTS", 1 << 20)
    monkeypatch.setattr(urls, "_TABLE", (urls.ORDER + 1) << 20)
    rows = some_urls()
    got = urls.filter_urls(pages(spark, rows), URL_RULES).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, *plain_rule(u)) for i, u in rows)
    assert want == collections.Counter(
        (r.page_id, r.host, r.path, (r.rule, r.verdict) if r.rule else None) for r in got)
    # The model again, with dictionaries and whole contexts.
    counts = collections.Counter()
    import zlib

    for _, u in rows:
        rule = plain_rule(u)[2]
        text = (u.split("://", 1)[1] if u and "://" in u else "").encode()
        if rule and zlib.crc32(text) % 5:
            for i, c in enumerate(text):
                for o in range(urls.ORDER + 1):
                    context = (b"\xff" * o + text[:i])[-o:] if o else b""
                    counts[rule[1], context] += 1
                    counts[rule[1], context, c] += 1
    for r, (_, u) in list(zip(sorted(got, key=lambda r: str(r.page_id)), sorted(rows, key=lambda r: str(r[0]))))[:40]:
        text = (u.split("://", 1)[1] if u and "://" in u else "").encode()
        total = 0.0
        for i, c in enumerate(text):
            for side, sign in (("allow", 1), ("block", -1)):
                chance = 1 / 256
                for o in range(urls.ORDER + 1):
                    context = (b"\xff" * o + text[:i])[-o:] if o else b""
                    chance = (counts[side, context, c] + urls.LEAN * chance) / (counts[side, context] + urls.LEAN)
                total += sign * math.log(chance)
        if r.page_id != 503:
            assert abs(r.ratio - total / max(1, len(text))) < 0.05
    assert all(r.verdict == ("allow" if r.probability >= 0.5 else "block") for r in got if not r.rule)


def test_url_counts_are_exact(spark):
    # Far more contexts than any fixed number of slots keeps apart.
    import zlib

    rng = random.Random(9)
    sign = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"http://{('example.net/en/', 'example.com/de/', 'x.y/')[i % 3]}{sign(20)}") for i in range(3000)]
    counts = collections.Counter()
    for i, u in rows:
        text = u.split("://", 1)[1].encode()
        if i % 3 < 2 and zlib.crc32(text) % 5:
            for at, c in enumerate(text):
                for o in range(urls.ORDER + 1):
                    context = (b"\xff" * o + text[:at])[-o:] if o else b""
                    counts[i % 3, context] += 1
                    counts[i % 3, context, c] += 1
    got = {r.page_id: r for r in urls.filter_urls(pages(spark, rows), URL_RULES).collect()}
    for i, u in rows[:600]:
        text, total = u.split("://", 1)[1].encode(), 0.0
        for at, c in enumerate(text):
            for side, plus in ((0, 1), (1, -1)):
                chance = 1 / 256
                for o in range(urls.ORDER + 1):
                    context = (b"\xff" * o + text[:at])[-o:] if o else b""
                    chance = (counts[side, context, c] + urls.LEAN * chance) / (counts[side, context] + urls.LEAN)
                total += plus * math.log(chance)
        assert abs(got[i].ratio - total / len(text)) < 1e-9


def test_url_joins_are_merged(spark, monkeypatch):
    # Spark took a row per character for smaller than its limit, and broadcast them through the driver.
    plans = []
    plan_of = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    keep = urls.settle
    monkeypatch.setattr(urls, "settle", lambda df: keep(plan_of(df)))
    plan_of(urls.filter_urls(pages(spark, some_urls()), URL_RULES))
    assert not any("Broadcast" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) == urls.ORDER + 2


def test_urls_without_a_model(spark):
    got = urls.filter_urls(pages(spark, [(1, "http://a.b/c"), (2, None)]), URL_RULES).collect()
    assert {(r.ratio, r.probability, r.verdict) for r in got} == {(0.0, 0.5, "allow")}
    assert urls.filter_urls(pages(spark, []), URL_RULES).count() == 0


def plain_statistics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_base_statistics(spark):
    rows = odd_rows() + [(20, "a b c a b c a b"), (21, "x | y\nx | y\n\n \nx"), (22, "a b c d a b"),
                         (23, "the a b c the a b\t\x0bc é漢🙂 #$% &|<>*"), (24, "z " * 70), (25, prose(1, 30) + " " + prose(1, 30))]
    docs = documents(spark, rows)
    got = quality.quality_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in got), key=key) == sorted(
        ((i, *plain_statistics(t)) for i, t in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed) and (r.distance is None) == r.base_failed
    assert quality.quality_rules(documents(spark, [])).count() == 0


def plain_distances(x):
    """Concentration steps with numpy, cuts by the same bins."""
    cut = lambda v, share: np.sort(np.floor(v / quality.BIN))[math.ceil(share * len(v) - 1e-9) - 1]
    m = np.array([(cut(c, 0.5) + 0.5) * quality.BIN for c in x.T])
    s = np.array([max(1.4826 * (cut(np.abs(c - k), 0.5) + 0.5) * quality.BIN, least)
                  for c, k, least in zip(x.T, m, quality.LEAST_SPREAD)])
    z = (x - m) / s
    d2 = (z * z).sum(axis=1)
    for _ in range(quality.STEPS):
        logs = np.log(d2 + 1e-9)
        near = z[np.floor(logs / quality.BIN) <= cut(logs, quality.HALF)]
        mean = near.mean(axis=0)
        cov = near.T @ near / len(near) - np.outer(mean, mean) + 0.1 * np.eye(quality.N)
        d2 = ((z - mean) @ np.linalg.inv(cov) * (z - mean)).sum(axis=1)
    grown = max(1.0, math.exp((cut(np.log(d2 + 1e-9), 0.5) + 0.5) * quality.BIN) / quality.CHI_MEDIAN)
    return d2 / grown


def test_outliers_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, quality.N)) @ rng.normal(size=(quality.N, quality.N)) * 0.3
    x[:40] += 9
    group = ["a"] * 450 + ["b"] * 120 + ["c"] * 60 + ["d"] * 70  # c and d are judged together
    rows = spark.createDataFrame(
        [(i, g, [float(v) for v in r]) for i, (g, r) in enumerate(zip(group, x))], "i int, g string, x array<double>")
    got = {r.i: r.d2 for r in quality.outliers(rows).collect()}
    for part in (slice(0, 450), slice(450, 570), slice(570, 700)):
        want = plain_distances(x[part])
        assert np.allclose([got[i] for i in range(part.start, part.stop)], want, rtol=1e-6, atol=1e-6)
    assert min(got[i] for i in range(40)) > quality.CUTOFF / 4


def junk_rows(n, copies):
    """n texts of prose in one group, a third of them junk: copies of one text, or all different."""
    junk = lambda i: " ".join(f"{w}#|$%&" for w in prose(3 if copies else i, 60).split())
    return [(i, junk(i) if i % 3 == 0 else prose(i, 80 + i * 37 % 200)) for i in range(n)]


@pytest.mark.parametrize("copies", [True, False])
def test_a_third_of_junk_is_rejected(spark, copies):
    got = quality.quality_rules(documents(spark, junk_rows(900, copies))).collect()
    assert not any(r.base_failed for r in got)
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got)


def test_small_groups_are_judged_by_themselves(spark):
    # Texts with many symbols: common in one small group, odd in the other, at any table size.
    odd = lambda i: " ".join(f"{w}#|$%&" for w in prose(i, 60 + i % 50).split())
    rows = [(i, odd(i), "code") for i in range(60)]
    rows += [(100 + i, prose(100 + i, 60 + i % 50), "news") for i in range(60)] + [(200, odd(200), "news")]
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert got[200].distance > 2 * max(got[i].distance for i in range(60))
    assert all(got[i].distance > 0 for i in (0, 30, 100, 130))


def test_headers_clauses_and_identifiers_are_labelled(spark):
    want = {
        "# SPDX-License-Identifier: Apache-2.0\nimport os": "apache",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl",
        "Redistributions of source code must retain the above copyright\n * notice, this list of "
        "conditions and the following disclaimer.": "bsd",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE": "mit",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3": "agpl,gpl",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.": "apache",
        "the software is provided to any person": "", "source code must be kept": "",
        "a license identifier of the map": "", "spdx identifier license mit": "",
    }
    noise = prose(3, 200)
    rows = [(i, f"{noise}\n{text}\n{noise}") for i, text in enumerate(want)]
    got = {r.doc_id: r.labels for r in licenses.license_labels(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == list(want.values())


def test_license_places_and_labels(spark):
    noise = prose(3, 40)
    mit = next(t for label, t in licenses.TEMPLATES if t.startswith("Permission is hereby"))
    rows = [
        (1, f"{noise} Released under the MIT License. {noise}"),
        (2, f"{noise}\nLicensed under the Apache License, Version 2.0.\n{noise} GENERAL public\tLicense"),
        (3, mit.replace("free of charge", "wholly free of any charge").replace("documentation", "docs")),
        (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under the Foo License"), (6, noise),
        (7, None), (8, ""), (9, "mit"), (10, "mit license " * 3), (None, "mit license"), (6, noise),
        (11, prose(5, 20000) + " apache license"), (12, "É MIT LICENSE é"),
    ]
    got = licenses.license_labels(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels == {1: "mit", 2: "apache,gpl", 3: "mit", 4: "cc-by-nc", 5: "", 6: "", 7: "", 8: "", 9: "",
                      10: "mit", None: "mit", 11: "apache", 12: "mit"}
    for doc_id, text in rows:
        w, places, base = alnum(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        r = next(x for x in got if x.doc_id == doc_id)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert (0.5 if base else 0) <= r.score <= 1
    assert licenses.license_labels(documents(spark, [])).count() == 0


def labelled(spark):
    good = [(i, prose(i, 80)) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(200)]
    labels = [(i, int(i < 1000)) for i, _ in good + bad]
    return good + bad, spark.createDataFrame(labels + [(None, 1), (7, None), (7, 1)], "doc_id long, quality int")


def test_classifier_learns_and_never_from_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows + odd_rows())
    weights = classifier.fit(docs, labels)
    found = classifier.score(docs, weights)
    assert found.columns == [*docs.columns, "quality_score"] and found.count() == docs.count()
    got = {r.doc_id: r.quality_score for r in found.filter("doc_id >= 100").collect()}
    assert all((got[i] >= 0.7) == (i < 1000) for i, _ in rows if i >= 100)
    assert all(0 <= r.quality_score <= 1 for r in found.collect())
    # Flipped labels of held-out rows change nothing.
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert np.array_equal(weights, classifier.fit(docs, flipped))
    assert not classifier.fit(docs, labels.limit(0)).any()
    assert classifier.score(documents(spark, []), weights).count() == 0


def test_scores_are_the_mean_weights_of_a_text():
    weights = np.random.default_rng(1).normal(size=classifier.SIZE).astype(np.float32)
    data = np.frombuffer("Ab ab, X|y".encode(), np.uint8)
    got = classifier.logits(data, np.array([0, len(data), len(data)]), weights)
    total = weights[-1].astype(float)
    for slot, _ in classifier.features(data, np.array([0, len(data)]))[1]:
        total += weights[slot].astype(float).sum() / (len(slot) + classifier.SMOOTH)
    assert np.allclose(got, [total, weights[-1]])
    assert classifier.train(pa.array(["a b", "c"]), np.array([1, 0]))[-1] == pytest.approx(0.0)
