"""Near duplicates and repeated lines against comparisons of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import duelwise.llm.components as contraction
from duelwise.llm import lines, minhash, scratch, words
from duelwise.llm.components import components

from . import helpers
from .helpers import documents, near_groups, odd_rows, prose, repeated_lines


def variants(seed, base, copies, edits):
    """Copies of a text with some words replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(copies):
        words = base.split(" ")
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (41, 40)]
    rows = spark.createDataFrame([*links, (None, 3), *links], "a long, b long")
    got = {r.node: r.component for r in components(rows).collect()}
    assert got == {i: 0 for i in range(42)} | {i: 100 for i in range(100, 160)}
    assert components(rows.limit(0)).count() == 0


def test_components_write_no_more_once_only_stars_are_left(spark, monkeypatch):
    written = []
    monkeypatch.setattr(contraction, "settle", lambda df: written.append(df) or scratch.settle(df))
    stars = [(i % 3, i) for i in range(3, 30)]
    rows = spark.createDataFrame(stars, "a long, b long")
    assert {r.node: r.component for r in components(rows).collect()} == {i: i % 3 for i in range(30)}
    assert len(written) == 1
    # Two smaller neighbours, a chain, and both at once are no stars.
    for links in ([(2, 0), (2, 1)], [(2, 1), (1, 0)], [(3, 1), (3, 2), (2, 0)]):
        rows = spark.createDataFrame(links, "a long, b long")
        assert {r.component for r in components(rows).collect()} == {0}


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    rows = spark.createDataFrame(links, "a long, b long")
    want = helpers.components({x for a, b in links if a != b for x in (a, b)}, links)
    assert {r.node: r.component for r in components(rows).collect()} == want


def test_near_duplicates_equal_all_pairs(spark):
    texts = variants(1, prose(1, 200), 40, (0, 14)) + variants(2, prose(2, 40), 30, (0, 4)) \
        + [prose(i, 30) for i in range(10, 30)] + ["a b c d e", "A b c  d e", "a b c d", "a", "A", ""]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    got = minhash.near_duplicates(documents(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = list(enumerate(variants(5, prose(9, 150), 90, (0, 16))))
    got = minhash.near_duplicates(documents(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(rows, 4)


def test_odd_rows_of_near_duplicates(spark):
    rows = odd_rows()
    got = minhash.near_duplicates(documents(spark, rows), shingle=5).collect()
    assert len(got) == len(rows)
    want = near_groups(rows, 5)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents(spark, []), percent=50)


def removed(df):
    return {r.doc_id: list(r.line_report.removed) for r in df.collect()}


def line_texts(seed):
    rng = random.Random(seed)
    pool = [prose(i, rng.randint(1, 25)) for i in range(30)]
    texts = []
    for _ in range(60):
        picked = [variants(rng.random(), rng.choice(pool), 1, (0, 3))[0] for _ in range(rng.randint(0, 6))]
        texts.append("\n".join([*picked, *rng.sample(["", "a b", "the of and", "The  of AND"], 2)]))
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_repeated_lines_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rows = line_texts(chunk)
    found = lines.dedup_lines(documents(spark, rows))
    want = repeated_lines(rows)
    assert removed(found) == want
    texts = {r.doc_id: r.text for r in found.collect()}
    for doc_id, text in rows:
        kept = [x for k, x in enumerate(text.split("\n")) if k not in want[doc_id]]
        assert texts[doc_id] == "\n".join(kept)


def test_a_group_of_similar_lines(spark):
    rows = list(enumerate(variants(8, prose(50, 40), 120, (0, 6))))
    assert removed(lines.dedup_lines(documents(spark, rows))) == repeated_lines(rows)


def test_odd_rows_of_lines(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    found = lines.dedup_lines(docs)
    assert found.columns == [*docs.columns, "line_report"] and found.count() == len(rows)
    got = found.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = repeated_lines([r for r in dict(rows).items() if r[0] is not None])
    assert removed(got) == want
    assert found.filter("text is null").select(F.sum("line_report.n_lines")).first()[0] == 0
    # Rows without id come last.
    last = found.filter("doc_id is null and n_chars > 0").first()
    assert list(last.line_report.removed) == [0] and last.text == ""
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_lines_dealt_into_many_buckets(spark, monkeypatch):
    for name, value in (("BUCKET_WORDS", 64), ("BUCKET_ENTRIES", 64), ("HELD", 100)):
        monkeypatch.setattr(lines, name, value)
    rows = line_texts(5)
    docs = documents(spark, [*rows, *rows[:20]]).repartition(7)
    assert removed(lines.dedup_lines(docs)) == repeated_lines(rows)


def test_copies_of_lines_are_compared_with_nothing(spark, monkeypatch):
    """Lines of equal sets, also far apart, make no pairs."""
    rows = [(i, "\n".join([prose(1, 30), prose(100 + i, 30), prose(2, 12)])) for i in range(60)]
    pairs = []

    def confirmed(source, found, percent, plain=lines._confirmed):
        pairs.append(found.count())
        return plain(source, found, percent)

    monkeypatch.setattr(lines, "_confirmed", confirmed)
    found = lines.dedup_lines(documents(spark, rows).repartition(6))
    assert removed(found) == repeated_lines(rows)
    assert pairs == [0]


@pytest.mark.parametrize("named", [None, 1])
def test_pairs_of_lists_do_not_depend_on_tiles(monkeypatch, named):
    rng = np.random.default_rng(3)
    n = 300
    rows = {"list": np.sort(rng.integers(0, 12, n)), "id": np.arange(n), "spot": np.zeros(n, int),
            "sig0": rng.integers(0, 8, n), "sig1": np.zeros(n, int), "n": rng.integers(6, 30, n),
            "pos": rng.integers(0, 3, n), "marked": rng.random(n) < 0.8}
    found = []
    for short, tile in ((512, 1 << 20), (512, 7), (0, 7), (25, 7)):
        monkeypatch.setattr(lines, "SHORT", short)
        monkeypatch.setattr(lines, "TILE", tile)
        found.append(sorted(zip(*(x.tolist() for x in lines._list_pairs(rows, 80, named)))))
    assert found[0] and all(x == found[0] for x in found)


def test_word_hashes_tell_words_apart():
    pool = [bytes(random.Random(i).choices(b"ab\0", k=i % 26 + 1)) for i in range(400)]
    pool += [b"a" * i for i in range(1, 40)]
    data = np.frombuffer(b" ".join(pool * 2), np.uint8)
    start, end = words.runs(data, np.array([0, 3, 3, len(data)]), words.SPACED)
    hashes = words.hash_words(data, start, end)
    own = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert len(set(own)) == len(set(hashes.tolist())) == len(set(zip(own, hashes.tolist())))
    assert not any(a < 3 < b for a, b in zip(start, end))
