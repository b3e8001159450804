"""Fill-in-middle, packing and source divergence against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duelwise.llm import divergence, infill, packing

from .helpers import LOWER, documents, odd_rows

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_infill(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_is_the_plain_one_and_comes_back(spark):
    rows = odd_rows() + [
        (20, "a <P> b"), (21, "<S>"), (22, "x<M"), (23, "<"), (24, "S><M ab1 <P"), (25, "\n\n"),
        *((100 + i, f"Äb{i} c-{i}\t🙂 é{'z' * i}") for i in range(60))]
    docs = documents(spark, rows).withColumnRenamed("g", "infill")
    made = infill.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "infill_"]
    flat = made.select("doc_id", F.col("text").alias("old"), "infill_.*")
    found = infill.restore(flat, "text", "form").collect()
    want = Counter((i, *plain_infill(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text)
                   for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert r.restored == (r.old or "")
        assert r.output_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((r.old or "").encode()).hexdigest()
        spelled = b"".join(
            ((r.old or "").encode() if p.buffer == "text" else infill.SENTINELS[p.buffer])
            [p.start:p.start + p.length] for p in r.pieces)
        assert spelled == r.text.encode()
    short = infill.fill_in_middle(docs, keep_text=False).select("infill_.*").collect()
    assert {(r.output_sha256, r.restored_sha256, r.text) for r in short} == {
        (r.output_sha256, r.restored_sha256, None) for r in found}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_pieces_split_at_edges():
    whole = [infill.Piece("text", 3, 5)]
    assert infill.split(whole, 0) == [infill.Piece("text", 3, 0), infill.Piece("text", 3, 5)]
    assert infill.split(infill.split(whole, 2), 2) == [
        infill.Piece("text", 3, 2), infill.Piece("text", 5, 0), infill.Piece("text", 5, 3)]
    assert infill.split(infill.split(whole, 2), 5) == [
        infill.Piece("text", 3, 2), infill.Piece("text", 5, 3), infill.Piece("text", 8, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=12), st.integers(0, 12))
def test_best_fill_is_the_closest_sum(counts, room):
    counts = [0, *counts]
    found = packing.best_fill(counts, room)
    assert all(n <= counts[x] for x, n in found.items())
    sums = {0}
    for length, n in enumerate(counts):
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
    assert sum(x * n for x, n in found.items()) == max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 400), max_size=12))
def test_plan_places_every_id_once(counts):
    rows = packing.plan(counts, 32)
    covered, used = defaultdict(list), defaultdict(list)
    for length, start, low, high, size, window, turn, per, offset in rows.tolist():
        for rank in range(low, high):
            t = turn + rank - low
            covered[length, rank].append((start, size))
            used[window + t // per].append((offset + t % per * size, size))
    assert set(covered) == {(x, r) for x, n in counts.items() for r in range(n)}
    for (length, _), parts in covered.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == length
    assert sorted(used) == list(range(len(used)))
    lengths = []
    for window in sorted(used):
        at = 0
        for offset, size in sorted(used[window]):
            assert offset == at
            at += size
        lengths.append(at)
    total = sum(x * n for x, n in counts.items())
    assert lengths[:total // 32] == [32] * (total // 32)
    assert sum(lengths) == total and all(x & (x - 1) == 0 for x in lengths)


def test_whole_rests_fill_windows_uncut():
    rows = packing.plan({20: 1000, 12: 1000, 3: 64, 29: 64}, 32)
    assert all(start == 0 and size == length for length, start, _, _, size, *_ in rows.tolist())
    # A third of all rests has one length: as few rows as for a handful.
    assert len(packing.plan({31: 10 ** 9, 7: 10 ** 9, 1: 10 ** 9}, 32)) < 100


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_pieces_hold_all_ids(spark, capacity):
    rows = odd_rows() + [(50 + i, " ".join(f"tok{i}x{j}" for j in range(i))) for i in range(40)]
    rows += [(200, "same text again and again") for _ in range(30)]
    docs = documents(spark, rows).repartition(5)
    pieces = packing.pack_documents(docs, TOKENIZER, capacity).collect()
    model = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, tuple([*model.encode(t or "", add_special_tokens=False).ids, 1]))
                   for i, t in rows)
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = Counter()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
        sizes[at] += 1
    assert sum(n for s, n in sizes.items() if s < capacity) <= capacity.bit_length()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for doc_id, parts in by_doc.items():
        own = {ids: n for (i, ids), n in want.items() if i == doc_id}
        assert sum(len(x) for _, x, _ in parts) == sum(len(ids) * n for ids, n in own.items())
        if sum(own.values()) == 1:
            (ids,) = own
            assert [x for _, part, _ in sorted(parts) for x in part] == list(ids)
            assert {n for *_, n in parts} == {len(ids)}
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_ranks_give_the_ids_of_the_tokenizer():
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = packing.Encoder(TOKENIZER, ranks, public_tokenizers.PATTERN)
    model = Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for _, t in odd_rows()]
    texts += ["a<|endoftext|>b", "  a  \n\n b\t c ", " " * 30_000 + "x", "x" * 50_000, "\u2028 a\x1c b"]
    texts += [f"a{c}1 {c}b{c}!{c}  {c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)])]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == model.encode(text, add_special_tokens=False).ids


def test_query_of_packing_gives_unsigned_checksums(spark):
    from duelwise.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    rows = QUERIES["op12_pack_sequences"](spark, path).collect()
    texts = dict(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    model = Tokenizer.from_file(TOKENIZER)
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    seen = Counter()
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


def plain_divergence(rows, least, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        groups.add((lang, source))
        n[lang, source].update(own)
        docs[lang].update(own.keys())
    out = set()
    kept = {lang: [t for t, k in docs[lang].items() if k >= least] for lang, _ in groups}

    def shares(lang, counts):
        terms = kept[lang]
        total = sum(counts[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 10 ** 9 * (counts[t] + 5) // total for t in terms}

    for lang, source in groups:
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(n[g])
        p, q = shares(lang, n[lang, source]), shares(lang, whole)
        pairs = []
        for g in groups:
            if g[0] == lang and g[1] != source:
                other = shares(lang, n[g])
                pairs.append((-sum(abs(p[t] - other[t]) for t in p), g[1].encode()))
        terms = [(q[t] - p[t], t.encode()) for t in p if n[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, k)
                    for k, (value, item) in enumerate(sorted(found), 1)}
    return out


def test_divergence_is_the_plain_one(spark):
    rng = random.Random(5)
    rows = [(None, None, None), ("", "en", None), ("only once", "rare", "a"), ("x", "rare", "b")]
    for i in range(400):
        lang, source = rng.choice("de en".split()), rng.choice("a a a a b c É".split())
        words = [f"{rng.choice('abÄ漢')}{'abcdefghij'[int(rng.paretovariate(1)) % 10] * k}"
                 for k in range(1, 6) for _ in range(rng.randrange(4))]
        rows.append((rng.choice([" ", ".", "1"]).join(words).upper(), lang, source))
    rows += [rows[10]] * 200
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows],
        "text string, lang string, source string, n long, term string, block int").repartition(7)
    found = divergence.source_divergence(docs, least_docs=20, top=9).collect()
    assert {tuple(r) for r in found} == plain_divergence(rows, 20, 9)
    assert len(found) == len({tuple(r) for r in found})
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_joint_cells_of_bitmaps():
    """Random count levels in several words: differences as by term."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    counts = rng.geometric(0.3, (4, 300)) * (rng.random((4, 300)) < 0.7)
    p = counts * np.array([[7], [11], [2], [5]]) + 1
    rows = []
    for g, w in product(range(4), range(5)):
        at = np.arange(64 * w, min(300, 64 * w + 64))
        levels = {0: at, **{c: at[counts[g, at] == c] for c in counts[g, at] if c}}
        for c, terms in levels.items():
            bits = np.bitwise_or.reduce(np.uint64(1) << (terms % 64).astype(np.uint64))
            rows.append(("abcd"[g], w, int(c), int(c * [7, 11, 2, 5][g] + 1),
                         int(np.uint64(bits).view(np.int64))))
    rng.shuffle(rows)
    source, word, n, own, bits = zip(*[(r[0], int(r[1]), int(r[2]), int(r[3]), int(r[4])) for r in rows])
    names, total = divergence._joint(pa.table({
        "source": list(source), "word": pa.array(word, pa.int32()), "n": list(n), "p": list(own),
        "bits": list(bits)}))
    at = ["abcd".index(x) for x in names]
    want = np.abs(p[at][:, None] - p[at][None]).sum(2)
    assert (total == want).all()
