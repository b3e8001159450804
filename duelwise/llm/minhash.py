"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles. Its sketch holds the k smallest hashes of that
set, so the k smallest of two united sketches are a fair sample of the united sets. Equal
sets are one node. Inverted lists of retained values propose pairs of nodes, the united
sketch estimates their similarity, and whole sets confirm it.

Two sets of similarity 0.8 share 51 of 64 retained values on average, and fewer than 32
with a chance of about 1e-8. A node therefore enters only the lists of its k - 32 + 1 rarest
retained values (any two such prefixes meet), which keeps passages that many documents
share out of the lists. Small sets are their own sketch, and nothing is left to chance.

Every list links its members with its most central one first. Members that are still apart
are compared in blocks of a bounded size; a parity bitmap of each whole set, which can only
underestimate a difference, discards pairs there. So a group of n near copies makes about n
pairs, not n**2, while every link between different components is looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelwise.llm.components import components
from duelwise.llm.scratch import TEXTS, settle, slot_counts
from duelwise.llm.words import SPACED, Words, mix, split_words, text_slices, whole, windows

K = 64
#: Retained values that two linked nodes share at least.
SHARED = 32
#: Slots of the array of list lengths, which orders values by rarity.
SLOTS = 1 << 20
#: Slots of the bitmap of wanted nodes.
WANTED = 1 << 22
BLOCK = 1024

_SETS = "row_id long, n long, node binary, sketch array<long>, bits binary"


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, ascending; one for all words of a shorter text."""
    hashes, place = windows(words, size)
    bounds = np.searchsorted(place, words.offsets)
    for i in range(len(words.offsets) - 1):
        if bounds[i] < bounds[i + 1]:
            yield np.unique(hashes[bounds[i]:bounds[i + 1]])
        elif words.offsets[i] < words.offsets[i + 1]:
            yield np.array([whole(words, i)])
        else:
            yield hashes[:0]


def node_key(values: np.ndarray) -> bytes:
    """128 bits of a set of hashes."""
    sums = [mix(values ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (1, 2)]
    return np.array(sums).astype(">u8").tobytes()


def parity(values: np.ndarray) -> bytes:
    """One bit per slot, set where an odd number of values fall; at least two slots a value."""
    size = max(64, 1 << int(2 * len(values) - 1).bit_length())
    slots = (mix(values ^ np.uint64(3)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=size) & 1).astype(np.uint8).tobytes()


def set_rows(source: DataFrame, size: int) -> DataFrame:
    """(row_id, n, node, sketch, bits) of every document; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                n, nodes, sketches, bits = [], [], [], []
                for values in shingle_sets(split_words(data, offsets, SPACED), size):
                    n.append(len(values))
                    nodes.append(node_key(values) if len(values) else None)
                    sketches.append(values[:K].view(np.int64))
                    bits.append(parity(values) if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()),
                     pa.array(nodes, pa.binary()), pa.array(sketches, pa.list_(pa.int64())),
                     pa.array(bits, pa.binary())],
                    names=["row_id", "n", "node", "sketch", "bits"])

    return source.mapInArrow(run, _SETS)


def _prefixes(nodes: DataFrame, counts) -> DataFrame:
    """(node, n, centre, prefix): the rarest retained values of each node, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counts.value
        for batch in batches:
            bounds = batch.column(2).offsets.to_numpy()
            values = batch.column(2).values.to_numpy()
            n = batch.column(1).to_numpy()
            kept, centre = [], []
            for i in range(len(batch)):
                own = values[bounds[i]:bounds[i + 1]]
                length = lengths[own & (SLOTS - 1)]
                # Up to 4/5 of k a set and all its partners are whole in their sketches.
                least = -(-4 * len(own) // 5) if 5 * n[i] <= 4 * K else SHARED
                kept.append(np.sort(own[np.lexsort((own, length))[:len(own) - least + 1]]))
                centre.append(np.log2(length + 1.0).sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(centre, pa.float64()),
                 pa.array(kept, pa.list_(pa.int64()))],
                names=["node", "n", "centre", "prefix"])

    return nodes.select("node", "n", "sketch").mapInArrow(
        run, "node binary, n long, centre double, prefix array<long>")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    A-Z is lower-cased; words are runs without white space. component_id is the smallest id
    that links reach, and kept is true where it is the row's own. Rows with the same set are
    linked, whether texts are equal or not, and rows that repeat an id share its fate. A row
    without words, or without text, has an empty set and is linked with nothing: its
    component is its own id. A row without id is linked with nothing, has no component and
    is kept. Other columns are not read. The similarity must be at least 80 percent, for
    which the sketches are laid out.
    """
    if percent < 80:
        raise ValueError("sketches are laid out for 80 percent or more")
    rows, nodes, links = similar_nodes(docs, id_col, text_col, shingle, percent)
    parts = settle(components(links))
    ids = parts.join(nodes.select("node", "first_id"), "node")
    least = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = settle(
        nodes.select("node", "first_id").join(parts, "node", "left")
        .join(least, "component", "left")
        .select("node", F.coalesce("component_id", "first_id").alias("component_id")))
    label = F.coalesce("component_id", "row_id")
    return rows.select("row_id", "n", "node").join(labels, "node", "left").select(
        F.col("row_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("row_id").isNotNull(), label).alias("component_id"),
        F.coalesce(label == F.col("row_id"), F.lit(True)).alias("kept"))


def similar_nodes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
    """(rows, nodes, links): set rows of documents, their distinct nodes, links of components.

    Nodes that the first confirmed links join come as one star, so their components are
    contracted once.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    rows = settle(set_rows(source, size), TEXTS)
    nodes = settle(
        rows.filter("node is not null and row_id is not null").groupBy("node").agg(
            F.min("row_id").alias("first_id"), F.first("n").alias("n"),
            F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    )
    slots = nodes.select(F.explode("sketch").alias("value")).select(
        F.col("value").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"))
    counts = spark.sparkContext.broadcast(
        np.minimum(slot_counts(slots, "slot", SLOTS), (1 << 31) - 1).astype(np.int32))
    prefixes = settle(_prefixes(nodes, counts))
    postings = prefixes.select("node", "n", "centre", F.explode("prefix").alias("value"))
    lists = settle(
        postings.groupBy("value").agg(
            F.count(F.lit(1)).alias("m"),
            F.max(F.struct("centre", "node", "n")).alias("lead"))
        .filter("m > 1").select("value", "m", F.col("lead.node").alias("lead"),
                                F.col("lead.n").alias("lead_n"))
    )
    joined = settle(postings.drop("centre").join(lists, "value"))
    fits = 100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")
    stars = settle(
        joined.filter(fits & (F.col("node") != F.col("lead")))
        .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
        .distinct()
    )
    parts = settle(components(_confirmed(source, nodes, stars, size, percent)))
    members = settle(
        joined.filter("m > 2").select("value", "node", "m").join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    apart = settle(
        members.groupBy("value").agg(
            F.min("component").alias("least"), F.max("component").alias("most"))
        .filter("least <> most").select("value")
    )
    blocks = members.join(apart, "value").join(
        prefixes.select("node", "n", "prefix"), "node").join(
        nodes.select("node", "bits"), "node")
    more = settle(_block_pairs(blocks, percent).distinct())
    found = parts.filter("node <> component").select(
        F.col("node").alias("a"), F.col("component").alias("b"))
    return rows, nodes, found.union(_confirmed(source, nodes, more, size, percent))


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of a list in different components that may be similar.

    A list is dealt into chunks of about BLOCK members, and every pair of chunks is one
    block, so a block stays small however long the list is.
    """
    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(
        "value", (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other"))
        .cast("long").alias("block"), "node", "component", "n", "prefix", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in _runs(batches):
            pairs = _compare(value, rows, percent)
            if pairs:
                yield pa.RecordBatch.from_pylist(
                    pairs, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return dealt.repartition("value", "block").sortWithinPartitions("value", "block").mapInArrow(
        run, "a binary, b binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one block at a time, also where batches end within it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        value, block = (table.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((np.diff(value) != 0) | (np.diff(block) != 0)) + 1
        bounds = [0, *cuts.tolist(), len(value)]
        for start, stop in zip(bounds[:-2], bounds[1:-1]):
            yield value[start], table.slice(start, stop - start)
        held = table.slice(bounds[-2], bounds[-1] - bounds[-2])
    if held is not None and len(held):
        yield held.column(0)[0].as_py(), held


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of `width` bytes with the same parities."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def _compare(value: int, rows: pa.Table, percent: int) -> list[dict]:
    nodes = rows.column(2).to_pylist()
    _, part = np.unique(np.array([x.hex() for x in rows.column(3).to_pylist()]),
                        return_inverse=True)
    if part.max(initial=0) == 0:
        return []
    n = rows.column(4).to_numpy()
    prefixes = [np.array(x, np.int64) for x in rows.column(5).to_pylist()]
    bits = [np.frombuffer(x, np.uint8) for x in rows.column(6).to_pylist()]
    widths = np.array([len(x) for x in bits])
    by_width = {}
    for width in np.unique(widths):
        near = np.flatnonzero((widths == width) | (widths == 2 * width))
        by_width[width] = near, np.stack([_folded(bits[i], width) for i in near])
    found = []
    for i in range(len(nodes)):
        near, map_ = by_width[widths[i]]
        apart = np.bitwise_count(map_ ^ bits[i]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(n[near], n[i]), np.maximum(n[near], n[i])
        # |x - y| + |y - x| of linked sets is at most (100 - p) / (100 + p) of |x| + |y|.
        may = ((100 + percent) * apart <= (100 - percent) * (small + large)) \
            & (100 * small >= percent * large) & (part[near] != part[i])
        may &= (widths[near] != widths[i]) | (near > i)
        for j in near[may]:
            # A pair may meet in many lists; the first of them reports it.
            if np.intersect1d(prefixes[i], prefixes[j], assume_unique=True)[0] == value:
                a, b = sorted((nodes[i], nodes[j]))
                found.append({"a": a, "b": b})
    return found


def _confirmed(
    source: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int
) -> DataFrame:
    """The pairs (a, b) whose united sketch and then whole sets reach the similarity."""
    side = nodes.select("node", "sketch", "first_id")
    both = (
        pairs.join(side.select(F.col("node").alias("a"), F.col("sketch").alias("sa"),
                               F.col("first_id").alias("ia")), "a")
        .join(side.select(F.col("node").alias("b"), F.col("sketch").alias("sb"),
                          F.col("first_id").alias("ib")), "b")
    )
    united = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(united, F.array_intersect("sa", "sb")))
    # Half of the sample is six standard errors below 0.8.
    likely = settle(both.filter(2 * shared >= F.size(united)).select("a", "b", "ia", "ib"))
    ends = likely.select(F.col("a").alias("node"), F.col("ia").alias("row_id")).union(
        likely.select("b", "ib"))
    sets = settle(_whole_sets(source, ends, size), TEXTS)
    common = F.size(F.array_intersect("xa", "xb"))
    return (
        likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
        .filter(100 * common >= percent * (F.size("xa") + F.size("xb") - common))
        .select("a", "b")
    )


def _whole_sets(source: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted (node, row_id), read again from the texts.

    A bitmap of fixed size picks the texts, so that no text is shuffled for it; a chance
    match in it costs a row that no pair asks for.
    """
    number = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    slot = number.bitwiseXOR(F.col("row_id")).bitwiseAND(F.lit(WANTED - 1)).cast("int")
    bitmap = source.sparkSession.sparkContext.broadcast(np.packbits(
        slot_counts(ends.select(slot.alias("slot")), "slot", WANTED) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bitmap.value, set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in text_slices(batch.column(1)):
                found = {}
                for i, values in enumerate(
                        shingle_sets(split_words(data, offsets, SPACED), size), first):
                    if not len(values) or ids[i] is None:
                        continue
                    node = node_key(values)
                    at = (int.from_bytes(node[:8], "big") ^ ids[i]) & (WANTED - 1)
                    if wanted[at >> 3] >> (7 - (at & 7)) & 1 and node not in seen:
                        seen.add(node)
                        found[node] = values.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()),
                     pa.array(list(found.values()), pa.list_(pa.int64()))],
                    names=["node", "shingles"])

    return source.mapInArrow(run, "node binary, shingles array<long>").groupBy("node").agg(
        F.first("shingles").alias("shingles"))
