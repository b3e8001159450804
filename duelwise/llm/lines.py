"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words. Of lines of equal sets the earliest one is compared with
others; the rest are copies, which go. Words are ordered by rarity over all texts; a line of
n distinct words is listed under its n - ceil(0.8 n) + 1 rarest ones, and any two lines of
similarity 0.8 meet in such a list. A list compares its lines in order of their place, by
length, by the places of the shared word, and by a parity bitmap that can only
underestimate a difference. Whole sets then confirm the pairs. A line goes if any earlier
line is similar to it.

In a first turn each line is compared with its earliest possible partner alone; a line that
this one does not confirm, and that has more, is compared with all of them in a second turn.
So a group of n similar lines makes about n pairs.

Lines and list entries are dealt into buckets, whose number grows with the input. What a task
sends to a bucket is one row, whose columns are the bytes of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelwise.llm.columns import let
from duelwise.llm.scratch import TEXTS, settle, slot_counts, small_batches
from duelwise.llm.words import SPACED, hash_words, lower_case, mix, runs, text_slices

#: Slots of the array of word counts, which orders words by rarity.
SLOTS = 1 << 20
#: Slots of a bitmap of wanted documents, lines or words.
WANTED = 1 << 22
#: Lists that may be longer are dealt into pairs of chunks of about this length.
CHUNK = 1 << 16
#: Lists up to this length are compared together with others, longer ones each by itself.
SHORT = 512
#: Pairs compared at once.
TILE = 1 << 18
#: Words of the texts, and list entries, of an average bucket.
BUCKET_WORDS, BUCKET_ENTRIES = 1 << 21, 1 << 17
#: Numbers that a task holds before it deals them into buckets.
HELD = 1 << 19
#: Rows of arrays that a task hands to Python at once.
ROWS = 16
_LAST = (1 << 63) - 1
#: A row's id; the hash of its text in the upper half, the line's number in the lower one.
_PLACE = ["id", "spot"]
#: 128 bits of a line's set.
_NODE = ["node0", "node1"]
_LINE = dict.fromkeys([*_PLACE, *_NODE, "sig0", "sig1"], "i8") | {"n": "i4"}
#: The form is the word's place in the line, and whether the line is open.
_ENTRY = dict.fromkeys(["list", *_PLACE, "sig0", "sig1"], "i8") | {"n": "i4", "form": "i4"}


def _packed(columns: list[np.ndarray], bounds: np.ndarray) -> list[pa.Array]:
    """Columns of bytes; row i of each holds its values from bounds[i] to bounds[i + 1]."""
    return [pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)),
        pa.py_buffer(np.ascontiguousarray(x))]) for x in columns]


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """The values of all rows of such a column."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, kind)
    offsets = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(kind)


def _bytes_of(*names: str) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in names)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Sorted rows in runs that end where a bucket ends."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        bucket = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(bucket) != 0)
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if held and held[-1].column(0)[-1].as_py() != bucket[0]:
            yield held
            held = []
        if cut:
            yield [*held, batch.slice(0, cut)]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield held


def _joined(batches: list[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([_values(b.column(c), kind) for b in batches])
            for c, kind in kinds.items()}


def _spans(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of spans one after the other, and the bounds of the spans among them."""
    bounds = np.append(0, np.cumsum(length))
    return np.repeat(first - bounds[:-1], length) + np.arange(bounds[-1]), bounds


class _Lines:
    """Distinct words of the lines of a run of texts, rarest first."""

    def __init__(self, data, offsets, counts=None, wanted=None):
        data = lower_case(data)
        start, end = runs(data, offsets, SPACED)
        breaks = np.flatnonzero(data == 10)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        line = np.searchsorted(breaks, start) + text
        begins = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)
        if wanted is not None:
            at = np.flatnonzero(np.diff(line, prepend=-1))
            few = np.repeat(wanted(text[at], line[at] - begins[text[at]]),
                            np.diff(np.append(at, len(line))))
            start, end, text, line = start[few], end[few], text[few], line[few]
        hashes = hash_words(data, start, end)
        rarity = counts[hashes & np.uint64(SLOTS - 1)] if counts is not None else None
        order = _order(hashes, rarity, line)
        token, line, text = hashes[order], line[order], text[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        starts = np.ones(len(token), bool)
        starts[1:] = line[1:] != line[:-1]
        at = np.flatnonzero(starts)
        self.words = np.diff(np.append(at, len(token)))
        self.token = token[new]
        self.first = np.flatnonzero(starts[new])
        self.n = np.diff(np.append(self.first, len(self.token)))
        self.text = text[at]
        self.line = line[at] - begins[self.text]

    def tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens of some lines, with their bounds."""
        flat, bounds = _spans(self.first[rows], self.n[rows])
        return self.token[flat], bounds


def _order(token: np.ndarray, rarity: np.ndarray | None, line: np.ndarray) -> np.ndarray:
    """Order by line, rarity and word, by one key if that settles it."""
    if rarity is not None:
        rarity = np.minimum(rarity, (1 << 22) - 1).astype(np.uint64)
    if len(line) and line[-1] < 1 << 20:
        key = (token >> np.uint64(20)) if rarity is None else (
            rarity << np.uint64(22)) | (token >> np.uint64(42))
        key |= line.astype(np.uint64) << np.uint64(44)
        order = np.argsort(key)
        key, own = key[order], token[order]
        if not ((key[1:] == key[:-1]) & (own[1:] != own[:-1])).any():
            return order
    return np.lexsort((token, line) if rarity is None else (token, rarity, line))


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Up to three words, 80 percent means equal sets, which need no list."""
    length = n - -(-percent * n // 100) + 1
    return np.where((n + 1) * percent > 100 * n, 0, length)


def _keys(id_col: str, text_col: str) -> list:
    """What tells a row from others: its id, and 32 bits of its text."""
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"),
            F.hash(f"`{text_col}`").alias("part")]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text"))


def _earliest(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the earliest of their sets, and which are copies at other places."""
    order = np.lexsort([rows[c] for c in (*_PLACE[::-1], *_NODE[::-1])])
    id_, spot, *node = (rows[c][order] for c in (*_PLACE, *_NODE))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in node], axis=0)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[new], order[(id_ != id_[begin]) | (spot != spot[begin])]


def _one_of_each_set(
    rows: dict[str, np.ndarray], percent: int, buckets: int | None = None
) -> pa.RecordBatch:
    """A row of arrays for each bucket, or one for all. Copies are spread evenly."""
    few, copies = _earliest(rows)
    bounds = np.array([0, len(few)])
    number = np.zeros(1, np.int32)
    if buckets:
        bucket = (rows["node0"][few].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        few, number = few[order], np.arange(buckets, dtype=np.int32)
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    length = _prefix_length(rows["n"].astype(np.int64), percent)
    flat, ends = _spans((np.cumsum(length) - length)[few], length[few])
    shares = np.linspace(0, len(copies), len(number) + 1).astype(np.int64)
    if "copy_id" in rows:
        copied = [np.append(rows[f"copy_{c}"], rows[c][copies]) for c in _PLACE]
        shares = np.array([0, len(copied[0])])
    else:
        copied = [rows[c][copies] for c in _PLACE]
    return pa.RecordBatch.from_arrays(
        [pa.array(number), *_packed([rows[c][few] for c in _LINE], bounds),
         *_packed([rows["words"][flat]], ends[bounds]), *_packed(copied, shares)],
        names=["bucket", *_LINE, "words", *(f"copy_{c}" for c in _PLACE)])


def _line_rows(
    source: DataFrame, counts, min_words: int, percent: int, buckets: int
) -> DataFrame:
    """Rows of arrays: the different lines of min_words or more, their listed words, copies.

    A task sends the earliest line of each of its sets to the set's bucket, so a set that
    occurs very often is no large group there.
    """
    kinds = _LINE | {"words": "i4"} | {f"copy_{c}": "i8" for c in _PLACE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            id_, part = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            for first, data, offsets in text_slices(batch.column(2)):
                found = _Lines(data, offsets, counts.value)
                rows = np.flatnonzero(found.words >= min_words)
                if not len(rows):
                    continue
                token, bounds = found.tokens(rows)
                n, at = found.n[rows], bounds[:-1]
                node = [np.add.reduceat(mix(token ^ np.uint64(i + 1)), at) for i in (0, 1)]
                slot = token >> np.uint64(57)
                bit = np.uint64(1) << (slot & np.uint64(63))
                sig = [np.bitwise_xor.reduceat(np.where((slot >= 64) == high, bit, np.uint64(0)), at)
                       for high in (False, True)]
                flat, _ = _spans(at, _prefix_length(n, percent))
                whose = found.text[rows] + first
                held.append({
                    "id": id_[whose], "spot": (part[whose] << 32) | found.line[rows],
                    "node0": node[0].view(np.int64), "node1": node[1].view(np.int64),
                    "sig0": sig[0].view(np.int64), "sig1": sig[1].view(np.int64),
                    "n": n.astype(np.int32),
                    "words": (token[flat] >> np.uint64(20)).astype(np.uint32).view(np.int32)})
                size += 10 * len(rows) + len(flat)
                if size >= HELD:
                    yield _one_of_each_set(_stacked(held), percent, buckets)
                    held, size = [], 0
        if held:
            yield _one_of_each_set(_stacked(held), percent, buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_buckets(batches):
            yield _one_of_each_set(_joined(some, kinds), percent)

    shape = _bytes_of(*kinds)
    return source.mapInArrow(run, shape).repartition("bucket").sortWithinPartitions(
        "bucket").mapInArrow(merge, shape)


def _stacked(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def _copies(lines: DataFrame) -> DataFrame:
    """(id, spot) of the lines whose sets occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(_values(batch.column(i), "i8")) for i in (0, 1)], names=_PLACE)

    return lines.select(*(f"copy_{c}" for c in _PLACE)).mapInArrow(run, "id long, spot long")


#: Slots whose counts are one row.
_BLOCK = 1 << 12


def _word_counts(source: DataFrame) -> np.ndarray:
    """How often words occur, by slot."""

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())],
            names=["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                data = lower_case(data)
                hashes = hash_words(data, *runs(data, offsets, SPACED))
                np.add.at(total, (hashes & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        blocks = total.reshape(-1, _BLOCK)
        for first in range(0, len(blocks), 64):
            yield rows({i: blocks[i] for i in range(first, first + 64) if blocks[i].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = _values(batch.column(1), "i8").reshape(-1, _BLOCK)
            for block, x in zip(batch.column(0).to_pylist(), values):
                total[block] = total.get(block, 0) + x
        if total:
            yield rows(total)

    shape = "block int, counts binary"
    with small_batches(source.sparkSession, TEXTS):
        found = source.select("text").mapInArrow(count, shape).repartition("block").mapInArrow(
            add, shape).toArrow()
    out = np.zeros((SLOTS // _BLOCK, _BLOCK), np.int64)
    for block, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[block] = np.frombuffer(x, np.int64)
    return out.reshape(-1)


def _slots():
    """The slot of a place; `_slot_of` gives the same in a task."""
    slot = F.col("id").bitwiseXOR(F.shiftright("spot", 29)).bitwiseXOR(F.shiftleft("spot", 9))
    return slot.bitwiseAND(F.lit(WANTED - 1)).cast("int")


def _slot_of(id_: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (id_ ^ (spot >> 29) ^ (spot << 9)) & (WANTED - 1)


def _bitmap(places: DataFrame):
    """A bitmap of fixed size with the slots of some places."""
    seen = slot_counts(places.select(_slots().alias("slot")), "slot", WANTED) > 0
    return places.sparkSession.sparkContext.broadcast(np.packbits(seen))


def _marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0


def _postings(
    lines: DataFrame, lengths, buckets: int, percent: int, words=None, open_=None
) -> DataFrame:
    """Rows of arrays: an entry per listed word of a line, in the bucket of its list.

    With bitmaps: of marked words; open lines marked. A list is a word and a block.
    """
    kinds = _LINE | {"words": "i4"}

    def entries(rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        word, length = rows["words"], _prefix_length(rows["n"].astype(np.int64), percent)
        which = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
        marked = np.ones(len(length), bool)
        if words is not None:
            few = _marked(words.value, _word_slot(word, WANTED))
            which, place, word = which[few], place[few], word[few]
            marked = _marked(open_.value, _slot_of(rows["id"], rows["spot"]))
        many = lengths.value[_word_slot(word, len(lengths.value))]
        chunks = np.maximum(1, -(-many // CHUNK))
        for block, some in _dealt(which, chunks, rows["node0"].view(np.uint64)):
            at = which[some]
            yield {"list": (word[some].astype(np.int64) << 32) | block,
                   **{c: rows[c][at] for c in (*_PLACE, "sig0", "sig1", "n")},
                   "form": ((place[some] << 1) | marked[at]).astype(np.int32)}

    def deal(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        bucket = (mix(rows["list"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(bounds))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)),
             *_packed([rows[c][order] for c in _ENTRY], np.append(bounds[some], bounds[-1]))],
            names=["bucket", *_ENTRY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(len(batch)):
                for some in entries(_joined([batch.slice(i, 1)], kinds)):
                    held.append(some)
                    size += len(some["list"])
                    if 2 * size >= HELD:
                        yield deal(_stacked(held))
                        held, size = [], 0
        if held:
            yield deal(_stacked(held))

    return lines.select(*kinds).mapInArrow(run, _bytes_of(*_ENTRY))


def _word_slot(word: np.ndarray, slots: int) -> np.ndarray:
    return (mix(word.astype(np.int64).view(np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


def _dealt(which: np.ndarray, chunks: np.ndarray, node: np.ndarray):
    """(block, rows): lists of one chunk whole, the others once per pair of chunks."""
    one = np.flatnonzero(chunks == 1)
    yield np.zeros(len(one), np.int64), one
    for k in np.unique(chunks[chunks > 1]):
        rows = np.flatnonzero(chunks == k)
        chunk = (node[which[rows]] % np.uint64(k)).astype(np.int64)
        for other in range(k):
            yield np.minimum(chunk, other) * k + np.maximum(chunk, other), rows


def _partners(postings: DataFrame, percent: int, named: int | None) -> DataFrame:
    """(x_id, x_spot, y_id, y_spot, more): x is earlier and may be similar."""
    names = [f"{s}_{c}" for s in "xy" for c in _PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_buckets(batches):
            rows = _listed(_joined(some, _ENTRY))
            x, y, more = _list_pairs(rows, percent, named)
            for s in range(0, len(x), 1 << 16):
                part = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(rows[c][side[part]]) for side in (x, y) for c in _PLACE),
                     pa.array(more[part])], names=[*names, "more"])

    return postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        run, ", ".join(f"{c} long" for c in names) + ", more boolean")


def _listed(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The lists of two lines or more, each in order of the lines' places."""
    order = np.argsort(rows["list"])
    list_ = rows["list"][order]
    same = list_[1:] == list_[:-1]
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    order = order[np.lexsort([rows[c][order] for c in (*_PLACE[::-1], "list")])]
    form = rows["form"][order]
    return {c: rows[c][order] for c in ("list", *_PLACE, "sig0", "sig1")} | {
        "n": rows["n"][order].astype(np.int64), "pos": (form >> 1).astype(np.int64),
        "marked": (form & 1).astype(bool)}


def _may(rows, x, y, percent: int) -> np.ndarray:
    """Whether lines x and y of a list pass the filters of length, place and bitmap."""
    nx, ny = rows["n"][x], rows["n"][y]
    left = 1 + np.minimum(nx - 1 - rows["pos"][x], ny - 1 - rows["pos"][y])
    good = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) \
        & ((100 + percent) * left >= percent * (nx + ny))
    # The bitmaps only of those that are left.
    x, y = (np.broadcast_to(v, good.shape)[good] for v in (x, y))
    apart = sum(np.bitwise_count((rows[c][x] ^ rows[c][y]).view(np.uint64)).astype(np.int64)
                for c in ("sig0", "sig1"))
    good[good] = (100 + percent) * apart <= (100 - percent) * (rows["n"][x] + rows["n"][y])
    return good


def _list_pairs(rows: dict[str, np.ndarray], percent: int, named: int | None):
    """Possible pairs (x before y) within lists; y must be marked."""
    size = len(rows["list"])
    if not size:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, bool)
    new = np.ones(size, bool)
    new[1:] = rows["list"][1:] != rows["list"][:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    rank = np.arange(size) - begin
    length = np.diff(np.append(np.flatnonzero(new), size))[np.cumsum(new) - 1]
    none = np.empty(0, np.int64)
    xs, ys, mores = [none], [none], [np.empty(0, bool)]
    later = np.flatnonzero((length <= SHORT) & (rank > 0) & rows["marked"])
    ends = np.cumsum(rank[later])
    first = 0
    while first < len(later):
        # Some lines, each against all earlier ones of its list.
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + TILE, "right")))
        y = later[first:last]
        x, _ = _spans(begin[y], rank[y])
        at = np.repeat(np.arange(len(y)), rank[y])
        good = _may(rows, x, y[at], percent)
        x, at = x[good], at[good]
        more = np.zeros(len(x), bool)
        if named is not None:
            few = np.arange(len(at)) - np.searchsorted(at, at) < named
            more = np.bincount(at, minlength=len(y))[at] > named
            x, at, more = x[few], at[few], more[few]
        xs.append(x)
        ys.append(y[at])
        mores.append(more)
        first = last
    for first in np.flatnonzero(new & (length > SHORT)):
        for x, y, more in _long_list(rows, first, first + length[first], percent, named):
            xs.append(x)
            ys.append(y)
            mores.append(more)
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(mores)


def _long_list(rows: dict[str, np.ndarray], first: int, last: int, percent: int, named):
    """The same for one list, by tiles; a line stops once it has named enough."""
    for top in range(first, last, 256):
        y = np.arange(top, min(top + 256, last))
        y = y[rows["marked"][y]]
        got = np.zeros(len(y), np.int64)
        found = []
        for start in range(first, min(top + 256, last), 1024):
            on = np.flatnonzero(got <= named) if named is not None else np.arange(len(y))
            if not len(on):
                break
            x = np.arange(start, min(start + 1024, last))
            good = _may(rows, x[None, :], y[on, None], percent) & (x[None, :] < y[on, None])
            order = got[on, None] + np.cumsum(good, axis=1)
            if named is not None:
                got[on] = order[:, -1]
                good &= order <= named
            at, which = np.nonzero(good)
            found.append((x[which], on[at]))
        for x, at in found:
            more = got[at] > named if named is not None else np.zeros(len(at), bool)
            yield x, y[at], more


def _confirmed(source: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(id, spot) of the later lines whose whole sets reach the similarity."""
    ends = pairs.select(*(F.col(f"x_{c}").alias(c) for c in _PLACE)).union(
        pairs.select(*(f"y_{c}" for c in _PLACE)))
    line = F.lit(0xFFFFFFFF)
    texts = _bitmap(ends.withColumn("spot", F.col("spot").bitwiseAND(F.bitwise_not(line))))
    wanted = _bitmap(ends)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_, part = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            few = np.flatnonzero(_marked(texts.value, _slot_of(id_, part << 32)))
            id_, part = id_[few], part[few]
            for first, data, offsets in text_slices(batch.column(2).take(pa.array(few))):
                found = _Lines(data, offsets, wanted=lambda text, line: _marked(
                    wanted.value, _slot_of(id_[text + first], (part[text + first] << 32) | line)))
                if not len(found.n):
                    continue
                token, bounds = found.tokens(np.arange(len(found.n)))
                whose = found.text + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(id_[whose]), pa.array((part[whose] << 32) | found.line),
                     pa.ListArray.from_arrays(bounds.astype(np.int32), token.view(np.int64))],
                    names=[*_PLACE, "tokens"])

    shape = "id long, spot long, tokens array<long>"
    sets = settle(source.mapInArrow(choose, shape).dropDuplicates(_PLACE), TEXTS)
    for side in "xy":
        pairs = pairs.join(sets.select(*(F.col(c).alias(f"{side}_{c}") for c in _PLACE),
                                       F.col("tokens").alias(side)),
                           [f"{side}_{c}" for c in _PLACE])
    common = F.size(F.array_intersect("x", "y"))
    return pairs.filter(
        100 * common >= percent * (F.size("x") + F.size("y") - common)
    ).select(*(F.col(f"y_{c}").alias(c) for c in _PLACE)).distinct()


def removed_lines(
    docs: DataFrame, id_col: str, text_col: str, min_words: int, percent: int
) -> DataFrame:
    """(id, part, removed): ascending numbers of the lines to remove, per (id, part)."""
    spark = docs.sparkSession
    source = _source(docs, id_col, text_col)
    counts = _word_counts(source)
    buckets = 1 + int(counts.sum()) // BUCKET_WORDS
    counts = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    lines = settle(_line_rows(source, counts, min_words, percent, buckets), TEXTS)
    # Slots of 4096 entries on average: only a list that is long alone counts as long.
    entries = (lines.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 4
    slots = 1 << min(24, max(12, (entries // 4096).bit_length()))
    lengths = spark.sparkContext.broadcast(_list_lengths(lines, slots, percent))
    buckets = 1 + entries // BUCKET_ENTRIES
    x = F.struct(*(f"x_{c}" for c in _PLACE))
    pairs = settle(
        _partners(_postings(lines, lengths, buckets, percent), percent, 1)
        .groupBy(*(f"y_{c}" for c in _PLACE))
        .agg(F.min(x).alias("x"), (F.max("more") | (F.min(x) < F.max(x))).alias("more"))
        .select("x.*", *(f"y_{c}" for c in _PLACE), "more"), ROWS)
    similar = settle(_confirmed(source, pairs, percent))
    still = settle(
        pairs.filter("more").select(*(F.col(f"y_{c}").alias(c) for c in _PLACE))
        .join(similar, _PLACE, "left_anti")
    )
    if not still.isEmpty():
        open_ = _bitmap(still)
        words = spark.sparkContext.broadcast(
            np.packbits(_list_lengths(lines, WANTED, percent, open_) > 0))
        again = _partners(
            _postings(lines, lengths, buckets, percent, words, open_), percent, None)
        more = settle(again.select(*(f"{s}_{c}" for s in "xy" for c in _PLACE)).distinct(), ROWS)
        similar = similar.union(_confirmed(source, more, percent))
    line = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return _copies(lines).union(similar).groupBy(
        "id", F.shiftright("spot", 32).cast("int").alias("part")).agg(
        F.sort_array(F.collect_set(line)).alias("removed"))


def _list_lengths(lines: DataFrame, slots: int, percent: int, open_=None) -> np.ndarray:
    """Lengths of the lists of words of all lines, or of those marked, by slot."""
    kinds = {"words": "i4"} | ({} if open_ is None else {c: _LINE[c] for c in (*_PLACE, "n")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            rows = _joined([batch], kinds)
            word = rows["words"]
            if open_ is not None:
                marked = _marked(open_.value, _slot_of(rows["id"], rows["spot"]))
                word = word[np.repeat(
                    marked, _prefix_length(rows["n"].astype(np.int64), percent))]
            total += np.bincount(_word_slot(word, slots), minlength=slots)
        slot = np.flatnonzero(total)
        for start in range(0, len(slot), 1 << 16):
            some = slot[start:start + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "c"])

    counted = lines.select(*kinds).mapInArrow(run, "slot int, c long")
    return slot_counts(counted, "slot", slots, "c", ROWS)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1,
    percent: int = 80, out: str = "line_report",
) -> DataFrame:
    """All columns of `docs`, the text without repeated lines, and `out`, a name new to `docs`.

    A line is a piece of the text between line feeds; its set holds its words (runs without
    white space, A-Z lower-cased). A line of min_words words or more goes if a line that
    comes earlier, by id and then by line number, reaches the similarity. Blank lines, and
    those of fewer words, stay. `out` is a struct of n_lines and removed (numbers of the lines, from
    0). A null text has no lines and stays null; a null id comes last; of rows with one id
    and different texts the order is that of a hash; rows alike in id and text are one
    document and lose the same lines. The similarity must be at least 80 percent.
    """
    if percent < 80:
        raise ValueError("equal short sets are taken for granted from 80 percent on")
    removed = removed_lines(docs, id_col, text_col, min_words, percent)
    names = docs.columns
    others = [docs[f"`{c}`"] for c in names if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"),
                       *_keys(id_col, text_col), docs[f"`{text_col}`"].alias("text"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))

    def rest(pieces: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "\n")

    kept = F.when(F.size(gone) == 0, F.col("text")).otherwise(
        let(F.split("text", "\n", -1), rest))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    report = F.struct(F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
                      gone.alias("removed"))
    return rows.join(removed, ["id", "part"], "left").select(
        *((kept if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names),
        report.alias(out))
