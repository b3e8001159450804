"""Packing token ids into sequences by minimum bin slack.

Documents become ids, and full windows are cut off at once. What is left of each document
is shorter than a window; how many rests there are of each length is all that the search for
good windows needs, a histogram of at most one row per length, whatever the input. A window
begins with the longest rest; a bitset of the sums that shorter ones can reach, shifted by
each length as often as it is there, shows the sum closest to the room left, and going back
through the bitsets gives how often each length is in it. That pattern is used as often as
its lengths last. Where it leaves a slack, one more rest is cut to fill it, and its other
part joins the lengths. Ranks of the rests, counted in the tasks, then find their windows.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelwise.llm.scratch import TEXTS, settle

#: Runs of white space from this length on are left to the tokenizer itself.
LONG = 10_000
#: Bits of a key of length, start and rank.
KEY = 62


def best_fill(counts: list[int], room: int) -> Counter:
    """{length: times} of the lengths at hand whose sum is closest to `room`, not above.

    Longer ones are tried first, so that short ones are left for later windows.
    """
    full, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(counts[length], room // length)
        times = 1
        while left and not bits >> room & 1:
            take = min(times, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & full
            left -= take
            times *= 2
        if bits >> room & 1:
            break
    rest, found = bits.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            found[length] += take
            rest -= length * take
    return found


class Lots:
    """Rests that still wait, in runs (length at first, low rank, high rank, ids placed)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.counts = [0] * (capacity + 1)
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]
        for length, n in counts.items():
            self.add(length, (length, 0, n, 0))

    def add(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.runs[length].append(run)
        self.counts[length] += run[2] - run[1]

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.counts[length] -= n
        while n:
            first, low, high, start = self.runs[length].popleft()
            middle = min(high, low + n)
            if middle < high:
                self.runs[length].appendleft((first, middle, high, start))
            n -= middle - low
            yield first, low, middle, start


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, start, low, high, size, window, turn, per, offset).

    Of the rests of `length` ids with a rank from low to before high, `size` ids from `start`
    are in windows from `window` on, `per` of them in each, from `offset` on; the one of rank
    low is the `turn`-th such. Windows are full; the ids that are left in the end fill
    windows of powers of two.
    """
    lots, rows, window = Lots(counts, capacity), [], 0
    total = sum(length * n for length, n in counts.items())
    longest = capacity

    def place(length: int, size: int, per: int, windows: int, offset: int) -> None:
        turn = 0
        for first, low, high, start in list(lots.take(length, per * windows)):
            rows.append((first, start, low, high, size, window, turn, per, offset))
            turn += high - low
            if size < length:
                lots.add(length - size, (first, low, high, start + size))

    while total:
        room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        while not lots.counts[longest]:
            longest -= 1
        chosen = Counter()
        if longest <= room:
            lots.counts[longest] -= 1
            chosen = best_fill(lots.counts, room - longest)
            lots.counts[longest] += 1
            chosen[longest] += 1
        slack = room - sum(length * n for length, n in chosen.items())
        needs, cut = chosen.copy(), 0
        if slack:
            # A rest that is left is longer than the slack, else it would be in the window.
            cut = next(x for x in range(longest, 0, -1) if lots.counts[x] > chosen[x])
            needs[cut] += 1
        windows = min(lots.counts[x] // n for x, n in needs.items())
        windows = max(1, min(windows, total // room))
        offset = 0
        for length, per in sorted(chosen.items(), reverse=True):
            place(length, length, per, windows, offset)
            offset += length * per
        if slack:
            place(cut, slack, 1, windows, offset)
        total -= room * windows
        window += windows
    return np.array(sorted(rows), np.int64).reshape(-1, 9)


class Encoder:
    """Ids of texts by a tokenizer file; by its table of ranks, where one is given.

    The table is the same vocabulary for a faster library, which gives the same ids; only
    texts that hold an added token of the tokenizer are left to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.fast, self.added = None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                pairs = map(bytes.split, file)
                table = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
            self.fast = tiktoken.Encoding(
                os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens={})
            added = self.slow.get_added_tokens_decoder().values()
            self.added = re.compile("|".join(
                [re.escape(t.content) for t in added] + [rf"\s{{{LONG},}}"]))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if self.fast is not None and not self.added.search(text):
                yield np.array(self.fast.encode_ordinary(text), np.uint32)
            else:
                yield np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


#: Encoders of this Python worker, read once.
_READ: dict[tuple, Encoder] = {}


def _encoder(*files: str | None) -> Encoder:
    if files not in _READ:
        _READ[files] = Encoder(*files)
    return _READ[files]


def _column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def token_windows(
    docs: DataFrame, files: tuple[str | None, ...], capacity: int, end: int, id_col: str,
    text_col: str,
) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids, task, turn) of full windows and rests.

    turn numbers the rows of a task and length, so that ranks need no shuffle of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            row, tokens, start, length, ids, turn = [], [], [], [], [], []
            for i, found in enumerate(_encoder(*files).ids(texts)):
                data = np.append(found, np.uint32(end)).astype("<u4").tobytes()
                n = len(data) // 4
                for low in range(0, n, capacity):
                    size = min(capacity, n - low)
                    row.append(i)
                    tokens.append(n)
                    start.append(low)
                    length.append(size)
                    ids.append(data[4 * low:4 * (low + size)])
                    turn.append(seen[size])
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(tokens, pa.int64()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int64()),
                 pa.array(turn, pa.int64())],
                names=["doc_id", "doc_tokens", "start", "length", "ids", "task", "turn"])

    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, (
        f"doc_id {_column_type(given, 'doc_id')}, doc_tokens long, start long, length long,"
        " ids binary, task long, turn long"))


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1,
    id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece.

    `tokenizer` is the path of a tokenizer file that every executor can read; `ranks`, the
    path of the same vocabulary as ranks, and `pattern`, which splits its words, make that
    faster. A document's
    ids are those of its text, without special ones added, and `end` after them; a null text
    is empty, so its only id is `end`. Pieces of a document are gapless; ids are unsigned
    32-bit little-endian bytes. Sequences are numbered without gaps from 0 and hold
    `capacity` ids, but for a last few whose lengths are powers of two, so none needs
    padding. Rests are cut only where no set of them fills a window. Repeated rows and rows
    without id are documents of their own; an empty table gives no rows.
    """
    if capacity not in {1 << i for i in range(14)}:
        raise ValueError("the capacity is a power of two up to 8192")
    rows = settle(token_windows(
        docs, (tokenizer, ranks, pattern), capacity, end, id_col, text_col), TEXTS)
    groups = settle(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # At most one row per length, for any number of documents.
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    found = plan(counts, capacity)
    ranked = rows.join(groups.drop("n"), ["task", "length"]).select(
        "doc_id", "doc_tokens", "start", "length", "ids",
        (F.col("base") + F.col("turn")).alias("rank"))

    ranks = KEY - 2 * (capacity.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (found[:, 0] * capacity + found[:, 1] << ranks) + found[:, 2]
        for batch in batches:
            begin, length, rank = (batch.column(i).to_numpy() for i in (2, 3, 5))
            row, start, size, sequence, offset = [], [], [], [], []
            whole = np.flatnonzero(length == capacity)
            row.append(whole)
            start.append(np.zeros(len(whole), np.int64))
            size.append(length[whole])
            sequence.append(rank[whole])
            offset.append(np.zeros(len(whole), np.int64))
            open_ = np.flatnonzero(length < capacity)
            placed = np.zeros(len(open_), np.int64)
            while len(open_):
                wanted = (length[open_] * capacity + placed << ranks) + rank[open_]
                _, _, low, _, taken, window, turn, per, at = found[
                    np.searchsorted(key, wanted, "right") - 1].T
                turn = turn + rank[open_] - low
                row.append(open_)
                start.append(placed)
                size.append(taken)
                sequence.append(full + window + turn // per)
                offset.append(at + turn % per * taken)
                placed = placed + taken
                more = placed < length[open_]
                open_, placed = open_[more], placed[more]
            row, start, size = (np.concatenate(x) for x in (row, start, size))
            ids = batch.column(4)
            pieces = [ids[r].as_buffer()[4 * s:4 * (s + n)].to_pybytes()
                      for r, s, n in zip(row.tolist(), start.tolist(), size.tolist())]
            chosen = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), pa.array(begin[row] + start), pa.array(size),
                 pa.array(pieces, pa.binary()), batch.column(1).take(chosen),
                 pa.array(np.concatenate(sequence)), pa.array(np.concatenate(offset))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, (
        f"doc_id {_column_type(rows, 'doc_id')}, start long, length long, ids binary,"
        " doc_tokens long, sequence_id long, offset long"))
