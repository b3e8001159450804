"""Fill-in-the-middle texts by piece tables.

A text is never edited. It is a list of pieces (buffer, start, length) over two buffers that
do not change: the text's own bytes and the sentinels. Cutting splits a piece in two, an
arrangement permutes the pieces and puts sentinels between them, and the inverse permutation
of the pieces found in an arranged text gives back the original. Texts are written, and
hashed, by going through the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelwise.llm.columns import free_name
from duelwise.llm.words import text_slices

#: Fixed values of the published form: sentinels before prefix, suffix and middle.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts by form.
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")
#: Of a hundred texts so many stay plain, and so many of the others put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

PIECES = "array<struct<buffer:string,start:bigint,length:bigint>>"
REPORT = (f"struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,pieces:{PIECES},"
          "text:string,output_sha256:string,restored_sha256:string>")

_codes = np.arange(256)
_LETTER = ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))
_INNER = (_codes >= 128) & (_codes < 192)  # bytes within a character


class Piece(NamedTuple):
    buffer: str
    start: int
    length: int


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The pieces with an edge at byte `at` of what they spell. A piece may be empty."""
    out, seen, done = [], 0, False
    for piece in pieces:
        inside = at - seen
        if not done and inside <= piece.length:
            out += [piece._replace(length=inside),
                    piece._replace(start=piece.start + inside, length=piece.length - inside)]
            done = True
        else:
            out.append(piece)
        seen += piece.length
    return out


def arrange(pieces: list[Piece], form: str) -> list[Piece]:
    """(prefix, middle, suffix) in the order of the form, each behind its sentinel."""
    named = dict(zip(PARTS, pieces))
    out = []
    for part in ORDERS[form]:
        out += [Piece(part, 0, len(SENTINELS[part])), named[part]]
    return out


def found_parts(output: bytes, form: str) -> list[Piece]:
    """The pieces of an arranged text, in its own order; sentinels are left out.

    Texts that hold a sentinel are never arranged, and no sentinel overlaps another, so the
    first place of each is the one that was put there.
    """
    out, place = [], 0
    for part in ORDERS[form]:
        mark = output.index(SENTINELS[part], place)
        if out:
            out[-1] = out[-1]._replace(length=mark - out[-1].start)
        place = mark + len(SENTINELS[part])
        out.append(Piece("text", place, len(output) - place))
    return out


def inverse(pieces: list[Piece], form: str) -> list[Piece]:
    """Parts in the order of the form, put back as prefix, middle, suffix."""
    return [pieces[ORDERS[form].index(part)] for part in PARTS]


def spans(pieces: list[Piece], text: memoryview) -> Iterator[memoryview | bytes]:
    for buffer, start, length in pieces:
        source = text if buffer == "text" else SENTINELS[buffer]
        yield source[start:start + length]


def digest(pieces: list[Piece], text: memoryview) -> str:
    seen = hashlib.sha256()
    for span in spans(pieces, text):
        seen.update(span)
    return seen.hexdigest()


def _numbers(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    drawn = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(drawn[8 * i:8 * i + 8], 16) for i in range(4))


def transformed(ids: pa.Array, texts: pa.Array, seed: int, keep_text: bool) -> list[dict]:
    """One report per row."""
    ids, rows = ids.to_pylist(), []
    for first, data, offsets in text_slices(texts):
        # A unit begins at a letter without a letter before it, or at any other character.
        letter = _LETTER[data]
        begins = ~_INNER[data]
        follows = letter[1:] & letter[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        follows[edges - 1] = False
        begins[1:] &= ~follows
        units = np.append(np.flatnonzero(begins), len(data))
        chars = np.append(0, np.cumsum(~_INNER[data]))
        bounds = np.searchsorted(units[:-1], offsets)
        view = memoryview(data.tobytes())
        for i in range(len(offsets) - 1):
            low, high = int(offsets[i]), int(offsets[i + 1])
            own, text = view[low:high], bytes(view[low:high])
            n = int(bounds[i + 1] - bounds[i])
            h1, h2, h3, h4 = _numbers("" if ids[first + i] is None else ids[first + i], seed)
            pieces = [Piece("text", 0, len(text))]
            prefix = middle = None
            if not text or h3 % 100 >= 100 - PLAIN or any(s in text for s in SENTINELS.values()):
                form, output, back = "plain", text, pieces
            else:
                form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                unit = sorted((h1 % (n + 1), h2 % (n + 1)))
                # The edge behind the last unit is the text's end, not the next text's start.
                at = [high if u == n else int(units[bounds[i] + u]) for u in unit]
                cut = split(split(pieces, at[0] - low), at[1] - low)
                prefix = int(chars[at[0]] - chars[low])
                middle = int(chars[at[1]] - chars[at[0]])
                pieces = arrange(cut, form)
                output = b"".join(spans(pieces, own))
                back = inverse(found_parts(output, form), form)
            rows.append({
                "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle,
                "pieces": [p._asdict() for p in pieces] if keep_text else None,
                "text": output.decode() if keep_text else None,
                "output_sha256": digest(pieces, own),
                "restored_sha256": digest(back, memoryview(output)),
            })
    return rows


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
    out: str = "infill", keep_text: bool = True,
) -> DataFrame:
    """`docs` with a struct `out`: n, form, prefix_chars, middle_chars, pieces, text,
    output_sha256 and restored_sha256.

    A unit is a run of A-Z and a-z, or any other single character; n counts them. The cuts,
    the form and whether a text stays plain follow from a hash of seed and id (a missing id
    counts as an empty one), so equal ids get equal numbers. pieces are over the bytes of the
    old text and the sentinels; text is the new text; without `keep_text` both are null and
    only the hashes, which are taken piece by piece, leave the task. restored_sha256 is that
    of the text put together from the new text and the form alone. Null texts count as empty,
    which are plain, as are texts that hold a sentinel. Repeated rows are treated one by one;
    an empty table stays empty. `out` replaces no column: it gets underscores until it is new.
    """
    out = free_name(docs, out)
    kind = T._parse_datatype_string(REPORT)
    arrow = pa.struct([
        ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("pieces", pa.list_(pa.struct([
            ("buffer", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))),
        ("text", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            reports = transformed(batch.column(batch.num_columns - 1), texts, seed, keep_text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(reports, arrow)], names=names)

    names = [*docs.columns, out]
    text_at = docs.columns.index(text_col)
    given = docs.withColumn(out, F.col(f"`{id_col}`").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    return given.mapInArrow(run, schema)


def restore(df: DataFrame, text: str, form: str, out: str = "restored") -> DataFrame:
    """`df` with the original text, from an arranged text and its form.

    A null text stays null; a form other than those with sentinels leaves the text as it is.
    """
    out = free_name(df, out)

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, forms: pd.Series) -> pd.Series:
        def one(given: str | None, form: str | None) -> str | None:
            if given is None or form not in ORDERS:
                return given
            data = given.encode()
            return b"".join(spans(inverse(found_parts(data, form), form), memoryview(data))).decode()
        return pd.Series([one(t, f) for t, f in zip(texts, forms)], dtype=object)

    return df.withColumn(out, rebuilt(F.col(f"`{text}`"), F.col(f"`{form}`")))
