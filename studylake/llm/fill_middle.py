"""Operator 13: fill-in-the-middle by a piece table.

A document is a list of pieces, (buffer, start, length), over two buffers that nobody changes: its text and the sentinels. Cutting
splits the piece that holds the place, an arrangement lays the parts out in another order behind their sentinels, and the inverse
of that order brings them back. Digests run over the pieces, so no arranged or restored text is built for them.

Rows are independent: no shuffle, and a task holds one batch of texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from studylake.llm.bytetext import SLICE_BYTES, arrow_bytes, slices
from studylake.llm.common import pick

PARTS = ("prefix", "middle", "suffix")
#: The parts of each form, in the order in which they are laid out.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
PLAIN = "plain"
TEXT, MARKS = 0, 1
BUFFERS = ("text", "sentinels")

Piece = tuple[int, int, int]

_PIECES = "array<struct<buffer:string,start:long,length:long>>"
_COLUMNS = f"n long, form string, prefix_chars long, middle_chars long, pieces {_PIECES}, output string, output_sha256 string, restored_sha256 string"


def cut(pieces: Sequence[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and from byte `at`; the piece that holds it becomes two."""
    left: list[Piece] = []
    for i, (buffer, start, length) in enumerate(pieces):
        if at < length:
            right = [(buffer, start + at, length - at), *pieces[i + 1 :]]
            return (left + [(buffer, start, at)] if at else left), right
        left.append((buffer, start, length))
        at -= length
    return left, []


def parts_of(pieces: Sequence[Piece], first: int, second: int) -> dict[str, list[Piece]]:
    prefix, rest = cut(pieces, first)
    middle, suffix = cut(rest, second - first)
    return dict(zip(PARTS, (prefix, middle, suffix)))


def marks() -> tuple[bytes, dict[str, Piece]]:
    """The sentinel buffer and where each part's sentinel lies in it."""
    buffer, places = b"", {}
    for part, sentinel in SENTINELS.items():
        places[part] = (MARKS, len(buffer), len(sentinel))
        buffer += sentinel
    return buffer, places


_MARKS, _MARK_OF = marks()


def arrange(parts: dict[str, list[Piece]], form: str) -> list[Piece]:
    return [piece for part in FORMS[form] for piece in (_MARK_OF[part], *parts[part])]


def disarrange(output: bytes, form: str) -> list[Piece]:
    """Pieces over `output` that give the text back: parts found between the sentinels, in the inverse order.

    A text without sentinels can't make one with a neighbour either: they open with `<`, close with `>` and hold neither inside.
    """
    if form == PLAIN:
        return [(TEXT, 0, len(output))] if output else []
    found, at = {}, 0
    order = FORMS[form]
    for i, part in enumerate(order):
        start = at + len(SENTINELS[part])
        at = output.index(SENTINELS[order[i + 1]], start) if i + 1 < len(order) else len(output)
        found[part] = [(TEXT, start, at - start)]
    return [piece for part in PARTS for piece in found[part] if piece[2]]


def streamed(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> str:
    digest = hashlib.sha256()
    for buffer, start, length in pieces:
        digest.update(buffers[buffer][start : start + length])
    return digest.hexdigest()


def built(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> bytes:
    return b"".join(buffers[buffer][start : start + length] for buffer, start, length in pieces)


def _leading(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of bounded size: where each begins and which of its bytes open a code point."""
    for at in range(0, len(buf), SLICE_BYTES):
        yield at, (buf[at : at + SLICE_BYTES] & 0xC0) != 0x80


def code_points(buf: np.ndarray) -> int:
    return sum(int(np.count_nonzero(opens)) for _, opens in _leading(buf))


def place_of(buf: np.ndarray, unit: int) -> int:
    """The byte at which code point `unit` begins; the end for one past the last."""
    for at, opens in _leading(buf):
        here = int(np.count_nonzero(opens))
        if unit < here:
            return at + int(np.flatnonzero(opens)[unit])
        unit -= here
    return len(buf)


def draws(seed: int, doc_id: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _arranged(buf: np.ndarray, doc_id: str, percent: int, spm_percent: int, seed: int) -> tuple:
    raw = buf.tobytes()
    buffers = (memoryview(raw), memoryview(_MARKS))
    n = code_points(buf)
    h1, h2, h3, h4 = draws(seed, doc_id)
    whole: list[Piece] = [(TEXT, 0, len(raw))] if raw else []
    if not raw or h3 % 100 >= percent or any(sentinel in raw for sentinel in SENTINELS.values()):
        form, cuts, pieces = PLAIN, None, whole
    else:
        form = "spm" if h4 % 100 < spm_percent else "psm"
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        pieces = arrange(parts_of(whole, *(place_of(buf, unit) for unit in cuts)), form)
    output = built(pieces, buffers)
    restored = streamed(disarrange(output, form), (memoryview(output),))
    described = [{"buffer": BUFFERS[buffer], "start": start, "length": length} for buffer, start, length in pieces]
    chars = (cuts[0], cuts[1] - cuts[0]) if cuts else (None, None)
    return n, form, *chars, described, output, streamed(pieces, buffers), restored


def _as_strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def _runs(batch: pa.RecordBatch, column: str):
    """(first row, end row, bytes, offsets) of parts of a batch of bounded size, or of one text."""
    buf, at = arrow_bytes(batch.column(batch.schema.get_field_index(column)))
    for a, b in slices(at):
        yield a, b, buf[at[a] : at[b]], at[a : b + 1] - at[a]


def fill_in_middle(
    docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each text cut in three at places drawn from its id, and laid out for fill-in-the-middle training.

    Returns a row per input row: doc_id, n (code points), form (`psm`, `spm` or `plain`), prefix_chars and middle_chars (code points;
    NULL if plain), pieces (byte ranges of the text and of the sentinels `<P><S><M>` that make the output), output (the text as
    laid out), output_sha256 and restored_sha256 (of the text rebuilt from output and form). `percent` of 100 texts are arranged,
    `spm_percent` of 100 of those with the suffix first; a text that is empty or holds a sentinel is plain. NULL text is empty; a
    NULL id draws as an empty one. Rows that repeat give equal rows, an empty table none. Other columns are ignored, whatever their
    names.
    """
    rows = pick(docs, doc_id=id_column, text=text_column)
    rows = rows.select("doc_id", rows["doc_id"].cast("string").alias("name"), "text")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(_COLUMNS).fields])
    arrow = to_arrow_schema(schema)

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for a, b, buf, at in _runs(batch, "text"):
                found = [_arranged(buf[at[i] : at[i + 1]], names[a + i] or "", percent, spm_percent, seed) for i in range(b - a)]
                columns = list(zip(*found))
                arrays = [_as_strings(list(c)) if f.name == "output" else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(arrow.field(0).type), *arrays], schema=arrow)

    return rows.mapInArrow(arranged, schema)


def restore(arranged: DataFrame) -> DataFrame:
    """doc_id and text of rows (doc_id, form, output) as `fill_in_middle` gives them; NULL output is an empty text."""
    rows = arranged.select("doc_id", "form", "output")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(1).to_pylist()
            for a, b, buf, at in _runs(batch, "output"):
                texts = []
                for i in range(b - a):
                    raw = buf[at[i] : at[i + 1]].tobytes()
                    texts.append(built(disarrange(raw, forms[a + i]), (memoryview(raw),)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(arrow.field(0).type), _as_strings(texts)], schema=arrow)

    return rows.mapInArrow(restored, schema)
