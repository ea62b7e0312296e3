r"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (a run of ASCII letters, or one other code point) and, by a hash of its id,
into prefix, middle and suffix. Its output is the text itself (``plain``), or the three parts behind
their marks: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>``
prefix ``<M>`` middle.

1. A document becomes pieces of whole units (``CHUNK_UNITS``; a longer unit is cut by bytes), each with
   the document's key and its place in the *output*. The marks are pieces of their own.
2. Pieces are repartitioned by document and sorted by place inside their partition; a task streams
   them into one incremental digest, or writes them out, and holds one piece at a time.
3. To restore, the streamed output is read from left to right: a mark opens the next part, and each
   piece gets its place in the *text*. A second sort inside the same partition, without a shuffle,
   brings them into that order, and a second digest reads them.

So a text of any length costs a task one piece of memory, the spillable sort apart, and one exchange
moves each byte once. Documents are dealt by a hash of a row number, so neither a hot source nor a
group of copies gathers. The row number is given where the pieces are made, in the same job: a task
that is run again numbers its rows alike, as it reads the same split in the same order.

Defined cases: a null or empty text is empty and plain, its parts have no lengths; a null id draws as
an empty string; equal rows are rows of their own with equal results; an empty table gives no rows;
extra columns are not read, whatever their names.
"""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the parts, in the order prefix, suffix, middle.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Parts in the order of each form's output, and of the text.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
TEXT_ORDER = ("prefix", "middle", "suffix")
CHUNK_UNITS = 4096
PIECE_BYTES = 1 << 15
#: Bytes of pieces in one Arrow batch that a task sends back.
BATCH_BYTES = 4 << 20
_LAST = 2**62

_FACTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"uid long, place long, piece binary, {_FACTS}"
_RESTORED = f"uid long, back long, piece binary, {_FACTS}, output_sha256 string"


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text start."""
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    start = ~letter & ((raw & 0xC0) != 0x80)
    start[:1] |= letter[:1]
    start[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(start)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    return struct.unpack(">4I", hashlib.sha256(name.encode()).digest()[:16])


def plan(text: bytes, doc_id: int | None, seed: int, plain_from: int, spm_below: int):
    """(unit starts, form, prefix end, middle end) of one text; ends count units."""
    starts = unit_starts(np.frombuffer(text, np.uint8))
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = len(starts)
    if not text or h3 % 100 >= plain_from or any(m in text for m in MARKS.values()):
        return starts, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return starts, "spm" if h4 % 100 < spm_below else "psm", a, b


def _chunks(text: bytes, bounds: np.ndarray, a: int, b: int) -> Iterator[bytes]:
    """Units ``a`` to ``b`` of a text in pieces; ``bounds`` are unit starts and the text's length."""
    for u in range(a, b, CHUNK_UNITS):
        x, y = int(bounds[u]), int(bounds[min(u + CHUNK_UNITS, b)])
        for at in range(x, y, PIECE_BYTES):
            yield text[at : min(at + PIECE_BYTES, y)]


def _output_pieces(text: bytes, starts: np.ndarray, form: str, a: int, b: int) -> Iterator[bytes]:
    bounds = np.append(starts, len(text))
    n = len(starts)
    if form == "plain":
        yield from _chunks(text, bounds, 0, n)
        return
    parts = {"prefix": (0, a), "middle": (a, b), "suffix": (b, n)}
    for part in FORMS[form]:
        yield MARKS[part]
        yield from _chunks(text, bounds, *parts[part])


def _batches(rows: Iterator[tuple], schema: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; column ``at`` holds the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[at] or b"")
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))


def pieces(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Pieces of all outputs: ``uid`` names the document's row, ``place`` counts in the output.

    The row with place -1 holds the document's facts and no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            none = (None,) * 5
            for uid, doc_id, text in _rows(batches):
                starts, form, a, b = plan(text, doc_id, seed, plain_from, spm_below)
                sizes = (None, None)
                if form != "plain":
                    ends = np.append(starts, len(text))
                    code = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
                    x, y = int(ends[a]), int(ends[b])
                    sizes = (int(np.count_nonzero(code[:x])), int(np.count_nonzero(code[x:y])))
                yield uid, -1, None, doc_id, len(starts), form, *sizes
                for i, piece in enumerate(_output_pieces(text, starts, form, a, b)):
                    yield uid, i, piece, *none

        yield from _batches(made(), _arrow(_PIECES), 2)

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, _PIECES)


def assembled(parts: DataFrame) -> DataFrame:
    """The pieces in the order of their outputs, each document's in one partition."""
    return parts.repartition("uid").sortWithinPartitions("uid", "place")


def outputs(docs: DataFrame, **options) -> DataFrame:
    """Per document its facts and ``output``, the whole transformed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            facts, held = None, []
            for _, place, piece, *rest in _rows(batches):
                if place == -1:
                    if facts is not None:
                        yield *facts, b"".join(held)
                    facts, held = rest, []
                else:
                    held.append(piece)
            if facts is not None:
                yield *facts, b"".join(held)

        yield from _batches(made(), _arrow(f"{_FACTS}, output binary"), 5)

    joined = assembled(pieces(docs, **options)).mapInArrow(run, f"{_FACTS}, output binary")
    return joined.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of a whole output, as an expression: the first marks part it."""
    psm = F.regexp_replace(output, r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _digest_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each output and give its text pieces their places in the text."""

    def made() -> Iterator[tuple]:
        none = (None,) * 6
        uid = facts = state = None
        marks, base = [], 0
        for key, place, piece, *rest in _rows(batches):
            if place == -1:
                if facts is not None:
                    yield uid, _LAST, None, *facts, state.hexdigest()
                uid, facts, state = key, rest, hashlib.sha256()
                marks, base = list(FORMS.get(rest[2], ())), 0
                continue
            state.update(piece)
            if marks and piece == MARKS[marks[0]]:
                base = TEXT_ORDER.index(marks.pop(0)) << 48
            else:
                yield key, base + place, piece, *none
        if facts is not None:
            yield uid, _LAST, None, *facts, state.hexdigest()

    yield from _batches(made(), _arrow(_RESTORED), 2)


_REPORT = f"{_FACTS}, output_sha256 string, restored_sha256 string"


def _digest_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple]:
        state = hashlib.sha256()
        for _, back, piece, *facts in _rows(batches):
            if back == _LAST:
                yield *facts, state.hexdigest()
                state = hashlib.sha256()
            else:
                state.update(piece)

    yield from _batches(made(), _arrow(_REPORT), 2)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: facts, the digest of its output, and of the text restored from that output."""
    streamed = assembled(pieces(docs, **options)).mapInArrow(_digest_outputs, _RESTORED)
    return streamed.sortWithinPartitions("uid", "back").mapInArrow(_digest_texts, _REPORT)
