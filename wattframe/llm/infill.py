"""Fill-in-middle rearrangement of documents by piece tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.text import record_batches, texts_of, word_table

SEED = 42
RATE = 50  # percent of documents that are rearranged
SPM_SHARE = 80  # percent of those that put the suffix first
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
# A descriptor is (buffer, start, length) in bytes: buffer 0 is the document's own text, buffer 1 the marks, one after the other. Neither is ever written.
TEXT, MARK = 0, 1
MARK_BUFFER = b"".join(MARKS.values())
_MARK_AT = {name: (MARK, MARK_BUFFER.index(mark), len(mark)) for name, mark in MARKS.items()}
# Parts of a cut document are 0 prefix, 1 middle, 2 suffix; an arrangement lists them as they come in the output, each with its mark.
ARRANGEMENTS = {"psm": ((0, "prefix"), (2, "suffix"), (1, "middle")), "spm": ((2, "suffix"), (0, "prefix"), (1, "middle"))}
_WORDS = word_table()

Descriptor = tuple[int, int, int]
PIECES = "array<struct<buffer:int,start:bigint,length:bigint>>"
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def token_ends(text: bytes) -> np.ndarray:
    """Byte offsets where the tokens end: a word with the white space before it, and white space at the end of the text."""
    if not text:
        return np.empty(0, np.int64)
    inside = _WORDS[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return np.append(ends, len(text))


def cut(table: list[Descriptor], at: int) -> list[Descriptor]:
    """Splits the descriptor that holds offset `at` of the table's text; a cut at an edge leaves an empty descriptor."""
    out, passed = [], 0
    for i, (buffer, start, length) in enumerate(table):
        if at <= passed + length:
            left = at - passed
            return [*out, (buffer, start, left), (buffer, start + left, length - left), *table[i + 1:]]
        out.append((buffer, start, length))
        passed += length
    raise ValueError(f"offset {at} is beyond the text")


def arrange(parts: list[Descriptor], form: str) -> list[Descriptor]:
    """Prefix, middle and suffix in the order of the form, each behind its mark; a plain document stays."""
    if form == "plain":
        return parts
    return [piece for part, mark in ARRANGEMENTS[form] for piece in (_MARK_AT[mark], parts[part])]


def invert(output: bytes, form: str) -> list[Descriptor]:
    """Descriptors over an output that give the original text: what lies between the marks, permuted back.

    No part holds a mark, and no mark can begin inside another, so the first mark found from each place on is the one that was put there.
    """
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order = ARRANGEMENTS[form]
    starts, at = [], 0
    for _, mark in order:
        at = output.index(MARKS[mark], at)
        starts.append(at)
    stops = [*starts[1:], len(output)]
    parts = {part: (TEXT, start + len(MARKS[mark]), stop - start - len(MARKS[mark])) for (part, mark), start, stop in zip(order, starts, stops)}
    return [parts[i] for i in range(3)]


def read_pieces(table: list[Descriptor], text: bytes) -> Iterator[memoryview]:
    """The bytes of a table, descriptor by descriptor, without copies."""
    buffers = (memoryview(text), memoryview(MARK_BUFFER))
    for buffer, start, length in table:
        yield buffers[buffer][start:start + length]


def stream_digest(table: list[Descriptor], text: bytes) -> str:
    digest = hashlib.sha256()
    for piece in read_pieces(table, text):
        digest.update(piece)
    return digest.hexdigest()


def _characters(text: bytes, start: int, length: int) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8, length, start) & 0xC0) != 0x80)) if length else 0


def piece_table(doc_id: int | None, text: bytes, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple[int, str, list[Descriptor]]:
    """Number of tokens, form and, still in the order of the text, the descriptors of a document. The draws depend on seed and id only."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * i:8 * i + 8], 16) for i in range(4))
    ends = token_ends(text)
    n = len(ends)
    table = [(TEXT, 0, len(text))]
    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS.values()):
        return n, "plain", table
    for units in sorted((h1 % (n + 1), h2 % (n + 1))):
        table = cut(table, int(ends[units - 1]) if units else 0)
    return n, "spm" if h4 % 100 < spm_share else "psm", _three(table)


def _three(table: list[Descriptor]) -> list[Descriptor]:
    """Two cuts at one place leave an empty descriptor beside it; the parts are always prefix, middle, suffix."""
    if len(table) != 3:
        raise ValueError("two cuts make three parts")
    return table


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per row: doc_id, n (tokens), form, prefix_chars, middle_chars, pieces (descriptors of the output), output, output_sha256.

    Null and empty texts, and texts that hold a mark, are plain. A null id draws as the empty id. Rows that repeat an id and a text are arranged alike. Texts of any length are cut
    through their whole length; a row needs its text and the output. An empty table gives an empty result; other columns are not read.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("pieces", _PIECES), ("output", pa.string()),
        ("output_sha256", pa.string()),
    ])

    def make(batch: pa.RecordBatch) -> list:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            n, form, parts = piece_table(doc_id, text, seed, rate, spm_share)
            prefix, middle = (None, None) if form == "plain" else (_characters(text, *p[1:]) for p in parts[:2])
            table = arrange(parts, form)
            pieces = [dict(zip(("buffer", "start", "length"), p)) for p in table]
            rows.append((n, form, prefix, middle, pieces, b"".join(read_pieces(table, text)), stream_digest(table, text)))
        columns = list(zip(*rows))
        arrays = [pa.array(c, f.type) for c, f in zip(columns[:5], list(schema)[1:6])]
        return [batch.column(0), *arrays, pa.array(columns[5], pa.binary()).cast(pa.string()), pa.array(columns[6], pa.string())]

    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    spark_schema = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output string, output_sha256 string"
    return picked.mapInArrow(lambda batches: record_batches(_few(batches), make, schema), spark_schema)


def restore_texts(arranged: DataFrame, keep_text: bool = True) -> DataFrame:
    """The rows of fill_in_middle with their original text, rebuilt from `output` and `form` alone: text (unless not wanted) and restored_sha256 instead of `output`."""
    kept = [c for c in arranged.columns if c not in ("output", "form", "text", "restored_sha256")]
    rows = arranged.select("output", "form", *kept)
    fields = [f"{c} {t}" for c, t in rows.dtypes if c in kept]
    names = ["form", *kept, *(["text"] if keep_text else []), "restored_sha256"]

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts, digests = [], []
            for output, form in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                table = invert(output, form)
                digests.append(stream_digest(table, output))
                if keep_text:
                    texts.append(b"".join(read_pieces(table, output)))
            made = [pa.array(texts, pa.binary()).cast(pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made, pa.array(digests, pa.string())], names)

    return rows.mapInArrow(restore, ", ".join(["form string", *fields, *(["text string"] if keep_text else []), "restored_sha256 string"]))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Outputs are as large as texts; few rows at a time keep a batch small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def infill_digests(docs: DataFrame) -> DataFrame:
    """Rows of the query: sizes, form and the digests of output and restored text."""
    arranged = fill_in_middle(docs).drop("pieces")
    return restore_texts(arranged, keep_text=False).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
      ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, len(tokens) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f),
p AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
