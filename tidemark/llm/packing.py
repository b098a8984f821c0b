"""Packing by concatenate and cut.

Pass 1 tokenises every document, appends the end id and writes the ids (16-bit) with the document's place in its
partition: the partition's number and the ids before it there. Pass 2 needs only the partitions' token totals, whose
prefix sums give each partition's global offset; every row then knows where its ids lie in one long virtual sequence,
which is cut every ``window`` ids. A document that crosses a cut yields a boundary record, a piece on each side.
Sequences are full but for the last, and no row depends on any other row, so nothing is gathered or sorted, and a lost
executor costs only its own tasks: pass 2 reads the written table.

The totals are one row for each task of pass 1; they are summed by the executors, and their prefix sums are sent with
pass 2 as a map of 16 bytes a task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KEPT_BYTES, encoder, encoder_dtype, file_path
from .common import claim, map_arrow, slices, stage, table

WINDOW = 1024
SLICE_BYTES = 2 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kept: int = KEPT_BYTES) -> DataFrame:
    """(part, before, id, n, ids binary) of each row, staged. ``kept``: bytes of words that a worker keeps."""
    path = path or file_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode, before = encoder(path, kept), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                ids = [encode.ids(t) for t in piece.column("text").to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), piece.column("id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["part", "before", "id", "n", "ids"],
                )
                before = int(ends[-1])

    return stage(map_arrow(rows, run, "part int, before long, id long, n long, ids binary"), "packing-ids")


def _wide(ids: pa.Array, n: np.ndarray, width: np.dtype) -> bytes:
    """All ids of a column as 32-bit integers."""
    ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1 + ids.offset)[ids.offset :]
    if not len(n):
        return b""
    return np.frombuffer(ids.buffers()[2], width, int(n.sum()), int(ends[0])).astype("<u4").tobytes()


def pack(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kept: int = KEPT_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined results: a null or empty text is the end id alone. Rows whose ids repeat or are null are packed separately.
    An empty table gives no piece. Extra columns are ignored. The order of documents is that of the input's partitions.
    """
    path = path or file_path()
    width = encoder_dtype(path)
    ids = tokenized(docs, id_col, text_col, path, kept)
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).collect()
    offsets, at = {}, 0
    for row in sorted(totals, key=lambda r: r.part):
        offsets[row.part], at = at, at + row.total

    def run(batches):
        claim()
        for batch in batches:
            part, before, doc, n = (batch.column(k) for k in ("part", "before", "id", "n"))
            n, first = np.asarray(n), np.asarray(before) + np.array([offsets[p] for p in part.to_pylist()], np.int64)
            pieces = (first + n - 1) // window - first // window + 1  # each document has its end id at least
            row = np.repeat(np.arange(len(n)), pieces)
            no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // window + no
            low = np.maximum(sequence * window, first[row])
            length = np.minimum((sequence + 1) * window, first[row] + n[row]) - low
            start = low - first[row]
            wide = memoryview(_wide(batch.column("ids"), n, width))
            at = 4 * (np.cumsum(n) - n)[row] + 4 * start
            crc = [zlib.crc32(wide[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            numbers = (start, length, np.array(crc, np.int64), n[row], sequence, low - sequence * window)
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), *map(pa.array, numbers)], names=[f.split()[0] for f in PIECES.split(", ")])

    return map_arrow(ids, run, PIECES)


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


SQL = None
