"""Token-ID files: documents in ascending id order, as compressed blocks (see range_coder), written and read by Spark.

A file set is a folder with two Parquet tables, so that Spark's committers make a lost executor harmless and any store
that Spark writes to will do: ``blocks`` (part, block, n_docs, n_ids, data) holds the binary blocks, about BLOCK_IDS ids
each and whole documents only; ``index`` (part, before) the ids in all earlier parts. Parts are ranges of ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import range_coder
from .bpe import encoder, file_path
from .common import claim, map_arrow, shared_root, slices, table

BLOCK_IDS = 1 << 22
SLICE_BYTES = 8 << 20


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every row's whole text, with the end id appended, into ``folder``.

    Defined results: a null or empty text is the end id alone. Null ids come first; rows that share an id follow each
    other in an order of their texts' hashes, which also lets a much repeated id spread over parts. An empty table
    gives an empty file set. Extra columns are ignored.
    """
    path = path or file_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(batches):
        encode = encoder(path)
        vocabulary = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        part = TaskContext.get().partitionId()
        ids, parts, held, before, block = [], [], 0, 0, 0

        def flush():
            data = range_coder.pack_block(ids, parts, before, vocabulary)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                for doc, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    got = encode.ids(text)
                    ids.append(doc)
                    parts.append(got)
                    held += len(got)
                    if held >= block_ids:
                        yield flush()
                        before, block = before + held, block + 1
                        ids, parts, held = [], [], 0
        if ids:
            yield flush()

    blocks = map_arrow(rows, run, "part int, block int, n_docs long, n_ids long, data binary")
    blocks.write.parquet(f"{folder}/blocks", compression="none")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a task
    index, at = [], 0
    for row in sorted(sizes, key=lambda r: r.part):
        index.append((row.part, at))
        at += row.n
    spark.createDataFrame(index, "part int, before long").coalesce(1).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, and its ids as array<int>; checksums are verified."""
    return _read(spark, folder, True)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """As read(), without the ids."""
    return _read(spark, folder, False)


def _read(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    before = {r.part: r.before for r in spark.read.schema("part int, before long").parquet(f"{folder}/index").collect()}
    blocks = spark.read.schema("part int, block int, n_docs long, n_ids long, data binary").parquet(f"{folder}/blocks").select("part", "data")

    def run(batches):
        claim()
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                first, docs, lengths, ids = range_coder.unpack_block(data.as_py())
                ends = np.cumsum(lengths)
                wide = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(docs, mask=docs == range_coder.NULL_ID),
                    "start": pa.array(before[part] + first + ends - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def query(spark, sf_dir):
    folder = f"{shared_root(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return digest(spark, folder)


SQL = None
