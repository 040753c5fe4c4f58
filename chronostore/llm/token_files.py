"""Token ids as Parquet list columns, in ascending document order.

Files: doc_id, part, start_in_part, n_tokens, ids. Ids are dictionary encoded
(a vocabulary's ids fit one dictionary page) and fall back to delta encoding
(format version 2); row groups and pages are small enough that the column and
offset indexes, which Parquet writes for each page, let a reader skip to a
document range, and the metadata columns can be read without the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, text_of
from .token_codec import codec, crc

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Text in a file at most, about, which bounds a task's work however large the table is.
FILE_BYTES = 128 << 20
#: Documents whose ids are handed to the writer together.
ROWS = 512
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encoder(path: str, end_id: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = codec(path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            encoded = encoder.ids(batch.column(1))
            for i in range(0, batch.num_rows, ROWS):
                rows = batch.slice(i, ROWS)
                ids = [x + end for x in islice(encoded, rows.num_rows)]
                n = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(n), part, dtype=np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return encode


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, parts: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Encode ``docs`` and write them to ``out``, globally sorted by doc_id.

    Null texts are empty and give the end id alone; null doc_ids come first;
    repeated doc_ids lie side by side, ordered by a hash of the text; no rows,
    no documents. A very long text is one row of one file, cut into pieces of
    its own while it is encoded. Other columns of ``docs`` are not read,
    whatever their names. ``parts``: number of ranges, each of which is one
    file; by default as many as hold FILE_BYTES of text each, and no fewer
    than the session's shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA).write.options(
        **{
            "compression": "zstd",
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(PAGE_BYTES),
            "parquet.enable.dictionary": "true",
            "parquet.writer.version": "v2",
        }
    ).parquet(out)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view("<u4")
        sums = [crc(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, type=pa.int64())],
            names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
        )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files.

    The starts of the parts come from the metadata columns alone; there is one
    row for each file, which bounds what the running sum and the broadcast hold.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = files.select("doc_id", "part", "start_in_part", "ids").mapInArrow(_checksums, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_index(spark, path)
