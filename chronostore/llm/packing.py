"""Best-fit packing of documents into sequences, under several capacities at once.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared lengths). Pieces are dealt at random into shards of bounded size and
each shard is packed in descending length. For each piece, every class of open
sequences with equal room is weighed, by the weighted norm of what would remain
or by the weighted dot product of the piece and the room, and only sequences
that hold the piece under every capacity are eligible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, text_of
from .token_codec import codec, crc

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SHARD_PIECES = 16_384


def _cutter(path: str, end_id: int, capacity: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = codec(path), np.asarray([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    out.append((doc_id, k // width, k // 4, len(part) // 4, crc(part)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenize; cut only documents longer than ``capacity``."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_cutter(tokenizer_path, end_id, capacity), PIECES)


def pack_lengths(lengths: np.ndarray, tokens: int, max_documents: int, max_attention: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` in descending order."""
    w = np.asarray(weights, dtype=float)
    room: list[list[int]] = [[] for _ in range(tokens + 1)]  # open sequences by tokens left
    docs, cost = [], []  # of each sequence
    top_docs, top_cost, there = np.zeros(tokens + 1), np.zeros(tokens + 1), np.zeros(tokens + 1, dtype=bool)  # of each class's newest sequence
    left = np.arange(tokens + 1) / tokens
    where, at = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)

    def show(r: int) -> None:
        there[r] = bool(room[r])
        if room[r]:
            top_docs[r], top_cost[r] = docs[room[r][-1]], cost[room[r][-1]]

    for i, n in enumerate(lengths.tolist()):
        need = np.asarray([n / tokens, 1 / max_documents, n * n / max_attention])
        classes = np.flatnonzero(there[n:]) + n
        chosen = -1
        if len(classes):
            spare = np.stack([left[classes], 1 - top_docs[classes] / max_documents, 1 - top_cost[classes] / max_attention])
            worth = (spare * (need * w)[:, None]).sum(0) if rule == "dot" else -(w[:, None] * np.square(spare - need[:, None])).sum(0)
            for c in classes[np.argsort(-worth, kind="stable")].tolist() if len(classes) > 1 and (spare[1:] < need[1:, None] - 1e-12).any() else [int(classes[np.argmax(worth)])]:
                for k in range(len(room[c]) - 1, -1, -1):
                    b = room[c][k]
                    if docs[b] + 1 <= max_documents and cost[b] + n * n <= max_attention:
                        chosen = b
                        del room[c][k]
                        break
                if chosen >= 0:
                    show(c)
                    rest = c - n
                    at[i] = tokens - c
                    break
        if chosen < 0:
            chosen, rest = len(docs), tokens - n
            docs.append(0)
            cost.append(0)
        where[i] = chosen
        docs[chosen] += 1
        cost[chosen] += n * n
        if rest:
            room[rest].append(chosen)
            show(rest)
    return where, at


def pack(pieces: DataFrame, tokens: int = 2048, max_documents: int = 2048, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32).

    ``max_attention`` None is tokens squared, which no full sequence can exceed.
    Each piece must fit an empty sequence: a length over ``tokens`` or a cost
    over ``max_attention`` is an error. A shard leaves at most a few sequences
    part full, so the number of sequences is within about one in a thousand of
    packing all pieces at once. Empty input gives no rows; repeated rows are
    packed as rows of their own; null doc_ids are ids like any other.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    max_attention = max_attention or tokens * tokens
    shards = max(1, -(-pieces.count() // shard_pieces))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        if len(lengths) and (lengths[0] > tokens or lengths[0] ** 2 > max_attention or lengths[-1] < 1):
            raise ValueError("a piece does not fit an empty sequence")
        where, at = pack_lengths(lengths, tokens, max_documents, max_attention, weights, rule)
        out = rows.drop(columns="shard")
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(sequence_id=(int(key[0]) << 32) + where, offset=at)

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(one, PIECES + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer_path: str, end_id: int, tokens: int = 2048) -> DataFrame:
    """Tokenize, cut and pack ``docs``."""
    return pack(stored(token_pieces(docs, tokenizer_path, end_id, tokens), "pieces"), tokens)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0)
