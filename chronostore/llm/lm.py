"""Bigram scores of whole texts from an Elias-Fano trie, dealt out by context.

1. Texts become blocks: the distinct words' hashes, and tokens as indices into them.
2. Each block sends its distinct bigrams, with training counts, to the shards
   that own their contexts. A context therefore meets each block once, however
   often it occurs; one that makes up much of the corpus is split by successor.
3. A shard adds up the counts, builds its trie in a memory-mapped file, and
   answers every block with counts and quantised probabilities, in the order asked.
4. Each block scores its documents from the answers.

Model: absolute discounting, interpolated with the additively smoothed unigrams.
p(w | v) = (c(vw) - d) / c(v) + d T(v) / c(v) p(w); T: distinct successors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_bucket, stored, text_of
from .elias_fano import Trie, dequantise, quantise, scratch_file, write_trie

BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 2_500_000
DISCOUNT = 0.75
#: Additive constant of the unigrams.
ADD = 0.1
#: Local indices of the start (a context only) and the end; words follow.
START, END = 0, 1

BLOCKS = "block long, doc_ids array<long>, held binary, lengths binary, words binary, counts binary, tokens binary, n_train long, n_tokens long"
ASKED = "shard int, block long, entries binary, counts binary, fans binary, words binary, pairs binary"
ANSWERS = "block long, shard int, counts binary, fans binary, codes binary, n_words long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    number = counter(TaskContext.get().partitionId() << 32)

    def pack(ids: list, held: list, lengths: list, tokens: list, local: dict) -> pa.RecordBatch:
        # The start and the end hash strings that no word can be.
        hashes = np.asarray([xxh64_intdigest(w) for w in (b" ", b"", *local)], dtype=np.uint64)
        flat, n = np.concatenate(tokens), np.asarray(lengths, dtype=np.int32)
        train = np.repeat(~np.asarray(held, dtype=bool), n)
        counts = np.bincount(flat[train], minlength=len(hashes)).astype(np.int64)
        counts[START] = int((~np.asarray(held, dtype=bool)).sum())
        cells = [next(number), ids, np.asarray(held, dtype=np.uint8).tobytes(), n.tobytes(), hashes.tobytes(), counts.tobytes(), flat.tobytes(), int(train.sum()), len(flat)]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([c], type=k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def empty() -> tuple[list, list, list, list, dict, int]:
        return [], [], [], [], {}, 0

    ids, held, lengths, tokens, local, size = empty()
    for batch in batches:
        for doc_id, text, out in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = text.encode("utf-8", "replace").lower().split()
            for w in raw:
                if w not in local:
                    local[w] = len(local) + 2
            known = np.fromiter(map(local.__getitem__, raw), dtype=np.uint32, count=len(raw))
            tokens.append(np.append(known, np.uint32(END)))
            ids.append(doc_id)
            held.append(bool(out))
            lengths.append(len(raw) + 1)
            size += len(text) + 16
            if size >= BLOCK_BYTES:
                yield pack(ids, held, lengths, tokens, local)
                ids, held, lengths, tokens, local, size = empty()
    if ids:
        yield pack(ids, held, lengths, tokens, local)


def _u8(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


class Routes:
    """Which shard owns a context and a successor; ``keys``, ``totals`` and ``parts`` are of the hot words, sorted."""

    def __init__(self, shards: int, keys: np.ndarray, totals: np.ndarray, parts: np.ndarray):
        self.shards, self.keys, self.totals, self.parts = shards, keys, totals, parts

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index into the hot list, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def owner(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)

    def pair_shards(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out, hot = self.owner(context), self.place(context)
        at = np.flatnonzero(hot >= 0)
        if len(at):
            out[at] = (out[at] + ((word[at] >> np.uint64(8)) % self.parts[hot[at]]).astype(np.int64)) % self.shards
        return out


class Asked:
    """What a block asks each shard, in an order that the block can find again."""

    def __init__(self, row: dict, routes: Routes):
        words, counts, tokens = _u8(row["words"]), _u8(row["counts"], np.int64), _u8(row["tokens"], np.uint32).astype(np.int64)
        lengths, held = _u8(row["lengths"], np.int32), _u8(row["held"], np.uint8).astype(bool)
        ends = np.cumsum(lengths)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[ends - lengths] = START
        keys, self.pair_of = np.unique(before * len(words) + tokens, return_inverse=True)
        self.left, self.right = keys // len(words), keys % len(words)
        self.pair_counts = np.bincount(self.pair_of[np.repeat(~held, lengths)], minlength=len(keys)).astype(np.uint32)
        self.words, self.counts, self.tokens, self.before, self.ends, self.lengths = words, counts, tokens, before, ends, lengths
        # Entries of a shard: words it owns, and contexts of which it owns some successors.
        pair_shard = routes.pair_shards(words[self.left], words[self.right])
        own = routes.owner(words)
        entry_keys = np.unique(np.concatenate([own * len(words) + np.arange(len(words)), pair_shard * len(words) + self.left]))
        self.entry_shard, self.entry_word = entry_keys // len(words), entry_keys % len(words)
        self.owned = own[self.entry_word] == self.entry_shard
        pair_entry = np.searchsorted(entry_keys, pair_shard * len(words) + self.left)
        self.order = np.lexsort((self.right, pair_entry))
        self.pair_entry = pair_entry[self.order]

    def requests(self) -> Iterator[tuple]:
        fans = np.bincount(self.pair_entry, minlength=len(self.entry_word)).astype(np.uint32)
        counts = np.where(self.owned, self.counts[self.entry_word], 0)
        hashes, right, n = self.words[self.entry_word], self.words[self.right[self.order]], self.pair_counts[self.order]
        shards, first = np.unique(self.entry_shard, return_index=True)
        first = np.append(first, len(self.entry_shard))
        begin = np.concatenate([[0], np.cumsum(fans, dtype=np.int64)])
        for k, s in enumerate(shards.tolist()):
            e, p = slice(first[k], first[k + 1]), slice(begin[first[k]], begin[first[k + 1]])
            yield s, hashes[e].tobytes(), counts[e].tobytes(), fans[e].tobytes(), right[p].tobytes(), n[p].tobytes()


def _ask(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = Routes(*held.value)
        for batch in batches:
            for row in batch.to_pylist():
                out = [(s, row["block"], *rest) for s, *rest in Asked(row, routes).requests()]
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _answer(held: Broadcast):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        routes = Routes(*held.value)
        rows = rows.sort_values("block")
        entries = [_u8(x) for x in rows["entries"]]
        fans = np.concatenate([_u8(x, np.uint32) for x in rows["fans"]]).astype(np.int64)
        contexts, entry_of = np.unique(np.concatenate(entries), return_inverse=True)
        total = np.bincount(entry_of, weights=np.concatenate([_u8(x, np.int64) for x in rows["counts"]]), minlength=len(contexts)).astype(np.int64)
        asked_words = np.concatenate([_u8(x) for x in rows["words"]])
        words, word_of = np.unique(asked_words, return_inverse=True)
        context_of = np.repeat(entry_of, fans)
        keys, key_of = np.unique(context_of * max(1, len(words)) + word_of, return_inverse=True)
        n = np.bincount(key_of, weights=np.concatenate([_u8(x, np.uint32) for x in rows["pairs"]]), minlength=len(keys))
        keys, n = keys[n > 0], n[n > 0]
        left, right = keys // max(1, len(words)), keys % max(1, len(words))
        fan = np.bincount(left, minlength=len(contexts)).astype(np.uint32)
        # A context that is split has its count from all parts.
        hot = routes.place(contexts)
        all_of = np.where(hot >= 0, routes.totals[np.maximum(hot, 0)] if len(routes.totals) else 0, total)
        path = scratch_file()
        try:
            write_trie(path, contexts, words, left, right, quantise((n - DISCOUNT) / np.maximum(all_of[left], 1)))
            trie = Trie(path)
            out, at = [], 0
            for block, entry, asked in zip(rows["block"], entries, rows["words"]):
                own = entry_of[at : at + len(entry)]
                f = fans[at : at + len(entry)]
                codes = trie.find(entry, f, _u8(asked))
                out.append((block, int(rows["shard"].iloc[0]), total[own].tobytes(), fan[own].tobytes(), codes.tobytes(), 0))
                at += len(entry)
            del trie
        finally:
            os.unlink(path)
        start = _start_hash()
        # The shard's part of each split context's successors.
        split = np.flatnonzero(hot >= 0)
        out.append((-1, int(rows["shard"].iloc[0]), hot[split].astype(np.int64).tobytes(), fan[split].tobytes(), b"", int(((total > 0) & (contexts != start)).sum())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    return run


def _start_hash() -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(b" "))


def _split_fans(routes: Routes, answers: DataFrame) -> np.ndarray:
    """Distinct successors of each hot context, over all its parts: one row for each shard, with the parts that it has."""
    out = np.zeros(len(routes.keys), dtype=np.int64)
    if len(out):
        for r in answers.where("block < 0").select("counts", "fans").toLocalIterator():
            np.add.at(out, _u8(r["counts"], np.int64), _u8(r["fans"], np.uint32).astype(np.int64))
    return out


def _score(held: Broadcast, fans_of: Broadcast, n_train: int, n_words: int):
    below = n_train + ADD * (n_words + 1)

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        routes, split_fans, out = Routes(*held.value), fans_of.value, []
        for row in blocks.to_dict("records"):
            asked, got = Asked(row, routes), answers.sort_values("shard")
            counts = np.concatenate([_u8(x, np.int64) for x in got["counts"]])
            fans = np.concatenate([_u8(x, np.uint32) for x in got["fans"]])
            code = np.empty(len(asked.left), dtype=np.uint16)
            code[asked.order] = np.concatenate([_u8(x, np.uint16) for x in got["codes"]])
            c = np.zeros(len(asked.words), dtype=np.int64)
            c[asked.entry_word[asked.owned]] = counts[asked.owned]
            fan = np.bincount(asked.entry_word, weights=fans, minlength=len(asked.words))
            # A block asks only those parts of a split context that own successors of its own.
            hot = routes.place(asked.words)
            fan[hot >= 0] = split_fans[hot[hot >= 0]]
            unigram = (c + ADD) / below
            back = np.where(c > 0, np.minimum(1.0, DISCOUNT * fan / np.maximum(c, 1)), 1.0)
            pair = np.log10(dequantise(code) + back[asked.left] * unigram[asked.right])
            first = asked.ends - asked.lengths
            ids = row["doc_ids"]
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array([None if i is None or i != i else int(i) for i in ids], dtype="Int64"),
                        "held_out": _u8(row["held"], np.uint8).astype(bool),
                        "n_tokens": asked.lengths.astype(np.int64),
                        "n_known": np.add.reduceat((c > 0)[asked.tokens].astype(np.int64), first),
                        "train_tokens": n_train,
                        "base_score": np.add.reduceat(np.log10(unigram)[asked.tokens], first),
                        "score": np.add.reduceat(pair[asked.pair_of], first),
                    }
                )
            )
        return pd.concat(out)

    return run


def _hot(blocks: DataFrame, n_train: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than a quarter of a shard's share of the training tokens: hash, count, parts.

    There are fewer than 4 * shards of them, of 24 bytes each, and far fewer in
    natural text, where few words are so frequent.
    """
    if shards == 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = max(1.0, n_train / (4 * shards))

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _u8(row["counts"], np.int64)
                at = np.flatnonzero(c * (4 * shards) >= max(1, row["n_train"]) / 2)
                yield pa.RecordBatch.from_arrays([pa.array(_u8(row["words"])[at].view(np.int64)), pa.array(c[at])], names=["word", "n"])

    found = blocks.select("words", "counts", "n_train").mapInArrow(heavy, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    candidates = np.asarray(sorted(r["word"] for r in found.where(F.col("n") >= least / 2).toLocalIterator()), dtype=np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = _u8(row["words"]).view(np.int64)
                at = np.flatnonzero(np.isin(w, candidates))
                yield pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array(_u8(row["counts"], np.int64)[at])], names=["word", "n"])

    sums = blocks.select("words", "counts").mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = np.asarray([(r["word"], r["n"]) for r in sums.toLocalIterator()], dtype=np.int64).reshape(-1, 2)
    keys = np.ascontiguousarray(found[:, 0]).view(np.uint64)
    order = np.argsort(keys)
    n = found[order, 1]
    return keys[order], n, np.minimum(shards, 2 * n * shards // max(1, n_train) + 1).astype(np.uint64)


def score(docs: DataFrame, held_out: str = "held_out", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text, held_out) that are not held out; score every row.

    Null and empty texts have the end alone. Repeated rows count, and are
    scored, each. Null doc_ids are ids like any other. With no training rows
    every probability is uniform in form; no rows give none. Other columns are
    not read, whatever their names. A text longer than BLOCK_BYTES is a block
    of its own. A block sends a row to each shard that owns one of its
    contexts: at most one for each distinct pair of words in it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.col(held_out).alias("held"))
    blocks = stored(rows.mapInArrow(_blocks, BLOCKS), "lm-blocks", compression="zstd")
    n_train, n_tokens = (int(x or 0) for x in blocks.agg(F.sum("n_train"), F.sum("n_tokens")).first())
    shards = max(1, -(-n_tokens // shard_tokens))
    routes = (shards, *_hot(blocks, n_train, shards))
    held = spark.sparkContext.broadcast(routes)
    asked = blocks.drop("doc_ids").mapInArrow(_ask(held), ASKED)
    answers = stored(asked.groupBy("shard").applyInPandas(_answer(held), ANSWERS), "lm-answers", compression="zstd")
    n_words = int(answers.where("block < 0").agg(F.sum("n_words")).first()[0] or 0)
    replies = answers.where("block >= 0").select("block", "shard", "counts", "fans", "codes")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_score(held, spark.sparkContext.broadcast(_split_fans(Routes(*routes), answers)), n_train, n_words), schema)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text", (id_bucket(10) == 0).alias("held_out")))
