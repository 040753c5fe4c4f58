"""SimHash near-duplicates, linked by a self-join of the fingerprints' binary trie.

Fingerprints are made in Arrow batches and reduced to distinct ones, so copies
cost nothing further. Two fingerprints that differ in at most ``budget`` bits
agree in one of budget + 1 parts, so each is dealt out once for each part,
rotated so that the part leads: the same number of copies at any size. All that
share a part are a node of the trie near its top, and a task walks pairs of
nodes below it together, level by level, adds the differing bits and drops a
pair once they exceed the budget. A node that is too full is dealt out deeper,
as pairs of its own descendants. A task returns, in place of all links of a
crowded neighbourhood, a spanning forest of them: at most one row for each
fingerprint it was given, with the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, text_of
from .graph import components

BITS = 64
#: Fingerprints under one node that a task takes as it is; a fuller node is dealt out deeper.
NODE_SIZE = 200_000
#: Levels that a node is dealt out deeper at most.
DEEPER = 16
#: Rows that a task walks, about.
SHARD_ROWS = 100_000
#: Nodes dealt out deeper that are broadcast at most.
BROADCAST_NODES = 100_000
#: Pairs of fingerprints under a pair of nodes that are compared outright.
LEAF = 64
#: Node pairs expanded at a time.
FRONTIER = 1 << 19


def _fingerprint(text: str, width: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return majority(np.asarray(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes`` (uint64)."""
    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    h = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed 64-bit). Null and blank texts give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray([_fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union-find over 0..n-1 by arrays of pairs; a root is its set's smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self._roots(np.arange(len(self.up)))


Nodes = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def trie_join(values: np.ndarray, starts: list[Nodes], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of ``values`` (uint64) at ``budget`` or fewer differing bits, below the pairs of nodes in ``starts``.

    A node is a range of ``values`` that is sorted and distinct within. ``starts``
    has (depth, first, end, other first, other end, bits that differ so far),
    arrays of pairs whose prefixes of that depth are done with; a node is paired
    with itself or with one behind it. Node pairs wait on a stack, in blocks.
    """
    stack = list(starts)
    while stack:
        d, a0, a1, b0, b1, e = stack.pop()
        if len(e) > FRONTIER:
            half = len(e) // 2
            stack += [(d, *(x[part] for x in (a0, a1, b0, b1, e))) for part in (slice(half, None), slice(None, half))]
            continue
        # Small enough node pairs end here: their members are compared outright.
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF) | (d == BITS)
        if leaf.any():
            la, lb, na, nb = a0[leaf], b0[leaf], (a1 - a0)[leaf], (b1 - b0)[leaf]
            count = na * nb
            k = np.repeat(np.arange(len(count)), count)
            j = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
            i, j = la[k] + j // nb[k], lb[k] + j % nb[k]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        rest = ~leaf
        if not rest.any():
            continue
        a0, a1, b0, b1, e = (x[rest] for x in (a0, a1, b0, b1, e))
        bit = np.uint64(BITS - 1 - d)
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        sides = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            # Of a pair of nodes and its mirror image one is walked.
            keep = (x1 > x0) & (y1 > y0) & (e + more <= budget) & (x0 <= y0)
            sides.append((x0[keep], x1[keep], y0[keep], y1[keep], e[keep] + more))
        nxt = [np.concatenate(x) for x in zip(*sides)]
        if len(nxt[0]):
            stack.append((d + 1, *nxt))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each sorted range, the first place whose ``bit`` is set: a binary search over all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        is_set = ((values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)


def parts_of(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the budget + 1 parts of a fingerprint."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _linked(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Links of a task's rows (x, turn, deeper, low, high); a unit is what shares all but x, and the first part of x."""
    parts = parts_of(budget)
    turn, x = rows["turn"].to_numpy().astype(np.int64), rows["x"].to_numpy().view(np.uint64)
    first = np.asarray([p[0] for p in parts], dtype=np.uint64)[turn]
    width = np.asarray([p[1] for p in parts], dtype=np.uint64)[turn]
    head, low, high, deeper = x >> (np.uint64(BITS) - width), rows["low"].to_numpy(), rows["high"].to_numpy(), rows["deeper"].to_numpy().astype(np.int64)
    order = np.lexsort((x, high, low, head, turn))
    turn, x, first, width, head, low, high, deeper = (v[order] for v in (turn, x, first, width, head, low, high, deeper))
    new = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (head[1:] != head[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    end = np.append(new[1:], len(x))
    # Within a unit of two nodes those of the lower prefix come first.
    depth = width[new].astype(np.int64) + deeper[new]
    own = (x << width) >> (np.uint64(BITS) - np.maximum(deeper, 1).astype(np.uint64))
    in_low = np.concatenate([[0], np.cumsum((deeper == 0) | (own == low.astype(np.uint64)))])
    cut = new + in_low[end] - in_low[new]
    one = low[new] == high[new]
    a0, a1, b0, b1 = new, np.where(one, end, cut), np.where(one, new, cut), end
    err = np.bitwise_count((low[new] ^ high[new]).astype(np.uint64)).astype(np.int64)
    keep = (a1 > a0) & (b1 > b0)
    starts = [(int(d), *(v[keep & (depth == d)] for v in (a0, a1, b0, b1, err))) for d in np.unique(depth[keep])]
    back = np.where(first > 0, (x >> first) | (x << ((np.uint64(BITS) - first) & np.uint64(BITS - 1))), x)
    fps, which = np.unique(back, return_inverse=True)
    forest = Forest(len(fps))
    for i, j in trie_join(x, starts, budget):
        forest.join(which[i], which[j])
    roots = forest.roots()
    linked = roots != np.arange(len(fps))
    return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[roots[linked]].view(np.int64)})


def trie_links(distinct: DataFrame, budget: int = 3, node_size: int = NODE_SIZE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``distinct`` (fp) within ``budget`` bits."""
    fp = F.col("fp")
    turned = []
    for k, (first, width) in enumerate(parts_of(budget)):
        x = F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, BITS - first)) if first else fp
        turned.append(F.struct(F.lit(k).alias("turn"), x.alias("x"), F.lit(width).alias("width"), F.shiftrightunsigned(x, BITS - width).alias("head")))
    rows = distinct.select(F.inline(F.array(*turned)))
    full = rows.groupBy("turn", "head").agg(F.count("*").alias("n")).where(F.col("n") > node_size)
    if full.isEmpty():
        rows = rows.withColumn("deeper", F.lit(0))
    else:
        levels = F.least(F.lit(DEEPER), F.ceil(F.log2(F.col("n") / node_size))).cast("int")
        full = stored(full.select(F.col("turn").alias("_turn"), F.col("head").alias("_head"), levels.alias("deeper")), "nodes-full")
        few = full.count() <= BROADCAST_NODES
        rows = rows.join(F.broadcast(full) if few else full, (F.col("turn") == F.col("_turn")) & (F.col("head") == F.col("_head")), "left").withColumn("deeper", F.coalesce("deeper", F.lit(0)))
    # Of a full node, pairs of descendants whose prefixes are near enough; of another one, the node with itself.
    own = F.expr(f"CASE WHEN deeper = 0 THEN 0L ELSE shiftrightunsigned(shiftleft(x, width), {BITS} - deeper) END")
    flips = F.expr(f"filter(sequence(0L, shiftleft(1L, deeper) - 1L), m -> bit_count(m) <= {budget})")
    rows = rows.select("turn", "x", "head", "deeper", own.alias("p"), F.explode(flips).alias("flip"))
    units = rows.select("turn", "x", "head", "deeper", F.least(F.col("p"), F.col("p").bitwiseXOR(F.col("flip"))).alias("low"), F.greatest(F.col("p"), F.col("p").bitwiseXOR(F.col("flip"))).alias("high"))
    shards = max(1, -(-distinct.count() * (budget + 1) // shard_rows))
    keyed = units.withColumn("shard", F.pmod(F.xxhash64("turn", "head", "low", "high"), F.lit(shards))).drop("head")
    return keyed.groupBy("shard").applyInPandas(lambda rows: _linked(rows, budget), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII white space. A text of fewer
    words than a shingle is one shingle; a blank or null text has fingerprint
    zero and links like any other. component_id is the smallest doc_id that
    links reach; a group of null doc_ids alone has a null one. Repeated rows
    stay. An empty table gives no rows. Only doc_id and text are read, whatever
    other columns are called; a very long text is hashed in blocks.
    """
    prints = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints-distinct")
    labels = components(stored(trie_links(distinct.select("fp"), budget), "links"))
    labelled = stored(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = stored(labelled.join(smallest, "label").select("fp", "component_id"), "classes")
    # A fingerprint that many documents share is split by AQE: both sides are shuffled plain files.
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
