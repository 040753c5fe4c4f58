"""Near-duplicates by Jaccard similarity of word shingles: SimHash links and MinHash bands give candidates, exact sets decide.

Texts become distinct sets of shingle hashes, so copies cost nothing further.
Fingerprints of the sets are linked by the binary trie self-join of
``simhash``. Within 3 of 64 bits that finds few of the pairs at a similarity of
0.8, and a budget that finds them makes the walk quadratic; so sets also fall
into one bucket for each band of a MinHash signature, and are paired there with
two sets that are picked anew in each bucket: at most two pairs for each set
and band, however crowded the bucket. Sets of paired texts are made again from
the texts and compared in full; pairs that are similar enough are links.

Buckets of more than three sets that these links leave in several groups may
hold further ones. Their sets are joined exactly, by their rarest shingles: sets
of similarity t have one in common among the rarest |s| - ceil(t |s|) + 1 of
each. Shingles of one group alone count as the rarest, since only links between
groups are looked for; so a set with enough text of its own meets no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .graph import components
from .simhash import majority, trie_links

#: A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9996.
BANDS, ROWS = 20, 5
#: Shingles hashed by all functions at a time.
BLOCK = 4096


def shingle_set(text: str, width: int, seed: int) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of the shingles; texts are lower-cased in A-Z and cut at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return np.asarray([xxh64_intdigest(b" ".join(words), seed)][: len(words)], dtype=np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return np.unique(np.asarray(hashes, dtype=np.uint64))


def buckets(shingles: np.ndarray, seed: int) -> list[int]:
    """One signed 64-bit bucket for each band; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(shingles):
        return []
    rnd = np.random.default_rng(seed)
    times, plus = rnd.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    times |= np.uint64(1)
    low = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(shingles), BLOCK):
        mixed = times * shingles[i : i + BLOCK] + plus
        low = np.minimum(low, mixed.min(axis=1))
    keys = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.asarray(keys, dtype=np.uint64).view(np.int64).tolist()


def _sketches(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingle_set(t, width, seed) for t in batch.column(2).to_pylist()]
            nodes = np.asarray([xxh64_intdigest(s.tobytes(), seed) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.asarray([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            cells = [batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], type=pa.int32()), pa.array(prints), pa.array([buckets(s, seed) for s in sets], type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "text_key", "node", "size", "fp", "buckets"])

    return run


def _sets(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t, width, seed).view(np.int64) for t in batch.column(1).to_pylist()], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "hashes"])

    return run


def _sets_of(rows: DataFrame, nodes: DataFrame, width: int, seed: int, name: str) -> DataFrame:
    """(node, hashes), stored, for ``nodes`` (node, text_key)."""
    texts = rows.select("text_key", "text").join(nodes.hint("shuffle_hash"), "text_key").select("node", "text")
    return stored(texts.mapInArrow(_sets(width, seed), "node long, hashes array<long>").dropDuplicates(["node"]), name)


def _links(pairs: DataFrame, sets: DataFrame, least: float, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough, stored."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_hashes")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_hashes")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("a_hashes", "b_hashes")).alias("common"), (F.size("a_hashes") + F.size("b_hashes")).alias("sizes"))
    return stored(both.where(F.col("common") >= least * (F.col("sizes") - F.col("common"))).select("a", "b"), name)


def _mixed(dealt: DataFrame, ends: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node, label): the sets in buckets of more than three that are left in several groups."""
    crowded = dealt.join(ends.where("n > 3").select("bucket"), "bucket").select("bucket", "node")
    members = stored(crowded.join(labelled.select("node", "label"), "node"), "buckets-crowded")
    several = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return members.join(several.select("bucket"), "bucket").select("node", "label").distinct()


def rare_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of ``sets`` (node, label, hashes) of different labels that may be similar enough, by their rarest shingles.

    ``left`` counts a set's shingles from one on, in a common order of all sets.
    At the first one that two sets have in common the smaller count bounds
    their overlap, so pairs below the overlap that ``least`` takes are let go.
    """
    shingles = sets.select("node", "label", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    shared = shingles.groupBy("h").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h", "n")
    ranked = shingles.join(shared, "h").withColumn("left", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("h"))))
    rarest = stored(ranked.where(F.col("left") >= F.ceil(least * F.col("size") - 1e-9)).select("h", "node", "label", "size", "left"), "rarest-shingles")
    side = lambda c: rarest.toDF("h", *[f"{c}_{x}" for x in rarest.columns[1:]])
    met = side("a").join(side("b"), "h").where("a_node < b_node AND a_label <> b_label")
    enough = (1 + least) * F.least("a_left", "b_left") >= least * (F.col("a_size") + F.col("b_size")) - 1e-9
    return met.where(enough).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8, seed: int = 42, budget: int = 3) -> DataFrame:
    """(doc_id, component_id), one row for each row of ``docs``: groups linked by pairs of Jaccard similarity ``least`` or more.

    A text of fewer words than a shingle is one shingle; blank and null texts
    are one group. component_id is the smallest doc_id of a group; a group of
    null doc_ids alone has a null one. Texts and sets are told apart by 64-bit
    hashes. All groups of the pairs that share a bucket are found; a pair of
    similarity 0.8 shares none with probability 0.0004. Columns beside doc_id
    and text are not read, whatever their names; repeated rows are rows of
    their own; a very long text is a set like any other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    sketches = stored(rows.mapInArrow(_sketches(width, seed), "doc_id long, text_key long, node long, size int, fp long, buckets array<long>"), "sketches")
    nodes = stored(sketches.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "sketches-distinct")
    # Both sides of each join are shuffled plain files, so AQE can split a crowded bucket or a set with many pairs.
    dealt = stored(nodes.select("node", "size", F.explode("buckets").alias("bucket")), "buckets")
    here = F.struct(F.xxhash64("node", "bucket").alias("turn"), "node", "size")  # other sets in each bucket
    ends = stored(dealt.groupBy("bucket").agg(F.min(here).alias("low"), F.max(here).alias("high"), F.count("*").alias("n")).where("low.node <> high.node"), "buckets-ends")
    met = dealt.join(ends, "bucket").select("node", "size", F.explode(F.array("low", "high")).alias("to")).select("node", "size", "to.node", "to.size").toDF("x", "x_size", "y", "y_size")
    # Fingerprints, and the nodes that share one, are linked through one node of each.
    of_fp = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("of")).select("fp", F.col("of.node").alias("y"), F.col("of.size").alias("y_size")), "fingerprint-nodes")
    alike = nodes.select("fp", F.col("node").alias("x"), F.col("size").alias("x_size")).join(of_fp, "fp").drop("fp")
    side = lambda c, names: of_fp.toDF(c, *names)
    near = trie_links(of_fp.select("fp"), budget).join(side("a", ("x", "x_size")), "a").join(side("b", ("y", "y_size")), "b").drop("a", "b")
    met = met.unionByName(alike).unionByName(near).where("x <> y").where(F.least("x_size", "y_size") >= least * F.greatest("x_size", "y_size"))
    pairs = stored(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_key"), "node")
    labels = components(_links(pairs, _sets_of(rows, wanted, width, seed, "shingle-sets"), least, "links"))
    labelled = stored(nodes.select("node", "first_id", "text_key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = stored(_mixed(dealt, ends, labelled), "mixed")
    if not mixed.isEmpty():
        sets = _sets_of(rows, mixed.join(labelled.select("node", "text_key"), "node").select("node", "text_key"), width, seed, "mixed-sets")
        more = _links(stored(rare_pairs(sets.join(mixed, "node"), least), "rare-pairs"), sets, least, "links-more")
        of = lambda c: labelled.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        merged = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
        merged = merged.toDF("label", "merged")
        labelled = stored(labelled.join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label")).drop("merged"), "labelled-again")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = stored(labelled.join(smallest, "label").select("node", "component_id"), "classes")
    return sketches.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")
