"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which token positions of a window are hashed and which are
ignored, so a window still hits where an ignored token was substituted. All
windows of both sides are hashed under each mask and joined; each hit fixes an
alignment of an item and a document, and the tokens around it are compared.
Before a document's windows are hashed, a bit map of the first two tokens of the
benchmark's windows drops those that cannot hit; it is of a fixed size, and only
makes the join smaller.

From eight tokens on the four masks hit every alignment that the share of equal
tokens allows. Shorter items have masks of their own, which are hashed only if
the benchmark has such items: of five to seven tokens one may be substituted
anywhere, and an item of up to four must be equal throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import indices, let
from .common import documents, stored, text_of

#: Five tokens count in each mask; the others are ignored.
MASKS = ("11111", "1101011", "11010011", "100111001")
#: Of items of five to seven tokens, which a single substitution would take from under the masks above.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Of items of one to four tokens.
TINY_MASKS = ("1", "11", "111", "1111")
ALL_MASKS = (*MASKS, *SHORT_MASKS, *TINY_MASKS)
#: Words of 64 bits in the map of the benchmark's windows.
MAP_WORDS = 1 << 14
#: Hits of a document that are compared in one row.
HITS = 1000
#: Tokens of the window that must overlap, and the share of them that must be equal.
WINDOW, SHARE = 20, 0.8
#: Seeds that are broadcast at most (32 bytes each); beyond it the join shuffles.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _masks_of(n: Column) -> list[Column]:
    """For each mask, whether an item of ``n`` tokens is hashed under it."""
    tiny = len(MASKS) + len(SHORT_MASKS)
    return [(n > 4) if k < len(MASKS) else n.between(5, 7) if k < tiny else n == k - tiny + 1 for k in range(len(ALL_MASKS))]


def _used(k: int) -> list[int]:
    return [o for o, c in enumerate(ALL_MASKS[k]) if c == "1"]


def _second(k: int) -> int:
    """Offset of the second token that counts; 0 if only one does."""
    return (_used(k) + [0])[1]


def _start(hs: Column, i: Column, offset: int) -> Column:
    """Hash of the first two tokens that count in a window."""
    return F.xxhash64(F.lit(-1 - offset), F.get(hs, i), F.get(hs, i + offset))


def _word(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(MAP_WORDS)).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))


def _hashes(text: Column, body: Callable[[Column], Column]) -> Column:
    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), body)


def start_map(items: DataFrame, masks: list[int]) -> Column:
    """The map of the starts of all windows of ``items`` (text): an array of MAP_WORDS numbers, whatever the items."""
    starts = _hashes(F.col("text"), lambda hs: F.concat(*[F.transform(indices(hs), lambda i: _start(hs, i, o)) for o in sorted({_second(k) for k in masks})]))
    found = items.select(F.explode(starts).alias("h")).groupBy(_word(F.col("h")).alias("word")).agg(F.bit_or(_bit(F.col("h"))).alias("bits"))
    bits = {r["word"]: r["bits"] for r in found.collect()}  # at most MAP_WORDS rows
    # A cast of a constant is a constant.
    return F.split(F.lit(",".join(str(bits.get(w, 0)) for w in range(MAP_WORDS))), ",").cast("array<bigint>")


def seeds(rows: DataFrame, masks: list[int], by_size: bool, *keys: str, bits: Column | None = None) -> DataFrame:
    """keys, n (tokens), at, seed of ``rows`` (keys, text), for the windows under ``masks``.

    ``by_size``: only under the masks for a text of n tokens. ``bits``: only
    windows whose start is in that map. Each window is a row as soon as its
    tokens are hashed, so that Spark compiles what is done for each of them.
    """
    hashed = rows.select(*keys, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    # Without _outer Spark infers a filter on the size, for which it makes all tokens once more.
    each = hashed.select(*keys, "hs", F.posexplode_outer("hs").alias("at", "h")).where(F.col("at").isNotNull())
    started = {o: F.lit(True) for o in {_second(k) for k in masks}}
    if bits is not None:
        for o in started:
            h = _start(F.col("hs"), F.col("at"), o)
            started[o] = F.get(bits, _word(h)).bitwiseAND(_bit(h)) != 0
        each = each.where(reduce(or_, started.values()))
    n = F.size("hs")
    wanted = _masks_of(n) if by_size else [F.lit(True)] * len(ALL_MASKS)

    def under(k: int) -> Column:
        fits = (F.col("at") <= n - len(ALL_MASKS[k])) & wanted[k] & started[_second(k)]
        return F.when(fits, F.xxhash64(F.lit(k), *[F.get("hs", F.col("at") + o) for o in _used(k)]))

    return each.select(*keys, n.alias("n"), "at", F.explode(F.array(*[under(k) for k in masks])).alias("seed")).where(F.col("seed").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_equal, contaminated=true): the items each document leaks.

    A leak is an alignment in which, of some WINDOW consecutive tokens of the
    item (all of a shorter item), a SHARE or more equal the document's at the
    same places. n_tokens is the item's length, n_equal the equal tokens of its
    best alignment. Items without tokens cannot leak; null texts are empty; rows
    with a null doc_id or item_id are reported under null; repeated rows give
    one row. Empty tables give no rows. Only doc_id or item_id and text are
    read, whatever other columns are called. The hits of a document, however
    long it is, are compared at most HITS at a time.
    """
    items = benchmark.select("item_id", text_of().alias("text"))
    sizes = items.select(F.size(tokens(F.col("text"))).alias("n")).select(F.array(*_masks_of(F.col("n"))).alias("m"))
    found = sizes.agg(*[F.max(F.get("m", F.lit(k)).cast("int")).alias(f"m{k}") for k in range(len(ALL_MASKS))]).first()
    masks = [k for k in range(len(ALL_MASKS)) if found[k]] or [0]
    tested = stored(seeds(items, masks, True, "item_id").distinct(), "benchmark-seeds").withColumnRenamed("at", "item_at")
    few = tested.count() <= broadcast_seeds
    rows = docs.select("doc_id", text_of().alias("text"))
    bits = start_map(items, masks) if few else None
    hits = seeds(rows, masks, False, "doc_id", bits=bits).drop("n").join(F.broadcast(tested) if few else tested, "seed")
    hits = hits.select(F.col("doc_id").alias("hit_id"), "item_id", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # Alignments of one document: those that share a seed with an item.
    turn = F.floor((F.row_number().over(Window.partitionBy("hit_id").orderBy("item_id", "shift")) - 1) / HITS)
    hits = stored(hits.withColumn("turn", turn).groupBy("hit_id", "turn").agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("hits")), "benchmark-hits")
    near = rows.join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("hit_id")))

    def aligned(words: Column) -> Column:
        """Of each hit, the document's tokens beside the item's."""
        return F.transform("hits", lambda x: F.struct(x["item_id"].alias("hit_item"), x["shift"].alias("shift"), F.slice(words, F.greatest(x["shift"], F.lit(0)) + 1, x["n"] + F.least(x["shift"], F.lit(0))).alias("part")))

    sides = near.select("doc_id", F.explode(let(tokens(F.col("text")), aligned)).alias("x")).select("doc_id", "x.*")
    whole = items.select("item_id", tokens(F.col("text")).alias("item")).distinct()
    sides = sides.join(F.broadcast(whole) if few else whole, F.col("item_id").eqNullSafe(F.col("hit_item")))
    same = F.transform(indices(F.col("item")), lambda j: F.coalesce(F.get("part", j + F.least("shift", F.lit(0))) == F.get("item", j), F.lit(False)).cast("int"))
    window = F.least(F.size("item"), F.lit(WINDOW))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    leak = let(same, lambda m: F.struct(total(m).alias("n_equal"), F.exists(F.sequence(F.lit(0), F.size(m) - window), lambda i: total(F.slice(m, i + 1, window)) >= SHARE * window).alias("leaks")))
    checked = sides.select("doc_id", "item_id", F.size("item").alias("n_tokens"), leak.alias("leak"))
    best = checked.where("leak.leaks").groupBy("doc_id", "item_id", "n_tokens").agg(F.max("leak.n_equal").alias("n_equal"))
    return best.withColumn("contaminated", F.lit(True))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All alignments of every document and item that share a token, and the same test on them.
ORACLE_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS j FROM b),
al AS (
  SELECT doc_id, item_id, n, i - j AS shift, list(j) AS js, count(*) AS n_equal FROM dt JOIN bt USING (t)
  GROUP BY ALL HAVING count(*) >= {SHARE} * least(n, {WINDOW})
), leaks AS (
  SELECT * FROM al WHERE len(list_filter(range(1, n - least(n, {WINDOW}) + 2), lambda s: len(list_filter(js, lambda j: j >= s AND j < s + least(n, {WINDOW}))) >= {SHARE} * least(n, {WINDOW}))) > 0
)
SELECT doc_id, item_id, n::INTEGER AS n_tokens, max(n_equal)::INTEGER AS n_equal, true AS contaminated FROM leaks GROUP BY doc_id, item_id, n
"""
