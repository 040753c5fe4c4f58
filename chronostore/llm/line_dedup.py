"""Line deduplication by content-defined chunks of lines.

A text is cut into chunks of lines: a hash over a window of two line hashes
says whether a chunk ends there, so boundaries move with the content and an
insertion upsets only its own neighbourhood; a line of ``long_words`` words or
more is a chunk by itself. A chunk of several lines, or of ``long_words``
words, that occurs more than once is removed everywhere but at its first place.
The match is then extended line by line, over ``long_words`` words or more on
each side, as far as the lines agree with those of the first place.

Whole-line passages of ``long_words`` words don't depend on chunk borders: the
shortest runs of lines that reach so many words, from each line on and up to
each line, are matched like chunks. A passage with words in its first and last
line is the union of such runs, so all of it goes. A run that overlaps its own
first place is no copy of it.

Line hashes stand for lines only after their bytes were compared: all lines are
grouped by hash and text, and a hash that two texts share removes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import common_prefix, indices, let
from .common import documents, stored, text_of

ROW = ["_id", "_row"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _reach(words: Column, least: int) -> Column:
    """(sum, n): how many leading elements it takes to sum to ``least``, or all of them."""
    none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(words, none, lambda a, w: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n"))))


def _runs(ws: Column, long_words: int) -> Column:
    """Array of (first, last): shortest runs of two lines or more with ``long_words`` words, from and up to each line that has words.

    Two such lines with blank ones between are a run too, if they have enough
    words; shorter ones leave no blank line of a passage out. A line of
    ``long_words`` words is a chunk. Each line is in at most 2 * long_words + 1 runs.
    """
    both = lambda a, b: a.cast("long") * (1 << 32) + b

    def over(at: Column, n: Column) -> Column:
        def reached(at: Column, n: Column, run: Callable[[Column, Column], Column]) -> Column:
            ends = F.transform(indices(n), lambda p: let(_reach(F.slice(n, p + 1, long_words), long_words), lambda r: F.when(r["sum"] >= long_words, run(F.get(at, p), F.get(at, p + r["n"] - 1)))))
            return F.filter(ends, lambda x: x.isNotNull())

        back = let(F.reverse(at), lambda a: let(F.reverse(n), lambda m: reached(a, m, lambda x, y: both(y, x))))
        gaps = F.filter(indices(n), lambda p: (F.get(at, p + 1) > F.get(at, p) + 1) & (F.get(n, p) + F.get(n, p + 1) >= long_words))
        return F.array_distinct(F.concat(reached(at, n, both), back, F.transform(gaps, lambda p: both(F.get(at, p), F.get(at, p + 1)))))

    found = let(F.filter(indices(ws), lambda i: F.get(ws, i) > 0), lambda at: let(F.filter(ws, lambda w: w > 0), lambda n: over(at, n)))
    pairs = F.transform(found, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("first"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("last")))
    return F.filter(pairs, lambda x: x["last"] > x["first"])


def _chunks(text: Column, divisor: int, long_words: int) -> Column:
    """Array of (first, last, words, hs, before, after), of chunks and runs; the last three are line hashes of it and its neighbours.

    Runs have no neighbours: where a match of one goes on, another run matches.
    """

    def over(lines: Column, hs: Column, ws: Column) -> Column:
        def ends(i: Column) -> Column:
            window = F.xxhash64(F.coalesce(F.get(hs, i - 1), F.lit(0)), F.get(hs, i))
            return (F.pmod(window, F.lit(divisor)) == 0) | (F.get(ws, i) >= long_words) | (F.coalesce(F.get(ws, i + 1), F.lit(0)) >= long_words) | (i == F.size(hs) - 1)

        def chunk(stops: Column, i: Column) -> Column:
            start = lambda k: F.coalesce(F.get(stops, k - 1) + 1, F.lit(0))
            last = F.get(stops, i)
            weigh = lambda part: F.transform(part, lambda w: F.greatest(w, F.lit(1)))
            # Two chunks before and one after, or as many lines as long_words words take: a longer match has runs.
            low = F.greatest(start(i) - long_words, F.lit(0))
            early = F.least(start(F.greatest(i - 2, F.lit(0))), start(i) - _reach(weigh(F.reverse(F.slice(ws, low + 1, start(i) - low))), long_words)["n"])
            late = F.greatest(F.coalesce(F.get(stops, i + 1), last), last + _reach(weigh(F.slice(ws, last + 2, long_words)), long_words)["n"])
            words = F.aggregate(F.slice(ws, start(i) + 1, last - start(i) + 1), F.lit(0), lambda a, w: a + w)
            return F.struct(start(i).alias("first"), last.alias("last"), words.alias("words"), F.slice(hs, start(i) + 1, last - start(i) + 1).alias("hs"), F.slice(hs, early + 1, start(i) - early).alias("before"), F.slice(hs, last + 2, late - last).alias("after"))

        def run(x: Column) -> Column:
            none = F.array().cast("array<bigint>")
            return F.struct(x["first"].alias("first"), x["last"].alias("last"), F.lit(long_words).alias("words"), F.slice(hs, x["first"] + 1, x["last"] - x["first"] + 1).alias("hs"), none.alias("before"), none.alias("after"))

        chunks = let(F.filter(indices(hs), ends), lambda stops: F.transform(indices(stops), lambda i: chunk(stops, i)))
        return F.concat(chunks, F.transform(_runs(ws, long_words), run))

    return let(_lines(text), lambda ls: let(F.transform(ls, lambda x: F.xxhash64(x)), lambda hs: let(F.transform(ls, _words), lambda ws: over(ls, hs, ws))))


def repeated_lines(rows: DataFrame, divisor: int = 2, long_words: int = 50) -> DataFrame:
    """(_id, _row, gone): numbers of the lines to remove, for ``rows`` (_id, _row, text) that lose any."""
    parts = stored(rows.select(*ROW, F.inline(_chunks(F.col("text"), divisor, long_words))).withColumn("key", F.xxhash64("hs")), "chunks")
    able = parts.where((F.col("last") > F.col("first")) | (F.col("words") >= long_words))
    # The first place of each repeated chunk.
    first = able.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "first")).alias("at")).where("n > 1")
    first = stored(first.select("key", "at._id", "at._row", "at.first"), "chunks-first")
    keep = first.join(able, [first["key"] == able["key"], first["_id"].eqNullSafe(able["_id"]), first["_row"] == able["_row"], first["first"] == able["first"]])
    keep = keep.select(first["key"], first["_id"].alias("k_id"), first["_row"].alias("k_row"), first["first"].alias("k_first"), F.col("hs").alias("k_hs"), F.col("before").alias("k_before"), F.col("after").alias("k_after"))
    keep = stored(keep.dropDuplicates(["key"]), "chunks-keep")
    # A chunk in a third of all documents: both sides are shuffled plain files, so AQE can split it.
    same = able.join(keep, "key").where("hs = k_hs")
    same = same.where(~(F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_row") == F.col("k_row")) & (F.col("first") < F.col("k_first") + F.size("hs"))))
    back = let(F.reverse("before"), lambda a: let(F.reverse("k_before"), lambda b: common_prefix(a, b)))
    same = same.withColumn("b", back).withColumn("a", common_prefix(F.col("after"), F.col("k_after")))
    hashes = F.concat(F.slice("before", F.size("before") - F.col("b") + 1, F.col("b")), "hs", F.slice("after", 1, F.col("a")))
    marked = same.select(*ROW, (F.col("first") - F.col("b")).alias("from"), F.posexplode(hashes).alias("k", "h")).select(*ROW, (F.col("from") + F.col("k")).alias("line"), "h")
    # Byte comparison of all lines; what is left of it are hashes of more than one text.
    texts = rows.select(F.explode(_lines(F.col("text"))).alias("line")).select(F.xxhash64("line").alias("h"), "line").groupBy("h", "line").agg(F.count("*").alias("n"))
    shared = stored(texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "lines-ambiguous")
    return marked.join(shared, "h", "left_anti").groupBy(*ROW).agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, divisor: int = 2, long_words: int = 50) -> DataFrame:
    """``docs`` with repeated passages removed; text and n_chars change, all rows and other columns stay.

    Added: lines_removed. The copy in the smallest doc_id, then the smallest
    line, stays; null doc_ids count as the smallest. A text whose lines are all
    removed becomes empty. Null and empty texts become empty. Rows that repeat
    both doc_id and text count as one. Ties cannot occur otherwise. Columns of
    ``docs`` whose names begin with an underscore are kept.
    """
    keyed = docs.withColumn("text", text_of()).withColumn("_ld_id", F.col("doc_id")).withColumn("_ld_row", F.xxhash64("text"))
    rows = keyed.select(F.col("_ld_id").alias("_id"), F.col("_ld_row").alias("_row"), "text")
    gone = stored(repeated_lines(rows, divisor, long_words), "lines-gone")
    gone = gone.select(F.col("_id").alias("_ld_gid"), F.col("_row").alias("_ld_grow"), F.col("gone").alias("_ld_gone"))
    both = keyed.join(gone.hint("shuffle_hash"), F.col("_ld_id").eqNullSafe(F.col("_ld_gid")) & (F.col("_ld_row") == F.col("_ld_grow")), "left")
    left = let(_lines(F.col("text")), lambda ls: F.array_join(F.transform(F.array_except(indices(ls), F.col("_ld_gone")), lambda i: F.get(ls, i)), "\n"))
    both = both.withColumn("text", F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(left)).withColumn("lines_removed", F.coalesce(F.size("_ld_gone"), F.lit(0)))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("_ld_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return both.select(*[F.col(c) for c in docs.columns], "lines_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "lines_removed")
