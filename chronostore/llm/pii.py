"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Identifier-shaped tokens (those with a digit or an at sign) are instances. A
lexical pattern is a word or two beside one and the token's own shape: the word
before and the exact shape; the word before, the two words before, or the word
behind, each with a shape in which runs of digits and of letters count as one.
Instances of the base kinds are seeds. Patterns and instances score each other
in turn: a pattern's score is the mean of its instances', an instance's the
noisy-or of its accepted patterns'. A pattern is accepted with a high score and
enough instances of a high score, seeds or found in an earlier round, and marks
all its instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import let
from .common import documents, stored, text_of
from .spans import Rule, listed, matches

# The patterns of the base kinds, in their order. What precedes
# the first character, and the possessive repeats, change no match: a match that
# fails where a run of its first class begins fails in all of the run, unless
# the match before it ended there (\G). They keep the search linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RULES = (Rule("email", EMAIL), Rule("ip", IP), Rule("card", CARD), Rule("phone", PHONE))
KINDS = tuple(r.kind for r in RULES)

#: A token that has a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: The last word of a gap, the word before it, and the first one. A gap holds whole words; each is looked at twice at most.
LAST = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\z"
SECOND = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]++\z"
FIRST = r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"
#: Code points up to which a pattern or an instance is its own name.
NAMED = 64
#: Code points in a cell of a text, by which overlapping spans are found.
CELL = 256


def _byte() -> str:
    return "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """The sum that a valid card number makes a multiple of ten."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def base_spans(rows: DataFrame) -> DataFrame:
    """(key, rank, kind, found, start, end) of ``rows`` (key, text); matches that fail their kind's test are dropped."""
    found = matches(rows, "key", RULES)
    digits = F.regexp_replace("found", "[^0-9]", "")
    n = F.length(digits)
    card = F.when((n >= 13) & (n <= 19), _luhn(digits) % 10 == 0).otherwise(False)
    good = F.when(F.col("rank") == 0, F.lit(True)).when(F.col("rank") == 1, F.col("found").rlike(rf"^{_byte()}(?:\.{_byte()}){{3}}$")).when(F.col("rank") == 2, card).otherwise((n >= 9) & (n <= 15))
    return found.where(good).select("key", "rank", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1).alias("kind"), "found", "start", "end")


def _named(x: Column) -> Column:
    """A name of bounded length: a longer text is named by its SHA-256, behind a sign that makes it longer than any other name."""
    return F.when(F.length(x) > NAMED, F.concat(F.lit("#"), F.sha2(x, 256))).otherwise(x)


def candidates(rows: DataFrame) -> DataFrame:
    """(key, instance, patterns, start, end): identifier-shaped tokens of ``rows`` (key, text) and their lexical patterns.

    A token's neighbours are the whole words of the gaps beside it, or the
    tokens beyond a gap that holds no further word. Each token is a row, so a
    very long text is many rows. Tokens and neighbours of any length count;
    instances and patterns are given by their names (see ``_named``).
    """
    gaps, found = F.split("text", TOKEN, -1), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    word = lambda gap, pattern: F.nullif(F.regexp_extract(gap, pattern, 1), F.lit(""))

    def spot(g: Column, x: Column, i: Column) -> Column:
        gap, behind = F.get(g, i), F.get(g, i + 1)
        return F.struct(i.alias("nth"), F.length(gap).alias("gap"), x.alias("token"), word(gap, LAST).alias("last"), word(gap, SECOND).alias("second"), word(behind, FIRST).alias("first"))

    spots = let(gaps, lambda g: F.transform(found, lambda x, i: spot(g, x, i)))
    order = Window.partitionBy("key").orderBy("nth")
    each = rows.select("key", F.explode(spots).alias("x")).select("key", "x.*")
    lag = lambda c, n=1: F.lag(c, n).over(order)
    each = each.select(
        "key",
        "token",
        F.sum(F.col("gap") + F.length("token")).over(order).cast("long").alias("stop"),
        F.coalesce("last", lag("token")).alias("before"),
        F.when(F.col("last").isNotNull(), F.coalesce("second", lag("token"))).otherwise(F.coalesce(lag("last"), lag("token", 2))).alias("two"),
        F.coalesce("first", F.lead("token").over(order)).alias("behind"),
    )
    instance = F.regexp_replace("token", r"^[^A-Za-z0-9+@]+|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    lead = F.length("token") - F.length(F.regexp_replace("token", r"^[^A-Za-z0-9+@]+", ""))
    start = F.col("stop") - F.length("token") + lead
    before, two, behind = (F.coalesce(F.lower(c), F.lit("^")).alias(c) for c in ("before", "two", "behind"))
    each = each.select("key", before, two, behind, instance.alias("instance"), start.alias("start")).where(F.col("instance").rlike("[0-9@]"))
    each = each.withColumn("exact", F.regexp_replace(F.regexp_replace("instance", "[0-9]", "9"), "[A-Za-z]+", "a"))
    each = each.withColumn("loose", F.regexp_replace("exact", "9+", "9"))
    patterns = F.array(F.concat_ws(" ", F.lit("1"), "before", "exact"), F.concat_ws(" ", F.lit("1"), "before", F.lit("~"), "loose"), F.concat_ws(" ", F.lit("2"), "two", "before", "loose"), F.concat_ws(" ", F.lit("+"), "behind", "loose"))
    return each.select("key", _named(F.col("instance")).alias("instance"), F.transform(patterns, _named).alias("patterns"), "start", (F.col("start") + F.length("instance")).alias("end"))


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int = 3, least_pattern: float = 0.8, least_score: float = 0.9, least_known: int = 5) -> DataFrame:
    """(instance): discovered ones. ``edges`` (pattern, instance), ``seeds`` (instance), all by their names.

    Patterns and instances are joined on their names, never all at once in one
    task; each round is written to the shared folder.
    """
    edges = stored(edges.select("pattern", "instance").distinct(), "pii-edges")
    marked = stored(seeds.select("instance").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    score = marked
    for _ in range(rounds):
        known = edges.join(score, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        patterns = known.groupBy("pattern").agg(F.avg("score").alias("p"), F.sum((F.col("score") >= least_score).cast("int")).alias("n"))
        accepted = patterns.where((F.col("p") >= least_pattern) & (F.col("n") >= least_known))
        reached = edges.join(accepted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("score"))
        score = stored(marked.unionByName(reached).groupBy("instance").agg(F.max("score").alias("score")), "pii-scores")
    return score.join(marked, "instance", "left_anti").where(F.col("score") >= least_score).select("instance")


def overlapping(spots: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, start, end, instance) of the ``spots`` that overlap one of ``spans``; they meet in the cells that both touch."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor((b - 1) / CELL))).alias("cell")
    of_spots = spots.select("key", "instance", "start", "end", cells(F.col("start"), F.col("end")))
    of_spans = spans.select("key", F.col("start").alias("b0"), F.col("end").alias("b1"), cells(F.col("start"), F.col("end")))
    return of_spots.join(of_spans, ["key", "cell"]).where("start < b1 AND b0 < end").select("key", "start", "end", "instance").distinct()


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, spans): (doc_id, key) of each row and (key, rank, kind, start, end) of each span.

    The key is the text's SHA-256, so equal texts are searched in one place;
    the spans that the contexts add have kind ``context``. Only doc_id and text
    of ``docs`` are read, whatever its other columns are called. Searches take
    time in proportion to a text, so a very long one is only one long task.
    """
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.sha2("text", 256))
    # Only texts with a digit or an at sign can hold anything; few do, and only these are kept.
    able = stored(keyed.where(F.col("text").rlike("[0-9@]")).select("key", "text").dropDuplicates(["key"]), "pii-texts")
    base = stored(base_spans(able), "pii-base")
    spots = stored(candidates(able), "pii-candidates")
    over = stored(overlapping(spots, base), "pii-known")  # instances of a base kind
    new = bootstrap(spots.select("instance", F.explode("patterns").alias("pattern")), over)
    added = spots.join(new, "instance").join(over.drop("instance"), ["key", "start", "end"], "left_anti")
    added = added.select("key", F.lit(len(KINDS)).alias("rank"), F.lit("context").alias("kind"), "start", "end").distinct()
    return keyed.select("doc_id", "key"), stored(base.drop("found").unionByName(added), "pii-spans")


def report(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each row of ``paths``: counts, digest of the base spans, all spans.

    Null texts are empty and have none; repeated rows and null doc_ids are
    rows of their own; no rows, none.
    """
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"n_{kind}")
    both = spans.groupBy("key").agg(*[count(k) for k in KINDS], listed("rank", "start").alias("spans"))
    plain = spans.where(F.col("kind").isin(*KINDS)).groupBy("key").agg(listed("rank", "start").alias("base"))
    known = stored(both.join(plain, "key", "left"), "pii-by-key")
    out = stored(paths, "pii-paths").join(known, "key", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*find(documents(spark, sf_dir)))
