"""Places of pattern matches in texts, by built-in functions alone.

Splitting a text at a pattern gives the gaps between the matches, and the
running sum of gap and match lengths gives their places, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group of the pattern that ``keep`` tests; 0 is the whole match.
    group: int = 0
    version: int = 1

    def hits(self, text: Column, rank: int, wanted: Column | None = None) -> Column:
        both = F.arrays_zip(
            F.split(text, self.pattern, -1).alias("gap"),
            F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)).alias("found"),
            F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group)).alias("value"),
        )
        rows = F.transform(both, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), F.length(x["gap"]).alias("gap"), x["found"].alias("found"), x["value"].alias("value")))
        # The last gap has no match after it.
        here = text.rlike(self.pattern)
        return F.when(here if wanted is None else wanted & here, F.filter(rows, lambda x: x["found"].isNotNull()))


def matches(rows: DataFrame, key: str, rules: tuple[Rule, ...], versions: str | None = None) -> DataFrame:
    """(key, rank, nth, found, value, start, end) of ``rows`` (key, text); end is exclusive.

    ``versions`` names an array column: rules of other versions skip the row.

    ``key`` must determine the text: rows that repeat it are reported once.
    Only texts with a match give rows; a key's rows are its text's matches.
    """
    none = F.array().cast("array<struct<rank:int,nth:int,gap:int,found:string,value:string>>")
    every = F.concat(*[F.coalesce(r.hits(F.col("text"), k, F.array_contains(versions, r.version) if versions else None), none) for k, r in enumerate(rules)])
    found = rows.select(key, F.explode(every).alias("m")).select(key, "m.*").dropDuplicates([key, "rank", "nth"])
    so_far = F.sum(F.col("gap") + F.length("found")).over(Window.partitionBy(key, "rank").orderBy("nth"))
    return found.withColumn("end", so_far.cast("long")).withColumn("start", F.col("end") - F.length("found")).drop("gap")


def listed(*order: str) -> Column:
    """Aggregate: the group's (kind, start, end), sorted by ``order`` and joined to kind:start:end,..."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"by_{c}") for c in order], "kind", "start", "end")))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
