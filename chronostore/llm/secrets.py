"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. The ledger records
which blob was scanned under which rule version; only pairs it lacks are
scanned, each blob once however many paths hold it. Findings are stored by
blob and joined back to every path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, stored, text_of
from .spans import Rule, listed, matches

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# A maximal run is one match, so a run's least length can stand in the pattern.
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

RULES = (
    Rule("assign", ASSIGN, group=2),
    Rule("access", ACCESS),
    Rule("hex", HEX),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", version=2),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", version=2),
)
LEAST = {"assign": 8, "access": 16, "hex": 32, "pem": 1, "jwt": 1}


class Ledger:
    """Scanned (blob, rule version) pairs and findings, in a folder of the shared store."""

    SCANNED = "blob string, version int"
    FINDINGS = "blob string, version int, rank int, kind string, start long, end long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scan(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the blobs of ``paths`` (doc_id, text) that are new under any rule version.

        Returns (doc_id, blob) of the paths. Findings are written before the
        pairs they belong to, so a scan that is cut short is scanned again.
        """
        blobs = stored(paths.select("doc_id", F.sha2(text_of(), 256).alias("blob")), "blobs")
        one = blobs.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("from_id"))
        pairs = one.withColumn("version", F.explode(F.array(*[F.lit(v) for v in sorted({r.version for r in rules})])))
        unseen = stored(pairs.join(self._read("scanned", self.SCANNED), ["blob", "version"], "left_anti"), "pairs-unseen")
        todo = unseen.groupBy(F.col("blob").alias("unseen"), "from_id").agg(F.collect_set("version").alias("versions"))
        # By document and blob, so that the copies of a blob are spread; the texts are the streamed side.
        texts = paths.select("doc_id", text_of().alias("text")).withColumn("blob", F.sha2("text", 256))
        fresh = texts.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("unseen")) & F.col("doc_id").eqNullSafe(F.col("from_id")))
        of_rule = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("rank") + 1)
        found = matches(fresh.select("blob", "text", "versions"), "blob", rules, "versions")
        found = found.where(F.length("value") >= of_rule([LEAST[r.kind] for r in rules]))
        found.select("blob", of_rule([r.version for r in rules]).alias("version"), "rank", of_rule([r.kind for r in rules]).alias("kind"), "start", "end").write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("blob", "version").write.mode("append").parquet(f"{self.path}/scanned")
        return blobs

    def findings(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        rows = self._read("findings", self.FINDINGS).distinct()  # a scan begun again may repeat some
        return rows if kinds is None else rows.where(F.col("kind").isin(*kinds))


def report(blobs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each path: counts, digest of the base spans, all spans.

    Null texts are empty and have no finding; repeated rows and null doc_ids
    are reported as rows of their own; no paths, no rows.
    """
    base = F.col("kind").isin(*BASE_KINDS)
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"n_{kind}")
    both = findings.groupBy("blob").agg(*[count(k) for k in BASE_KINDS], listed("start", "rank").alias("spans"))
    plain = findings.where(base).groupBy("blob").agg(listed("start", "rank").alias("base"))
    known = stored(both.join(plain, "blob", "left"), "blob-findings")
    # A blob that many paths share: plain files on both sides, which AQE can split.
    out = blobs.join(known, "blob", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, new_path(spark, "secret-ledger"))
    blobs = ledger.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return report(blobs, ledger.findings())


def _sql_spans(rank: int, rule: Rule) -> str:
    """Spans of one rule, from the gaps between its matches and their lengths."""
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, row_id, {rank} AS rank, '{rule.kind}' AS kind, v, list_sum(lens[1:k]) + list_sum(gaps[1:k]) - lens[k] AS s, list_sum(lens[1:k]) + list_sum(gaps[1:k]) AS e
  FROM (SELECT *, unnest(vals) AS v, generate_subscripts(vals, 1) AS k FROM (
    SELECT doc_id, row_id, regexp_extract_all(text, '{p}', {rule.group}) AS vals,
           list_transform(regexp_extract_all(text, '{p}', 0), lambda x: length(x)) AS lens, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps FROM d))
  WHERE length(v) >= {LEAST[rule.kind]}"""


_BASE = ", ".join(f"'{k}'" for k in BASE_KINDS)
_JOINED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT row_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)}, {_JOINED} FILTER (WHERE kind IN ({_BASE})) AS base, {_JOINED} AS spans FROM f GROUP BY row_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_id)
"""
