"""Secret scans over an incremental blob ledger.

A blob is a distinct text, addressed by its SHA-256; documents (or file versions) are paths to blobs. The ledger is a
folder with three tables: the paths of each scan, the pairs (blob, rule version) scanned so far, and findings (blob, rule, span).
A scan addresses its paths, keeps the blobs with a pair that is not in the ledger, runs just the missing rules over one copy of
each such blob, appends to the tables, and joins findings back to its paths; history() joins them to the paths of all scans, so
every version that ever held a secret is named. Every step is a DataFrame operation.

Positions come from splitting a text at a rule's matches: the lengths of pieces and matches, summed in order, are the
spans. Before a blob's text is shuffled (to bring copies together), it must pass a rule's anchor, a pattern which each text
with a finding of that rule contains.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import conf, documents, text_of, work_path, written


@dataclass(frozen=True)
class Rule:
    """pattern: run over the text, leftmost and without overlap; a match fails if its group `measured` is shorter than
    `least`. anchor: found in each text with a finding. A change of the pattern needs a new version."""

    kind: str
    pattern: str
    anchor: str
    measured: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
#: Runs of a class are found alike with the least length in the pattern, as a failing run holds no passing one.
BASE = (
    Rule("assign", _ASSIGN + "+)", _ASSIGN + "{8})", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}"),
    Rule("hex", "[0-9a-f]{32,}", "[0-9a-f]{32}"),
)
#: Public formats of tokens and keys.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
)
RULES = BASE + MORE


def spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo: names of rules) -> (blob, rule, start, end): code points, end exclusive."""
    ran = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("whole"), F.split("text", r.pattern, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.measured)).alias("part")) for r in rules]
    each = [F.when(F.array_contains("todo", r.name) & F.col("text").rlike(r.anchor), x) for r, x in zip(rules, ran, strict=True)]
    hits = blobs.select("blob", F.explode(F.array_compact(F.array(*each))).alias("h")).select("blob", "h.rule", "h.least", F.posexplode(F.arrays_zip("h.whole", "h.pieces", "h.part")).alias("nth", "m")).where(F.col("m.whole").isNotNull())
    sized = hits.select("blob", "rule", "least", "nth", (F.length("m.pieces") + F.length("m.whole")).cast("long").alias("step"), F.length("m.whole").cast("long").alias("len"), F.length("m.part").alias("held"))
    end = F.sum("step").over(Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("end", end).where("held >= least").select("blob", "rule", (F.col("end") - F.col("len")).alias("start"), "end")


class BlobLedger:
    """The ledger in a folder; `path` outlives the session, so that later scans are incremental."""

    SCANNED, FOUND = "blob binary, rules array<string>", "blob binary, rule string, start bigint, end bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("scanned", self.SCANNED), ("found", self.FOUND)):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def found(self) -> DataFrame:
        return self.spark.read.schema(self.FOUND).parquet(f"{self.path}/found")

    def scan(self, paths: DataFrame, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """paths: (blob); texts: (blob, text), any number of copies. Returns the number of blobs with rules to run."""
        names = F.array(*[F.lit(r.name) for r in rules])
        first = self.scanned().isEmpty()
        blobs = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
        known = self.scanned() if first else self.scanned().join(blobs.select("blob"), "blob", "left_semi")  # of the ledger only what is asked for
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("rules"))
        todo = blobs.withColumn("todo", names) if first else blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("rules", F.array().cast("array<string>"))))
        todo = written(todo.where(F.size("todo") > 0).select("blob", "todo"), "ledger-todo")
        n = todo.count()
        if not n:
            return 0
        anchored = F.lit(False)
        for r in rules:
            anchored = anchored | F.col("text").rlike(r.anchor)
        if first:  # all blobs are new, with all rules
            one = texts.where(anchored).groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", names)
        else:
            # Spark puts a Bloom filter of the new blobs on the texts' side of the join
            with conf(self.spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
                unseen = written(texts.join(todo.where(F.size("todo") > 0).select("blob"), "blob", "left_semi").where(anchored).groupBy("blob").agg(F.first("text").alias("text")), "ledger-unseen")
            one = unseen.join(todo, "blob")
        spans(one, rules).write.mode("append").parquet(f"{self.path}/found")  # before `scanned`: a scan cut short is done again
        todo.withColumnRenamed("todo", "rules").write.mode("append").parquet(f"{self.path}/scanned")
        return n

    def address(self, rows: DataFrame) -> DataFrame:
        """Add the paths (doc_id, blob) of a scan; return them."""
        where = f"{self.path}/paths/scan={uuid.uuid4().hex}"
        rows.write.parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(scan, doc_id, blob, rule, start, end): findings on the paths of all scans. Paths of a hot blob are many, its findings few:
        AQE splits its partition."""
        paths = self.spark.read.option("basePath", f"{self.path}/paths").parquet(f"{self.path}/paths")
        return paths.join(self.findings(rules), "blob").select("scan", "doc_id", "blob", "rule", "start", "end")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """A row a span; a span found twice (by a scan cut short) counts once."""
        return self.found().where(F.col("rule").isin([r.name for r in rules])).distinct()


def secret_scan(docs: DataFrame, ledger: BlobLedger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of docs: doc_id, blob, spans: array of (start, kind's place, kind, end), in that order.

    A null text counts as empty; nulls and repeats of doc_id are kept as they are; an empty table gives an empty result.
    Copies of a text share one scan and get the same spans.
    """
    addressed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("blob"))
    paths = ledger.address(addressed)
    texts = docs.select(text_of(text_col).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    ledger.scan(paths, texts, rules)
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    span = F.struct("start", place[F.col("rule")].alias("place"), F.split_part("rule", F.lit("@"), F.lit(1)).alias("kind"), "end")
    each = ledger.findings(rules).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # a blob has one row here, and many paths at most on the left: AQE splits a hot blob's partition
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return paths.join(each, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir), BlobLedger(spark, work_path(spark, "secret-ledger")))
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    line = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def _sql(rule: Rule, place: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, nth, len(whole) AS len, len(part) AS held,
  sum(len(piece) + len(whole)) OVER (PARTITION BY doc_id ORDER BY nth) AS stop
FROM (SELECT doc_id, unnest(range(len(regexp_extract_all(t, '{p}')))) AS nth, unnest(regexp_extract_all(t, '{p}')) AS whole,
  unnest(regexp_extract_all(t, '{p}', {rule.measured})) AS part, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS piece FROM d)
QUALIFY held >= {rule.least}"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(f'SELECT * FROM ({_sql(r, i)})' for i, r in enumerate(RULES))}),
s AS (SELECT doc_id, place, kind, stop - len AS start, kind || ':' || CAST(stop - len AS BIGINT) || ':' || CAST(stop AS BIGINT) AS line FROM m),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(line, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base, string_agg(line, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
