"""Exact dedup by stateful streaming: keyed state on disk, without expiry, and a check of full bytes on hits.

1. Content index: one slim row per document (digest of the normalised text, identifier, locator), written once. The
   locator is the Parquet file and the row's place in it, so that it finds the content again, in later runs too; documents
   that come from anything but Parquet files are written first.
2. A Structured Streaming aggregation reads the index as it grows. Its state lives in RocksDB and keeps, for each digest,
   the winner's identifier and locator and the number of rows. Rows of a hot digest are summed in each task before the
   shuffle. With a folder of the caller's, later calls add their documents to the index and the state of earlier ones.
3. Hits (digests with several rows) are compared byte by byte, with contents of earlier calls fetched by their locators; a
   digest with two texts is told apart by text.

All steps are DataFrame operations. At no point do texts without a hit leave their task: only hits' texts are shuffled,
behind a Bloom filter that Spark builds from the digests with several rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import conf, located, lower_ascii, remove, scratch, text_of, those, work_path, written

#: A digest with more than one part in HOT of all rows is hot.
HOT = 1000
#: Rows of the index for a partition of the state, about, and most partitions; their number stays that of the first call.
STATE_ROWS, STATE_PARTITIONS = 50_000, 10_000
#: RocksDB's memory in an executor, for all its partitions of the state.
STATE_MB = 128
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def content_index(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """rows: of located(). (id, digest, loc, file)."""
    text = text_of(F.col(f"carried.`{text_col}`"))
    return rows.select(F.col(f"carried.`{id_col}`").alias("id"), digest(lower_ascii(text)).alias("digest"), "loc", "file")


def keyed_state(spark: SparkSession, index_path: str, checkpoint: str) -> DataFrame:
    """Bring the state up to date with all files of the index; return (digest, win(id, loc), n)."""
    index = spark.read.parquet(index_path)
    parts = min(STATE_PARTITIONS, max(1, ceil(index.count() / STATE_ROWS)))
    state = spark.readStream.schema(index.schema).parquet(index_path).groupBy("digest").agg(F.max(F.struct("id", "loc")).alias("win"), F.count(F.lit(1)).alias("n"))
    store = "spark__sql__streaming__stateStore__"
    # stores of few keys must not reserve megabytes each for logs, nor upload whole files for each batch; all of an executor's
    # stores share one bound of memory, and those of ended queries are closed soon
    small = {f"{store}rocksdb__allowFAllocate": "false", f"{store}rocksdb__changelogCheckpointing__enabled": "true", f"{store}rocksdb__boundedMemoryUsage": "true", f"{store}rocksdb__maxMemoryUsageMB": str(STATE_MB), f"{store}unloadOnCommit": "true"}
    with conf(spark, **{f"{store}providerClass": ROCKSDB, "spark__sql__shuffle__partitions": str(parts)}, **small):
        run = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        finally:
            run.stop()
    kept = spark.read.format("statestore").load(checkpoint)
    win, n = kept.schema["value"].dataType.names[:2]
    return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{win}").alias("win"), F.col(f"value.{n}").alias("n"))


def _texts(rows: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, id, loc, t) of located rows."""
    return rows.select(lower_ascii(text_of(F.col(f"carried.`{text_col}`"))).alias("t"), "loc").select(digest(F.col("t")).alias("digest"), "loc", "t")


def _earlier(index: DataFrame, known: DataFrame, hits: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame | None:
    """(digest, loc, t) of the hits' contents that earlier calls saw, found by their locators; None without any. known: the
    index of this call."""
    wanted = written(index.join(hits.select("digest"), "digest", "left_semi").join(known.select("loc"), "loc", "left_anti").select("loc", "file"), "dedup-wanted")
    files = [r["file"] for r in wanted.select("file").distinct().toLocalIterator()]  # files with hits, as the driver lists files anyway
    if not files:
        return None
    spark = index.sparkSession
    return _texts(located(spark.read.parquet(*files), "dedup-earlier").join(wanted.select("loc"), "loc", "left_semi"), text_col, digest)


def _met(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of texts whose digest is a hit. Hot digests are looked up where the texts are; for the others Spark puts a Bloom
    filter of the digests with several rows before the shuffle."""
    hot = hits.where("hot").select("digest")  # fewer than HOT
    return texts.join(F.broadcast(hot), "digest", "left_semi").union(texts.join(hits.where("not hot").select("digest"), "digest", "left_semi"))


def _told(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], state: str | None) -> DataFrame:
    """rows: of located(). (id, loc, win: (id, loc), n, sha) for each."""
    spark = rows.sparkSession
    folder = state.rstrip("/") if state else work_path(spark, "dedup-state")
    known = written(content_index(rows, id_col, text_col, digest), "dedup-known")
    known.write.mode("append").parquet(f"{folder}/index")
    groups = written(keyed_state(spark, f"{folder}/index", f"{folder}/checkpoint"), "dedup-groups")
    index = spark.read.schema(known.schema).parquet(f"{folder}/index") if state else known
    if not state:
        remove(spark, folder)
    total = groups.agg(F.sum("n")).first()[0] or 0
    hits = groups.where("n > 1").select("digest", (F.col("n") * HOT > total).alias("hot"))
    texts, before = _texts(rows, text_col, digest), None
    if state:
        hits = written(hits.join(known.select("digest").distinct(), "digest", "left_semi"), "dedup-hits")
        before = _earlier(index, known, hits, text_col, digest)
    bloom = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g"}
    with conf(spark, **{f"spark__sql__optimizer__runtime__bloomFilter__{k}": v for k, v in bloom.items()}):
        met = _met(texts, hits) if before is None else _met(texts, hits).union(before)
        ends = met.groupBy("digest").agg(F.min("t").alias("least"), F.max("t").alias("most"))
        odd = written(ends.where("least <> most").select("digest"), "dedup-odd")
    sha = F.lower(F.hex("digest")) if digest is sha256 else None
    if odd.isEmpty() and sha is not None:
        return known.join(groups, "digest").select("id", "loc", "win", "n", sha.alias("sha"))
    # by text within the digests that differ; by digest elsewhere
    met = written((texts if before is None else texts.union(before)).join(odd, "digest", "left_semi"), "dedup-texts")
    own = met.join(index.select("id", "loc"), "loc")
    split = own.groupBy("digest", "t").agg(F.max(F.struct("id", "loc")).alias("win"), F.count(F.lit(1)).alias("n"))
    by_text = known.select("id", "loc").join(met.join(split, ["digest", "t"]), "loc").select("id", "loc", "win", "n", F.sha2("t", 256).alias("sha"))
    rest = known.join(odd, "digest", "left_anti").join(groups, "digest")
    if sha is None:
        rest = rest.join(texts.select("loc", F.sha2("t", 256).alias("sha")), "loc")
    else:
        rest = rest.withColumn("sha", sha)
    return rest.select("id", "loc", "win", "n", "sha").unionByName(by_text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest identifier stays; a null identifier
    is below all others, and identifiers are of any type that can be ordered. Rows that repeat identifier and text are one
    group and just one of them is kept. A null text counts as empty. An empty table gives an empty result. Other columns of docs are
    not read.

    state: a folder of the caller's, empty at first, for streams of documents: the documents of all calls with it count, and
    each call returns rows for its own, as things stand after it. A document is given once. Its Parquet file must stay, as the
    state holds its place there and not its text.
    """
    found = _told(located(docs, "dedup-content"), id_col, text_col, digest, state)
    return found.select(F.col("id").alias("doc_id"), F.col("win.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("loc") == F.col("win.loc")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns under whatever names; nulls, repeats and empty tables
    as in exact_dedup()."""
    rows = located(docs, "dedup-content")
    with scratch(docs.sparkSession) as keep:
        kept = keep(written(_told(rows, id_col, text_col, sha256, None).where("loc = win.loc").select("loc"), "dedup-kept"))
    return those(rows, kept)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
