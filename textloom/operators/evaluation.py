"""Vectors, extraction from pages and texts, and statistics of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx
from .passages import value_at

# --- vectors ---------------------------------------------------------------------------------------------------------


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid, n): the mean of unit vectors of a key, made a unit vector again. Means are taken a dimension at a time,
    so a key's rows need not meet in one task."""
    rows = vectors.where(F.col(vector).isNotNull()).select(key, F.posexplode(sm.unit(F.col(vector))).alias("d", "x"))
    means = rows.groupBy(key, "d").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"), F.max("n").alias("n"))
    return joined.select(key, sm.unit(F.col("c")).alias("centroid"), "n")


def vector_top(queries: DataFrame, index: DataFrame, k: int, query: str = "q", key: str = "key") -> DataFrame:
    """(query, key, score, place): the k keys of the index with the largest dot product, for a stated query set against the
    whole index. queries: (query, qv); index: (key, v), both unit vectors. Each task keeps its k best before the shuffle."""
    scored = queries.crossJoin(index).select(query, key, F.round(sm.dot(F.col("qv"), F.col("v")), 6).alias("score"))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))  # Spark limits groups before the exchange
    return scored.withColumn("place", best.cast("long")).where(F.col("place") <= k)


def confident(top: DataFrame, query: str = "q", sure: float = 0.82, floor: float = 0.75, margin: float = 0.08) -> DataFrame:
    """(query, key, score, margin, confident): the best key of each query; sure by its score, or by its lead."""
    w = Window.partitionBy(query).orderBy("place")
    rows = top.withColumn("margin", F.round(F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)), 6)).where("place = 1")
    return rows.select(query, "key", "score", "margin", ((F.col("score") >= sure) | (F.col("score") >= floor) & (F.col("margin") >= margin)).alias("confident"))


def fused(parts: list[tuple[DataFrame, float]], query: str = "q", key: str = "key") -> DataFrame:
    """(query, key, score): weighted sum of scores, held within 0 and 1."""
    rows = None
    for df, weight in parts:
        one = df.select(query, key, (F.col("score") * weight).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(query, key).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("s"))), 4).alias("score"))


# --- extraction ------------------------------------------------------------------------------------------------------


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, nth, kind, text): the texts of <p> elements in order, the first of each beginning (120 characters) kept."""
    p = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)))
    rows = pages.select("page_id", p.alias("nth", "raw")).withColumn("text", tx.strip_markup(F.col("raw"))).where("text <> ''")
    first = F.row_number().over(Window.partitionBy("page_id", F.substring("text", 1, 120)).orderBy("nth"))
    kind = F.when(F.col("text").rlike("^[\"“«]"), "quote").otherwise("prose")
    return rows.withColumn("_n", first).where("_n = 1").select("page_id", F.col("nth").cast("long").alias("nth"), kind.alias("kind"), "text")


def with_neighbours(paras: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("nth")
    return paras.select("page_id", "nth", F.lag("text").over(w).alias("before"), "text", F.lead("text").over(w).alias("after"))


def negatives(paras: DataFrame, least: int = 180) -> DataFrame:
    """Long prose without quotation marks or references: material in which nothing is to be found."""
    return paras.where((F.length("text") >= least) & (F.col("kind") == "prose") & ~F.col("text").rlike("[\"“”«»]") & ~F.col("text").rlike(r"[0-9]+\s*:\s*[0-9]+"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, title, n_links, links): title, and distinct targets in order of appearance."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('(?i)<a\\s+href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", tx.strip_markup(title).alias("title"), F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


# --- statistics ------------------------------------------------------------------------------------------------------


def summary(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for one), least, largest and number of each metric."""
    return rows.groupBy(metric).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def rates(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """Per cent of rows with the flag, for each group and over all (null)."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(flag, 1).otherwise(0)).alias("hits"), F.round(100.0 * F.sum(F.when(flag, 1).otherwise(0)) / F.count(F.lit(1)), 4).alias("rate"))


def confusion(rows: DataFrame, true: str, predicted: str, most: int = 6) -> DataFrame:
    return rows.where(F.col(true) != F.col(predicted)).groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), true, predicted).limit(most)


def hash_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in an order that only the seed decides."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(n, digest): one digest of all rows in any order: the sums of two 32-bit parts of each row's SHA-256."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys + columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("long"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", part(1).cast("string"), part(9).cast("string")).alias("digest"))


def round_robin(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first of each group, then the second of each, until n."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("nth", nth.cast("long")).where(F.col("nth") <= n).orderBy("nth", by).limit(n)


def percentile(rows: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """(by, p): sorted(value)[int(share * (n - 1))] of each group, from how often each value occurs."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return value_at(counts, "p", share, by)
