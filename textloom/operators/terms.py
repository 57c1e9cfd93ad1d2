"""Terminology: a glossary of terms with a source phrase and approved, discouraged and other renderings; scans of source and
translation; the status of each term in each document.

glossary: (term_id, source: words of the source phrase, kind, form: words of a rendering), a row a rendering; kinds are approved,
translit, discouraged and unattested. terms: (term_id, source, ambiguous, scan_alone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that satisfy a term.
GOOD = ("approved", "translit")


def merged(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records: (record_id, source, rank, wrong_sense, ambiguous, scan_alone, forms: array of (kind, form)). Senses with the same
    source phrase are one term, named by it; wrong senses go; renderings keep the order of senses, and equal ones count once. Returns
    (terms, glossary)."""
    rows = records.where(~F.coalesce("wrong_sense", F.lit(False))).withColumn("key", F.array_join("source", " "))
    terms = rows.groupBy(F.col("key").alias("term_id")).agg(F.first("source").alias("source"), F.max(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"), F.max(F.coalesce("scan_alone", F.lit(False))).alias("scan_alone"))
    forms = rows.select(F.col("key").alias("term_id"), "source", "rank", "record_id", F.posexplode("forms").alias("nth", "f")).select("term_id", "source", "rank", "record_id", "nth", "f.kind", "f.form")
    first = F.min(F.struct("rank", "record_id", "nth")).alias("place")
    return terms, forms.groupBy("term_id", "source", "kind", "form").agg(first)


def places(docs: DataFrame, words: str, phrases: DataFrame, phrase: str, *keep: str) -> DataFrame:
    """(doc_id, keep, start, end): every place where a phrase (an array of words) stands in a document's words. A phrase is looked
    up by its first word, the rest of it is compared at the place."""
    head = phrases.select(*keep, F.col(phrase).alias("_p"), F.element_at(phrase, 1).alias("_w")).where(F.size(phrase) > 0)
    at = docs.select("doc_id", F.col(words).alias("_d"), F.posexplode(words).alias("start", "_w"))
    met = at.join(head, "_w").where(F.slice("_d", F.col("start") + 1, F.size("_p")) == F.col("_p"))
    return met.select("doc_id", *keep, F.col("start").cast("long").alias("start"), (F.col("start") + F.size("_p")).cast("long").alias("end"))


def consumed(hits: DataFrame, *keep: str) -> DataFrame:
    """Of a document's hits the longest at each place, from left to right, none within or over one taken before. A stretch of hits
    that overlap is settled on its own, as an array fold, so a document is only as much work as its longest such stretch."""
    longest = F.row_number().over(Window.partitionBy("doc_id", "start").orderBy(F.desc("end"), *keep))
    rows = hits.withColumn("_n", longest).where("_n = 1")
    w = Window.partitionBy("doc_id").orderBy("start")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_isl", F.when(far.isNull() | (F.col("start") >= far), 1).otherwise(0)).withColumn("_isl", F.sum("_isl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = rows.groupBy("doc_id", "_isl").agg(F.array_sort(F.collect_list(F.struct("start", "end", *keep))).alias("h"))
    take = lambda taken, x: F.when((F.size(taken) == 0) | (x["start"] >= F.element_at(taken, -1)["end"]), F.concat(taken, F.array(x))).otherwise(taken)
    kept = F.aggregate(F.slice("h", 2, F.size("h")), F.slice("h", 1, 1), take)
    return stretch.select("doc_id", F.explode(kept).alias("h")).select("doc_id", *[F.col(f"h.{k}").alias(k) for k in (*keep, "start", "end")])


def source_terms(docs: DataFrame, words: str, terms: DataFrame) -> DataFrame:
    """(doc_id, term_id, times, first): the terms in each source text, how often, and where first."""
    hits = consumed(places(docs, words, terms, "source", "term_id"), "term_id")
    return hits.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("times"), F.min("start").alias("first"))


def rendering_hits(docs: DataFrame, words: str, glossary: DataFrame) -> DataFrame:
    """(doc_id, term_id, kind, form, start, end): renderings in each translation, of one term and kind the longest at a place; hits of
    different terms may overlap."""
    hits = places(docs, words, glossary.select("term_id", "kind", F.array_join("form", " ").alias("form"), F.col("form").alias("_f")), "_f", "term_id", "kind", "form")
    longest = F.row_number().over(Window.partitionBy("doc_id", "term_id", "kind", "start").orderBy(F.desc("end")))
    return hits.withColumn("_n", longest).where("_n = 1").drop("_n")


def bilingual(present: DataFrame, hits: DataFrame, terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, term_id, status, found): the status of each term present in a source text, by its translation's hits. A discouraged
    rendering comes first, unless it is the approved one of another term present (VARIANT); then a good one (APPROVED), an
    unattested one (VARIANT); without any, ambiguous terms are passed over, terms without an approved rendering are
    NOT_IN_GLOSSARY, others MISSING."""
    mine = hits.join(present.select("doc_id", "term_id"), ["doc_id", "term_id"], "left_semi")
    good = mine.where(F.col("kind").isin(*GOOD))
    others = good.select("doc_id", "form", F.col("term_id").alias("_t")).distinct()
    taken = mine.where("kind = 'discouraged'").join(others, ["doc_id", "form"]).where("_t <> term_id").select("doc_id", "term_id", "form").distinct()
    bad = mine.where("kind = 'discouraged'").join(taken, ["doc_id", "term_id", "form"], "left_anti")
    first = lambda rows, name: rows.groupBy("doc_id", "term_id").agg(F.min(F.struct("start", "form")).alias(name))
    rows = present.join(first(bad, "bad"), ["doc_id", "term_id"], "left").join(first(good, "good"), ["doc_id", "term_id"], "left")
    rows = rows.join(first(mine.where("kind = 'unattested'"), "odd"), ["doc_id", "term_id"], "left")
    known = glossary.where("kind = 'approved'").select("term_id").distinct().withColumn("known", F.lit(True))
    rows = rows.join(terms.select("term_id", "ambiguous"), "term_id").join(known, "term_id", "left")
    rest = F.when(F.col("ambiguous"), F.lit(None).cast("string")).when(F.col("known").isNull(), "NOT_IN_GLOSSARY").otherwise("MISSING")
    status = F.when(F.col("bad").isNotNull(), "VARIANT").when(F.col("good").isNotNull(), "APPROVED").when(F.col("odd").isNotNull(), "VARIANT").otherwise(rest)
    return rows.select("doc_id", "term_id", status.alias("status"), F.coalesce("bad.form", "good.form", "odd.form").alias("found")).where("status IS NOT NULL")


def other_language(present: DataFrame, hits: DataFrame, terms: DataFrame, latin: Column) -> DataFrame:
    """(doc_id, term_id, status, found) for translations in languages without approved renderings: APPROVED where the transliteration
    is kept and the script is Latin (latin: of a row of present); ambiguous terms are passed over; else NOT_IN_GLOSSARY."""
    kept = hits.where("kind = 'translit'").groupBy("doc_id", "term_id").agg(F.min(F.struct("start", "form")).alias("kept"))
    rows = present.withColumn("_l", latin).join(kept, ["doc_id", "term_id"], "left").join(terms.select("term_id", "ambiguous"), "term_id")
    ok = F.col("_l") & F.col("kept").isNotNull()
    status = F.when(ok, "APPROVED").when(~F.col("ambiguous"), "NOT_IN_GLOSSARY")
    return rows.select("doc_id", "term_id", status.alias("status"), F.when(ok, F.col("kept.form")).alias("found")).where("status IS NOT NULL")


def consistency(hits: DataFrame, sentence: Column, terms: DataFrame) -> DataFrame:
    """(doc_id, term_id, status, spellings) without a source text, for terms that may be scanned alone and have a transliteration or an
    unattested rendering among the outermost hits: VARIANT for a discouraged rendering in a sentence that names the term, for an
    unattested one, or for several spellings; else APPROVED. sentence: the number of a hit's sentence; hits have `spelling`."""
    alone = hits.withColumn("_s", sentence).join(terms.where("scan_alone").select("term_id"), "term_id", "left_semi")
    named = alone.where("kind = 'translit'").select("doc_id", "term_id", "_s").distinct()
    reduced = alone.where("kind = 'discouraged'").join(named, ["doc_id", "term_id", "_s"], "left_semi").select("doc_id", "term_id").distinct().withColumn("reduced", F.lit(True))
    rows = alone.where(F.col("kind").isin("translit", "unattested")).groupBy("doc_id", "term_id").agg(
        F.count(F.when(F.col("kind") == "unattested", 1)).alias("odd"), F.count_distinct(F.when(F.col("kind") == "translit", F.col("spelling"))).alias("spellings")
    )
    rows = rows.join(reduced, ["doc_id", "term_id"], "left")
    variant = F.col("reduced").isNotNull() | (F.col("odd") > 0) | (F.col("spellings") > 1)
    return rows.select("doc_id", "term_id", F.when(variant, "VARIANT").otherwise("APPROVED").alias("status"), "spellings")


def clarity_entries(terms: DataFrame, glossary: DataFrame, least: int = 3) -> DataFrame:
    """(term_id, surface): transliterations of `least` characters or more of terms that may be scanned alone: what text surgery must
    leave as it is."""
    rows = glossary.where("kind = 'translit'").join(terms.where("scan_alone").select("term_id"), "term_id", "left_semi")
    return rows.select("term_id", F.array_join("form", " ").alias("surface")).where(F.length("surface") >= least).distinct()


def tally(status: DataFrame, top: int = 40) -> DataFrame:
    """(term_id, approved, variant, missing, not_in_glossary, total): documents by status, the terms with most of them first."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    rows = status.groupBy("term_id").agg(*map(n, ("APPROVED", "VARIANT", "MISSING", "NOT_IN_GLOSSARY")), F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("total"), "term_id").limit(top)
