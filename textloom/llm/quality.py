"""Quality rules: word and repetition counts of each text, and line frequency across the documents of a host.

Each text's lines are normalised (A-Z lower-cased, runs of white space as one space, ends trimmed) and hashed. For each
host (the source) and line the distinct documents with it are counted, and lines above the limit are taken out. A document
that loses so much that too little is left is rejected. For the count a document is known by a digest of its whole text:
documents with any lines in common stay distinct, while thousands of copies of one text count as one.

The texts are read once, in Arrow batches. Copies are reduced to one, and counts are summed, in each task before the
shuffle, so a hot text, host or line is a row a task. A host has at most (lines a document) / (share of the limit) lines above the
limit, so they go to its documents as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, documents, small_batches, text_of, written
from .kernel import U, mix, sums_by_text, text_batches, words

#: Base rules: fewest words, and most per cent of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: A line is above the limit in more than MIN_DOCS documents and more than SHARE per cent of its host's.
MIN_DOCS, SHARE = 10, 5
#: Depleted: fewer than MIN_WORDS words left, or less than LEFT per cent.
LEFT = 30

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))
_INNER = (np.arange(256) & 0xC0) == 0x80
_LINES = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))
_SCHEMA = "doc_id {id}, host string, key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<hash:bigint,words:int>>"


def repeated(w, n: int) -> np.ndarray:
    """For each text the number of words in windows of n words that occur twice or more in it."""
    hashes, at = w.runs(n)
    if not len(at):
        return np.zeros(len(w.first) - 1, np.int64)
    own = mix(hashes + mix(w.of[at].astype(U) + U(1)))  # told apart by text
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return sums_by_text((np.cumsum(cover[:-1]) > 0).astype(np.int64), w.first)


def _lines(data: np.ndarray, bounds: np.ndarray, w) -> tuple[list, np.ndarray]:
    """For each text its distinct normalised lines (hash, words in all their places), and the number of lines equal to an
    earlier one."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    firsts = np.searchsorted(w.start, np.append(starts, len(data)))  # the lines' words
    counts = np.diff(firsts)
    weights = (np.arange(len(w.hash)) - np.repeat(firsts[:-1], counts)).astype(U) * U(2) + U(1)
    run = np.concatenate([[U(0)], np.cumsum(mix(w.hash) * mix(weights), dtype=U)])
    hashes = mix(run[firsts[1:]] - run[firsts[:-1]] + counts.astype(U)).astype(np.int64)
    raw, ends = data.tobytes(), np.append(starts[1:], len(data))
    text_of_line = np.searchsorted(bounds, starts, "right") - 1
    first_line = np.searchsorted(text_of_line, np.arange(len(bounds)))
    told, again = [], np.zeros(len(bounds) - 1, np.int64)
    for t in range(len(bounds) - 1):
        seen, own = set(), {}
        for i in range(first_line[t], first_line[t + 1]):
            if counts[i]:
                line = raw[starts[i] : ends[i]].removesuffix(b"\n")
                again[t] += line in seen
                seen.add(line)
                h = int(hashes[i])
                own[h] = own.get(h, 0) + int(counts[i])
        told.append([{"hash": h, "words": n} for h, n in own.items()])
    return told, again


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each row of docs: the base counts, a digest of the text (key) and the distinct normalised lines."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_batches(batch.column(3)):
                w = words(data, bounds, lower=True)
                exact = words(data, bounds, lower=False)
                chars = np.concatenate([[0], np.cumsum(~_INNER[data])])
                marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
                in_words = sums_by_text(chars[w.end] - chars[w.start], w.first)
                lines, again = _lines(data, bounds, w)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), *(pa.array(x.astype(np.int64)) for x in (w.counts, in_words, np.diff(marks[bounds]), again, repeated(exact, WINDOW))), pa.array(lines, _LINES)],
                    names=["doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
                )

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, _SCHEMA.format(id=kind))


def common_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, common: hashes of the lines above the limit), a row a host that has any. rows: host, key, lines."""
    texts = rows.where(F.size("lines") > 0).select("host", "key", "lines").dropDuplicates(["host", "key"])
    by_line = texts.select("host", F.explode("lines.hash").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = rows.where(F.size("lines") > 0).select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    over = by_line.where(F.col("n") > min_docs).join(hosts.select(F.col("host").alias("h"), "docs"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") * 100 > F.col("docs") * share)
    return over.groupBy(F.col("host").alias("h")).agg(F.collect_list("line").alias("common"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed
    (words in lines above the limit), depleted, kept.

    A null text counts as empty, which fails the base rules; null hosts are one host; repeats and nulls of doc_id stay
    as they are; an empty table gives an empty result. In a host of min_docs documents or fewer nothing is removed.
    """
    small_batches(docs.sparkSession)
    rows = written(measured(docs, id_col, text_col, host_col), "quality-lines")
    common = written(common_lines(rows, min_docs, share), "quality-common")
    told = rows.join(common, F.col("host").eqNullSafe(F.col("h")), "left")
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains(F.col("common"), x["hash"])), F.lit(0).cast("long"), lambda s, x: s + x["words"])
    told = told.withColumn("n_removed", F.when(F.col("common").isNull(), F.lit(0).cast("long")).otherwise(gone))
    left = F.col("n_words") - F.col("n_removed")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = (F.col("n_removed") > 0) & ((left < MIN_WORDS) | (100 * left < LEFT * F.col("n_words")))
    told = told.withColumn("base_failed", base_failed).withColumn("depleted", depleted)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


#: Lines as they are: the SQL compares normalised lines and whole texts, where the operator compares their hashes.
OP7_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM t),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range({WINDOW})) AS k) GROUP BY r),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM t),
n AS (SELECT *, array_to_string(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{WORD}'), ' ') AS norm, len(regexp_extract_all(line, '{WORD}')) AS k FROM l WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM n GROUP BY r),
o AS (SELECT source, count(DISTINCT t) AS docs FROM n GROUP BY source),
c AS (SELECT f.source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM n GROUP BY source, norm) f JOIN o ON f.source IS NOT DISTINCT FROM o.source
  WHERE f.n > {MIN_DOCS} AND f.n * 100 > o.docs * {SHARE}),
gone AS (SELECT n.r, sum(k) AS k FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.norm = c.norm GROUP BY n.r),
b AS (SELECT t.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.k, 0) AS n_removed FROM t JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  n_removed > 0 AND (n_words - n_removed < {MIN_WORDS} OR 100 * (n_words - n_removed) < {LEFT} * n_words) AS depleted FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(n_removed AS BIGINT) AS n_removed, depleted, NOT base_failed AND NOT depleted AS kept FROM v
"""
