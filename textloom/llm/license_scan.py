"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any stretch of a text's words, WIDTH times as long as the template, wherever its lines break. It matches the template if
it contains at least THRESHOLD of the template's distinct words. Tokens are put in one global order, rarest in the corpus first. A
block that reaches `need` of a template's n tokens has one of the template's first n - need + 1 (prefix filter); so texts
without a prefix token of any template go, and pairs of a text and a template without one. Texts must have `need` of the template's
tokens at all (length filter). Each text is taken apart once; its distinct words of templates are kept for the order and both
filters. What is left are the places of the template's tokens: a block that starts at
one must have need - 1 others after it within its length (positional filter), which are counted on whole sets. The table of
templates is a fixed parameter, so its side of the join is small by definition. All steps are DataFrame operations; texts are not
shuffled, and copies of a text are searched once.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lower_ascii, text_of, written

THRESHOLD, WIDTH = 0.8, 1.5
#: Words are runs of letters and digits of ASCII and of any other character.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in lower-cased texts, as a set that Java tells sooner.
_TERM_LOWER = r"[a-z0-9\x{80}-\x{10FFFF}]+"
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
#: Sentences of public licenses and usual short notices. What follows a hyphen after a label's name is a part or form
#: of that license.
TEMPLATES = {
    "agpl": "licensed under the gnu affero general public license as published by the free software foundation",
    "all-rights-reserved": "all rights reserved",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "apache-terms": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-short": "licensed under the apache license version 2 0",
    "boost": "distributed under the boost software license version 1 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-short": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-short": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
#: Forms that are reported by their license's name alone.
FORMS = ("binary", "notice", "short", "source", "terms", "warranty")


def template_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    """Label -> distinct words; a template without words matches nothing and goes."""
    found = {k: sorted(set(re.findall(TERM, t.lower()))) for k, t in templates.items()}
    return {k: v for k, v in found.items() if v}


def ranked(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Word -> place in the global order: by the number of texts with it, then by the word. rows: (words), a text's distinct words of
    templates, as no other can be common to a block and a template; so the driver gets a row a word of the templates."""
    counts = {r["w"]: r["n"] for r in rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def prefix_index(templates: dict[str, str], order: dict[str, int], threshold: float = THRESHOLD) -> list[tuple]:
    """(w, label, n, need, width, prefix) for each distinct word of each template."""
    out = []
    for label, words in template_sets(templates).items():
        need = ceil(threshold * len(words) - 1e-9)
        first = set(sorted(words, key=order.__getitem__)[: len(words) - need + 1])
        width = ceil(WIDTH * len(re.findall(TERM, templates[label])))
        out += [(w, label, len(words), need, width, w in first) for w in words]
    return out


def license_join(texts: DataFrame, index: list[tuple]) -> DataFrame:
    """texts: (key, hits: array of (pos, w), the places of words of templates), a row a key. Returns (key, label, n, start, width,
    containment, same: the words in common), for each pair of a text and a template that has a block at or above the threshold the
    best such block, the first among equals."""
    widest = max(x[4] for x in index)
    templates = texts.sparkSession.createDataFrame(index, "w string, label string, n int, need int, width int, prefix boolean")
    met = texts.select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.w").join(F.broadcast(templates), "w")  # bounded by the templates
    pairs = met.groupBy("key", "label", "n", "need", "width").agg(F.collect_set("w").alias("have"), F.max("prefix").alias("prefix"), F.collect_list(F.struct("pos", "w")).alias("hits"))
    pairs = pairs.where(F.col("prefix") & (F.size("have") >= F.col("need")))
    places = pairs.select("key", "label", "n", "need", "width", F.explode("hits").alias("h")).select("key", "label", "n", "need", "width", "h.pos", "h.w")
    # a block is one unit long when places are divided by its width
    block = f"PARTITION BY key, label ORDER BY pos / width RANGE BETWEEN CURRENT ROW AND {1 - 0.5 / widest}D FOLLOWING"
    blocks = places.withColumn("same", F.expr(f"collect_set(w) OVER ({block})")).where(F.size("same") >= F.col("need"))
    best = blocks.groupBy("key", "label", "n", "width").agg(F.max(F.struct(F.size("same").alias("k"), (-F.col("pos")).alias("at"), F.array_sort("same").alias("same"))).alias("b"))
    return best.select("key", "label", "n", (-F.col("b.at")).alias("start"), "width", (F.col("b.k") / F.col("n")).alias("containment"), F.col("b.same").alias("same"))


def _at(words: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of the phrase among the words."""
    # array_position names only the first place; a filter with its index finds all
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)]))


def _all(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found & t
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, starts: map of phrase label to array of word places, matches: array of
    (label, containment, start), start being the word at which the template's best block begins, score.

    Of a text's templates one goes if its words in its block are all among those of a better one whose block overlaps it: of higher
    containment, then with more words, then later by name. score: 1 with a phrase, else the highest containment reported, else
    0. A null text counts as empty: no words, nothing found. Repeats and nulls of doc_id stay as they are; an empty table gives an
    empty result. Other columns of docs are not read.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for s in template_sets(templates).values() for w in s})
    # hits belong to a text, and all rows with that text share them
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(text_of(text_col)).alias("t"))
    rows = rows.select("doc_id", F.sha2("t", 256).alias("key"), F.regexp_extract_all("t", F.lit(_TERM_LOWER), F.lit(0)).alias("w"))
    has = lambda p: _all([F.array_contains("w", x) for x in (p[-1], p[0])])
    starts = F.create_map(*[x for label, p in PHRASES.items() for x in (F.lit(label), F.when(has(p), _at(F.col("w"), p)).otherwise(F.array().cast("array<int>")))])
    array = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    rows = rows.select("doc_id", "key", "w", F.size("w").cast("long").alias("n_words"), starts.alias("starts"), F.array_intersect("w", array(vocabulary)).alias("words"))
    enough = F.lit(False)
    for words in sorted(map(tuple, template_sets(templates).values())):
        enough = enough | (F.size(F.array_intersect("words", array(words))) >= ceil(threshold * len(words) - 1e-9))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("w"))), lambda h: F.array_contains(F.col("words"), h["w"]))
    rows = rows.select("doc_id", "n_words", "key", "starts", "words", F.when(enough, hits).alias("hits"))
    none = "array<struct<label:string,containment:double,start:int>>"
    if vocabulary:
        rows = written(rows, "license-rows")
        index = prefix_index(templates, ranked(rows, vocabulary), threshold)
        prefix = F.arrays_overlap("words", array(sorted({x[0] for x in index if x[5]})))
        found = license_join(rows.where(F.col("hits").isNotNull() & prefix).dropDuplicates(["key"]).select("key", "hits"), index)
        rank = lambda x: F.struct(x["containment"], x["n"], x["label"])
        over = lambda x, y: (x["start"] < y["start"] + y["width"]) & (y["start"] < x["start"] + x["width"])
        within = lambda x, y: (rank(y) > rank(x)) & over(x, y) & (F.size(F.array_except(x["same"], y["same"])) == 0)
        all_ = found.groupBy("key").agg(F.collect_list(F.struct("containment", "n", "label", "start", "width", "same")).alias("ms"))  # one a template at most
        best = F.filter("ms", lambda x: ~F.exists("ms", lambda y: within(x, y)))
        told = all_.select("key", F.array_sort(F.transform(best, lambda x: F.struct(x["label"].alias("label"), x["containment"].alias("containment"), x["start"].alias("start")))).alias("matches"))
        rows = rows.drop("hits", "words").join(written(told, "license-hits"), "key", "left")  # one row a text on the right; AQE splits a hot text's partition
    else:
        rows = rows.withColumn("matches", F.lit(None).cast(none))
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast(none)))
    any_phrase = F.exists(F.map_values("starts"), lambda a: F.size(a) > 0)
    score = F.when(any_phrase, 1.0).otherwise(F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "starts", "matches", score.alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.flatten(F.map_values("starts"))
    base = F.map_keys(F.map_filter("starts", lambda _, a: F.size(a) > 0))
    family = F.transform("matches", lambda m: F.regexp_replace(m["label"], f"-({'|'.join(FORMS)})$", ""))
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        line(base).alias("base_labels"), line(F.concat(base, family)).alias("labels"), "score",
    )


def _sql() -> str:
    order = {w: 0 for s in template_sets(TEMPLATES).values() for w in s}  # any order finds the same
    index = prefix_index(TEMPLATES, order)
    values = ", ".join(f"('{w}', '{label}', {n}, {need}, {width})" for w, label, n, need, width, _ in index)
    starts = " || ".join(f"list_transform(list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))}), lambda i: {{'label': '{label}', 'at': i}})" for label, p in PHRASES.items())
    family = f"regexp_replace(x.label, '-({'|'.join(FORMS)})$', '')"
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{TERM}') AS w FROM t),
p AS (SELECT doc_id, len(w) AS n_words, {starts} AS p FROM w),
l(word, label, n, need, width) AS (VALUES {values}),
h AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
j AS (SELECT doc_id, label, n, need, width, pos, word FROM h JOIN l USING (word)),
e AS (SELECT doc_id, label FROM j GROUP BY doc_id, label, need HAVING count(DISTINCT word) >= need),
k AS (SELECT j.* FROM j SEMI JOIN e USING (doc_id, label)),
b AS (SELECT a.doc_id, a.label, a.n, a.width, a.pos AS start, count(DISTINCT b.word) AS k, list_sort(list(DISTINCT b.word)) AS same FROM k a JOIN k b
  ON a.doc_id = b.doc_id AND a.label = b.label AND b.pos BETWEEN a.pos AND a.pos + a.width - 1 GROUP BY a.doc_id, a.label, a.n, a.width, a.need, a.pos HAVING count(DISTINCT b.word) >= a.need),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY k DESC, start) = 1),
f AS (SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE x.doc_id = y.doc_id AND (y.k::DOUBLE / y.n, y.n, y.label) > (x.k::DOUBLE / x.n, x.n, x.label)
  AND x.start < y.start + y.width AND y.start < x.start + x.width AND list_has_all(y.same, x.same))),
g AS (SELECT doc_id, list({family}) AS labels, max(k::DOUBLE / n) AS best FROM f x GROUP BY doc_id)
SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label) || coalesce(labels, []))), ','), '') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN g USING (doc_id)
"""


OP2_SQL = _sql()
