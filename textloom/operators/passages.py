"""Attribution of documents to approved renderings of passages: index, candidates, comparison, state and report.

A passage (id) has renderings, one an edition. Documents meet passages through words they share: n-grams for verbatim
quotes, weighted words for the rest. All joins are on equal keys; only pairs that share a run are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx

# Words of a run that makes a pair a candidate; windows and candidates of the lexical search; least inverse document
# frequency of a word in the index; window sizes.
RUN, SMALL_RUN, TOP, KEEP = 8, 4, 5, 0.4
MIN_IDF = 2.0
WINDOWS = (8, 12, 18, 26, 36, 50)


def renderings(passages: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Three editions of each passage, derived from its text: as it is; in lower case without each seventh word; with a
    footnote behind a rule."""
    w = F.split(F.coalesce(F.col(text_col), F.lit("")), " ")
    shorter = F.lower(F.array_join(F.filter(w, lambda _, i: i % 7 != 6), " "))
    noted = F.concat(F.col(text_col), F.lit(" ____ [1] note "), F.array_join(F.slice(w, 1, 5), " "))
    edition = F.explode(F.array(*[F.struct(F.lit(i).alias("edition"), t.alias("text")) for i, t in enumerate((F.col(text_col), shorter, noted))]))
    return passages.select(F.col(id_col).alias("item_id"), edition.alias("e")).select("item_id", "e.edition", "e.text")


def words_of(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col), tx.tokens(F.col(text_col)).alias("w"))


# --- index -----------------------------------------------------------------------------------------------------------


def document_frequency(rend: DataFrame) -> DataFrame:
    """(token, df): renderings with the word."""
    return rend.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def postings(rend: DataFrame) -> DataFrame:
    """(token, item_id, weight): idf * editions with the word / editions / sqrt(shortest edition's length), for words of
    MIN_IDF or more."""
    n = rend.agg(F.count(F.lit(1)).alias("n_docs"))
    sized = rend.select("item_id", "edition", F.length(tx.normalize(F.col("text"))).alias("len"), tx.tokens(F.col("text")).alias("w"))
    per_item = sized.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ed"), F.min("len").alias("shortest"))
    hits = sized.select("item_id", F.explode(F.array_distinct("w")).alias("token")).groupBy("token", "item_id").agg(F.count(F.lit(1)).alias("c"))
    idf = document_frequency(rend).crossJoin(F.broadcast(n)).select("token", F.log(F.col("n_docs") / (1 + F.col("df"))).alias("idf")).where(F.col("idf") >= MIN_IDF)  # n is one row
    weight = F.col("idf") * F.col("c") / F.col("n_ed") / F.sqrt(F.greatest(F.lit(1), F.col("shortest")))
    return hits.join(idf, "token").join(per_item, "item_id").select("token", "item_id", weight.alias("weight"))


def shortest(rend: DataFrame) -> DataFrame:
    return rend.groupBy("item_id").agg(F.min(F.size(tx.tokens(F.col("text")))).cast("long").alias("ref_len"))


def upper_median(value: Column) -> Column:
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def value_at(counts: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """(keys, value): sorted(x)[int(share * (n - 1))] of a group's values, from (keys, value, n): how often each occurs. Only distinct
    values are ordered, so a group of any number of rows is as small as its range of values."""
    w = Window.partitionBy(*keys)
    rows = counts.withColumn("_to", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    return rows.where(F.col("_to") > F.floor(F.lit(share) * (F.col("_all") - 1))).groupBy(*keys).agg(F.min(value).alias(value))


def window_ladder(rend: DataFrame) -> DataFrame:
    """Window sizes for the search: the base sizes up to the 95th percentile of lengths, and that length."""
    sizes = rend.groupBy(F.size(tx.tokens(F.col("text"))).alias("p95")).agg(F.count(F.lit(1)).alias("n"))
    p95 = value_at(sizes, "p95", 0.95)
    ladder = F.array_sort(F.array_distinct(F.concat(F.filter(F.array(*map(F.lit, WINDOWS)), lambda s: s <= F.col("p95")), F.array("p95"))))
    return p95.select("p95", F.explode(ladder).alias("window"))


def plain_renderings(rend: DataFrame, most: float = 1.6) -> DataFrame:
    """Renderings up to their footnote rule, without those longer than `most` times the upper median of their passage."""
    cut = rend.select("item_id", "edition", F.trim(tx.first_part(F.col("text"))).alias("plain")).withColumn("n", F.size(tx.tokens(F.col("plain"))))
    mid = cut.groupBy("item_id").agg(upper_median(F.col("n")).alias("mid"))
    return cut.join(mid, "item_id").where(F.col("n") <= most * F.col("mid")).select("item_id", "edition", "plain", F.col("n").cast("long").alias("n"))


# --- pairs -----------------------------------------------------------------------------------------------------------


def sharing(docs: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """docs without those that surely share no run of n words with a passage: runs meet as hashes of 64 bits, so nothing else is made
    or dealt of the texts that stay out. Hashes that clash let a document too many through."""
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)]))
    # a filter on w would make its words a second time
    runs = lambda rows, key: words_of(rows, key).select(key, F.explode(F.when(F.size("w") >= n, hashes).otherwise(F.array().cast("array<long>"))).alias("g"))
    met = runs(docs, "doc_id").join(runs(passages, "item_id").select("g").distinct(), "g", "left_semi").select(F.col("doc_id").alias("_met")).distinct()
    return docs.join(met, F.col("doc_id").eqNullSafe(F.col("_met")), "left_semi")


def shared_runs(docs: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """(doc_id, item_id, shared, of_passage): distinct runs of n words in common, and the passage's."""
    d = words_of(sharing(docs, passages, n), "doc_id").select("doc_id", F.explode(tx.shingles(F.col("w"), n)).alias("g"))
    p = words_of(passages, "item_id").select("item_id", tx.shingles(F.col("w"), n).alias("gs")).select("item_id", F.size("gs").alias("of_passage"), F.explode("gs").alias("g"))
    return d.join(p, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.first("of_passage").cast("long").alias("of_passage"))


def coverage(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Which documents quote which passages, and how completely."""
    cov = F.round(F.col("shared") / F.col("of_passage"), 6)
    return shared_runs(docs, passages, RUN).select("doc_id", "item_id", "shared", "of_passage", cov.alias("coverage"), sm.state(cov).alias("state"))


def word_pairs(docs: DataFrame, passages: DataFrame, n: int = RUN) -> DataFrame:
    """(doc_id, item_id, dw, pw): the words of pairs that share a run of n words. Only documents of such pairs are read for their
    words."""
    pairs = shared_runs(docs, passages, n).select("doc_id", "item_id")
    met = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    return pairs.join(words_of(met, "doc_id").withColumnRenamed("w", "dw"), "doc_id").join(words_of(passages, "item_id").withColumnRenamed("w", "pw"), "item_id")


def common_runs(docs: DataFrame, passages: DataFrame, n: int = SMALL_RUN) -> DataFrame:
    """(doc_id, item_id, run, i, j): every maximal run of n words or more in common, and where it starts in the document and the
    passage. Both sides are tokenised once; equal runs of n words meet with their places, lie on diagonals, and consecutive
    ones on a diagonal are one longer run."""
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.when(F.size("w") >= n, runs).otherwise(F.array().cast("array<string>"))
    placed = lambda rows, key, at: words_of(rows, key).select(key, F.posexplode(runs).alias(at, "g"))
    hits = placed(sharing(docs, passages, n), "doc_id", "i").join(placed(passages, "item_id", "j"), "g").select("doc_id", "item_id", "i", "j", (F.col("i") - F.col("j")).alias("diag"))
    w = Window.partitionBy("doc_id", "item_id", "diag").orderBy("i")
    islands = hits.withColumn("isl", F.col("i") - F.row_number().over(w)).groupBy("doc_id", "item_id", "diag", "isl")
    return islands.agg((F.count(F.lit(1)) + (n - 1)).alias("run"), F.min("i").alias("i"), F.min("j").alias("j")).select("doc_id", "item_id", "run", "i", "j")


def run_spans(docs: DataFrame, passages: DataFrame, n: int = SMALL_RUN) -> DataFrame:
    """(doc_id, item_id, start, end): the document's words in each maximal run of n words or more in common with a passage."""
    runs = common_runs(docs, passages, n)
    return runs.select("doc_id", "item_id", F.col("i").cast("long").alias("start"), (F.col("i") + F.col("run")).alias("end"))


def longest_run(docs: DataFrame, passages: DataFrame, n: int = RUN) -> DataFrame:
    """(doc_id, item_id, run, doc_start, passage_start): the longest run of n words or more in common, the earliest among equals."""
    best = common_runs(docs, passages, n).groupBy("doc_id", "item_id").agg(F.max(F.struct("run", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.run").alias("run"), (-F.col("b.i")).cast("long").alias("doc_start"), (-F.col("b.j")).cast("long").alias("passage_start"))


def contained_segment(pairs: DataFrame) -> DataFrame:
    """(doc_id, item_id, best): the largest sum over a stretch of the document's words, +1 for words of the passage, -2 for
    others: prefix sums less their least before."""
    rows = pairs.select("doc_id", "item_id", F.posexplode(F.transform("dw", lambda x: F.when(F.array_contains(F.col("pw"), x), 1).otherwise(-2))).alias("i", "v"))
    w = Window.partitionBy("doc_id", "item_id").orderBy("i")
    sums = rows.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.coalesce(F.least(F.lit(0), F.min("s").over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0))
    return sums.withColumn("m", F.col("s") - low).groupBy("doc_id", "item_id").agg(F.max("m").alias("best"))


# --- candidates ------------------------------------------------------------------------------------------------------


def sliding_windows(docs: DataFrame, size: int, stride: int) -> DataFrame:
    """(doc_id, start, words) of each window; a shorter document is one."""
    w = words_of(docs, "doc_id").where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size), F.lit(stride)))
    return w.select("doc_id", "w", starts.alias("start")).select("doc_id", "start", F.slice("w", F.col("start") + 1, F.lit(size)).alias("words"))


def lexical_top(windows: DataFrame, post: DataFrame, k: int = TOP, keep: float = KEEP) -> DataFrame:
    """(doc_id, start, item_id, score, place): for each window the k passages with the largest sum of weights of words in
    common, as shares of the best, at least `keep`."""
    return _top(windows.select("doc_id", "start", F.explode(F.array_distinct("words")).alias("token")).join(post, "token"), k, keep)


def lexical_ladder(words: DataFrame, post: DataFrame, sizes: tuple[int, ...] = WINDOWS, k: int = TOP, keep: float = KEEP) -> DataFrame:
    """lexical_top of windows of all sizes, each a third of its size apart, start being a struct (start, size). words: (doc_id, w). A
    window counts a word where it first stands in it: at places whose last one before lies ahead of the window."""
    placed = words.select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "token"))
    indexed = placed.join(post.select("token").distinct(), "token", "left_semi")
    last = F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", "token").orderBy("pos")), F.lit(-1))
    size = F.explode(F.array(*[F.struct(F.lit(x).alias("size"), F.lit(max(1, x // 3)).alias("stride")) for x in sizes]))
    rows = indexed.withColumn("last", last).select("*", size.alias("x")).select("doc_id", "token", "pos", "n", "last", "x.size", "x.stride")
    first = F.floor((F.greatest(F.col("last"), F.col("pos") - F.col("size")) + F.col("stride")) / F.col("stride")).cast("int")
    final = F.floor(F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("size"))) / F.col("stride")).cast("int")
    rows = rows.withColumn("a", F.greatest(F.lit(0), first)).withColumn("b", final).where("a <= b")
    windows = rows.select("doc_id", "token", "size", "stride", F.explode(F.sequence("a", "b")).alias("nth"))
    return _top(windows.select("doc_id", F.struct((F.col("nth") * F.col("stride")).alias("start"), "size").alias("start"), "token").join(post, "token"), k, keep)


def _top(hits: DataFrame, k: int, keep: float) -> DataFrame:
    score = hits.groupBy("doc_id", "start", "item_id").agg(F.round(F.sum("weight"), 9).alias("s"))
    w = Window.partitionBy("doc_id", "start")
    ranked = score.withColumn("place", F.row_number().over(w.orderBy(F.desc("s"), "item_id"))).withColumn("top", F.max("s").over(w)).where(F.col("place") <= k)
    return ranked.select("doc_id", "start", "item_id", F.round(F.col("s") / F.col("top"), 6).alias("score"), F.col("place").cast("long").alias("place")).where(F.col("score") >= keep)


def likeness(docs: DataFrame, rend: DataFrame) -> DataFrame:
    """(doc_id, likeness): the largest share of idf of a document's words that a rendering has, over passages that share a
    run of SMALL_RUN words."""
    n = rend.agg(F.count(F.lit(1)).alias("n_docs"))
    idf = document_frequency(rend).crossJoin(F.broadcast(n)).select("token", F.greatest(F.lit(0.0), F.log(F.col("n_docs") / (1 + F.col("df")))).alias("idf"))
    near = shared_runs(docs, rend.where("edition = 0"), SMALL_RUN).select("doc_id", "item_id")
    met = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    tokens = words_of(met, "doc_id").select("doc_id", F.explode(F.array_distinct("w")).alias("token"))
    total = tokens.join(idf, "token").groupBy("doc_id").agg(F.sum("idf").alias("all_idf"))
    have = rend.select("item_id", "edition", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    common = near.join(tokens, "doc_id").join(have, ["item_id", "token"]).join(idf, "token").groupBy("doc_id", "item_id", "edition").agg(F.sum("idf").alias("s"))
    return common.join(total, "doc_id").groupBy("doc_id").agg(F.round(F.max(F.when(F.col("all_idf") > 0, F.col("s") / F.col("all_idf")).otherwise(0.0)), 6).alias("likeness"))


# --- attribution -----------------------------------------------------------------------------------------------------


def quotations(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, quote): the stretch of the document where the longest common run lies, as long as the passage."""
    at = longest_run(docs, passages)
    met = words_of(docs.join(at.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").withColumnRenamed("w", "dw")
    sizes = words_of(passages, "item_id").select("item_id", F.size("w").alias("n"))
    first = F.greatest(F.lit(0), F.col("doc_start") - F.col("passage_start"))
    return at.join(met, "doc_id").join(sizes, "item_id").select("doc_id", "item_id", F.array_join(F.slice("dw", first.cast("int") + 1, F.col("n")), " ").alias("quote"))


def ranked_editions(quotes: DataFrame, rend: DataFrame, score: str = "jaccard", keys: tuple[str, ...] = ("doc_id", "item_id")) -> DataFrame:
    """(keys, edition, score, place) of each rendering of a quotation's passage, best first, then by edition.
    score: `jaccard`, or `sim`, the Arrow kernel."""
    r = rend.select("item_id", "edition", tx.normalize(F.col("text")).alias("approved"))
    both = quotes.join(r, "item_id")
    a, b = F.split("quote", " "), F.split("approved", " ")
    jac = sm.jaccard(F.array_distinct(a), F.array_distinct(b))
    value = jac if score == "jaccard" else sm.sim(F.col("quote"), F.col("approved"))
    both = both.withColumn("score", F.round(value, 6))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "edition"))
    return both.withColumn("place", place.cast("long")).select(*keys, "edition", "score", "place")


def best_edition(quotes: DataFrame, rend: DataFrame, keys: tuple[str, ...] = ("doc_id", "item_id")) -> DataFrame:
    """(keys, edition, score, n_compared): the rendering with the largest `sim`, the first among equals, with provable pruning. In
    each quotation the rendering with the highest bound is compared in full; of the others only those whose bound reaches that
    score are; n_compared counts those."""
    r = rend.select("item_id", "edition", tx.normalize(F.col("text")).alias("approved"))
    both = quotes.join(r, "item_id")
    words = lambda c: F.array_distinct(F.split(c, " "))
    both = both.withColumn("bound", sm.multiset_bound(F.col("quote"), F.col("approved"), sm.jaccard(words("quote"), words("approved"))))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bound"), "edition"))
    ranked = both.withColumn("nth", first).withColumn("floor", F.when(F.col("nth") == 1, sm.sim(F.col("quote"), F.col("approved"))))
    ranked = ranked.withColumn("floor", F.max("floor").over(Window.partitionBy(*keys)))
    left = ranked.where((F.col("nth") == 1) | (F.col("bound") >= F.col("floor") - 1e-9))
    scored = left.withColumn("score", F.when(F.col("nth") == 1, F.col("floor")).otherwise(sm.sim(F.col("quote"), F.col("approved"))))
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.round("score", 6).alias("score"), (-F.col("edition")).alias("e"))).alias("b"), F.count(F.lit(1)).alias("n_compared"))
    return best.select(*keys, (-F.col("b.e")).alias("edition"), F.col("b.score").alias("score"), "n_compared")


def attributed(ranked: DataFrame, keys: tuple[str, ...] = ("doc_id", "item_id")) -> DataFrame:
    """One row a quotation: the best edition (none if the state is UNATTRIBUTED), the state, and the next three."""
    later = F.sort_array(F.collect_list(F.when(F.col("place").between(2, 4), F.struct("place", "edition", "score"))))
    found = ranked.groupBy(*keys).agg(F.max_by("edition", -F.col("place")).alias("edition"), F.max_by("score", -F.col("place")).alias("score"), F.count(F.lit(1)).alias("n_compared"), later.alias("later"))
    state = sm.state(F.col("score"))
    runners = F.array_join(F.transform("later", lambda r: r["edition"].cast("string")), ",")
    return found.select(*keys, F.when(state != "UNATTRIBUTED", F.col("edition")).alias("edition"), "score", state.alias("state"), "n_compared", runners.alias("runners_up"))


def in_language(findings: DataFrame, docs: DataFrame, languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """Findings in documents of a language (column lang) without renderings have the state NO_APPROVED_TRANSLATION and no edition. A null
    language counts as the first; without the column all documents do."""
    if "lang" not in docs.columns:
        return findings
    other = docs.where(~F.coalesce("lang", F.lit(languages[0])).isin(*languages)).select("doc_id").distinct().withColumn("_other", F.lit(True))
    rows = findings.join(other, "doc_id", "left")
    kept = lambda c: F.when(F.col("_other").isNull(), F.col(c))
    return rows.withColumn("edition", kept("edition")).withColumn("state", F.coalesce(kept("state"), F.lit("NO_APPROVED_TRANSLATION"))).drop("_other").select(*findings.columns)


def verdicts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a document: findings by state, and the verdict: REFER if any finding is NEAR or UNATTRIBUTED, NO_QUOTES without any,
    NO_APPROVED_TRANSLATION if one has that state, CLEAR if all are MATCH. findings: (doc_id, item_id, state)."""
    states = ("MATCH", "NEAR", "UNATTRIBUTED", "NO_APPROVED_TRANSLATION")
    counts = findings.groupBy("doc_id").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s.lower()) for s in states], F.array_join(F.slice(F.sort_array(F.collect_set("item_id")), 1, 5), ",").alias("refs"))
    rows = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, [s.lower() for s in states]).na.fill("", ["refs"])
    verdict = F.when(F.col("near") + F.col("unattributed") > 0, "REFER").when(F.col("match") + F.col("no_approved_translation") == 0, "NO_QUOTES").when(F.col("no_approved_translation") > 0, "NO_APPROVED_TRANSLATION").otherwise("CLEAR")
    return rows.select("*", verdict.alias("verdict"))


# --- intervals -------------------------------------------------------------------------------------------------------


def merged_intervals(rows: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Intervals (start, end) of a key merged where one starts at most `gap` after all earlier ones have ended."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when(far.isNull() | (F.col("start") > far + gap), 1).otherwise(0))
    isl = flagged.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy(*keys, "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_isl")


def resolve_overlaps(spans: DataFrame, gap: int = -1) -> DataFrame:
    """Of a document's spans (doc_id, item_id, start, end, score) the best by score, then length, then start, then item, and
    each next that overlaps none taken before: greedy, so each document is one Arrow group, as large as its spans. A span that starts or ends within `gap` words of a taken
    one of its passage is a fragment of it and goes; further off it is a quotation of its own."""
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_l=rows["start"] - rows["end"]).sort_values(["score", "_l", "start", "item_id"], ascending=[False, True, True, True])
        taken, kept = [], []
        for i, (a, b, item) in enumerate(zip(rows["start"], rows["end"], rows["item_id"], strict=True)):
            if all((b <= x or a >= y) and not (item == other and min(abs(a - y), abs(x - b)) <= gap) for x, y, other in taken):
                taken.append((a, b, item))
                kept.append(i)
        return rows.iloc[kept].drop(columns="_l")

    return spans.groupBy("doc_id").applyInPandas(pick, spans.schema)
