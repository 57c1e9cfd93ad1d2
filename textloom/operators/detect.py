"""Finding quotations in documents: seeds from shared runs and from weighted words, edges moved to where the text is most alike,
overlaps resolved, and each quotation compared with all renderings of its passage.

Seeds and candidates are joins. Only the walk of a span's edges, which goes step by step, runs as an Arrow kernel over rows
that carry all it needs: the document's words around the seed and the two closest renderings.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx
from ..sources.store import written
from . import passages as ps

#: Least score of a seed and of a span, of a span of few words, and which spans have few; most steps of the walk,
#: and words between a span and a fragment of it.
SEED, SPAN, SHORT, LEAST_WORDS, FEW_WORDS, STEPS, SAME_GAP = 0.42, 0.55, 0.75, 6, 12, 400, 5
#: Words of a document whose seeds are walked together.
BLOCK = 256
SPANS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
MOVES = tuple((a * n, b * n) for n in (1, 2) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)))


class Likeness:
    """sm.similarity of stretches of words with one approved text, each told once. What the approved text needs is made once, and a
    bound on the characters in common spares most comparisons whose result cannot reach what is asked for."""

    def __init__(self, words: list[str], approved: str) -> None:
        self.words, self.approved, self.set, self.reach = words, approved, set(approved.split()), max(4, len(approved.split()))
        self.known: dict[tuple[int, int], float] = {}
        self.bounds: dict[tuple[int, int], float] = {}
        self.matcher = SequenceMatcher(None, "", approved)

    def _sets(self, span: tuple[int, int]) -> tuple[str, float]:
        text = " ".join(self.words[span[0] : span[1]])
        x = set(text.split())
        return text, sm.SETS * (len(x & self.set) / len(x | self.set) if x | self.set else 0.0)

    def score(self, span: tuple[int, int]) -> float:
        if span not in self.known:
            text, sets = self._sets(span)
            self.matcher.set_seq1(text)
            self.known[span] = sm.SEQUENCE * self.matcher.ratio() + sets if text and self.approved else 0.0
        return self.known[span]

    def may_exceed(self, span: tuple[int, int], floor: float) -> bool:
        if span in self.known:
            return self.known[span] > floor
        if span not in self.bounds:
            text, sets = self._sets(span)
            self.matcher.set_seq1(text)
            self.bounds[span] = sm.SEQUENCE * self.matcher.quick_ratio() + sets
        return self.bounds[span] > floor - 1e-12


def walk(words: list[str], start: int, end: int, approved: str, like: Likeness | None = None) -> tuple[int, int, float]:
    """Move the edges of words[start:end], one or two words at a time, as long as that makes it more like the approved text;
    the first move of MOVES that helps is taken. At least three words stay. Walks over the same words share `like`."""
    like = like or Likeness(words, approved)
    low, high = max(0, start - like.reach), min(len(words), end + like.reach)
    at = (start, end)
    for _ in range(STEPS):
        floor = like.score(at) + 1e-9
        tried = ((at[0] + a, at[1] + b) for a, b in MOVES)
        better = next((t for t in tried if low <= t[0] and t[1] <= high and t[1] - t[0] >= 3 and like.may_exceed(t, floor) and like.score(t) > floor), None)
        if better is None:
            break
        at = better
    return *at, like.score(at)


def refined(words: list[str], stretches: list[tuple[int, int]], approved: list[tuple[int, str]]) -> Iterator[tuple[int, int, float]]:
    """Each stretch walked towards the two renderings (edition, text) whose words are most like its own, if it is like them at all."""
    likes = [(edition, set(text.split(" ")), Likeness(words, text)) for edition, text in approved]
    for start, end in stretches:
        own = set(words[start:end])
        # a stretch without words and a rendering without words have no word in common
        near = sorted(likes, key=lambda x: (-(len(own & x[1]) / len(own | x[1])) if own | x[1] else 0.0, x[0]))[:2]
        for _, _, like in near:
            if like.may_exceed((start, end), SEED - 1e-9) and like.score((start, end)) >= SEED:
                yield walk(words, start, end, like.approved, like)


def seeds(docs: DataFrame, rend: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end): stretches as long as the passage around each maximal run of SMALL_RUN words or more that a
    pair shares, and for these pairs windows of every size of the ladder, a third of it apart, that weighted words point to. A
    quotation without SMALL_RUN words in a row of its passage is not found."""
    first = rend.where("edition = 0").select("item_id", "text")
    sizes = first.select("item_id", F.size(tx.tokens(F.col("text"))).alias("n"))
    begin = F.greatest(F.lit(0), F.col("i") - F.col("j")).cast("long")
    found = ps.common_runs(docs, first).join(sizes, "item_id").select("doc_id", "item_id", begin.alias("start"), (begin + F.col("n")).alias("end"))
    near = found.select("doc_id", "item_id").distinct()
    met, post = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi"), ps.postings(rend)
    top = ps.lexical_ladder(ps.words_of(met, "doc_id"), post).join(near, ["doc_id", "item_id"], "left_semi")
    by_words = top.select("doc_id", "item_id", F.col("start.start").cast("long").alias("start"), (F.col("start.start") + F.col("start.size")).cast("long").alias("end"))
    return found.unionByName(by_words).distinct()


def spans(docs: DataFrame, rend: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, score): refined spans that pass the gate, overlaps resolved. Documents that share no run with a
    passage go at once; the others are written. Seeds of a pair that begin in the same BLOCK of words are walked together, with
    the words around them."""
    met = written(ps.sharing(docs, rend.where("edition = 0").select("item_id", "text"), ps.SMALL_RUN).select("doc_id", "text"), "detect-documents")
    words = ps.words_of(met, "doc_id")
    text = tx.normalize(F.col("text"))
    approved = rend.select("item_id", F.struct("edition", text.alias("text")).alias("x"), F.size(F.split(text, " ")).alias("n"))
    approved = approved.groupBy("item_id").agg(F.collect_list("x").alias("approved"), F.greatest(F.lit(4), F.max("n")).alias("reach"))
    blocks = seeds(met, rend).groupBy("doc_id", "item_id", F.floor(F.col("start") / BLOCK).alias("block")).agg(F.collect_list(F.struct("start", "end")).alias("stretches"), F.min("start").alias("first"), F.max("end").alias("last"))
    low = F.greatest(F.lit(0), F.col("first") - F.col("reach")).cast("int")
    rows = blocks.join(approved, "item_id").join(words, "doc_id").withColumn("low", low)
    rows = rows.select("doc_id", "item_id", "low", F.array_join(F.slice("w", F.col("low") + 1, (F.col("last") + F.col("reach") - F.col("low")).cast("int")), " ").alias("words"), "stretches", "approved")

    def refine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for r in part.to_pylist():
                w, at = r["words"].split(" "), r["low"]
                stretches = [(x["start"] - at, min(x["end"] - at, len(w))) for x in r["stretches"]]
                found = set(refined(w, stretches, [(x["edition"], x["text"]) for x in r["approved"]]))
                out += [{"doc_id": r["doc_id"], "item_id": r["item_id"], "start": a + at, "end": b + at, "score": round(s, 6)} for a, b, s in found]
            yield pa.RecordBatch.from_pylist(out, SPANS)

    # dealt anew: a pair's blocks are much work for few bytes
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "doc_id", "item_id", "low")
    found = rows.mapInArrow(refine, "doc_id bigint, item_id bigint, start bigint, end bigint, score double")
    n = F.col("end") - F.col("start")
    gate = (F.col("score") >= SPAN) & (n >= LEAST_WORDS) & ((n >= FEW_WORDS) | (F.col("score") >= SHORT))
    return ps.resolve_overlaps(found.where(gate).distinct(), SAME_GAP)


def check(docs: DataFrame, rend: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edition, score, state, n_compared, runners_up): each quotation found, compared with all
    renderings. MATCH stands only if a rendering has exactly these words; else it is NEAR."""
    keys = ("doc_id", "item_id", "start", "end")
    cut = F.array_join(F.slice("w", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), " ")
    found = written(spans(docs, rend), "detect-spans")
    met = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    quotes = found.join(ps.words_of(met, "doc_id"), "doc_id").select(*keys, cut.alias("quote"))
    told = ps.attributed(ps.ranked_editions(quotes, rend, "sim", keys), keys)
    words = rend.select("item_id", tx.strict_tokens(F.col("text")).alias("a"), tx.strict_tokens(F.col("text"), True).alias("b"))
    same = quotes.join(words, "item_id").select(*keys, sm.verbatim(F.split("quote", " "), F.col("a"), F.col("b")).isNotNull().cast("int").alias("v")).groupBy(*keys).agg(F.max("v").alias("v"))
    rows = told.join(same, [*keys]).select("doc_id", "item_id", "edition", "score", "state", "n_compared", "runners_up", "start", "end", "v")
    return rows.withColumn("state", F.when((F.col("state") == "MATCH") & (F.col("v") == 0), "NEAR").otherwise(F.col("state"))).drop("v")


def control(docs: DataFrame, rend: DataFrame) -> DataFrame:
    """Findings and verdicts of whole documents: one row a document."""
    return ps.verdicts(docs, ps.in_language(check(docs, rend), docs))


def free_regions(docs: DataFrame, walls: DataFrame) -> DataFrame:
    """(doc_id, start, end): the largest stretch of a document's words between walls (doc_id, start, end), the earliest of
    equals. Documents without walls are left out."""
    n = ps.words_of(docs, "doc_id").select("doc_id", F.size("w").cast("long").alias("all"))
    merged = ps.merged_intervals(walls, ["doc_id"]).join(n, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("start")
    before = merged.select("doc_id", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("start"), F.col("start").alias("end"))
    last = merged.groupBy("doc_id").agg(F.max("end").alias("start"), F.first("all").alias("end"))
    gaps = before.unionByName(last).where("end > start")
    best = gaps.groupBy("doc_id").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("len"), (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", (-F.col("b.s")).alias("start"), (F.col("b.len") - F.col("b.s")).alias("end"))


def excerpt(quote: list[str], approved: list[str]) -> tuple[int, int, float]:
    """The stretch of the approved words that is most like a shorter quote: near where the longest common run puts it, with
    0.8 to 1.25 of its length; the first of equals."""
    from difflib import SequenceMatcher

    run = SequenceMatcher(None, quote, approved, autojunk=False).find_longest_match()
    at, text, n = run.b - run.a, " ".join(quote), len(quote)
    tried = [(a, a + k) for a in range(max(0, at - 3), max(0, at) + 4) for k in range(max(1, int(0.8 * n)), int(1.25 * n) + 2) if a + k <= len(approved)]
    scored = [(sm.similarity(text, " ".join(approved[a:b])), -i, a, b) for i, (a, b) in enumerate(tried)]
    if not scored:
        return 0, len(approved), sm.similarity(text, " ".join(approved))
    best = max(scored)
    return best[2], best[3], best[0]


def excerpts(quotes: DataFrame, rend: DataFrame) -> DataFrame:
    """(key, item_id, edition, start, end, score) for quotes (key, item_id, quote: words) of eight words or more that are less
    than 0.85 of a rendering."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                a, b, s = excerpt(list(r.quote), list(r.approved))
                out.append((r.key, r.item_id, r.edition, a, b, round(s, 6)))
            yield pd.DataFrame(out, columns=["key", "item_id", "edition", "start", "end", "score"])

    rows = quotes.join(rend.select("item_id", "edition", tx.tokens(F.col("text")).alias("approved")), "item_id").where((F.size("quote") >= 8) & (F.size("quote") < 0.85 * F.size("approved")))
    return rows.select("key", "item_id", "edition", "quote", "approved").mapInPandas(run, "key bigint, item_id bigint, edition int, start bigint, end bigint, score double")


def not_aliases(missing: DataFrame, placed: DataFrame, least: int = 3) -> DataFrame:
    """Missing passages (item_id, words) of `least` words or more that lie within no placed one (item_id, words) are really
    missing; pairs are those that share their first `least` words."""
    key = lambda w: F.array_join(F.slice(w, 1, least), " ")
    m = missing.where(F.size("words") >= least).select("item_id", F.array_join("words", " ").alias("text"), key(F.col("words")).alias("g"))
    p = placed.select(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("whole"), F.explode(tx.shingles(F.col("words"), least)).alias("g"))
    inside = m.join(p, "g").where(F.contains("whole", F.concat(F.lit(" "), F.col("text"), F.lit(" ")))).select("item_id").distinct()
    return missing.join(inside, "item_id", "left_anti")
