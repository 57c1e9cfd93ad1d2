"""Where in a document a passage stands that is known to be there: beside its citation, at a window of its length, within the author's
quotation marks; and sentences, quoted regions and quotations with a reference nearby, by characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import similarity as sm
from ..functions import text as tx
from .citations import matches

# Margin by which a place behind a citation must be better than one before it; coverage that makes a place certain; words
# of the farthest search; words around a span in which its marks are looked for, and what may be lost by moving to them.
MARGIN, COVERED, REACH, SNAP_WORDS, SNAP_LOSS = 0.10, 0.80, 320, 3, 0.03
OPEN, CLOSE = "“«‹\"'‘﴾„", "”»›\"'’﴿“"
# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "mr mrs ms dr prof st vol no pp p ed eds cf ie eg etc vs ibid trans pbuh saw swt ra rah q ch fig".split()
FALSE_END = rf"(?:^|\s)(?:(?i:{'|'.join(ABBREVIATIONS)})\.+|[A-Z]\.)$"
_PARAGRAPH = r"(?!\n[ \t\r\f]*\n)"
REGIONS = "(" + "|".join(rf"{o}(?:{_PARAGRAPH}[^{c}])*{c}?" for o, c in (("“", "”"), ("«", "»"), ("﴾", "﴿"), ("﴿", "﴾"), ('"', '"'))) + ")()"
#: A quotation of 8 to 600 characters, and how far from it its reference may stand.
QUOTED, NEAR = r"[\"“”«۝﴾]([^\"“”»﴿]{8,600}?)[\"“”»﴿]()", 90


def segment(windows: DataFrame, passages: DataFrame) -> DataFrame:
    """windows: (key..., item_id, w: words). passages: (item_id, pw). (key..., item_id, first, last, best, coverage): the stretch of
    the window with the largest sum, +1 for words of the passage and -2 for others, the earliest of equals, and the share of the
    passage's distinct words that are in it. Windows without any word of it give no row."""
    keys = [c for c in windows.columns if c != "w"]
    rows = windows.join(passages, "item_id").select(*keys, "pw", F.posexplode("w").alias("i", "x"))
    rows = rows.withColumn("v", F.when(F.array_contains("pw", F.col("x")), 1).otherwise(-2))
    w = Window.partitionBy(*keys).orderBy("i")
    sums = rows.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.min(F.struct(F.col("s").alias("low"), (-F.col("i")).alias("at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("b", before)
    from_start = F.col("b").isNull() | (F.col("b.low") >= 0)
    first = F.when(from_start, 0).otherwise(1 - F.col("b.at"))
    scored = sums.select(*keys, "pw", F.col("i").alias("last"), first.alias("first"), (F.col("s") - F.when(from_start, 0).otherwise(F.col("b.low"))).alias("m"))
    best = scored.groupBy(*keys).agg(F.max(F.struct("m", (-F.col("last")).alias("l"), "first")).alias("z"), F.first("pw").alias("pw")).where("z.m > 0")
    at = best.select(*keys, F.col("z.first").alias("first"), (-F.col("z.l")).alias("last"), F.col("z.m").alias("best"), "pw").join(windows, keys)
    cut = F.array_distinct(F.slice("w", F.col("first") + 1, F.col("last") - F.col("first") + 1))
    share = F.size(F.array_intersect(cut, "pw")) / F.size(F.array_distinct("pw"))
    return at.select(*keys, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("best").cast("long").alias("best"), F.round(share, 6).alias("coverage"))


def cited_places(docs: DataFrame, cites: DataFrame, passages: DataFrame) -> DataFrame:
    """docs: (doc_id, w); cites: (doc_id, cite_id, item_id, start, end: words); passages: (item_id, pw). (doc_id, cite_id, item_id, side,
    start, end, coverage, certain): where the cited passage stands, between the citation before and this one, or between this one and
    the next, no farther than one and a half times its length. A place before is taken unless the one behind is better by
    MARGIN."""
    order = Window.partitionBy("doc_id").orderBy("start", "cite_id")
    rows = cites.withColumn("left", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("right", F.lead("start").over(order))
    rows = rows.join(docs, "doc_id").join(passages.select("item_id", F.size("pw").alias("n")), "item_id")
    reach = F.least(F.lit(REACH), F.floor(1.5 * F.col("n")) + 4)
    stop = F.coalesce("right", F.size("w"))
    side = lambda name, a, b: rows.select("doc_id", "cite_id", "item_id", F.lit(name).alias("side"), a.cast("int").alias("from"), F.slice("w", a.cast("int") + 1, (b - a).cast("int")).alias("w")).where(F.size("w") > 0)
    before = side("before", F.greatest(F.col("left"), F.col("start") - reach), F.col("start"))
    after = side("after", F.col("end"), F.least(stop, F.col("end") + reach))
    found = segment(before.unionByName(after), passages)
    worth = F.when(F.col("side") == "after", F.col("coverage") - MARGIN).otherwise(F.col("coverage") + 1e-9)
    best = found.groupBy("doc_id", "cite_id", "item_id").agg(F.max(F.struct(worth.alias("worth"), "side", "from", "first", "last", "coverage")).alias("b"))
    return best.select("doc_id", "cite_id", "item_id", "b.side", (F.col("b.from") + F.col("b.first")).alias("start"), (F.col("b.from") + F.col("b.last") + 1).alias("end"), "b.coverage", (F.col("b.coverage") >= COVERED).alias("certain"))


def known_places(pairs: DataFrame) -> DataFrame:
    """pairs: (doc_id, item_id, dw, pw). (doc_id, item_id, start, end, score): the window of the passage's length in the document that is
    most like it by the Jaccard index of words, the first of equals; a shorter document is one window."""
    n = F.size("pw")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("dw") - n)))
    rows = pairs.where(F.size("dw") > 0).select("doc_id", "item_id", "pw", "dw", n.alias("n"), starts.alias("start"))
    cut = F.array_distinct(F.slice("dw", F.col("start") + 1, F.col("n")))
    scored = rows.select("doc_id", "item_id", "start", F.least(F.col("start") + F.col("n"), F.size("dw")).alias("end"), F.round(sm.jaccard(cut, F.array_distinct("pw")), 6).alias("score"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.end").cast("long").alias("end"), F.col("b.score").alias("score"))


def snapped(words: Column, start: Column, end: Column) -> Column:
    """(start, end) of a span of raw words moved to the marks around it: an opening one within SNAP_WORDS before its first word or at it,
    with a closing one as near behind its last; else as it was."""
    a, b = f"^[(\\[]*[{OPEN}]", f"[{CLOSE}][)\\].,;:!?]*$"
    low = F.greatest(F.lit(0), start - SNAP_WORDS)
    # of several openers the nearest to the span, so looked for backwards
    back = F.reverse(F.slice(words, (low + 1).cast("int"), (start - low + 1).cast("int")))
    opened = F.array_position(F.transform(back, lambda x: x.rlike(a)), True)
    ahead = F.slice(words, end.cast("int"), F.lit(SNAP_WORDS + 1))
    closed = F.array_position(F.transform(ahead, lambda x: x.rlike(b)), True)
    both = (opened > 0) & (closed > 0)
    return F.struct(F.when(both, start - opened + 1).otherwise(start).cast("long").alias("start"), F.when(both, end + closed - 1).otherwise(end).cast("long").alias("end"))


def snap(spans: DataFrame) -> DataFrame:
    """spans: (key columns, raw: words as written, start, end, approved). The spans moved to their marks where the Jaccard index with
    the approved text does not fall by more than SNAP_LOSS; `raw` goes."""
    cut = lambda s, e: tx.tokens(F.array_join(F.slice("raw", s.cast("int") + 1, (e - s).cast("int")), " "))
    like = lambda w: sm.jaccard(F.array_distinct(w), F.array_distinct(tx.tokens(F.col("approved"))))
    rows = spans.withColumn("_t", snapped(F.col("raw"), F.col("start"), F.col("end")))
    ok = like(cut(F.col("_t.start"), F.col("_t.end"))) >= like(cut(F.col("start"), F.col("end"))) - SNAP_LOSS
    rows = rows.withColumn("_t", F.when(ok, F.col("_t")).otherwise(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    return rows.withColumn("start", F.col("_t.start")).withColumn("end", F.col("_t.end")).drop("_t", "raw")


# --- characters ------------------------------------------------------------------------------------------------------


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nth, start, end): sentences by characters: split behind a terminator and white space, but not behind an abbreviation or an
    initial; trimmed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ends = F.filter(matches(text, r"([.!?؟۔。।॥])(\s+)"), lambda m: m["end"] < F.length(text))
    cuts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda m: m["end"]))
    stops = F.concat(F.transform(ends, lambda m: m["start"] + 1), F.array(F.length(F.rtrim(text))))
    pieces = F.zip_with(cuts, stops, lambda a, b: F.struct(a.alias("start"), F.greatest(a, b).alias("end")))
    bad = lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"]).rlike(FALSE_END)

    def add(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), p["end"].alias("end"))))
        return F.when((F.size(out) > 0) & bad(last), joined).otherwise(F.concat(out, F.array(p)))

    spans = F.aggregate(pieces, F.array().cast("array<struct<start:int,end:int>>"), add)
    rows = docs.select(id_col, F.posexplode(spans).alias("nth", "s")).select(id_col, "nth", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return rows.where("end > start")


def quoted_characters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): regions from an opening quotation mark to its partner, or to the end of the paragraph."""
    found = docs.select(id_col, F.explode(matches(F.coalesce(F.col(text_col), F.lit("")), REGIONS)).alias("m"))
    return found.select(id_col, F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def classified(sents: DataFrame, regions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, nth, kind): QUOTED for sentences that a region overlaps, else PROSE."""
    r = regions.select(id_col, F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = sents.join(r, id_col).where((F.col("_a") < F.col("end")) & (F.col("start") < F.col("_b"))).select(id_col, "nth").distinct().withColumn("_q", F.lit(True))
    return sents.join(hit, [id_col, "nth"], "left").select(id_col, "nth", F.when(F.col("_q"), "QUOTED").otherwise("PROSE").alias("kind"))


_NUMBERS = r"(?i)[(\[]\s*(?:Qur['’]?an|Quran|Koran)?\s*[:\s]?\s*(\d{1,3})\s*[:ۖ]\s*(\d{1,3})\s*[)\]]"


def quotations_near_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, quote, chapter, verse): quoted stretches with a reference within NEAR characters behind them, else before: the
    detector that needs no index."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text.alias("_t"), F.explode(matches(text, QUOTED)).alias("m"))
    tail = F.substring("_t", F.col("m.end") + 1, F.lit(NEAR))
    low = F.greatest(F.lit(0), F.col("m.start") - NEAR)
    head = F.regexp_extract_all(F.substring("_t", low + 1, F.col("m.start") - low), F.lit(_NUMBERS), F.lit(0))
    ref = F.when(tail.rlike(_NUMBERS), F.regexp_extract(tail, _NUMBERS, 0)).when(F.size(head) > 0, F.element_at(head, -1))
    rows = rows.select(id_col, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.a").alias("quote"), ref.alias("ref")).where("ref IS NOT NULL")
    return rows.select(id_col, "start", "end", "quote", F.regexp_extract("ref", _NUMBERS, 1).cast("int").alias("chapter"), F.regexp_extract("ref", _NUMBERS, 2).cast("int").alias("verse"))


@F.pandas_udf(DoubleType())
def best_window(quote: pd.Series, approved: pd.Series) -> pd.Series:
    """The largest sequence ratio of a quote (in comparison form) with a stretch of the approved words, two shorter to two longer."""

    def one(q: str | None, a: str | None) -> float:
        x, y = (q or "").split(), (a or "").split()
        if not x or not y:
            return 0.0
        if len(x) >= len(y):
            return sm.similarity(" ".join(x), " ".join(y))
        widths = {k for k in range(max(1, len(x) - 2), len(x) + 3) if k <= len(y)}
        return max(sm.similarity(" ".join(x), " ".join(y[i : i + k])) for k in widths for i in range(len(y) - k + 1))

    return pd.Series([one(q, a) for q, a in zip(quote, approved, strict=True)], dtype="float64")


def fallback(docs: DataFrame, rend: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, item_id, score, state) of quotations_near_references(), by the best window of any rendering of the passage that
    their reference names (chapter and verse number the items by tens); NO_APPROVED_TRANSLATION if there is none."""
    quotes = quotations_near_references(docs, id_col).withColumn("item_id", ((F.col("chapter") - 1) * 10 + F.col("verse") - 1).cast("long"))
    r = rend.select("item_id", tx.normalize(F.col("text")).alias("approved"))
    rows = quotes.join(r, "item_id", "left").withColumn("score", F.when(F.col("approved").isNotNull(), best_window(tx.normalize(F.col("quote")), F.col("approved"))))
    best = rows.groupBy(id_col, "start", "end", "item_id").agg(F.round(F.max("score"), 6).alias("score"))
    return best.withColumn("state", F.when(F.col("score").isNull(), "NO_APPROVED_TRANSLATION").otherwise(sm.state(F.col("score"))))
