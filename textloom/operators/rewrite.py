"""Surgery on texts: frozen parts, splitting of long sentences, quoted regions, units and chunks, and a budget of words.
These scan a text from left to right, so they are Arrow kernels over one text at a time; what can be told from counts alone
(whether a rewrite kept its frozen parts) is a column expression."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Conjunctions at which a sentence may be split, and pairs of quotation marks.
CONJUNCTIONS = frozenset(("and", "but", "so", "yet"))
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
UNIT_WORDS, CHUNK, SLICE, PAIR, REGION = 5, 48, 32, 80, 400

_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


_OPEN, _CLOSE = "\ue000", "\ue001"
_TOKEN = re.compile(f"{_OPEN}+([0-9]+){_CLOSE}")


def mask(text: str, parts: list[str]) -> tuple[str, list[str]]:
    """The text with each place of a part, longer parts first, replaced by a numbered token. The tokens' marks are of private
    use; a text that holds such a mark is not masked at all."""
    held: list[str] = []
    pattern = "|".join(re.escape(p) for p in sorted({p for p in parts if p}, key=lambda p: (-len(p), p)))
    if not pattern or _OPEN in text or _CLOSE in text:
        return text, held

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"{_OPEN}{len(held) - 1}{_CLOSE}"

    return re.sub(pattern, keep, text), held


def unmask(text: str, held: list[str]) -> str | None:
    """The frozen parts put back; None if a token is missing, doubled or unknown."""
    if not held:
        return text
    if sorted(int(n) for n in _TOKEN.findall(text)) != list(range(len(held))):
        return None
    return _TOKEN.sub(lambda m: held[int(m[1])], text)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("held", T.ArrayType(T.StringType()))]))
def freeze(text: pd.Series, parts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mask(t or "", list(p) if p is not None else []) for t, p in zip(text, parts, strict=True)], columns=["text", "held"])


@F.pandas_udf(T.StringType())
def thaw(text: pd.Series, held: pd.Series) -> pd.Series:
    return pd.Series([unmask(t or "", list(h) if h is not None else []) for t, h in zip(text, held, strict=True)], dtype=object)


def split_long(sentence: str, most: int = 22, least: int = 6) -> str:
    """A sentence of more than `most` words, split before conjunctions behind a comma into parts of `least` words or more. The
    comma becomes a full stop and the conjunction takes a capital; nothing else changes. Conditions are never split."""
    words = list(re.finditer(r"\S+", sentence))
    if len(words) <= most or re.match(r"\s*(if|unless|when|whenever|whoever)\b", sentence, re.I):
        return sentence
    edits, part = [], 0
    for before, word, left in zip([None, *words], words, range(len(words), 0, -1), strict=False):
        if before and part >= least and left - 1 >= least and before[0].endswith(",") and word[0].strip(",;:").lower() in CONJUNCTIONS:
            edits += [(before.end() - 1, "."), (word.start(), word[0][0].upper())]
            part = 0
        part += 1
    chars = list(sentence)
    for at, char in edits:
        chars[at] = char
    return "".join(chars)


@F.pandas_udf(T.StringType())
def shorter_sentences(sentence: pd.Series) -> pd.Series:
    return sentence.map(lambda s: None if s is None else split_long(s))


@F.pandas_udf(_RANGES)
def quoted_regions(text: pd.Series) -> pd.Series:
    """Word ranges from an opening quotation mark to its partner, REGION words at most; a new opening mark begins anew."""

    def regions(t: str | None) -> list[dict]:
        out, opened, closer = [], None, ""
        for i, w in enumerate((t or "").split()):
            if opened is not None and w.rstrip(".,;:!?)").endswith(closer):
                if i - opened < REGION:
                    out.append({"start": opened, "end": i + 1})
                opened = None
            elif w.lstrip("(")[:1] in QUOTES:
                opened, closer = i, QUOTES[w.lstrip("(")[0]]
                if len(w) > 1 and w.rstrip(".,;:!?)").endswith(closer):
                    out.append({"start": i, "end": i + 1})
                    opened = None
        return out

    return text.map(regions)


@F.pandas_udf(_RANGES)
def units(text: pd.Series) -> pd.Series:
    """Word ranges of sentences; one of fewer than UNIT_WORDS words goes on into the next, the last into the one before."""
    ends = re.compile("[.!?।॥۔؟]+[\"'”’»)\\]]*$")

    def split(t: str | None) -> list[dict]:
        out, start, n = [], 0, 0
        for line in (t or "").split("\n"):
            words = line.split()
            for i, w in enumerate(words):
                n += 1
                if (ends.search(w) or i == len(words) - 1) and n - start >= UNIT_WORDS:
                    out.append({"start": start, "end": n})
                    start = n
        if n > start:
            if out:
                out[-1]["end"] = n
            else:
                out.append({"start": start, "end": n})
        return out

    return text.map(split)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): units up to CHUNK words, slices of SLICE words of longer ones, and pairs of neighbours up to
    PAIR words."""
    u = docs.select("doc_id", F.posexplode(units(F.col("text"))).alias("nth", "u")).select("doc_id", "nth", "u.start", "u.end")
    n = F.col("end") - F.col("start")
    whole = u.where(n <= CHUNK).select("doc_id", "start", "end")
    begins = F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - SLICE // 2 - 1), F.lit(SLICE // 2)))
    slices = u.where(n > CHUNK).select("doc_id", "end", begins.alias("begin")).select("doc_id", F.col("begin").alias("start"), F.least("end", F.col("begin") + SLICE).alias("end"))
    after = F.lead("end").over(Window.partitionBy("doc_id").orderBy("nth"))
    pairs = u.select("doc_id", "start", after.alias("end")).where((F.col("end").isNotNull()) & (F.col("end") - F.col("start") <= PAIR))
    return whole.unionByName(slices).unionByName(pairs).distinct()


def within_budget(rows: DataFrame, key: str, priority: str, size: str, budget: int) -> DataFrame:
    """Adds `taken`: for each key, rows by falling priority are taken as long as they fit what is left; one that does not fit is
    passed over. One key's rows are a group."""

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([priority, size], ascending=[False, True], kind="stable")
        left, taken = budget, []
        for n in part[size]:
            taken.append(bool(n <= left))
            left -= n if n <= left else 0
        return part.assign(taken=taken)

    return rows.groupBy(key).applyInPandas(take, T.StructType([*rows.schema.fields, T.StructField("taken", T.BooleanType())]))


def words_at(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, nth): words that start within character ranges (id, from, to). Each word knows where it starts; the join is on the
    identifier, with the range as a condition."""
    pieces = F.split(F.col("text"), r"\s+")
    gaps = F.regexp_extract_all("text", F.lit(r"\s+"), F.lit(0))
    w = docs.select(id_col, F.posexplode(F.arrays_zip(pieces.alias("w"), gaps.alias("g"))).alias("i", "p"))
    step = F.length("p.w") + F.coalesce(F.length("p.g"), F.lit(0))
    placed = w.select(id_col, "i", "p.w", step.alias("step")).withColumn("at", F.coalesce(F.sum("step").over(Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.where("w <> ''").withColumn("nth", F.row_number().over(Window.partitionBy(id_col).orderBy("i")) - 1)
    return placed.join(ranges, id_col).where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))).select(id_col, F.col("nth").cast("long").alias("nth")).distinct()
