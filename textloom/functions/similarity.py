"""Similarity of texts and vectors: set and multiset measures as columns, the sequence ratio as an Arrow kernel."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of the sequence ratio and of the Jaccard index in `sim`; scores from which a text counts as the same or near.
SEQUENCE, SETS = 0.6, 0.4
SAME, NEAR = 0.92, 0.75


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of a's items, with repeats, that occur in b; 0 if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)).otherwise(0.0)


def length_bound(a: Column, b: Column, jac: Column) -> Column:
    """No `sim` of texts a and b is above this."""
    la, lb = F.length(a), F.length(b)
    return F.when((la > 0) & (lb > 0), SEQUENCE * 2 * F.least(la, lb) / (la + lb) + SETS * jac).otherwise(0.0)


def multiset_bound(a: Column, b: Column, jac: Column) -> Column:
    """A closer bound: characters in common, with repeats. Each text counts its characters once; a character's number in the
    other is the drop in length when it is taken out."""
    chars = F.array_distinct(F.split(a, ""))
    number = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))
    common = F.aggregate(chars, F.lit(0), lambda s, ch: s + F.when(ch == "", 0).otherwise(F.least(number(a, ch), number(b, ch))))
    la, lb = F.length(a), F.length(b)
    return F.when((la > 0) & (lb > 0), SEQUENCE * 2 * common / (la + lb) + SETS * jac).otherwise(0.0)


def similarity(a: str, b: str) -> float:
    """Of two texts in comparison form: difflib's ratio, with its junk rule for long texts, and the Jaccard index of words."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    return SEQUENCE * SequenceMatcher(None, a, b).ratio() + SETS * (len(x & y) / len(x | y) if x | y else 0.0)


@F.pandas_udf(T.DoubleType())
def sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("op", "published", "approved")])))
def word_diff(published: pd.Series, approved: pd.Series) -> pd.Series:
    """Edit script between two arrays of words; runs of equal words are one entry."""

    def ops(a, b) -> list[dict]:
        a, b = list(a if a is not None else ()), list(b if b is not None else ())
        return [{"op": op, "published": " ".join(a[i:j]), "approved": " ".join(b[k:m])} for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]

    return pd.Series([ops(a, b) for a, b in zip(published, approved, strict=True)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector over its length; zeros stay zeros."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 1e-12, x.cast("double") / norm).otherwise(0.0))


def state(score: Column) -> Column:
    return F.when(score >= SAME, "MATCH").when(score >= NEAR, "NEAR").otherwise("UNATTRIBUTED")


def verbatim(published: Column, approved: Column, approved_plain: Column) -> Column:
    """whole if the words are all the approved ones, excerpt if a run of them, else null. approved_plain: the approved words
    without their own parentheses, tried second."""
    line = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    none = F.size(published) == 0
    whole = (published == approved) & (F.size(approved) > 0) | (published == approved_plain) & (F.size(approved_plain) > 0)
    part = F.contains(line(approved), line(published)) | F.contains(line(approved_plain), line(published))
    return F.when(none, F.lit(None).cast("string")).when(whole, "whole").when(part, "excerpt")
