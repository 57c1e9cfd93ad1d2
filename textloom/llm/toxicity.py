"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so words are labelled from them: features of words (the word, or a proper beginning of it) are
chosen one after the other, each for the toxic documents it explains that earlier ones left, less the clean ones it is
in; in toxic documents words with a chosen feature are toxic, all others are not. The field learns weights of features, of
neighbours' features and of transitions from windows of these words.

For a text the forward and backward passes give each word's probability of being toxic. Stretches of words without features
are crossed by one power of the step matrix, which is the same product, so a long text costs little. Expected toxic words, their
share of the text, and the probability of any are the inputs of the document's score, fitted on the same sample. Runs of
words with a probability of 1/2 or more are the offending spans.

Training takes a sample of at most MAX_LABELLED labelled documents of each class to the driver; scoring is one pass over the
texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import column, documents, give_back, small_batches, text_of

#: Largest sample for the fit, a class: labelled rows, and characters of their texts. Rows come whole, in the order of a hash of the
#: identifier, until the next one would not fit.
MAX_LABELLED, MAX_CHARS = 3000, 30_000_000
#: Lengths of word beginnings; weight of the clean share against the toxic share; least gain of a feature; most features;
#: features that may explain a document.
BEGINNINGS, AGAINST, GAIN, FEATURES, COVER = range(3, 9), 2.0, 0.004, 64, 3
#: Words at either side of a hit in a training window.
AROUND = 8
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> set[str]:
    """The word itself, and proper beginnings, which end in a mark."""
    return {word, *(word[:k] + "~" for k in BEGINNINGS if len(word) > k)}


def features_in(text: str) -> set[str]:
    return {f for w in {w.lower() for w in _WORD.findall(text)} for f in features_of(w)}


def choose(toxic: list[str], clean: list[str]) -> list[str]:
    """Features by greedy cover of the texts, until COVER of them explain a text. A first pass counts hashes of features, and
    just those features are held that occur often enough by that count."""
    least = max(3, ceil(GAIN * len(toxic)))
    rough = np.zeros(1 << 22, np.int32)
    spot = lambda f: crc32(f.encode()) & (1 << 22) - 1
    for t in toxic:
        rough[np.unique(np.fromiter(map(spot, features_in(t)), np.int64))] += 1
    holders: dict[str, set[int]] = {}
    for i, t in enumerate(toxic):
        for f in features_in(t):
            if rough[spot(f)] >= least:
                holders.setdefault(f, set()).add(i)
    in_clean: Counter[str] = Counter()
    for t in clean:
        in_clean.update(f for f in features_in(t) if f in holders)
    cost = {f: AGAINST * in_clean[f] / len(clean) for f in holders}
    left = {f: h for f, h in holders.items() if len(h) >= least and len(h) / len(toxic) - cost[f] >= GAIN}
    found, times, covered = [], Counter(), set()
    while left and len(found) < FEATURES:
        gains = {f: len(h - covered) / len(toxic) - cost[f] for f, h in left.items()}
        best = max(gains, key=lambda f: (gains[f], f))
        if gains[best] < GAIN:
            break
        found.append(best)
        times.update(left.pop(best))
        covered = {i for i, k in times.items() if k >= COVER}
        left = {f: h for f, h in left.items() if gains[f] >= GAIN}  # gains only fall
    return found


class Tagger:
    """Features and weights; what workers need, and nothing else. Order of the weights: bias, neighbours, start, four
    transitions (from state, to state), then features."""

    def __init__(self, features: list[str]):
        self.features = {f: i for i, f in enumerate(features)}
        self.weights = np.zeros(7 + len(features))
        self.document = np.array([-20.0, 0.0, 0.0, 0.0])
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def hits(self, text: str) -> tuple[int, list[int], list[tuple[int, ...]]]:
        """Number of words, and places and features of those that have any."""
        memo, at, got = self.memo, [], []
        found = _WORD.findall(text)
        for i, w in enumerate(found):
            f = memo.get(w)
            if f is None:
                if len(memo) >= MEMO:
                    memo.clear()
                f = memo[w] = tuple(sorted(self.features[x] for x in features_of(w.lower()) if x in self.features))
            if f:
                at.append(i)
                got.append(f)
        return len(found), at, got

    def emissions(self, n: int, at: list[int], got: list[tuple[int, ...]]) -> tuple[list[int], list[float]]:
        """Places where the toxic state's score isn't that of a plain word, and the scores."""
        w = self.weights
        extra: dict[int, float] = {}
        for i, f in zip(at, got, strict=True):
            extra[i] = extra.get(i, 0.0) + sum(w[7 + k] for k in f)
            for j in (i - 1, i + 1):
                if 0 <= j < n:
                    extra[j] = extra.get(j, 0.0) + w[1]
        places = sorted(extra)
        return places, [w[0] + extra[i] for i in places]

    def marginals(self, n: int, places: list[int], scores: list[float]) -> np.ndarray:
        """Probability of the toxic state at the places, in a chain of n words."""
        w = self.weights
        step, plain = np.exp(w[3:7].reshape(2, 2)), np.array([1.0, np.exp(w[0])])
        m = step * plain
        half = (m[0, 0] - m[1, 1]) / 2
        root = np.sqrt(half * half + m[0, 1] * m[1, 0])
        top, low = (m[0, 0] + m[1, 1]) / 2 + root, (m[0, 0] + m[1, 1]) / 2 - root
        p1, eye = (m - low * np.eye(2)) / (2 * root), np.eye(2)
        power = lambda g: p1 + (low / top) ** g * (eye - p1)  # noqa: E731  of m, over the largest eigenvalue's power
        before = np.array([1.0, np.exp(w[2])])  # weights of states before the word's own score
        fore, at = [], 0
        for i, s in zip(places, scores, strict=True):
            if i > at:  # plain words from `at` on, then a step to i
                before = (before * plain) @ power(i - at - 1) @ step
            fore.append(before / before.sum())
            before = (fore[-1] * [1.0, np.exp(s)]) @ step
            at = i + 1
        after, back, at = np.ones(2), [], n
        for i, s in zip(reversed(places), reversed(scores), strict=True):
            gap = at - i - 1  # plain words after i
            after = after if at == n and gap == 0 else power(gap) @ after if at == n else power(gap) @ step @ after
            after = after / after.sum()
            back.append(after)
            after = np.array([1.0, np.exp(s)]) * after
            at = i
        own = np.array(fore) * np.stack([np.ones(len(scores)), np.exp(scores)], axis=1) * np.array(back[::-1])
        return own[:, 1] / own.sum(axis=1)

    def tag(self, text: str) -> tuple[int, list[int], np.ndarray]:
        n, at, got = self.hits(text)
        if not at:
            return n, [], np.zeros(0)
        places, scores = self.emissions(n, at, got)
        return n, places, self.marginals(n, places, scores)

    def inputs(self, n: int, p: np.ndarray) -> list[float]:
        return [1.0, float(np.log1p(p.sum())), float(np.log1p(100 * p.sum() / max(n, 1))), float(1 - np.prod(1 - p))]

    def score(self, n: int, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.document @ self.inputs(n, p), -30, 30))))

    def spans(self, text: str, places: list[int], p: np.ndarray) -> list[dict]:
        """Runs of toxic words: code points, end exclusive."""
        bad, out, last = {i for i, x in zip(places, p, strict=True) if x >= 0.5}, [], -2
        if bad:
            for i, m in enumerate(_WORD.finditer(text)):
                if i in bad:
                    if i == last + 1:
                        out[-1]["end"] = m.end()
                    else:
                        out.append({"start": m.start(), "end": m.end()})
                    last = i
        return out


Windows = Counter[tuple[tuple[tuple[int, ...], ...], tuple[int, ...], tuple[int, ...]]]


def _windows(tagger: Tagger, texts: list[str], toxic: bool) -> Windows:
    """(features, neighbours with features, labels) by word, of windows that cover the texts: those around hits, and the plain
    stretches between, cut at the same length. Equal windows, as plain ones of a length are, are one with its number."""
    out: Windows = Counter()
    width = 2 * AROUND + 1
    plain = lambda k: (((),) * k, (0,) * k, (0,) * k)
    for text in texts:
        n, at, got = tagger.hits(text)
        where = dict(zip(at, got, strict=True))
        done = 0
        for i in [*at, None]:
            if i is not None and i < done:
                continue
            a = n if i is None else max(done, i - AROUND)
            full, rest = divmod(a - done, width)
            if full:
                out[plain(width)] += full
            if rest:
                out[plain(rest)] += 1
            if i is not None:
                done = min(n, i + AROUND + 1)
                span = range(a, done)
                out[tuple(where.get(j, ()) for j in span), tuple((j - 1 in where) + (j + 1 in where) for j in span), tuple(int(toxic and j in where) for j in span)] += 1
    return out


def fit_chain(tagger: Tagger, windows: Windows, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> None:
    """Adam on the log-likelihood of the windows, all at once: shorter ones are padded behind, where steps do nothing. Words
    with the same features are of one kind, so a word is a small number here. The ridge is a share of the windows with features."""
    width, size = 2 * AROUND + 1, len(windows)
    kinds: dict[tuple[int, ...], int] = {(): 0}
    kind, beside, y, real = (np.zeros((size, width), t) for t in (np.int32, np.int8, np.int8, np.float32))
    times = np.zeros(size)
    for i, ((features, around, labels), k) in enumerate(windows.items()):
        n = len(labels)
        kind[i, :n], beside[i, :n], y[i, :n], real[i, :n] = [kinds.setdefault(f, len(kinds)) for f in features], around, labels, 1
        times[i] = k
    held = np.zeros((len(kinds), len(tagger.features)))
    for f, k in kinds.items():
        held[k, list(f)] = 1
    w, m, v = tagger.weights, np.zeros_like(tagger.weights), np.zeros_like(tagger.weights)
    both, scale = real[:, 1:], max(1.0, times[kind.any(axis=1)].sum())
    for t in range(1, rounds + 1):
        score = np.zeros((size, width, 2))
        score[..., 1] = w[0] + (held @ w[7:])[kind] + w[1] * beside
        score[:, 0, 1] += w[2]
        step = w[3:7].reshape(2, 2)
        fore, back = score.copy(), np.zeros_like(score)
        for i in range(1, width):
            new = np.logaddexp(*(fore[:, i - 1, s, None] + step[s] for s in (0, 1))) + score[:, i]
            fore[:, i] = np.where(real[:, i, None] > 0, new, fore[:, i - 1])
        for i in range(width - 2, -1, -1):
            new = np.logaddexp(*((step[:, s] + (score[:, i + 1, s] + back[:, i + 1, s])[:, None]) for s in (0, 1)))
            back[:, i] = np.where(real[:, i + 1, None] > 0, new, 0)
        z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        off = (y - np.exp(fore[..., 1] + back[..., 1] - z[:, None])) * real * times[:, None]
        grad = np.zeros_like(w)
        grad[0], grad[1], grad[2] = off.sum(), (off * beside).sum(), off[:, 0].sum()
        grad[7:] = held.T @ np.bincount(kind.ravel(), weights=off.ravel(), minlength=len(kinds))
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(fore[:, :-1, a] + step[a, b] + score[:, 1:, b] + back[:, 1:, b] - z[:, None])
                grad[3 + 2 * a + b] = ((((y[:, :-1] == a) & (y[:, 1:] == b)) - pair) * both * times[:, None]).sum()
        grad = grad / scale - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def fit_document(tagger: Tagger, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression by Newton steps."""
    w = np.zeros(rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (weight * (y - p)) - 0.05 * w
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(bend, grad)
    tagger.document = w


def held_out(id_col: Column) -> Column:
    """crc32 of the identifier as text mod 5 is 0; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_chars: int) -> Tagger:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        taken = part if taken is None else taken.union(part)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(taken), "_id")  # at most 2 * most ids
    one = texts.groupBy("_y", "_id").agg(F.max(F.struct(F.length("_t").alias("n"), F.col("_t").alias("t"))).alias("d"))
    before = F.sum("d.n").over(Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id"))  # at most `most` rows a class
    sample = sorted({(r["_y"], r["t"]) for r in one.withColumn("chars", before).where(F.col("chars") <= most_chars).select("_y", "d.t").collect()})  # equal texts count once
    toxic, clean = ([t for y, t in sample if y == k] for k in (1, 0))
    if not toxic or not clean:
        return Tagger([])
    tagger = Tagger(choose(toxic, clean))
    windows = _windows(tagger, toxic, True) + _windows(tagger, clean, False)
    if windows and tagger.features:
        fit_chain(tagger, windows)
    rows = []
    for t in toxic + clean:
        n, _, p = tagger.tag(t)
        rows.append(tagger.inputs(n, p))
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    weight = np.where(y == 1, totals[1] / len(toxic), totals[0] / len(clean))
    fit_document(tagger, np.array(rows), y, weight / weight.mean())
    return tagger


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED, most_chars: int = MAX_CHARS) -> Tagger:
    """Fit on labelled documents that are not held out: at most `most` rows and `most_chars` characters of each class, those with
    the least hash of the identifier. Rows of labels with a null in either column are left out; of two labels of a document
    the larger counts, and of several texts the longest. With just one class there is nothing to learn, and each text scores near 0.
    The sample's memory goes back to the system when the fit ends."""
    try:
        return _train(docs, labels, id_col, text_col, label_col, most, most_chars)
    finally:
        give_back()


def _scored(rows: DataFrame, tagger: Tagger, text: str | None, spans: bool) -> DataFrame:
    """rows: (carried, t), or (carried) with the text in its field of that name. (carried, toxic_score, toxic_spans)."""
    small_batches(rows.sparkSession)
    held, name = rows.sparkSession.sparkContext.broadcast(tagger), text
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for batch in batches:
            scores, where = [], []
            for x in batch.column(1) if name is None else batch.column(0).field(name).cast(pa.string()):
                text = x.as_py() or ""
                n, places, p = tagger.tag(text)
                scores.append(tagger.score(n, p))
                where.append(tagger.spans(text, places, p) if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(where, span)], names=["carried", "toxic_score", "toxic_spans"])
        tagger.memo.clear()  # a worker that waits for the next task holds no memory

    return rows.mapInArrow(run, StructType([rows.schema["carried"], *_SCORES.fields]))


_SCORES = StructType([StructField("toxic_score", DoubleType()), StructField("toxic_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])


def scored(docs: DataFrame, tagger: Tagger, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """The carried columns of each row of docs, toxic_score (0 to 1) and toxic_spans (start, end); a carried column of one of these
    names gives way. A null text counts as empty and scores as one without any evidence; repeats and nulls of other columns stay;
    an empty table gives an empty result."""
    names = [c for c in carry if c not in _SCORES.names]
    made = _scored(docs.select(F.struct(*map(column, names)).alias("carried"), column(text_col).cast("string").alias("t")), tagger, None, spans)
    return made.select("carried.*", *_SCORES.names)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_clean(docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns under whatever names. Null texts are clean; repeats
    stay; an empty table gives an empty result."""
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("carried"))
    found = _scored(rows, train(docs, labels(docs.sparkSession, sf_dir)), "text", spans=False)
    return found.where("toxic_score < 0.5").select("carried.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scored(docs, train(docs, labels(spark, sf_dir)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
