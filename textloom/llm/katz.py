"""Language-model scoring with Katz backoff: bigrams, then unigrams, then one class for unknown words.

The model is a folder of partitioned tables: n-grams with their counts by order and range of key, and for each context the sums
that its backoff weight is made of. Texts are scored from them as they are built, or later by score_with(), without training again.

Counts are discounted by Good-Turing; the mass left in a context goes to words not seen there, by their unigram
probability, with a weight that makes the context's probabilities sum to exactly one.

Texts become chunks of some CHUNK tokens (distinct words' hashes and the tokens as places among them), written once. A chunk
asks for the corpus counts of its distinct words and bigrams only: keys go out sorted and packed by range of key, each range
(a partition of the count table) adds up what the chunks hold, and answers with the counts in the order asked. A key
is in a chunk's request once however often it occurs, and keys are spread evenly over the ranges, so frequent words and
pairs make no hot task. Sums for the backoff weights go the same way: just one of the chunks with a bigram owns
it and adds it to its context's sums; chunks then ask for the weights of the contexts they back off from. The number of
ranges grows with the corpus, so a task's share does not. Nothing but counts of counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import conf, documents, remove, scratch, shuffles_end, small_batches, text_of, work_path, written
from .kernel import U, mix, text_batches, words

#: Tokens a chunk holds at least, unless its task has no more, and keys a range is to hold, about.
CHUNK, RANGE = 1_500_000, 1_000_000
#: Good-Turing holds for counts up to K. Larger ones lose TAIL of a count, so that every context has mass left.
K, TAIL = 5, 0.1
#: Additive smoothing of the base score.
BASE = 0.1
_END, _START = U(0xE5D0E5D0E5D0E5D1), U(0x57A2757A2757A271)
_FIRST, _SECOND = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)


def pack(a: np.ndarray) -> bytes:
    """By byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U), dtype=U)


def by_range(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, empty ranges left out."""
    at = ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)
    cut = np.searchsorted(at, np.arange(n + 1))
    return ((q, cut[q], cut[q + 1]) for q in np.flatnonzero(np.diff(cut)).tolist())


class Chunk:
    """A row of the table of chunks, unpacked. Places of words: their order by hash; the context START has the place after
    the last."""

    def __init__(self, row: dict):
        self.vocab = unpack_keys(row["vocab"])
        self.tokens = unpack(row["tokens"], np.int32).astype(np.int64)
        sizes = unpack(row["sizes"], np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.train = ~np.repeat(np.array(row["held"], bool), sizes)
        v = len(self.vocab)
        before = np.concatenate([[v], self.tokens[:-1]])
        before[self.first[:-1]] = v
        codes, self.pair = np.unique(before * (v + 1) + self.tokens, return_inverse=True)
        self.left, self.right = codes // (v + 1), codes % (v + 1)
        hashes = np.append(self.vocab, _START)
        keys = mix(hashes[self.left] * _FIRST + hashes[self.right] * _SECOND)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counted(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their counts in the chunk's training texts. Kinds: 1 words, 2 bigrams."""
        if kind == 1:
            return self.vocab, np.bincount(self.tokens[self.train], minlength=len(self.vocab))
        return self.keys, np.bincount(self.pair[self.train], minlength=len(self.keys))[self.order]


def _each(run: Callable[[dict], Iterator[dict]], schema: pa.Schema) -> Callable:
    """run, row by row, as a function for mapInArrow."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                for rows in run(batch.slice(i, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_pydict(rows, schema)

    return batches


def chunks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, parts, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate([p[3] for p in parts])
            vocab, at = np.unique(tokens, return_inverse=True)
            ids, flags = pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            sizes = np.concatenate([p[2] for p in parts])
            trained = int((~np.array(flags.to_pylist(), bool)).sum())
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([len(tokens)]), pa.array([trained]), one(ids), one(flags), pa.array([pack(sizes.astype(np.int32))]), pa.array([pack_keys(vocab)]), pa.array([pack(at.astype(np.int32))])], names=["chunk", "n", "trained", "doc_id", "held", "sizes", "vocab", "tokens"])

        for batch in batches:
            for a, b, data, bounds in text_batches(batch.column(2)):
                w = words(data, bounds, lower=True)
                parts.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), w.counts + 1, np.insert(w.hash, w.first[1:], _END)))
                n += len(parts[-1][3])
                if n >= CHUNK:
                    yield out()
                    parts, n, made = [], 0, made + 1
        if parts:
            yield out()

    schema = f"chunk bigint, n bigint, trained bigint, doc_id array<{kind}>, held array<boolean>, sizes binary, vocab binary, tokens binary"
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), text_of(text_col).alias("text")).mapInArrow(run, schema)


_ASKED = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = "chunk bigint, kind int, range bigint, keys binary, totals binary, owned binary, types bigint, n bigint, " + ", ".join(f"r{r} bigint" for r in range(1, K + 2))


#: The chunk that rows of the model's tables have.
TABLE = -1


def counts(held: DataFrame, ranges: int, model: DataFrame | None = None) -> DataFrame:
    """Answers for each chunk, kind and range: the corpus counts of the keys asked, which of them the chunk owns, and over
    those owned the types that training texts hold, their tokens, and the types of counts 1 to K + 1. The rows of chunk TABLE are the
    table of n-grams: all keys of training texts, in order, and their counts. model: such rows of a model, which count too."""

    build = model is None

    def ask(row: dict) -> Iterator[dict]:
        c = Chunk(row)
        for kind in (1, 2):
            keys, own = c.counted(kind)
            for q, a, b in by_range(keys, ranges):
                yield {"kind": [kind], "range": [q], "chunk": [row["chunk"]], "keys": [pack_keys(keys[a:b])], "counts": [pack(own[a:b].astype(np.int32))]}

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [unpack_keys(r["keys"]) for r in rows]
        cut = np.cumsum([0, *map(len, keys)])
        known, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack(r["counts"], np.int64 if r["chunk"] == TABLE else np.int32) for r in rows])).astype(np.int64)
        mine, out = np.zeros(cut[-1], bool), []
        mine[first] = True  # the first chunk with a key
        for i, r in enumerate(rows):
            t, o = total[at[cut[i] : cut[i + 1]]], mine[cut[i] : cut[i + 1]]
            own = t[o]
            out.append({"chunk": r["chunk"], "kind": r["kind"], "range": r["range"], "keys": None, "totals": pack(t), "owned": pack(o), "types": int((own > 0).sum()), "n": int(own.sum())} | {f"r{x}": int((own == x).sum()) for x in range(1, K + 2)})
        if build:
            own = total > 0
            out.append({"chunk": TABLE, "kind": rows[0]["kind"], "range": rows[0]["range"], "keys": pack_keys(known[own]), "totals": pack(total[own]), "owned": None, "types": 0, "n": 0} | {f"r{x}": 0 for x in range(1, K + 2)})
        return pa.Table.from_pylist(out, pa.schema([(f, pa.int32() if f == "kind" else pa.binary() if f in ("keys", "totals", "owned") else pa.int64()) for f in ("chunk", "kind", "range", "keys", "totals", "owned", "types", "n", *(f"r{x}" for x in range(1, K + 2)))]))

    asked = held.select("chunk", "held", "sizes", "vocab", "tokens").mapInArrow(_each(ask, _ASKED), "kind int, range bigint, chunk bigint, keys binary, counts binary")
    if model is not None:
        asked = asked.unionByName(model.select("kind", "range", "chunk", "keys", "counts"))
    return asked.groupBy("kind", "range").applyInArrow(answer, _TOLD)


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to K from n, the numbers of types with counts 1 to K + 1: Good-Turing, scaled so that counts
    above K keep theirs. Where the numbers do not give factors between 0 and 1 (copies upset them), they are smoothed
    to a line in log space first; where that does not fall fast enough (tiny corpora), half a count is taken."""

    def turing(m: np.ndarray) -> np.ndarray:
        r, rest = np.arange(1, K + 1), (K + 1) * m[K] / m[0]
        return (((r + 1) * m[1:] / (r * m[:-1])) - rest) / (1 - rest)

    fits = lambda f: bool(np.isfinite(f).all() and (f > 0).all() and (f < 1).all())
    r, m = np.arange(1, K + 2), np.array(n, float)
    tried = []
    with np.errstate(all="ignore"):
        if (m > 0).all():
            tried.append(turing(m))
        if (m > 0).sum() >= 2:
            slope = np.polyfit(np.log(r[m > 0]), np.log(m[m > 0]), 1)[0]
            tried.append(turing(r**slope))
    plain = (r[:K] - 0.5) / r[:K]
    return np.concatenate([[1.0], next((f for f in tried if fits(f)), plain)])


def discounted(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(c <= K, c * by[np.minimum(c, K)], c - TAIL)


class Model:
    """Sizes and discounts: what is the same for all chunks."""

    def __init__(self, stats: dict[int, dict], trained: int):
        none = {"n": 0, "types": 0} | {f"r{r}": 0 for r in range(1, K + 2)}
        one, two = stats.get(1, none), stats.get(2, none)
        self.n, self.types, self.trained = one["n"], one["types"], trained
        self.by1, self.by2 = (discounts([x[f"r{r}"] for r in range(1, K + 2)]) for x in (one, two))
        small = {r: one[f"r{r}"] for r in range(1, K + 1)}
        kept = sum(r * k * self.by1[r] for r, k in small.items()) + (self.n - sum(r * k for r, k in small.items())) - TAIL * (self.types - sum(small.values()))
        self.unknown = 1 - kept / self.n if self.n else 1.0  # mass of the class of unknown words

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.by1) / max(self.n, 1), self.unknown)


_SCORED = [("chunk", pa.int64()), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("part", pa.list_(pa.float64())), ("sum_keys", pa.binary()), ("sums", pa.binary()), ("asks", pa.binary()), ("back_doc", pa.binary()), ("back_at", pa.binary())]


def scored(held: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """For each chunk: what needs no backoff weight of each text's score, the sums that the chunk owns, and the contexts whose
    weights it asks for, with the texts' places that use them."""
    answers = told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("kind", "range", "totals", "owned"))).alias("told"))

    def run(row: dict) -> Iterator[dict]:
        c = Chunk(row)
        total, owned = ({k: np.concatenate([unpack(x[f], kind) for x in row["told"] if x["kind"] == k]) for k in (1, 2)} for f, kind in (("totals", np.int64), ("owned", np.bool_)))
        word = total[1]
        pair, mine = np.empty(len(c.keys), np.int64), np.empty(len(c.keys), bool)
        pair[c.order], mine[c.order] = total[2], owned[2]
        context = np.append(word, model.trained)
        uni = model.unigram(word)
        seen = pair > 0
        p = np.where(seen, discounted(pair, model.by2) / np.maximum(context[c.left], 1), 0.0)
        score = np.log10(np.where(seen, p, uni[c.right]))[c.pair]
        base = np.log10((word + BASE) / (model.n + BASE * (model.types + 1)))[c.tokens]
        add = lambda x: np.add.reduceat(x, c.first[:-1])  # noqa: E731  each text has a token at least
        own = seen & mine
        v = len(c.vocab)
        s1, s2 = (np.bincount(c.left[own], weights=x[own], minlength=v + 1) for x in (p, uni[c.right]))
        hashes = np.append(c.vocab, _START)
        with_sums = np.flatnonzero(np.bincount(c.left[own], minlength=v + 1))
        with_sums = with_sums[np.argsort(hashes[with_sums])]
        back = np.flatnonzero((~seen & (context[c.left] > 0))[c.pair])
        where, at = np.unique(hashes[c.left[c.pair[back]]], return_inverse=True)
        text = np.searchsorted(c.first, back, "right") - 1
        yield {"chunk": [row["chunk"]], "n_tokens": [np.diff(c.first)], "n_known": [add((word > 0).astype(np.int64)[c.tokens])], "base": [add(base)], "part": [add(score)], "sum_keys": [pack_keys(hashes[with_sums])], "sums": [pack(np.concatenate([s1[with_sums], s2[with_sums]]))], "asks": [pack_keys(where)], "back_doc": [pack(text.astype(np.int32))], "back_at": [pack(at.astype(np.int32))]}

    kinds = "chunk bigint, n_tokens array<bigint>, n_known array<bigint>, base array<double>, part array<double>, sum_keys binary, sums binary, asks binary, back_doc binary, back_at binary"
    return held.select("chunk", "held", "sizes", "vocab", "tokens").join(answers, "chunk").mapInArrow(_each(run, pa.schema(_SCORED)), kinds)


_SUMS = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("asked", pa.bool_()), ("keys", pa.binary()), ("sums", pa.binary())])


def weights(parts: DataFrame, ranges: int, model: DataFrame | None = None) -> DataFrame:
    """(chunk, range, keys, weights): log10 of the backoff weights that chunks ask for, in the order asked. The rows of chunk TABLE are
    the table of contexts: keys in order, and their two sums. model: such rows of a model, in place of the chunks' sums."""

    build = model is None

    def send(row: dict) -> Iterator[dict]:
        keys, sums = unpack_keys(row["sum_keys"]), unpack(row["sums"], np.float64).reshape(2, -1)
        for q, a, b in by_range(keys, ranges):
            yield {"range": [q], "chunk": [row["chunk"]], "asked": [False], "keys": [pack_keys(keys[a:b])], "sums": [pack(sums[:, a:b].ravel())]}
        keys = unpack_keys(row["asks"])
        for q, a, b in by_range(keys, ranges):
            yield {"range": [q], "chunk": [row["chunk"]], "asked": [True], "keys": [pack_keys(keys[a:b])], "sums": [None]}

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])  # always added in the same order
        given, asked = [r for r in rows if not r["asked"]], [r for r in rows if r["asked"]]
        keys = np.concatenate([unpack_keys(r["keys"]) for r in given] or [np.zeros(0, U)])
        sums = np.concatenate([unpack(r["sums"], np.float64).reshape(2, -1) for r in given] or [np.zeros((2, 0))], axis=1)
        known, at = np.unique(keys, return_inverse=True)
        s1, s2 = (np.bincount(at, weights=x, minlength=len(known)) for x in sums)
        log = np.log10((1 - s1) / (1 - s2))
        out = [{"chunk": r["chunk"], "range": r["range"], "keys": None, "weights": pack(log[np.searchsorted(known, unpack_keys(r["keys"]))])} for r in asked]
        if build and len(known):
            out.append({"chunk": TABLE, "range": rows[0]["range"], "keys": pack_keys(known), "weights": pack(np.concatenate([s1, s2]))})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("weights", pa.binary())]))

    sent = parts.select("chunk", "sum_keys", "sums", "asks").mapInArrow(_each(send, _SUMS), "range bigint, chunk bigint, asked boolean, keys binary, sums binary")
    if model is not None:
        sent = sent.where("asked").unionByName(model.select("range", "chunk", F.lit(False).alias("asked"), "keys", "sums"))
    return sent.groupBy("range").applyInArrow(answer, "chunk bigint, range bigint, keys binary, weights binary")


_SCORES = "chunk bigint, place bigint, score double"


def _evaluate(docs: DataFrame, table: DataFrame, told: DataFrame, model: Model, ranges: int, id_col: str, store: str | None, contexts: DataFrame | None) -> DataFrame:
    """The result for the texts of a table of chunks, from the answers to them. store: where the table of contexts goes; contexts: that
    table, of a model made before."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"), scratch(spark) as keep:
        parts = keep(written(scored(table, told, model), "katz-parts"))
        if store:
            remove(spark, f"{store}/ngrams/answers=true")
        logs = weights(parts, ranges, contexts).withColumn("answers", F.col("chunk") != TABLE)
        if store:
            with shuffles_end(spark):
                logs.write.partitionBy("answers").parquet(f"{store}/contexts")
            logs = spark.read.schema(logs.schema).parquet(f"{store}/contexts")
        logs = logs.where("answers").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "weights"))).alias("logs"))

        def run(row: dict) -> Iterator[dict]:
            score = np.array(row["part"])
            if row["logs"]:
                log = np.concatenate([unpack(x["weights"], np.float64) for x in row["logs"]])
                score += np.bincount(unpack(row["back_doc"], np.int32), weights=log[unpack(row["back_at"], np.int32)], minlength=len(score))
            yield {"place": np.arange(len(score)), "chunk": np.full(len(score), row["chunk"]), "score": score}

        final = parts.select("chunk", "part", "back_doc", "back_at").join(logs, "chunk", "left")
        scores = keep(written(final.mapInArrow(_each(run, pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("score", pa.float64())])), _SCORES), "katz-scores"))
        if store:
            remove(spark, f"{store}/contexts/answers=true")
    rows = table.select("chunk", "doc_id", "held").join(parts.select("chunk", "n_tokens", "n_known", "base"), "chunk")
    rows = rows.select("chunk", F.posexplode(F.arrays_zip("doc_id", "held", "n_tokens", "n_known", "base")).alias("place", "d"))
    rows = rows.join(scores.withColumn("place", F.col("place").cast("int")), ["chunk", "place"])
    return rows.select(F.col("d.doc_id").cast(kind).alias("doc_id"), F.col("d.held").alias("held_out"), F.col("d.n_tokens").alias("n_tokens"), F.col("d.n_known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), F.col("d.base").alias("base_score"), "score")


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, store: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts of which `held` is true are scored without being learned from; it stands by default for those with
    crc32(doc_id as text) mod 10 = 0 (a null identifier counts as empty text). A null text counts as empty: one token,
    its end. Repeated rows are learned from as often as they occur. Without any training text each token is unknown
    with probability one. An empty table gives an empty result. Other columns of docs are not read.

    store: a folder for the model's tables, of the caller's or by default in the shared folder: ngrams (by kind: 1 for words, 2 for
    bigrams; range, keys, totals), contexts (range, keys, weights: the two sums) and sizes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store = (store or work_path(spark, "katz-model")).rstrip("/")
    if held is None:
        held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        table = written(chunks(docs, id_col, text_col, held), "katz-chunks")
    total, trained = table.agg(F.sum("n"), F.sum("trained")).first()
    ranges = max(1, ceil((total or 0) / RANGE))
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"), shuffles_end(spark):
        told = counts(table, ranges).withColumn("answers", F.col("chunk") != TABLE)
        told.write.partitionBy("answers", "kind").parquet(f"{store}/ngrams")
        told = spark.read.schema(told.schema).parquet(f"{store}/ngrams").where("answers")
    sizes = [F.sum(c).alias(c) for c in ("types", "n", *(f"r{r}" for r in range(1, K + 2)))]
    stats = told.groupBy("kind").agg(*sizes).withColumn("trained", F.lit(trained or 0).cast("long")).withColumn("ranges", F.lit(ranges).cast("long"))
    stats.coalesce(1).write.parquet(f"{store}/sizes")
    model = Model({r["kind"]: r.asDict() for r in spark.read.parquet(f"{store}/sizes").collect()}, trained or 0)  # two rows
    return _evaluate(docs, table, told, model, ranges, id_col, store, None)


def score_with(store: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns for texts that a stored model has not seen, all held out; nulls, repeats and empty tables as there. A model
    without training texts gives no scores: that raises."""
    spark, store = docs.sparkSession, store.rstrip("/")
    small_batches(spark)
    stats = {r["kind"]: r.asDict() for r in spark.read.parquet(f"{store}/sizes").collect()}
    ranges = stats[1]["ranges"]
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        table = written(chunks(docs, id_col, text_col, F.lit(True)), "katz-chunks")
    ngrams = spark.read.parquet(f"{store}/ngrams").where(~F.col("answers").cast("boolean")).select(F.col("kind").cast("int").alias("kind"), "range", "chunk", "keys", F.col("totals").alias("counts"))
    contexts = spark.read.parquet(f"{store}/contexts").where(~F.col("answers").cast("boolean")).select("range", "chunk", "keys", F.col("weights").alias("sums"))
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        told = written(counts(table, ranges, ngrams), "katz-told").where(F.col("chunk") != TABLE)
    return _evaluate(docs, table, told, Model(stats, stats[1]["trained"]), ranges, id_col, None, contexts)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
