"""The pipeline, stage by stage, against brute force."""

import collections
import random
import re

import tiktoken

import corpus_pipeline
from tests.llm.test_free import components
from textloom.llm import bpe, minhash, mixing, toxicity
from textloom.llm.common import documents, written


def test_stages(spark, sf, tmp_path):
    docs = documents(spark, sf)
    before = docs.toPandas()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        out[name] = docs.toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == list(out)
    clean, equal, near, mixed, tokens = out.values()
    assert all(list(x.columns) == list(before.columns) for x in (clean, equal, near, mixed))
    scores = toxicity.scored(documents(spark, sf), toxicity.train(documents(spark, sf), toxicity.labels(spark, sf))).toPandas()
    assert sorted(clean.doc_id) == sorted(scores[scores.toxic_score < 0.5].doc_id)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    last = {}
    for r in clean.itertuples():
        last[lower(r.text)] = max(r.doc_id, last.get(lower(r.text), -1))
    assert sorted(equal.doc_id) == sorted(last.values())
    groups = components([(r.doc_id, r.text) for r in equal.itertuples()], corpus_pipeline.NEAR)
    assert sorted(near.doc_id) == sorted(d for d, (n, c) in groups.items() if d == c)
    copies = mixing.mix(spark.createDataFrame(near)).toPandas()
    assert collections.Counter(mixed.doc_id) == {r.doc_id: r.copies for r in copies.itertuples() if r.copies}
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(zip(near.doc_id, near.text, strict=True))
    assert collections.Counter(tokens.doc_id) == collections.Counter(mixed.doc_id)
    assert all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in tokens.itertuples())


def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty):
    """Nulls, empty and very long texts, repeated rows, clashing columns; tables without rows."""
    for docs, want in ((odd, (10, 6, 6)), (empty, (0, 0, 0))):
        names, seen = docs.columns, []
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), "test-stage")
            seen.append(docs.count())
            if len(seen) < 5:
                assert docs.columns == names
        assert tuple(seen[:3]) == want and seen[3] == seen[4]


def jobs(spark, run):
    """What run() returns, and how many Spark jobs it started."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_driver_has_few_jobs(spark, sf):
    """Each job's tasks are the driver's to keep: classes of the mix are one aggregation each, few links are joined in one task."""
    copies, n = jobs(spark, lambda: mixing.mix(documents(spark, sf)).collect())
    assert copies and n <= 34
    chain = [(i, i + 1) for i in range(300)]  # labels went along it round by round
    found, n = jobs(spark, lambda: minhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert {tuple(r) for r in found} == {(i, 0) for i in range(301)} and n <= 8


def test_components_either_way(spark):
    rng = random.Random(3)
    links = [(a, b) for a, b in ((rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)) if a != b]
    links += [(x + 1000 * k, y + 1000 * k) for k in (1, 2) for x, y in ((9, 8), (8, 2), (2, 5), (5, 9), (1, 5))]
    least = {x: x for pair in links for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    for few in (len(links), 0):
        found = minhash.components(spark.createDataFrame(links, "a bigint, b bigint"), few).collect()
        assert len(found) == len(least) and {r["node"]: r["label"] for r in found} == least
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_the_fit_gives_memory_back(spark, sf, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "give_back", lambda: done.append(1))
    toxicity.train(documents(spark, sf), toxicity.labels(spark, sf))
    assert done
