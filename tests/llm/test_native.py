"""Secret scans, license scans, mixing and exact dedup: against DuckDB, and on odd and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import plain
from tests.llm.conftest import LONG, frame
from textloom.llm import exact_dedup, license_scan, mixing, secrets
from textloom.llm.common import work_path
from textloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, small, sf, name):
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(small.sql(ORACLES[name]).df())


def ledger(spark):
    return secrets.BlobLedger(spark, work_path(spark, "test-ledger"))


def test_secrets_odd_and_empty(spark, odd, empty):
    assert secrets.secret_scan(odd, ledger(spark)).where("size(spans) = 0").count() == 10
    assert secrets.secret_scan(empty, ledger(spark)).count() == 0


def test_secret_spans(spark):
    hexes = "0123456789abcdef" * 3
    texts = [f"é\U0001f600 token = '{hexes}' and AKIA{'B' * 16}", "secret: token=\"12345678\" password=short", "PassWord:longenough1", "0" * 31, None]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.secret_scan(docs, ledger(spark)).collect()}
    a = texts[0].index("token")
    assert got[0] == [("assign", a, a + 9 + 48), ("hex", a + 9, a + 57), ("access", texts[0].index("AKIA"), len(texts[0]))]
    assert got[1] == [] and got[3] == [] and got[4] == []  # the first match takes `token=`, is too short and goes
    assert got[2] == [("assign", 0, 20)]


def test_ledger_is_incremental(spark):
    own, key = ledger(spark), "AKIA" + "C" * 14
    one = frame(spark, [(1, f"x {key}", None), (2, f"x {key}", None), (3, "plain", None)])
    two = frame(spark, [(4, f"x {key}", None), (5, "secret=abcdefgh1", None)])
    blobs = lambda d: d.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    assert own.scan(blobs(one).select("blob"), blobs(one)) == 2
    assert own.scan(blobs(one).select("blob"), blobs(one)) == 0
    assert own.scan(blobs(two).select("blob"), blobs(two)) == 1  # just the unseen blob
    newer = (secrets.Rule("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}", version=2),)
    assert own.scan(blobs(one).select("blob"), blobs(one), newer) == 2  # a new version of a rule runs over all
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.secret_scan(two, own).collect()} == {4: 1, 5: 1}


def test_ledger_names_all_versions(spark):
    """A secret that later versions of a path no longer hold is still found on the earlier one, and on other paths to the same blob."""
    own, key = ledger(spark), "AKIA" + "D" * 14
    for rows in ([(1, f"x {key}", None), (2, "y", None)], [(1, "x", None), (3, f"x {key}", None)], [(1, "x", None)]):
        last = secrets.secret_scan(frame(spark, rows), own).collect()
    assert [len(r["spans"]) for r in last] == [0]
    rows = own.history().collect()
    assert sorted((r["doc_id"], r["rule"], r["start"]) for r in rows) == [(1, "access@1", 2), (3, "access@1", 2)] and len({r["scan"] for r in rows}) == 2


def test_license_odd_and_empty(spark, odd, empty):
    rows = license_scan.license_scan(odd).collect()
    assert len(rows) == 10 and all(r["score"] == 0 for r in rows)
    assert sorted(r["n_words"] for r in rows)[-1] == 60_000
    assert license_scan.license_scan(empty).count() == 0


def test_several_licenses_of_a_text_are_reported(spark):
    bsd, mpl = (license_scan.TEMPLATES[k] for k in ("bsd", "mpl"))
    rows = [(1, f"{bsd} or {mpl} all rights reserved", None), (2, license_scan.TEMPLATES["cc-by-nc"], None)]
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: {"bsd", "mpl", "all-rights-reserved"}, 2: {"cc-by-nc"}}


def test_line_breaks_do_not_matter(spark):
    """A template wrapped at any width, within other words, is found as it is on one line."""
    words = license_scan.TEMPLATES["mit"].split()
    wrapped = lambda k: "\n# ".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))
    rows = [(k, f"Some words before.\n\n{wrapped(k)}\n\nand others after it", None) for k in (3, 10, 40)]
    got = {r["doc_id"]: (r["score"], [(m["label"], m["start"]) for m in r["matches"]]) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == dict.fromkeys((3, 10, 40), (1.0, [("mit", 3)]))


def test_license_join_is_exact(spark):
    """All pairs of texts and templates with a block at the threshold, by brute force over all blocks."""
    import random

    rng = random.Random(5)
    sets = license_scan.template_sets(license_scan.TEMPLATES)
    vocabulary = sorted({w for s in sets.values() for w in s})
    texts = [[rng.choice([*vocabulary, "filler", "other"]) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    for text in license_scan.TEMPLATES.values():
        for drop in range(4):
            words = [w for k, w in enumerate(text.split()) if k >= drop and rng.random() > 0.1]
            for _ in range(rng.randint(0, len(words))):
                words.insert(rng.randint(0, len(words)), "filler")
            texts.append(words)
    rows = [(str(i), [(pos, w) for pos, w in enumerate(t) if w in vocabulary]) for i, t in enumerate(texts)]
    index = license_scan.prefix_index(license_scan.TEMPLATES, {w: i for i, w in enumerate(rng.sample(vocabulary, len(vocabulary)))})
    found = license_scan.license_join(spark.createDataFrame(rows, "key string, hits array<struct<pos:int,w:string>>"), index).collect()
    got = {(r["key"], r["label"]): (round(r["containment"], 9), r["start"]) for r in found}
    want = {}
    for i, t in enumerate(texts):
        for label, s in sets.items():
            width = next(x[4] for x in index if x[1] == label)
            each = [(len(set(t[a : a + width]) & set(s)) / len(s), -a) for a in range(len(t)) if t[a] in s]
            if each and max(each)[0] >= license_scan.THRESHOLD:
                want[str(i), label] = (round(max(each)[0], 9), -max(each)[1])
    assert got == want and len(want) > 40


def test_mixing_odd_and_empty(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mixing_targets_and_reruns(spark):
    source = lambda i: f"s{i % 4}" if i % 5 else None
    docs = frame(spark, [(i, "w " * (1 + i * 7 % 50), source(i)) for i in range(4000)])
    rows = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "copies")
    by = {}
    for r in rows.collect():
        by.setdefault((source(r["doc_id"]), r["source_size"], r["target"]), []).append(r["copies"] * r["size"])
    assert len(by) == 5 and abs(sum(t for _, _, t in by) - sum(z for _, z, _ in by)) < 1e-3
    assert all(abs(sum(taken) - t) <= 0.02 * t + 50 and t <= 3 * z + 1e-6 for (_, z, t), taken in by.items())
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect()))
    n = sum(r["copies"] for r in rows.collect())
    assert mixing.mixed(docs).count() == n


def test_targets_stop_at_the_cap(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 0)], "source string, z long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got["b"] == 3.0 and got["c"] == 30.0 and abs(got["a"] - 78.0) < 1e-9 and got[None] == 0.0


def test_dedup_odd_and_empty(spark, odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 10
    same = [r for r in rows if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {2} and [r["doc_id"] for r in same if r["kept"]] == [2]
    assert sum(r["kept"] for r in rows) == 6
    none = next(r for r in rows if r["doc_id"] == 4)
    assert none["text_sha256"] == hashlib.sha256(b"").hexdigest() and none["group_size"] == 2
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_dedup_keeps_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, "same", "a"), (1, "SAME", "a"), (2, LONG, "a"), (3, None, None)])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]


def test_dedup_compares_whole_texts(spark):
    """With a digest that everything shares, groups are those of equal texts still."""
    docs = frame(spark, [(1, "a", None), (2, "b", None), (3, "A", None)])
    weak = lambda c: F.unhex(F.substring(F.lit("00"), 1, 2))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, digest=weak).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


def test_state_goes_on(spark, tmp_path):
    """Calls with one state count the documents of earlier ones, whose contents are found by locator for the check of full bytes."""
    state = work_path(spark, "test-state")
    calls = [[("a1", "a"), ("c1", "c")], [("a5", "A"), ("b2", "b")], [("a3", "a"), (None, "c")]]
    want = [{"a1": ("a1", 1, True), "c1": ("c1", 1, True)}, {"a5": ("a5", 2, True), "b2": ("b2", 1, True)}, {"a3": ("a5", 3, False), None: ("c1", 2, False)}]
    for i, (rows, told) in enumerate(zip(calls, want, strict=True)):
        spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        found = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/{i}"), state=state).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == told


def test_state_compares_with_earlier_contents(spark, tmp_path):
    state, weak = work_path(spark, "test-state"), lambda c: F.unhex(F.lit("00"))
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(3, "B"), (4, "d")]]):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{i}")
        found = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/{i}"), digest=weak, state=state).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == {3: (3, 2, True), 4: (4, 1, True)}


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("x", "one two", "s"), ("y", "ONE two", None), (None, "three", "s")], "doc_id string, text string, source string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()} == {"x": "y", "y": "y", None: None}
    assert {r["doc_id"] for r in exact_dedup.keep_one(docs).collect()} == {"y", None}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {"x": 2, "y": 2, None: 1}
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_comes_near_with_few_documents(spark):
    """Sources of few documents, some of them large: words taken are within the smallest documents of the target."""
    rows = [(i, "w " * z, s) for s in "abc" for i, z in enumerate([900, 400, 200, 100, 50, 40, 30, 20, 10, 5, 5, 3, 2, 1, 1] * 2)]
    by = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        assert r["copies"] <= 3
        by.setdefault((r["source_size"], r["target"]), []).append(r["copies"] * r["size"])
    assert len(by) == 3 and all(abs(sum(t) - target) <= 0.02 * target for (_, target), t in by.items())


def test_license_texts_are_taken_apart_once(spark, monkeypatch):
    """Order and filters work on a text's words of templates, and texts are read by one action."""
    read = []
    monkeypatch.setattr(license_scan, "lower_ascii", lambda c, f=license_scan.lower_ascii: read.append(1) or f(c))
    rows = [(1, f"x\x01y É {license_scan.TEMPLATES['mit-short'].upper()}", None), (2, "rights of all are reserved", None), (3, None, None)]
    got = {r["doc_id"]: (r["n_words"], [m["label"] for m in r["matches"]]) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: (8, ["mit-short"]), 2: (5, ["all-rights-reserved"]), 3: (0, [])} and len(read) == 1
