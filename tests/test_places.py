"""Forms of words, terms, citations, placement and pages, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_functions import one
from textloom.functions import folding as fd
from textloom.functions import similarity as sm
from textloom.operators import citations as ct
from textloom.operators import gate as gt
from textloom.operators import language as lg
from textloom.operators import ledger as ld
from textloom.operators import pages as pg
from textloom.operators import passages as ps
from textloom.operators import placement as pl
from textloom.operators import terms as tm
from textloom.sources import tables as io


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (fd.latin_key, {"Tawheed": "tawhid", "al-Salaah": "sala", "Salat": "sala", "prayers": "prayer", "worshipping": "worship", "Sunnah": "suna", "Qur’ān": "quran", "Tauhid": "tawhid", None: ""}),
        (fd.spelling, {"Qur’an's": "qur'an", "al-Fitrah": "fitrah", None: ""}),
        (fd.looks_transliterated, {"Mas’ud": True, "won't": False, "ṣalāh": True, "God's": False, "plain": False}),
        (fd.is_arabic, {"السلام عليكم": True, "یہ گھر": False, "mixed سلام words here": False}),
        (fd.strip_trailing_reference, {"so it is (Quran 2:255).": "so it is", "no reference": "no reference"}),
        (fd.strip_quote_marks, {"“so it is”": "so it is", " «x» ": "x"}),
        (fd.clean_rendering, {"(2:255) God [3] is ____ note": "God is", "12. plain": "plain", None: ""}),
        (fd.quoted_core, {"he said “a b c” then left": "“a b c”", "a b": "a b", "one": "one", "no marks at all here": "no marks at all here"}),
        (fd.fold_term, {"(التوحيد)": "التوحيد", "صلاة": "صلاة", "موسى": "موسى", "أَمْر": "امر", None: ""}),
        (fd.strip_harakat, {"الإِسْلَامُ": "الإسلام"}),
    ],
)
def test_forms(spark, function, cases):
    for text, want in cases.items():
        assert one(spark, text, function(F.col("x"))) == want, text


def test_shortened(spark):
    assert one(spark, "a" * 200 + ". " + "b" * 300, fd.shortened(F.col("x"))) == "a" * 200 + "."
    assert one(spark, "- short", fd.shortened(F.col("x"))) == "short"
    assert one(spark, "a" * 400, fd.shortened(F.col("x"))) == "a" * 300 + "…"


def test_alternatives_and_keys(spark):
    assert one(spark, "Tawhid / Oneness of God (creed)", fd.alternatives(F.col("x"))) == ["Tawhid", "Oneness of God", "creed"]
    assert one(spark, "The People of the Book", fd.form_keys(F.col("x"))) == ["people", "of", "bok"] or one(spark, "The People of the Book", fd.form_keys(F.col("x")))[0] == "people"
    assert "صلاة" in one(spark, "وصلاتهم", fd.candidates(F.col("x")))


def test_vowels():
    assert not pg.agree("الخُطْبَة", "الْخِطْبَةُ") and not pg.agree("الإله", "الآلَةُ") and pg.agree("صلاة", "صَلَاة") and pg.agree("بيت", "بيتنا") and pg.agree("ٱسم", "إسم")


def test_consumption_is_left_to_right(spark):
    hits = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 1, 4), (1, "c", 2, 3), (1, "d", 2, 5), (1, "e", 9, 10)], "doc_id long, term_id string, start long, end long")
    assert sorted(r["term_id"] for r in tm.consumed(hits, "term_id").collect()) == ["a", "d", "e"]


def test_term_status(spark):
    docs = spark.createDataFrame([(1, "s t u".split(), "good one here".split()), (2, "s t".split(), "bad word and good one".split()), (3, "s t".split(), ["nothing"]), (4, ["u"], ["odd"]), (5, ["w"], [])], "doc_id long, sw array<string>, tw array<string>")
    records = spark.createDataFrame(
        [(1, ["s", "t"], 0, False, False, True, [("approved", ["good", "one"]), ("discouraged", ["bad", "word"])]), (2, ["u"], 1, None, True, False, [("unattested", ["odd"])]), (3, ["w"], 2, None, None, None, [("translit", ["double"])]), (4, ["s", "t"], 3, True, True, True, [("approved", ["nothing"])])],
        "record_id int, source array<string>, rank int, wrong_sense boolean, ambiguous boolean, scan_alone boolean, forms array<struct<kind:string,form:array<string>>>",
    )
    terms, glossary = tm.merged(records)
    found = tm.bilingual(tm.source_terms(docs, "sw", terms), tm.rendering_hits(docs, "tw", glossary), terms, glossary)
    assert {(r["doc_id"], r["term_id"]): r["status"] for r in found.collect()} == {(1, "s t"): "APPROVED", (2, "s t"): "VARIANT", (3, "s t"): "MISSING", (4, "u"): "VARIANT", (5, "w"): "NOT_IN_GLOSSARY"}
    assert [r["surface"] for r in tm.clarity_entries(terms, glossary).collect()] == []


def test_citation_forms(spark):
    text = "(Quran 2:255) then [an-Nahl 16:120-7], (Bukhari 1:23); سورة البقرة: ٢٥٥ and الکہف18:28 or (200:1) (3:4)"
    rows = ct.citations(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r["chapter"], r["verse"], r["last"]) for r in rows] == [(2, 255, 255), (16, 120, 127), (18, 28, 28), (3, 4, 4)]
    assert all(str(r["chapter"]) in text[r["start"] : r["end"]] for r in rows)


def test_nearest_by_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda n: [(rng.randint(0, 2), i, a := rng.randint(0, 90), a + rng.randint(0, 4)) for i in range(n)]
    left, right = make(40), make(60)
    frames = [spark.createDataFrame(x, f"k int, {name} long, start long, end long") for x, name in ((left, "left_id"), (right, "right_id"))]
    for reach in (0, 2, 10):
        want = {}
        for k, i, a, b in left:
            each = [((0, a - y, j) if y <= a else (1, x - b, j)) for q, j, x, y in right if q == k and (0 <= a - y <= reach or 0 <= x - b <= reach)]
            if each:
                want[k, i] = min(each)
        got = {(r["k"], r["left_id"]): (int(r["side"] == "after"), r["distance"], r["right_id"]) for r in ct.nearest(*frames, "k", reach).collect()}
        assert got == want


def test_sentences_and_regions(spark):
    text = "Dr. Who came. “One. Two.” A. B. left! «open\n\nNext"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    spans = pl.sentence_spans(docs).orderBy("doc_id", "nth").collect()
    assert [text[r["start"] : r["end"]] for r in spans] == ["Dr. Who came.", "“One.", "Two.” A. B. left!", "«open\n\nNext"]
    assert [text[r["start"] : r["end"]] for r in pl.quoted_characters(docs).orderBy("start").collect()] == ["“One. Two.”", "«open"]


def test_best_window_and_editions(spark):
    q, a = "b c d e", "x a b c d e f g h i"
    want = max(sm.similarity(q, " ".join(a.split()[i : i + k])) for k in range(2, 7) for i in range(10 - k + 1))
    got = spark.createDataFrame([(q, a), ("", "x"), (None, None)], "q string, a string").select(pl.best_window(F.col("q"), F.col("a")).alias("s")).collect()
    assert [r["s"] for r in got] == [want, 0.0, 0.0]


def test_pruning_changes_nothing(spark):
    """The best rendering with bounds is that of the full comparison."""
    from tests.conftest import DATA
    from textloom.plans.catalogue import QUERIES

    d = str(DATA / "sf0.01")
    full = {(r["doc_id"], r["item_id"]): (r["edition"], r["score"]) for r in QUERIES["sim_exact"](spark, d).where("place = 1").collect()}
    assert full == {(r["doc_id"], r["item_id"]): (r["edition"], r["score"]) for r in QUERIES["best_renderings"](spark, d).collect()}


def test_a_run_of_five_words_is_found(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e z a b c d e"), (2, None), (3, "a b c")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "q a b c d e r")], "item_id long, text string")
    assert sorted((r["start"], r["end"]) for r in ps.run_spans(docs, passages).collect()) == [(2, 7), (8, 13)]


def test_only_documents_with_a_run_are_read_on(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e z"), (2, None), (3, "a b c"), (None, "b c d e"), (5, "a b c x d e")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "q a b c d e r")], "item_id long, text string")
    assert {r["doc_id"] for r in ps.sharing(docs, passages, 4).collect()} == {1, None}


def test_ladder_finds_what_single_sizes_find(spark):
    import random

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice([f"w{i}" for i in range(60)]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(n)) for i, n in enumerate((0, 3, 8, 37, 90))], "doc_id long, text string")
    post = spark.createDataFrame([(f"w{i}", j, (i * 7 + j) % 5 + 0.5) for i in range(60) for j in range(12) if (i + j) % 3 == 0], "token string, item_id long, weight double")
    got = ps.lexical_ladder(ps.words_of(docs, "doc_id"), post, (5, 8, 2)).select("doc_id", "start.start", "start.size", "item_id", "score", "place").collect()
    want = [(r["doc_id"], r["start"], n, r["item_id"], r["score"], r["place"]) for n in (5, 8, 2) for r in ps.lexical_top(ps.sliding_windows(docs, n, max(1, n // 3)), post).collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_do_not_change_a_walk():
    import random

    from textloom.operators import detect as dt

    rng = random.Random(3)
    words = [rng.choice("alpha beta gamma delta eta theta iota kappa mu nu xi rho".split()) for _ in range(60)]
    for n in (6, 12, 40):
        approved = " ".join(words[10 : 10 + n])
        like = dt.Likeness(words, approved)
        for start in range(0, 40, 3):
            at = (start, start + n)
            while True:  # the walk without bounds
                tried = [(at[0] + a, at[1] + b) for a, b in dt.MOVES]
                inside = [t for t in tried if max(0, start - like.reach) <= t[0] and t[1] <= min(60, start + n + like.reach) and t[1] - t[0] >= 3]
                score = lambda t: sm.similarity(" ".join(words[t[0] : t[1]]), approved)
                at, last = next((t for t in inside if score(t) > score(at) + 1e-9), at), at
                if at == last:
                    break
            assert dt.walk(words, start, start + n, approved, like) == (*at, score(at))


def test_guard_fails_safe(spark):
    sents = spark.createDataFrame([(1, 0, "it is told that a b c d e f is so"), (1, 1, "plain words here")], "doc_id long, nth int, sentence string")
    rend = ps.renderings(spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string"))
    assert {r["nth"]: r["guard"] for r in gt.guarded(sents, rend).collect()} == {0: "SCRIPTURE_TEXT", 1: None}
    assert {r["guard"] for r in gt.guarded(sents, None).collect()} == {"SCRIPTURE_UNCHECKED"}


def test_refused_is_any_reason(spark):
    from textloom.plans.wider import EXAMPLES

    more = ["The father prays in the town and the child was there", "May the peace and mercy of God be upon him today", "Der Mann geht in die Stadt", " "]
    rows = spark.createDataFrame([(x, lang) for x in (*[e[0] for e in EXAMPLES], *more, None) for lang in ("en", "de", None)], "sentence string, lang string")
    s, lang = F.col("sentence"), F.col("lang")
    told = rows.select(gt.refused(s, lang).alias("refused"), (F.size(F.concat(gt.reasons(s), gt.language_reasons(s, lang))) > 0).alias("any")).collect()
    assert all(r["refused"] == r["any"] for r in told) and len({r["any"] for r in told}) == 2


def test_adaptation_keeps_words_and_refused_sentences(spark):
    long = "the market sold bread and olives to the people of the town near the river every day, and the carts came from the hills in the early morning"
    docs = spark.createDataFrame([(1, f"{long}. You must not go there today.", "en")], "doc_id long, text string, lang string")
    rows = {r["nth"]: r for r in gt.adapted(docs, None).collect()}
    assert {r["status"] for r in rows.values()} == {"REFUSED"} and all(r["adapted"] == r["sentence"] for r in rows.values())
    rend = ps.renderings(spark.createDataFrame([(1, "nothing of the kind at all")], "item_id long, text string"))
    rows = {r["nth"]: r for r in gt.adapted(docs, rend).collect()}
    assert rows[0]["status"] == "ADAPTED" and rows[1]["status"] == "REFUSED"
    told = gt.adapted_documents(gt.adapted(docs, rend)).first()
    assert (told["sentences"], told["refused"], told["adapted"], told["refusal_rate"]) == (2, 1, 1, 0.5)


def test_sentences_are_trimmed_of_spaces_only(spark):
    import duckdb

    from textloom.plans.catalogue import ORACLES

    docs = spark.createDataFrame([(1, " 0 of 10.  1st of 11. 2 of 22\n33 and 3 \n\n 4.\x0b5. 6"), (2, "0"), (3, " "), (4, None)], "doc_id long, text string")
    got = [tuple(r) for r in lg.sentences(docs).orderBy("doc_id", "nth").collect()]
    assert got == [(1, 0, "0 of 10."), (1, 1, "1st of 11."), (1, 2, "2 of 22"), (1, 3, "33 and 3"), (1, 4, "4.\x0b5."), (1, 5, "6"), (2, 0, "0")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in docs.collect()])
    assert sorted(con.sql(ORACLES["split_sentences"]).fetchall()) == got


def test_decisions_and_reports(spark, tmp_path):
    new = spark.createDataFrame([(1, "replace", "R", None, None), (1, "approve", " ", None, None), (9, "approve", "R", None, None), (1, "replace", "R", "n", "text")], "item long, decision string, reviewer string, note string, replacement string")
    codes = [r["code"] for r in ld.checked_decisions(new, spark.createDataFrame([(1,)], "item long"), "item").collect()]
    assert sorted(codes) == ["ITEM_NOT_FOUND", "OK", "REPLACEMENT_REQUIRED", "REVIEWER_REQUIRED"]
    df = spark.createDataFrame([(1, "a|b\nc <x>"), (2, None)], "id int, t string")
    assert sorted(r["value"] for r in io.markdown_rows(df).collect()) == ["| 1 | a\\|b c <x> |", "| 2 |  |"]
    io.export_report(df, str(tmp_path / "r"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "r" / "rows"), lineSep="</tr>\n").collect())[0].startswith("<tr><td>1</td><td>a|b")
    (tmp_path / "x.jsonl").write_text(json.dumps({"a": 1}) + "\n")
    assert io.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").first()["a"] == 1
    (tmp_path / "m.json").write_text(json.dumps({"name": "n", "size": 2}))
    assert io.manifest(spark, str(tmp_path / "m.json"), "name string, size int").first()["size"] == 2
    pins = spark.createDataFrame([("m.json", "0" * 64), ("gone", "0" * 64)], "name string, sha256 string")
    assert {r["name"]: r["status"] for r in io.pinned_files(spark, str(tmp_path / "m.json"), pins).collect()} == {"m.json": "changed", "gone": "missing"}
    assert io.vectors(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", 2).count() == 1
    assert io.public(df, ("t",)).columns == ["id"]
