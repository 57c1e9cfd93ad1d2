import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from textloom.functions import similarity as sm
from textloom.functions import text as tx
from textloom.operators import gate as gt
from textloom.operators import language as lg
from textloom.operators import ledger as ld
from textloom.operators import passages as ps
from textloom.plans import wider
from textloom.sources import tables as io
from textloom.streaming import events as st


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first()["y"]


def test_normalize(spark):
    for text, form in (("12. He said[3] (so) : YES!", "he said yes"), (None, ""), ("", ""), ("a_b  cé", "a_b cé"), ("أَبة", "ابه")):
        assert one(spark, text, tx.normalize(F.col("x"))) == form


def test_compatible_characters(spark):
    import unicodedata

    for text in ("ﬁne ＡＢＣ１２３ … ﷲ", "plain é", "ﻛﺘﺎﺏ", "①②"):
        assert one(spark, text, tx.compatible(F.col("x"))) == unicodedata.normalize("NFKC", text)
    assert one(spark, "Ｃafé ﬁne", tx.normalize(F.col("x"))) == "café fine"
    assert one(spark, "Qur’ān Ḥajj é", tx.strict_tokens(F.col("x"))) == ["qur", "an", "hajj", "e"]


def test_strict_tokens(spark):
    assert one(spark, "\"36. It is (never) so?", tx.strict_tokens(F.col("x"))) == ["it", "is", "never", "so", "qmark"]
    assert one(spark, "It is (never) so", tx.strict_tokens(F.col("x"), True)) == ["it", "is", "so"]
    assert one(spark, None, tx.strict_tokens(F.col("x"))) == []


def test_unicode_kernels(spark):
    assert one(spark, "ﬁ①", tx.nfkc(F.col("x"))) == "fi1"
    assert one(spark, "Allâh", tx.without_accents(F.col("x"))) == "Allah"
    assert one(spark, None, tx.nfkc(F.col("x"))) is None


def test_short_forms(spark):
    assert one(spark, "one two three", tx.excerpt(F.col("x"), 2)) == "one two …"
    assert one(spark, "text ____ note", tx.first_part(F.col("x"))) == "text "
    assert one(spark, "<a>&\"", tx.escape_markup(F.col("x"))) == "&lt;a&gt;&amp;&quot;"
    assert one(spark, "٢५", tx.ascii_digits(F.col("x"))) == "25"


def test_similarity_and_bounds(spark):
    pairs = [("the cat sat", "the cat sat"), ("a b c d", "d c b a"), ("", "x"), ("aa", "bb"), ("the quick brown fox", "the quick red fox")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    jac = sm.jaccard(F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " ")))
    got = rows.select("a", "b", sm.sim(F.col("a"), F.col("b")).alias("s"), sm.length_bound(F.col("a"), F.col("b"), jac).alias("l"), sm.multiset_bound(F.col("a"), F.col("b"), jac).alias("m")).collect()
    for r in got:
        want = sm.similarity(r["a"], r["b"])
        assert abs(r["s"] - want) < 1e-12 and r["s"] <= r["m"] + 1e-12 <= r["l"] + 2e-12
    assert got[0]["s"] == 1.0 and got[2]["s"] == 0.0


def test_word_diff(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"])], "p array<string>, q array<string>")
    ops = rows.select(sm.word_diff(F.col("p"), F.col("q")).alias("o")).first()["o"]
    assert [(o["op"], o["published"], o["approved"]) for o in ops] == [("equal", "a", "a"), ("replace", "b", "x"), ("equal", "c", "c")]


def test_verbatim(spark):
    def flag(published, approved):
        rows = spark.createDataFrame([(published, approved)], "p string, a string")
        return rows.select(sm.verbatim(tx.strict_tokens(F.col("p")), tx.strict_tokens(F.col("a")), tx.strict_tokens(F.col("a"), True)).alias("v")).first()["v"]

    assert flag("He forgives, always.", "he forgives always") == "whole"
    assert flag("he forgives", "He (surely) forgives") == "whole"
    assert flag("he (never) forgives", "he forgives") is None
    assert flag("forgives al", "he forgives always") is None
    assert flag("forgives always", "he forgives always") == "excerpt"
    assert flag("", "x") is None


def test_longest_run_is_difflibs(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y a b c d e f"), (2, "q r s t")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    got = ps.longest_run(docs, passages, 4).collect()
    m = SequenceMatcher(None, "x a b c d e y a b c d e f".split(), "a b c d e f g".split(), autojunk=False).find_longest_match()
    assert [(r["doc_id"], r["run"], r["doc_start"], r["passage_start"]) for r in got] == [(1, m.size, m.a, m.b)]


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 8, 9), (2, 0, 1)], "doc_id long, start long, end long")
    got = lambda gap: sorted((r["doc_id"], r["start"], r["end"]) for r in ps.merged_intervals(rows, ["doc_id"], gap).collect())
    assert got(0) == [(1, 0, 6), (1, 8, 9), (2, 0, 1)]
    assert got(2) == [(1, 0, 9), (2, 0, 1)]


def test_greedy_overlaps(spark):
    rows = spark.createDataFrame([(1, 1, 0, 5, 0.9), (1, 2, 4, 9, 0.8), (1, 3, 5, 7, 0.7)], "doc_id long, item_id long, start long, end long, score double")
    assert sorted(r["item_id"] for r in ps.resolve_overlaps(rows).collect()) == [1, 3]


def test_references(spark):
    docs = spark.createDataFrame([(1, "see (Name 2:155-7) and [3:4], not (200:1) or 5:6")], "doc_id long, text string")
    assert [(r["chapter"], r["first"], r["last"]) for r in lg.printed_references(docs).orderBy("nth").collect()] == [(2, 155, 157), (3, 4, 4)]


def test_gate(spark):
    reasons = lambda t: one(spark, t, gt.reasons(F.col("x")))
    assert reasons("You must never do this") == ["NORMATIVE"]
    assert reasons("Two words") == ["TOO_SHORT"]
    assert reasons("The sky was blue that day") == []
    for sentence, want in wider.EXAMPLES:
        assert ",".join(reasons(sentence)) == want, sentence
    assert one(spark, "Il pleut", gt.language_reasons(F.col("x"), F.lit("fr-FR"))) == ["LANGUAGE_UNSCREENED"]
    assert one(spark, "Rain falls", gt.language_reasons(F.col("x"), F.lit(None).cast("string"))) == []


def test_ledger(spark):
    events = spark.createDataFrame([(1, 7, "click"), (2, 7, "error"), (3, 8, "other")], "event_id long, user_id long, event_type string")
    assert {r["user_id"]: r["status"] for r in ld.latest_status(events).collect()} == {7: "escalate", 8: "pending"}
    queue = spark.createDataFrame([(1, 1)], "check_id long, finding long")
    new = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "check_id long, finding long")
    assert [tuple(r) for r in ld.enqueued(queue, new, ["check_id", "finding"]).collect()] == [(1, 2)]
    assert json.loads(ld.payload(events, "event_id", "event_type").orderBy("event_id").first()["payload"]) == {"event_id": 1, "event_type": "click"}


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"book_id": 1, "language": "en", "passages": [{"chapter": 1, "verse": 1, "text": "a"}, {"chapter": 1, "verse": 2, "text": ""}]}))
    assert [r["text"] for r in io.edition_dumps(spark, str(tmp_path / "d.json")).collect()] == ["a"]
    (tmp_path / "p.txt").write_text("# c\n\n1|1|x\n1|b|y\n1|2|z\n1|2\n")
    rows = io.delimited_passages(spark, str(tmp_path / "p.txt"))
    assert [tuple(r) for r in rows.collect()] == [(1, 1, "x"), (1, 2, "z")]
    assert io.incomplete(rows, rows.where("verse = 1"), ["chapter", "verse"]).collect()[0]["only"] == "left"
    old, new = (spark.createDataFrame(r, "k long, t long, v string") for r in ([(1, 1, "a"), (2, 1, "b")], [(1, 1, "c")]))
    assert sorted(r["v"] for r in io.upserted(old, new, ["k"], "t").collect()) == ["b", "c"]


def test_streams_end_as_batches(spark, tmp_path):
    from tests.conftest import DATA

    path = f"{DATA}/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = io.stream(spark, path, batch.schema)
    got = st.drained(spark, st.status(stream), "update", f"file://{tmp_path}/s", ["user_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.status(batch).collect()))


def test_walk_finds_the_edges():
    from textloom.operators.detect import walk

    quote = "in the beginning there was a word and the word was good".split()
    words = [*"some prose of the author before it".split(), *quote, *"and prose that follows after".split()]
    a, b, score = walk(words, 10, 16, " ".join(quote))
    assert words[a:b] == quote and score == 1.0


def test_an_altered_copy_beside_a_verbatim_one_is_found(spark):
    from textloom.operators import detect

    passage = "the quick river ran below seven old bridges while nine tired fishermen sang of winter storms and empty nets"
    altered = passage.replace("seven old", "many new").replace("winter", "summer")
    between = " ".join(f"prose{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{passage} {between} {altered}"), (2, f"{between} {passage}")], "doc_id long, text string")
    others = [(k, " ".join(f"other{k}x{i}" for i in range(20)), 0) for k in range(8, 40)]
    rend = spark.createDataFrame([(7, passage, 0), *others], "item_id long, text string, edition int")
    found = sorted((r["doc_id"], r["start"], r["end"], r["state"]) for r in detect.check(docs, rend).collect())
    assert found == [(1, 0, 19, "MATCH"), (1, 59, 78, "NEAR"), (2, 40, 59, "MATCH")]
    assert {r["doc_id"]: r["verdict"] for r in detect.control(docs, rend).collect()} == {1: "REFER", 2: "CLEAR"}


def test_freeze_and_thaw():
    from textloom.operators.rewrite import mask, split_long, unmask

    masked, held = mask("the quote “a b” and a b", ["a b", "“a b”"])
    assert held == ["“a b”", "a b"] and "a b" not in masked
    assert unmask(masked, held) == "the quote “a b” and a b"
    assert unmask(masked.replace("\ue000", "", 1), held) is None
    long = "one two three four five six seven eight, and nine ten eleven twelve thirteen fourteen"
    assert split_long(long, 10, 4) == "one two three four five six seven eight. And nine ten eleven twelve thirteen fourteen"
    assert split_long("if " + long, 10, 4) == "if " + long


def test_words_in_ranges(spark):
    from textloom.operators.rewrite import words_at

    docs = spark.createDataFrame([(1, "  one two  three")], "doc_id long, text string")
    ranges = spark.createDataFrame([(1, 3, 7)], "doc_id long, from int, to int")
    assert [r["nth"] for r in words_at(docs, ranges).collect()] == [1]
