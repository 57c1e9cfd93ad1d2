"""Further queries: whole-document checks, text surgery, and evaluation of the attribution itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx
from ..operators import detect as dt
from ..operators import evaluation as ev
from ..operators import ledger as ld
from ..operators import passages as ps
from ..operators import rewrite as rw
from ..sources.tables import table
from . import catalogue as c
from .catalogue import query

# --- whole documents -----------------------------------------------------------------------------------------------------


@query()
def refined_spans(s, d):
    return dt.spans(table(s, d, "documents"), c._rend(s, d))


@query()
def check_documents(s, d):
    return dt.check(table(s, d, "documents"), c._rend(s, d))


@query()
def check_verdicts(s, d):
    return dt.control(table(s, d, "documents"), c._rend(s, d))


# --- surgery -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, true AS same FROM documents")
def freeze_roundtrip(s, d):
    """Freezing the first words of each text and putting them back gives the text."""
    docs = table(s, d, "documents")
    frozen = docs.select("doc_id", "text", rw.freeze(F.col("text"), F.slice(tx.tokens(F.col("text")), 1, 3)).alias("f"))
    return frozen.select("doc_id", (rw.thaw(F.col("f.text"), F.col("f.held")) == F.col("text")).alias("same"))


@query()
def split_long_sentences(s, d):
    from ..operators.language import sentences

    rows = sentences(table(s, d, "documents")).where(F.size(F.split("sentence", " ")) > 22)
    return rows.select("doc_id", "nth", rw.shorter_sentences(F.col("sentence")).alias("sentence"))


@query()
def quote_regions(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(rw.quoted_regions(F.col("text"))).alias("r")).select("doc_id", "r.start", "r.end")


@query()
def sentence_chunks(s, d):
    return rw.chunks(table(s, d, "documents"))


@query()
def budget_plan(s, d):
    rows = rw.chunks(table(s, d, "documents")).withColumn("size", F.col("end") - F.col("start")).withColumn("priority", F.pmod(F.xxhash64("doc_id", "start", "end"), F.lit(1000)))
    return rw.within_budget(rows, "doc_id", "priority", "size", 1024)


@query(r"""WITH w AS (SELECT item_id, text || ' (Book 2:3) end' AS text, length(text) + 1 AS a, length(text) + 11 AS b FROM benchmark), p AS (SELECT item_id, a, b, unnest(regexp_extract_all(text, '\S+')) AS x, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS nth FROM w)
SELECT item_id, CAST(nth AS BIGINT) AS nth FROM (SELECT *, max(nth) OVER (PARTITION BY item_id) AS last FROM p) WHERE nth IN (last - 1, last - 2)""")
def citation_word_ranges(s, d):
    """Words within a citation put behind each passage."""
    p = table(s, d, "benchmark")
    cited = p.select("item_id", F.concat("text", F.lit(" (Book 2:3) end")).alias("text"))
    ranges = p.select("item_id", (F.length("text") + 1).alias("from"), (F.length("text") + 11).alias("to"))
    return rw.words_at(cited, ranges, "item_id")


# --- evaluation of the attribution ---------------------------------------------------------------------------------------

_SELF = f"{c._R}, {c._RW}, sf AS (SELECT a.item_id, a.edition AS true_edition, b.edition, {c._JACCARD('a.w', 'b.w')} AS score FROM rw a JOIN rw b USING (item_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, true_edition ORDER BY round(score, 6) DESC, edition) AS place FROM sf)"


def _self(s, d) -> DataFrame:
    """Every rendering fed back: its score with each rendering of its passage."""
    r = c._rend(s, d).select("item_id", "edition", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    a = r.select("item_id", F.col("edition").alias("true_edition"), F.col("w").alias("a"))
    rows = a.join(r, "item_id").select("item_id", "true_edition", "edition", F.round(sm.jaccard(F.col("a"), F.col("w")), 6).alias("score"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "true_edition").orderBy(F.desc("score"), "edition")).cast("long"))


@query(f"WITH {_SELF} SELECT true_edition, count(*) AS n, count(*) FILTER (score < {sm.NEAR}) AS false_alarms FROM rk WHERE place = 1 GROUP BY true_edition")
def control_false_alarms(s, d):
    return _self(s, d).where("place = 1").groupBy("true_edition").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") < sm.NEAR, 1)).alias("false_alarms"))


@query(f"WITH {_SELF} SELECT true_edition, edition AS predicted, count(*) AS n FROM rk WHERE place = 1 GROUP BY ALL")
def identity_confusion(s, d):
    return _self(s, d).where("place = 1").groupBy("true_edition", F.col("edition").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SELF} SELECT true_edition, edition, round(avg(round(score, 6)), 6) AS mean, round(median(round(score, 6)), 6) AS mid, max(round(score, 6)) AS most, count(*) FILTER (score >= {sm.SAME}) AS same FROM rk WHERE true_edition < edition GROUP BY ALL")
def edition_separation(s, d):
    rows = _self(s, d).where("true_edition < edition")
    return rows.groupBy("true_edition", "edition").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.median("score"), 6).alias("mid"), F.max("score").alias("most"), F.count(F.when(F.col("score") >= sm.SAME, 1)).alias("same"))


@query(f"""WITH {c._R}, {c._RW}, n AS (SELECT count(*) AS n FROM benchmark), x AS (SELECT a.item_id, a.edition, max({c._JACCARD('a.w', 'b.w')}) AS score FROM rw a, n JOIN rw b ON b.item_id = (a.item_id + 1) % n.n GROUP BY ALL)
SELECT edition, count(*) AS n, count(*) FILTER (score < {sm.NEAR}) AS rejected FROM x GROUP BY edition""")
def wrong_passage_rejection(s, d):
    """Each rendering against those of the next passage: all must be rejected."""
    r = c._rend(s, d).select("item_id", "edition", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    n = table(s, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    a = r.crossJoin(F.broadcast(n)).select("item_id", "edition", F.col("w").alias("a"), ((F.col("item_id") + 1) % F.col("n")).alias("next"))  # n is one row
    x = a.join(r.select(F.col("item_id").alias("next"), "w"), "next").groupBy("item_id", "edition").agg(F.max(sm.jaccard(F.col("a"), F.col("w"))).alias("score"))
    return x.groupBy("edition").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") < sm.NEAR, 1)).alias("rejected"))


@query(f"""WITH {c._R}, k AS (SELECT item_id, edition, {tx.tokens_sql("regexp_split_to_array(text, '_{4,}')[1]")} AS w FROM rend WHERE edition = 2), o AS (SELECT item_id, {tx.tokens_sql('text')} AS w FROM benchmark)
SELECT k.item_id, round({c._JACCARD('k.w', 'o.w')}, 6) AS score FROM k JOIN o USING (item_id)""")
def footnoted_editions(s, d):
    """Renderings with a footnote, cut at its rule, against the plain text."""
    k = c._rend(s, d).where("edition = 2").select("item_id", F.array_distinct(tx.tokens(tx.first_part(F.col("text")))).alias("k"))
    o = table(s, d, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("o"))
    return k.join(o, "item_id").select("item_id", F.round(sm.jaccard(F.col("k"), F.col("o")), 6).alias("score"))


@query("""WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n, sha256(text) AS digest FROM t ORDER BY n DESC, conv_id LIMIT 12""")
def documents_regrouped(s, d):
    """The twelve conversations with the most turns, put together: a report of that length."""
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return rows.select("conv_id", "n", F.sha2("text", 256).alias("digest")).orderBy(F.desc("n"), "conv_id").limit(12)


@query("""SELECT o_orderpriority AS metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, coalesce(stddev_samp(v), 0) > 0 AND NOT regexp_matches(o_orderpriority, 'LOW') AS drifting
FROM (SELECT o_orderpriority, o_orderkey % 3 AS run, count(*) AS v FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def drift_detection(s, d):
    """Metrics that differ between runs though they should not; those named LOW may."""
    v = table(s, d, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 3).alias("run")).agg(F.count(F.lit(1)).alias("v"))
    rows = ev.summary(v, "o_orderpriority", "v")
    return rows.select(F.col("o_orderpriority").alias("metric"), "mean", "sd", ((F.col("sd") > 0) & ~F.col("o_orderpriority").rlike("LOW")).alias("drifting"))


@query("SELECT item_id, substr(sha256('suite|7|' || sha256(text)), 1, 12) AS key FROM benchmark")
def cache_key(s, d):
    return table(s, d, "benchmark").select("item_id", F.substring(F.sha2(F.concat(F.lit("suite|7|"), F.sha2("text", 256)), 256), 1, 12).alias("key"))


@query("""WITH m AS (SELECT item_id // 10 + 1 AS chapter, max(item_id % 10 + 1) AS last FROM benchmark GROUP BY ALL), o AS (SELECT chapter, coalesce(sum(last) OVER (ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT item_id, CAST(before + item_id % 10 + 1 AS BIGINT) AS global_id FROM benchmark JOIN o ON chapter = item_id // 10 + 1""")
def global_passage_id(s, d):
    """Running numbers of passages, from the last number of each earlier chapter."""
    p = table(s, d, "benchmark").select("item_id", F.expr("item_id div 10 + 1").alias("chapter"), F.expr("item_id % 10 + 1").alias("verse"))
    last = p.groupBy("chapter").agg(F.max("verse").alias("last"))  # a row a chapter
    before = last.select("chapter", F.coalesce(F.sum("last").over(Window.orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return p.join(before, "chapter").select("item_id", (F.col("before") + F.col("verse")).alias("global_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(s, d):
    """A ledger's JSON payload written and read again."""
    rows = table(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")
    return ld.payload(rows, "k").select("event_id", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("""SELECT doc_id, array_to_string(w[1:20], ' ') AS start FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) BETWEEN 8 AND 90 AND ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || 'held'), 1, 4))::BIGINT % 2 = 0""")
def held_out_slices(s, d):
    """Short texts of one half, by a seeded hash; their first twenty words."""
    half = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("held"))), 1, 4), 16, 10).cast("long") % 2 == 0
    w = F.split("text", " ")
    return table(s, d, "documents").where(half & F.size(w).between(8, 90)).select("doc_id", F.array_join(F.slice(w, 1, 20), " ").alias("start"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT *, CASE WHEN length(line) < 60 THEN line END AS head FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS i, sha256(line) AS line, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS theme FROM h""")
def lines_with_theme(s, d):
    """Each line with the last short line before it, as a listing's headings go with what follows."""
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    theme = F.last(F.when(F.length("line") < 60, F.col("line")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "i", F.sha2("line", 256).alias("line"), theme.alias("theme"))


@query(f"""{c._pairs(ps.SMALL_RUN)}, {c._ISLANDS}, {c._HITS}, m0 AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hits),
m1 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m0), m AS (SELECT doc_id, min(start) AS a, max("end") AS b FROM m1 GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS "end" FROM m UNION ALL SELECT doc_id, max(b), any_value(len(w)) FROM m JOIN dw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM gap WHERE "end" > start QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "end" - start DESC, start) = 1""")
def free_regions(s, d):
    return dt.free_regions(table(s, d, "documents"), c._run_spans(s, d))


@query()
def best_excerpts(s, d):
    """The first twenty words of each passage, placed in its renderings."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("key"), "item_id", F.slice(tx.tokens(F.col("text")), 1, 20).alias("quote"))
    return dt.excerpts(q, c._rend(s, d))


@query(f"WITH {c._DW}, {c._PW}, {c._runs(ps.RUN)}, q AS (SELECT DISTINCT doc_id FROM sh{ps.RUN}) SELECT lang, count(*) AS n, CAST(sum(CASE WHEN q.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(100.0 * sum(CASE WHEN q.doc_id IS NOT NULL THEN 1 ELSE 0 END) / count(*), 4) AS rate FROM documents d LEFT JOIN q USING (doc_id) GROUP BY ROLLUP (lang)")
def detection_rollup(s, d):
    """Share of documents that quote a passage, by language and in all."""
    docs = table(s, d, "documents")
    hit = ps.shared_runs(docs, table(s, d, "benchmark"), ps.RUN).select("doc_id").distinct().withColumn("hit", F.lit(True))
    return ev.rates(docs.join(hit, "doc_id", "left"), "lang", F.coalesce("hit", F.lit(False)))


@query(f"""WITH {c._PARA}, {c._PW}, dw AS (SELECT page_id * 100000 + nth AS doc_id, 'x' AS lang, {tx.tokens_sql('text')} AS w FROM para WHERE length(text) >= 180 AND kind = 'prose'), {c._runs(ps.RUN)}
SELECT count(*) AS paragraphs, count(DISTINCT s.doc_id) AS with_finding FROM dw LEFT JOIN (SELECT DISTINCT doc_id FROM sh{ps.RUN}) s USING (doc_id)""")
def prose_findings(s, d):
    """Paragraphs of prose in pages, and those in which something is found."""
    p = c._paras(s, d).where((F.length("text") >= 180) & (F.col("kind") == "prose")).select((F.col("page_id") * 100000 + F.col("nth")).alias("doc_id"), "text")
    hit = ps.shared_runs(p, table(s, d, "benchmark"), ps.RUN).select("doc_id").distinct().withColumn("hit", F.lit(1))
    return p.join(hit, "doc_id", "left").agg(F.count(F.lit(1)).alias("paragraphs"), F.count("hit").alias("with_finding"))


@query(f"WITH {c._DW}, {c._PW}, {c._runs(ps.SMALL_RUN)}, {c._runs(ps.RUN)} SELECT count(*) AS seeds, count(b.doc_id) AS survive FROM sh{ps.SMALL_RUN} a LEFT JOIN sh{ps.RUN} b USING (doc_id, item_id)")
def tier_survival(s, d):
    """Pairs that a short run proposes, and those that a long one confirms."""
    docs, p = table(s, d, "documents"), table(s, d, "benchmark")
    long = ps.shared_runs(docs, p, ps.RUN).select("doc_id", "item_id", F.lit(1).alias("ok"))
    return ps.shared_runs(docs, p, ps.SMALL_RUN).join(long, ["doc_id", "item_id"], "left").agg(F.count(F.lit(1)).alias("seeds"), F.count("ok").alias("survive"))


@query("""WITH p AS (SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0), m AS (SELECT item_id + 1000 AS item_id, array_to_string(string_split(text, ' ')[3:9], ' ') AS text FROM benchmark)
SELECT item_id FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(' ' || p.text || ' ', ' ' || m.text || ' '))""")
def alias_suppression(s, d):
    """Pieces of all passages against the even ones: what lies within one of these is not missing."""
    w = table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    pieces = w.select((F.col("item_id") + 1000).alias("item_id"), F.slice("words", 3, 7).alias("words"))
    return dt.not_aliases(pieces, w.where("item_id % 2 = 0")).select("item_id")
