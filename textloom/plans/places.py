"""Queries of placement, sentences and quotations by characters, publishers' pages, and the ledger's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger as ld
from ..operators import pages as pg
from ..operators import passages as ps
from ..operators import placement as pl
from ..sources import tables as io
from ..sources.tables import table
from . import catalogue as c
from .catalogue import query

# --- placement -----------------------------------------------------------------------------------------------------------

_PASSAGES = f"pw AS (SELECT item_id, {tx.tokens_sql('text')} AS w FROM benchmark)"


def _words(s, d) -> DataFrame:
    return ps.words_of(table(s, d, "benchmark"), "item_id").select("item_id", F.col("w").alias("pw"))


@query(f"{c._PAIRS}, st AS (SELECT doc_id, item_id, dw, pw, unnest(range(0, greatest(0, len(dw) - len(pw)) + 1)) AS start FROM pairs WHERE len(dw) > 0), sc AS (SELECT doc_id, item_id, start, least(start + len(pw), len(dw)) AS stop, round({c._JACCARD('dw[start + 1:start + len(pw)]', 'pw')}, 6) AS score FROM st)\nSELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS \"end\", score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, start) = 1")
def known_placements(s, d):
    """Passages known to be in a document, at the window most like them."""
    return pl.known_places(ps.word_pairs(table(s, d, "documents"), table(s, d, "benchmark")))


# a document for each passage: words of it, a citation of it, words of the next passage, a citation of that after, words of that
_BOOK = f"""{_PASSAGES}, n AS (SELECT count(*) AS n FROM benchmark), bk AS (SELECT p.item_id AS doc_id, list_filter(p.w, lambda x, i: i % 9 <> 0) AS a, q.w AS b, r.w AS e, r.item_id AS third FROM pw p, n JOIN pw q ON q.item_id = (p.item_id + 1) % n.n JOIN pw r ON r.item_id = (p.item_id + 2) % n.n),
dw AS (SELECT doc_id, a || ['cite'] || b || ['cite'] || e AS w, a, b, e, third FROM bk), ct AS (SELECT doc_id, 0 AS cite_id, doc_id AS item_id, len(a) AS start, len(a) + 1 AS stop FROM dw UNION ALL SELECT doc_id, 1, third, len(a) + 1 + len(b), len(a) + 2 + len(b) FROM dw),
rg AS (SELECT ct.*, coalesce(lag(stop) OVER o, 0) AS lo, coalesce(lead(start) OVER o, len(dw.w)) AS hi, dw.w AS w, pw.w AS pw, least({pl.REACH}, floor(1.5 * len(pw.w)) + 4) AS reach FROM ct JOIN dw USING (doc_id) JOIN pw USING (item_id) WINDOW o AS (PARTITION BY doc_id ORDER BY start, cite_id)),
sd AS (SELECT doc_id, cite_id, item_id, pw, 'before' AS side, CAST(greatest(lo, start - reach) AS BIGINT) AS f, CAST(start AS BIGINT) AS t, w FROM rg UNION ALL SELECT doc_id, cite_id, item_id, pw, 'after', stop, CAST(least(hi, stop + reach) AS BIGINT), w FROM rg),
x AS (SELECT *, w[f + 1:t] AS cut FROM sd WHERE t > f), v AS (SELECT doc_id, cite_id, item_id, side, f, pw, cut, unnest(range(len(cut))) AS i, unnest(list_transform(cut, lambda y: CASE WHEN list_contains(pw, y) THEN 1 ELSE -2 END)) AS v FROM x),
s AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, cite_id, side ORDER BY i) AS s FROM v), z AS (SELECT a.*, b.i AS j, a.s - coalesce(b.s, 0) AS m FROM s a LEFT JOIN (SELECT doc_id, cite_id, side, i, s FROM s) b ON a.doc_id = b.doc_id AND a.cite_id = b.cite_id AND a.side = b.side AND b.i < a.i AND b.s < 0),
lo AS (SELECT doc_id, cite_id, side, i, max(m) AS m FROM (SELECT doc_id, cite_id, side, i, m FROM z UNION ALL SELECT doc_id, cite_id, side, i, s FROM s) GROUP BY ALL),
lb AS (SELECT s.doc_id, s.cite_id, s.item_id, s.side, s.f, s.pw, s.cut, s.i AS last, lo.m, s.s - lo.m AS low FROM s JOIN lo USING (doc_id, cite_id, side, i) WHERE lo.m > 0 QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.cite_id, s.side ORDER BY lo.m DESC, s.i) = 1),
fs AS (SELECT lb.*, CASE WHEN low >= 0 THEN 0 ELSE (SELECT min(s.i) + 1 FROM s WHERE s.doc_id = lb.doc_id AND s.cite_id = lb.cite_id AND s.side = lb.side AND s.i < lb.last AND s.s = lb.low) END AS first FROM lb),
cv AS (SELECT *, round(len(list_intersect(list_distinct(cut[first + 1:last + 1]), pw))::DOUBLE / len(list_distinct(pw)), 6) AS coverage FROM fs)"""


@query(f"""WITH {_BOOK} SELECT doc_id, CAST(cite_id AS INTEGER) AS cite_id, item_id, side, CAST(f + first AS BIGINT) AS start, CAST(f + last + 1 AS BIGINT) AS "end", coverage, coverage >= {pl.COVERED} AS certain
FROM cv QUALIFY row_number() OVER (PARTITION BY doc_id, cite_id ORDER BY CASE WHEN side = 'after' THEN coverage - {pl.MARGIN} ELSE coverage + 1e-9 END DESC) = 1""")
def cited_placements(s, d):
    """Passages beside their citations: one behind its quotation, one before it."""
    p = _words(s, d)
    n = table(s, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    at = p.crossJoin(F.broadcast(n)).select(F.col("item_id").alias("doc_id"), F.filter("pw", lambda _, i: (i + 1) % 9 != 0).alias("a"), ((F.col("item_id") + 1) % F.col("n")).alias("x"), ((F.col("item_id") + 2) % F.col("n")).alias("third"))  # n is one row
    rows = at.join(p.select(F.col("item_id").alias("x"), F.col("pw").alias("b")), "x").join(p.select(F.col("item_id").alias("third"), F.col("pw").alias("e")), "third")
    cite = F.array(F.lit("cite"))
    docs = rows.select("doc_id", F.concat("a", cite, "b", cite, "e").alias("w"))
    first = rows.select("doc_id", F.lit(0).alias("cite_id"), F.col("doc_id").alias("item_id"), F.size("a").alias("start"))
    second = rows.select("doc_id", F.lit(1).alias("cite_id"), F.col("third").alias("item_id"), (F.size("a") + 1 + F.size("b")).alias("start"))
    found = pl.cited_places(docs, first.unionByName(second).withColumn("end", F.col("start") + 1), p)
    return found.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@query("SELECT item_id, CAST(2 AS BIGINT) AS start, CAST(len(string_split(text, ' ')) + 2 AS BIGINT) AS \"end\" FROM benchmark")
def snapped_spans(s, d):
    """Spans two words off at either side, moved to the author's marks."""
    p = table(s, d, "benchmark")
    raw = F.concat(F.split(F.lit("He said"), " "), F.split(F.concat(F.lit("“"), "text", F.lit("”.")), " "), F.split(F.lit("Then they left"), " "))
    n = F.size(F.split("text", " "))
    spans = p.select("item_id", raw.alias("raw"), (F.lit(2) + F.expr("item_id % 3")).cast("int").alias("start"), (n + 2 - F.expr("item_id % 2")).cast("int").alias("end"), F.col("text").alias("approved"))
    return pl.snap(spans).select("item_id", "start", "end")


# --- characters ----------------------------------------------------------------------------------------------------------

_QUOTING = "qd AS (SELECT item_id, 'He said to Dr. Who: ' || chr(8220) || text || ' (' || CAST(item_id // 10 + 1 AS VARCHAR) || ':' || CAST(item_id % 10 + 1 AS VARCHAR) || ')' || chr(8221) || ' and left. A. Smith \"stayed here for long' || chr(10) || chr(10) || 'Then ' || text AS t FROM benchmark)"


def _quoting(s, d) -> DataFrame:
    n = lambda e: F.expr(f"CAST({e} AS STRING)")
    text = F.concat(F.lit("He said to Dr. Who: “"), "text", F.lit(" ("), n("item_id div 10 + 1"), F.lit(":"), n("item_id % 10 + 1"), F.lit(")” and left. A. Smith \"stayed here for long\n\nThen "), "text")
    return table(s, d, "benchmark").select(F.col("item_id"), text.alias("text"))


_SPANS = rf"""{_QUOTING}, pc AS (SELECT item_id, t, unnest(regexp_extract_all(t, '[.!?؟۔。।॥]\s+')) AS m, unnest(range(len(regexp_extract_all(t, '[.!?؟۔。।॥]\s+')))) AS nth, unnest(regexp_split_to_array(t, '[.!?؟۔。।॥]\s+')[:len(regexp_extract_all(t, '[.!?؟۔。।॥]\s+'))]) AS p FROM qd),
ce AS (SELECT item_id, t, nth, CAST(sum(length(p) + length(m)) OVER (PARTITION BY item_id ORDER BY nth) AS BIGINT) AS stop, length(m) AS k FROM pc),
cu AS (SELECT item_id, t, stop - k + 1 AS a, stop AS b FROM ce WHERE stop < length(t)), st AS (SELECT item_id, t, 0 AS start FROM qd UNION ALL SELECT item_id, t, b FROM cu),
pi AS (SELECT item_id, t, start, coalesce((SELECT min(cu.a) FROM cu WHERE cu.item_id = st.item_id AND cu.a > st.start), length(rtrim(t, ' ' || chr(10)))) AS stop FROM st),
fl AS (SELECT *, coalesce(regexp_matches(lag(substr(t, start + 1, stop - start)) OVER (PARTITION BY item_id ORDER BY start), '(?:^|\s)(?:(?i:{'|'.join(pl.ABBREVIATIONS)})\.+|[A-Z]\.)$'), false) AS go FROM pi),
gr AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY start) AS g FROM fl),
sn AS (SELECT item_id, g - 1 AS nth, min(start) AS start, max(stop) AS stop FROM gr GROUP BY item_id, g)"""


@query(f'WITH {_SPANS} SELECT item_id, CAST(nth AS INTEGER) AS nth, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM sn')
def sentence_offsets(s, d):
    return pl.sentence_spans(_quoting(s, d), "item_id")


_REGIONS = f"""rg AS (SELECT item_id, strpos(t, chr(8220)) - 1 AS a, strpos(t, chr(8221)) AS b FROM qd UNION ALL SELECT item_id, strpos(t, '"') - 1, strpos(t, chr(10) || chr(10)) - 1 FROM qd)"""


@query(f'WITH {_QUOTING}, {_REGIONS} SELECT item_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM rg')
def quoted_character_regions(s, d):
    return pl.quoted_characters(_quoting(s, d), "item_id")


@query(f"WITH {_SPANS}, {_REGIONS} SELECT item_id, CAST(nth AS INTEGER) AS nth, CASE WHEN EXISTS (SELECT 1 FROM rg WHERE rg.item_id = sn.item_id AND rg.a < sn.stop AND sn.start < rg.b) THEN 'QUOTED' ELSE 'PROSE' END AS kind FROM sn")
def sentence_kinds(s, d):
    docs = _quoting(s, d)
    return pl.classified(pl.sentence_spans(docs, "item_id"), pl.quoted_characters(docs, "item_id"), "item_id")


@query("""SELECT item_id AS doc_id, 11 AS start, CAST(length(text) + 13 AS INTEGER) AS "end", item_id, 1.0::DOUBLE AS score, 'MATCH' AS state FROM benchmark WHERE length(text) BETWEEN 8 AND 600 AND item_id < 1140""")
def fallback_findings(s, d):
    """Quotations with a reference behind, compared with the passage it names: no index of words is used. (References have chapters up
    to 114.)"""
    n = lambda e: F.expr(f"CAST({e} AS STRING)")
    text = F.concat(F.lit("It is said “"), "text", F.lit("” ("), n("item_id div 10 + 1"), F.lit(":"), n("item_id % 10 + 1"), F.lit(") there."))
    p = table(s, d, "benchmark")
    return pl.fallback(p.where("item_id < 1140").select(F.col("item_id").alias("doc_id"), text.alias("text")), c._rend(s, d))


# --- pages ---------------------------------------------------------------------------------------------------------------

_ITEM = pg.ITEM.replace("'", "''")


@query(f"""WITH x AS (SELECT page_id, coalesce(html, '') AS h FROM pages), i AS (SELECT page_id, h, regexp_extract_all(h, '{_ITEM}', 1) AS a, list_transform(regexp_extract_all(h, '{_ITEM}', 2), lambda y: {c._strip_sql('y')}) AS b FROM x)
SELECT page_id, {c._strip_sql("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading, CAST(len(a) AS BIGINT) AS n_items, array_to_string(list_transform(range(1, len(a) + 1), lambda k: a[k] || ' ' || b[k]), '|') AS items,
length({c._strip_sql("regexp_extract(h, '(?is)<article[^>]*>(.*?)(?:</article>|$)', 1)")}) AS article_chars FROM i""")
def page_parts(s, d):
    return pg.page_parts(table(s, d, "pages"))


_SECTIONED = "sc AS (SELECT item_id, '<h2>One</h2><p>' || text || '</p><h2>Two &amp; more</h2> <b>x</b><h2>One</h2>again' AS h FROM benchmark)"


@query(f"WITH {_SECTIONED} SELECT item_id, CAST(0 AS INTEGER) AS nth, 'One' AS name, {tx.collapse_sql('text')} AS text FROM benchmark UNION ALL SELECT item_id, 1, 'Two & more', 'x' FROM benchmark")
def page_sections(s, d):
    h = F.concat(F.lit("<h2>One</h2><p>"), "text", F.lit("</p><h2>Two &amp; more</h2> <b>x</b><h2>One</h2>again"))
    return pg.sections(table(s, d, "benchmark").select("item_id", h.alias("h")), "item_id", "h")


@query("SELECT n_nationkey AS doc_id, n_regionkey + 1 AS chapter, CAST(n_nationkey % 5 + 1 AS INTEGER) AS verse FROM nation")
def named_references(s, d):
    """References by name: regions as chapters of five, cited in several spellings; unknown names and numbers are left out."""
    r = table(s, d, "region")
    names = r.select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).alias("chapter"), F.lit(5).alias("verses"))
    n = table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.initcap("r_name")).otherwise(F.concat(F.lit("al-"), F.lower("r_name")))
    text = F.concat(F.lit("see ["), name, F.lit(": "), F.expr("CAST(n_nationkey % 5 + 1 AS STRING)"), F.lit("] or [Nowhere: 3] or ["), name, F.lit(": 99]"))
    return pg.named_references(n.select(F.col("n_nationkey").alias("doc_id"), text.alias("text")), names)


@query(f"""WITH q AS (SELECT item_id, {tx.collapse_sql('text')} AS text FROM benchmark WHERE length(text) BETWEEN 20 AND 1200)
SELECT item_id AS page_id, CAST(1 AS INTEGER) AS nth, text AS quote, 'A first paragraph of an answer.' AS before, 'A last paragraph of an answer.' AS after FROM q""")
def inline_quotes(s, d):
    """Answers whose middle paragraph quotes a passage with its citation."""
    html = F.concat(F.lit("<p>A first paragraph of an answer.</p><p>It is said “"), "text", F.lit("” (2:3).</p><p class=x>A last paragraph of an answer.</p><p>short</p>"))
    return pg.inline_quotes(table(s, d, "benchmark").select(F.col("item_id").alias("page_id"), html.alias("html")), r"\(\d+:\d+\)")


#: Titles by number with how many categories they have, and the titles that seeds mean.
TITLES = ((1, "الْخِطْبَةُ", 1), (2, "الخُطْبَةُ", 2), (3, "الآلَةُ", 1), (4, "الإله", 3), (5, "صيام", 1), (6, "خطبة", 5))
SEEDS = (("الخُطْبَة", 2, 1), ("الإله", 4, 1), ("الصيام", 5, 1))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {n})" for a, b, n in SEEDS) + ") AS t(seed, title_id, place)")
def homographs(s, d):
    seeds = s.createDataFrame([(a,) for a, _, _ in SEEDS], "seed string")
    return pg.resolved(seeds, s.createDataFrame(list(TITLES), "title_id int, title string, categories int"))


# --- records -------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'replace' WHEN 2 THEN 'escalate' WHEN 3 THEN 'erase' ELSE NULL END AS decision, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 = 0 THEN repeat('n', 81) ELSE 'R' END AS reviewer,
CASE WHEN event_id % 13 = 0 THEN repeat('x', 2001) ELSE 'note' END AS note, CASE WHEN event_id % 2 = 0 THEN 'text' END AS replacement FROM events)
SELECT event_id, CASE WHEN decision IS NULL OR decision NOT IN ('approve', 'replace', 'escalate') THEN 'BAD_DECISION' WHEN trim(reviewer) = '' THEN 'REVIEWER_REQUIRED' WHEN length(reviewer) > 80 THEN 'REVIEWER_TOO_LONG' WHEN length(note) > 2000 THEN 'NOTE_TOO_LONG'
WHEN decision = 'replace' AND replacement IS NULL THEN 'REPLACEMENT_REQUIRED' WHEN user_id % 10 = 0 THEN 'ITEM_NOT_FOUND' ELSE 'OK' END AS code FROM e""")
def checked_decisions(s, d):
    """Decisions made from events, with the reason against each that may not be appended; users divisible by ten are no items."""
    e, m = table(s, d, "events"), lambda k: F.col("event_id") % k == 0
    kind = F.element_at(F.array(*map(F.lit, ("approve", "replace", "escalate", "erase")), F.lit(None).cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    reviewer = F.when(m(7), " ").when(m(11), F.lit("n" * 81)).otherwise("R")
    new = e.select("event_id", "user_id", kind.alias("decision"), reviewer.alias("reviewer"), F.when(m(13), F.lit("x" * 2001)).otherwise("note").alias("note"), F.when(m(2), "text").alias("replacement"))
    return ld.checked_decisions(new, e.select("user_id").where("user_id % 10 <> 0"), "user_id").select("event_id", "code")


@query(f"""{c._VERDICTS} SELECT substr(sha1(CAST(doc_id AS VARCHAR) || '|' || sha256(coalesce(text, ''))), 1, 16) AS check_id, sha256(coalesce(text, '')) AS text_sha256, verdict,
'{{"match":' || match || ',"near":' || near || ',"unattributed":' || unattributed || '}}' AS payload FROM vd JOIN documents USING (doc_id)""")
def check_records(s, d):
    docs = table(s, d, "documents")
    return ld.check_records(docs, c.document_verdict(s, d))


@query("""WITH r AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id), v AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR) || ':' || CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'replace' ELSE 'escalate' END, ',' ORDER BY event_id) AS review FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id)
SELECT user_id, sha256(CAST(e AS VARCHAR)) AS translation_sha256, 'CLEAR' AS verdict, coalesce(review, '') AS review FROM r LEFT JOIN v USING (user_id)""")
def exported_records(s, d):
    """A record a user, with the decisions on it."""
    e = table(s, d, "events")
    records = e.groupBy("user_id").agg(F.sha2(F.min("event_id").cast("string"), 256).alias("text_sha256")).withColumn("verdict", F.lit("CLEAR"))
    return ld.exported(records, e, "user_id")


@query("SELECT '<tr><td>' || CAST(n_nationkey AS VARCHAR) || '</td><td>' || replace(n_name, '&', '&amp;') || '</td></tr>' AS html, '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |' AS markdown FROM nation")
def report_rows(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    return _lines(n).select("html", "markdown")


def _lines(n: DataFrame) -> DataFrame:
    html = io.html_rows(n).select(F.regexp_extract("value", r"<td>(\d+)</td>", 1).cast("long").alias("n_nationkey"), F.col("value").alias("html"))
    mark = io.markdown_rows(n).select(F.regexp_extract("value", r"^\| (\d+)", 1).cast("long").alias("n_nationkey"), F.col("value").alias("markdown"))
    return html.join(mark, "n_nationkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def public_customers(s, d):
    """Customers without what is not to be published."""
    rows = table(s, d, "customer")
    return io.public(rows, tuple(x for x in rows.columns if x not in ("c_custkey", "c_name", "c_nationkey")))
