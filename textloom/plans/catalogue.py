"""The registered queries: each operator over its whole table, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import language as lg
from ..operators import ledger as ld
from ..operators import passages as ps
from ..sources.tables import table
from ..streaming import events as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _passages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark")


def _rend(s: SparkSession, d: str) -> DataFrame:
    return ps.renderings(_passages(s, d))


# Shared parts of the oracles.
_DW = f"dw AS (SELECT doc_id, lang, {tx.tokens_sql('text')} AS w FROM documents)"
_PW = f"pw AS (SELECT item_id, {tx.tokens_sql('text')} AS w FROM benchmark)"
_R = """r0 AS (SELECT item_id, text, string_split(coalesce(text, ''), ' ') AS s FROM benchmark),
rend AS (SELECT item_id, 0 AS edition, text FROM r0 UNION ALL SELECT item_id, 1, lower(array_to_string(list_filter(s, lambda x, i: (i - 1) % 7 <> 6), ' ')) FROM r0
 UNION ALL SELECT item_id, 2, text || ' ____ [1] note ' || array_to_string(s[1:5], ' ') FROM r0)"""
_RW = f"rw AS (SELECT item_id, edition, text, {tx.normalize_sql('text')} AS norm, {tx.tokens_sql('text')} AS w FROM rend)"


def _runs(n: int) -> str:
    return f"""dg{n} AS (SELECT doc_id, unnest({tx.shingles_sql('w', n)}) AS g FROM dw),
pg{n} AS (SELECT item_id, len(gs) AS of_passage, unnest(gs) AS g FROM (SELECT item_id, {tx.shingles_sql('w', n)} AS gs FROM pw)),
sh{n} AS (SELECT doc_id, item_id, count(*) AS shared, any_value(of_passage) AS of_passage FROM dg{n} JOIN pg{n} USING (g) GROUP BY doc_id, item_id)"""


def _pairs(n: int) -> str:
    return f"WITH {_DW}, {_PW}, {_runs(n)}, pairs AS (SELECT doc_id, item_id, dw.w AS dw, pw.w AS pw FROM sh{n} JOIN dw USING (doc_id) JOIN pw USING (item_id))"


_PAIRS = _pairs(ps.RUN)
_ISLANDS = """h AS (SELECT doc_id, item_id, i, j, i - j AS diag FROM (SELECT doc_id, item_id, unnest(dw) AS x, generate_subscripts(dw, 1) - 1 AS i FROM pairs) d
  JOIN (SELECT doc_id, item_id, unnest(pw) AS x, generate_subscripts(pw, 1) - 1 AS j FROM pairs) p USING (doc_id, item_id, x)),
isl AS (SELECT doc_id, item_id, diag, isl, count(*) AS run, min(i) AS i, min(j) AS j FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS isl FROM h) GROUP BY doc_id, item_id, diag, isl),
best AS (SELECT doc_id, item_id, run, i AS doc_start, j AS passage_start FROM isl QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY run DESC, i, j) = 1)"""
_STATE = lambda x: f"CASE WHEN {x} >= {sm.SAME} THEN 'MATCH' WHEN {x} >= {sm.NEAR} THEN 'NEAR' ELSE 'UNATTRIBUTED' END"
_JACCARD = lambda a, b: f"CASE WHEN len(list_distinct({a} || {b})) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) ELSE 0 END"


# --- scalar functions --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {tx.normalize_sql('text')} AS norm FROM documents")
def normalize_text(s, d):
    return _docs(s, d).select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, array_to_string({tx.strict_sql('text')}, ' ') AS words, CAST(len({tx.strict_sql('text')}) AS BIGINT) AS n FROM documents")
def strict_tokens(s, d):
    return _docs(s, d).select("doc_id", tx.strict_tokens(F.col("text")).alias("w")).select("doc_id", F.array_join("w", " ").alias("words"), F.size("w").cast("long").alias("n"))


@query(f"WITH {_DW} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM dw")
def token_counts(s, d):
    return ps.words_of(_docs(s, d), "doc_id").select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(r"""SELECT doc_id, round(CASE WHEN l > 0 THEN n / l ELSE 0 END, 6) AS latin_share, CASE WHEN len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) > 0 THEN 'latin' END AS script
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\p{L}'))::DOUBLE AS l, len(regexp_extract_all(text, '\p{Latin}'))::DOUBLE AS n FROM documents)""")
def latin_share_script(s, d):
    return _docs(s, d).select("doc_id", F.round(tx.latin_share(F.col("text")), 6).alias("latin_share"), tx.dominant_script(F.col("text")).alias("script"))


_STRIP = r"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


def _strip_sql(x: str) -> str:
    x = _STRIP.format(x=x)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return tx.collapse_sql(x)


@query(f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def strip_html_text(s, d):
    return table(s, d, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


_TITLE = _strip_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query(f"""WITH l AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<a\\s+href="([^"]*)"', 1) AS a FROM pages),
u AS (SELECT page_id, href, min(i) AS i FROM (SELECT page_id, unnest(a) AS href, generate_subscripts(a, 1) AS i FROM l) GROUP BY page_id, href),
g AS (SELECT page_id, count(*) AS n, string_agg(href, ' ' ORDER BY i) AS links FROM u GROUP BY page_id)
SELECT l.page_id, {_TITLE} AS title, coalesce(n, 0) AS n_links, coalesce(links, '') AS links FROM l LEFT JOIN g USING (page_id)""")
def page_title_links(s, d):
    return ev.links(table(s, d, "pages"))


@query("SELECT doc_id, sha256(text) AS text_sha256, substr(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source)), 1, 16) AS record_id FROM documents")
def sha_ids(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("text_sha256"), tx.record_id(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("record_id"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\p{L}]+') AS w, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[.!?]+(\s|$)'))) AS s,
 len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '\p{Latin}')) AS n FROM documents),
y AS (SELECT doc_id, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(x), '[^aeiouyl]e$') AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM t)
SELECT doc_id, CAST(s AS BIGINT) AS n_sentences, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(y, 0) AS BIGINT) AS n_syllables,
 CASE WHEN len(w) > 0 AND n >= 0.9 * l AND l > 0 THEN round(206.835 - 1.015 * len(w) / s - 84.6 * y / len(w), 6) END AS flesch FROM t JOIN y USING (doc_id)""")
def readability_flesch(s, d):
    return lg.readability(_docs(s, d))


_SENT = r"""s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?؟۔।॥])\s+', '\1' || chr(10), 'g'), '\s*\n\s*', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM documents),
sent AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS nth FROM s0)"""


@query(f"WITH {_SENT} SELECT doc_id, CAST(nth AS INTEGER) AS nth, sentence FROM sent")
def split_sentences(s, d):
    return lg.sentences(_docs(s, d))


# --- similarity --------------------------------------------------------------------------------------------------------


@query(f"{_PAIRS} SELECT doc_id, item_id, round({_JACCARD('dw', 'pw')}, 6) AS jaccard FROM pairs")
def jaccard_pairs(s, d):
    pairs = ps.word_pairs(_docs(s, d), _passages(s, d))
    return pairs.select("doc_id", "item_id", F.round(sm.jaccard(F.array_distinct("dw"), F.array_distinct("pw")), 6).alias("jaccard"))


@query(f"{_PAIRS} SELECT doc_id, item_id, round(len(list_filter(pw, lambda x: list_contains(dw, x)))::DOUBLE / len(pw), 6) AS containment FROM pairs")
def containment_pairs(s, d):
    return ps.word_pairs(_docs(s, d), _passages(s, d)).select("doc_id", "item_id", F.round(sm.containment(F.col("pw"), F.col("dw")), 6).alias("containment"))


@query(f"""{_PAIRS}, t AS (SELECT doc_id, item_id, array_to_string(dw, ' ') AS a, array_to_string(pw, ' ') AS b, {_JACCARD('dw', 'pw')} AS j FROM pairs),
ca AS (SELECT doc_id, item_id, ch, count(*) AS n FROM (SELECT doc_id, item_id, unnest(string_split(a, '')) AS ch FROM t) GROUP BY ALL),
cb AS (SELECT doc_id, item_id, ch, count(*) AS n FROM (SELECT doc_id, item_id, unnest(string_split(b, '')) AS ch FROM t) GROUP BY ALL),
m AS (SELECT doc_id, item_id, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (doc_id, item_id, ch) GROUP BY ALL)
SELECT doc_id, item_id, round(0.6 * 2 * least(length(a), length(b)) / (length(a) + length(b)) + 0.4 * j, 6) AS by_length, round(0.6 * 2 * c / (length(a) + length(b)) + 0.4 * j, 6) AS by_characters FROM t JOIN m USING (doc_id, item_id)""")
def multiset_bounds(s, d):
    pairs = ps.word_pairs(_docs(s, d), _passages(s, d))
    a, b, jac = F.array_join("dw", " "), F.array_join("pw", " "), sm.jaccard(F.array_distinct("dw"), F.array_distinct("pw"))
    rows = pairs.select("doc_id", "item_id", a.alias("a"), b.alias("b"), jac.alias("j"))
    return rows.select("doc_id", "item_id", F.round(sm.length_bound(F.col("a"), F.col("b"), F.col("j")), 6).alias("by_length"), F.round(sm.multiset_bound(F.col("a"), F.col("b"), F.col("j")), 6).alias("by_characters"))


@query(f"{_PAIRS}, {_ISLANDS} SELECT doc_id, item_id, run, CAST(doc_start AS BIGINT) AS doc_start, CAST(passage_start AS BIGINT) AS passage_start FROM best")
def longest_common_run(s, d):
    return ps.longest_run(_docs(s, d), _passages(s, d))


@query(f"""{_PAIRS}, v AS (SELECT doc_id, item_id, unnest(list_transform(dw, lambda x: CASE WHEN list_contains(pw, x) THEN 1 ELSE -2 END)) AS v, generate_subscripts(dw, 1) AS i FROM pairs),
s AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS s FROM v),
m AS (SELECT *, s - coalesce(least(0, min(s) OVER (PARTITION BY doc_id, item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS m FROM s)
SELECT doc_id, item_id, CAST(max(m) AS BIGINT) AS best FROM m GROUP BY doc_id, item_id""")
def contained_segments(s, d):
    return ps.contained_segment(ps.word_pairs(_docs(s, d), _passages(s, d)))


_STRICT = f"""WITH {_DW}, {_PW}, {_runs(ps.RUN)}, {_R}, t AS (SELECT doc_id, item_id, edition, {tx.strict_sql('b.text')} AS p, {tx.strict_sql('rend.text')} AS a, {tx.strict_sql('rend.text', True)} AS q
FROM sh{ps.RUN} JOIN rend USING (item_id) JOIN benchmark b USING (item_id))"""


@query(f"""{_STRICT} SELECT doc_id, item_id, edition, CASE WHEN len(p) = 0 THEN NULL WHEN (p = a AND len(a) > 0) OR (p = q AND len(q) > 0) THEN 'whole'
WHEN contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ') OR contains(' ' || array_to_string(q, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ') THEN 'excerpt' END AS verbatim FROM t""")
def verbatim_flag(s, d):
    quotes = ps.shared_runs(_docs(s, d), _passages(s, d), ps.RUN).join(_passages(s, d), "item_id").select("doc_id", "item_id", tx.strict_tokens(F.col("text")).alias("p"))
    r = _rend(s, d).select("item_id", "edition", tx.strict_tokens(F.col("text")).alias("a"), tx.strict_tokens(F.col("text"), True).alias("q"))
    return quotes.join(r, "item_id").select("doc_id", "item_id", "edition", sm.verbatim(F.col("p"), F.col("a"), F.col("q")).alias("verbatim"))


@query()
def sim_exact(s, d):
    """The Arrow kernel of the sequence ratio, over each quotation and rendering."""
    return ps.ranked_editions(ps.quotations(_docs(s, d), _passages(s, d)), _rend(s, d), "sim")


@query()
def best_renderings(s, d):
    """Each quotation's best rendering by the sequence ratio, those compared in full that a bound does not rule out."""
    return ps.best_edition(ps.quotations(_docs(s, d), _passages(s, d)), _rend(s, d)).drop("n_compared")


@query()
def word_diffs(s, d):
    r = _rend(s, d)
    a, b = (r.where(F.col("edition") == e).select("item_id", tx.strict_tokens(F.col("text")).alias(f"w{e}")) for e in (0, 1))
    return a.join(b, "item_id").select("item_id", F.explode(sm.word_diff(F.col("w1"), F.col("w0"))).alias("o")).select("item_id", "o.op", "o.published", "o.approved")


# --- index ---------------------------------------------------------------------------------------------------------------

_DF = f"{_R}, {_RW}, df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM rw) GROUP BY token)"
_POST = f"""{_DF}, idf AS (SELECT token, ln((SELECT count(*) FROM rend)::DOUBLE / (1 + df)) AS idf FROM df), per AS (SELECT item_id, count(*) AS n_ed, min(length(norm)) AS shortest FROM rw GROUP BY item_id),
hit AS (SELECT token, item_id, count(*) AS c FROM (SELECT item_id, unnest(list_distinct(w)) AS token FROM rw) GROUP BY ALL),
post AS (SELECT token, item_id, idf * c / n_ed / sqrt(greatest(1, shortest)) AS weight FROM hit JOIN idf USING (token) JOIN per USING (item_id) WHERE idf >= {ps.MIN_IDF})"""


@query(f"WITH {_DF} SELECT token, df FROM df")
def doc_frequency(s, d):
    return ps.document_frequency(_rend(s, d))


@query(f"WITH {_POST} SELECT token, item_id, round(weight, 9) AS weight FROM post")
def idf_postings(s, d):
    return ps.postings(_rend(s, d)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {_R}, {_RW} SELECT item_id, CAST(min(len(w)) AS BIGINT) AS ref_len FROM rw GROUP BY item_id")
def ref_len_min(s, d):
    return ps.shortest(_rend(s, d))


@query(f"""WITH {_R}, {_RW}, p AS (SELECT list_sort(list(len(w)))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM rw)
SELECT CAST(p95 AS INTEGER) AS p95, CAST(unnest(list_distinct(list_filter({list(ps.WINDOWS)}, lambda x: x <= p95) || [p95])) AS INTEGER) AS "window" FROM p""")
def window_ladder_p95(s, d):
    return ps.window_ladder(_rend(s, d))


@query(f"""WITH {_R}, c AS (SELECT item_id, edition, trim(regexp_split_to_array(text, '_{{4,}}')[1], ' ') AS plain FROM rend), n AS (SELECT *, len({tx.tokens_sql('plain')}) AS n FROM c),
m AS (SELECT item_id, list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mid FROM n GROUP BY item_id) SELECT item_id, edition, plain, CAST(n AS BIGINT) AS n FROM n JOIN m USING (item_id) WHERE n <= 1.6 * mid""")
def plain_renderings_upper_median(s, d):
    return ps.plain_renderings(_rend(s, d))


# --- candidates ----------------------------------------------------------------------------------------------------------

_WIN = f"""{_DW}, win AS (SELECT doc_id, start, w[start + 1:start + 36] AS words FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 36) + 1, 18)) AS start FROM dw WHERE len(w) > 0))"""


@query(f"WITH {_WIN} SELECT doc_id, CAST(start AS INTEGER) AS start, array_to_string(words, ' ') AS words FROM win")
def sliding_token_windows(s, d):
    return ps.sliding_windows(_docs(s, d), 36, 18).select("doc_id", F.col("start").cast("int").alias("start"), F.array_join("words", " ").alias("words"))


@query(f"""WITH {_WIN}, {_POST}, sc AS (SELECT doc_id, start, item_id, round(sum(weight), 9) AS s FROM (SELECT doc_id, start, unnest(list_distinct(words)) AS token FROM win) JOIN post USING (token) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY s DESC, item_id) AS place, max(s) OVER (PARTITION BY doc_id, start) AS top FROM sc)
SELECT doc_id, CAST(start AS INTEGER) AS start, item_id, place FROM rk WHERE place <= {ps.TOP} AND round(s / top, 6) >= {ps.KEEP}""")
def lexical_topk(s, d):
    return ps.lexical_top(ps.sliding_windows(_docs(s, d), 36, 18), ps.postings(_rend(s, d))).select("doc_id", F.col("start").cast("int").alias("start"), "item_id", "place")


@query(f"WITH {_DW}, {_PW}, {_runs(ps.SMALL_RUN)} SELECT doc_id, item_id, shared, CAST(of_passage AS BIGINT) AS of_passage FROM sh{ps.SMALL_RUN}")
def ngram_seed_hits(s, d):
    return ps.shared_runs(_docs(s, d), _passages(s, d), ps.SMALL_RUN)


_QUOTE = f"{_PAIRS}, {_ISLANDS}, q AS (SELECT doc_id, item_id, dw[greatest(0, doc_start - passage_start) + 1:greatest(0, doc_start - passage_start) + len(pw)] AS qw FROM best JOIN pairs USING (doc_id, item_id)), {_R}, {_RW}"
_RANK = f"""{_QUOTE}, j AS (SELECT doc_id, item_id, edition, round({_JACCARD('qw', 'rw.w')}, 6) AS score FROM q JOIN rw USING (item_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, edition) AS place FROM j)"""


def _ranked(s, d):
    return ps.ranked_editions(ps.quotations(_docs(s, d), _passages(s, d)), _rend(s, d))


@query(f"{_RANK} SELECT doc_id, item_id, edition, score, place FROM rk WHERE place <= 2")
def seed_jaccard_top2(s, d):
    return _ranked(s, d).where("place <= 2")


@query(f"""WITH {_DW}, {_PW}, {_runs(ps.SMALL_RUN)}, {_DF}, idf AS (SELECT token, greatest(0, ln((SELECT count(*) FROM rend)::DOUBLE / (1 + df))) AS idf FROM df),
tk AS (SELECT doc_id, unnest(list_distinct(w)) AS token FROM dw), al AS (SELECT doc_id, sum(idf) AS a FROM tk JOIN idf USING (token) GROUP BY doc_id),
hv AS (SELECT item_id, edition, unnest(list_distinct(w)) AS token FROM rw), cm AS (SELECT doc_id, item_id, edition, sum(idf) AS s FROM sh{ps.SMALL_RUN} JOIN tk USING (doc_id) JOIN hv USING (item_id, token) JOIN idf USING (token) GROUP BY ALL)
SELECT doc_id, round(max(CASE WHEN a > 0 THEN s / a ELSE 0 END), 6) AS likeness FROM cm JOIN al USING (doc_id) GROUP BY doc_id""")
def passage_likeness(s, d):
    return ps.likeness(_docs(s, d), _rend(s, d))


# --- attribution and report ----------------------------------------------------------------------------------------------


@query(f"""WITH {_DW}, {_PW}, {_runs(ps.RUN)}, c AS (SELECT *, round(shared::DOUBLE / of_passage, 6) AS coverage FROM sh{ps.RUN})
SELECT doc_id, item_id, shared, CAST(of_passage AS BIGINT) AS of_passage, coverage, {_STATE('coverage')} AS state FROM c""")
def passage_coverage(s, d):
    return ps.coverage(_docs(s, d), _passages(s, d))


_ATTR = f"""{_RANK}, b AS (SELECT doc_id, item_id, max(score) AS score, arg_min(edition, place) AS edition, count(*) AS n_compared, coalesce(string_agg(CAST(edition AS VARCHAR), ',' ORDER BY place) FILTER (place BETWEEN 2 AND 4), '') AS runners_up FROM rk GROUP BY ALL),
att AS (SELECT doc_id, item_id, CASE WHEN score >= {sm.NEAR} THEN edition END AS edition, score, {_STATE('score')} AS state, n_compared, runners_up FROM b)"""


@query(f"{_ATTR} SELECT * FROM att")
def attribute_rank_jaccard(s, d):
    return ps.attributed(_ranked(s, d))


@query()
def attribute_state_sim(s, d):
    return ps.attributed(sim_exact(s, d))


_VERDICTS = f"""{_ATTR}, al AS (SELECT doc_id, item_id, CASE WHEN coalesce(lang, 'en') = 'en' THEN state ELSE 'NO_APPROVED_TRANSLATION' END AS state FROM att JOIN documents USING (doc_id)),
n AS (SELECT doc_id, count(*) FILTER (state = 'MATCH') AS match, count(*) FILTER (state = 'NEAR') AS near, count(*) FILTER (state = 'UNATTRIBUTED') AS unattributed, count(*) FILTER (state = 'NO_APPROVED_TRANSLATION') AS no_approved_translation,
 array_to_string(list_sort(list_distinct(list(item_id)))[1:5], ',') AS refs FROM al GROUP BY doc_id),
vd AS (SELECT d.doc_id, coalesce(match, 0) AS match, coalesce(near, 0) AS near, coalesce(unattributed, 0) AS unattributed, coalesce(no_approved_translation, 0) AS no_approved_translation, coalesce(refs, '') AS refs,
CASE WHEN coalesce(near, 0) + coalesce(unattributed, 0) > 0 THEN 'REFER' WHEN n.doc_id IS NULL THEN 'NO_QUOTES' WHEN no_approved_translation > 0 THEN 'NO_APPROVED_TRANSLATION' ELSE 'CLEAR' END AS verdict FROM documents d LEFT JOIN n USING (doc_id))"""


@query(f"{_VERDICTS} SELECT * FROM vd")
def document_verdict(s, d):
    return ps.verdicts(_docs(s, d), ps.in_language(attribute_rank_jaccard(s, d), _docs(s, d)))


@query(f"{_ATTR} SELECT lang, count(*) FILTER (state = 'MATCH') AS match, count(*) FILTER (state = 'NEAR') AS near, count(*) FILTER (state = 'UNATTRIBUTED') AS unattributed FROM att JOIN documents USING (doc_id) GROUP BY lang")
def state_counts_pivot(s, d):
    rows = attribute_rank_jaccard(s, d).join(_docs(s, d).select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(*[F.count(F.when(F.col("state") == x, 1)).alias(x.lower()) for x in ("MATCH", "NEAR", "UNATTRIBUTED")])


@query(f"WITH {_DW}, {_PW}, {_runs(ps.RUN)} SELECT d.doc_id, d.lang, 'NO_APPROVED_TRANSLATION' AS state FROM documents d WHERE EXISTS (SELECT 1 FROM sh{ps.RUN} s WHERE s.doc_id = d.doc_id) AND d.lang NOT IN ('en')")
def no_edition_state(s, d):
    """Documents that quote a passage in a language without editions (the derived ones are English)."""
    quoting = ps.shared_runs(_docs(s, d), _passages(s, d), ps.RUN).select("doc_id")
    return _docs(s, d).join(quoting, "doc_id", "left_semi").where("lang <> 'en'").select("doc_id", "lang", F.lit("NO_APPROVED_TRANSLATION").alias("state"))


@query(f"WITH {_DW}, {_PW}, {_runs(ps.RUN)} SELECT b.item_id FROM benchmark b ANTI JOIN sh{ps.RUN} s USING (item_id)")
def missing_source_refs(s, d):
    return _passages(s, d).join(ps.shared_runs(_docs(s, d), _passages(s, d), ps.RUN), "item_id", "left_anti").select("item_id")


_HITS = f"hits AS (SELECT doc_id, item_id, i AS start, i + run AS \"end\", run FROM isl WHERE run >= {ps.SMALL_RUN})"


def _run_spans(s, d) -> DataFrame:
    """Runs of SMALL_RUN words or more that documents and passages have in common."""
    return ps.run_spans(_docs(s, d), _passages(s, d))


def _merge_sql(gap: int, keys: str) -> str:
    return f"""m0 AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hits),
m1 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m0)
SELECT {keys}, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", count(*) AS n FROM m1 GROUP BY {keys}, g"""


@query(f"{_pairs(ps.SMALL_RUN)}, {_ISLANDS}, {_HITS}, {_merge_sql(5, 'doc_id, item_id')}")
def merge_fragments(s, d):
    return ps.merged_intervals(_run_spans(s, d), ["doc_id", "item_id"], 5)


@query(f"{_pairs(ps.SMALL_RUN)}, {_ISLANDS}, {_HITS}, {_merge_sql(0, 'doc_id')}")
def interval_merge(s, d):
    return ps.merged_intervals(_run_spans(s, d), ["doc_id"])


@query()
def overlap_greedy(s, d):
    return ps.resolve_overlaps(_run_spans(s, d).withColumn("score", (F.col("end") - F.col("start")).cast("double")))


@query(f"""{_pairs(ps.SMALL_RUN)}, {_ISLANDS}, {_HITS}, m AS (SELECT doc_id, sum(n) AS covered FROM (SELECT doc_id, max("end") - min(start) AS n FROM (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hits)) GROUP BY doc_id, g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) - covered AS BIGINT) AS extra, len(w) - covered >= 3 AS flagged FROM m JOIN dw USING (doc_id)""")
def extra_words(s, d):
    """Words of quoting documents that no run covers."""
    covered = ps.merged_intervals(_run_spans(s, d), ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return ps.words_of(_docs(s, d), "doc_id").join(covered, "doc_id").select("doc_id", (F.size("w") - F.col("covered")).alias("extra"), (F.size("w") - F.col("covered") >= 3).alias("flagged"))


# --- references ----------------------------------------------------------------------------------------------------------

_CITE = "cite AS (SELECT item_id, text || ' (Book ' || CAST(item_id % 130 + 1 AS VARCHAR) || ':' || CAST(item_id % 7 + 150 AS VARCHAR) || '-' || CAST(item_id % 3 + 7 AS VARCHAR) || ') and [x ' || CAST(item_id % 114 + 1 AS VARCHAR) || ':' || CAST(item_id % 9 + 1 AS VARCHAR) || ']' AS text FROM benchmark)"


def _cited(s, d) -> DataFrame:
    n = lambda e: F.expr(f"CAST(item_id {e} AS STRING)")
    return _passages(s, d).select("item_id", F.concat("text", F.lit(" (Book "), n("% 130 + 1"), F.lit(":"), n("% 7 + 150"), F.lit("-"), n("% 3 + 7"), F.lit(") and [x "), n("% 114 + 1"), F.lit(":"), n("% 9 + 1"), F.lit("]")).alias("text"))


_REFS = rf"""{_CITE}, x AS (SELECT item_id, unnest(regexp_extract_all(text, '[(\[][^()\[\]\n]{{0,40}}?{lg.REFERENCE}\s*[)\]]')) AS ref, generate_subscripts(regexp_extract_all(text, '[(\[][^()\[\]\n]{{0,40}}?{lg.REFERENCE}\s*[)\]]'), 1) - 1 AS nth FROM cite),
y AS (SELECT item_id, nth, CAST(regexp_extract(ref, '{lg.REFERENCE}\s*[)\]]', 1) AS INTEGER) AS chapter, regexp_extract(ref, '{lg.REFERENCE}\s*[)\]]', 2) AS a, regexp_extract(ref, '{lg.REFERENCE}\s*[)\]]', 3) AS b FROM x),
refs AS (SELECT item_id, CAST(nth AS BIGINT) AS nth, chapter, CAST(a AS INTEGER) AS "first", greatest(CAST(a AS INTEGER), CAST(CASE WHEN b = '' THEN a WHEN length(b) < length(a) THEN substr(a, 1, length(a) - length(b)) || b ELSE b END AS INTEGER)) AS "last" FROM y)"""


@query(f'WITH {_REFS} SELECT * FROM refs WHERE chapter BETWEEN 1 AND {lg.CHAPTERS} AND "first" BETWEEN 1 AND {lg.VERSES}')
def printed_refs(s, d):
    return lg.printed_references(_cited(s, d), "item_id")


@query(f"""WITH {_REFS} SELECT item_id, chapter, CAST(unnest(range("first", "last" + 1)) AS INTEGER) AS verse FROM refs WHERE chapter BETWEEN 1 AND {lg.CHAPTERS} AND "first" BETWEEN 1 AND {lg.VERSES}""")
def ref_ranges(s, d):
    return lg.printed_references(_cited(s, d), "item_id").select("item_id", "chapter", F.explode(F.sequence("first", "last")).alias("verse"))


@query(f"""WITH {_REFS} SELECT item_id, chapter, "first" FROM refs WHERE chapter BETWEEN 1 AND {lg.CHAPTERS} AND "first" BETWEEN 1 AND {lg.VERSES} AND (chapter - 1) * 10 + "first" - 1 NOT IN (SELECT item_id FROM benchmark)""")
def bad_reference(s, d):
    """References to passages that are not there (chapter and verse number the items by tens)."""
    refs = lg.printed_references(_cited(s, d), "item_id").withColumn("at", ((F.col("chapter") - 1) * 10 + F.col("first") - 1).cast("long"))
    return refs.join(_passages(s, d).select(F.col("item_id").alias("at")), "at", "left_anti").select("item_id", "chapter", "first")


# --- language ------------------------------------------------------------------------------------------------------------


@query(rf"""WITH {_SENT}, w AS (SELECT doc_id, nth, unnest(regexp_extract_all(sentence, '[\p{{L}}]+')) AS w, generate_subscripts(regexp_extract_all(sentence, '[\p{{L}}]+'), 1) AS i FROM sent),
l AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, nth ORDER BY i) AS isl FROM w WHERE length(w) >= {lg.LONG_WORD}), r AS (SELECT doc_id, nth, count(*) AS run FROM l GROUP BY doc_id, nth, isl HAVING count(*) >= {lg.CHAIN})
SELECT doc_id, CAST(nth AS INTEGER) AS nth, count(*) AS chains, max(run) AS longest FROM r GROUP BY doc_id, nth""")
def noun_chain(s, d):
    return lg.noun_chains(lg.sentences(_docs(s, d)))


@query(f"WITH {_DW} SELECT doc_id, (length(text) - length(replace(text, w[1], ''))) = (length(upper(text)) - length(replace(upper(text), w[1], ''))) AS kept FROM dw JOIN documents USING (doc_id) WHERE len(w) > 0")
def byte_exact_verify(s, d):
    """Whether a document's first word occurs as often after its text was put in capitals."""
    rows = _docs(s, d).select("doc_id", "text", F.get(tx.tokens(F.col("text")), F.lit(0)).alias("frozen")).where("frozen IS NOT NULL")
    return rows.select("doc_id", lg.kept_bytes(F.col("text"), F.upper("text"), F.col("frozen")).alias("kept"))


_TERMS = f"""{_DW}, pr AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM dw WHERE len(w) >= 2),
terms AS (SELECT lang || '-' || CAST(nth AS VARCHAR) AS term_id, lang, pair FROM (SELECT lang, pair, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, pair) AS nth FROM pr GROUP BY lang, pair) WHERE nth <= 20),
ph AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair, unnest(range(0, len(w) - 1)) AS start FROM dw WHERE len(w) >= 2),
th AS (SELECT doc_id, term_id, start, start + 2 AS "end" FROM ph JOIN terms USING (lang, pair))"""


@query(f'WITH {_TERMS} SELECT doc_id, term_id, start, "end" FROM th')
def phrase_hits(s, d):
    return lg.phrase_hits(_docs(s, d), lg.glossary(_docs(s, d)))


@query(f"WITH {_TERMS} SELECT doc_id, term_id, min(start) AS start, count(*) AS uses FROM th GROUP BY ALL")
def first_use_gloss(s, d):
    return lg.first_uses(phrase_hits(s, d))


@query(f"""{_pairs(ps.SMALL_RUN)}, {_ISLANDS}, {_HITS} SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start)""")
def outermost_hits(s, d):
    return lg.outermost(_run_spans(s, d))


@query(f"""WITH {_TERMS}, n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY lang), f AS (SELECT term_id, count(DISTINCT doc_id) AS found FROM th GROUP BY term_id)
SELECT term_id, coalesce(found, 0) AS found, n - coalesce(found, 0) AS missing FROM terms JOIN n USING (lang) LEFT JOIN f USING (term_id)""")
def term_status(s, d):
    return lg.term_status(phrase_hits(s, d), _docs(s, d), lg.glossary(_docs(s, d)))


@query(f"""WITH {_DW}, x AS (SELECT DISTINCT unnest(w) AS x FROM dw) SELECT translate(x, 'àâäáãéèêëíìîïóòôöõúùûüçñß', 'aaaaaeeeeiiiiooooouuuucns') AS key, count(*) AS n, array_to_string(list_sort(list(x)), ',') AS spellings FROM x WHERE length(x) >= 4 GROUP BY key HAVING count(*) > 1""")
def spelling_variants(s, d):
    return lg.spelling_variants(_docs(s, d))


@query(f"""WITH {_DW}, x AS (SELECT DISTINCT unnest(w) AS x FROM dw WHERE lang = 'en'), p AS (SELECT x, unnest(['', 're', 'un']) AS p FROM x), c AS (SELECT x, p, unnest(['', 'ing', 'ed', 'ly']) AS s FROM p)
SELECT x AS word, string_agg(DISTINCT substr(x, length(p) + 1, length(x) - length(p) - length(s)), ',' ORDER BY substr(x, length(p) + 1, length(x) - length(p) - length(s))) AS stems FROM c WHERE starts_with(x, p) AND ends_with(x, s) AND length(x) - length(p) - length(s) >= 3 GROUP BY x""")
def stem_candidates(s, d):
    w = ps.words_of(_docs(s, d).where("lang = 'en'"), "doc_id").select(F.explode("w").alias("word")).distinct()
    return w.select("word", lg.stems(F.col("word"), ("re", "un"), ("ing", "ed", "ly")).alias("a")).where(F.size("a") > 0).select("word", F.array_join("a", ",").alias("stems"))


# --- ledger --------------------------------------------------------------------------------------------------------------

_DECIDE = "CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'replace' WHEN 'error' THEN 'escalate' END"
_LATEST = f"ls AS (SELECT user_id, coalesce(arg_max({_DECIDE}, event_id) FILTER ({_DECIDE} IS NOT NULL), 'pending') AS status, max(event_id) FILTER ({_DECIDE} IS NOT NULL) AS event_id FROM events GROUP BY user_id)"


@query(f"WITH {_LATEST} SELECT * FROM ls")
def latest_status(s, d):
    return ld.latest_status(table(s, d, "events"))


@query(f"WITH {_LATEST} SELECT status, status IN ('pending', 'escalate') AS is_open, count(*) AS n FROM ls GROUP BY ALL")
def open_closed_counts(s, d):
    return ld.status_counts(table(s, d, "events"))


@query(f"SELECT event_id, user_id, decision, c_name FROM (SELECT event_id, user_id, {_DECIDE} AS decision FROM events) JOIN customer ON user_id = c_custkey WHERE decision IS NOT NULL ORDER BY event_id DESC LIMIT 1000")
def audit_log_join(s, d):
    """The newest 1000 decisions: a report of that length."""
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return ld.audit_log(table(s, d, "events"), c, F.col("user_id") == F.col("c_custkey"), ["event_id", "user_id", "decision", "c_name"], 1000)


@query("""SELECT event_id, user_id FROM events e WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM events) OR event_id IN (SELECT event_id FROM events WHERE event_type = 'error')""")
def retention_purge(s, d):
    e = table(s, d, "events")
    return ld.purged(e, e.where("event_type = 'error'"), "event_id", "ts", 7).select("event_id", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type NOT IN ('click') AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0)")
def idempotent_enqueue(s, d):
    e = table(s, d, "events")
    return ld.enqueued(e.where("event_id % 3 = 0"), e.where("event_type <> 'click'").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 89 = 5 THEN ts - INTERVAL 2 DAY ELSE ts END AS ts FROM events UNION ALL SELECT event_id, ts FROM events WHERE event_id % 97 = 3)
SELECT event_id, 'repeated' AS fault FROM l GROUP BY event_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT event_id, 'time runs back' FROM (SELECT event_id, ts, max(ts) OVER (ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l) WHERE ts < b""")
def append_only_violations(s, d):
    """A log of the events in which some are written twice and some have an earlier time."""
    e = table(s, d, "events").select("event_id", "ts")
    late = e.withColumn("ts", F.when(F.col("event_id") % 89 == 5, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts")))
    return ld.violations(late.unionByName(e.where("event_id % 97 = 3")), "event_id", "event_id", "ts", 1000)


# --- vectors -------------------------------------------------------------------------------------------------------------

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_CENT = f"""{_UNIT}, m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY label, i),
cc AS (SELECT label, list(m ORDER BY i) AS c, max(n) AS n FROM m GROUP BY label), cent AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v, n FROM cc)"""
_TOP = f"""{_CENT}, sc AS (SELECT vec_id AS q, cent.label AS key, round(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * cent.v[i])), 6) AS score FROM u, cent WHERE vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM sc QUALIFY place <= 5)"""


def _centroids(s, d) -> DataFrame:
    return ev.centroids(table(s, d, "embeddings"), "label", "embedding")


def _top(s, d) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all centroids."""
    q = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), sm.unit(F.col("embedding")).alias("qv"))
    return ev.vector_top(q, _centroids(s, d).select(F.col("label").alias("key"), F.col("centroid").alias("v")), 5)


@query(f"WITH {_CENT} SELECT label, CAST(n AS BIGINT) AS n, round(v[1], 5) AS c1, round(v[len(v)], 5) AS c_last, round(list_sum(v), 5) AS total FROM cent")
def centroids(s, d):
    v = F.col("centroid")
    return _centroids(s, d).select("label", "n", F.round(v[0], 5).alias("c1"), F.round(F.element_at(v, -1), 5).alias("c_last"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {_TOP} SELECT q, key, round(score, 5) AS score, place FROM top")
def vector_topk(s, d):
    return _top(s, d).withColumn("score", F.round("score", 5))


_TOP_EVEN = """m2 AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u WHERE vec_id % 2 = 0) GROUP BY label, i), c2 AS (SELECT label, list(m ORDER BY i) AS c FROM m2 GROUP BY label),
e2 AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v FROM c2),
s2 AS (SELECT vec_id AS q, e2.label AS key, round(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * e2.v[i])), 6) AS score FROM u, e2 WHERE vec_id % 50 = 0), top2 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, key) <= 5)"""


@query(f"WITH {_TOP}, {_TOP_EVEN} SELECT q, key, round(greatest(0, least(1, sum(s))), 4) AS score FROM (SELECT q, key, score * 0.8::DOUBLE AS s FROM top UNION ALL SELECT q, key, score * 0.2::DOUBLE FROM top2) GROUP BY q, key")
def fused_score(s, d):
    """Centroids of all vectors, and those of every second one, as two indices."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), sm.unit(F.col("embedding")).alias("qv"))
    half = ev.centroids(e.where("vec_id % 2 = 0"), "label", "embedding").select(F.col("label").alias("key"), F.col("centroid").alias("v"))
    return ev.fused([(_top(s, d), 0.8), (ev.vector_top(q, half, 5), 0.2)])


@query(f"""WITH {_TOP}, l AS (SELECT *, round(score - coalesce(lead(score) OVER (PARTITION BY q ORDER BY place), 0), 6) AS margin FROM top)
SELECT q, key, round(score, 5) AS score, score >= 0.82 OR (score >= 0.75 AND margin >= 0.08) AS confident FROM l WHERE place = 1""")
def confident_margin(s, d):
    return ev.confident(_top(s, d)).select("q", "key", F.round("score", 5).alias("score"), "confident")


# --- extraction ----------------------------------------------------------------------------------------------------------

_PARA = rf"""pa AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), 1) - 1 AS nth FROM pages),
pt AS (SELECT page_id, nth, {_strip_sql('raw')} AS text FROM pa),
para AS (SELECT page_id, nth, text, CASE WHEN regexp_matches(text, '^["“«]') THEN 'quote' ELSE 'prose' END AS kind FROM pt WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id, substr(text, 1, 120) ORDER BY nth) = 1)"""


def _paras(s, d) -> DataFrame:
    return ev.paragraphs(table(s, d, "pages"))


@query(f"WITH {_PARA} SELECT page_id, CAST(nth AS BIGINT) AS nth, kind, text FROM para")
def paragraphs_kind(s, d):
    return _paras(s, d)


@query(f"WITH {_PARA} SELECT page_id, CAST(nth AS BIGINT) AS nth, lag(text) OVER w AS before, text, lead(text) OVER w AS after FROM para WINDOW w AS (PARTITION BY page_id ORDER BY nth)")
def neighbour_context(s, d):
    return ev.with_neighbours(_paras(s, d))


@query(f"""WITH {_PARA} SELECT page_id, CAST(nth AS BIGINT) AS nth FROM para WHERE length(text) >= 180 AND kind = 'prose' AND NOT regexp_matches(text, '["“”«»]') AND NOT regexp_matches(text, '[0-9]+\\s*:\\s*[0-9]+')""")
def negative_controls(s, d):
    return ev.negatives(_paras(s, d)).select("page_id", "nth")


@query("SELECT min(conv_id) AS conv_id, substr(text, 1, 80) AS opening, count(*) AS n FROM conversations GROUP BY substr(text, 1, 80)")
def dedupe_first(s, d):
    return table(s, d, "conversations").groupBy(F.substring("text", 1, 80).alias("opening")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))


# --- evaluation ----------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd, min(l_quantity) AS least, max(l_quantity) AS most, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag")
def metric_summary(s, d):
    return ev.summary(table(s, d, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(0.95 * (count(o_totalprice) - 1)) AS BIGINT) + 1] AS p FROM orders GROUP BY o_orderpriority")
def p95_nearest_rank(s, d):
    return ev.percentile(table(s, d, "orders"), "o_orderpriority", "o_totalprice")


@query("SELECT lang, count(*) AS n, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(100.0 * sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(*), 4) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def rates_rollup(s, d):
    return ev.rates(_docs(s, d).join(table(s, d, "labels"), "doc_id"), "lang", F.col("toxic") == 1)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 6")
def confusion_top(s, d):
    """The six largest cells: a report of that length."""
    return ev.confusion(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_quality, count(*) FILTER (quality = 0 AND toxic = 1) AS only_toxic, count(*) FILTER (quality = 1 AND toxic = 1) AS both FROM labels")
def paired_gain_loss(s, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = lambda x: F.count(F.when(x, 1))
    return table(s, d, "labels").agg(c(q & ~t).alias("only_quality"), c(~q & t).alias("only_toxic"), c(q & t).alias("both"))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id LIMIT 120")
def hash_sample(s, d):
    """120 documents in hash order: a sampling operator."""
    return ev.hash_sample(_docs(s, d), "doc_id", "7", 120).select("doc_id")


@query("""SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS VARCHAR) AS digest
FROM (SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(text, ''), coalesce(lang, ''))) AS h FROM documents)""")
def fingerprint(s, d):
    return ev.fingerprint(_docs(s, d), ["doc_id"], ["text", "lang"])


@query("SELECT doc_id, lang, nth FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) ORDER BY nth, lang LIMIT 120")
def stratified_round_robin(s, d):
    """The first of each language, then the second, until 120: a sampling operator."""
    return ev.round_robin(_docs(s, d), "lang", ["doc_id"], 120).select("doc_id", "lang", "nth")


# --- streams (extensions) ------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_window_counts(s, d):
    return st.window_counts(table(s, d, "events"))


@query(f"SELECT user_id, arg_max(x, event_id) AS status FROM (SELECT user_id, event_id, {_DECIDE} AS x FROM events) WHERE x IS NOT NULL GROUP BY user_id")
def latest_status_batch(s, d):
    return st.status(table(s, d, "events"))
