"""Queries of the gate and its guard, forms of words, terminology, and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folding as fd
from ..functions import text as tx
from ..operators import citations as ct
from ..operators import gate as gt
from ..operators import language as lg
from ..operators import passages as ps
from ..operators import terms as tm
from ..sources.tables import table
from . import catalogue as c
from .catalogue import query

# --- gate ----------------------------------------------------------------------------------------------------------------

_REASONS = f"{c._SENT}, gated AS (SELECT doc_id, nth, sentence, {gt.reasons_sql('sentence')} || CASE WHEN lang <> 'en' OR (len(regexp_extract_all(sentence, '\\p{{L}}')) > 0 AND 2 * len(regexp_extract_all(sentence, '\\p{{Latin}}')) < len(regexp_extract_all(sentence, '\\p{{L}}'))) THEN ['LANGUAGE_UNSCREENED'] ELSE [] END AS reasons FROM sent JOIN documents USING (doc_id))"


@query(f"WITH {_REASONS} SELECT doc_id, CAST(nth AS INTEGER) AS nth, array_to_string(reasons, ',') AS reasons FROM gated")
def lexical_gate_reasons(s, d):
    return gt.gated(table(s, d, "documents")).select("doc_id", "nth", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['OPEN'] ELSE reasons END) AS reason FROM gated) GROUP BY reason")
def gate_counts(s, d):
    reasons = F.when(F.size("reasons") == 0, F.array(F.lit("OPEN"))).otherwise(F.col("reasons"))
    return gt.gated(table(s, d, "documents")).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Sentences of each reason, with the reasons they must have.
EXAMPLES = (
    ("Eating pork is haram for the community here.", "NORMATIVE"),
    ("Do not eat before the sun has gone down.", "NORMATIVE"),
    ("The act is a sin that people regret later.", "NORMATIVE"),
    ("The market sold bread and olives all year long.", ""),
    ("He wrote “the market sold bread” in that letter.", "SCRIPTURE"),
    ("This is told in chapter 2:255 of that old book.", "REFERENCE"),
    ("The prophet said that the road would be long.", "REFERENCE,CREED"),
    ("It is better to travel early in the day.", "PREFERENCE"),
    ("The scholars differ about the date of the battle.", "ATTRIBUTION"),
    ("There is no god but the one who made it.", "CREED"),
    ("The answer depends on Him in every single case.", "CREED"),
    ("Muhammad, may the peace of God be upon him, was known for patience.", ""),
    ("A believer prays five times a day in summer.", "IMPLICIT_OBLIGATION"),
    ("Muslims prayed behind him that day, as was told.", ""),
    ("If rain falls the road to town is closed.", "CONDITIONAL"),
    ("They went home when it rained, and the shop closed.", "CONDITIONAL"),
    ("Verily the road was long and the night cold.", "SCRIPTURE_LIKE"),
    ("Too short.", "TOO_SHORT"),
    ("قال الناس يجب أن نذهب إلى البيت", "NORMATIVE"),
)
_VALUES = ", ".join("('" + s.replace("'", "''") + f"', '{r}')" for s, r in EXAMPLES)


@query(f"SELECT * FROM (VALUES {_VALUES}) AS t(sentence, reasons)")
def gate_examples(s, d):
    rows = s.createDataFrame([(x,) for x, _ in EXAMPLES], "sentence string")
    return rows.select("sentence", F.array_join(gt.reasons(F.col("sentence")), ",").alias("reasons"))


_SENT_DOCS = f"{c._SENT}, dw AS (SELECT doc_id * 1000000 + nth AS doc_id, {tx.tokens_sql('sentence')} AS w FROM sent)"


def _sents(s, d) -> DataFrame:
    return lg.sentences(table(s, d, "documents"))


@query(f"""WITH {_SENT_DOCS}, {c._PW}, {c._runs(gt.GUARD_RUN)}, {c._runs(ps.SMALL_RUN)}, {c._DF}, idf AS (SELECT token, greatest(0, ln((SELECT count(*) FROM rend)::DOUBLE / (1 + df))) AS idf FROM df),
tk AS (SELECT doc_id, unnest(list_distinct(w)) AS token FROM dw), al AS (SELECT doc_id, sum(idf) AS a FROM tk JOIN idf USING (token) GROUP BY doc_id),
hv AS (SELECT item_id, edition, unnest(list_distinct(w)) AS token FROM rw), cm AS (SELECT doc_id, item_id, edition, sum(idf) AS s FROM sh{ps.SMALL_RUN} JOIN tk USING (doc_id) JOIN hv USING (item_id, token) JOIN idf USING (token) GROUP BY ALL),
lk AS (SELECT doc_id FROM cm JOIN al USING (doc_id) GROUP BY doc_id HAVING round(max(CASE WHEN a > 0 THEN s / a ELSE 0 END), 6) >= {gt.GUARD_LIKENESS}), hit AS (SELECT doc_id FROM sh{gt.GUARD_RUN} UNION SELECT doc_id FROM lk)
SELECT doc_id // 1000000 AS doc_id, CAST(doc_id % 1000000 AS INTEGER) AS nth FROM hit""")
def guarded_sentences(s, d):
    """Sentences that the guard refuses: words of passages in a row, or nearly all of a rendering's weight."""
    return gt.guarded(_sents(s, d), c._rend(s, d)).where("guard IS NOT NULL").select("doc_id", "nth")


@query(f"WITH {c._SENT} SELECT 'SCRIPTURE_UNCHECKED' AS guard, count(*) AS n FROM sent")
def guard_without_index(s, d):
    """No index: nothing is let through."""
    return gt.guarded(_sents(s, d), None).groupBy("guard").agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"(WITH {_SENT_DOCS}, {c._PW}, {c._runs(n)} SELECT {n} AS run, (SELECT count(*) FROM sent) AS n, count(DISTINCT doc_id) AS labelled FROM sh{n})" for n in (4, 6, 8, 10)))
def guard_calibration(s, d):
    return gt.calibration(_sents(s, d), c._rend(s, d))


@query()
def adapted_documents(s, d):
    return gt.adapted_documents(gt.adapted(table(s, d, "documents"), c._rend(s, d)))


# --- forms of words ------------------------------------------------------------------------------------------------------

_TOKENS = f"lt AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{fd.LATIN_TOKEN.replace(chr(39), chr(39) * 2)}')) AS w FROM documents), tok AS (SELECT w FROM lt WHERE lower(w) NOT IN ('the', 'a', 'an'))"


def _key_sql(w: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace(translate(lower({w}), '{fd.MARKED[0]}', '{fd.MARKED[1]}'), '\\p{{M}}', '', 'g'), '{fd.ARTICLE}', '\\1'), '{fd.APOSTROPHES.replace(chr(39), chr(39) * 2)}', '', 'g')"
    for a, b in fd.DOUBLES:
        t = f"replace({t}, '{a}', '{b}')"
    return t


@query(f"""WITH {_TOKENS}, a AS (SELECT w, {_key_sql('w')} AS t FROM tok),
b AS (SELECT w, CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END AS t FROM a),
e AS (SELECT w, CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN t[:-4] WHEN length(t) > 4 AND t LIKE '%ed' THEN t[:-3] ELSE t END AS t FROM b),
f AS (SELECT w, CASE WHEN t = '' THEN '' ELSE array_to_string(list_filter(string_split(t, ''), lambda x, i: i = 1 OR x <> string_split(t, '')[i - 1]), '') END AS t FROM e)
SELECT w, CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]a[ht]$') THEN t[:-2] ELSE t END AS key FROM f""")
def latin_keys(s, d):
    """Each word's key without what spellings differ in."""
    return table(s, d, "documents").select(F.explode(fd.latin_tokens(F.col("text"))).alias("w")).distinct().select("w", fd.latin_key(F.col("w")).alias("key"))


@query(rf"""WITH {_TOKENS} SELECT w, lower(regexp_replace(regexp_replace(regexp_replace(w, '[''’‘`ʼ]s$', ''), '{fd.ARTICLE}', '\1'), '[''’‘`ʼ]', '''', 'g')) AS spelling,
regexp_matches(w, '{fd.TRANSLITERATED}') OR (regexp_extract(w, '\p{{L}}[''’‘`ʼ](\p{{L}}+)$', 1) <> '' AND lower(regexp_extract(w, '\p{{L}}[''’‘`ʼ](\p{{L}}+)$', 1)) NOT IN {fd.CONTRACTIONS}) AS foreign_shape FROM tok""")
def spelling_forms(s, d):
    rows = table(s, d, "documents").select(F.explode(fd.latin_tokens(F.col("text"))).alias("w")).distinct()
    return rows.select("w", fd.spelling(F.col("w")).alias("spelling"), fd.looks_transliterated(F.col("w")).alias("foreign_shape"))


#: Words and phrases of Arabic script, with their folded form, key and core.
ARABIC = (
    ("الصَّلَاةُ", "الصلاه", "الصلاه", "صلاه"),
    ("ٱلْحَمْدُ لِلَّهِ", "الحمد لله", "الحمدلله", "حمدلله"),
    ("إيمان", "ايمان", "ايمان", "ايمان"),
    ("موسى", "موسي", "موسي", "موسي"),
    ("(التوحيد) [١] آية", "ايه", "ايه", "ايه"),
    ("ـكتـاب", "كتاب", "كتاب", "كتاب"),
)
_ARABIC = ", ".join("('" + "', '".join(x) + "')" for x in ARABIC)


@query(f"SELECT * FROM (VALUES {_ARABIC}) AS t(text, folded, key, core)")
def arabic_forms(s, d):
    rows = s.createDataFrame([(x[0],) for x in ARABIC], "text string")
    return rows.select("text", fd.fold_arabic(F.col("text")).alias("folded"), fd.fold_key(F.col("text")).alias("key"), fd.core(fd.fold_key(F.col("text"))).alias("core"))


#: Words with clitics and suffixes, and cores that must be among their candidates.
CLITICS = (("والصلاة", "صلاة"), ("صلاته", "صلاة"), ("للمسلمين", "مسلم"), ("بالكتاب", "كتاب"), ("صدقات", "صدقة"), ("كبر", "كبر"), ("فبرسولهم", "رسول"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', true)" for w, _ in CLITICS) + ") AS t(word, found)")
def clitic_candidates(s, d):
    rows = s.createDataFrame(list(CLITICS), "word string, core string")
    return rows.select("word", F.array_contains(fd.candidates(fd.fold_term(F.col("word"))), F.col("core")).alias("found"))


_MARKED = "SELECT item_id, chr(8220) || text || chr(8221) || ' (Book ' || CAST(item_id % 114 + 1 AS VARCHAR) || ':' || CAST(item_id % 9 + 1 AS VARCHAR) || ').' AS t, '12. ' || text || ' [3] ____ note' AS r FROM benchmark"


@query(rf"""WITH m AS ({_MARKED}), q AS (SELECT item_id, trim(regexp_replace(t, '{fd.TRAILING_REFERENCE}', ''), ' ') AS bare, r FROM m)
SELECT item_id, bare, trim(bare, chr(8220) || chr(8221) || ' ') AS core, length(bare) >= 25 AS quote_like, {tx.collapse_sql(f"regexp_replace(regexp_replace(regexp_split_to_array(r, '_{{4,}}')[1], '{fd.FOOTNOTE_MARK}', ' ', 'g'), '{fd.LEADING_REFERENCE}', '')")} AS plain FROM q""")
def quotation_forms(s, d):
    """Passages in quotation marks with a citation behind, cut to what is quoted; and renderings cut to what was rendered."""
    p = table(s, d, "benchmark")
    n = lambda e: F.expr(f"CAST(item_id {e} AS STRING)")
    rows = p.select("item_id", F.concat(F.lit("“"), "text", F.lit("” (Book "), n("% 114 + 1"), F.lit(":"), n("% 9 + 1"), F.lit(").")).alias("t"), F.concat(F.lit("12. "), "text", F.lit(" [3] ____ note")).alias("r"))
    rows = rows.select("item_id", fd.strip_trailing_reference(F.col("t")).alias("bare"), "r")
    return rows.select("item_id", "bare", fd.strip_quote_marks(F.col("bare")).alias("core"), fd.looks_like_quote(F.col("bare")).alias("quote_like"), fd.clean_rendering(F.col("r")).alias("plain"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(trim(text, ' '), '^[-–—:•· ]+', '') AS t FROM documents), x AS (SELECT doc_id, t, t[:300] AS cut FROM t),
k AS (SELECT *, 301 - strpos(reverse(cut), '.') AS pos FROM x)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN contains(cut, '.') AND pos > 151 THEN trim(cut[:pos], ' ') ELSE rtrim(cut, ' ') || '…' END AS short FROM k""")
def shortened_texts(s, d):
    return table(s, d, "documents").select("doc_id", fd.shortened(F.col("text")).alias("short"))


@query("SELECT event_id, least(3600.0, 60.0 * pow(2.0, event_id % 9)) AS wait FROM events")
def retry_waits(s, d):
    return table(s, d, "events").select("event_id", fd.retry_after(60.0, (F.col("event_id") % 9 + 1)).alias("wait"))


# --- terminology ---------------------------------------------------------------------------------------------------------

_BOTH = f"""cv AS (SELECT conv_id AS doc_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS source, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'user'), '') AS text FROM conversations GROUP BY conv_id),
cw AS (SELECT doc_id, {tx.tokens_sql('source')} AS sw, {tx.tokens_sql('text')} AS tw FROM cv),
sb AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) - 1 AS r FROM (SELECT unnest(list_transform(range(1, len(sw)), lambda i: sw[i] || ' ' || sw[i + 1])) AS p FROM cw) GROUP BY p QUALIFY r < 24),
tb AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) - 1 AS r FROM (SELECT unnest(list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1])) AS p FROM cw) GROUP BY p QUALIFY r < 72),
tu AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) - 1 AS r FROM (SELECT unnest(tw) AS p FROM cw) GROUP BY p QUALIFY r < 24),
rec AS (SELECT r, r // 2 * 2 AS base, r % 5 = 0 AS ambiguous, r % 2 = 0 AS scan_alone, r = 22 AS wrong FROM sb),
terms AS (SELECT sb.p AS term_id, bool_or(rec.ambiguous) AS ambiguous, bool_or(rec.scan_alone) AS scan_alone FROM rec JOIN sb ON sb.r = rec.base WHERE NOT wrong GROUP BY sb.p),
fm AS (SELECT sb.p AS term_id, f.kind, f.form, min((rec.r, f.nth)) AS place FROM rec JOIN sb ON sb.r = rec.base JOIN (SELECT r, 0 AS nth, 'approved' AS kind, p AS form FROM tb WHERE r % 3 <> 1 UNION ALL SELECT r, 1, 'translit', p FROM tu
  UNION ALL SELECT r - 24, 2, 'discouraged', p FROM tb UNION ALL SELECT r - 48, 3, 'unattested', p FROM tb UNION ALL SELECT r - 1, 4, 'discouraged', p FROM tb) f ON f.r = rec.r WHERE NOT wrong GROUP BY sb.p, f.kind, f.form)"""


def _conversations(s, d) -> DataFrame:
    """(doc_id, sw, tw): the users' words of each conversation as a source, the others' as its translation."""
    side = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    rows = table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(side(F.col("role") == "user").alias("source"), side(F.col("role") != "user").alias("text"))
    return rows.select("doc_id", tx.tokens(F.col("source")).alias("sw"), tx.tokens(F.col("text")).alias("tw"), "text")


def _common(rows: DataFrame, words: str, n: int, most: int) -> DataFrame:
    """(p, r): the most frequent runs of n words, with their rank from 0."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.slice(words, i, n))
    top = rows.where(F.size(words) >= n).select(F.explode(runs).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.array_join("p", " ")).limit(most)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.array_join("p", " ").alias("t"), "p"))).alias("a"))  # at most `most` rows
    return ranked.select(F.posexplode("a").alias("r", "x")).select(F.col("x.p").alias("p"), "r")


def _glossary(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, terms and glossary: each second frequent pair of source words names two records, which merge; frequent words and
    pairs of the translations are renderings of several kinds."""
    rows = _conversations(s, d)
    source, pairs, single = _common(rows, "sw", 2, 24), _common(rows, "tw", 2, 72), _common(rows, "tw", 1, 24)
    form = lambda t, shift, nth, kind: t.select((F.col("r") - shift).alias("r"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), F.col("p").alias("form"))
    forms = form(pairs.where("r % 3 <> 1"), 0, 0, "approved")
    for part in (form(single, 0, 1, "translit"), form(pairs, 24, 2, "discouraged"), form(pairs, 48, 3, "unattested"), form(pairs, 1, 4, "discouraged")):
        forms = forms.unionByName(part)
    lists = forms.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("nth", "kind", "form"))).alias("forms"))
    base = source.select(F.col("r").alias("base"), F.col("p").alias("source"))
    records = source.select(F.col("r").alias("record_id"), F.expr("r div 2 * 2").alias("base")).join(base, "base").join(lists.withColumnRenamed("r", "record_id"), "record_id")
    r = F.col("record_id")
    terms, glossary = tm.merged(records.select("record_id", "source", r.alias("rank"), (r == 22).alias("wrong_sense"), (r % 5 == 0).alias("ambiguous"), (r % 2 == 0).alias("scan_alone"), "forms"))
    return rows, terms, glossary


@query(f"WITH {_BOTH} SELECT term_id, kind, form, CAST(row_number() OVER (PARTITION BY term_id, kind ORDER BY place) AS INTEGER) AS nth, ambiguous, scan_alone FROM fm JOIN terms USING (term_id)")
def glossary_merged(s, d):
    from pyspark.sql import Window

    _, terms, glossary = _glossary(s, d)
    nth = F.row_number().over(Window.partitionBy("term_id", "kind").orderBy("place"))
    return glossary.withColumn("nth", nth).join(terms.select("term_id", "ambiguous", "scan_alone"), "term_id").select("term_id", "kind", F.array_join("form", " ").alias("form"), "nth", "ambiguous", "scan_alone")


_SOURCE = """sh AS (SELECT doc_id, term_id, i - 1 AS start, i + 1 AS stop FROM (SELECT doc_id, sw, unnest(range(1, len(sw))) AS i FROM cw WHERE len(sw) > 1) JOIN terms ON term_id = sw[i] || ' ' || sw[i + 1]),
tk AS (SELECT doc_id, term_id, start, stop FROM sh QUALIFY start = min(start) OVER (PARTITION BY doc_id) UNION ALL
 SELECT h.doc_id, h.term_id, h.start, h.stop FROM tk JOIN sh h ON h.doc_id = tk.doc_id AND h.start = (SELECT min(start) FROM sh z WHERE z.doc_id = tk.doc_id AND z.start >= tk.stop)),
present AS (SELECT doc_id, term_id, count(*) AS times, min(start) AS "first" FROM tk GROUP BY doc_id, term_id)"""


@query(f'WITH RECURSIVE {_BOTH}, {_SOURCE} SELECT doc_id, term_id, times, CAST("first" AS BIGINT) AS "first" FROM present')
def source_term_scan(s, d):
    rows, terms, _ = _glossary(s, d)
    return tm.source_terms(rows, "sw", terms)


_RENDERED = """rh AS (SELECT doc_id, term_id, kind, form, start, start + n AS stop FROM (SELECT doc_id, n, i - 1 AS start, array_to_string(tw[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, tw, n, unnest(range(1, len(tw) - n + 2)) AS i FROM cw, (VALUES (1), (2)) v(n) WHERE len(tw) >= n))
 JOIN fm ON form = g QUALIFY row_number() OVER (PARTITION BY doc_id, term_id, kind, start ORDER BY n DESC) = 1)"""


@query(f'WITH {_BOTH}, {_RENDERED} SELECT doc_id, term_id, kind, form, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end" FROM rh')
def rendering_hits(s, d):
    rows, _, glossary = _glossary(s, d)
    return tm.rendering_hits(rows, "tw", glossary)


_BILINGUAL = f"""{_BOTH}, {_SOURCE}, {_RENDERED}, mine AS (SELECT rh.* FROM rh SEMI JOIN present USING (doc_id, term_id)), good AS (SELECT * FROM mine WHERE kind IN ('approved', 'translit')),
bad AS (SELECT * FROM mine m WHERE kind = 'discouraged' AND NOT EXISTS (SELECT 1 FROM good g WHERE g.doc_id = m.doc_id AND g.form = m.form AND g.term_id <> m.term_id)),
st AS (SELECT p.doc_id, p.term_id, b.f AS bf, g.f AS gf, o.f AS of, t.ambiguous, EXISTS (SELECT 1 FROM fm WHERE fm.term_id = p.term_id AND kind = 'approved') AS known FROM present p JOIN terms t USING (term_id)
 LEFT JOIN (SELECT doc_id, term_id, arg_min(form, (start, form)) AS f FROM bad GROUP BY ALL) b USING (doc_id, term_id) LEFT JOIN (SELECT doc_id, term_id, arg_min(form, (start, form)) AS f FROM good GROUP BY ALL) g USING (doc_id, term_id)
 LEFT JOIN (SELECT doc_id, term_id, arg_min(form, (start, form)) AS f FROM mine WHERE kind = 'unattested' GROUP BY ALL) o USING (doc_id, term_id)),
bi AS (SELECT doc_id, term_id, CASE WHEN bf IS NOT NULL THEN 'VARIANT' WHEN gf IS NOT NULL THEN 'APPROVED' WHEN of IS NOT NULL THEN 'VARIANT' WHEN ambiguous THEN NULL WHEN NOT known THEN 'NOT_IN_GLOSSARY' ELSE 'MISSING' END AS status, coalesce(bf, gf, of) AS found FROM st)"""


def _bilingual(s, d) -> DataFrame:
    rows, terms, glossary = _glossary(s, d)
    return tm.bilingual(tm.source_terms(rows, "sw", terms), tm.rendering_hits(rows, "tw", glossary), terms, glossary)


@query(f"WITH RECURSIVE {_BILINGUAL} SELECT * FROM bi WHERE status IS NOT NULL")
def term_status_bilingual(s, d):
    return _bilingual(s, d)


@query(f"WITH RECURSIVE {_BILINGUAL} SELECT term_id, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'VARIANT') AS variant, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'NOT_IN_GLOSSARY') AS not_in_glossary, count(*) AS total FROM bi WHERE status IS NOT NULL GROUP BY term_id ORDER BY total DESC, term_id LIMIT 40")
def term_tally(s, d):
    return tm.tally(_bilingual(s, d))


@query(f"""WITH RECURSIVE {_BOTH}, {_SOURCE}, {_RENDERED}, k AS (SELECT doc_id, term_id, arg_min(form, (start, form)) AS f FROM rh WHERE kind = 'translit' GROUP BY ALL)
SELECT doc_id, term_id, CASE WHEN f IS NOT NULL THEN 'APPROVED' ELSE 'NOT_IN_GLOSSARY' END AS status, f AS found FROM present JOIN terms USING (term_id) LEFT JOIN k USING (doc_id, term_id) WHERE f IS NOT NULL OR NOT ambiguous""")
def term_status_other_language(s, d):
    rows, terms, glossary = _glossary(s, d)
    return tm.other_language(tm.source_terms(rows, "sw", terms), tm.rendering_hits(rows, "tw", glossary), terms, F.lit(True))


@query(f"""WITH {_BOTH}, {_RENDERED}, al AS (SELECT rh.*, start // 12 AS s FROM rh JOIN terms USING (term_id) WHERE scan_alone), named AS (SELECT DISTINCT doc_id, term_id, s FROM al WHERE kind = 'translit'),
red AS (SELECT DISTINCT doc_id, term_id FROM al SEMI JOIN named USING (doc_id, term_id, s) WHERE kind = 'discouraged')
SELECT doc_id, term_id, CASE WHEN bool_or(red.term_id IS NOT NULL) OR count(*) FILTER (kind = 'unattested') > 0 OR count(DISTINCT form) FILTER (kind = 'translit') > 1 THEN 'VARIANT' ELSE 'APPROVED' END AS status, count(DISTINCT form) FILTER (kind = 'translit') AS spellings
FROM al LEFT JOIN red USING (doc_id, term_id) WHERE kind IN ('translit', 'unattested') GROUP BY doc_id, term_id""")
def term_consistency(s, d):
    """Translations without their source; twelve words count as a sentence."""
    rows, terms, glossary = _glossary(s, d)
    hits = tm.rendering_hits(rows, "tw", glossary).withColumn("spelling", F.col("form"))
    return tm.consistency(hits, F.floor(F.col("start") / 12), terms)


@query(f"WITH {_BOTH} SELECT term_id, form AS surface FROM fm JOIN terms USING (term_id) WHERE kind = 'translit' AND scan_alone AND length(form) >= 3")
def frozen_terms(s, d):
    _, terms, glossary = _glossary(s, d)
    return tm.clarity_entries(terms, glossary)


# --- citations -----------------------------------------------------------------------------------------------------------

_FORMS = "CASE item_id % 4 WHEN 0 THEN ' (Quran ' || a || ':' || b || ').' WHEN 1 THEN ' [an-Nahl ' || a || ':' || b || '-7] and (Bukhari 1:23)' WHEN 2 THEN ' (' || a || ':' || b || ') see Surah 4: 12' ELSE ' ( Sad ' || a || ' : ' || b || ') and [200:1]' END"
_FORMED = f"f AS (SELECT item_id, text || {_FORMS} AS t FROM (SELECT item_id, text, CAST(item_id % 120 + 1 AS VARCHAR) AS a, CAST(item_id % 200 + 1 AS VARCHAR) AS b FROM benchmark))"


def _formed(s, d) -> DataFrame:
    a, b = F.expr("CAST(item_id % 120 + 1 AS STRING)"), F.expr("CAST(item_id % 200 + 1 AS STRING)")
    n = F.col("item_id") % 4
    form = F.when(n == 0, F.concat(F.lit(" (Quran "), a, F.lit(":"), b, F.lit(").")))
    form = form.when(n == 1, F.concat(F.lit(" [an-Nahl "), a, F.lit(":"), b, F.lit("-7] and (Bukhari 1:23)")))
    form = form.when(n == 2, F.concat(F.lit(" ("), a, F.lit(":"), b, F.lit(") see Surah 4: 12")))
    form = form.otherwise(F.concat(F.lit(" ( Sad "), a, F.lit(" : "), b, F.lit(") and [200:1]")))
    return table(s, d, "benchmark").select("item_id", F.concat("text", form).alias("text"))


def _found_sql(name: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT item_id, stop - length(whole) AS start, stop, CAST(a AS INTEGER) AS chapter, b, whole FROM (SELECT *, sum(length(piece) + length(whole)) OVER (PARTITION BY item_id ORDER BY nth) AS stop FROM (
 SELECT item_id, unnest(range(len(regexp_extract_all(t, '{p}')))) AS nth, unnest(regexp_extract_all(t, '{p}')) AS whole, unnest(regexp_extract_all(t, '{p}', 1)) AS a, unnest(regexp_extract_all(t, '{p}', 2)) AS b, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS piece FROM f))
 WHERE CAST(a AS INTEGER) BETWEEN 1 AND {lg.CHAPTERS} AND CAST(b AS INTEGER) BETWEEN 1 AND {lg.VERSES})"""


_CITED = f"""{_FORMED}, {_found_sql('la', ct.LATIN)}, {_found_sql('ba', ct.BARE)}, {_found_sql('na', ct.NAMED)}, pl AS (SELECT * FROM la UNION ALL SELECT * FROM ba),
al AS (SELECT * FROM pl UNION ALL SELECT * FROM na x WHERE NOT regexp_matches(whole, '{ct.OTHER_SOURCE.replace(chr(39), chr(39) * 2)}') AND NOT EXISTS (SELECT 1 FROM pl y WHERE x.item_id = y.item_id AND y.start < x.stop AND x.start < y.stop)),
e AS (SELECT *, regexp_extract(whole, '[-–—]\\s*([0-9]{{1,3}})\\s*[)\\]]$', 1) AS e FROM al),
cited AS (SELECT DISTINCT item_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", chapter, CAST(b AS INTEGER) AS verse, greatest(CAST(b AS INTEGER), CAST(CASE WHEN e = '' THEN b WHEN length(e) < length(b) THEN b[:length(b) - length(e)] || e ELSE e END AS INTEGER)) AS "last" FROM e)"""


@query(f"WITH {_CITED} SELECT * FROM cited")
def citation_extents(s, d):
    """Citations of several forms behind each passage, with their characters."""
    return ct.citations(_formed(s, d), "item_id")


_NEAR = f"""o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey % 3 = 0 AS l FROM orders),
n AS (SELECT a.o_custkey, a.o_orderkey AS left_id, b.o_orderkey AS right_id, CASE WHEN b.day <= a.day THEN 'before' ELSE 'after' END AS side, abs(a.day - b.day) AS distance FROM o a JOIN o b USING (o_custkey) WHERE a.l AND NOT b.l)"""


@query(f"WITH {_NEAR} SELECT o_custkey, left_id, right_id, side, distance FROM n WHERE distance <= {ct.BACK} QUALIFY row_number() OVER (PARTITION BY o_custkey, left_id ORDER BY side = 'after', distance, right_id) = 1")
def nearest_span(s, d):
    """For each third order the customer's other order that is nearest to it, an earlier one if there is one."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", day.alias("start"), day.alias("end"))
    third = F.col("o_orderkey") % 3 == 0
    return ct.nearest(o.where(third).withColumnRenamed("o_orderkey", "left_id"), o.where(~third).withColumnRenamed("o_orderkey", "right_id"), "o_custkey", ct.BACK)
