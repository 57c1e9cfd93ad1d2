"""The gate that leaves a sentence as it is: every reason for which it must not be rewritten, and what is built on it: quoted
parts, a guard against approved wording that fails safe, adaptation of sentences with rollback, and the gate's rates.

All tests are patterns over whole sentences, as columns. Words are matched between characters that are no letters, digits or
underscores, written without look-around, so that Java's and RE2's patterns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.store import written
from . import language as lg
from . import passages as ps
from . import rewrite as rw

# Words and phrases by which a sentence is refused, by reason; and those without word boundaries, of Arabic script.
NORMATIVE = (
    r"must|shall|should|ought|has\s+to|have\s+to|needs?\s+to|(?:is|are)\s+to\s+be|may\s+not|may\s+only|"
    r"oblig\w*|compulsor\w*|mandat\w*|requir\w*|duty|duties|incumbent|binding|enjoin\w*|ordain\w*|prescri(?:be|bed|bes|ption)|"
    r"forbid\w*|forbade|prohibit\w*|impermissib\w*|permissib\w*|permit(?:s|ted)?|allow(?:s|ed|able)?|disallow\w*|"
    r"lawful\w*|unlawful\w*|illicit|licit|illegal|(?:is|are)\s+(?:strongly\s+)?(?:encouraged|discouraged)|"
    r"disliked|reprehensible|blameworthy|praiseworthy|condemn\w*|exempt\w*|sin|sins|sinful\w*|sinned|sinning|sinners?|punish\w*|"
    r"haram|haraam|halal|halaal|makruh|makrooh|mustahabb?|mandub|mubah|wajib|fard|fardh|farz|sunnah\s+mu'?akkadah|it\s+is\s+(?:a\s+)?sunnah|"
    r"it\s+is\s+(?:not\s+)?valid|invalid\w*|void|nullif\w*|annul\w*|breaks?\s+(?:the|one's|his|her|their)\s+(?:fast|ablution|wudu|prayer)|"
    r"it\s+is\s+(?:not\s+)?(?:right|wrong|correct|incorrect|acceptable|unacceptable|appropriate|inappropriate|proper|improper)\s+(?:to|for)|ruling|rulings"
)
NORMATIVE_START = r"^\s*(?:do\s+not|don't|never)(?:$|[^\w])"
NORMATIVE_AR = r"يجب|لا\s*يجوز|يجوز|حرام|محرم|واجب|فرض|مكروه|مستحب|مباح|ينبغي|لا\s*ينبغي|يحرم|يلزم|على\s*المسلم(?:ة)?\s*أن|إثم|ذنب|معصية"
PREFERENCE = (
    r"it\s+is\s+better|better\s+to|preferable|preferred|recommended|the\s+best|best\s+of|superior\s+to|greater\s+(?:than|reward)|"
    r"more\s+beloved|most\s+beloved|more\s+virtuous|most\s+virtuous|takes\s+precedence"
)
PREFERENCE_AR = r"أفضل|الأفضل|خير\s*من|أحب\s*إلى|الأولى\s*أن|يُستحسن"
REFERENCE = (
    r"(?:qur'?an|quran|surah|surat|sura|chapter)\s*[\s:,]?\s*\d{1,3}\s*[:.]\s*\d{1,3}|q\.?\s*\d{1,3}\s*[:.]\s*\d{1,3}|(?:narrated|reported)\s+by|"
    r"(?:sahih\s+)?(?:al-?)?(?:bukhari|muslim|tirmidhi|abu\s+dawud|nasa'?i|ibn\s+majah|ahmad|malik|muwatta)|hadith\s+(?:no\.?|number)\s*\d+|"
    r"verses?|ayahs?|ayat|hadiths?|ahadith"
)
REFERENCE_ANY = r"\[\s*\d{1,3}\s*[:.]\s*\d{1,3}\s*\]|\(\s*\d{1,3}\s*[:.]\s*\d{1,3}\s*\)|رواه|أخرجه|متفق\s*عليه|صحيح\s*(?:البخاري|مسلم)|\[\s*[^\]]*?\s*:\s*\d{1,3}\s*\]|قال\s*(?:تعالى|الله|رسول|النبي)"
SPEAKERS = r"qur'?an|qur’an|koran|bible|torah|gospels?|injil|scriptures?|prophet|messenger|allah|god|lord"
SAYING = (
    r"says|said|saying|states|stated|tells|told|teaches|taught|mentions|mentioned|declares|declared|reports|reported|narrates|narrated|"
    r"records|recorded|describes|described|reminds|addresses|commands|commanded|forbids|forbade|promises|promised|warns|warned"
)
#: Between speaker and verb: up to three words, a bracket, a clause between commas, an adverb.
FRAMED = rf"(?:{SPEAKERS})(?:\s+[\w’']+){{0,3}}(?:\s*\([^)]{{0,60}}\))?(?:\s*,[^,]{{0,90}},)?\s+(?:also\s+|clearly\s+|himself\s+|itself\s+)?(?:{SAYING})"
ATTRIBUTION = (
    r"hanafi|maliki|shafi'?i|hanbali|zahiri|the\s+(?:four\s+)?(?:schools?|madhhab|madhahib|jurists|scholars|fuqaha|ulama|'?ulama'?)|"
    r"(?:imam|shaykh|sheikh|ibn|al-)\w*\s+\w+\s+(?:held|holds|said|states|ruled|argued|is\s+of\s+the\s+(?:view|opinion))|"
    r"according\s+to\s+(?:the\s+)?(?:majority|imam|shaykh|sheikh|scholars)|scholars\s+(?:differ|differed|agree|agreed|hold|held)|consensus|ijma'?"
)
ATTRIBUTION_AR = r"المذهب|الحنفية|المالكية|الشافعية|الحنابلة|جمهور\s*العلماء|الإجماع"
CREED = (
    r"the\s+six\s+(?:articles|pillars)\s+of\s+(?:faith|iman)|(?:the\s+five\s+)?pillars?\s+of\s+(?:islam|faith|iman)|the\s+five\s+pillars|"
    r"articles?\s+of\s+(?:islamic\s+)?(?:faith|belief)|whoever|whosoever|is\s+(?:an?\s+)?(?:disbeliever|kafir|kufr|shirk|bid'?ah|innovation)|"
    r"(?:leaves?|left)\s+the\s+fold|out\s+of\s+(?:the\s+fold\s+of\s+)?islam|takes\s+one\s+out\s+of\s+islam|"
    r"allah|god|gods|god's|god’s|lord|lords|creator|almighty|divin\w*|deity|deities|oneness|monothe\w*|polythe\w*|idol\w*|"
    r"worthy\s+of\s+worship|partners?\s+(?:with|to|unto|in|besides)|associat\w*\s+(?:partners|others|anything|anyone|any\s+\w+)\s+with|"
    r"associates?\s+in\s+worship|partners?\s+or\s+associates?|no\s+(?:partners?|associates?|equals?|rivals?|consort)|"
    r"creat\w*\s+(?:the\s+)?(?:universe|heavens?|earth|world|mankind|man|humans?|human\s+beings|everything|all\s+things)|"
    r"shirk|kufr|kafir\w*|disbelie\w*|unbelie\w*|infidel\w*|apostas\w*|apostate\w*|blasphem\w*|testimony\s+of\s+faith|shahadah?|"
    r"prophethood|(?:final|last|seal\s+of\s+the)\s+(?:prophet|messenger)s?|(?:prophet|messenger|apostle)s?\s+of\s+(?:allah|god|islam)|"
    r"prophets?|messengers?|apostles?|gabriel|jibr[ae]el|jibril|revelation\w*|reveal\w*|scriptures?|sent\s+down|word\s+of\s+(?:god|allah)|miracle\w*|"
    r"paradise|heaven\w*|hell|hells|hellfire|jannah|jahannam|hereafter|afterlife|after\s+death|resurrect\w*|"
    r"day\s+of\s+(?:judg\w*|resurrection|reckoning|recompense|rising)|judg(?:e)?ment\s+day|angel\w*|archangel\w*|jinn|satan\w*|devil\w*|"
    r"shaytan|iblis|unseen|soul|souls|decree\w*|predestin\w*|destiny|qadar|reward\w*|recompense|"
    r"crucif\w*|son\s+of\s+god|trinit\w*|triune|begotten|incarnat\w*|atonement|original\s+sin|messiah|raised\s+(?:him\s+|them\s+)?up|"
    r"islam\s+(?:teaches|holds|affirms|maintains|says|requires|forbids|permits|considers|regards|specifies|views|sees|lays|stresses)|"
    r"in\s+islam|according\s+to\s+islam|islamic\s+(?:doctrine|belief|creed|faith|law|teaching|teachings)"
)
CREED_AR = r"كفر|شرك|بدعة|من\s*أنكر|من\s*جحد|يخرج\s*من\s*الملة|الله|إله|الرب|ربك|ربه|ربهم|الجنة|النار|الآخرة|القيامة|الملائكة|الوحي|نبي|رسول|الغيب|القدر"
_BLESSING = r"(?:peace|mercy|blessings?|salutations?)"
HONORIFIC = (
    rf"\(?\s*(?:may\s+)?(?:the\s+)?{_BLESSING}(?:\s*,?\s*(?:and\s+)?(?:the\s+)?{_BLESSING})*\s+of\s+(?:god|allah)\s+be\s+(?:up)?on\s+(?:him|her|them|you)\s*\)?|"
    r"\(?\s*(?:may\s+)?(?:god|allah)\s+(?:bless\s+him\s+and\s+grant\s+him\s+peace|be\s+pleased\s+with\s+(?:him|her|them))\s*\)?|\(?\s*peace\s+be\s+upon\s+(?:him|her|them)\s*\)?"
)
#: Every form of an honorific has one of these.
HONORIFIC_WORD = "(?i)peace|mercy|blessing|salutation|bless|pleased"
DIVINE = r"He|Him|His|Himself|Fire|Garden|Gardens|Hour|Hereafter|Throne|Unseen"
DIVINE_START = r"He|His|Fire|Garden|Gardens|Hour|Hereafter|Throne|Unseen"
ARCHAIC = r"thee|thou|thy|thine|ye|hath|doth|unto|verily|saith|shalt|hast|dost|wouldst|couldst|shouldst|art\s+thou|lo"
CONDITION = (
    r"if|when|whenever|unless|until|whoever|whosoever|whomever|except|provided|providing|as\s+long\s+as|so\s+long\s+as|"
    r"on\s+condition|in\s+case|only\s+if|even\s+if|otherwise|lest"
)
CONDITION_AR = r"إذا|إلا|ما\s*دام|بشرط|شريطة|كلما|لولا"
QUOTE_PAIRS = ('""', "''", "“”", "‘’", "«»", "﴾﴿", "‹›")
SUBJECT = (
    r"muslim|muslims|believer|believers|worshipper|worshippers|one|woman|women|man|men|girl|girls|boy|boys|husband|husbands|wife|wives|"
    r"parent|parents|father|fathers|mother|mothers|child|children|son|sons|daughter|daughters|person|people|everyone|"
    r"pilgrim|pilgrims|travell?er|travell?ers|imam|adult|adults|guardian|guardians|heir|heirs"
)
HABIT = (
    r"prays?|fasts?|gives?|pays?|performs?|makes?|observes?|recites?|faces?|wash|washes|abstains?|refrains?|wears?|covers?|avoids?|"
    r"undertakes?|completes?|repeats?|begins?|ends?|lowers?|keeps?|obeys?|provides?|stays?|remains?|marry|marries|divorces?|inherits?|offers?|"
    r"bows?|prostrates?|says?|reads?|eats?|drinks?|goes|go|visits?|teach|teaches|learns?|seeks?|greets?|follows?|spends?|distributes?|"
    r"slaughters?|sacrifices?|shaves?|trims?|grows?|returns?|leaves?|stands?|sits?|uses?|takes?|supports?|maintains?|serves?|honou?rs?|respects?|protects?"
)
PAST = r"was|were|had|did|used\s+to"
#: Words behind a subject in which its verb is looked for; share of Latin letters below which a sentence is not screened; languages
#: that are; least run of words in common with a passage, and least likeness, that the guard refuses.
REACH, LATIN, SCREENED, GUARD_RUN, GUARD_LIKENESS = 8, 0.5, ("en",), 6, 0.95
REASONS = ("SCRIPTURE", "REFERENCE", "NORMATIVE", "PREFERENCE", "ATTRIBUTION", "CREED", "IMPLICIT_OBLIGATION", "CONDITIONAL", "SCRIPTURE_LIKE", "TOO_SHORT")
_EDGE, _EDGE_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def word(pattern: str, case: bool = False) -> str:
    """The alternatives as whole words; \\w stands for letters, digits and underscores."""
    return ("" if case else "(?i)") + _EDGE + "(?:" + pattern.replace(r"\w", r"[\p{L}\p{N}_]") + ")" + _EDGE_END


_FIRST_WORD = r"^[\s\"“‘'(\[]*(?:" + DIVINE_START + r")(?:$|[^\p{L}\p{N}_])"
_START = r"(?i)^\s*[\"“‘'(\[]*(?:(?:and|but|so|yet|or)\s+)?(?:" + CONDITION + "|once)" + _EDGE_END
_COMMA = r"(?i)[,;:]\s*(?:(?:and|but|or)\s+)?(?:" + CONDITION + ")" + _EDGE_END
_BEFORE = "(?is)" + _EDGE + "(?:" + CONDITION + r")[^\p{L}\p{N}_].*,\s+(?:and|but|so|yet)" + _EDGE_END
_BEFORE_AT = "(?is)" + _EDGE + "(?:" + CONDITION + r"),\s+(?:and|but|so|yet)" + _EDGE_END


def quoted(s: Column) -> Column:
    """A balanced pair of quotation marks, apostrophes within words left out."""
    s = F.regexp_replace(s, r"(?<=\p{L})['’‘`ʼ](?=\p{L})", "")
    count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    tests = [count(o) >= 2 if o == c else (count(o) > 0) & (count(c) > 0) for o, c in QUOTE_PAIRS]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def implicit(s: Column) -> Column:
    """A role followed within REACH words by a habitual verb, and by no past auxiliary: an obligation told as a description."""
    near = lambda w, i: F.array_join(F.slice(w, i + 1, F.lit(REACH)), " ")
    one = lambda w, i: F.element_at(w, i).rlike(word(SUBJECT)) & near(w, i).rlike(word(HABIT)) & ~near(w, i).rlike(word(PAST))
    # the words are split once, as the item of an array, and only where a role and a verb stand at all
    found = F.exists(F.array(F.split(s, r"\s+")), lambda w: F.exists(F.sequence(F.lit(1), F.size(w)), lambda i: one(w, i)))
    return s.rlike(word(SUBJECT)) & s.rlike(word(HABIT)) & found


def tests(sentence: Column) -> dict[str, Column]:
    """Whether each reason of REASONS holds, by its name."""
    s = F.trim(F.coalesce(sentence, F.lit("")))
    topic = F.when(s.rlike(HONORIFIC_WORD), F.regexp_replace(s, "(?i)" + HONORIFIC, " ")).otherwise(s)
    divine = F.regexp_replace(topic, _FIRST_WORD, " ")
    return {
        "SCRIPTURE": quoted(s),
        "REFERENCE": s.rlike(word(REFERENCE)) | s.rlike("(?i)" + REFERENCE_ANY) | s.rlike(word(FRAMED)),
        "NORMATIVE": s.rlike(word(NORMATIVE)) | s.rlike("(?i)" + NORMATIVE_START) | s.rlike(NORMATIVE_AR),
        "PREFERENCE": s.rlike(word(PREFERENCE)) | s.rlike(PREFERENCE_AR),
        "ATTRIBUTION": s.rlike(word(ATTRIBUTION)) | s.rlike(ATTRIBUTION_AR),
        "CREED": topic.rlike(word(CREED)) | s.rlike(CREED_AR) | divine.rlike(word(DIVINE, case=True)),
        "IMPLICIT_OBLIGATION": implicit(s),
        "CONDITIONAL": s.rlike(CONDITION_AR) | s.rlike(_START) | s.rlike(_COMMA) | s.rlike(_BEFORE) | s.rlike(_BEFORE_AT),
        "SCRIPTURE_LIKE": s.rlike(word(ARCHAIC)),
        "TOO_SHORT": F.size(F.filter(F.split(s, r"\s+"), lambda x: x != "")) < lg.TOO_SHORT,
    }


def reasons(sentence: Column) -> Column:
    """All lexical reasons to leave a sentence as it is, in the order of REASONS; none for null."""
    found = tests(sentence)
    return F.array_compact(F.array(*[F.when(found[r], F.lit(r)) for r in REASONS]))


def refused(sentence: Column, lang: Column) -> Column:
    """Whether a sentence has any reason, of its words or its language: what is cheap to tell is told first, and the first ends it."""
    found = tests(sentence)
    last = ("NORMATIVE", "CREED", "IMPLICIT_OBLIGATION")
    any_ = (F.size(language_reasons(sentence, lang)) > 0) | found["TOO_SHORT"]
    for r in (*(r for r in REASONS if r not in (*last, "TOO_SHORT")), *last):
        any_ = any_ | found[r]
    return any_


def language_reasons(sentence: Column, lang: Column) -> Column:
    """LANGUAGE_UNSCREENED in documents of another language than those screened, and for sentences of another script; nothing for
    blanks. A null language counts as the first one screened."""
    base = F.split(F.replace(F.lower(F.coalesce(lang, F.lit(SCREENED[0]))), F.lit("_"), F.lit("-")), "-")[0]
    other = ~base.isin(*SCREENED) | (F.regexp_count(sentence, F.lit(r"\p{L}")) > 0) & (tx.latin_share(sentence) < LATIN)
    return F.when((F.trim(sentence) != "") & other, F.array(F.lit("LANGUAGE_UNSCREENED"))).otherwise(F.array().cast("array<string>"))


def gated(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, sentence, reasons): lexical and language reasons of each sentence."""
    rows = lg.sentences(docs).join(docs.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id")
    return rows.select("doc_id", "nth", "sentence", F.concat(reasons(F.col("sentence")), language_reasons(F.col("sentence"), F.col("lang"))).alias("reasons"))


# --- the guard -------------------------------------------------------------------------------------------------------


def guarded(sents: DataFrame, rend: DataFrame | None, run: int = GUARD_RUN, likeness: float = GUARD_LIKENESS) -> DataFrame:
    """(doc_id, nth, guard) for sentences (doc_id, nth, sentence): SCRIPTURE_TEXT if a passage has `run` words in a row of it, or a
    rendering has `likeness` of its weight of words; else null. Without an index every sentence is SCRIPTURE_UNCHECKED: what
    cannot be checked is not let through."""
    if rend is None:
        return sents.select("doc_id", "nth", F.lit("SCRIPTURE_UNCHECKED").alias("guard"))
    key = F.struct("doc_id", "nth").alias("key")  # a struct's nulls are equal
    hits = guard_hits(sents, rend, run, likeness).select(key, F.lit(True).alias("hit"))
    rows = sents.select("doc_id", "nth", key).join(hits, "key", "left")
    return rows.select("doc_id", "nth", F.when(F.col("hit"), F.lit("SCRIPTURE_TEXT")).alias("guard"))


def guard_hits(sents: DataFrame, rend: DataFrame, run: int = GUARD_RUN, likeness: float = GUARD_LIKENESS) -> DataFrame:
    """(doc_id, nth) of the sentences that are SCRIPTURE_TEXT."""
    keyed = sents.select(F.struct("doc_id", "nth").alias("doc_id"), F.col("sentence").alias("text"))
    # runs of both rules are runs of the shorter one's length
    met = written(ps.sharing(keyed, rend.where("edition = 0").select("item_id", "text"), min(run, ps.SMALL_RUN)), "guard-sentences")
    runs = ps.shared_runs(met, rend.where("edition = 0").select("item_id", "text"), run).select("doc_id")
    alike = ps.likeness(met, rend).where(F.col("likeness") >= likeness).select("doc_id")
    return runs.unionByName(alike).distinct().select("doc_id.doc_id", "doc_id.nth")


def calibration(sents: DataFrame, rend: DataFrame, runs: tuple[int, ...] = (4, 6, 8, 10)) -> DataFrame:
    """(run, n, labelled): sentences, and those that the guard's rule on runs labels, for each length of run."""
    keyed = sents.select(F.struct("doc_id", "nth").alias("doc_id"), F.col("sentence").alias("text"))
    longest = ps.common_runs(keyed, rend.where("edition = 0").select("item_id", "text"), min(runs)).groupBy("doc_id").agg(F.max("run").alias("run"))
    each = keyed.select("doc_id").join(longest, "doc_id", "left").select(F.coalesce("run", F.lit(0)).alias("longest"), F.explode(F.array(*map(F.lit, runs))).alias("run"))
    return each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("longest") >= F.col("run"), 1)).alias("labelled"))


# --- adaptation ------------------------------------------------------------------------------------------------------


def adapted(docs: DataFrame, rend: DataFrame | None, most_words: int = 22) -> DataFrame:
    """(doc_id, nth, sentence, status, adapted): sentences that no reason or guard refuses are split if longer than most_words, then
    checked again: a reason that comes up, or words that are not those of before, roll the sentence back. status: REFUSED, KEPT,
    ADAPTED or ROLLED_BACK; all but ADAPTED have the sentence as it was."""
    rows = lg.sentences(docs, "doc_id", also=("lang",)).where("doc_id IS NOT NULL")
    if rend is None:
        rows = rows.withColumn("hit", F.lit(True))
    else:
        hits = guard_hits(rows, rend).groupBy("doc_id").agg(F.collect_set("nth").alias("hits"))
        rows = rows.join(hits, "doc_id", "left").withColumn("hit", F.coalesce(F.array_contains("hits", F.col("nth")), F.lit(False)))
    rows = rows.withColumn("free", ~(F.col("hit") | refused(F.col("sentence"), F.col("lang"))))
    free = F.col("free")
    long = F.size(F.split("sentence", r"\s+")) > most_words
    rows = rows.withColumn("tried", F.when(free & long, rw.shorter_sentences(F.col("sentence"))).otherwise(F.col("sentence")))
    words = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    changed = F.col("tried") != F.col("sentence")
    pieces = F.split(F.col("tried"), r"(?<=[.])\s+")
    again = F.exists(pieces, lambda p: F.size(F.array_except(reasons(p), F.array(F.lit("TOO_SHORT")))) > 0) | (words(F.col("tried")) != words(F.col("sentence")))
    status = F.when(~free, "REFUSED").when(~changed, "KEPT").when(again, "ROLLED_BACK").otherwise("ADAPTED")
    rows = rows.withColumn("status", status)
    return rows.select("doc_id", "nth", "sentence", "status", F.when(F.col("status") == "ADAPTED", F.col("tried")).otherwise(F.col("sentence")).alias("adapted"))


def adapted_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, text, sentences, refused, adapted, rolled_back, refusal_rate) of adapted() rows, sentences in their order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "adapted"))), lambda x: x["adapted"]), " ")
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    all_ = F.count(F.lit(1))
    return rows.groupBy("doc_id").agg(text.alias("text"), all_.alias("sentences"), n("REFUSED").alias("refused"), n("ADAPTED").alias("adapted"), n("ROLLED_BACK").alias("rolled_back"), F.round(n("REFUSED") / all_, 6).alias("refusal_rate"))


# --- the gate for DuckDB ---------------------------------------------------------------------------------------------


def reasons_sql(x: str) -> str:
    """The lexical reasons of a trimmed sentence."""
    e = lambda p: "'" + p.replace("'", "''") + "'"
    m = lambda y, p: f"regexp_matches({y}, {e(p)})"
    bare = rf"regexp_replace(regexp_replace({x}, '(\p{{L}})[''’‘`ʼ](\p{{L}})', '\1\2', 'g'), '(\p{{L}})[''’‘`ʼ](\p{{L}})', '\1\2', 'g')"
    pairs = " OR ".join(f"(length({bare}) - length(replace({bare}, {e(o)}, ''))) >= 2" if o == c else f"(contains({bare}, {e(o)}) AND contains({bare}, {e(c)}))" for o, c in QUOTE_PAIRS)
    topic = f"regexp_replace({x}, {e('(?i)' + HONORIFIC)}, ' ', 'g')"
    divine = f"regexp_replace({topic}, {e(_FIRST_WORD)}, ' ')"
    w = rf"regexp_split_to_array({x}, '\s+')"
    near = f"array_to_string(({w})[i + 1:i + {REACH}], ' ')"
    found = {
        "SCRIPTURE": f"({pairs})",
        "REFERENCE": f"({m(x, word(REFERENCE))} OR {m(x, '(?i)' + REFERENCE_ANY)} OR {m(x, word(FRAMED))})",
        "NORMATIVE": f"({m(x, word(NORMATIVE))} OR {m(x, '(?i)' + NORMATIVE_START)} OR {m(x, NORMATIVE_AR)})",
        "PREFERENCE": f"({m(x, word(PREFERENCE))} OR {m(x, PREFERENCE_AR)})",
        "ATTRIBUTION": f"({m(x, word(ATTRIBUTION))} OR {m(x, ATTRIBUTION_AR)})",
        "CREED": f"({m(topic, word(CREED))} OR {m(x, CREED_AR)} OR {m(divine, word(DIVINE, True))})",
        "IMPLICIT_OBLIGATION": f"(len(list_filter(range(1, len({w}) + 1), lambda i: {m(f'({w})[i]', word(SUBJECT))} AND {m(near, word(HABIT))} AND NOT {m(near, word(PAST))})) > 0)",
        "CONDITIONAL": f"({m(x, CONDITION_AR)} OR {m(x, _START)} OR {m(x, _COMMA)} OR {m(x, _BEFORE)} OR {m(x, _BEFORE_AT)})",
        "SCRIPTURE_LIKE": m(x, word(ARCHAIC)),
        "TOO_SHORT": f"len(list_filter({w}, lambda y: y <> '')) < {lg.TOO_SHORT}",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {found[r]} THEN '{r}' END" for r in REASONS) + "], lambda z: z IS NOT NULL)"
