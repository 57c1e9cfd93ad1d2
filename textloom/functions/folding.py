"""Forms in which words of Arabic script and transliterations are compared, cleaned and shown, as Spark column expressions, and the
same for DuckDB where RE2 can say it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Marks of the Uthmani script and their folds; vowels, tatweel; letters that only Urdu has; clitics and suffixes.
UTHMANI = ("ٱ", "ا")
ORNAMENTS = "[ٰۥۦـ]"
HARAKAT = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
URDU_ONLY = "یگٹڈڑںہۃےۂژپچ"
PROCLITICS = tuple(a + b for a in ("", "و", "ف") for b in ("", "ب", "ك", "ل"))
SUFFIXES = ("هما", "كما", "هم", "هن", "كم", "كن", "نا", "ها", "ات", "ون", "ين", "ان", "ه", "ي", "ك")
# Latin letters with marks and without; apostrophes; double vowels; the article as it is transliterated.
MARKED = ("àáâãäåāăąçćčďèéêëēėęěğģìíîïīįķļłñńňòóôõöōőŕřśşšţťùúûüūůűųýÿźżžḥṣḍṭẓḏṯẖḳġṁṅṇḷ", "aaaaaaaaacccdeeeeeeeeggiiiiiikllnnnooooooorrsssttuuuuuuuuyyzzzhsdtzdthkgmnnl")
APOSTROPHES = "[ʿʾʼʻꜤꜥ'’‘`\\-‐‑]"
DOUBLES = (("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ou", "u"), ("aa", "a"), ("au", "aw"))
ARTICLE = r"(?i)^(?:al|el|ul|an|ar|as|ash|at|ath|ad|adh|az|ah)[-‐‑]([\p{L}\p{N}_])"
ARTICLES = ("the", "a", "an")
LATIN_TOKEN = r"\p{L}+(?:[-‐‑'’‘`ʼ]\p{L}+)*"
TRANSLITERATED = "[āīūḥṣḍṭẓʿʾĀĪŪḤṢḌṬẒ]"
CONTRACTIONS = ("s", "t", "re", "ve", "ll", "d", "m")
ALTERNATIVES = r"\s*/\s*|\s*;\s*|\s*,\s*|\s+or\s+|\s+i\.e\.\s+|[()\[\]]"
# Quotation marks of publishers, numbers of verses before a text, a citation behind it, a footnote's mark.
OPENERS = "“”\"'«»‹›﴾﴿༺‘’„‚"
LEADING_REFERENCE = r"^\s*(?:\(\s*\p{Nd}{1,3}\s*(?::\s*\p{Nd}{1,3}\s*)?\)|\p{Nd}{1,3}\s*[.)])\s*"
TRAILING_REFERENCE = r"\s*[(\[（][^()\[\]]{0,60}\p{Nd}{1,3}\s*[:：]\s*\p{Nd}{1,3}[^()\[\]]{0,25}[)\]）]\s*[.۔।]?\s*$"
FOOTNOTE_MARK = r"\[\s*\p{Nd}+\s*\]"
BASMALA = "بسم الله الرحمن الرحيم"
HOLD = ("ةى", "\ue000\ue001")


def fold_arabic(c: Column) -> Column:
    """The comparison form, of the Uthmani script too."""
    return tx.normalize(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), *UTHMANI), ORNAMENTS, ""))


def fold_term(c: Column) -> Column:
    """fold_arabic() with what brackets hold, and with ة and ى as they are."""
    held = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[()]", " "), *HOLD)
    # private characters are no letters, so they take the place of letters while the rest is folded
    kept = F.regexp_replace(F.translate(held, *UTHMANI), ORNAMENTS, "")
    for pattern in (tx.FOOTNOTE, tx.LEADING_NUMBER):
        kept = F.regexp_replace(kept, pattern, " ")
    kept = F.translate(F.regexp_replace(kept, tx.DIACRITICS, ""), *tx.LETTER_FORMS)
    kept = tx.collapse(F.lower(F.regexp_replace(kept, r"[^\p{L}\p{N}_\s\x{E000}\x{E001}]", " ")))
    return F.translate(kept, HOLD[1], HOLD[0])


def strip_harakat(c: Column) -> Column:
    return tx.collapse(F.regexp_replace(F.coalesce(c, F.lit("")), HARAKAT, ""))


def fold_key(c: Column) -> Column:
    return F.replace(fold_arabic(c), F.lit(" "), F.lit(""))


def core(c: Column) -> Column:
    """A word or key less its article, if more than three letters long; a final ى as ي."""
    bare = F.when(F.startswith(c, F.lit("ال")) & (F.length(c) > 3), F.substring(c, F.lit(3), F.length(c))).otherwise(c)
    return F.translate(bare, "ى", "ي")


def candidates(c: Column, least: int = 3) -> Column:
    """Every core that a folded word can be an inflection of, sorted: less one or two clitics (with the article or `least` letters
    left; an article whose alef is elided behind ل is given back), less a suffix with `least` letters left (with ة given back)."""
    stems = [c]
    for p in PROCLITICS[1:]:
        rest = F.substring(c, F.lit(len(p) + 1), F.length(c))
        has = F.startswith(c, F.lit(p))
        if p.endswith("ل"):
            stems.append(F.when(has & F.startswith(rest, F.lit("ل")) & (F.length(rest) > 3), F.concat(F.lit("ا"), rest)))
        stems.append(F.when(has & (F.startswith(rest, F.lit("ال")) | (F.length(rest) >= least)), rest))
    bare = lambda x: F.when(F.startswith(x, F.lit("ال")) & (F.length(x) > 3), F.substring(x, F.lit(3), F.length(x))).otherwise(x)
    both = F.flatten(F.transform(F.array_compact(F.array(*stems)), lambda x: F.array(x, bare(x))))

    def less(x: Column) -> Column:
        out = [x]
        for s in SUFFIXES:
            b = F.substring(x, F.lit(1), F.length(x) - len(s))
            cut = F.endswith(x, F.lit(s)) & (F.length(x) - len(s) >= least)
            out += [F.when(cut, b), F.when(cut & F.endswith(b, F.lit("ت")), F.concat(F.substring(b, F.lit(1), F.length(b) - 1), F.lit("ة")))]
            if s == "ات":
                out.append(F.when(cut, F.concat(b, F.lit("ة"))))
        return F.array_compact(F.array(*out))

    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(both, less)), lambda x: F.translate(x, "ى", "ي"))))


def latin_key(c: Column) -> Column:
    """A word without what its spellings differ in: marks, article, apostrophes, doubled letters, endings."""
    t = F.regexp_replace(F.lower(F.translate(F.lower(F.coalesce(c, F.lit(""))), *MARKED)), r"\p{M}", "")
    t = F.regexp_replace(F.regexp_replace(t, ARTICLE, "$1"), APOSTROPHES, "")
    for a, b in DOUBLES:
        t = F.replace(t, F.lit(a), F.lit(b))
    ending = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    t = F.when((F.length(t) > 4) & F.endswith(t, F.lit("ies")), F.concat(ending(3), F.lit("y"))).when((F.length(t) > 3) & F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), ending(1)).otherwise(t)
    ending = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    t = F.when((F.length(t) > 5) & F.endswith(t, F.lit("ing")), ending(3)).when((F.length(t) > 4) & F.endswith(t, F.lit("ed")), ending(2)).otherwise(t)
    t = F.regexp_replace(t, r"(.)\1+", "$1")
    return F.regexp_replace(t, r"(?<=[\p{L}\p{N}_]{2})a[ht]$", "a")


def latin_tokens(c: Column) -> Column:
    """Words of a text with their apostrophes and hyphens, English articles left out."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LATIN_TOKEN), F.lit(0)), lambda w: ~F.lower(w).isin(*ARTICLES))


def form_keys(c: Column) -> Column:
    """Keys of a form's words, without empty ones."""
    return F.filter(F.transform(latin_tokens(c), latin_key), lambda k: k != "")


def alternatives(c: Column) -> Column:
    """The forms that one entry lists."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ALTERNATIVES), lambda p: F.regexp_replace(p, r"^[ .\-]+|[ .\-]+$", "")), lambda p: p != "")


def spelling(c: Column) -> Column:
    """What tells two spellings apart: neither case, the kind of apostrophe, a possessive nor the article does."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "['’‘`ʼ]s$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(s, ARTICLE, "$1"), "['’‘`ʼ]", "'"))


def looks_transliterated(c: Column) -> Column:
    """Marked letters, or an inner apostrophe that is no contraction's."""
    tail = F.lower(F.regexp_extract(c, r"\p{L}['’‘`ʼ](\p{L}+)$", 1))
    return c.rlike(TRANSLITERATED) | (tail != "") & ~tail.isin(*CONTRACTIONS)


def is_arabic(c: Column) -> Column:
    """Half of the characters or more are of the Arabic block, and none is a letter of Urdu alone."""
    all_ = F.greatest(F.length(F.replace(c, F.lit(" "), F.lit(""))), F.lit(1))
    return (F.regexp_count(c, F.lit(r"[\x{0600}-\x{06FF}]")) * 2 >= all_) & ~c.rlike(f"[{URDU_ONLY}]")


def strip_trailing_reference(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), TRAILING_REFERENCE, ""))


def strip_quote_marks(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{OPENERS} \\t]+|[{OPENERS} \\t]+$", ""))


def looks_like_quote(c: Column) -> Column:
    """25 characters or more that open with a quotation mark, or hold an ornate bracket."""
    return (F.length(c) >= 25) & (c.rlike(f"^[…. ]*[{OPENERS}]") | c.rlike("[﴾﴿۝]"))


def clean_rendering(c: Column) -> Column:
    """A rendering up to its footnotes, without their marks and its verse number."""
    t = F.regexp_replace(F.regexp_replace(tx.first_part(F.coalesce(c, F.lit(""))), FOOTNOTE_MARK, " "), LEADING_REFERENCE, "")
    return tx.collapse(t)


def clean_source(c: Column, chapter: Column, verse: Column) -> Column:
    """A verse without the opening formula that stands before the first one of chapters other than 1 and 9."""
    t = tx.collapse(F.coalesce(c, F.lit("")))
    opened = (verse == 1) & ~chapter.isin(1, 9) & F.startswith(t, F.lit(BASMALA))
    return F.when(opened, F.trim(F.substring(t, F.lit(len(BASMALA) + 1), F.length(t)))).otherwise(t)


def shortened(c: Column, limit: int = 300) -> Column:
    """At most `limit` characters, up to the last stop in their second half if there is one, else with an ellipsis. Stops are
    tried in the order . ؛ ،"""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^[-–—:•· ]+", "")
    cut = F.substring(t, 1, limit)
    out = F.concat(F.rtrim(cut), F.lit("…"))
    for stop in ("،", "؛", "."):
        at = F.length(cut) - F.instr(F.reverse(cut), stop)  # characters before the last one
        out = F.when((F.instr(cut, stop) > 0) & (at > limit * 0.5), F.trim(F.substring(cut, F.lit(1), at + 1))).otherwise(out)
    return F.when(F.length(t) <= limit, t).otherwise(out)


def quoted_core(c: Column) -> Column:
    """The words between an opener within the first four words and a closer within the last five from there, where there are any."""
    w = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    mark = f".*[{OPENERS}].*"
    first = F.array_position(F.transform(F.slice(w, 1, 4), lambda x: x.rlike(mark)), True)
    s = F.greatest(first, F.lit(1))
    tail = F.reverse(F.slice(w, F.greatest(s, F.size(w) - 4), F.lit(5)))
    last = F.array_position(F.transform(tail, lambda x: x.rlike(mark)), True)
    e = F.when(last > 0, F.size(w) - last + 1).otherwise(F.size(w))
    return F.when((F.size(w) < 2) | (e < s), c).otherwise(F.array_join(F.slice(w, s.cast("int"), (e - s + 1).cast("int")), " "))


def retry_after(first: float, failures: Column, most: float = 3600.0) -> Column:
    """Seconds to wait after so many failures in a row: doubling, up to `most`."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), failures - 1))


# --- for DuckDB -------------------------------------------------------------------------------------------------------


def fold_arabic_sql(x: str) -> str:
    return tx.normalize_sql(f"regexp_replace(translate(coalesce({x}, ''), '{UTHMANI[0]}', '{UTHMANI[1]}'), '{ORNAMENTS}', '', 'g')")
