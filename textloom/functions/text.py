"""Text functions as Spark column expressions: comparison forms, tokens, shingles, scripts, readability, markup.

Letters and digits are written [\\p{L}\\p{N}_]: Java's \\w knows ASCII only. NFKC has no built-in: compatible() does what it does to
single characters, by a table built from its rule, for texts that hold any beyond the Latin ones; nfkc() is an Arrow UDF that also
composes letters from parts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks that do not change the wording, and letters that are written in several forms.
FOOTNOTE = r"\[\p{Nd}+\]"
LEADING_NUMBER = r"^\s*\p{Nd}+\s*[.)]\s*"
QUOTED_NUMBER = "^[\\s\"'“”‘’«»„]*\\p{Nd}+\\s*[.)]\\s*"
PASSAGE_NUMBER = r"[(\[﴿]\s*[0-9٠-٩۰-۹]{1,3}\s*[)\]﴾]"
PARENTHESES = r"\([^)]*\)"
DIACRITICS = "[ؗ-ًؚ-ْٰـ]"
LETTER_FORMS = ("أإآةى", "اااهي")
MORE_FORMS = ("یکہۃھ", "يكههه")
ELLIPSIS = r"\.(?:\s*\.){2,}"


def _table(points: list[range], form: Callable[[str], str]) -> tuple[str, str]:
    """Characters that a form makes another single character, and these."""
    pairs = [(chr(p), form(chr(p))) for r in points for p in r]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and not b.isspace()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _without_marks(c: str) -> str:
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f"))


COMPATIBLE = _table([range(0x250, 0xD800), range(0xF900, 0xFFF0)], lambda c: unicodedata.normalize("NFKC", c))
#: Characters that stand for several.
EXPANDED = tuple((c, unicodedata.normalize("NFKC", c)) for c in "…ﬀﬁﬂﬃﬄﬅﬆﷲﷳﷴﻵﻷﻹﻻ")
_BEYOND = r"[^\x00-\x{024F}]"
PLAIN = _table([range(0xC0, 0x250), range(0x1E00, 0x1F00)], _without_marks)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Latin accents dropped; other combining marks stay."""

    def plain(t: str | None) -> str | None:
        if t is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ")
        return unicodedata.normalize("NFC", kept)

    return text.map(plain)


def compatible(c: Column) -> Column:
    """Compatibility characters as what they stand for: presentation forms, full width, ligatures, the ellipsis."""
    t = F.translate(c, *COMPATIBLE)
    for a, b in EXPANDED:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(c.rlike(_BEYOND), t).otherwise(c)


def latin_plain(c: Column) -> Column:
    """Latin letters without their marks; others keep theirs."""
    return F.regexp_replace(F.translate(c, *PLAIN), r"[\x{0300}-\x{036F}]", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """The form in which texts are compared for ranking; null becomes empty. Latin texts without brackets skip the steps that find nothing in them."""
    raw = F.coalesce(c, F.lit(""))
    words = lambda x: F.trim(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " ")))
    c = compatible(raw)
    for pattern in (FOOTNOTE, LEADING_NUMBER, PARENTHESES):
        c = F.regexp_replace(c, pattern, " ")
    c = F.translate(F.regexp_replace(c, DIACRITICS, ""), *LETTER_FORMS)
    return F.when(raw.rlike(r"[\[(]|" + _BEYOND), words(c)).otherwise(words(F.regexp_replace(raw, LEADING_NUMBER, " ")))


def tokens(c: Column) -> Column:
    """Words of the comparison form; an empty text has none."""
    n = normalize(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def strict_tokens(c: Column, strip_parentheses: bool = False) -> Column:
    """Words for identity: only case, punctuation but the question mark, numbering and letter forms are left out."""
    c = F.regexp_replace(compatible(F.coalesce(c, F.lit(""))), r"\p{Cf}", "")
    for pattern in (FOOTNOTE, QUOTED_NUMBER, PASSAGE_NUMBER, *([PARENTHESES] if strip_parentheses else [])):
        c = F.regexp_replace(c, pattern, " ")
    c = F.translate(F.regexp_replace(c, DIACRITICS, ""), LETTER_FORMS[0] + MORE_FORMS[0], LETTER_FORMS[1] + MORE_FORMS[1])
    return F.regexp_extract_all(F.lower(latin_plain(F.regexp_replace(c, "[?؟]", " qmark "))), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words, each joined by a space."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def latin_share(c: Column) -> Column:
    """Share of letters that are Latin; 0 without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{IsLatin}")) / letters).otherwise(0.0)


# Scripts and their letters' blocks.
SCRIPTS = {"arabic": r"؀-ۿݐ-ݿ", "bengali": r"ঀ-৿", "devanagari": r"ऀ-ॿ", "latin": r"A-Za-zÀ-ɏ"}


def dominant_script(c: Column) -> Column:
    """The script with the most letters, the first by name among equals; null without letters of any."""
    counts = F.array(*[F.struct((-F.regexp_count(c, F.lit(f"[{block}]"))).alias("n"), F.lit(name).alias("name")) for name, block in sorted(SCRIPTS.items())])
    first = F.array_min(counts)
    return F.when(first["n"] < 0, first["name"])


def syllables(word: Column) -> Column:
    """Runs of vowels, less a silent e at the end, at least one."""
    word = F.lower(word)
    runs = F.regexp_count(word, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), runs - F.when(word.rlike("[^aeiouyl]e$") & (runs > 1), 1).otherwise(0))


def strip_markup(c: Column) -> Column:
    """Visible text of HTML: scripts and styles go whole, line breaks are spaces, common references are decoded."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return collapse(c)


def escape_markup(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def excerpt(c: Column, n: int = 14) -> Column:
    words = F.split(collapse(c), " ")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" …"))).otherwise(collapse(c))


def first_part(c: Column) -> Column:
    """A rendering up to its footnote rule of four underscores or more."""
    return F.split(c, "_{4,}", 2)[0]


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९০১২৩৪৫৬৭৮৯", "0123456789" * 4)


def record_id(*parts: Column) -> Column:
    """16 hex digits of a SHA-1 over the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


# --- the same forms for DuckDB, for the oracles -----------------------------------------------------------------------


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def compatible_sql(x: str) -> str:
    a, b = (y.replace("'", "''") for y in COMPATIBLE)
    t = f"translate({x}, '{a}', '{b}')"
    for a, b in EXPANDED:
        t = f"replace({t}, '{a}', '{b}')"
    return f"(CASE WHEN regexp_matches({x}, '{_BEYOND}') THEN {t} ELSE {x} END)"


def normalize_sql(x: str) -> str:
    x = compatible_sql(f"coalesce({x}, '')")
    for pattern in (r"\[\p{Nd}+\]", r"^\s*\p{Nd}+\s*[.)]\s*", r"\([^)]*\)"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    x = f"translate(regexp_replace({x}, '{DIACRITICS}', '', 'g'), '{LETTER_FORMS[0]}', '{LETTER_FORMS[1]}')"
    return collapse_sql(rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'))")


def tokens_sql(x: str) -> str:
    n = normalize_sql(x)
    return f"(CASE WHEN {n} = '' THEN [] ELSE string_split({n}, ' ') END)"


def strict_sql(x: str, strip_parentheses: bool = False) -> str:
    x = rf"regexp_replace({compatible_sql(f"coalesce({x}, '')")}, '\p{{Cf}}', '', 'g')"
    quoted = QUOTED_NUMBER.replace("'", "''")
    for pattern in (FOOTNOTE, quoted, PASSAGE_NUMBER, *([PARENTHESES] if strip_parentheses else [])):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    x = f"translate(regexp_replace({x}, '{DIACRITICS}', '', 'g'), '{LETTER_FORMS[0] + MORE_FORMS[0]}', '{LETTER_FORMS[1] + MORE_FORMS[1]}')"
    x = rf"regexp_replace(translate(regexp_replace({x}, '[?؟]', ' qmark ', 'g'), '{PLAIN[0]}', '{PLAIN[1]}'), '[\x{{0300}}-\x{{036F}}]', '', 'g')"
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}]+')"


def shingles_sql(w: str, n: int) -> str:
    return f"(CASE WHEN len({w}) >= {n} THEN list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) ELSE [] END)"
