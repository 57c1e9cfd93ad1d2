"""Printed citations with their extents, in five forms, and the nearest quotation to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .language import CHAPTERS, VERSES

# The forms of a citation, in the order in which they are tried; sources whose numbers are no chapter and verse.
LATIN = r"(?i)[\[(]?\s*(?:qur\s?[’'`]?\s?an|quran|koran|surah|surat|sura|q\.?)\s*[\s.:,-]*?(\d{1,3})\s*[:：.\-]\s*(\d{1,3})\s*[\])]?"
ARABIC = r"(?:القرآن|القران|سورة|الآية|اية)\s*[^\d٠-٩]{0,20}?([0-9٠-٩]{1,3})\s*[:：]\s*([0-9٠-٩]{1,3})"
BARE = r"[\[(]\s*([0-9٠-٩]{1,3})\s*[:：]\s*([0-9٠-٩]{1,3})\s*[\])]"
NAMED = r"[(\[]\s*[A-Za-z][^()\[\]\n]{0,40}?([0-9]{1,3})\s*[:：]\s*([0-9]{1,3})(?:\s*[-–—]\s*[0-9]{1,3})?\s*[)\]]"
ARABIC_NAMED = r"(?<![\p{L}\p{N}_])[\x{0621}-\x{064A}\x{0671}-\x{06D3}ۃ]{2,15}\s*[،,]?\s*([0-9٠-٩۰-۹]{1,3})\s*[:：/]\s*([0-9٠-٩۰-۹]{1,3})"
OTHER_SOURCE = (
    r"(?i)bukh[aā]r|muslim|tirmidh|ab[uū]\s*d[aā]w|n[aā]s[aā]'?[iī]|ibn\s*m[aā]j|ahmad|musnad|muwat|bayhaq|tabar[aā]n|h[aā]kim|d[aā]rim|"
    r"بخار|مسلم|ترمذ|داؤد|داود|نسائ|ماج[ہه]|احمد|أحمد|مسند|موط|بيهق|بیہق|طبران|حاکم|حاكم|دارم"
)
#: Words between a citation and the quotation it labels; words back to which one is looked for.
ADJACENT, BACK = 2, 60


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, whole, a, b) of a pattern with two groups: characters, end exclusive. Places come from the lengths of the
    matches and of the pieces between them."""
    all_ = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    rows = F.arrays_zip(all_(0).alias("whole"), all_(1).alias("a"), all_(2).alias("b"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(all_(0))).alias("piece"))
    none = F.array().cast("array<struct<start:int,end:int,whole:string,a:string,b:string>>")
    at = lambda out: F.when(F.size(out) > 0, F.element_at(out, -1)["end"]).otherwise(0)

    def add(out: Column, x: Column) -> Column:
        start = at(out) + F.length(x["piece"])
        return F.concat(out, F.array(F.struct(start.cast("int").alias("start"), (start + F.length(x["whole"])).cast("int").alias("end"), x["whole"].alias("whole"), x["a"].alias("a"), x["b"].alias("b"))))

    return F.aggregate(rows, none, add)


def citations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, chapter, verse, last): every valid citation with its characters, end exclusive. The named forms count only
    where no earlier form has a citation, and not for other sources; a range (155-7 is 155 to 157) reaches to `last`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = lambda c: tx.ascii_digits(c).cast("int")
    tail = lambda x: F.regexp_extract(x["whole"], r"[-–—]\s*([0-9]{1,3})\s*[)\]]$", 1)

    def told(x: Column) -> Column:
        end = tail(x)
        full = F.when(F.length(end) < F.length(x["b"]), F.concat(F.substring(x["b"], F.lit(1), F.length(x["b"]) - F.length(end)), end)).otherwise(end)
        verse = number(x["b"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), number(x["a"]).alias("chapter"), verse.alias("verse"), F.greatest(verse, F.when(end == "", verse).otherwise(full.cast("int"))).alias("last"), x["whole"].rlike(OTHER_SOURCE).alias("other"))

    valid = lambda x: x["chapter"].between(1, CHAPTERS) & x["verse"].between(1, VERSES)
    every = [F.filter(F.transform(matches(text, p), told), valid).alias(n) for n, p in (("latin", LATIN), ("arabic", ARABIC), ("bare", BARE), ("named", NAMED), ("arabic_named", ARABIC_NAMED))]
    rows = docs.select(id_col, *every).select(id_col, F.concat("latin", "arabic", "bare").alias("plain"), "named", "arabic_named")
    free = lambda of: lambda x: ~x["other"] & ~F.exists(of, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    rows = rows.withColumn("plain", F.concat("plain", F.filter("named", free(F.col("plain")))))
    rows = rows.withColumn("plain", F.concat("plain", F.filter("arabic_named", free(F.col("plain")))))
    found = rows.select(id_col, F.explode("plain").alias("c")).select(id_col, *[F.col(f"c.{n}").alias(n) for n in ("start", "end", "chapter", "verse", "last")])
    return found.dropDuplicates([id_col, "chapter", "verse", "start"])


def nearest(left: DataFrame, right: DataFrame, key: str, reach: int = ADJACENT) -> DataFrame:
    """(key, left_id, right_id, side, distance): for each span of left (key, left_id, start, end) the span of right (key, right_id,
    start, end) at most `reach` away without overlap: one that ends before it is preferred to one that starts behind it, then the
    closest, then the least right_id. Spans meet by blocks of positions, so a key with many of them makes no pairs but near ones."""
    size = reach + 1
    block = lambda c: F.floor(c / size)
    before = left.select(key, "left_id", F.col("start").alias("_at"), F.explode(F.array(block(F.col("start")) - 1, block(F.col("start")))).alias("_b"))
    before = before.join(right.select(key, "right_id", F.col("end").alias("_to"), block(F.col("end")).alias("_b")), [key, "_b"]).where((F.col("_to") <= F.col("_at")) & (F.col("_at") - F.col("_to") <= reach))
    after = left.select(key, "left_id", F.col("end").alias("_at"), F.explode(F.array(block(F.col("end")), block(F.col("end")) + 1)).alias("_b"))
    after = after.join(right.select(key, "right_id", F.col("start").alias("_to"), block(F.col("start")).alias("_b")), [key, "_b"]).where((F.col("_to") >= F.col("_at")) & (F.col("_to") - F.col("_at") <= reach))
    one = lambda rows, side: rows.select(key, "left_id", "right_id", F.lit(side).alias("side"), F.abs(F.col("_at") - F.col("_to")).alias("distance"))
    each = one(before, "before").unionByName(one(after, "after"))
    best = F.min(F.struct((F.col("side") == "after").alias("s"), "distance", "right_id", "side")).alias("b")
    return each.groupBy(key, "left_id").agg(best).select(key, "left_id", F.col("b.right_id").alias("right_id"), F.col("b.side").alias("side"), F.col("b.distance").cast("long").alias("distance"))


def mismatched(cites: DataFrame, quotes: DataFrame, key: str, reach: int = ADJACENT) -> DataFrame:
    """(key, left_id, right_id): citations (key, left_id, start, end, cited) whose nearest quotation (key, right_id, start, end) is of
    another passage than the one cited."""
    near = nearest(cites, quotes, key, reach)
    return near.join(cites.select(key, "left_id", "cited"), [key, "left_id"]).where("cited <> right_id").select(key, "left_id", "right_id")
