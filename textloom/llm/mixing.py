"""Mixing sources to target weights by systematic sampling.

Each document has a number of expected copies; within a source they are summed along an order, one random offset a source is
added, and a document is emitted once for each integer that the sum crosses.

Expected copies are the source's target words over its words, but for two corrections that bring the words taken near the
target. The order is by size class, large documents first (class c holds those of at most target / FACTOR**c words), and each
class shares what the classes before it left of the target over all words that are left. So what a few large documents
take too much or too little, the many smaller ones make up for. Documents of more than a quarter of the target (the first
class) are expected the whole number of times below the rate, or more often where the rest at CAP copies each could not reach
the target.

The prefix sum is distributed: slim rows (identifier, size, place) are written once and dealt by range of (source, class, size,
identifier, place), so that a hot source covers many partitions; each is sorted and numbered by itself, written, and only a count
for each (source, class, partition) is summed over. There are CLASSES - 1 sums over one class each, then the result. Texts are not
shuffled; mixed() deals them once, unsorted, to meet their copies. Every step is a DataFrame operation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, located, scratch, text_of, written

#: Weights of the sources in their order, repeating; no target is above CAP times its source's size.
WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix-1"
#: Size classes, and how many times smaller the documents of the next one are.
CLASSES, FACTOR = 5, 4


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, z) rows, one a source: adds target. Targets are weight * level, where those above cap * z stop there
    and the level rises for the others until the sum is that of all z. The table has a row a source, so a window over
    all of it is small."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("double")
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before, all_rows = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("z").over(all_rows) - cap * F.coalesce(F.sum("z").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = sources.withColumn("w", weight).withColumn("room", cap * F.col("z") / F.col("w")).withColumn("level", level).withColumn("nth", F.row_number().over(by_room))
    free = F.when(F.col("level") < F.col("room"), F.struct("nth", "level"))
    rows = rows.withColumn("first", F.min(free).over(all_rows))
    full = F.col("first").isNull() | (F.col("nth") < F.col("first.nth"))
    return rows.select("source", "z", F.when(full, (cap * F.col("z")).cast("double")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1): the same in each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\0")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows: (id, source, size, loc) -> (id, source, size, loc, z, target, u, class, k: place within source and class, from 0)."""
    slim = written(rows, "mix-slim")
    level = written(targets(slim.groupBy("source").agg(F.sum("size").alias("z"))), "mix-targets")
    known = slim.join(level.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    size_class = sum((F.when(F.col("size") * F.lit(float(FACTOR**i)) <= F.col("target"), 1).otherwise(0) for i in range(1, CLASSES)), F.lit(0))
    known = known.withColumn("class", size_class).withColumn("small", -F.col("size")).withColumn("u", offset(F.col("source")))
    order = ["source", "class", "small", "id", "loc"]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order).drop("small")
    numbered = written(dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), "mix-numbered")
    parts = written(numbered.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least")), "mix-parts")  # a row for each partition and class in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("part").alias("p"), "least", before.alias("before"))
    found = numbered.join(starts, (F.col("part") == F.col("p")) & (F.col("class") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")))
    return written(found.select("id", "source", "size", "loc", "z", "target", "u", "class", (F.col("before") + F.col("seq") - F.col("least")).alias("k")), "mix-places")


def _crossed() -> Column:
    """Copies of a row beside its class's e and rate: the integers that its part of the sum crosses."""
    crossed = F.floor(F.col("e") + (F.col("k") + 1) * F.col("rate")) - F.floor(F.col("e") + F.col("k") * F.col("rate"))
    return F.least(crossed, F.ceil("rate")).cast("int")


def _copies(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with copies. state: (s, c, e, rate): sums and expected copies for each source and class."""
    at = rows.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    return at.withColumn("copies", _crossed())


def _mix(rows: DataFrame) -> DataFrame:
    """rows: (id, source, size, loc) -> the same with z, target and copies."""
    with scratch(rows.sparkSession) as keep:
        return _classes(keep(_dealt(rows)), keep)


def _classes(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows: of _dealt(). Class by class, from large documents to small ones. A source's row carries all it needs from class to class
    (n and own: rows and words of each class), so that a class is one aggregation and the driver has few tasks to keep."""
    in_class = lambda c, x: F.sum(F.when(F.col("class") == c, x).otherwise(F.lit(0).cast("long")))
    classes = [x for c in range(CLASSES) for x in (in_class(c, F.lit(1)).alias(f"n{c}"), in_class(c, F.col("size")).alias(f"own{c}"))]
    carried = [f"{x}{c}" for c in range(CLASSES) for x in ("n", "own")]
    state = rows.groupBy(F.col("source").alias("s")).agg(F.first("target").alias("target"), F.first("z").alias("z"), F.first("u").alias("e"), *classes)
    state = state.withColumns({"taken": F.lit(0).cast("long"), "rest": F.col("z")})
    steps = []
    for c in range(CLASSES):
        n, own = F.col(f"n{c}"), F.col(f"own{c}")
        if c == 0:  # z - own: the words of smaller documents
            least = F.when(own > 0, (F.col("target") - CAP * (F.col("z") - own)) / own).otherwise(0.0)
            rate = F.when(F.col("z") > 0, F.greatest(F.floor(F.col("target") / F.col("z")).cast("double"), least)).otherwise(0.0)
        else:
            rate = F.when(F.col("rest") > 0, F.least(F.lit(float(CAP)), F.greatest(F.lit(0.0), (F.col("target") - F.col("taken")) / F.col("rest")))).otherwise(0.0)
        now = written(state.withColumn("rate", rate), "mix-state")
        steps.append(now.select("s", F.lit(c).alias("c"), "e", "rate"))
        if c < CLASSES - 1:
            met = rows.select("source", "size", "class", "k").join(now, F.col("source").eqNullSafe(F.col("s")))
            sums = met.groupBy("s").agg(in_class(c, F.col("size") * _crossed()).alias("took"), *(F.first(x).alias(x) for x in now.columns if x != "s"))
            state = sums.select("s", "target", "z", (F.col("e") + n * F.col("rate")).alias("e"), (F.col("taken") + F.col("took")).alias("taken"), (F.col("rest") - own).alias("rest"), *carried)
    plan = steps[0]
    for s in steps[1:]:
        plan = plan.unionByName(s)
    return _copies(rows, keep(written(plan, "mix-plan")))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, loc: Column, prefix: str = "") -> DataFrame:
    get = lambda name: F.col(f"{prefix}`{name}`")
    return docs.select(get(id_col).alias("id"), get(source_col).cast("string").alias("source"), word_count(text_of(get(text_col))).alias("size"), loc.alias("loc"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies) for each row.

    A null text has size 0; a null source is a source of its own, last in order. Rows without words can be emitted too,
    which adds no words. Identifiers are of any type that can be ordered. Rows with the same source, size and identifier are
    dealt in any order, with the same number of copies in all. An empty table gives an empty result; a corpus without words takes
    nothing. Other columns of docs are not read.
    """
    found = _mix(_slim(docs, id_col, text_col, source_col, F.monotonically_increasing_id()))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("z").alias("source_size"), "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix emits it; nulls, repeats and empty tables as in mix()."""
    rows = located(docs, "mix-rows")
    with scratch(docs.sparkSession) as keep:
        copies = _mix(_slim(rows, id_col, text_col, source_col, F.col("loc"), "carried.")).where("copies > 0").select("loc", "copies")
        copies = keep(written(copies, "mix-copies"))
    met = rows.select("carried", "loc").join(copies.hint("shuffle_hash"), "loc")
    return met.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("carried.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _sql() -> str:
    steps, state = [], "SELECT source, target, z, u AS e, 0::BIGINT AS taken, z AS rest FROM t"
    for c in range(CLASSES):
        rate = (
            f"CASE WHEN z > 0 THEN greatest(floor(target / z), CASE WHEN own > 0 THEN (target - {CAP} * (z - own)) / own ELSE 0::DOUBLE END) ELSE 0::DOUBLE END"
            if c == 0
            else f"CASE WHEN rest > 0 THEN least({CAP}::DOUBLE, greatest(0::DOUBLE, (target - taken) / rest)) ELSE 0::DOUBLE END"
        )
        steps.append(f"""s{c} AS MATERIALIZED (SELECT *, {rate} AS rate FROM (SELECT s.*, coalesce(g.n, 0) AS n, coalesce(g.z, 0) AS own FROM ({state}) s
  LEFT JOIN g ON g.source IS NOT DISTINCT FROM s.source AND g.class = {c})),
x{c} AS MATERIALIZED (SELECT k.*, CAST(least(floor(e + (k + 1) * rate) - floor(e + k * rate), ceil(rate)) AS BIGINT) AS copies FROM k JOIN s{c} s ON k.source IS NOT DISTINCT FROM s.source WHERE k.class = {c})""")
        state = f"""SELECT s{c}.source, target, z, e + n * rate AS e, CAST(taken + coalesce(took, 0) AS BIGINT) AS taken, rest - own AS rest
  FROM s{c} LEFT JOIN (SELECT source, sum(size * copies) AS took FROM x{c} GROUP BY source) q ON q.source IS NOT DISTINCT FROM s{c}.source"""
    return ",\n".join(steps)


OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM s),
r AS (SELECT *, {CAP} * z / w AS room FROM w),
l AS (SELECT *, row_number() OVER o AS nth,
  (sum(z) OVER () - {CAP} * coalesce(sum(z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r WINDOW o AS (ORDER BY room, source ASC NULLS LAST)),
f AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM l WHERE level < room),
t AS (SELECT l.source, z, CASE WHEN f.nth IS NULL OR l.nth < f.nth THEN ({CAP} * z)::DOUBLE ELSE f.level * w END AS target,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0))), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM l, f),
k AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY size DESC, doc_id) - 1 AS k FROM (SELECT d.*, t.source_size, t.target,
  {' + '.join(f"CASE WHEN size * {FACTOR**i}::DOUBLE <= target THEN 1 ELSE 0 END" for i in range(1, CLASSES))} AS class FROM d JOIN (SELECT source, z AS source_size, target FROM t) t ON d.source IS NOT DISTINCT FROM t.source)),
g AS (SELECT source, class, count(*) AS n, sum(size)::BIGINT AS z FROM k GROUP BY ALL),
{_sql()}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({' UNION ALL '.join(f'SELECT * FROM x{c}' for c in range(CLASSES))})
"""
