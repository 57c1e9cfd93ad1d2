"""Sources and sinks: Parquet tables, JSON and JSON lines, delimited text, checks of completeness and of pinned files,
upserts, and append-only tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

EDITION_DUMP = "book_id int, title string, language string, locale string, direction string, source string, version string, passages array<struct<chapter:int,verse:int,text:string>>"


#: Tables of texts, of which a row is much work.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt anew if their files are split in fewer partitions than there are cores; a large table is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def edition_dumps(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document an edition, exploded to its passages; those without text are left out."""
    whole = spark.read.schema(EDITION_DUMP).option("multiLine", True).json(path)
    rows = whole.select("*", F.explode("passages").alias("p")).drop("passages")
    return rows.select("book_id", "title", "language", "p.chapter", "p.verse", "p.text").where(F.length("text") > 0)


def delimited_passages(spark: SparkSession, path: str) -> DataFrame:
    """Lines chapter|verse|text; blanks, comments (#) and lines of another form are passed over."""
    part = F.split("value", r"\|")
    rows = spark.read.text(path).where((F.size(part) == 3) & ~F.col("value").startswith("#") & part[0].rlike(r"^\d+$") & part[1].rlike(r"^\d+$"))
    return rows.select(part[0].cast("int").alias("chapter"), part[1].cast("int").alias("verse"), part[2].alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def vectors(df: DataFrame, column: str, size: int) -> DataFrame:
    """Rows whose vector has the given size; others raise when they are read."""
    checked = F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("vector of size "), F.size(column).cast("string"))))
    return df.withColumn(column, checked)


def incomplete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that just one of the two tables has, with the side; empty if both are complete."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("only", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("only", F.lit("right")))


def pinned_files(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """(name, status): ok, changed or missing for each pin (name, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("sha256"), "ok").otherwise("changed")
    return pins.join(files, "name", "left").select("name", status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of both, the last by `order` for each key; on equal order the new one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_new")


def append(df: DataFrame, path: str) -> None:
    """The only way to write ledgers: rows are added, none is changed or removed."""
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table's files as a stream, whether the path is a folder or a single file (as a pattern it may be either)."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def html_rows(df: DataFrame) -> DataFrame:
    """(value): a line of an HTML table for each row, cells escaped; nulls are empty."""
    cells = [F.concat(F.lit("<td>"), tx.escape_markup(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """(value): a line of a Markdown table for each row; bars are escaped, line ends are spaces."""
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def export_report(df: DataFrame, path: str, kind: str = "html") -> None:
    """A report as text files in a folder, with its head as the first file's first line. Rows are written as they come: sort df first."""
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>" if kind == "html" else "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    rows = html_rows(df) if kind == "html" else markdown_rows(df)
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/head")
    rows.write.text(f"{path}/rows")


def public(df: DataFrame, private: tuple[str, ...]) -> DataFrame:
    """The rows without columns that are not to be published."""
    return df.drop(*private)
