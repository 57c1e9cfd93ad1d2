"""What the training-data operators share: text expressions, rows by their place, and the tables of sources.store."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import conf, drop_written, remove, scratch, shared_dir, shuffles_end, work_path, written  # noqa: F401
from ..sources.tables import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch, about: rows of long texts come in small batches.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session hand Python at most ARROW_BYTES a batch (results do not depend on it, and a lower bound stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Hand freed memory of this process back to the system. glibc keeps what lies between blocks in use, for good if nothing else
    asks for it. Elsewhere nothing is done."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def column(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def located(docs: DataFrame, name: str) -> DataFrame:
    """(carried: a struct of all columns of docs, loc: where the row's content is). loc is made of the Parquet file and the row's
    place in it, so it is the same in each scan. Anything but a plain Parquet table is written first, as other plans may deal their
    rows differently each time."""
    plan = docs._jdf.queryExecution().analyzed()
    plain = plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    if not plain or plan.relation().fileFormat().toString() != "Parquet":
        docs = written(docs, name)
    at = docs.metadataColumn("_metadata")
    loc = F.concat_ws(":", F.hex(F.xxhash64(at.getField("file_path"))), F.hex(at.getField("row_index")))
    return docs.select(F.struct(*map(column, docs.columns)).alias("carried"), loc.alias("loc"), at.getField("file_path").alias("file"))


def those(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of located() whose loc is in chosen, as they were. The texts are dealt by loc and not sorted; the other side is
    slim."""
    return rows.select("carried", "loc").join(chosen.select("loc").hint("shuffle_hash"), "loc", "left_semi").select("carried.*")


def lower_ascii(c: Column) -> Column:
    """A-Z only to lower case. Pure ASCII texts take the JVM's fast path, which does the same to them."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(c: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, dealt over all cores if it is in few files."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
