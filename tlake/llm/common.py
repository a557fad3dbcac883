"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Maximal runs outside blank and U+0009 to U+000D, in UTF-8. The split of a byte string knows just those spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def checkpoint_folder(spark: SparkSession) -> None:
    """Take the shared folder that the cluster names in spark.checkpoint.dir; only a local session without one, as in
    tests, gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch where the session has Spark's own number: rows are whole texts here, and each batch is held
    in the JVM and in the Python worker. Stays set for the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def of_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python worker and kept between its tasks. Only for caches of bounded size
    whose content follows from ``key``."""
    kept = sys.modules.setdefault("llm_worker_caches", ModuleType("llm_worker_caches")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that results of a few rows only are held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % n


def text_key(text: Column) -> Column:
    """128-bit digest of a text (null as empty) as 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def ids(*frames: DataFrame) -> Column:
    """doc_id in a type that all frames share: whole numbers, or text where one of them has other ids."""
    whole = all(df.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") for df in frames)
    return F.col("doc_id").cast("long" if whole else "string").alias("doc_id")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, fold: Column, max_rows: int
) -> list[tuple[str, int]]:
    """(text, label) of at most ``max_rows`` labelled documents inside ``fold``, in an order that hashing the id gives.

    The ids are chosen from the label table alone; only the chosen texts are read into the driver, so what reaches
    it is bounded by ``max_rows``. Labels other than 0 and 1, null texts and repeated (id, label) rows are passed over.
    """
    wanted = (
        labels.select(ids(docs, labels), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & fold)
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )
    # At most max_rows rows of 12 bytes: a bounded broadcast.
    rows = (
        docs.select(ids(docs, labels), "text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(wanted), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y", "text")
        .limit(max_rows)
        .select("text", "y")
        .collect()
    )
    return [(r.text, r.y) for r in rows]
