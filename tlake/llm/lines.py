"""Line dedup: lines are exploded, hashed, counted by document, dropped where too many documents hold them, and the rest
is put together again by position."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key

#: Blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: One line in so many repeated ones is frequent.
FREQUENT = 1000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case. Text of ASCII only takes the fast way, all else keeps its case."""
    line = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, ascii_uppercase, ascii_lowercase))


def hashed_lines(docs: DataFrame, min_chars: int, *columns: str) -> DataFrame:
    """The given columns, pos and the 128-bit hash h of every line whose key has ``min_chars`` code points."""
    return (
        docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .select(*columns, "pos", line_key(F.col("line")).alias("line_key"))
        .filter(F.char_length("line_key") >= min_chars)
        .select(*columns, "pos", text_key(F.col("line_key")).alias("h"))
    )


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h, n, first_doc: hashes of lines that ``min_docs`` documents hold, how many do, and the smallest id among these.

    Every step aggregates before it shuffles. A document counts once for a line: pairs (h, doc_id) are made distinct, then
    counted by h, so a line that all documents hold costs one partial count a task.
    """
    pairs = hashed_lines(docs, min_chars, "doc_id").groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
    return (
        pairs.groupBy("h")
        .agg(F.count("one").alias("n"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("n") >= min_docs)
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: each row's text without the lines that ``min_docs`` documents hold, except in the
    one with the smallest id.

    Lines are what stands between line feeds (null or empty text: one empty line). Their key is the line without blanks
    at its ends, A-Z in lower case; lines with shorter keys than ``min_chars`` code points always stay, blanks included.
    A document is a doc_id, of any type that can be ordered: rows with the same id are one document and all keep a line of
    which theirs is the smallest id; null ids are one document too, after all others. Equal rows give equal rows.
    If all lines go, the text is empty. Other columns are not read.

    What is joined per line is its hash, place and row key (id and digest of the text). Only the places of dropped lines
    are gathered per row key, and meet the texts again in the one shuffle of those. Hashes that hold a thousandth of all
    repeated (line, document) pairs, so at most ``FREQUENT`` of them, are broadcast; the lines with such a hash are dealt
    out evenly where the others are dealt by hash.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_md5", text_key(F.col("text")))
    repeated = repeated_lines(rows, min_chars, min_docs).checkpoint()
    frequent = F.col("n") * FREQUENT >= (repeated.agg(F.sum("n")).first()[0] or 0)
    often = repeated.filter(frequent).select(F.col("h").alias("often"), F.col("first_doc").alias("often_first"))
    rarely = repeated.filter(~frequent).select(F.col("h").alias("rarely"), F.col("first_doc").alias("rarely_first"))
    lines = hashed_lines(rows, min_chars, "doc_id", "text_md5").join(F.broadcast(often), F.col("h") == F.col("often"), "left")
    own = F.unhex(F.md5(F.concat("text_md5", F.col("pos").cast("string").cast("binary"), F.col("h"))))  # meets nothing
    lines = lines.withColumn("dealt", F.when(F.col("often").isNull(), F.col("h")).otherwise(own))
    held = F.col("often").isNotNull() | F.col("rarely").isNotNull()
    first_doc = F.when(F.col("often").isNotNull(), F.col("often_first")).otherwise(F.col("rarely_first"))
    dropped = (
        lines.join(rarely, F.col("dealt") == F.col("rarely"), "left")
        .filter(held & ~F.col("doc_id").eqNullSafe(first_doc))
        .groupBy(F.col("doc_id").alias("in_doc"), F.col("text_md5").alias("in_text"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    # The split happens before the join, so that the lines below are a column and not an expression repeated per line.
    texts = rows.select("doc_id", "text_md5", F.split("text", "\n").alias("lines"))
    same = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_md5") == F.col("in_text"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # keeps the order
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    return texts.join(dropped, same, "left").select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
