"""Operator 2: exact deduplication that no large group of copies can slow down.

Three combining steps, each comparing whole normalised texts, never digests alone:

1. every task combines the equal texts it has read (map side of the first grouping);
2. groups of one digest, one of ``SALTS`` salts and one text combine, so a text that a third
   of all rows share is spread over tasks;
3. the salts' winners combine by digest and text.

Members learn their winner over (digest, salt), again spread. The salt is a hash of the id, so
a repeated or recomputed read deals every row alike. If one digest should cover different
texts, their members are told apart by the texts in a further join.

A null text counts as empty. The smallest id of a group stays, a null id only if the group has
no other; of rows that repeat id and text one stays. An empty table gives no rows. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.arrow_text import id_and_text
from quillsift.session import checkpointed

#: Fixed value: the characters that count as white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest), one row per input row.

    ``digest`` may be any function of the normalised text; only speed depends on it.
    """
    rows = id_and_text(docs, id_col, text_col).select(
        "id",
        normalised(F.col("text")).alias("content"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = rows.withColumn("digest", digest(F.col("content")))
    by_salt = rows.groupBy("digest", "salt", "content").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size")
    )
    winners = (
        by_salt.repartition("digest")
        .groupBy("digest", "content")
        .agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("size").alias("size"),
            F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"),
        )
    )
    by_digest = checkpointed(
        winners.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"),
            F.min("keep_id").alias("keep_id"),
            F.sum("size").alias("size"),
            F.bit_or("salts").alias("salts"),
        )
    )
    present = F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda s: F.get(F.array(*[F.col("salts").bitwiseAND(1 << n) != 0 for n in range(SALTS)]), s),
    )
    alone = by_digest.where("texts = 1").select(
        "digest", F.explode(present).alias("salt"), "keep_id", F.col("size").alias("group_size")
    )
    members = rows.groupBy("digest", "salt", "id").agg(F.count(F.lit(1)).alias("repeats"))
    found = members.join(alone, ["digest", "salt"]).select(
        "id", "keep_id", "group_size", "digest", "repeats"
    )
    clashes = by_digest.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        text_rows = rows.join(clashes, "digest", "left_semi")
        sizes = text_rows.groupBy("digest", "content").agg(
            F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        found = found.unionByName(
            text_rows.groupBy("digest", "content", "id")
            .agg(F.count(F.lit(1)).alias("repeats"))
            .join(sizes, ["digest", "content"])
            .select("id", "keep_id", "group_size", "digest", "repeats")
        )
    repeat = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return found.select("*", repeat.alias("copy")).select(
        "id",
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def row_key(id_column: Column, digest: Column) -> Column:
    """Id and digest of a row in one value, so that null ids can be joined on."""
    return F.concat(digest, F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay; see ``dedup_groups``."""
    groups = dedup_groups(docs, id_col, text_col)
    keys = (
        groups.groupBy(row_key(F.col("id"), F.col("digest")).alias("key"))
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
        .where("not kept or rows > 1")
    )
    keys = checkpointed(keys)
    own = normalised(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("row"), row_key(docs[id_col].cast("long"), sha256_of(own)).alias("key"))
    kept = keyed.join(broadcast_within(keys.select("key")), "key", "left_anti")
    repeated = keys.where("kept")
    if not repeated.isEmpty():
        again = keyed.join(broadcast_within(repeated.select("key")), "key", "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["key"]))
    return kept.select("row.*")


def broadcast_within(keys: DataFrame, rows: int = 500_000) -> DataFrame:
    """Keys of some fifty bytes marked for broadcast if counted to be few; else they shuffle."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys
