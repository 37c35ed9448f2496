"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its content says so (after a blank that follows certain letters), so a chunk's
borders depend on the text around them and equal texts give equal chunks.  A chunk's identifier is a truncated
SHA-256.  Identifiers are verified: chunks are deduplicated to distinct (identifier, bytes) pairs, the one time that
text is shuffled, and where different bytes share an identifier, an ordinal is added to it.  A document is then its
recipe, the ordered list of verified identifiers, and equal recipes mean equal texts, whatever the digest length.
Grouping and joining move recipes (16 bytes for about 1,100 characters), never documents.

A group that holds a third of all rows is one partially aggregated key when grouped.  When its result is joined back
both sides are shuffled as they are, so that AQE can split the key.

Defined results: null text counts as empty; the row that stays is the first by (id, nulls last; text as it was); of
rows with equal ids and texts exactly one stays; an empty table gives an empty table.  Only the id is returned besides
the result columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import RID, cut, keyed

SPACE = r"[\x20\x09-\x0D]+"
#: At least 1,024 characters, up to a blank behind two letters of these classes; 8,192 where there is none.
CHUNK = r"(?s).{1024,8192}?(?:(?<=[aeiou][dnrst] )|\z)|.{1,8192}"


def normalised(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 128) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per row of docs."""
    rows, plain = keyed(docs.select(id_col, text_col), id_col, text_col)
    kind = docs.schema[id_col].dataType
    return _judged(rows, plain, id_col, text_col, digest_bits).select(F.col("id").alias(id_col), F.col("keep").cast(kind).alias("keep_id"), "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 128) -> DataFrame:
    """docs without the rows that exact_duplicates does not keep, all columns as they were."""
    rows, plain = keyed(docs, id_col, text_col)
    gone = _judged(rows.select(id_col, text_col, RID), plain, id_col, text_col, digest_bits).filter("NOT kept").select(RID)
    return rows.join(gone, RID, "left_anti").select(*docs.columns)


def _judged(rows: DataFrame, plain: bool, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    if not 4 <= digest_bits <= 256 or digest_bits % 4:
        raise ValueError("digest_bits must be a multiple of 4 in 4..256")
    norm = rows.select(F.col(id_col).alias("id"), RID, normalised(text_col).alias("norm"))
    pieces = norm.withColumn("chunks", F.expr(f"regexp_extract_all(norm, r'{CHUNK}', 0)"))
    identifier = lambda c: F.left(F.sha2(c, 256), F.lit(digest_bits // 4))
    if digest_bits % 8 == 0:
        identifier = lambda c: F.unhex(F.left(F.sha2(c, 256), F.lit(digest_bits // 4)))
    distinct = pieces.select(F.explode("chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("ident"), "chunk").distinct()
    shared = distinct.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ident")
    shared = cut(shared)
    sha = F.sha2("norm", 256).alias("text_sha256")
    if shared.isEmpty():
        recipes = pieces.select("id", RID, sha, F.transform("chunks", identifier).alias("recipe"))
    else:
        ordinal = F.row_number().over(Window.partitionBy("ident").orderBy("chunk"))
        numbered = distinct.join(shared, "ident", "left_semi").withColumn("ordinal", ordinal)
        placed = pieces.select(RID, F.posexplode("chunks").alias("pos", "chunk")).withColumn("ident", identifier(F.col("chunk")))
        told = placed.join(numbered, ["ident", "chunk"], "left").groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("pos", "ident", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("recipe"))
        recipes = norm.select("id", RID, sha).join(told, RID, "left").withColumn("recipe", F.transform(F.coalesce("recipe", F.array().cast(told.schema["recipe"].dataType)), lambda x: F.struct(x["ident"], x["ordinal"])))
    recipes = cut(recipes)
    first = F.min(RID) if plain else F.min_by(F.struct(RID, "id"), RID)
    groups = recipes.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = cut(groups.select("recipe", "size", F.col("first").alias("keep_rid") if plain else F.col(f"first.{RID}").alias("keep_rid"), (F.col("first") if plain else F.col("first.id")).cast(rows.schema[id_col].dataType).alias("keep")))
    return recipes.join(groups, "recipe", "left").select(
        RID,
        "id",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_rid", RID) == F.col(RID)).alias("kept"),
        "text_sha256",
    )
