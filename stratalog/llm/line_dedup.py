"""Removal of lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fold_ascii, named

MIN_CHARS = 40
MIN_DOCUMENTS = 5


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text):
    """Array of (position, h1, h2) of the lines whose key is long enough to count; the two hashes make 128 bits."""
    keys = F.transform(
        _lines(fold_ascii(text)),
        lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(SPACES)).alias("key")),
    )
    return F.filter(keys, lambda x: F.char_length(x["key"]) >= MIN_CHARS)


def holders(lines: DataFrame, min_documents: int) -> DataFrame:
    """(__h1, __h2, __keeper) of hashes found in at least min_documents different documents, from rows (__id, __h1, __h2) that may repeat. Both sums are begun before their shuffles, the first of which deals a hot line's rows by document."""
    once = lines.groupBy("__h1", "__h2", "__id").agg(F.lit(1).alias("__one"))
    return once.groupBy("__h1", "__h2").agg(F.sum("__one").alias("__n"), F.max("__id").alias("__keeper")).where(F.col("__n") >= min_documents).drop("__n")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    r"""All columns of docs, with `text` without its shared lines, and n_lines_before and n_lines_dropped.

    A text is split at \n. A line's key is the line without spaces, tabs and other ASCII blanks at its ends and with A-Z lower-cased. A key of at least 40 code points that is found in at least min_documents documents, counted by doc_id, loses all its lines, but for those in the document with the largest doc_id.
    Each document's distinct keys are exploded and hashed. A hash's rows of one document are made one before documents are counted, with map-side sums in both steps. Only ids, positions and hashes are joined with the hashes over the threshold (a join that adaptive execution may split); the text meets the list of its dropped positions in one more join, and is put together from the positions that stay.

    Null text is an empty one: one empty line. An empty table gives an empty one. Rows with one doc_id are one document when documents are counted, and all of them keep a line that their id keeps; a null doc_id is smaller than any other and is one document, too. Of ties there are none: the keeper is the largest id. Columns named n_lines_before or n_lines_dropped are replaced; all others, of whatever names, stay.
    """
    base = docs.select(
        named(doc_id).alias("__id"),
        F.xxhash64(named(text)).alias("__row"),
        F.explode(_keys(named(text))).alias("__k"),
    ).select(
        "__id",
        "__row",
        F.col("__k.pos").alias("__pos"),
        F.xxhash64(F.col("__k.key")).alias("__h1"),
        F.xxhash64(F.lit("second"), F.col("__k.key")).alias("__h2"),
    )
    distinct = docs.select(
        named(doc_id).alias("__id"),
        F.explode(F.array_distinct(F.transform(_keys(named(text)), lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("second"), x["key"]).alias("h2"))))).alias("__k"),
    ).select("__id", F.col("__k.h1").alias("__h1"), F.col("__k.h2").alias("__h2"))
    shared = holders(distinct, min_documents)
    # Joined by a mix of the hashes, so that both sides are dealt anew and a line that very many documents share can be split over tasks; the sums' own partitioning would bind it to one.
    mixed = lambda df: df.withColumn("__mix", F.col("__h1").bitwiseXOR(F.col("__h2")))
    dropped = (
        mixed(base)
        .join(mixed(shared), ["__mix", "__h1"])
        .where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy("__id", "__row")
        .agg(F.collect_set("__pos").alias("__drop"))
        .withColumnsRenamed({"__id": "__did", "__row": "__drow"})
    )
    rest = [c for c in docs.columns if c not in ("n_lines_before", "n_lines_dropped")]
    # The document travels as one struct, so that its columns may have any names.
    whole = docs.select(F.struct(*[named(c) for c in rest]).alias("__doc"), named(doc_id).alias("__id"), F.xxhash64(named(text)).alias("__row"), _lines(named(text)).alias("__lines"))
    joined = whole.join(dropped, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__row") == F.col("__drow")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    own = lambda c: F.col("__doc").getField(c)
    kept = F.when(F.col("__drop").isNull(), own(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n"))
    return joined.select(
        *[kept.alias(text) if c == text else own(c).alias(c) for c in rest],
        F.size("__lines").cast("long").alias("n_lines_before"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_lines_dropped"),
    )


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_lines_before").alias("n_lines"),
        F.col("n_lines_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.doc_id, pos, line, shared.k IS NOT NULL AND keyed.doc_id <> keeper AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
