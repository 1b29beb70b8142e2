"""Line deduplication: explode, hash, count documents, drop, reassemble by position.

Native DataFrame code only.  Text moves once, to meet its own list of dropped
positions; the counting shuffles carry 16-byte keys.  Counting combines before
the shuffle, so a line that a third of all documents hold is one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the columns kept_text, n_lines and n_dropped added.

    A key of at least ``min_chars`` code points in at least ``min_docs``
    different doc_ids keeps its lines only in the largest doc_id that holds it.
    A null or empty text is one empty line and stays.  A null doc_id counts as no
    document: its lines go where a key is dropped elsewhere.  Repeated rows count
    as one document and each gets the same result.  An empty table gives no rows.
    A text of any length is split whole.
    Columns of the input named as those added are replaced.
    """
    rows = docs.drop("kept_text", "n_lines", "n_dropped").withColumns(
        {
            "__text": F.coalesce("text", F.lit("")),
            "__th": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )
    lines = (
        rows.select("doc_id", "__th", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "__th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "__th", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    lines = written(lines, "lines")
    common = (
        lines.groupBy("hash")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .drop("n")
    )
    # As a table of its own the join deals both sides anew, and a line that very many hold can be split.
    common = written(common, "common")
    dropped = (
        lines.join(common, "hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__h"))
        .agg(F.sort_array(F.collect_set("pos")).alias("__gone"))
    )
    all_lines = F.split("__text", "\n", -1)
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    joined = joined.withColumns({"__lines": all_lines, "__gone": gone})
    # The runs between dropped positions, one slice each: linear in the lines.
    runs = F.transform(
        F.sequence(F.lit(0), F.size("__gone")),
        lambda i: F.slice(
            F.col("__lines"),
            F.when(i == 0, 1).otherwise(F.get(F.col("__gone"), i - 1) + 2),
            F.coalesce(F.get(F.col("__gone"), i), F.size("__lines"))
            - F.when(i == 0, 0).otherwise(F.get(F.col("__gone"), i - 1) + 1),
        ),
    )
    return joined.withColumns(
        {
            "kept_text": F.when(F.size("__gone") == 0, F.col("__text")).otherwise(F.array_join(F.flatten(runs), "\n")),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.size("__gone").cast("long"),
        }
    ).drop("__text", "__th", "__id", "__h", "__gone", "__lines")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of :func:`line_dedup` over all documents."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
