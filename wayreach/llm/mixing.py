"""Mixing sources to target weights along a time-varying curriculum.

Native DataFrame code only.  Each source repeats its documents in a fixed hash
order; the mix takes the first ``target`` words of that line of passes, so the
words taken meet the target to the word, and no document is taken more than
twice.  A source's weight schedule over training time is w(t) = 1 + a (2t - 1);
its integral W(t) = (1 - a) t + a t^2 is inverted at each document's share of the
source's cumulative demand, which gives its training position in [0, 1).

Prefix sums run in two levels (hash buckets of about 4,096 different rows, then
inside a bucket), so a source with a third of all rows is spread over its buckets.
Rows are hashed by id and text, so null or repeated ids are spread too, and equal
rows are one row with a count until the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_DOCS = 4096


def source_targets(sized: DataFrame, ratio: float = 1.5, cap: int = 2) -> DataFrame:
    """Per source: source_size, target, slope of its schedule.  One row a source.

    Weights 5, 2, 1 repeat over the sources in code point order, null last.
    ``ratio`` times all sizes are shared by weight; a target stops at ``cap``
    times its source's size and the excess goes to the rest by weight.  In the
    order of cap to weight the stopped sources are a prefix, so running sums find
    the level at once.  The windows here see one row a source.
    """
    per = sized.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("source_size"), F.count("*").alias("__docs"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    per = per.withColumn("__rank", F.row_number().over(by_name))
    per = per.withColumns(
        {
            "__w": F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("__rank") - 1) % 3 + 1),
            "__cap": F.col("source_size") * cap,
        }
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "__level",
        (F.sum("source_size").over(everything) * F.lit(float(ratio)) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0))),
    )
    free = F.col("__cap") / F.col("__w") > F.col("__level")
    # From the first free source on the running level falls, so the largest is the first's.
    level = F.max(F.when(free, F.col("__level"))).over(everything)
    return per.withColumns(
        {
            "target": F.when(free, F.least(F.col("__cap").cast("double"), F.col("__w") * level)).otherwise(
                F.col("__cap").cast("double")
            ),
            "__slope": F.when(F.count("*").over(everything) == 1, F.lit(0.0)).otherwise(
                F.lit(0.8) - F.lit(1.6) * (F.col("__rank") - 1) / (F.count("*").over(everything) - 1)
            ),
        }
    ).select("__source", "source_size", "__docs", "target", "__slope")


def _position(share, slope):
    """The time at which a source has met ``share`` of its demand."""
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + F.lit(4.0) * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise((root - b) / (F.lit(2.0) * slope))


def text_digest(text):
    """A text's md5; null as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def plan_mix(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, source, the columns ``also``, text_hash, size, source_size, target, taken, taken_first, taken_again, position, position_again.

    ``taken_first`` and ``taken_again`` are the words taken in the first and second
    pass over the source; only the document at the end of the demand is cut.
    ``position`` is null where nothing is taken, ``position_again`` where the second
    pass takes nothing.  Null texts and texts of white space have size 0 and nothing
    is taken; a null source is a source of its own; a null doc_id is a value like
    any other.  Repeated rows are separate documents that follow each other.
    Sources without words have target 0, and an empty table gives no rows.  A text
    of any length is counted whole, in one pass.  Two documents never tie: order is
    by hash, then id, then text.  Other columns of the input are not read.
    """
    own = ["doc_id", "source", *also]
    sized = docs.select(
        *own,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        text_digest(F.col("text")).alias("text_hash"),
    )
    sized = sized.withColumns(
        {
            "__source": F.col("source"),
            "__order": F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash").cast("binary")),
        }
    )
    sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("__copies"))
    sized = written(sized, "sizes")
    targets = source_targets(sized)
    rows = sized.join(targets.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
    unit = F.conv(F.substring("__order", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    rows = rows.withColumn("__bucket", F.floor(unit * F.ceil(F.col("__docs") / BUCKET_DOCS)).cast("long"))
    words = F.col("__size") * F.col("__copies")
    sums = rows.groupBy(F.col("__source").alias("__bs"), F.col("__bucket").alias("__bb")).agg(F.sum(words).alias("__sum"))
    over = Window.partitionBy("__bs").orderBy("__bb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__bs", "__bb", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
    rows = rows.join(sums, F.col("__source").eqNullSafe(F.col("__bs")) & (F.col("__bucket") == F.col("__bb")))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "doc_id", "text_hash", *also)
    start = F.col("__base") + F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - words
    rows = rows.withColumns({"__start": start, "__goal": F.round("target").cast("long")})
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    rows = rows.withColumn("__start", F.col("__start") + F.col("__copy") * F.col("__size"))
    first = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__goal") - F.col("__start")))
    again = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__goal") - F.col("source_size") - F.col("__start")))
    rows = rows.withColumns({"taken_first": first, "taken_again": again})
    taken = F.col("taken_first") + F.col("taken_again")
    return rows.select(
        *own,
        "text_hash",
        F.col("__size").alias("size"),
        "source_size",
        "target",
        taken.alias("taken"),
        "taken_first",
        "taken_again",
        F.when(taken > 0, _position(F.col("__start") / F.col("__goal"), F.col("__slope"))).alias("position"),
        F.when(
            F.col("taken_again") > 0,
            _position((F.col("source_size") + F.col("__start")) / F.col("__goal"), F.col("__slope")),
        ).alias("position_again"),
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix over all documents, range-sorted by training position (untaken documents last)."""
    plan = plan_mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    out = plan.select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat(CAST(doc_id AS VARCHAR), ':', md5(coalesce(text, '')))) AS ord
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, count(*) OVER () AS n FROM per
), weighed AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap FROM ranked
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0
      - CAST(coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed
), shared AS (
  SELECT source, source_size, rk, n,
    CASE WHEN cap / CAST(w AS DOUBLE) > level
      THEN least(CAST(cap AS DOUBLE), w * max(CASE WHEN cap / CAST(w AS DOUBLE) > level THEN level END) OVER ())
      ELSE CAST(cap AS DOUBLE) END AS target,
    CASE WHEN n = 1 THEN 0e0 ELSE 0.8e0 - 1.6e0 * (rk - 1) / (n - 1) END AS a
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.a, CAST(round(s.target) AS BIGINT) AS goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM sized d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source
), cut AS (
  SELECT *, greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) AS taken,
    least(size, goal - source_size - start) AS again
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN
    CASE WHEN abs(a) < 1e-9 THEN start / CAST(goal AS DOUBLE)
    ELSE (sqrt((1e0 - a) * (1e0 - a) + 4e0 * a * (start / CAST(goal AS DOUBLE))) - (1e0 - a)) / (2e0 * a) END
  END AS position,
  CASE WHEN again > 0 THEN
    CASE WHEN abs(a) < 1e-9 THEN (source_size + start) / CAST(goal AS DOUBLE)
    ELSE (sqrt((1e0 - a) * (1e0 - a) + 4e0 * a * ((source_size + start) / CAST(goal AS DOUBLE))) - (1e0 - a)) / (2e0 * a) END
  END AS position_again
FROM cut
"""
