"""Document fingerprints: canonical exact digests.

A text is brought to Unicode form NFKC, case-folded and freed of white-space
differences, then hashed with the 128-bit xxhash.  Texts whose digests are equal are
compared byte for byte: copies collapse to one row a task before the shuffle, and a
digest whose texts differ gives each different text a number of its own.

The query's edited texts need the next document by id.  Rows are sorted by ranges of
id and each task walks through its own range; its first and last document go out as
well, and the last of a range meets the first of the next in a second, small step.
The only text that moves is each document once, to its range.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, task_count, written

#: Bytes of canonical texts a task remembers, to hand each on once.
REMEMBERED = 32 << 20


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, NFKC again, runs of white space one space, none at the ends; null as empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8")


def digest(canon: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon)


def with_digests(docs: DataFrame) -> DataFrame:
    """doc_id, tie (md5 of the text), digest: a row a document, without a shuffle."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            d = [digest(canonical(t)) for t in texts]
            tie = [hashlib.md5((t or "").encode("utf-8")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tie, pa.string()), pa.array(d, pa.string())], ["doc_id", "tie", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tie string, digest string")


def clashes(canon: DataFrame) -> DataFrame:
    """digest, text_sha, number: the different canonical texts of digests that have more than one.

    Input: digest and canon (bytes), null where nothing is to compare.  Least and
    greatest bytes of a bucket are equal exactly when all its texts are; both
    combine before the shuffle.
    """
    known = canon.where(F.col("canon").isNotNull())
    torn = known.groupBy("digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo != hi").select("digest")
    texts = known.join(torn, "digest", "left_semi").select("digest", F.sha2("canon", 256).alias("text_sha")).distinct()
    return texts.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("text_sha")))


_PAIR_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " next_fingerprint string, canon binary, edited_canon binary, sha binary, edited_sha binary, next_sha binary"
)
_PAIR = [(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in _PAIR_SCHEMA.split(",")]
#: What a task says of its first (head) and last (open) document; null in the rows of pairs.
_EDGE = [("part", pa.int32()), ("head", pa.bool_()), ("text", pa.string()), ("flag", pa.bool_())]


class _Walker:
    """Turns documents and their next ones into rows; hands the same bytes on once."""

    def __init__(self, edit_share: int):
        self.edit_share, self.seen, self.size = edit_share, {}, 0

    def once(self, d: str, c: bytes):
        """The bytes, where this task has not handed on the same under this digest before."""
        if self.seen.get(d) == c:
            return None
        if self.size > REMEMBERED:
            self.seen.clear()
            self.size = 0
        self.seen[d] = c
        self.size += len(c) + 100
        return c

    @staticmethod
    def opened(name, text: str, flag: bool) -> tuple:
        canon = canonical(text)
        return name, text, digest(canon), canon, flag, hashlib.sha256(canon).digest()

    def pair(self, own: tuple, after: tuple) -> tuple:
        name, text, d, canon, flag, sha = own
        _, next_text, next_d, _, _, next_sha = after
        n = len(text)
        k = n // self.edit_share
        edited = text[: n - k] + next_text[:k] if k else text
        ecanon = canonical(edited)
        ed = digest(ecanon)
        # An edited text can only share a bucket with its own document's or its next one's text here.
        near = ed in (d, next_d)
        return (
            name, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), d, ed, next_d,
            self.once(d, canon) if flag or near or d == next_d else None, self.once(ed, ecanon) if near else None,
            sha, hashlib.sha256(ecanon).digest(), next_sha,
        )


def fingerprints(docs: DataFrame, edit_share: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text's last floor(n_chars / ``edit_share``) code points give way to the first
    as many (or all) of the next document in descending doc_id, the first following
    the last.  Exact digests are alike (1.0) or not (0.0).  Null texts are empty.
    Repeated ids follow each other by descending md5 of the text; rows with a null
    id come last, in the same order.  A single document is its own next.  An empty
    table gives no rows.  Texts of any length are taken whole.  Columns beyond
    doc_id and text are left out, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5(text.cast("binary")).alias("tie"), text.alias("text"), F.lit(1).alias("kind"))
    equal = written(with_digests(docs), "digests")
    # As a table of its own the join deals both sides anew, and a digest that very many share can be split.
    shared = written(equal.groupBy("digest").count().where("count > 1").select("digest"), "shared")
    flags = equal.join(shared, "digest", "left_semi").select(F.col("doc_id").alias("id"), "tie").distinct()
    every = rows.unionByName(flags.select("id", "tie", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind")))
    # A flag comes before the rows that it is for.
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc()]
    every = every.repartitionByRange(task_count(docs), *order).sortWithinPartitions(*order, "kind")
    fields = _PAIR + _EDGE

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

    def run(batches):
        from pyspark import TaskContext

        part, walker, held, flagged = TaskContext.get().partitionId(), _Walker(edit_share), None, None
        edge = lambda at, head: (at[0], *[None] * (len(_PAIR) - 1), part, head, at[1], at[4])
        for b in batches:
            out = []
            for name, tie, own, kind in zip(*(b.column(c).to_pylist() for c in ("id", "tie", "text", "kind"))):
                if kind == 0:
                    flagged = (name, tie)
                    continue
                now = walker.opened(name, own, flagged == (name, tie))
                out.append(edge(now, True) if held is None else (*walker.pair(held, now), *[None] * len(_EDGE)))
                held = now
            if out:
                yield batch(out)
        if held is not None:
            yield batch([edge(held, False)])

    walked = written(every.select("id", "tie", "text", "kind").mapInArrow(run, f"{_PAIR_SCHEMA}, part int, head boolean, text string, flag boolean"), "walked")
    # One row a range that holds documents: its last one's next is the first of the range after it, round the end.
    edges = walked.where("part is not null").select("doc_id", "part", "head", "text", "flag")
    turn = Window.orderBy("part")
    parts = edges.where("head").select("part").withColumn("to", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())))
    heads = edges.where("head").select(F.col("part").alias("to"), F.col("text").alias("next_text"))
    meet = edges.where("not head").join(parts, "part").join(heads, "to").select("doc_id", "text", "flag", "next_text")

    def close(batches):
        walker = _Walker(edit_share)
        for b in batches:
            out = [
                walker.pair(walker.opened(name, own, flag), walker.opened(None, after, False))
                for name, own, flag, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "flag", "next_text")))
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out), _PAIR)], [n for n, _ in _PAIR])

    inner = walked.where("part is null").select(*[n for n, _ in _PAIR])
    made = inner.unionByName(written(meet.mapInArrow(close, _PAIR_SCHEMA), "edges"))
    canon = made.select(F.col("fingerprint").alias("digest"), "canon").unionByName(
        made.select(F.col("edited_fingerprint").alias("digest"), F.col("edited_canon").alias("canon"))
    )
    torn = written(clashes(canon), "clashes")
    out = made.drop("canon", "edited_canon")
    if not torn.isEmpty():  # only where a 128-bit digest has two texts
        for name, sha in (("fingerprint", "sha"), ("edited_fingerprint", "edited_sha"), ("next_fingerprint", "next_sha")):
            own = (F.col(name) == F.col("digest")) & (F.lower(F.hex(sha)) == F.col("text_sha"))
            named = F.when(F.col("number").isNotNull(), F.concat_ws("-", name, F.col("number").cast("string"))).otherwise(F.col(name))
            out = out.join(torn, own, "left").withColumn(name, named).drop("digest", "text_sha", "number")
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, sf_dir))
