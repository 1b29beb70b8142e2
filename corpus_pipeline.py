"""A training-data pipeline from five corpus operators, each stage written and reread.

STAGES lists (name, function); a function takes (spark, docs, sf_dir).  All but the
last return the columns of documents.  Null and empty texts crash no stage; an empty
table gives an empty result; columns beyond those of documents are dropped, so
clashing names do no harm.  Texts of any length are read whole.  Ties and repeated
rows: each stage's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayreach.llm.byte_bpe import byte_bpe
from wayreach.llm.common import documents, written
from wayreach.llm.line_dedup import line_dedup
from wayreach.llm.mixing import WORD, plan_mix, text_digest
from wayreach.llm.near_duplicates import similar_components
from wayreach.llm.quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go.

    The classifier is fitted on the labelled documents of ``sf_dir``.  Equal texts
    score alike, so repeated rows stay or go together; a score of 0.5 stays.
    """
    model = fit_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of these only.

    Repeated rows are one document and lose the same lines.
    """
    out = line_dedup(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    return out.select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Near duplicates have a Jaccard similarity of 0.8 or more of their sets of five-word
    shingles, or are joined by others that have.  Repeated rows of a document become one.  Rows with a null doc_id have no rank in a group
    and stay, each text once.
    """
    groups = similar_components(docs, shingle=5, similarity=0.8)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.select(*COLUMNS)
    rows = rows.join(kept, rows.doc_id == F.col("__kept"), "left").where("__kept is not null or doc_id is null")
    return rows.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).select(*COLUMNS)


def _key(text_hash):
    """Tells rows of COLUMNS apart, nulls from values too."""
    return F.unhex(F.md5(F.to_json(F.struct("doc_id", "source", "lang", "n_chars", text_hash.alias("text"))).cast("binary")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, once for each pass that takes them.

    The document at the end of its source's demand is cut after its last word taken.
    Documents of which nothing is taken, so those without words too, go.  Repeated
    rows are documents of their own: each comes as often as the plan takes it.
    """
    plan = written(plan_mix(docs, also=("lang", "n_chars")), "plan").where("taken > 0").select(
        _key(F.col("text_hash")).alias("__key"), F.col("size").alias("__size"),
        F.explode(
            F.array(
                F.struct(F.col("taken_first").alias("take"), F.col("position").alias("at")),
                F.struct(F.col("taken_again").alias("take"), F.col("position_again").alias("at")),
            )
        ).alias("__pass"),
    )
    plan = plan.where("__pass.take > 0")
    # The plan has a row for each of several equal documents; the text joins it once.
    rows = docs.select(*COLUMNS, _key(text_digest(F.col("text"))).alias("__key")).dropDuplicates(["__key"])
    mixed = rows.join(plan, "__key")
    # Each word with the white space before it: the first so many are the part up to that word's end.
    words = F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*+" + WORD), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("__pass.take").cast("int")), "")
    whole = F.col("__pass.take") == F.col("__size")
    cut = F.when(whole, F.col("text")).otherwise(part)
    return mixed.orderBy("__pass.at", "doc_id").select(
        "doc_id", cut.alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.char_length(cut).cast("long")).alias("n_chars")
    )


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that the mix takes, with what they decode to checked by digest.

    A row comes out for each that comes in, repeated ones too.
    """
    import public_tokenizers

    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A fitted classifier, components and BPE are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
