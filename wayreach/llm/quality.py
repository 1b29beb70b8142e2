"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every pairwise interaction of the features is modelled by low-rank factors and
scored in linear time by the sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``.
Of a document's metadata its declared length is a feature; its id, language, source
and labels never are.  The model is fitted on a bounded sample of labelled rows
(``FIT_ROWS``, by hash of the id, and the bounds of ``common.fit_rows``) and is a
fixed 2^16 x 9 table whatever the corpus; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, fit_rows, mix64

#: Bound of the labelled rows that a fit reads.
FIT_ROWS = 6_000
HASH_BITS = 16
RANK = 8
#: Bytes of text that one hashing step works on.
PIECE = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
_N_WORD = 1 << HASH_BITS
STRUCTURE = (
    "log words", "log lines", "characters a word", "words a line", "upper share", "digit share", "mark share",
    "space share", "distinct words share", "commonest word share", "repeated neighbours share", "full stops a line",
    "marks a word", "words with marks inside", "non-ASCII share", "blank lines share",
)
METADATA = ("log declared code points",)
N_FEATURES = _N_WORD + len(STRUCTURE) + len(METADATA)

_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 upper, 3 digit, 4 mark, 5 non-ASCII
_KIND[[32, 9, 10, 11, 12, 13]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4
_KIND[128:] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    p = np.full(n, PRIME, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ASCII-space separated word, A-Z lower-cased, in order."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    solid = _KIND[raw] != 1
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    # Powers restart at every word, so equal words hash alike wherever they stand.
    longest = int((end - start).max())
    power = _powers(longest)
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], end]), np.diff(np.concatenate([[0], end, [len(raw)]])))
    lead = np.repeat(np.append(start - np.concatenate([[0], end[:-1]]), 0), np.diff(np.concatenate([[0], end, [len(raw)]])))
    place = np.clip(place - lead, 0, longest - 1)
    value = np.where(solid, (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0))
    return mix64(np.add.reduceat(value, start) + (end - start).astype(np.uint64))


def features(text: str | None, declared: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's features.  Long texts are hashed in pieces cut at white space.

    ``declared`` is the length that the document's row states; without one its own counts.
    """
    declared = len(text or "") if declared is None or declared < 0 else declared
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KIND[data], minlength=6)[:6]
    hashes, at = [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and _KIND[data[to]] != 1:
            to += 1
        hashes.append(word_hashes(data[at:to]))
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n, size = max(len(h), 1), max(len(data), 1)
    slot, count = np.unique((h >> np.uint64(64 - HASH_BITS)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    norm = np.sqrt((value * value).sum()) or 1.0
    is_mark = _KIND[data] == 4
    lines = 1 + int((data == 10).sum())
    blank = int(((data[1:] == 10) & (data[:-1] == 10)).sum()) if len(data) else 0
    inside = int((is_mark[1:-1] & (_KIND[data[:-2]] != 1) & (_KIND[data[2:]] != 1)).sum()) if len(data) > 2 else 0
    doubled = int((h[1:] == h[:-1]).sum())
    shape = np.array([
        np.log1p(len(h)) / 8, np.log1p(lines) / 6, len(data) / n / 10, min(len(h) / lines / 20, 5), kinds[2] / size * 4,
        kinds[3] / size * 4, kinds[4] / size * 4, kinds[1] / size * 2, len(slot) / n, (count.max() if len(count) else 0) / n * 2,
        doubled / n * 4, min(int((data == 46).sum()) / lines, 5) / 3, kinds[4] / n, inside / n * 4, kinds[5] / size * 2, blank / lines,
        np.log1p(declared) / 10,
    ])
    return np.concatenate([slot, np.arange(_N_WORD, N_FEATURES)]), np.concatenate([value / norm, shape])


@dataclass
class FactorMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factor[index] * value[:, None]
        total = v.sum(axis=0)
        return float(self.bias + (self.weight[index] * value).sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, text: str | None, declared: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text, declared)), -30, 30))))


def fit_machine(
    texts: list[str | None], labels: np.ndarray, declared: list | None = None, epochs: int = 12, rate: float = 0.08, l2: float = 2e-5, seed: int = 7
) -> FactorMachine:
    """AdaGrad on the logistic loss over all rows alike.

    Without rows, or with one class only, the model is a constant.
    """
    y = np.asarray(labels, float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = FactorMachine(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK)))
    if not len(y) or y.min() == y.max():
        model.bias = float(np.log(share / (1 - share)))
        return model
    rng = np.random.default_rng(seed)
    model.factor = rng.normal(0, 0.02, (N_FEATURES, RANK))
    rows = [features(t, d) for t, d in zip(texts, declared or [None] * len(texts))]
    gw, gv, gb = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            p = 1 / (1 + np.exp(-np.clip(model.margin(i, x), -30, 30)))
            g = p - y[r]
            dw = g * x + l2 * model.weight[i]
            v = model.factor[i]
            vx = v * x[:, None]
            dv = g * (x[:, None] * vx.sum(axis=0) - vx * x[:, None]) + l2 * v
            gb += g * g
            gw[i] += dw * dw
            gv[i] += dv * dv
            model.bias -= rate * g / np.sqrt(gb)
            model.weight[i] -= rate * dw / np.sqrt(gw[i])
            model.factor[i] -= rate * 0.5 * dv / np.sqrt(gv[i])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out, rows: int = FIT_ROWS) -> tuple[list, np.ndarray, list]:
    """Texts, 0/1 labels and declared lengths of at most ``rows`` labelled documents that aren't held out, by hash of the id."""
    known = labels.where(F.col(column).isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col(column).alias("__y"))
    # Ids first: the texts are fetched for a bounded number of ids only.
    ids = known.where(~held_out(F.col("__id"))).orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(rows)
    table = fit_rows(_declared(docs), ids, "__declared")
    return table["text"].tolist(), table["__y"].to_numpy(), [None if d != d or d is None else int(d) for d in table["__declared"].tolist()]


def _declared(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__declared", F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long"))


def is_held_out(doc_id):
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(False))


def score_quality(docs: DataFrame, model: FactorMachine, carry: tuple | list = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, score and predicted for every row; a null text scores as an empty one.

    A score of 0.5 is predicted 1.  Equal rows score alike and each comes out; an
    empty table gives no rows.  Texts of any length are scored whole.  Columns not
    carried are left out, whatever their names; carried columns named score or
    predicted raise, so name the input's apart first.
    """
    if {"score", "predicted"} & set(carry):
        raise ValueError("score and predicted are columns of the result; rename those to carry")
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight.astype(np.float32), model.factor.astype(np.float32)))
    rows = _declared(docs).select(*carry, F.col("text").alias("__scored"), "__declared")
    schema = T.StructType(rows.schema.fields[:-2]).add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches):
        m = FactorMachine(*shared.value)
        for b in batches:
            s = np.array([m.score(t, d) for t, d in zip(b.column("__scored").to_pylist(), b.column("__declared").to_pylist())], float)
            kept = [b.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*carry, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame) -> FactorMachine:
    return fit_machine(*labelled_sample(docs, labels, "quality", is_held_out))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels with crc32(doc_id) mod 3 = 1 are held out of the fit."""
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
