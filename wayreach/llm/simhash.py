"""SimHash near-duplicates by a Gray-order hierarchical index.

Documents become 64-bit fingerprints; equal fingerprints collapse to one row
before anything else.  Fingerprints that differ in at most ``distance`` bits agree
on at least one of ``distance + 1`` bit segments, so each is dealt out under each
of its segments; where one alone holds too many, the bits left are cut into segments
again, and once more where two hold too many.  Inside a deal, fingerprints are sorted by Gray rank; groups of neighbours become nodes that
hold the bits their members share (less the bits their parents hold), and a search
descends from the root, adds up the differing shared bits and leaves a whole group
as soon as the sum passes ``distance``.  What leaves a task is a spanning forest of
the links it found, at most a row a fingerprint, whatever the number of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written
from .components import connected_components, spanning_rows

FANOUT = 8
#: Fingerprints of a deal beyond which it is dealt out by one more segment, and how often that is done.
CROWDED, FINER = 4096, 2
PIECE = 1 << 16
#: Pairs that a search may hold at a time.
HELD_PAIRS = 1 << 22


def shingles(text: str | None, size: int):
    """The words joined by a space, and the XXH64 values of their shingles, 65,536 at a time.

    A-Z are lower-cased.  Fewer words than a shingle has are one shingle; no words, none.
    A very long text needs no more memory than its words do.
    """
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest

    def pieces():
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        k = min(size, len(words))
        first, last = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
        for at in range(0, len(first), PIECE):
            yield np.array([digest(line[s:e], 42) for s, e in zip(first[at : at + PIECE], last[at : at + PIECE])], np.uint64)

    return line, pieces() if words else iter(())


def set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set, from the top bit."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` values have set."""
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 values of the text's word shingles; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingles(text, shingle)[1]:
        ones, n = ones + set_bits(h), n + len(h)
    return majority(ones, n)


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), a row a document."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each code in Gray order: prefix XOR from the top bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Nodes over fingerprints that are sorted by (deal, Gray rank); one root a deal."""

    def __init__(self, fp: np.ndarray, deal_start: np.ndarray):
        self.fp = fp
        full = np.full(len(fp), ~np.uint64(0))
        self.levels = [(fp, full, None)]
        start = np.asarray(deal_start)
        bounds = np.append(start, len(fp))
        shared = full
        while True:
            sizes = np.diff(bounds)
            if (sizes == 1).all():
                break
            groups = -(-sizes // FANOUT)
            first_group = np.concatenate([[0], np.cumsum(groups)])
            deal = np.repeat(np.arange(len(groups)), groups)
            child = bounds[:-1][deal] + (np.arange(first_group[-1]) - first_group[:-1][deal]) * FANOUT
            value = self.levels[-1][0]
            apart = np.bitwise_or.reduceat(value ^ np.repeat(value[child], np.diff(np.append(child, len(value)))), child)
            held = np.bitwise_and.reduceat(shared, child) & ~apart
            # What the parent holds its children need not compare again.
            below = self.levels[-1]
            span = np.diff(np.append(child, len(value)))
            self.levels[-1] = (below[0], below[1] & ~np.repeat(held, span), below[2])
            self.levels.append((value[child], held, np.append(child, len(value))))
            shared, bounds = held, first_group
        self.roots = len(self.levels[-1][0])

    def search(self, query: np.ndarray, root: np.ndarray, distance: int):
        """(query index, item index) of all pairs within ``distance``, in the query's own deal."""
        q, node = np.arange(len(query)), root
        gone = np.zeros(len(query), np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            value, mask, children = self.levels[level]
            gone = gone + np.bitwise_count((query[q] ^ value[node]) & mask[node])
            keep = gone <= distance
            q, node, gone = q[keep], node[keep], gone[keep]
            if children is not None and len(q):
                n = children[node + 1] - children[node]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                node = np.repeat(children[node], n) + inside
                q, gone = np.repeat(q, n), np.repeat(gone, n)
        return q, node


def _pairs(fp, deal_no, index, distance):
    """Linked pairs, from so many queries at a time as cannot find more than ``HELD_PAIRS``."""
    size = np.cumsum(np.bincount(deal_no)[deal_no])
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD_PAIRS, "right")))
        q, x = index.search(fp[at:to], deal_no[at:to], distance)
        q = q + at
        yield q[q < x], x[q < x]
        at = to


def segments(distance: int, bits=range(64)) -> list[int]:
    """Bit masks of ``distance + 1`` segments of the bits."""
    bits = list(bits)
    edge = [len(bits) * i // (distance + 1) for i in range(distance + 2)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(edge, edge[1:])]


def finer_segments(distance: int, level: int) -> dict[int, tuple[int, list[int]]]:
    """By kind of deal at a level: the bits that its fingerprints agree on, and the segments of the others.

    A kind is its segments' numbers from 1, a digit each to the base of 64.
    """
    kinds = {0: (0, segments(distance))}
    for _ in range(level):
        kinds = {
            kind * 64 + i + 1: (held | m, segments(distance, [b for b in range(64) if not (held | m) >> b & 1]))
            for kind, (held, masks) in kinds.items() for i, m in enumerate(masks)
        }
    return kinds


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, distance: int = 4, crowded: int = CROWDED) -> DataFrame:
    """a, b: links that join all distinct ``fp`` within ``distance`` bits into their components."""
    masks = F.array(*[F.lit(_signed(m)) for m in segments(distance)])
    dealt = fps.select("fp", F.posexplode(masks).alias("i", "m")).select("fp", (F.col("i") + 1).alias("kind"), F.col("fp").bitwiseAND(F.col("m")).alias("part"))
    for level in range(1, FINER + 1):
        crowds = dealt.groupBy("kind", "part").count().where(F.col("count") > crowded).select("kind", "part", F.lit(True).alias("crowd"))
        table = F.create_map(
            *[x for kind, (_, finer) in finer_segments(distance, level).items() for x in (F.lit(kind), F.array(*[F.lit(_signed(m)) for m in finer]))]
        )
        # Deals of an earlier level that were not crowded are not now either.
        sub = F.when(F.col("crowd"), F.element_at(table, F.col("kind"))).otherwise(F.array(F.lit(0).cast("long")))
        dealt = dealt.join(crowds, ["kind", "part"], "left").select("fp", "kind", "part", "crowd", F.posexplode(sub).alias("i", "m")).select(
            "fp", F.when(F.col("crowd"), F.col("kind") * 64 + F.col("i") + 1).otherwise(F.col("kind")).alias("kind"),
            F.col("part").bitwiseOR(F.col("fp").bitwiseAND(F.col("m"))).alias("part"),
        )
    dealt = dealt.repartition("kind", "part").sortWithinPartitions("kind", "part")

    def run(batches):
        kept = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.concat_tables(kept)
        kind, part = t.column("kind").to_numpy(), t.column("part").to_numpy()
        fp = t.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(fp), part, kind))
        kind, part, fp = kind[order], part[order], fp[order]
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])])
        deal_no = np.cumsum(new) - 1
        index = GrayIndex(fp, np.flatnonzero(new))
        label = spanning_rows(len(fp), _pairs(fp, deal_no, index, distance))
        linked = np.flatnonzero(label != np.arange(len(fp)))
        ends = np.unique(np.stack([fp[linked], fp[label[linked]]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ends[0].view(np.int64)), pa.array(ends[1].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Texts of fewer words than a shingle hash as one.  Repeated rows come out as
    often as they came in.  A null doc_id keeps its row; where a component holds
    no other id its component_id is null.  An empty table gives no rows.  Words
    and shingles of very long texts stream through.  Columns beyond doc_id and text
    are left out, whatever their names.
    """
    marked = written(with_fingerprints(docs, shingle), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(fps.select("fp"), distance)
    parts = connected_components(links, "a", "b")
    classes = fps.join(parts, fps.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "component").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(known, F.col("fp") == F.col("__fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash_components(documents(spark, sf_dir))
