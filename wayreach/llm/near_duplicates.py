"""Documents whose word shingles have at least a given Jaccard similarity, by Gray-order indexes.

A pair at a similarity of 0.8 differs in some 10 of a fingerprint's 64 bits.  The bit
segments that deal fingerprints out for 4 bits (``simhash.py``) would be too short to
part anything at 10, so here documents are dealt out by the least hashes of their
shingles: ``BANDS`` keys of ``ROWS`` least hashes each.  Inside a deal the fingerprints
are sorted by Gray rank and searched by the same index with a wide distance, and
every link that it proposes is settled by the exact similarity of the shingle sets.

A deal that holds too many is dealt out again by other groups of the hashes, twice.
What leaves a deal is a spanning forest of its links, at most a row a document,
whatever the number of links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, written
from .components import connected_components, spanning_rows
from .simhash import HELD_PAIRS, GrayIndex, gray_rank, majority, set_bits, shingles

#: Keys of a level, and least hashes in a key: a pair at 0.8 shares one with a probability of 0.998.
BANDS, ROWS = 12, 4
#: Differing bits up to which the index proposes a pair; one at 0.8 has 9.7, with a deviation of 2.9.
DISTANCE = 20
#: Distances at which a deal is searched in turn, so that near pairs are joined before far ones.
STEPS = (4, 8, 12, 16, DISTANCE)
#: Members beyond which a deal is dealt out again, and how often that is done.
CROWDED, FINER = 2048, 2
#: Forests of pairs that are checked pair by pair, and the pairs of a row that are always checked so.
FOREST_ROUNDS, FEW_PAIRS = 3, 50
#: Hashes whose products are held at a time.
HELD_HASHES = 4096


def _multipliers() -> np.ndarray:
    return mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _groupings() -> np.ndarray:
    """By level and band the numbers of its least hashes; bands of two levels share at most one or two."""
    band, row = np.arange(BANDS)[:, None], np.arange(ROWS)[None, :]
    n = BANDS * ROWS
    return np.stack([band * ROWS + row, band + row * BANDS, (band + row * (BANDS + 1)) % n])


def shingle_set(text: str | None, size: int) -> tuple[bytes, np.ndarray]:
    """The 128-bit name of the text's words, and the distinct hashes of its shingles."""
    import xxhash

    line, pieces = shingles(text, size)
    return xxhash.xxh3_128_digest(line), np.unique(np.concatenate([np.empty(0, np.uint64), *pieces]))


def sketch(text: str | None, size: int):
    """The name of the text's words, the majority bits of its distinct shingles' hashes, and its keys."""
    name, h = shingle_set(text, size)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), HELD_HASHES):
        part = h[at : at + HELD_HASHES]
        least = np.minimum(least, (part[:, None] * _MULTIPLIERS).min(axis=0))
        ones += set_bits(part)
    keys = np.zeros((len(_GROUPINGS), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mix64(keys * np.uint64(31) + least[_GROUPINGS[:, :, row]])
    return name, majority(ones, len(h)), keys.ravel()


_MULTIPLIERS, _GROUPINGS = _multipliers(), _groupings()


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            made = [sketch(t, size) for t in b.column("text").to_pylist()]
            keys = np.array([k for _, _, k in made], np.uint64).view(np.int64).ravel()
            offsets = np.arange(len(made) + 1, dtype=np.int32) * (len(_GROUPINGS) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([n for n, _, _ in made], pa.binary()),
                    pa.array(np.array([x for _, x, _ in made], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                ],
                ["doc_id", "name", "fp", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, name binary, fp long, keys array<long>")


def join_nearest(label: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Labels with the pairs' components joined, and the places of pairs that are a forest of these; earlier pairs first."""
    label, at, chosen = label.copy(), np.arange(len(left)), []
    while len(at):
        a, b = label[left[at]], label[right[at]]
        apart = a != b
        at, high, low = at[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        # Each root but the least of its links hangs itself below one other: no cycles, one pair a root.
        roots, which = np.unique(high, return_index=True)
        label[roots] = low[which]
        chosen.append(at[which])
        while not np.array_equal(up := label[label], label):
            label = up
    return label, np.concatenate(chosen) if chosen else at


def is_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; two empty ones have."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b):
        return False
    shared = np.count_nonzero(b.take(np.searchsorted(b, a), mode="clip") == a) if len(a) else 0
    return shared >= similarity * (len(a) + len(b) - shared)


class Deals:
    """Rows of some deals in the order of deal and Gray rank, with an index over each deal."""

    def __init__(self, deal: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), deal))
        deal, self.fp = deal[self.order], fp[self.order]
        new = np.concatenate([[True], deal[1:] != deal[:-1]])
        self.number, self.start = np.cumsum(new) - 1, np.flatnonzero(new)
        self.index = GrayIndex(self.fp, self.start)

    def apart(self, q, x):
        return np.bitwise_count(self.fp[q] ^ self.fp[x])

    def first_pairs(self):
        """Each row with its deal's row nearest to the deal's majority bits, and neighbours in Gray order."""
        rows, n = np.arange(len(self.fp)), np.diff(np.append(self.start, len(self.fp)))
        bits = np.unpackbits(self.fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, self.start, axis=0, dtype=np.int64)
        middle = np.packbits(ones * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        centre = np.lexsort((np.bitwise_count(self.fp ^ middle[self.number]), self.number))[self.start][self.number]
        q, x = np.concatenate([rows, rows[:-1]]), np.concatenate([centre, rows[1:]])
        good = (q != x) & (self.number[q] == self.number[x])
        q, x = q[good], x[good]
        good = self.apart(q, x) <= DISTANCE
        return q[good], x[good]

    def pairs(self, distance: int, label: np.ndarray):
        """Pairs within ``distance``, but for those inside the largest component of a deal."""
        size = np.bincount(label, minlength=len(label))
        largest = np.lexsort((-size, self.number))[self.start]
        asking = label != largest[self.number]
        ask = np.flatnonzero(asking)
        held = np.cumsum(np.bincount(self.number)[self.number[ask]])
        at = 0
        while at < len(ask):
            to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + HELD_PAIRS, "right")))
            q, x = self.index.search(self.fp[ask[at:to]], self.number[ask[at:to]], distance)
            q = ask[at:to][q]
            once = (q < x) | ~asking[x]
            yield q[once], x[once]
            at = to


class SharedCounts:
    """How many shingles a row shares with each row of its deal."""

    def __init__(self, deals: Deals, sets):
        self.deals, self.sets = deals, [sets[i] for i in deals.order]
        self.size = np.array([len(x) for x in self.sets], np.int64)
        self.deal = None

    def shared(self, row: int, deal: int) -> np.ndarray:
        first = self.deals.start[deal]
        if deal != self.deal:
            last = self.deals.start[deal + 1] if deal + 1 < len(self.deals.start) else len(self.sets)
            self.edge = np.concatenate([[0], np.cumsum(self.size[first:last])])
            values, self.code = np.unique(np.concatenate(self.sets[first:last]), return_inverse=True)
            self.mark, self.deal = np.zeros(len(values), bool), deal
        mine = self.code[self.edge[row - first] : self.edge[row - first + 1]]
        self.mark[mine] = True
        upto = np.concatenate([[0], np.cumsum(self.mark[self.code])])
        self.mark[mine] = False
        return np.diff(upto[self.edge])


def near_groups(deal: np.ndarray, fp: np.ndarray):
    """Rows that have others within ``DISTANCE`` in their deal, and a deal for each group of these."""
    deals = Deals(deal, fp)
    first = deals.first_pairs()
    label = spanning_rows(len(fp), [first])
    label = spanning_rows(len(fp), itertools.chain([first], deals.pairs(DISTANCE, label)))
    near = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    root = label[near]
    return deals.order[near], mix64(mix64(deal[deals.order[root]].view(np.uint64)) ^ deals.fp[root]).view(np.int64)


def exact_links(deal: np.ndarray, fp: np.ndarray, sets, similarity: float):
    """Index pairs that join rows of a deal at or above ``similarity`` into their components.

    Every pair within ``DISTANCE`` is either checked by its sets or has been joined
    through others before.  Likely and near pairs are checked first, and rows of a
    deal's largest component search for none, so few are checked in a group of copies.
    """
    deals = Deals(deal, fp)
    order, label = deals.order, np.arange(len(fp))

    def link(q, x):
        nonlocal label
        label, at = join_nearest(label, q, x)
        return order[q[at]], order[x[at]]

    def settle(q, x):
        nearest = np.argsort(deals.apart(q, x), kind="stable")
        q, x = q[nearest], x[nearest]
        for _ in range(FOREST_ROUNDS):
            apart = label[q] != label[x]
            q, x = q[apart], x[apart]
            if not len(q):
                return
            at = join_nearest(label, q, x)[1]
            good = at[[is_similar(sets[order[i]], sets[order[j]], similarity) for i, j in zip(q[at].tolist(), x[at].tolist())]]
            yield link(q[good], x[good])
            q, x = np.delete(q, at), np.delete(x, at)
        # Many pairs that look alike are not similar: the rest of a row's pairs are counted at once.
        by_row = np.argsort(q, kind="stable")
        q, x = q[by_row], x[by_row]
        edge = np.append(np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])), len(q)) if len(q) else [0]
        for i, j in itertools.pairwise(edge):
            row, others = q[i], x[i:j][label[x[i:j]] != label[q[i]]]
            if len(others) < FEW_PAIRS:
                good = [k for k in others.tolist() if is_similar(sets[order[row]], sets[order[k]], similarity)]
                good = np.array(good, np.int64)
            else:
                shared = counts.shared(row, deals.number[row])[others - deals.start[deals.number[row]]]
                good = others[shared >= similarity * (counts.size[row] + counts.size[others] - shared)]
            if len(good):
                yield link(np.full(len(good), row), good)

    counts = SharedCounts(deals, sets)
    yield from settle(*deals.first_pairs())
    for before, step in itertools.pairwise((-1, *STEPS)):
        for q, x in deals.pairs(step, label):
            fresh = deals.apart(q, x) > before
            yield from settle(q[fresh], x[fresh])


def _by_deal(rows: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of tables of whole deals of at least two rows, some deals at a time."""

    def alone(t):
        deal = t.column("deal").to_numpy()
        first = np.concatenate([[True], deal[1:] != deal[:-1]])
        return t.filter(pa.array(~(first & np.append(first[1:], True))))

    def run(batches):
        # Rows come in the order of their deals; the last deal of a batch may go on in the next.
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            deal = b.column("deal").to_numpy()
            if held and held[-1].column("deal")[-1].as_py() != deal[0] or deal[0] != deal[-1]:
                cut = int(np.searchsorted(deal, deal[-1]))
                t = alone(pa.Table.from_batches([*held, b.slice(0, cut)]))
                if t.num_rows:
                    yield from work(t)
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            t = alone(pa.Table.from_batches(held))
            if t.num_rows:
                yield from work(t)

    return rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, schema)


def _dealt(classes: DataFrame, crowded: int) -> DataFrame:
    """deal, fp, name: a row for each key of a class, crowded deals dealt out anew."""
    todo, out = classes.select("name", "fp", "keys", F.lit(0).alias("deal")), None
    for level in range(FINER + 1):
        keys = F.slice("keys", level * BANDS + 1, BANDS)
        dealt = todo.select("name", "fp", "deal", F.posexplode(keys).alias("band", "key")).select(
            "name", "fp", F.xxhash64("deal", "band", "key").alias("deal")
        )
        if level < FINER:
            crowds = dealt.groupBy("deal").count().where(F.col("count") > crowded).select(F.col("deal").alias("__deal"))
            crowds = written(crowds, "crowds")
            todo = dealt.join(crowds, F.col("deal") == F.col("__deal"), "left_semi").select(F.col("name").alias("__name"), "deal")
            todo = classes.select("name", "fp", "keys").join(todo, F.col("name") == F.col("__name"))
            dealt = dealt.join(crowds, F.col("deal") == F.col("__deal"), "left_anti")
        out = dealt if out is None else out.unionByName(dealt)
    return out


def similar_links(docs: DataFrame, classes: DataFrame, size: int, similarity: float, crowded: int = CROWDED) -> DataFrame:
    """a, b: names of different texts at or above ``similarity``, enough to join them into components.

    ``classes`` has a row (name, fp, keys, least) for each different text.  Only texts
    with others near them travel as sets, of 32 bits a shingle, to their deals.
    """

    def near(t: pa.Table):
        at, deal = near_groups(t.column("deal").to_numpy(), t.column("fp").to_numpy().view(np.uint64))
        name = t.column("name").combine_chunks().take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(deal), name], ["deal", "name"])

    near_rows = written(_by_deal(_dealt(classes, crowded), near, "deal long, name binary"), "near")

    def sets_of(batches):
        for b in batches:
            made = [shingle_set(t, size) for t in b.column("text").to_pylist()]
            cut = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for _, h in made]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.binary()), pa.array(cut, pa.binary())], ["name", "set"])

    ends = classes.select("name", "fp", "least").join(near_rows.select("name").distinct(), "name", "left_semi")
    least = ends.select(F.col("least").alias("__least")).distinct()
    texts = docs.select("doc_id", "text").join(least, F.col("doc_id").cast("long") == F.col("__least"), "left_semi")
    sets = texts.select("text").mapInArrow(sets_of, "name binary, set binary").dropDuplicates(["name"])
    sets = written(ends.select("name", "fp").join(sets, "name"), "sets")

    def links(t: pa.Table):
        held = [np.frombuffer(x, "<u4") for x in t.column("set").to_pylist()]
        names = t.column("name").combine_chunks()
        for a, b in exact_links(t.column("deal").to_numpy(), t.column("fp").to_numpy().view(np.uint64), held, similarity):
            if len(a):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["a", "b"])

    return _by_deal(near_rows.join(sets, "name"), links, "a binary, b binary")


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowded: int = CROWDED) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable by links of at least ``similarity``.

    Linked are texts with equal words, and texts whose sets of word shingles have that
    Jaccard similarity.  Null, empty and blank texts have no words and are equal to
    each other only.  Texts of fewer words than a shingle are one shingle.  Repeated
    rows come out as often as they came in.  A null doc_id keeps its row, links with
    nothing and has no component_id.  An empty table gives no rows.  Very long texts
    are read whole, their hashes in pieces.  Columns beyond doc_id and text are left
    out, whatever their names.

    Keys miss a pair at exactly 0.8 with a probability of 0.002, one in a crowded deal
    with up to 0.006; the exact check lets no pair below ``similarity`` through.
    """
    marked = written(_sketches(docs.where("doc_id is not null"), shingle), "sketches")
    classes = marked.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = written(classes, "classes")
    links = similar_links(docs, classes, shingle, similarity, crowded)
    parts = connected_components(links, "a", "b")
    joined = classes.select("name", "least").join(parts, F.col("name") == F.col("node"), "left")
    joined = joined.select("name", "least", F.coalesce("component", "name").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(least, "component").select(F.col("name").alias("__name"), "component_id")
    found = marked.select("doc_id", "name").join(known, F.col("name") == F.col("__name")).select("doc_id", "component_id")
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(nameless)
