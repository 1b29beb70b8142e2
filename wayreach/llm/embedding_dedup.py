"""Embedding near-duplicates by product quantisation.

Vectors of a label that are equal collapse to one class first.  Coarse centroids and
residual codebooks are fitted on a bounded sample (``FIT_ROWS``); every class is
indexed: it goes to the inverted list of its nearest centroid with a code of its
residual.  Every class also searches: it goes to its own list and to each list whose
dividing plane is at most its reach from it.  A pair at distance r that a plane
divides is missed only if both lie farther than their reach from it, so r / 2 misses
none, whatever the vectors.  Where all of r points along the plane's normal is rare,
less will do: the sample's nearest neighbours, label by label and list by list, show
what part of a displacement falls along the normals of the planes around, and r / 2
times a high quantile of that part is probed (``TAIL``; all of r / 2 for labels that
the sample holds too few of).  Low-rank vectors thus get a wide reach by themselves.
In a list, table look-ups give asymmetric distances to the
stored codes; a code passes if its distance less its own quantisation error is
within r, so this step loses nothing, and survivors are ranked by exact cosine.

Lists that hold many classes are stored in blocks, their searchers dealt out in
parts, and each block meets each part in a task of its own.
What leaves a task is link counts and a spanning forest, a row a class each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components, spanning_rows

#: Bounds of the sample that the index is fitted on and of its number of lists.
FIT_ROWS = 8_192
MAX_LISTS = 1_024
CLASSES_A_LIST = 256
SUBSPACE = 8
CODES = 64
#: Classes of a block and searchers of a part, at least and at most: a list's quarters between these.
BLOCK_CLASSES = (256, 4_096)
PART_CLASSES = (256, 16_384)
#: Numbers of an array that a step of the search works on: distances of searchers to codes, components of pairs.
HELD = 1 << 20
#: The part of sampled displacements along planes' normals that may exceed what is probed for.
TAIL = 0.005
#: Sampled classes of a label, or displacements of a list, under which no quantile is taken of it.
LEAST_SEEN = 32
#: Planes around a sampled class that its displacement is held against.
PLANES = 4


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class PqIndex:
    """Coarse centroids and, for each run of ``SUBSPACE`` dimensions, codewords of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        self.coarse = _kmeans(sample, lists, 8, seed)
        home = self.home(sample)
        residual = sample - self.coarse[home]
        self.cuts = list(range(0, sample.shape[1], SUBSPACE)) + [sample.shape[1]]
        self.books = [_kmeans(residual[:, a:b], CODES, 6, seed + a) for a, b in zip(self.cuts, self.cuts[1:])]

    @classmethod
    def of(cls, state: dict) -> "PqIndex":
        """An index from its attributes: plain arrays travel to workers that lack this package."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the coarse centroids."""
        return np.maximum((x * x).sum(axis=1)[:, None] + (self.coarse * self.coarse).sum(axis=1) - 2 * (x @ self.coarse.T), 0)

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(x), axis=1)

    def beyond(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How far each vector lies from the plane between its own and every other centroid."""
        c = self.coarse
        apart = np.sqrt(np.maximum((c[home] ** 2).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (c[home] @ c.T), 1e-18))
        out = (d - d[np.arange(len(home)), home][:, None]) / (2 * apart)
        out[np.arange(len(home)), home] = 0.0
        return out

    def along_normals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home list, part of the displacement to the nearest other vector that lies along a normal) for the nearest planes."""
        home = self.home(x)
        near, far = np.empty(len(x), np.int64), np.zeros(len(x), bool)
        for lo in range(0, len(x), 1024):
            g = x[lo : lo + 1024] @ x.T
            g[g >= 1 - 1e-12] = -2.0  # itself and vectors of its direction
            near[lo : lo + 1024], far[lo : lo + 1024] = g.argmax(axis=1), g.max(axis=1) <= -2.0
        d = x[near] - x
        d /= np.maximum(np.sqrt((d * d).sum(axis=1)), 1e-12)[:, None]
        beyond = self.beyond(self.distances(x), home)
        beyond[np.arange(len(x)), home] = np.inf
        lists, parts = [], []
        for other in np.argsort(beyond, axis=1)[:, : min(PLANES, len(self.coarse) - 1)].T:
            n = self.coarse[other] - self.coarse[home]
            n /= np.maximum(np.sqrt((n * n).sum(axis=1)), 1e-12)[:, None]
            lists.append(home[~far])
            parts.append(np.abs((d * n).sum(axis=1))[~far])
        return (np.concatenate(lists), np.concatenate(parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def learn_reach(self, x: np.ndarray, label: np.ndarray, radius: float, tail: float | None) -> None:
        """Sets how far each label and list probes; ``tail`` None probes all that can hold a link."""
        half = radius / 2 + 1e-9
        self.half, self.label_reach, self.list_reach = half, {}, np.zeros(len(self.coarse))
        if tail is None:
            return
        lists, parts = [], []
        for v in np.unique(label):
            own = np.flatnonzero(label == v)
            if len(own) >= LEAST_SEEN:
                at, part = self.along_normals(x[own])
                if len(part):
                    self.label_reach[int(v)] = min(half, half * float(np.quantile(part, 1 - tail)) + 1e-9)
                lists.append(at)
                parts.append(part)
        if parts:
            at, part = np.concatenate(lists), np.concatenate(parts)
            for lst in np.unique(at):
                seen = part[at == lst]
                if len(seen) >= LEAST_SEEN:
                    self.list_reach[lst] = min(half, half * float(np.quantile(seen, 1 - tail)) + 1e-9)

    def probed(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home list, whether each list is searched) of vectors."""
        d = self.distances(x)
        home = np.argmin(d, axis=1)
        reach = np.array([self.label_reach.get(v, self.half) for v in label.tolist()])
        return home, self.beyond(d, home) <= np.maximum(reach, self.list_reach[home])[:, None]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes and the distance between each vector and what its code stands for."""
        r = x - self.coarse[home]
        code = np.empty((len(x), len(self.books)), np.uint8)
        lost = np.zeros(len(x))
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            part = r[:, a:b]
            d = (book * book).sum(axis=1) - 2 * (part @ book.T)
            code[:, j] = np.argmin(d, axis=1)
            lost += ((part - book[code[:, j]]) ** 2).sum(axis=1)
        return code, np.sqrt(lost)

    def asymmetric(self, query: np.ndarray, lst: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of queries to stored codes of one list, by table look-up."""
        r = query - self.coarse[lst]
        total = np.zeros((len(query), len(code)), np.float32)
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            part = r[:, a:b]
            table = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * (part @ book.T)
            total += table.astype(np.float32)[:, code[:, j]]
        return total


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1 in double precision, whether each row has one)."""
    dims = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(dims.max()) if len(dims) else 0
    flat = column.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    out = np.zeros((len(dims), width))
    start = np.concatenate([[0], np.cumsum(dims)[:-1]]).astype(np.int64)
    own = np.repeat(np.arange(len(dims)), dims)
    out[own, np.arange(len(values)) - np.repeat(start, dims)] = values
    bad = ~np.isfinite(out).all(axis=1)
    out[bad] = 0
    top = np.abs(out).max(axis=1, initial=0)
    good = (top > 0) & (dims > 0)
    out = out / np.where(good, top, 1)[:, None]
    return out / np.where(good, np.sqrt((out * out).sum(axis=1)), 1)[:, None], good


def _usable():
    """Label and vector without nulls, all components finite, not all zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles, no negative zero) of the rows that can link."""
    return vectors.where(_usable()).select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double") + 0.0).alias("embedding"))


def embedding_links(vectors: DataFrame, least_cosine: float = 0.93, tail: float | None = TAIL) -> tuple[DataFrame, DataFrame]:
    """(classes, marks).  classes: class, label, embedding, copies, dims.  marks: class, n_links, partner.

    A class is a label's set of equal vectors, known by its least vec_id; vectors of
    different lengths never meet.  ``tail`` None probes all that can hold a link.  ``n_links`` are partial counts of vectors of
    other classes within reach; rows with a ``partner`` join linked classes.
    """
    spark = vectors.sparkSession
    classes = usable_vectors(vectors).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("class"))
    classes = written(classes.withColumn("dims", F.size("embedding")), "classes")
    sizes = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    radius = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    marks_schema = "class long, n_links long, partner long"
    if sizes is None:
        return classes, spark.createDataFrame([], marks_schema)
    dims, n = sizes["dims"], classes.count()
    sample = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS)
    # Labels may be of any type; a hash stands for them.
    sample = sample.select("embedding", F.xxhash64("label").alias("mark")).toArrow()
    unit, _ = _units(sample.column("embedding").combine_chunks())
    lists = int(min(MAX_LISTS, max(1, n // CLASSES_A_LIST), max(1, len(unit) // 4)))
    index = PqIndex(unit, lists)
    index.learn_reach(unit, sample.column("mark").to_numpy(), radius, tail)
    shared = spark.sparkContext.broadcast(vars(index))

    def place(batches):
        pq = PqIndex.of(shared.value)
        for b in batches:
            size = b.column("dims").to_numpy(zero_copy_only=False)
            home, probed = np.full(b.num_rows, -1, np.int32), [[-1]] * b.num_rows  # lengths the index wasn't fitted on share a list of their own
            fitted = np.flatnonzero(size == pq.coarse.shape[1])
            x, _ = _units(b.column("embedding").take(pa.array(fitted)))
            mark = b.column("mark").to_numpy(zero_copy_only=False)[fitted]
            for lo in range(0, len(fitted), 2048):
                part = slice(lo, lo + 2048)
                own, some = pq.probed(x[part], mark[part])
                home[fitted[part]] = own
                for i, row in zip(fitted[part].tolist(), some):
                    probed[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(home), pa.array(probed, pa.list_(pa.int32()))], ["class", "label", "dims", "embedding", "copies", "home", "probed"]
            )

    label_type = classes.schema["label"].dataType.simpleString()
    placed = classes.select("class", "label", "dims", "embedding", "copies", F.xxhash64("label").alias("mark"))
    placed = written(placed.mapInArrow(place, f"class long, label {label_type}, dims int, embedding array<double>, copies long, home int, probed array<int>"), "placed")
    went = placed.select("label", "dims", "home", F.explode("probed").alias("list"))
    held = went.groupBy("label", "dims", "list").agg(F.count_if(F.col("home") == F.col("list")).alias("stored"), F.count("*").alias("searching"))
    quarters = lambda c, bounds: F.ceil(F.col(c) / F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.col(c) / 4))).cast("int")
    held = held.where("stored > 0").select("label", "dims", "list", quarters("stored", BLOCK_CLASSES).alias("blocks"), quarters("searching", PART_CLASSES).alias("parts"))
    dealt = placed.withColumn("list", F.explode("probed")).join(held, ["label", "dims", "list"])
    dealt = dealt.withColumns({"own": F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), "mine": F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")).cast("int")})
    # A searcher meets every block in its part; a stored class meets every part in its block.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), F.col("mine").alias("part")))
    stays = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("own").alias("block"), i.alias("part")))
    places = F.when(F.col("home") == F.col("list"), F.array_union(meets, stays)).otherwise(meets)
    dealt = dealt.select("class", "label", "dims", "list", "embedding", "copies", "home", "probed", "own", "mine", F.explode(places).alias("at"))
    dealt = dealt.select("label", "dims", "list", F.col("at.block").alias("block"), F.col("at.part").alias("part"), "class", "embedding", "copies", "home", "probed", "own", "mine")
    keys = ("label", "dims", "list", "block", "part")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "class")

    def search(t: pa.Table):
        pq = PqIndex.of(shared.value)
        lst, block, part = (t.column(k)[0].as_py() for k in keys[2:])
        x, _ = _units(t.column("embedding").combine_chunks())
        ids = t.column("class").to_numpy()
        copies, home = t.column("copies").to_numpy(), t.column("home").to_numpy()
        stored = np.flatnonzero((home == lst) & (t.column("own").to_numpy() == block))
        seeking = np.flatnonzero(t.column("mine").to_numpy() == part)
        links = np.zeros(len(ids), np.int64)
        fitted = lst >= 0
        if fitted and len(stored):
            code, lost = pq.encode(x[stored], np.full(len(stored), lst))
            # Whether a stored class itself searches each searcher's home list.
            back = np.zeros((len(stored), len(pq.coarse)), bool)
            each = t.column("probed").combine_chunks().take(pa.array(stored))
            back[np.repeat(np.arange(len(stored)), each.value_lengths().to_numpy()), each.flatten().to_numpy()] = True

        def pairs():
            step, some = max(1, HELD // max(1, len(stored))), max(1, HELD // max(1, x.shape[1]))
            for lo in range(0, len(seeking) if len(stored) else 0, step):
                q = seeking[lo : lo + step]
                if fitted:
                    near = np.sqrt(np.maximum(pq.asymmetric(x[q], lst, code), 0)) <= radius + lost + 1e-3
                    a, s = np.nonzero(near)
                else:
                    a, s = np.nonzero(x[q] @ x[stored].T >= least_cosine - 1e-6)
                a, b = q[a], stored[s]
                for at in range(0, len(a), some):
                    i, j, k = a[at : at + some], b[at : at + some], s[at : at + some]
                    sure = (i != j) & (np.einsum("ij,ij->i", x[i], x[j]) >= least_cosine)
                    i, j, k = i[sure], j[sure], k[sure]
                    np.add.at(links, i, copies[j])
                    if fitted:
                        # A pair that only one side finds counts for both.
                        lone = ~back[k, home[i]]
                        np.add.at(links, j[lone], copies[i[lone]])
                    yield i, j

        label = spanning_rows(len(ids), pairs())
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        partner = ids[label[some]]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(links[some]), pa.array(partner, mask=label[some] == some)], ["class", "n_links", "partner"]
        )

    def run(batches):
        kept, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(b.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                key = tuple(c[s] for c in cols)
                if key != now and kept:
                    yield search(pa.Table.from_batches(kept))
                    kept = []
                now = key
                kept.append(b.slice(s, e - s))
        if kept:
            yield search(pa.Table.from_batches(kept))

    return classes, written(dealt.mapInArrow(run, marks_schema), "marks")


def embedding_dedup(vectors: DataFrame, least_cosine: float = 0.93, tail: float | None = TAIL) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row a vector.  ``tail`` None finds every link.

    Vectors that are null, zero or hold null or non-finite components, and vectors
    with a null label, link with nothing and are kept.  Equal vectors of a label
    link.  Vectors of different lengths never link.  A cosine that is
    ``least_cosine`` in double precision links.  vec_id is taken as unique;
    repeated rows link with each other as different vectors would.  An empty table
    gives no rows.  Columns beyond vec_id, label and embedding are left out,
    whatever their names.
    """
    classes, marks = embedding_links(vectors, least_cosine, tail)
    counts = marks.groupBy("class").agg(F.sum("n_links").alias("outer"))
    parts = connected_components(marks.where("partner is not null").select("class", "partner"), "class", "partner")
    known = classes.join(counts, "class", "left").join(parts, classes["class"] == parts.node, "left").select(
        F.col("label").alias("__label"), F.col("embedding").alias("__e"),
        (F.coalesce("outer", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"),
    )
    linked = usable_vectors(vectors).join(known, (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__e"))).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
