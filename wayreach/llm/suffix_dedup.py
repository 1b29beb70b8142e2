"""Exact substring deduplication: bytes covered by long strings that occur again.

Interval expansion on a Burrows-Wheeler transform finds the repeated strings; the
steps around it bring together the places that can hold the same string.

1. Equal texts collapse to one with a count.
2. Every window of ``length`` bytes has an anchor: the ``GRAM``-byte string in it with
   the least hash, leftmost among equals.  Equal windows have equal anchors at equal
   offsets.  Windows with the same anchor follow each other in runs.
3. Anchors are counted over the different texts.  Runs whose anchor is found once
   can't be repeated; the others are candidates.
4. A candidate run becomes a context, its windows' bytes, and goes to its anchor's
   group.  Contexts that are equal collapse to one with a count; those of an anchor
   that very many places have do so before they are dealt out, by an aggregate that
   combines in each task, and what the index finds of them goes back by a join.
5. The groups' contexts are indexed, a few megabytes at a time:
   :class:`BoundedIntervals` derives the common prefixes of neighbouring
   suffixes by breadth-first backward extension, by increasing value, and stops at
   ``length``.  Neighbours that are undecided then share at least ``length`` bytes,
   and windows of a class that stands for more than one place are repeated.
6. A group of very many different contexts is dealt out anew.  A context is cut into
   stretches of a few windows by their distance from the anchor; the bytes that all
   windows of a stretch share name its new group, so only contexts that are equal up
   to a few bytes meet again.  Where these are still too many, stretches are single
   windows, and equal ones are counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, documents, mix64, task_count, written, written_at

GRAM = 64
#: Bytes that one hashing step works on (positions fit ``PLACE`` bits).
PIECE = 1 << 19
PLACE = np.uint64(20)
#: Texts in a block that anchors are counted by, and its bytes of anchors.
BLOCK_TEXTS, BLOCK_BYTES = 8192, 4 << 20
#: Bytes of contexts that one index holds; a group is not divided unless salted.
INDEX_BYTES = 1 << 21
#: Occurrences of an anchor beyond which equal contexts are counted first, and different contexts beyond which a group is dealt out anew.
CROWD, SPLIT_CONTEXTS = 1_000, 1_000
#: Windows of a stretch, step by step; the last is one.
STRETCHES = (12, 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` bytes, by doubling: h(2m) = h(m) * A + h(m) shifted by m."""
    h = data.astype(np.uint64) + np.uint64(0x9E37)
    h *= np.uint64(0x9E3779B97F4A7C15)
    m = 1
    while m < GRAM:
        # Odd, and another for each doubling.
        h = h[:-m] * np.uint64(0xD1B54A32D192ED03 ^ (m * 0x5851F42D4C957F00 & 0xFFFFFFFFFFFFFFFF)) + h[m:]
        h ^= h >> np.uint64(29)
        m *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    grid = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, anchor position, anchor hash) of each run of windows, over one stretch of bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _grams(data)
    place = (np.uint64(1) << PLACE) - np.uint64(1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    least = _window_least(key, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    anchor = (least[first] & place).astype(np.int64)
    return first, anchor, mix64(h[anchor])


def text_runs(data: np.ndarray, length: int):
    """:func:`anchor_runs` of a whole text, in pieces that overlap by a window less a byte."""
    parts, at = [], 0
    while True:
        first, anchor, h = anchor_runs(data[at : at + PIECE + length - 1], length)
        parts.append((first + at, anchor + at, h))
        at += PIECE
        if at > len(data) - length:
            break
    first, anchor, h = (np.concatenate(x) for x in zip(*parts))
    # A run that goes on in the next piece is one run.
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
    return first[new], anchor[new], h[new]


def _text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8"), np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """key (md5 of the text), doc_id, n_bytes, n_runs, runs (hashes, first windows, anchors)."""

    def run(batches):
        for b in batches:
            out = []
            texts = b.column("text").to_pylist()
            for i, t in zip(b.column("doc_id").to_pylist(), texts):
                data = _text_bytes(t)
                first, anchor, h = text_runs(data, length)
                runs = h.tobytes() + _pack(np.diff(first, prepend=0).astype("<u4"), (anchor - first).astype("<u2")) if len(h) else b""
                out.append((hashlib.md5(data.tobytes()).digest(), i, len(data), len(h), runs))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["key", "doc_id", "n_bytes", "n_runs", "runs"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, doc_id long, n_bytes long, n_runs long, runs binary")


def _open_runs(runs: bytes, n: int):
    h = np.frombuffer(runs, np.uint64, n)
    rest = _unpack(runs[8 * n :])
    first = np.cumsum(np.frombuffer(rest, "<u4", n).astype(np.int64))
    return first, first + np.frombuffer(rest, "<u2", n, 4 * n).astype(np.int64), h


_ALL = (1 << 64) - 1
_BLOCK_SCHEMA = "block long, bucket int, n long, payload binary"


def _rows(rows, names=("block", "bucket", "n", "payload"), kinds=(pa.int64(), pa.int32(), pa.int64(), pa.binary())):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], list(names))


def anchor_blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of texts (bucket -1) and, by hash bucket, each block's different anchors with their number (2 for more)."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close():
            h = np.concatenate([np.frombuffer(x[4], np.uint64, x[3]) for x in held])
            known, count = np.unique(h, return_counts=True)
            bucket = (known % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out = [(block, -1, len(held), _table_bytes(held, kinds))]
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                out.append((block, int(bucket[part[0]]), len(part), known[part].tobytes() + np.minimum(count[part], 1 << 30).astype("<u4").tobytes()))
            return _rows(out)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "n_bytes", "n_runs", "runs"))):
                held.append(row)
                size += len(row[4])
                if len(held) >= BLOCK_TEXTS or size >= BLOCK_BYTES:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    return texts.select("key", "doc_id", "n_bytes", "n_runs", "runs").mapInArrow(run, _BLOCK_SCHEMA)


def _table_bytes(rows: list, kinds) -> bytes:
    sink = pa.BufferOutputStream()
    t = pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [str(i) for i in range(len(kinds))])
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def count_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block's anchors of a bucket, in their order: 0 found once, 1 again, 2 in a crowd."""

    def run(batches):
        held, now = [], None

        def close():
            h = np.concatenate([np.frombuffer(p, np.uint64, n) for _, _, n, p in held])
            c = np.concatenate([np.frombuffer(p, "<u4", n, 8 * n) for _, _, n, p in held]).astype(np.int64)
            known, where = np.unique(h, return_inverse=True)
            total = np.bincount(where, c, len(known))
            grade = ((total > 1).astype(np.uint8) + (total > CROWD))[where]
            ends = np.cumsum([n for _, _, n, _ in held])
            return _rows([(blk, bkt, n, _pack(g)) for (blk, bkt, n, _), g in zip(held, np.split(grade, ends[:-1]))])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "n", "payload"))):
                if row[1] != now and held:
                    yield close()
                    held = []
                now = row[1]
                held.append(row)
        if held:
            yield close()

    return blocks.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _BLOCK_SCHEMA)


def candidate_runs(blocks: DataFrame, grades: DataFrame, buckets: int, length: int) -> DataFrame:
    """key, doc_id, n, runs (hash, first window, windows, anchor from the first window, crowded) of the texts that have candidates."""
    meet = blocks.select("block", "bucket", "n", "payload", F.lit(0).alias("kind")).unionByName(grades.withColumn("kind", F.lit(1)))
    meet = meet.repartition(buckets, "block").sortWithinPartitions("block", "bucket", "kind")

    def settle(texts, known, grade):
        order = np.argsort(known)
        known, grade = known[order], grade[order]
        out = []
        for key, doc_id, n_bytes, n, runs in texts:
            if not n:
                continue
            first, anchor, h = _open_runs(runs, n)
            g = grade[np.searchsorted(known, h)]
            end = np.append(first[1:], n_bytes - length + 1)
            lone = g == 0
            lo, hi, keep = first, end, ~lone
            if keep.any():
                m = int(keep.sum())
                out.append((key, doc_id, m, _pack(h[keep], lo[keep].astype("<u8"), (hi - lo)[keep].astype("<u4"), (anchor - lo)[keep].astype("<u2"), (g[keep] > 1).astype("u1"))))
        return out

    def run(batches):
        texts, words, known, grade, now = [], {}, [], [], None

        def close():
            if known:
                out = settle(texts, np.concatenate(known), np.concatenate(grade))
                if out:
                    return [_rows(out, ("key", "doc_id", "n", "runs"), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))]
            return []

        for b in batches:
            for block, bucket, n, payload, kind in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "n", "payload", "kind"))):
                if block != now:
                    yield from close()
                    texts, words, known, grade, now = [], {}, [], [], block
                if bucket < 0:
                    texts = list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(payload).read_all().columns)))
                elif kind == 0:
                    words[bucket] = np.frombuffer(payload, np.uint64, n)
                else:
                    known.append(words.pop(bucket))
                    grade.append(np.frombuffer(_unpack(payload), np.uint8))
        yield from close()

    return meet.mapInArrow(run, "key binary, doc_id long, n long, runs binary")


_CONTEXT_SCHEMA = "grp long, crowd boolean, name binary, context binary, off int, key binary, n long, starts binary"


def contexts(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """grp, crowd, name (128-bit hash), context, off (its anchor), key, n, starts: each text's different contexts and where its runs begin."""
    own = runs.select("key", F.col("doc_id").alias("__id"), F.col("n").alias("m"), "runs")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("__key"))
    rows = rows.join(own, (F.col("__key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("key", "text", "m", "runs")
    names = ("grp", "crowd", "name", "context", "off", "key", "n", "starts")
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary())

    def run(batches):
        import xxhash

        for b in batches:
            out, size = [], 0
            for key, text, m, packed in zip(*(b.column(c).to_pylist() for c in ("key", "text", "m", "runs"))):
                data, raw = (text or "").encode("utf-8"), _unpack(packed)
                grp, lo = np.frombuffer(raw, np.int64, m).tolist(), np.frombuffer(raw, "<u8", m, 8 * m).tolist()
                n, off, crowd = np.frombuffer(raw, "<u4", m, 16 * m).tolist(), np.frombuffer(raw, "<u2", m, 20 * m).tolist(), raw[22 * m :]
                places: dict = {}
                for g, s, k, o, c in zip(grp, lo, n, off, crowd):
                    # Equal contexts of an anchor have it at equal offsets.
                    places.setdefault((g, c, data[s : s + k + length - 1], o), []).append(s)
                for (g, c, context, o), starts in places.items():
                    name = xxhash.xxh3_128_digest(context, g & _ALL) if c else None
                    out.append((g, bool(c), name, context, o, key, len(starts), np.array(starts, "<u8").tobytes()))
                    size += len(context)
                if size > 16 << 20:
                    yield _rows(out, names, kinds)
                    out, size = [], 0
            if out:
                yield _rows(out, names, kinds)

    return rows.mapInArrow(run, _CONTEXT_SCHEMA)


class BoundedIntervals:
    """Which neighbouring suffixes of ``symbols`` share at least ``length`` symbols.

    ``order`` sorts the suffixes by their first ``length`` or more symbols; the
    transform is the symbol before each.  Breadth-first, every interval of suffixes
    that begin with a string w of the level's length is extended backwards by each
    symbol c before it, to the interval of cw.  Where the border after that
    interval is undecided, the common prefix there has the level's value.  Borders
    still undecided at level ``length`` have common prefixes of at least that.
    """

    START = 7

    def __init__(self, symbols: np.ndarray, length: int):
        n = len(symbols)
        self.order, start = self._sorted(symbols, length)
        bwt = symbols[self.order - 1]
        by_symbol = np.argsort(bwt, kind="stable")
        self.back = np.empty(n, np.int64)  # where the suffix one longer stands
        self.back[by_symbol] = np.arange(n)
        turn = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.run_start, self.run_end = turn, np.append(turn[1:], n) - 1
        self.run_symbol = bwt[turn].astype(np.int64)
        self.run_of = np.cumsum(np.concatenate([[False], bwt[1:] != bwt[:-1]]))
        self.border = np.zeros(n + 1, bool)  # border[i]: suffixes i-1 and i share less
        self.border[start] = True
        self.border[n] = True
        first = np.flatnonzero(start)
        left, right = first, np.append(first[1:], n) - 1
        for _ in range(self.START, length):
            left, right = self._extend(left, right)
            fresh = ~self.border[right + 1]
            left, right = left[fresh], right[fresh]
            self.border[right + 1] = True
            if not len(left):
                break

    def _extend(self, left, right):
        a, b = self.run_of[left], self.run_of[right]
        n = b - a + 1
        total = int(n.sum())
        own = np.repeat(np.arange(len(left)), n)
        run = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + a[own]
        lo, hi = np.maximum(self.run_start[run], left[own]), np.minimum(self.run_end[run], right[own])
        key = own * 512 + self.run_symbol[run]
        sort = np.argsort(key, kind="stable") if (np.diff(key) < 0).any() else np.arange(total)
        key = key[sort]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(first[1:], total) - 1
        return self.back[lo[sort[first]]], self.back[hi[sort[last]]]

    @staticmethod
    def _sorted(symbols: np.ndarray, length: int):
        """(order of the suffixes by at least ``length`` symbols round the end, where the first START symbols change)."""
        n = len(symbols)
        key = np.zeros(n, np.uint64)
        for i in range(BoundedIntervals.START):
            key = (key << np.uint64(9)) | np.roll(symbols, -i).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.concatenate([[True], k[1:] != k[:-1], [False]])
        rank = np.empty(n, np.int64)
        change = start[:n].copy()
        rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        depth = BoundedIntervals.START
        while depth < length:
            end = np.append(change[1:], True)
            slots = np.flatnonzero(~(change & end))  # suffixes that don't stand alone
            if not len(slots):
                break
            own = order[slots]
            pair = rank[own] * n + rank[(own + depth) % n]
            sort = np.argsort(pair, kind="stable")
            pair, own = pair[sort], own[sort]
            order[slots] = own
            change[slots] = np.concatenate([[True], pair[1:] != pair[:-1]])
            rank[own] = np.maximum.accumulate(np.where(change[slots], slots, 0))
            depth *= 2
        return order, start


def _index(groups: list, length: int):
    """For each group's contexts: the class of each window, and the classes' weights.

    ``groups`` holds lists of (context, weight) with different contexts.  Returns a
    list of (classes by context) and the weight of each class.
    """
    flat = [c for g in groups for c, _ in g]
    weight = np.array([w for g in groups for _, w in g], np.int64)
    size = np.array([len(c) for c in flat], np.int64)
    # A mark of its own symbol before each context keeps strings from crossing.
    text = np.zeros(int(size.sum()) + len(flat), np.uint16)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 1
    windows = size - length + 1
    body = np.frombuffer(b"".join(flat), np.uint8).astype(np.uint16) + np.uint16(1)
    inside = np.ones(len(text), bool)
    inside[begin - 1] = False
    text[inside] = body
    found = BoundedIntervals(text, length)
    cls = np.empty(len(text), np.int64)
    cls[found.order] = np.cumsum(found.border[:-1]) - 1
    own = np.repeat(np.arange(len(flat)), windows)
    at = begin[own] + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    of = cls[at]
    total = np.bincount(of, weight[own], int(cls.max()) + 1)
    return np.split(of, np.cumsum(windows)[:-1]), total


def repeated_windows(rows: DataFrame, length: int, partitions: int) -> DataFrame:
    """key, crowd, lo, hi: runs of windows that are repeated.

    ``rows``: grp, context, key, crowd, n, starts; a context counts ``n`` times
    and lies at ``starts`` of what ``key`` and ``crowd`` name.
    """
    dealt = rows.repartition(partitions, "grp").sortWithinPartitions("grp")
    names, kinds = ("key", "crowd", "lo", "hi"), (pa.binary(), pa.bool_(), pa.int64(), pa.int64())

    def settle(held: list):
        """held: {context: [(key, crowd, n, starts)]} of whole groups."""
        out = []
        several = [group for group in held if sum(p[2] for places in group.values() for p in places) > 1]
        if several:
            classes, total = _index([[(c, sum(p[2] for p in places)) for c, places in g.items()] for g in several], length)
            for places, cls in zip((places for g in several for places in g.values()), classes):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], total[cls] > 1, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for key, crowd, _, starts in places:
                        out += [(key, crowd, s + a, s + b) for s in np.frombuffer(starts, "<u8").tolist()]
        for lo in range(0, len(out), 50_000):
            yield _rows(out[lo : lo + 50_000], names, kinds)

    def run(batches):
        held, size, now, group = [], 0, None, {}
        for b in batches:
            for grp, context, *place in zip(*(b.column(c).to_pylist() for c in ("grp", "context", "key", "crowd", "n", "starts"))):
                if grp != now:
                    if group:
                        held.append(group)
                        if size >= INDEX_BYTES:
                            yield from settle(held)
                            held, size = [], 0
                    now, group = grp, {}
                if context not in group:
                    group[context] = []
                    size += len(context)
                group[context].append(place)
        if group:
            held.append(group)
        if held:
            yield from settle(held)

    return dealt.mapInArrow(run, "key binary, crowd boolean, lo long, hi long")


def stretches(rows: DataFrame, width: int, length: int) -> DataFrame:
    """grp, name, context, off, n, parent, at: contexts cut into stretches of ``width`` windows by distance from the anchor."""
    names = ("grp", "name", "context", "off", "n", "parent", "at")
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64())

    def run(batches):
        import xxhash

        for b in batches:
            out = []
            for grp, context, off, n, parent in zip(*(b.column(c).to_pylist() for c in ("grp", "context", "off", "n", "name"))):
                last = len(context) - length  # windows 0 to last begin off, off - 1, ... before the anchor
                for j in range((off - last) // width, off // width + 1):
                    first, end = max(0, off - j * width - width + 1), min(last, off - j * width)
                    part = context[first : end + length]
                    # All windows of the stretch hold these bytes.
                    core = context[off - j * width : off - j * width - width + 1 + length]
                    own = xxhash.xxh3_64_intdigest(core, (grp + j) & _ALL)
                    own -= (own >> 63) << 64
                    out.append((own, xxhash.xxh3_128_digest(part, own & _ALL), part, off - first, n, parent, first))
                    if len(out) >= 50_000:
                        yield _rows(out, names, kinds)
                        out = []
            if out:
                yield _rows(out, names, kinds)

    return rows.mapInArrow(run, "grp long, name binary, context binary, off int, n long, parent binary, at long")


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [lo, hi) in order, those that meet as one."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]]))
    return lo[first], top[np.append(first[1:], len(lo)) - 1]


_SPANS = "array<struct<lo: long, hi: long>>"


def _moved(rows: DataFrame) -> DataFrame:
    """key, spans: ``found`` of each row of key, starts, found at all its starts; a row a row."""

    def spans(held: list):
        lo, hi = (np.concatenate(x) for x in list(zip(*held))[1:])
        ends = np.cumsum([0, *(len(x[1]) for x in held)])
        pairs = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["key", "spans"])

    def run(batches):
        for b in batches:
            held, size = [], 0
            for key, starts, found in zip(*(b.column(c).to_pylist() for c in ("key", "starts", "found"))):
                at = np.frombuffer(starts, "<u8").astype(np.int64)[:, None]
                lo, hi = _merged(*(np.array([x[c] for x in found], np.int64) for c in ("lo", "hi")))
                held.append((key, *_merged((at + lo).ravel(), (at + hi).ravel())))
                size += len(held[-1][1])
                if size >= 1 << 20:
                    yield spans(held)
                    held, size = [], 0
            if held:
                yield spans(held)

    return rows.select("key", "starts", "found").mapInArrow(run, f"key binary, spans {_SPANS}")


def judged(crowded: DataFrame, length: int, buckets: int, plain: DataFrame | None = None, widths: tuple = STRETCHES) -> tuple[DataFrame, DataFrame | None]:
    """(what the index says of ``plain`` and of small groups, name, lo, hi of all repeated windows of ``crowded``; None without rows)."""
    columns = ["grp", "context", "key", "crowd", "n", "starts"]
    some = not crowded.isEmpty()
    rows = [plain.select(*columns)] if plain is not None else []
    if some:
        # One row a different context: the count combines before the shuffle, however many places share it.
        different = written(crowded.groupBy("grp", "name", "context", "off").agg(F.sum("n").alias("n")), "different")
        sizes = different.groupBy(F.col("grp").alias("__g")).count().where(F.col("count") > SPLIT_CONTEXTS).select("__g")
        different = different.join(sizes, F.col("grp") == F.col("__g"), "left").withColumn("__large", F.col("__g").isNotNull())
        small = different.where("not __large").withColumn("starts", F.unhex(F.lit("00" * 8)))
        rows.append(small.select("grp", "context", F.col("name").alias("key"), F.lit(True).alias("crowd"), "n", "starts"))
    rows = rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]
    ruled = written(repeated_windows(rows, length, buckets), "repeats")
    if not some:
        return ruled, None
    verdicts = ruled.where("crowd").select(F.col("key").alias("name"), "lo", "hi")
    large = different.where("__large").select("grp", "name", "context", "off", "n")
    if not large.isEmpty():
        parts = written(stretches(large, widths[0], length), "stretches")
        if widths[0] == 1:
            below = parts.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
            below = below.select("name", F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"))
        else:
            below = judged(parts.select("grp", "name", "context", "off", "n"), length, buckets, None, widths[1:])[1]
        below = written(below, "below").withColumnRenamed("name", "__name")
        back = parts.join(below, F.col("name") == F.col("__name"))
        verdicts = verdicts.unionByName(back.select(F.col("parent").alias("name"), (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi")))
    return ruled, verdicts


def removed_windows(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(texts: key, copies; windows: key, spans of lo, hi), the second for strings shared by different texts or places of a text.

    Tables that later steps no longer read are removed at once.
    """
    spark = docs.sparkSession
    buckets = task_count(docs)
    found, found_path = written_at(find_anchors(docs, length), "anchors")
    copies = written(found.groupBy("key").agg(F.count("*").alias("copies")), "copies")
    texts = found.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("n_runs").alias("n_runs"), F.first("runs").alias("runs")
    )
    blocks, blocks_path = written_at(anchor_blocks(texts, buckets), "blocks")
    delete(spark, found_path)
    made = written(contexts(docs, candidate_runs(blocks, count_anchors(blocks, buckets), buckets, length), length), "contexts")
    delete(spark, blocks_path)
    plain, crowded = made.where("not crowd"), made.where("crowd")
    ruled, verdicts = judged(crowded.select("grp", "name", "context", "off", "n"), length, buckets, plain)
    windows = ruled.where("not crowd").select("key", F.array(F.struct("lo", "hi")).alias("spans"))
    if verdicts is not None:
        # Two tables meet by name, so that the places of a context that very many share can be split.
        # A context has all its verdicts in one row, so that its places stay one row each.
        verdicts = written(verdicts.groupBy(F.col("name").alias("__name")).agg(F.collect_list(F.struct("lo", "hi")).alias("found")), "verdicts")
        windows = windows.unionByName(_moved(crowded.select("name", "key", "starts").join(verdicts, F.col("name") == F.col("__name"))))
    return copies, windows


def suffix_dedup(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept and spans, a row a document.

    Every byte goes that a string of ``length`` bytes covers which starts anywhere
    else too, in the same text or another; strings are judged on the input.  Null
    texts are empty.  Texts shorter than ``length`` stay.  Repeated rows are copies
    of each other.  A null doc_id keeps its row.  An empty table gives no rows.
    Texts of any length are judged whole, hashed in pieces that overlap.  Columns
    beyond doc_id and text are left out, whatever their names.  ``kept`` is binary,
    since a cut can fall inside a character.
    """
    copies, windows = removed_windows(docs, length)
    spans = windows.groupBy("key").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))
    known = copies.join(spans, "key", "left").where("copies > 1 or spans is not null")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("__key"))
    rows = rows.join(known, F.col("__key") == F.col("key"), "left").select(
        "doc_id", "text", "copies", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi")
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<long>" * with_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.int64())] * with_text

    def run(batches):
        for b in batches:
            out = []
            for i, text, n, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "copies", "lo", "hi"))):
                data = (text or "").encode("utf-8")
                cuts = []
                if (n or 1) > 1 and len(data) >= length:
                    cuts = [[0, len(data)]]
                elif lo:
                    for s, e in zip(lo, hi):
                        if cuts and s <= cuts[-1][1]:
                            cuts[-1][1] = max(cuts[-1][1], e - 1 + length)
                        else:
                            cuts.append([s, e - 1 + length])
                at, kept = 0, []
                for s, e in cuts:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                row = (i, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest())
                out.append(row + ((kept, [x for c in cuts for x in c]) if with_text else ()))
            if out:
                yield _rows(out, names, kinds)

    return rows.mapInArrow(run, schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents removed."""
    return suffix_dedup(documents(spark, sf_dir))
