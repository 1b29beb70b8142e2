"""Byte-level BPE by a global shuffle of distinct words.

1. Documents are split into pre-tokens in blocks of about ``BLOCK_CHARS``; a block
   keeps each document as positions into its own list of distinct words, and hands
   the words on in buckets by hash.
2. A bucket sees every block's words of its share of the hash range and encodes each
   distinct word once; the ids go back to the blocks in the words' order.
3. Blocks meet their words' ids, and documents are put together by position.
   Decoding looks ids up in the token-byte table, whose size is the vocabulary's.

Words travel once a block, not once an occurrence, so the commonest word is one
entry a block whatever its count.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, task_count

#: Code points of text after which a block is closed; a longer document is a block of its own.
BLOCK_CHARS = 6 << 20
#: Pre-tokens are split in pieces of so many code points, cut where the pattern cuts too.
PIECE = 1 << 18


def _squeeze(*arrays) -> bytes:
    import zstandard

    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit values, all lowest bytes first: these compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unplanes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _open(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def pre_tokens(text: str, pattern):
    """Lists of pre-tokens of ``text`` in order.

    A long text is cut before a line feed that follows a letter and precedes one:
    there the pattern ends one pre-token and begins another whatever stands around.
    """
    at = 0
    while len(text) - at > 2 * PIECE:
        cut = at + PIECE
        while True:
            cut = text.find("\n", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if text[cut - 1].isalpha() and text[cut + 1].isalpha():
                break
            cut += 1
        if cut < 0:
            break
        yield pattern.findall(text, at, cut)
        at = cut
    yield pattern.findall(text, at)


class _Numbering(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


#: block, bucket, a mark of the block's words, number of entries, entries
_FIELDS = [("block", pa.int64()), ("bucket", pa.int32()), ("mark", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]
_SCHEMA = "block long, bucket int, mark long, n long, payload binary"


def split_blocks(docs: DataFrame, pattern: str, buckets: int, words_only: bool) -> DataFrame:
    """Each block's words by bucket, or else (bucket -1) its documents as positions among these.

    Both are made from the same rows in the same order; ``mark`` tells if they weren't.
    """
    schema = pa.schema(_FIELDS)

    def run(batches):
        import regex
        import xxhash
        from pyspark import TaskContext

        compiled = regex.compile(pattern)
        block = TaskContext.get().partitionId() << 32
        words, names, places, chars = _Numbering(), [], [], 0

        def close():
            known = [w.encode("utf-8") for w in words]
            bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in known], np.int64)
            order = np.argsort(bucket, kind="stable")
            mark = xxhash.xxh3_64_intdigest(b"\xff".join([b"%d" % len(names), *known])) >> 1
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            lengths = np.array([len(p) for p in places], "<u8")
            all_places = place[np.concatenate(places)] if lengths.sum() else np.zeros(0, np.uint32)
            ids = np.array([n or 0 for n in names], "<i8")
            nulls = np.array([n is None for n in names], "u1")
            if not words_only:
                packed = [(block, -1, mark, len(names), _squeeze(ids, nulls, lengths, _planes(all_places)))]
                return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*packed), schema)], schema=schema)
            out = []
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, edges) if len(order) else []:
                own = [known[i] for i in part.tolist()]
                sizes = np.array([len(w) for w in own], np.uint32)
                out.append((block, int(bucket[part[0]]), mark, len(own), _squeeze(_planes(sizes), np.frombuffer(b"".join(own), np.uint8))))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if chars and chars + len(text) > BLOCK_CHARS:
                    yield close()
                    block, chars = block + 1, 0
                    words, names, places = _Numbering(), [], []
                get = words.__getitem__
                own = [np.fromiter(map(get, p), np.uint32, len(p)) for p in pre_tokens(text, compiled)]
                places.append(own[0] if len(own) == 1 else np.concatenate(own))
                names.append(name)
                chars += len(text)
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def encode_words(words: DataFrame, pattern: str, ranks, buckets: int) -> DataFrame:
    """The rows of ``words`` with their ids as payload; a word that many blocks hold is encoded once."""
    schema = pa.schema(_FIELDS)

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(ranks.value), special_tokens={})
        known: dict[bytes, bytes] = {}
        now = None
        for b in batches:
            out = []
            for block, bucket, mark, n, payload in zip(*(b.column(c).to_pylist() for c in schema.names)):
                if bucket != now:
                    known, now = {}, bucket
                raw = _open(payload)
                ends = np.cumsum(_unplanes(raw[: 4 * n]).astype(np.int64))
                text = raw[4 * n :].tobytes()
                own = [text[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
                for w in own:
                    if w not in known:
                        known[w] = np.array(encoding.encode_ordinary(w.decode("utf-8")), "<u4").tobytes()
                ids = [known[w] for w in own]
                counts = np.array([len(x) // 4 for x in ids], np.uint32)
                out.append((block, bucket, mark, n, _squeeze(_planes(counts), _planes(np.frombuffer(b"".join(ids), "<u4")))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _SCHEMA)


def _ranks(table: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, ids and decoded, a row a document.

    ``ids_sha256`` is of the decimal ids joined by a space, ``decoded_sha256`` of the
    bytes that the ids stand for.  Null texts are empty and have no ids.  Repeated
    rows come out as often as they came in; a null doc_id stays null.  An empty
    table gives no rows.  A text longer than a block is a block of its own, split in
    pieces.  Columns beyond doc_id and text are left out, whatever their names.
    ``docs`` is read twice in the order of its partitions, so it should come from files.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())
    buckets = task_count(docs)
    # Splitting again costs less than to write and move the positions twice.
    ids = encode_words(split_blocks(docs, pattern, buckets, True), pattern, ranks, buckets)
    met = split_blocks(docs, pattern, buckets, False).unionByName(ids).repartition(buckets, "block").sortWithinPartitions("block", "bucket")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids

    def run(batches):
        token = {i: b for b, i in _ranks(ranks.value).items()}
        table = [token.get(i, b"") for i in range(max(token) + 1)]
        decimal = [b"%d" % i for i in range(len(table))]
        now, documents_row, parts = None, None, []

        def assemble():
            n, payload, mark = documents_row
            raw = _open(payload)
            ids, raw = raw[: 8 * n].view("<i8"), raw[8 * n :]
            nulls, raw = raw[:n].astype(bool), raw[n:]
            ends = np.cumsum(raw[: 8 * n].copy().view("<u8").astype(np.int64))
            places = _unplanes(raw[8 * n :])
            shown, meant, counts, values = [], [], [], []
            for m, part, its in parts:
                if its != mark:
                    raise RuntimeError("the rows of documents changed between two reads; write them first")
                body = _open(part)
                count = _unplanes(body[: 4 * m]).astype(np.int64)
                value = _unplanes(body[4 * m :]).tolist()
                at = np.concatenate([[0], np.cumsum(count)]).tolist()
                for s, e in zip(at, at[1:]):
                    own = value[s:e]
                    shown.append(b" ".join([decimal[i] for i in own]))
                    meant.append(b"".join([table[i] for i in own]))
                    if with_ids:
                        values.append(own)
                counts.append(count)
            count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            for k, (s, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                own = places[s:e]
                at = own.tolist()
                line = b" ".join(map(shown.__getitem__, at))
                back = b"".join(map(meant.__getitem__, at))
                row = (None if nulls[k] else int(ids[k]), int(count[own].sum()), hashlib.sha256(line).hexdigest(), hashlib.sha256(back).hexdigest())
                yield row + (([i for w in at for i in values[w]], back.decode("utf-8", "replace")) if with_ids else ())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for block, bucket, mark, n, payload in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "mark", "n", "payload"))):
                if block != now:
                    if documents_row:
                        yield batch(list(assemble()))
                    now, documents_row, parts = block, None, []
                if bucket < 0:
                    documents_row = (n, payload, mark)
                else:
                    parts.append((n, payload, mark))
        if documents_row:
            yield batch(list(assemble()))

    return met.mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    import public_tokenizers

    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
