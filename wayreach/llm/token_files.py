"""Token ids in patched frame-of-reference blocks.

A shard holds whole documents in ascending doc_id.  Its ids are cut into blocks of
``BLOCK`` values; a block stores its minimum, the differences packed at the width
that a percentile of them fits, and the rest as exceptions.  A shard begins with an
index of its documents and of its blocks' starts, so a reader can go to any block.

Spark writes the files: a file holds the images of some shards, each with a line
feed after it, and nothing else.  The writer's commit protocol makes a retried or
lost task harmless, and any store that Spark knows will do.  A shard's head has its
place among all, so files can be read in any order.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, kept_by_worker, new_path, task_count, written

MAGIC = b"WPFR"
BLOCK = 1024
PERCENTILE = 90
#: A shard is closed at so many ids; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
#: Shards of a file.
FILE_SHARDS = 64
#: mark, length of the image, part and place in it, documents, ids, block size, blocks
_HEAD = "<4sQIIIQII"
#: min, width, number of exceptions, of each block
_BLOCK = np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2")])


def pack_shard(ids: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, lengths: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """The binary image of a shard: head, document index, block heads, block starts, blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    if n:
        grid.ravel()[:n] = ids
        grid.ravel()[n:] = ids[-1]
    low = grid.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    common = np.partition(rest, at, axis=1)[:, at] if n else low
    width = np.maximum(1, np.ceil(np.log2(common.astype(np.float64) + 1))).astype(np.uint8)
    odd = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    heads = np.zeros(blocks, _BLOCK)
    heads["low"], heads["width"], heads["odd"] = low, width, odd.sum(axis=1)
    size = width.astype(np.int64) * (BLOCK // 8) + heads["odd"].astype(np.int64) * 6
    starts = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for some in np.array_split(own, max(1, len(own) // 64)):
            bits = (rest[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
            packed = np.packbits(bits.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
            body[starts[some].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    for b in np.flatnonzero(heads["odd"]):
        where = np.flatnonzero(odd[b])
        patch = where.astype("<u2").tobytes() + rest[b, where].astype("<u4").tobytes()
        begin = int(starts[b]) + int(width[b]) * (BLOCK // 8)
        body[begin : begin + len(patch)] = np.frombuffer(patch, np.uint8)
    index = doc_ids.astype("<i8").tobytes() + null_ids.astype("u1").tobytes() + lengths.astype("<u8").tobytes()
    rest = b"".join([index, heads.tobytes(), starts.tobytes(), body.tobytes()])
    return struct.pack(_HEAD, MAGIC, struct.calcsize(_HEAD) + len(rest), part, seq, len(doc_ids), n, BLOCK, blocks) + rest


class Shard:
    """Reads a shard's image: the documents' index at once, ids on demand."""

    def __init__(self, image: bytes):
        magic, self.size, self.part, self.seq, docs, self.n, self.block, blocks = struct.unpack_from(_HEAD, image)
        if magic != MAGIC or self.size > len(image):
            raise ValueError("not a token shard")
        at = struct.calcsize(_HEAD)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null_ids, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.heads, self.starts = take(_BLOCK, blocks), take("<u8", blocks + 1)
        self.body = np.frombuffer(image, np.uint8, self.size - at, at)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``begin`` to ``end``; only the blocks that hold them are unpacked."""
        end = self.n if end is None else end
        first, last = begin // self.block, -(-end // self.block)
        out = np.zeros((max(0, last - first), self.block), np.uint32)
        width = self.heads["width"][first:last]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            for part in np.array_split(own, max(1, len(own) // 64)):
                at = self.starts[first + part].astype(np.int64)[:, None] + np.arange(int(w) * self.block // 8)
                bits = np.unpackbits(self.body[at], axis=1, bitorder="little").reshape(len(part), self.block, int(w))
                out[part] = bits @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
        for b in np.flatnonzero(self.heads["odd"][first:last]):
            odd, at = int(self.heads["odd"][first + b]), int(self.starts[first + b]) + int(width[b]) * self.block // 8
            where = self.body[at : at + 2 * odd].copy().view("<u2")
            out[b, where] = self.body[at + 2 * odd : at + 6 * odd].copy().view("<u4")
        out += self.heads["low"][first:last, None]
        return out.ravel()[begin - first * self.block : end - first * self.block]


def shards_of(content: bytes):
    """The shards of a file's bytes, in its order."""
    view, at = memoryview(content), 0
    while at < len(view):
        shard = Shard(view[at:])
        yield shard
        at += shard.size + 1  # the line feed


class WordEncoder(dict):
    """Ids as the tokenizers library gives them; what stands between white space is encoded once and remembered.

    Where the file's normalisation and splitting are of the known form, which never
    joins across white space, texts of Latin characters are split here and the
    library's model is asked for new words only.  Any other text, or file, goes to
    the library whole.
    """

    # The steps that are known, as a file states them.
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    CUTS = [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]
    MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False}
    REMEMBER = 600_000

    def __init__(self, config: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(config)
        spec = json.loads(config)
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers")
        normal = (spec.get("normalizer") or {}).get("normalizers")
        self.known = normal == self.NORMAL and cuts == self.CUTS and {k: spec["model"].get(k) for k in self.MODEL} == self.MODEL
        if self.known:
            self.words = regex.compile(cuts[0]["pattern"]["Regex"])
            marks = [x["content"] for x in spec.get("added_tokens", [])]
            # What the library treats in a way of its own: added tokens, and all but Latin characters.
            self.other = regex.compile("|".join([r"[^\t-\r\x20-\x7e\xa1-ɏ]", *map(regex.escape, marks)]))
            self.bytes = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isalpha() else self.words.findall(chunk)
        if len(words) > 1:  # a word with a mark is the word and the mark
            self[chunk] = out = b"".join(map(self.__getitem__, words))
            return out
        ids = []
        for w in words:
            letters = w if w.isascii() else "".join(map(self.bytes.__getitem__, w.encode("utf-8")))
            ids += [t.id for t in self.tokenizer.model.tokenize(letters)]
        self[chunk] = out = array("I", ids).tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not self.known or self.other.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if len(self) > self.REMEMBER:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), np.uint32)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Encodes every text (null as empty), appends ``end_id``, writes shards in ascending doc_id to files at ``path``.

    Null doc_ids come first; repeated ids follow each other by text.
    """
    spark = docs.sparkSession
    config = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(task_count(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        text = config.value
        encoder = kept_by_worker(f"encoder {zlib.crc32(text.encode())}", lambda: WordEncoder(text))
        held, names, size = [], [], 0

        def close():
            lengths = np.array([len(x) for x in held], np.uint64)
            known = np.array([n or 0 for n in names], np.int64)
            nulls = np.array([n is None for n in names])
            image = pack_shard(np.concatenate(held), known, nulls, lengths, part, seq)
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], ["image"])

        end = np.array([end_id], np.uint32)
        for b in batches:
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.concatenate([encoder.encode(text), end])
                if held and size + len(ids) > SHARD_IDS:
                    yield close()
                    held, names, size, seq = [], [], 0, seq + 1
                held.append(ids)
                names.append(name)
                size += len(ids)
        if held:
            yield close()

    # A cast of bytes to a string keeps them as they are, and so does the writer of lines.
    images = rows.mapInArrow(run, "image binary").select(F.col("image").cast("string"))
    images.write.option("compression", "none").option("maxRecordsPerFile", FILE_SHARDS).text(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"]

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                for shard in shards_of(content.as_buffer()):
                    ids = shard.ids().astype("<u4")
                    ends = np.cumsum(shard.lengths.astype(np.int64))
                    begins = ends - shard.lengths.astype(np.int64)
                    crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(begins.tolist(), ends.tolist())]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.part] * n, pa.int32()), pa.array([shard.seq] * n, pa.int32()),
                            pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids.astype(bool)), pa.array(begins), pa.array(ends - begins),
                            pa.array(crcs, pa.int64()),
                        ],
                        names,
                    )

    # The documents' rows are few bytes each: written once, they tell where parts and shards begin.
    read = written(files.mapInArrow(run, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long"), "tokens-read")
    shards = read.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("all"))  # one row a written partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("own") + F.col("base")).alias("shard_start"))
    return read.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the token files to the shared folder and reports the documents from them.

    Null texts are empty and have the end id alone.  Repeated rows come out as often
    as they came in.  An empty table gives no rows.  A text longer than a shard has
    a shard of its own.  Columns beyond doc_id and text are left out, whatever their
    names.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id)
    return read_tokens(docs.sparkSession, path)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Token files of all documents, as read back from them."""
    import public_tokenizers

    return token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
