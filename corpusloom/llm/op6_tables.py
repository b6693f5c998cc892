"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier:

    block*   entries: varint shared key bytes, varint other key bytes, varint value bytes, key tail, value
             then the zlib-packed entries' CRC-32 in 4 bytes; each block is packed on its own
    index    for each block: varint key bytes, first key, varint offset, varint bytes, varint documents
    bloom    bits of the keys' hashes
    footer   offsets of index and bloom, bloom hashes, id width, documents, ids, magic

Keys are the identifiers as 8 big-endian bytes with the sign bit turned, so bytes sort as numbers
do; a null identifier is the empty key and comes first. Values are token ids of 2 or 4 bytes each,
little-endian, as the vocabulary needs. lookup() asks the Bloom filter, searches the sparse index by
halving, and unpacks one block.

Spark deals the documents by ranges of (id, text hash) and sorts each range, so neither the number
of shards nor a frequent id bounds a task; each task tokenizes and streams its own shard to the
shared folder under a temporary name and renames it, so a repeated task leaves the same file.

Rows: null and empty texts have the end id only; repeated ids keep all their rows, in order of
their text hash; other columns are ignored; no rows give no shard.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, table, text_or_empty, written

END_ID = 0
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 10, 7
_FOOTER, _MAGIC = struct.Struct("<QQIIQQ8s"), b"CLSSTAB1"
BATCH_BYTES = 8 << 20
_CACHE_LIMIT = 400_000
_UNEVEN = r" (?:[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
_SIGN = 1 << 63


# ---------------------------------------------------------------- files in the shared folder


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- format


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (int(doc_id) + _SIGN) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - _SIGN


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [((a + i * b) & (1 << 64) - 1) % bits for i in range(hashes)]


class TableWriter:
    """Writes one shard; add() must be called in ascending order of keys."""

    def __init__(self, out: BinaryIO, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.first, self.last, self.in_block = bytearray(), b"", b"", 0
        self.index, self.keys, self.docs, self.ids = bytearray(), [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        if not self.in_block:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix((self.last, key)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.in_block, self.docs, self.ids = key, self.in_block + 1, self.docs + 1, self.ids + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        packed = zlib.compress(bytes(self.block), 1)
        packed += struct.pack("<I", zlib.crc32(packed))
        self.index += _varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(packed)) + _varint(self.in_block)
        self.out.write(packed)
        self.at += len(packed)
        self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        if self.in_block:
            self._close_block()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, len(bloom) * 8, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(bytes(self.index) + bytes(bloom))
        self.out.write(_FOOTER.pack(self.at, self.at + len(self.index), BLOOM_HASHES, self.width, self.docs, self.ids, _MAGIC))


class TableReader:
    """Reads one shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        index_at, bloom_at, self.hashes, self.width, self.docs, self.ids, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a token table")
        source.seek(index_at)
        index = source.read(bloom_at - index_at)
        self.bloom = source.read(size - _FOOTER.size - bloom_at)
        self.blocks, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            offset, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            count, at = _read_varint(index, at)
            self.blocks.append((bytes(key), offset, length, count))

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, _ = self.blocks[block]
        self.source.seek(offset)
        packed = self.source.read(length)
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError("damaged block")
        data, at, key = zlib.decompress(packed[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + n]
            at += own + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8, self.hashes))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of every document with this identifier."""
        key, low, high = key_of(doc_id), 0, len(self.blocks)
        if not self.may_hold(key):
            return []
        while low < high:  # the first block that starts at the key or after it
            middle = (low + high) // 2
            low, high = (low, middle) if self.blocks[middle][0] >= key else (middle + 1, high)
        found = []
        for block in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[block][0] > key:
                break
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.entries(block) if k == key]
        return found


# ---------------------------------------------------------------- tokenizing


def _strings(values: pa.Array) -> list[str]:
    """As to_pylist(), made by Arrow at once and not value by value."""
    return values.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of words.

    Byte-level BPE never merges across a space that a non-space follows, nor from letters to a
    punctuation mark after them. So a text may be cut before each such space, and a word after its
    letters, and the pieces encoded one by one; every piece is encoded by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True  # the sign of a space byte
        self.words: dict[str, bytes] = {}  # without the space before them
        self.tails: dict[str, bytes] = {}
        self.cut = re.compile(r"(?= \S)")
        letters = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
        self.letters = re.compile(letters).fullmatch
        self.stem = re.compile(letters + r"(?=[.,!?;:*%$#&|@\"'()\n-])")

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each after a space: many are encoded as one text, and each word
        begins at the one piece of it that begins with a space."""
        out, width = [], self.width
        texts = [" " + " ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
        for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(got.ids, f"<u{width}")
            starts, data = [*(np.flatnonzero(self.begins[ids]) * width).tolist(), len(ids) * width], ids.tobytes()
            out += [data[a:b] for a, b in zip(starts, starts[1:])]
        return out

    def _learn(self, new: list[str]) -> None:
        """new: words, without the space before them, whose ids are not known."""
        words, tails = self.words, self.tails
        parts = {w: m.end() for w in new if (m := self.stem.match(w))}
        stems = list({w[: parts[w]] if w in parts else w for w in new if w in parts or self.letters(w)} - words.keys())
        words.update(zip(stems, self._encoded_words(stems)))
        other = [w for w in new if w not in parts and w not in words]
        words.update(zip(other, self._encoded([" " + w for w in other])))
        ends = list({w[n:] for w, n in parts.items()} - tails.keys())
        tails.update(zip(ends, self._encoded(ends)))
        words.update((w, words[w[:n]] + tails[w[n:]]) for w, n in parts.items())

    def _odd(self, text: str) -> bytes:
        """A text with a space before white space or at its end is cut at safe spaces only."""
        return b"".join(self._encoded(self.cut.split(text)))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.width each.

        The words of all texts are numbered at once; each distinct word is looked up once, and the
        ids of its places are gathered by number.
        """
        odd = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        lists = pc.split_pattern(even, " ")
        numbered = pc.dictionary_encode(lists.flatten())
        index, distinct = numbered.indices.to_numpy().astype(np.int64), _strings(numbered.dictionary)
        if len(self.words) > _CACHE_LIMIT:  # what is frequent is in these texts too
            self.words = {w: self.words[w] for w in distinct if w in self.words}
            self.tails.clear()
        self._learn([w for w in distinct if w not in self.words])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        first = bounds[:-1] - bounds[0]  # a text's first word has no space before it
        heads = self._encoded(_strings(lists.flatten().take(pa.array(first))))
        index[first] = len(distinct) + np.arange(len(first))
        pieces = [*map(self.words.__getitem__, distinct), *heads]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        ids = np.frombuffer(b"".join(pieces), f"<u{self.width}")
        starts, own = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ends = np.cumsum(own)
        gathered = ids[np.repeat(starts - (ends - own), own) + np.arange(int(own.sum()))].tobytes()
        cuts = (np.concatenate(([0], ends))[bounds - bounds[0]] * self.width).tolist()
        out, at = [], 0
        for i, strange in enumerate(odd.tolist()):
            out.append(self._odd(texts[i].as_py()) if strange else gathered[cuts[at] : cuts[at + 1]])
            at += not strange
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- Spark jobs


def _portions(part: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of part in order, as slices of at most ``most`` bytes of text, or of one longer text."""
    ends = np.cumsum(pc.binary_length(part["text"]).to_numpy().astype(np.int64))
    at = 0
    while at < part.num_rows:
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield part.slice(at, until - at)
        at = until


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, at_once: int = BATCH_BYTES) -> DataFrame:
    """Writes docs (doc_id, text) as shards in folder; returns shard, path, docs, ids of each.

    at_once: bytes of text that a task encodes together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).withColumn("salt", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("salt")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        # each attempt writes a file of its own; the result names the file of the one that counts
        name = f"{folder}/shard-{shard:07d}-{uuid.uuid4().hex}.sst"
        files, path = _file_system(name)
        out = writer = None
        for part in batches:
            for some in _portions(part, at_once):
                for doc_id, value in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"])):
                    if writer is None:
                        files.create_dir(path.rpartition("/")[0], recursive=True)
                        out = files.open_output_stream(path)
                        writer = TableWriter(out, encoder.width)
                    writer.add(key_of(doc_id), value + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "docs": [writer.docs], "ids": [writer.ids]})

    return written(rows.mapInArrow(run, "shard int, path string, docs long, ids long"), "shards")


def read_tables(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards' files."""
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    placed = shards.withColumn("start", F.coalesce(before, F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, start in zip(part["path"], part["start"]):
                files, path = _file_system(name)
                with files.open_input_file(path) as source:
                    reader, out = TableReader(source), []
                    for key, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 8192:
                            yield _frame(out)
                            out = []
                    yield _frame(out)

    return placed.repartitionByRange(max(1, shards.count()), "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def op6_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_tables(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tables(shards)
