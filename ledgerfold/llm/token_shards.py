"""Operator 8: token ids in sorted-string-table shards.

A shard file holds documents in ascending key order in prefix-compressed blocks,
followed by a sparse block index, a Bloom filter and a footer:

``LFSST1\\0\\0``
data block *
    entry: shared, unshared, value length as varints, unshared key bytes, value
    (restart: the first entry of a block shares nothing); the block is deflated
index: for each block its first key (length-prefixed), offset, length
Bloom filter: 64-bit words
footer (64 bytes): index offset and length, Bloom offset and length, number of
    hashes, entries, token count, magic

A key is a document's identifier as 8 big-endian bytes with the sign bit flipped
(byte order is numeric order; a null identifier is the empty key, which sorts
first) and 8 bytes of sequence number among equal identifiers.  A value is the
document's token ids as little-endian unsigned 32-bit integers, or unsigned
16-bit where all fit (the first byte says which).

Shards are ranges of identifiers: ``write_shards`` cuts them by quantiles of the
identifier column alone, moves each text once, and writes every shard from one
sorted partition by a temporary name and a rename, so a lost task is repeated
without harm.  ``read_shards`` returns the documents of the files; ``lookup``
finds one document by Bloom filter, binary search of the block index and one
block.

Defined results: a null text is empty (it has the end id alone); repeated
identifiers are kept, in text order (ties are equal rows); an empty table writes one
empty shard; further columns are ignored; very long texts are encoded whole.  All
rows of one identifier go to one shard.  Beyond ``MAX_SHARDS`` shards their size
grows with the table instead of their number: a shard is written from a sorted
stream, so its size bounds no memory.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import cache, open_binary, publish, python_ready, shared_path, table, text_of, worker_task

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"LFSST1\0\0"
FOOTER = struct.Struct("<QQQQIIQQ8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
#: Characters of text a shard holds about, and the most shards: beyond them the
#: shards grow, so that the manifest stays small.
SHARD_CHARS = 24_000_000
MAX_SHARDS = 20_000
#: Words whose ids a worker remembers; when full only words met in several batches
#: stay, so its memory is bounded.
MEMO_WORDS = 600_000
GATHER_BYTES = 8 << 20

#: Lower-case letters that every normalisation leaves as they are.
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")



class WordMemo:
    """Encodes texts through the tokenizers library, each distinct word once.

    The vocabulary's own splitting never crosses white space, so a text's ids are
    the concatenation of its words' ids; Arrow splits and numbers the words of a
    batch, and only words not met before go to the library.  Texts with ``<|``
    could hold a special token's name, whose match precedes lower-casing; they go
    to the library whole.
    """

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if PLAIN.fullmatch(chr(c))}
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.uint16)
        self.count, self.size = 0, 0

    def _thin(self):
        """Keep the words met in several batches, at most half the limit."""
        uses = self.uses[: self.count]
        least = 2
        while np.count_nonzero(uses >= least) > self.limit // 2:
            least += 1
        kept = np.flatnonzero(uses >= least)
        ends = self.ends[: self.count]
        starts = np.concatenate([[0], ends[:-1]])[kept] if self.count else ends
        length = ends[kept] - starts
        at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        words, ids, uses = list(self.index), self.ids[at], uses[kept] // 2
        self._forget()
        self.index = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.count, self.size = len(kept), len(ids)
        self.ids = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.ends = np.concatenate([np.cumsum(length), np.zeros(1 << 14, np.int64)])
        self.uses = np.concatenate([uses, np.zeros(1 << 14, np.uint16)])

    def _learn(self, words: list[str]):
        """Remember the ids of new words.  A word of lower-case Latin letters alone
        is one piece that no normaliser changes, so it goes straight to the
        vocabulary's model, in the byte alphabet of the model."""
        is_plain = [PLAIN.fullmatch(w) is not None for w in words]
        plain = [w for w, p in zip(words, is_plain, strict=True) if p]
        other = [w for w, p in zip(words, is_plain, strict=True) if not p]
        model, letters = self.model, self.letters
        self._keep(plain, [[t.id for t in model.tokenize(w if w.isascii() else w.translate(letters))] for w in plain])
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            self._keep(part, [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])

    def _keep(self, words: list[str], got: list[list[int]]):
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(got) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.ids[self.size : self.size + len(flat)] = flat
        self.ends[self.count : self.count + len(got)] = self.size + np.cumsum(lengths)
        self.index.update(zip(words, range(self.count, self.count + len(got)), strict=True))
        self.size += len(flat)
        self.count += len(got)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        low = pc.ascii_lower(texts)
        # A blank before the punctuation after a letter changes no piece, and makes
        # "word" and "word," one word here.
        low = pc.replace_substring_regex(low, r"([a-z])([.,!?;:]+)", r"\1 \2")
        lists = pc.ascii_split_whitespace(low)
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.count + len(distinct) > self.limit:
            self._thin()
        self._learn([w for w in distinct if w not in self.index])
        which = np.fromiter((self.index[w] for w in distinct), np.int64, len(distinct))
        self.uses[which] = np.minimum(self.uses[which], 60_000) + 1
        stops = self.ends[which] if len(which) else np.zeros(0, np.int64)
        starts = np.where(which > 0, self.ends[which - 1], 0) if len(which) else stops
        codes = coded.indices.to_numpy(zero_copy_only=False)
        first, length = starts[codes], (stops - starts)[codes]
        out = []
        for i in range(len(texts)):
            if odd[i]:
                out.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
                continue
            a, n = first[offsets[i] : offsets[i + 1]], length[offsets[i] : offsets[i + 1]]
            total = int(n.sum())
            # Positions a, a+1, ... of every word, laid end to end.
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
            out.append(self.ids[at])
        return out


def gathered(batches, most: int = GATHER_BYTES):
    """Larger batches: more words in common, still bounded."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_memo(path: str | None = None) -> WordMemo:
    """This worker's memo of a vocabulary file."""
    path, memos = path or vocabulary_path(), cache("tokens")
    if path not in memos:
        memos[path] = WordMemo(path)
    return memos[path]


# --- the file format -----------------------------------------------------------


def key_of(identifier: int | None, sequence: int) -> bytes:
    head = b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & (1 << 64) - 1)
    return head + struct.pack(">Q", sequence)


def identifier_of(key: bytes) -> int | None:
    return None if len(key) == 8 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varint_at(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def value_of(ids: np.ndarray) -> bytes:
    if not len(ids) or ids.max() < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _bloom_places(identifier: int | None, bits: int, hashes: int):
    h = zlib.crc32(key_of(identifier, 0)) | zlib.crc32(key_of(identifier, 0), 0x9E3779B9) << 32
    h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes entries that come in ascending key order to an open file."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes = out, block_bytes
        self.at = out.write(MAGIC) or len(MAGIC)
        self.block, self.first, self.last, self.index = bytearray(), None, b"", bytearray()
        self.keys: list[int | None] = []
        self.tokens = 0

    def add(self, identifier: int | None, sequence: int, ids: np.ndarray):
        key = key_of(identifier, sequence)
        shared = 0
        if self.first is None:
            self.first = key
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        value = value_of(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.tokens += len(ids)
        self.keys.append(identifier)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self):
        if self.first is None:
            return
        data = zlib.compress(bytes(self.block), 1)
        self.index += _varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(data))
        self.out.write(data)
        self.at += len(data)
        self.block, self.first, self.last = bytearray(), None, b""

    def close(self):
        self._flush()
        n = len(self.keys)
        words = max(1, -(-n * BLOOM_BITS_PER_KEY // 64))
        bloom = bytearray(8 * words)
        for k in self.keys:
            for p in _bloom_places(k, 64 * words, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(bytes(self.index))
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(
            self.at, len(self.index), self.at + len(self.index), len(bloom), BLOOM_HASHES, 0, n, self.tokens, MAGIC))


class ShardReader:
    """Reads a shard by blocks; ``get`` is a point lookup."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        at, size, bloom_at, bloom_size, self.hashes, _, self.entries, self.tokens, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        source.seek(at)
        raw = source.read(size)
        source.seek(bloom_at)
        self.bloom = source.read(bloom_size)
        self.first, self.blocks, i = [], [], 0
        while i < len(raw):
            n, i = _varint_at(raw, i)
            self.first.append(raw[i : i + n])
            offset, i = _varint_at(raw, i + n)
            length, i = _varint_at(raw, i)
            self.blocks.append((offset, length))

    def block(self, i: int):
        """(key, value) of one block's entries."""
        offset, length = self.blocks[i]
        self.source.seek(offset)
        data, at, key = zlib.decompress(self.source.read(length)), 0, b""
        while at < len(data):
            shared, at = _varint_at(data, at)
            own, at = _varint_at(data, at)
            size, at = _varint_at(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def __iter__(self):
        for i in range(len(self.blocks)):
            for key, value in self.block(i):
                yield identifier_of(key), ids_of(value)

    def may_hold(self, identifier: int | None) -> bool:
        bits = 8 * len(self.bloom)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(identifier, bits, self.hashes))

    def get(self, identifier: int | None) -> np.ndarray | None:
        """Ids of the first document with this identifier."""
        if not self.may_hold(identifier):
            return None
        key = key_of(identifier, 0)
        i = bisect_right(self.first, key) - 1
        if i < 0:
            return None
        return next((ids_of(v) for k, v in self.block(i) if k == key), None)


# --- Spark ---------------------------------------------------------------------


def range_bounds(docs: DataFrame, id_column: str, shard_chars: int) -> list[int]:
    """Upper bounds of all shards but the last, from the identifiers alone."""
    chars, low = docs.agg(F.sum(F.length("text")), F.min(id_column)).first()
    shards = min(MAX_SHARDS, max(1, -(-(chars or 0) // shard_chars)))
    if shards == 1 or low is None:
        return []
    cuts = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(id_column, cuts, 100 * shards)).first()[0]
    return sorted(set(found))


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 vocabulary: str | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Tokenise and write all documents under ``path``; return the manifest:
    ``shard, path, documents, tokens, start`` (ids in the shards before)."""
    spark = docs.sparkSession
    python_ready(spark)
    vocabulary = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text_of(text_column).alias("text"))
    bounds = range_bounds(rows, "id", shard_chars)
    # A document's shard: the number of bounds below it; a null id is the smallest.
    shard = F.lit(0)
    if bounds:
        shard = F.when(F.col("id").isNull(), 0).otherwise(_bisect("id", bounds))
    dealt = (
        rows.withColumn("shard", shard.cast("int"))
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    )

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        final = f"{path}/shard-{number:06d}.sst"
        temporary = f"{final}.{TaskContext.get().taskAttemptId()}.tmp"
        memo, out = word_memo(vocabulary), open_binary(temporary, "wb")
        writer, last, sequence, shards = ShardWriter(out), (), 0, set()
        for batch in gathered(batches):
            shards.update(batch.column("shard").unique().to_pylist())
            for identifier, ids in zip(batch.column("id").to_pylist(), memo.encode(batch.column("text")), strict=True):
                sequence = sequence + 1 if (identifier,) == last else 0
                last = (identifier,)
                writer.add(identifier, sequence, np.append(ids, np.uint32(END_ID)))
        writer.close()
        out.close()
        if len(shards) > 1:
            raise RuntimeError(f"partition {number} got the shards {sorted(shards)}")
        publish(temporary, final)
        yield pa.RecordBatch.from_pylist(
            [{"shard": min(shards, default=-1), "path": final, "documents": len(writer.keys), "tokens": writer.tokens}],
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    written = dealt.mapInArrow(worker_task(run, "tokens"), "shard int, path string, documents bigint, tokens bigint").collect()
    # One small row for each shard file.  Empty partitions hold nothing.
    files, start = [], 0
    for r in sorted((r for r in written if r.documents or len(written) == 1), key=lambda r: r.shard):
        files.append((r.shard, r.path, r.documents, r.tokens, start))
        start += r.tokens
    return spark.createDataFrame(files, "shard int, path string, documents bigint, tokens bigint, start bigint")


def _bisect(column: str, bounds: list[int]) -> F.Column:
    """Number of bounds below the value: nested comparisons of logarithmic depth,
    or a vectorised binary search where there are too many bounds for a plan."""

    def tree(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(bounds) <= 256:
        return tree(0, len(bounds))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "left").astype(np.int32))

    return place(F.coalesce(F.col(column), F.lit(-(1 << 63))))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the shard files."""
    spark = manifest.sparkSession
    python_ready(spark)
    return _read(manifest, True)


def _read(manifest: DataFrame, with_ids: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, held, size = row["start"], [], 0
                with open_binary(row["path"], "rb") as source:
                    for identifier, ids in ShardReader(source):
                        x = {"doc_id": identifier, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                        if with_ids:
                            x["ids"] = ids.tolist()
                            size += len(ids)
                        held.append(x)
                        at += len(ids)
                        if len(held) >= 4096 or size >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        ddl += ", ids array<bigint>"
    schema = pa.schema(fields)
    rows = manifest.select("path", "start").collect()
    spark = manifest.sparkSession
    # One task a file; a plan of file names, not of data.
    files = spark.createDataFrame(rows or [], "path string, start bigint").repartition(max(1, len(rows)))
    return files.mapInArrow(worker_task(run, "tokens"), ddl)


def lookup(manifest: DataFrame, identifier: int | None) -> np.ndarray | None:
    """Ids of one document by binary search, or None."""
    for row in manifest.orderBy("shard").toLocalIterator():
        with open_binary(row.path, "rb") as source:
            found = ShardReader(source).get(identifier)
        if found is not None:
            return found
    return None


def encode_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards and read them back, without the ids themselves."""
    path = path or shared_path(docs.sparkSession, "token-shards")
    return _read(write_shards(docs, path, **options), False)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, from the shard files written for them."""
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_shards": op8_token_shards}
ORACLE: dict[str, str] = {}
