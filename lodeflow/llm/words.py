"""Byte-level BPE by ranks, each distinct word of the corpus encoded once behind a global shuffle of words.

1. Each task splits its texts by the vocabulary's pattern into pre-tokens and gives the distinct words of a block (about
   :data:`BLOCK` bytes of text) numbers, the most frequent first. A block becomes rows of two kinds: its words, in one row for
   each bucket of the words' hash, and its *positions*, the numbers of all its pre-tokens in their order.
2. The rows are shuffled by bucket. A word has one bucket, so all blocks' copies of it meet in one task, which encodes it once
   and joins its ids to each block's row. A word that stands in every text still is one entry for each block, so frequent words make no hot key.
3. The rows are shuffled by block. Ids are put where their words stand, and each text gets its own.

Decoding joins the token-byte table, one row for each vocabulary, and puts the bytes of a text's ids together.

A row for each occurrence, or for each word of each block, would shuffle over twice the bytes of the input. Packed rows hold
positions in about one byte for each pre-token, so what is shuffled stays near the compressed size of the texts, whose
bytes are never shuffled. Memory: a task holds one block and the ids of its words. A longer text is split where a
piece ends and is one block by itself; its ids are one value, so they are held whole.

Cases: a null or empty text has no ids and decodes to no bytes; null ids decode to no bytes. An id that the vocabulary lacks is
an error. Strings of special tokens in a text are ordinary text. Null, equal and repeated keys give a row each, as given. An
empty table gives an empty one. Columns other than the key and the text aren't carried, whatever their names.
"""

from __future__ import annotations

import array
import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import cleared, process_state, release_state, table

#: Bytes of text whose words are numbered together; bytes of text for each bucket of words; buckets of a small corpus.
BLOCK, BUCKET, MIN_BUCKETS = 16 << 20, 128 << 20, 48
#: Encoded words that a task holds; beyond them it starts anew, and encodes a word a second time.
KNOWN = 500_000
#: Between words: a byte that UTF-8 doesn't have.
BETWEEN = b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_bytes(file: bytes) -> dict[int, bytes]:
    """The bytes of each id in a file of ranks."""
    return {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file.splitlines() if line.strip())}


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2**32, first all their lowest bytes, then the next: the high ones are mostly zero and cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def loosened(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * 4), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).reshape(-1).view("<u4")


def emptied() -> None:
    """A worker process begins a task without what the task before has left in it."""
    release_state()
    pa.default_memory_pool().release_unused()


class Block:
    """The numbered words of some texts, and the numbers of their pre-tokens."""

    def __init__(self):
        self.words: list[str] = []
        self.encode = bpe.Encoder(bpe.Splitter(()), {}, self._numbered, KNOWN)
        self.rows: list[tuple[list, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def _numbered(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for n, piece in enumerate(pieces, len(self.words)):
            yield piece, n.to_bytes(4, "little")
        self.words.extend(pieces)

    def add(self, keys: list, texts: pa.Array) -> None:
        flat, ends = self.encode(texts)
        self.rows.append((keys, flat, np.diff(ends, prepend=0)))
        self.bytes += texts.nbytes

    def packed(self, block: int, n_buckets: int) -> Iterator[tuple]:
        """Rows of words by bucket, then rows of positions."""
        self.encode.known.clear()
        counts = np.zeros(len(self.words), np.int64)
        for _, flat, _ in self.rows:
            counts += np.bincount(flat, minlength=len(counts))
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        words = [self.words[i].encode() for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        for at in np.split(by_bucket, cuts[1:]) if len(words) else ():
            body = BETWEEN.join(map(words.__getitem__, at.tolist()))
            yield block, int(bucket[at[0]]), 0, squeezed(np.diff(at, prepend=0)), len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True), None, None
        for i, (keys, flat, sizes) in enumerate(self.rows):  # positions go along with words, evenly over the buckets
            yield block, zlib.crc32(f"{block} {i}".encode()) % n_buckets, 1, squeezed(number[flat]), None, keys, sizes.tolist()


def _batches(rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema.names)


def _packed(docs: DataFrame, n_buckets: int, key: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary()), ("keys", pa.list_(to_arrow_type(key))), ("sizes", pa.list_(pa.int64()))])

    def run(batches):
        emptied()
        place, held = TaskContext.get().partitionId() << 32, Block()
        for b in bpe.stretches(batches, 1):
            held.add(b.column(0).to_pylist(), b.column(1))
            if held.bytes >= BLOCK:
                yield from _batches(held.packed(place, n_buckets), schema)
                place, held = place + 1, Block()
        if held.rows:
            yield from _batches(held.packed(place, n_buckets), schema)

    return docs.mapInArrow(run, T.StructType([*T._parse_datatype_string("block long, bucket long, kind int, numbers binary, words binary").fields, T.StructField("keys", T.ArrayType(key)), T.StructField("sizes", T.ArrayType(T.LongType()))]))


def ranked(file: bytes):
    """The library's encoder for these ranks."""

    def make():
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in token_bytes(file).items()}, special_tokens={})

    return process_state(f"ranks_{zlib.crc32(file)}", make)


def encode_texts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: str = "ids", packed: str | None = None) -> DataFrame:
    """``key`` and the ids of ``text``, an ``array<int>``; with ``packed``, also the ids as little-endian unsigned 32-bit integers."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(bpe.vocabulary_file(path or default_path()))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, -(-total // BUCKET))

    def join_ids(batches):
        """In place of a bucket's words: how many ids each has, and the ids, one after another."""
        emptied()
        encode, known = ranked(file.value)._encode_single_piece, {}
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                body = row.column("words")[0].as_py()
                if body is not None:
                    words = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True).split(BETWEEN)
                    new = [w for w in words if w not in known]
                    if len(known) + len(new) > KNOWN:
                        known.clear()
                        new = words
                    known.update((w, array.array("I", encode(w)).tobytes()) for w in new)
                    lists = list(map(known.__getitem__, words))
                    counts = squeezed(np.fromiter(map(len, lists), np.uint32, len(lists)) // 4)
                    body = len(counts).to_bytes(8, "little") + counts + squeezed(np.frombuffer(b"".join(lists), "<u4"))
                    row = row.set_column(4, "words", pa.array([body], pa.binary()))
                yield row

    names = [ids, *([packed] if packed else [])]

    def assemble(batches):
        emptied()
        block, counts, flats, numbers, starts, sizes, flat = None, [], [], [], None, None, None
        for b in batches:
            for i in range(b.num_rows):
                at = b.column("block")[i].as_py()
                if at != block:
                    block, counts, flats, numbers, sizes = at, [], [], [], None
                if b.column("kind")[i].as_py() == 0:
                    body = b.column("words")[i].as_py()
                    n = int.from_bytes(body[:8], "little")
                    numbers.append(np.cumsum(loosened(b.column("numbers")[i].as_py()), dtype=np.int64))
                    counts.append(loosened(body[8 : 8 + n]).astype(np.int64))
                    flats.append(loosened(body[8 + n :]))
                    continue
                if sizes is None:
                    flat, own = np.concatenate([*flats, np.zeros(0, np.uint32)]), np.concatenate([*counts, np.zeros(0, np.int64)])
                    number = np.concatenate([*numbers, np.zeros(0, np.int64)])
                    sizes, starts = np.empty_like(own), np.empty_like(own)
                    sizes[number], starts[number] = own, np.cumsum(own) - own
                    counts, flats, numbers = [], [], []
                seq = loosened(b.column("numbers")[i].as_py())
                out = flat[bpe.spread(starts[seq], sizes[seq])].astype("<u4")
                ends = np.concatenate(([0], np.cumsum(sizes[seq])))[np.concatenate(([0], np.cumsum(b.column("sizes")[i].as_py())))]
                columns = [pa.array(b.column("keys")[i].as_py(), to_arrow_type(kind)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.view("<i4")))]
                if packed:
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(out)]))
                yield pa.RecordBatch.from_arrays(columns, [key, *names])

    made = _packed(rows, n_buckets, kind)
    joined = made.repartition(n_buckets, "bucket").mapInArrow(join_ids, made.schema)
    results = [T.StructField(key, kind), T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(packed, T.BinaryType())] if packed else [])]
    return joined.repartition(n_buckets, "block").sortWithinPartitions("block", "kind").mapInArrow(assemble, T.StructType(results))


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The token-byte table: one row, the vocabulary's checksum and the bytes of ids 0, 1, and so on, each byte a Latin-1 character.
    Its size is that of the vocabulary."""
    file = bpe.vocabulary_file(path or default_path())
    known = token_bytes(file)
    return spark.createDataFrame([(zlib.crc32(file), [known[i].decode("latin-1") if i in known else None for i in range(max(known) + 1)])], "vocabulary_ long, tokens_ array<string>")


def decode_ids(df: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for."""
    tokens = token_table(df.sparkSession, path)
    vocabulary = zlib.crc32(bpe.vocabulary_file(path or default_path()))
    rows = cleared(df, decoded, "vocabulary_", "tokens_").withColumn("vocabulary_", F.lit(vocabulary).cast("long"))
    one = F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.coalesce(F.element_at("tokens_", i + 1), F.raise_error(F.concat(F.lit("no token has the id "), i.cast("string"))).cast("string")))
    return rows.join(F.broadcast(tokens), "vocabulary_", "left").withColumn(decoded, F.encode(F.array_join(one, ""), "ISO-8859-1")).drop("vocabulary_", "tokens_")


def op11_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"), packed="packed")
    return decode_ids(encoded).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_distinct_words": op11_distinct_words}
ORACLE_SQL: dict[str, str] = {}
