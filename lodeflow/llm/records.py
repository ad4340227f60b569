"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

File format: records follow each other; each is

    u64 length of the payload | u32 masked CRC-32 of these 8 bytes | payload | u32 masked CRC-32 of the payload

with a payload of ``u8`` bytes per id (2 or 4), ``u8`` whether there is a document id, ``i64`` that id,
then the ids; all little-endian. A checksum is masked, since it is often stored inside data that
is itself checksummed: rotated right by 15 bits, plus 0xA282EAD8. The index, a Parquet table
in ``index/``, has for each record its file, place in the order, offset, length, and number of ids.

Documents are range-partitioned by id (each text is shuffled once; the number of ranges follows the bytes
of text) and each task writes one file in ascending order. A file is named by its attempt, and the index only lists what committed tasks wrote,
so a lost executor or a second attempt leaves at most an unused file. Files are written by
``pyarrow.fs`` into the shared folder; nothing stays on an executor.

Cases: a null or empty text has the end id alone. Null document ids come first and are read back as
null; equal ids are ordered by their texts, null first. An empty table writes an empty index. Columns other than
the id and the text aren't written, whatever their names.
"""

from __future__ import annotations

import array
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import process_state, remove_at_exit, shared_dir, table

INDEX = "doc_id long, file string, part int, place long, offset long, length long, n_tokens long"
HEAD = "<BBq"
#: Known strings that an executor process keeps; bytes of text for each file; files of a small corpus.
KNOWN, FILE, MIN_FILES = 1_000_000, 32 << 20, 8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframed(stream) -> Iterator[bytes]:
    """Payloads of a stream of records, checked."""
    while head := stream.read(12):
        size = head[:8]
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(size):
            raise ValueError("a record's length is damaged")
        n = struct.unpack("<Q", size)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
            raise ValueError("a record is damaged")
        yield body[:n]


def _payload(width: int, doc_id: int | None, body: bytes) -> bytes:
    return struct.pack(HEAD, width, doc_id is not None, doc_id or 0) + body


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A payload; ``ids`` are packed 32-bit numbers."""
    return _payload(width, doc_id, ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    width, has, doc_id = struct.unpack_from(HEAD, payload)
    body = payload[struct.calcsize(HEAD) :]
    return (doc_id if has else None), (body if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes())


def library_encoder(file: bytes) -> tuple[bpe.Encoder, int]:
    """What gives texts' ids, and the size of the vocabulary. Pieces are encoded by the library's model, each distinct one once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make():
        bpe.checked(file)
        t = Tokenizer.from_str(file.decode())
        added = {x.content: i for i, x in t.get_added_tokens_decoder().items()}

        char = {b: c for c, b in bpe.byte_of_char().items()}
        model = t.model

        def new(pieces):
            for piece in pieces:
                yield piece, array.array("I", [x.id for x in model.tokenize(piece.encode().decode("latin-1").translate(char))]).tobytes()

        return bpe.Encoder(bpe.Splitter(added), added, new, KNOWN), t.get_vocab_size()

    return process_state(f"library_{zlib.crc32(file)}", make)


def write_records(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the texts' ids, each with ``end_id`` after them, in ascending order of ``key``, and the index, which it returns as read back."""
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(bpe.vocabulary_file(path))
    def run(batches):
        from pyarrow import fs

        encode, n_vocab = library_encoder(file.value)
        width = 2 if max(n_vocab, (end_id or 0) + 1) <= 1 << 16 else 4
        kind = f"<u{width}"
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        store, where = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.records"
        first = next(batches := iter(bpe.stretches(batches, 1)), None)
        if first is None:
            return
        offset, place = 0, 0
        with store.open_output_stream(f"{where}/{name}") as out:
            for b in itertools.chain([first], batches):
                flat, ends = encode(b.column(1))
                n = b.num_rows
                counts = np.diff(ends, prepend=0) + (end_id is not None)
                body, cuts = flat.astype(kind).tobytes(), [0, *(ends * width).tolist()]
                records = [frame(_payload(width, doc_id, body[lo:hi] + end)) for doc_id, lo, hi in zip(b.column(0).to_pylist(), cuts[:-1], cuts[1:], strict=True)]
                out.write(b"".join(records))
                lengths = np.fromiter(map(len, records), np.int64, n)
                offsets = offset + np.cumsum(lengths) - lengths
                columns = [pa.array([name] * n), pa.array(np.full(n, part, np.int32)), *(pa.array(x) for x in (place + np.arange(n), offsets, lengths, counts))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "file", "part", "place", "offset", "length", "n_tokens"])
                offset, place = offset + int(lengths.sum()), place + n

    _make_folder(folder)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # rows of one id are dealt by the starts of their texts too, so that neither an id nor the null id makes a range larger
    ranged = rows.withColumn("start_", F.left("text", F.lit(32))).repartitionByRange(max(MIN_FILES, -(-total // FILE)), "doc_id", "start_")
    ranged.select("doc_id", "text").sortWithinPartitions("doc_id", "text").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _make_folder(folder: str) -> None:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    store.create_dir(where, recursive=True)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each record from the files: ``doc_id``, ``start`` (ids in all records before it), ``n_tokens`` and ``ids`` (packed 32-bit)."""
    files = spark.read.parquet(f"{folder}/index").groupBy("file", "part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, files.count())
    starts = files.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select("file", "base").repartition(n)

    def run(batches):
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{where}/{name}", buffer_size=1 << 20) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for payload in unframed(stream):
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start, held = start + len(ids) // 4, held + len(ids)
                        if held > 4 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names)

    return starts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names)


def read_at(folder: str, file: str, offset: int) -> tuple[int | None, bytes]:
    """One record by its place in the index."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{where}/{file}") as f:
        f.seek(offset)
        return unpack(next(unframed(f)))


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    write_records(table(spark, sf_dir, "documents"), folder)
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_binary_records": op8_binary_records}
ORACLE_SQL: dict[str, str] = {}
