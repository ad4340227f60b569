"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is split by the vocabulary's pattern; a piece's encoding does not depend on what is around it,
so each distinct piece is encoded once. The pieces that are new in a stretch of texts are sorted, which
is the depth-first order of their trie, and walked with a stack that holds, for each prefix on the
current path, the last token of its encoding. A prefix shared by many pieces is so encoded once. The
last token of a prefix is the longest token that ends it and that may follow the last token of what is
left; two tokens may follow each other if the merges of their joined bytes give just these two.

Each executor process does this for the texts it holds, with a table of known strings of bounded size;
nothing is shuffled. The table stays from task to task in a worker process. In a stretch of texts of ASCII and
Latin letters all pieces are found at once from the kinds of neighbouring bytes, and numbered by distinct piece, so
that the table is asked once for each distinct piece and ids are put together as arrays; other texts are
split one by one. Memory: texts are handled in stretches of about :data:`STRETCH` bytes, and a longer text in parts
that end where a piece ends (before what is no letter and follows one, in any script; a longer run of one kind
is one piece and is held whole).

The pattern is that of the vocabulary file's own byte-level splitter; a file with another splitter, or with a
normaliser, is an error.

Cases: a null or empty text has no ids; its decoded text is empty. The string of an added token is
that token, as the library has it by default. Null ids decode to an empty text. Rows repeat as given;
an empty table gives an empty one. Other columns stay; one named like a result is replaced.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleared, process_state, table

#: Bytes of text that are handled at once.
STRETCH = 1 << 22
#: Known pieces that an executor process keeps, about 250 bytes each; longer ones than this many characters aren't kept.
KNOWN, LONG = 400_000, 64

#: The pattern of byte-level splitters, and letters that are known to be such by their bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BEYOND = "[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]"
#: A place where a piece always ends.
SEAM = r"(?<=\p{L})(?=\P{L})"
_OTHER, _LETTER, _DIGIT, _SPACE, _WHITE, _NONE = range(6)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_file(path: str | None = None) -> bytes:
    """A vocabulary as it is sent to the executors: a file of a few MB, read at the driver."""
    with open(path or default_path(), "rb") as f:
        return f.read()


def byte_of_char() -> dict[str, int]:
    """Printable characters that stand for bytes: those of Latin-1 for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def checked(file: bytes) -> dict:
    """A vocabulary file's content; an error where its texts aren't split as :data:`PATTERN` does."""
    data = json.loads(file)
    before = data.get("pre_tokenizer") or {}
    if data.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("only vocabularies with a plain byte-level splitter and no normaliser are known")
    if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in data.get("added_tokens", ())):
        raise ValueError("added tokens that take in what is beside them are not known")
    return data


def _kinds() -> np.ndarray:
    """The kind of each byte of a text of ASCII and Latin letters."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[0x80:] = _LETTER
    for first, last, kind in (("A", "Z", _LETTER), ("a", "z", _LETTER), ("0", "9", _DIGIT), ("\t", "\r", _WHITE), (" ", " ", _SPACE)):
        kinds[ord(first) : ord(last) + 1] = kind
    return kinds


class Splitter:
    """Splits texts into pieces, and names added tokens in them."""

    def __init__(self, added: Iterable[str]):
        import regex

        self.pattern, self.seam, self.kinds = regex.compile(PATTERN), regex.compile(SEAM), _kinds()
        names = [re.escape(a) for a in sorted(added, key=len, reverse=True)]
        self.added = re.compile("(" + "|".join(names) + ")") if names else None
        #: Matches texts that are split one by one.
        self.apart = "|".join([BEYOND, *names])

    def parts(self, text: str) -> Iterator[str]:
        """Parts of about STRETCH characters that end where pieces do."""
        at = 0
        while len(text) - at > 2 * STRETCH and (m := self.seam.search(text, at + STRETCH)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def marked(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is an added token)."""
        for i, x in enumerate(self.added.split(text) if self.added else (text,)):
            if x:
                yield x, i % 2 == 1

    def starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces start in the bytes of ASCII and Latin texts; ``texts`` are where texts start that aren't empty."""
        kind = self.kinds[data]
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[texts] = _NONE
        after[texts[1:] - 1] = after[-1] = _NONE
        white = kind >= _SPACE
        opens = (kind != before) & (before != _SPACE)
        # of white space before something else, the last character is apart; a space goes with what follows
        opens[white] = (((before != _SPACE) & (before != _WHITE)) | (after < _SPACE))[white]
        at = np.flatnonzero((data == ord("'")) & opens & (after == _LETTER))  # one letter or two that go with the sign
        if len(at):
            tail = np.concatenate((data[at[-1] + 1 :][:3], np.zeros(3, np.uint8)))
            one, two = data[at + 1], np.where(after[at + 1] == _LETTER, np.concatenate((data, tail))[at + 2], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            opens[at[short | long] + 1] = False
            ends = np.concatenate((at[short] + 2, at[long] + 3))
            opens[ends[ends < len(opens)]] = True
        return np.flatnonzero(opens)

    def pieces(self, part: str) -> list[str]:
        return self.pattern.findall(part)


class Trie:
    """The vocabulary, and the walk over the trie of new pieces."""

    def __init__(self, file: bytes):
        data = checked(file)
        model = data["model"]
        byte = byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        self.added = {x["content"]: x["id"] for x in data.get("added_tokens", ())}
        names = {i: raw(s) for s, i in model["vocab"].items() if s not in self.added}
        self.ids = {b: i for i, b in names.items()}
        self.bytes = [b""] * (1 + max([*names, *self.added.values()]))
        for i, b in names.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        #: Length of the longest token with these two last bytes.
        self.tails: dict[bytes, int] = {}
        for b in self.ids:
            self.tails[b[-2:]] = max(len(b), self.tails.get(b[-2:], 1))
        self.follows: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """Plain merging by rank, for short words."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            rank, i, new = min(((*m[:1], i, m[1]) for i in range(len(out) - 1) if (m := self.merges.get((out[i], out[i + 1])))), default=(None, 0, 0))
            if rank is None:
                break
            out[i : i + 2] = [new]
        return out

    def may_follow(self, a: int, b: int) -> bool:
        if len(self.follows) > KNOWN:
            self.follows.clear()
        known = self.follows[a << 32 | b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """The ids of each word, in the order of the trie."""
        last: list[int] = [-1]
        before, ids, size, follows, tails = b"", self.ids.get, self.bytes, self.follows, self.tails.get
        for word in sorted(words):
            n = min(len(before), len(word))
            shared = n if before[:n] == word[:n] else next(i for i in range(n) if before[i] != word[i])
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - tails(word[end - 2 : end], 1)), end):
                    token = ids(word[start:end])
                    if token is not None:
                        if start:
                            ok = follows.get(last[start] << 32 | token)
                            if ok is None:
                                ok = self.may_follow(last[start], token)
                            if not ok:
                                continue
                        last.append(token)
                        break
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(size[last[end]])
            out.reverse()
            yield word, out
            before = word


class Encoder:
    """Ids of texts, by a table of known pieces and their ids, packed as little-endian 32-bit numbers; ``new`` encodes
    pieces that aren't known, in the order that suits it."""

    def __init__(self, split: Splitter, added: dict[str, int], new: Callable[[list[str]], Iterable[tuple[str, bytes]]], limit: int = KNOWN):
        self.split, self.added, self.new, self.limit = split, added, new, limit
        self.known: dict[str, bytes] = {}

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces. The table is emptied first where it would grow too large."""
        known = self.known
        out = list(map(known.get, pieces))
        missing = [p for p, x in zip(pieces, out, strict=True) if x is None]
        if missing:
            fresh = dict(self.new(missing))
            out = [fresh[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
            if len(known) + len(fresh) > self.limit:
                known.clear()
            known.update(fresh if max(map(len, missing)) <= LONG else {p: x for p, x in fresh.items() if len(p) <= LONG})
        return out

    def apart(self, text: str) -> np.ndarray:
        """The ids of a text that is split by itself."""
        out = []
        for part, is_added in self.split.marked(text):
            if is_added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            pieces = self.split.pieces(part)
            distinct = list(set(pieces))
            ids = dict(zip(distinct, self.pieces(distinct), strict=True))
            out.extend(map(ids.__getitem__, pieces))
        return np.frombuffer(b"".join(out), "<u4")

    def together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of ASCII and Latin letters, and where each text's end."""
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        if ends[0] == ends[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        low, ends = int(ends[0]), (ends - ends[0]).astype(np.int64)
        body = texts.buffers()[2].slice(low, int(ends[-1]))
        starts = self.split.starts(np.frombuffer(body, np.uint8), np.unique(ends[:-1][np.diff(ends) > 0]))
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32)), body).dictionary_encode()
        packed = self.pieces(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        which = pieces.indices.to_numpy()
        counts = sizes[which]
        done = np.concatenate(([0], np.cumsum(counts)))
        return np.frombuffer(b"".join(packed), "<u4")[spread((np.cumsum(sizes) - sizes)[which], counts)], done[np.searchsorted(starts, ends[1:])]

    def _at_once(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        alone = pc.match_substring_regex(texts, self.split.apart).to_numpy(zero_copy_only=False)
        if not alone.any():
            return self.together(texts)
        flat, ends = self.together(pc.if_else(pa.array(alone), "", texts))
        parts = np.split(flat, ends[:-1])
        for i in np.flatnonzero(alone).tolist():
            parts[i] = self.apart(texts[i].as_py())
        return np.concatenate(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's end."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(texts) == 1 and len(texts[0].as_py()) > 2 * STRETCH:
            parts = [self._at_once(pa.array([y]))[0] if not is_added else np.array([self.added[y]], np.uint32) for x, is_added in self.split.marked(texts[0].as_py()) for y in ([x] if is_added else self.split.parts(x))]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self._at_once(texts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places ``starts[i]``, ``starts[i] + 1``, and so on, ``counts[i]`` of them, one after another."""
    done = np.cumsum(counts)
    return np.repeat(starts - (done - counts), counts) + np.arange(int(done[-1]) if len(done) else 0)


def encoder(file: bytes) -> tuple[Encoder, Tokens]:
    """What gives texts' ids, and the bytes of ids."""

    def make():
        trie = Trie(file)
        new = lambda pieces: ((w.decode(), array.array("I", ids).tobytes()) for w, ids in trie.encode([p.encode() for p in pieces]))
        return Encoder(Splitter(trie.added), trie.added, new), Tokens(trie.bytes)

    return process_state(f"trie_{zlib.crc32(file)}", make)


class Tokens:
    """The bytes of each id."""

    def __init__(self, token: list[bytes]):
        self.flat = np.frombuffer(b"".join(token), np.uint8)
        self.sizes = np.array([len(x) for x in token], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids, given one after another; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.sizes[ids]
        data = self.flat[spread(self.starts[ids], sizes)]
        done = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
        out = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(done), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(done[:-1].tolist(), done[1:].tolist(), strict=True)], pa.large_string())
        return out.cast(pa.string())


def stretches(batches: Iterable[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """Rows with about STRETCH bytes of text together; a longer text by itself."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().tolist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > STRETCH:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield b.slice(start)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with their texts' ids, an ``array<int>``; with ``decoded``, also the text that the ids give,
    decoded where they were encoded, so they need not go to a second worker."""
    docs = cleared(docs, ids) if ids != text else docs
    docs = cleared(docs, decoded) if decoded else docs
    file = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))
    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches):
        encode, tokens = encoder(file.value)
        for b in stretches(batches, text):
            flat, ends = encode(b.column(text))
            columns = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.view(np.int32)))]
            if decoded:
                columns.append(tokens.texts(flat, ends))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(k.name for k in kinds)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *kinds]))


def decode_ids(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; bytes that are no UTF-8 become U+FFFD."""
    df = cleared(df, text) if ids != text else df
    file = df.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(batches):
        tokens = Tokens(Trie(file.value).bytes)
        for b in slices(batches):
            lists = b.column(ids)
            texts = tokens.texts(lists.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def op10_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return encode_texts(docs.select("doc_id", "text"), decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
