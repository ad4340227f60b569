"""Suffix-array dedup: byte strings of a threshold length that also start earlier are removed.

Suffixes are ordered only as far as the threshold, most significant digits first, and what is alone after a
pass is dropped, so that equal groups of the last pass are exactly the repeated windows:

1. The first digit is the window's *anchor*: the least, by hash, of its :data:`DIGIT`-byte strings. Equal
   windows have equal anchors at equal offsets, so one anchor stands for all windows around it (about 1 position in
   30). Anchors are dealt by hash and sorted; one that is alone in the corpus ends here.
2. The remaining anchors are looked up in their documents, and the bytes that windows around them can
   take in (the *surroundings*) are the next digits. Equal surroundings need no further pass: all but
   the first are covered whole.
3. Different surroundings of one anchor are sorted once for each offset of the window to the anchor, by a hash
   of the window's digits and then, neighbour by neighbour, by the digits themselves, so that equal means equal bytes.
   All windows around one anchor overlap, so what is covered there is one span, kept as its two ends.

Hashes deal and sort; what is removed has been compared byte by byte (rows of one id are told apart by 64-bit hashes).

Texts move once, by a hash of the document's id (both times they are needed the same shuffle is read);
anchors, surroundings and spans move as packed arrays. The number of parts grows with the bytes of text.
An anchor is sent once for each stretch of texts it repeats in, and equal surroundings once for each part, so
a common line or a group of copies costs a row for each part of the corpus and not for each document. What one
task holds of a single anchor grows with the number of *different* surroundings it has.

Cases: a null text is empty. Rows that share an id are ordered by a hash of their texts; of equal rows all
but one are covered whole. A null id comes first. Texts below the threshold are kept. A text that
repeats a string within itself counts too. An empty table gives an empty result. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import cleared, release_state, table
from .graph import map_groups
from .minhash import mix

#: Bytes of the first digit; bytes of text for each part; bytes handled at once.
DIGIT, PART, PIECE = 32, 8 << 20, 1 << 20
_ROOT = 0x9E3779B97F4A7C15
_NULL_ID = -(1 << 63)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self, n: int = 1 << 16):
        self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        np.cumprod(np.full(n - 1, _ROOT, np.uint64), out=self.up[1:])
        np.cumprod(np.full(n - 1, pow(_ROOT, -1, 1 << 64), np.uint64), out=self.down[1:])


def digit_hashes(data: np.ndarray, powers: Powers, size: int = DIGIT) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = len(powers.up) - size
    for at in range(0, n, step):
        part = data[at : at + step + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers.up[: len(part)], out=sums[1:])
        m = len(part) - size + 1
        out[at : at + m] = mix((sums[size:] - sums[:-size]) * powers.down[:m])
    return out


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over each run of ``size``."""
    span = 1
    while span * 2 <= size:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    rest = size - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows that lie within documents, and their hashes; ``bounds`` are
    the documents' ends in ``data``, with 0 before them. Every window's anchor is among them."""
    hashes = digit_hashes(data, powers)
    width = window - DIGIT + 1
    if len(data) < window:
        return np.zeros(0, np.int64), hashes[:0]
    rank = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(rank, width, np.minimum)
    outside = np.zeros(len(least) + 1, np.int32)  # windows that reach over a document's end
    ends = bounds[1:-1]
    np.add.at(outside, np.clip(ends - window + 1, 0, len(least)), 1)
    np.add.at(outside, np.clip(ends, 0, len(least)), -1)
    least[np.cumsum(outside[:-1]) > 0] = 0
    pad = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), width, np.maximum)[: len(rank)] == rank)
    return at, hashes[at]


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _stretches(ids, ties, texts: list[bytes], window: int) -> Iterator[tuple[list, list, list[bytes], list[int]]]:
    """Documents, up to PIECE bytes at once; a longer one in pieces that overlap by a window. Also where each starts in its document."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for i, t, x in zip(ids, ties, texts, strict=True):
        for at in range(0, max(1, len(x) - window + 1), PIECE):
            part = x[at : at + PIECE + window - 1]
            if len(part) < window:
                continue
            if held[0] and size + len(part) > PIECE:
                yield held
                held, size = ([], [], [], []), 0
            for k, v in zip(held, (i, t, part, at), strict=True):
                k.append(v)
            size += len(part)
    if held[0]:
        yield held


ASKED = "part int, hash binary, at binary, doc binary, ids binary, ties binary, known boolean"


def ask(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Anchors of all documents, by hash. The first of an anchor in a stretch asks whether it is elsewhere; the others know."""

    def run(batches):
        release_state()
        powers = Powers()
        for b in slices(batches):
            for ids, ties, texts, starts in _stretches(b.column("id_").to_pylist(), b.column("tie_").to_pylist(), _texts(b.column("text_")), window):
                bounds = np.cumsum([0, *map(len, texts)])
                at, hashes = anchors(np.frombuffer(b"".join(texts), np.uint8), bounds, window, powers)
                if not len(at):
                    continue
                doc = np.searchsorted(bounds, at, side="right") - 1
                place = (at - bounds[doc] + np.asarray(starts)[doc]).astype(np.uint32)
                order = np.argsort(hashes, kind="stable")
                h = hashes[order]
                new = np.concatenate(([True], h[1:] != h[:-1]))
                alone = new & np.concatenate((new[1:], [True]))
                part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                low = h.astype(np.uint32)
                ids_, ties_ = np.asarray(ids, np.int64), np.asarray(ties, np.int64)
                rows = []
                for mask, known in ((new, False), (~alone, True)):
                    some = np.flatnonzero(mask)
                    if not len(some):
                        continue
                    d = doc[order[some]]
                    to = (part[some] if not known else (ids_[d] ^ ties_[d]).view(np.uint64) % np.uint64(parts)).astype(np.int64)
                    some = some[by := np.argsort(to, kind="stable")]
                    to = to[by]
                    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
                        pick = some[lo:hi]
                        used, short = np.unique(doc[order[pick]], return_inverse=True)
                        rows.append((int(to[lo]), low[pick].tobytes(), place[order[pick]].tobytes(), short.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes(), ids_[used].tobytes(), ties_[used].tobytes(), known))
                yield _batch(rows, ASKED)

    return docs.select("id_", "tie_", "text_").mapInArrow(run, ASKED)


_TYPES = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _arrays(t: pa.Table | pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
        yield int(to[lo]), order[lo:hi]


FOUND = "part int, at binary, ids binary, ties binary"


def answer(asked: DataFrame, parts: int) -> DataFrame:
    """Places of anchors that the corpus has more than once, by part of their documents."""

    def run(t: pa.Table):
        for part in np.unique(t.column("part").to_numpy()).tolist():
            rows = t.filter(pc.equal(t.column("part"), part))
            ask_ = rows.filter(pc.invert(rows.column("known")))
            at, ids, ties = [], [], []
            for group, known in ((ask_, False), (rows.filter(rows.column("known")), True)):
                if not group.num_rows:
                    continue
                doc = [np.frombuffer(d, np.uint16 if len(i) // 8 < 1 << 16 else np.uint32) for d, i in zip(group.column("doc").to_pylist(), group.column("ids").to_pylist(), strict=True)]
                i = np.concatenate([x[d] for x, d in zip(_arrays(group, "ids", np.int64), doc, strict=True)])
                j = np.concatenate([x[d] for x, d in zip(_arrays(group, "ties", np.int64), doc, strict=True)])
                p = np.concatenate(_arrays(group, "at", np.uint32))
                if not known:
                    h = np.concatenate(_arrays(group, "hash", np.uint32))
                    order = np.argsort(h, kind="stable")
                    same = h[order][1:] == h[order][:-1]
                    again = np.zeros(len(h), bool)
                    again[order[1:][same]] = True
                    again[order[:-1][same]] = True
                    i, j, p = i[again], j[again], p[again]
                at.append(p)
                ids.append(i)
                ties.append(j)
            if at:
                p, i, j = np.concatenate(at), np.concatenate(ids), np.concatenate(ties)
                yield _batch([(to, p[k].tobytes(), i[k].tobytes(), j[k].tobytes()) for to, k in _dealt(_part_of(i, j, parts))], FOUND)

    return map_groups(asked, ["part"], run, FOUND)


def _part_of(ids: np.ndarray, ties: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ (ties.view(np.uint64) * np.uint64(_ROOT))) % np.uint64(parts)).astype(np.int64)


AROUND = "part int, hash binary, around binary, left binary, right binary, at binary, ids binary, ties binary, spans boolean"


def surroundings(docs: DataFrame, found: DataFrame, window: int, parts: int) -> DataFrame:
    """Surroundings of the repeated anchors, by anchor; what they show at once to be covered goes as spans."""
    before, after = window - DIGIT, window

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_batch([], AROUND)]
        if left.num_rows and right.num_rows:
            out += around(left, right)
        return pa.Table.from_batches(out)

    def around(left, right):
        import zstandard

        packed = zstandard.ZstdCompressor(level=1).compress
        left = left.combine_chunks()
        order = np.lexsort((left.column("tie_").to_numpy(), left.column("id_").to_numpy()))
        ids, ties = left.column("id_").to_numpy()[order], left.column("tie_").to_numpy()[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])))
        order, ids, ties = order[new], ids[new], ties[new]  # equal rows are one document here
        texts = _texts(left.column("text_").take(pa.array(order)))
        ends = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join([bytes(before), *texts, bytes(after)]), np.uint8)
        p = np.concatenate(_arrays(right, "at", np.uint32)).astype(np.int64)
        i, j = np.concatenate(_arrays(right, "ids", np.int64)), np.concatenate(_arrays(right, "ties", np.int64))
        key = np.empty(len(ids), [("a", np.int64), ("b", np.int64)])
        key["a"], key["b"] = ids, ties
        want = np.empty(len(i), key.dtype)
        want["a"], want["b"] = i, j
        doc = np.searchsorted(key, want)
        doc, p = _unique_pairs(doc, p)
        powers = Powers(1 << 10)
        for lo in range(0, len(p), 50_000):  # in order of documents and places
            d, q = doc[lo : lo + 50_000], p[lo : lo + 50_000]
            l, r = np.minimum(q, before), np.minimum(ends[d + 1] - ends[d] - q, after)
            at = ends[d] + q  # in data, where the first byte of the surroundings is
            rows = np.lib.stride_tricks.sliding_window_view(data, before + after)[at]
            column = np.arange(before + after)
            rows = np.where((column >= (before - l)[:, None]) & (column < (before + r)[:, None]), rows, 0).astype(np.uint8)
            weight = powers.up[: before + after]
            h = mix(((rows[:, before : before + DIGIT].astype(np.uint64) + np.uint64(1)) * weight[:DIGIT]).sum(1, dtype=np.uint64))
            whole = mix(((rows.astype(np.uint64) + np.uint64(1)) * weight).sum(1, dtype=np.uint64) + (l * 256 + r).astype(np.uint64))
            _, first, which = np.unique(whole, return_index=True, return_inverse=True)
            first = first[which]  # the one before with an equal hash, whose bytes are compared
            again = (first != np.arange(len(q))) & (l == l[first]) & (r == r[first]) & (rows == rows[first]).all(1)
            long = (l + r >= window) & again
            if long.any():
                yield from _span_rows(ids[d[long]], ties[d[long]], (q - l)[long], (q + r)[long], parts)
            keep = np.flatnonzero(~again & (l + r >= window))
            out = []
            keep = keep[np.argsort(h[keep], kind="stable")]  # alike ones side by side, which compresses well
            for to, k in _dealt((h[keep] % np.uint64(parts)).astype(np.int64)):
                k = keep[k]
                out.append((to, h[k].tobytes(), packed(rows[k].tobytes()), l[k].astype(np.uint8).tobytes(), r[k].astype(np.uint8).tobytes(), q[k].astype(np.uint32).tobytes(), ids[d[k]].tobytes(), ties[d[k]].tobytes(), False))
            yield _batch(out, AROUND)

    both = docs.select("part_", "id_", "tie_", "text_", *[c for c in docs.columns if c not in ("part_", "id_", "tie_", "text_")])
    return both.groupBy("part_").cogroup(found.groupBy("part")).applyInArrow(run, AROUND)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _span_rows(ids, ties, starts, ends, parts) -> Iterator[pa.RecordBatch]:
    """Spans as rows of AROUND that only pass on: ``hash`` has the starts, ``around`` the ends."""
    rows = [(to, starts[k].astype(np.int64).tobytes(), ends[k].astype(np.int64).tobytes(), b"", b"", b"", ids[k].tobytes(), ties[k].tobytes(), True) for to, k in _dealt(_part_of(ids, ties, parts))]
    yield _batch(rows, AROUND)


SPANS = "part int, starts binary, ends binary, ids binary, ties binary"


def repeated(around: DataFrame, window: int, parts: int) -> DataFrame:
    """Spans covered by windows that start earlier elsewhere, by part of their documents."""
    before = window - DIGIT
    size = before + window

    def run(t: pa.Table):
        for part in np.unique(t.column("part").to_numpy()).tolist():
            rows = t.filter(pc.equal(t.column("part"), part))
            starts, ends, ids, ties = [], [], [], []
            known = rows.filter(rows.column("spans"))
            if known.num_rows:
                starts += _arrays(known, "hash", np.int64)
                ends += _arrays(known, "around", np.int64)
                ids += _arrays(known, "ids", np.int64)
                ties += _arrays(known, "ties", np.int64)
            rows = rows.filter(pc.invert(rows.column("spans")))
            if rows.num_rows:
                for got, x in zip((starts, ends, ids, ties), compare(rows), strict=True):
                    got.append(x)
            if starts:
                s, e, i, j = map(np.concatenate, (starts, ends, ids, ties))
                yield _batch([(to, s[k].tobytes(), e[k].tobytes(), i[k].tobytes(), j[k].tobytes()) for to, k in _dealt(_part_of(i, j, parts))], SPANS)

    def compare(rows):
        import zstandard

        unpacked = zstandard.ZstdDecompressor().decompress
        h, at = np.concatenate(_arrays(rows, "hash", np.uint64)), np.concatenate(_arrays(rows, "at", np.uint32)).astype(np.int64)
        i, j = np.concatenate(_arrays(rows, "ids", np.int64)), np.concatenate(_arrays(rows, "ties", np.int64))
        l, r = np.concatenate(_arrays(rows, "left", np.uint8)), np.concatenate(_arrays(rows, "right", np.uint8))
        around = np.frombuffer(b"".join(map(unpacked, rows.column("around").to_pylist())), np.uint8).reshape(-1, size)
        order = np.lexsort((at, j, i, h))
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        order = order[~(new & np.concatenate((new[1:], [True])))]  # anchors that are alone after all
        h, at, i, j, l, r, around = h[order], at[order], i[order], j[order], l[order], r[order], around[order]
        n = len(h)
        least, most = np.full(n, window, np.int16), np.full(n, -1, np.int16)
        if n:
            columns = np.ascontiguousarray(around.T)
            power = Powers(1 << 10).up
            value = lambda c: (columns[c].astype(np.uint64) + np.uint64(1)) * power[c]
            low = before  # first column of the window; offset 0
            total = np.zeros(n, np.uint64)
            for c in range(low, low + window):
                total += value(c)
            for offset in range(before + 1):
                if offset:
                    low -= 1
                    total += value(low) - value(low + window)
                fits = np.flatnonzero((l >= offset) & (r >= window - offset))
                if len(fits) > 1:
                    later = _later(mix(total[fits] ^ h[fits]), fits, around[:, low : low + window])
                    least[later] = np.minimum(least[later], offset)
                    most[later] = offset
        hit = most >= 0
        return at[hit] - most[hit], at[hit] - least[hit] + window, i[hit], j[hit]

    return map_groups(around, ["part"], run, SPANS)


def _later(hashes: np.ndarray, rows: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Of ``rows`` in order, those with the same ``digits`` as one before. Rows are sorted by hash and then compared
    with their neighbours byte by byte; where equal hashes have different bytes these are the next digit."""
    by = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[by], rows[by]
    same = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    at = np.flatnonzero(same)
    equal = (digits[rows[at]] == digits[rows[at - 1]]).all(1)
    if equal.all():
        return rows[at]
    run = np.cumsum(~same)
    mixed = np.isin(run, run[at[~equal]])
    seen, later = set(), []
    for g, i in zip(run[mixed].tolist(), rows[mixed].tolist(), strict=True):
        one = (g, digits[i].tobytes())
        if one in seen:
            later.append(i)
        seen.add(one)
    return np.concatenate((rows[same & ~mixed], np.array(later, rows.dtype)))


def without_repeats(docs: DataFrame, window: int = 100, key: str = "doc_id", text: str = "text", whole_chars: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` (removed runs, as pairs of start and end) and ``kept`` (bytes).
    With ``whole_chars`` a code point is removed only if all its bytes are covered, so ``kept`` is UTF-8."""
    if window < DIGIT + 1 or window > 255:
        raise ValueError(f"a window has {DIGIT + 1} to 255 bytes")
    docs = cleared(docs, "n_bytes", "n_removed", "spans", "kept", "id_", "tie_", "text_", "part_")
    names = docs.columns
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(64, -(-total // PART))
    marked = docs.withColumn("id_", F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID))).withColumn("tie_", F.xxhash64(text)).withColumn("text_", F.coalesce(F.col(text), F.lit("")))

    def deal(batches):
        for b in batches:
            part = _part_of(b.column("id_").to_numpy(), b.column("tie_").to_numpy(), parts) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], [*b.schema.names, "part_"])

    keys = [c for c in names if c != text]
    by_part = marked.select(*keys, "id_", "tie_", "text_")
    by_part = by_part.mapInArrow(deal, T.StructType([*by_part.schema.fields, T.StructField("part_", T.IntegerType())]))
    found = answer(ask(marked, window, parts), parts)
    spans = repeated(surroundings(by_part, found, window, parts), window, parts)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*[docs.schema[c] for c in names], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", kind), T.StructField("kept", T.BinaryType())])

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        order = np.lexsort((left.column("tie_").to_numpy(), left.column("id_").to_numpy()))
        left = left.take(pa.array(order)) if left.num_rows else left
        ids, ties = left.column("id_").to_numpy(), left.column("tie_").to_numpy()
        texts = _texts(left.column("text_"))
        of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if right.num_rows:
            s, e = (np.concatenate(_arrays(right, c, np.int64)) for c in ("starts", "ends"))
            i, j = (np.concatenate(_arrays(right, c, np.int64)) for c in ("ids", "ties"))
            by = np.lexsort((s, j, i))
            s, e, i, j = s[by], e[by], i[by], j[by]
            cuts = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            of = {(int(i[a]), int(j[a])): (s[a:b], e[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)], strict=True)}
        removed, lists, kept = [], [], []
        for n, (x, i, j) in enumerate(zip(texts, ids.tolist(), ties.tolist(), strict=True)):
            if n and (i, j) == (int(ids[n - 1]), int(ties[n - 1])) and len(x) >= window:
                runs = [(0, len(x))]
            elif (i, j) in of:
                runs = _merged(*of[i, j])
                if whole_chars:
                    runs = _on_chars(x, runs)
            else:
                runs = []
            removed.append(sum(b - a for a, b in runs))
            lists.append([{"start": a, "end": b} for a, b in runs])
            bounds = [0, *(v for run in runs for v in run), len(x)]
            kept.append(b"".join(x[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
        columns = [left.column("text_") if c == text else left.column(c) for c in names]
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns += [pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, kinds), pa.array(kept, pa.binary())]
        return pa.table(dict(zip([f.name for f in out.fields], columns, strict=True)))

    both = by_part.select("part_", "id_", "tie_", "text_", *[c for c in by_part.columns if c not in ("part_", "id_", "tie_", "text_")])
    return both.groupBy("part_").cogroup(spans.groupBy("part")).applyInArrow(cut_out, out)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans sorted by start."""
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), reach[np.append(first[1:], len(starts)) - 1].tolist(), strict=True))


def _on_chars(x: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs shrunk to whole code points."""
    inner = lambda p: p < len(x) and x[p] & 0xC0 == 0x80
    out = []
    for a, b in runs:
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL4 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(generate_series(0, length(h) // 2 - 100), lambda s: {'s': s, 'w': md5_number(substr(h, 2 * s + 1, 200))})) AS x FROM d WHERE length(h) >= 200),
ranked AS (SELECT doc_id, x.s AS s, row_number() OVER (PARTITION BY x.w ORDER BY doc_id, x.s) AS k FROM starts),
again AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM ranked WHERE k > 1),
runs AS (SELECT doc_id, s, sum((before IS NULL OR s > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM again),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, run),
marks AS (SELECT doc_id, b AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS to_ FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT m.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (coalesce(to_, length(h) // 2) - from_)), '' ORDER BY from_) AS h FROM marks m JOIN d USING (doc_id) GROUP BY m.doc_id),
counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE_SQL = {"op4_suffix_dedup": SQL4}
