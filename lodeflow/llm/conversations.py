"""Repair of conversations' structure by cheapest edits: Dial's bucket queue over a layered graph.

A conversation is a walk: a node is a place between its rows and what its roles so far allow next (nothing yet, after the system's
row, after a user's, after an assistant's). Arcs are edits with small integer costs, so distances to the end
are found with one bucket for each distance (:func:`distances`), and the audit by walking, from the start, the tight arc with the least
letter (:func:`walk`). A letter has one arc at each node, so the walk never branches. Rows that must be deleted are no layers: their letter comes
before any insertion at their place, since it is the lesser one.

On Spark: equal rows are counted together, then rows are range-partitioned by conversation, turn, role and start of text, so that a conversation of any length
is spread over tasks, as segments of :data:`SEGMENT` rows. A segment's sixteen distances between its ends are found where it lies.
Two narrow passes over segments, a row of some hundred bytes each, carry distances from the last segment to the first
and states from the first to the last; then each segment walks by itself. Only the digest of a conversation, which is defined
over its whole text in order, passes one task, in a stream that holds a segment at a time.

Cases: null roles and texts are one space, null turns come first, and a null ``conv_id`` is a conversation. Rows of one turn are taken by
role, then text. A role counts by its first character only; an empty role fits nowhere. Repeated rows are duplicates. A very
long text is held by one task at a time. Conversations of which no row is left have zeros, an empty audit and no
repaired rows. An empty table gives an empty one. Columns other than the four aren't carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, process_state, table

#: Rows and bytes of text of a segment; patterns whose distances a worker process keeps.
SEGMENT, SEGMENT_BYTES, KNOWN = 512, 4 << 20, 50_000
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
WHITE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: What roles so far allow: nothing yet, the system's row, a user's, an assistant's; what it costs to end there, by insertions.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, 2 * INSERT, INSERT, 0)
#: The state after a row whose role is kept, by state and initial; the state after one that may be set or inserted, and its role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40


def distances(rows: str, ends: tuple[int, ...]) -> list[list[int]]:
    """The least cost from each node to the end, where ending in a state costs ``ends``. ``rows`` has a letter for each row that
    may stay: its role's initial, or ``x``, in capitals if it is truncated."""
    n = len(rows)
    known = [[FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max(e for e in ends if e < FAR) + (DELETE + INSERT) * (n + 2))]
    into = [[] for _ in range(4)]  # states from which an insertion or a set role leads to a state
    for q, to in enumerate(NEXT):
        into[to].append(q)

    def reach(i: int, q: int, d: int) -> None:
        if d < known[i][q]:
            known[i][q] = d
            buckets[d].append((i, q))

    for q, d in enumerate(ends):
        if d < FAR:
            reach(n, q, d)
    for d, bucket in enumerate(buckets):
        for i, q in bucket:  # may grow: a row kept costs nothing
            if known[i][q] < d:
                continue
            if i < n:
                for p in into[q]:
                    reach(i, p, d + INSERT)
            if i:
                row = rows[i - 1]
                late = UNFINISHED if row.isupper() else 0
                reach(i - 1, q, d + DELETE)
                for p in range(4):
                    if KEPT.get((p, row.lower())) == q:
                        reach(i - 1, p, d + KEEP + late)
                for p in into[q]:
                    reach(i - 1, p, d + REROLE + late)
    return known


def walk(rows: str, known: list[list[int]], q: int) -> tuple[str, int]:
    """The letters of the cheapest edits from a state at the first row on, and the state after the last."""
    letters, i = [], 0
    while i < len(rows):
        d, row = known[i][q], rows[i]
        late = UNFINISHED if row.isupper() else 0
        kept = KEPT.get((q, row.lower()))
        if d == DELETE + known[i + 1][q]:
            letters.append("D")
            i += 1
        elif d == INSERT + known[i][NEXT[q]]:
            letters.append("I")
            q = NEXT[q]
        elif kept is not None and d == KEEP + late + known[i + 1][kept]:
            letters.append("K")
            i, q = i + 1, kept
        else:
            letters.append("R")
            i, q = i + 1, NEXT[q]
    return "".join(letters), q


def _walks(rows: str, ends: tuple[int, ...]) -> tuple[list[int], list[tuple[str, int]]]:
    """Distances at the first row, and the walk from each state there; conversations of one pattern share them."""
    kept = process_state("conversation_walks", dict)
    key = (rows, ends)
    if key not in kept:
        if len(kept) >= KNOWN:
            kept.clear()
        known = distances(rows, ends)
        kept[key] = (known[0], [walk(rows, known, q) if known[0][q] < FAR else ("", q) for q in range(4)])
    return kept[key]


def matrix(rows: str) -> list[int]:
    """The least cost of getting from each state at the first row to each state after the last."""
    columns = [_walks(rows, tuple(0 if q == end else FAR for q in range(4)))[0] for end in range(4)]
    return [columns[end][q] for q in range(4) for end in range(4)]


def edited(letters: str, q: int, forced: list[int], roles: list[str], texts: list[str]) -> Iterator[tuple[str, str | None, str]]:
    """(letter, role, text) of each edit of a segment; ``forced`` are the deletions before each row that may stay, and after the last."""
    i, arrived = 0, -1
    for letter in letters:
        if arrived < i:
            yield from (("D", None, "") for _ in range(forced[i]))
            arrived = i
        if letter == "D":
            yield "D", None, ""
        elif letter == "K":
            q = KEPT[q, roles[i][:1]]
            yield "K", roles[i], texts[i]
        else:
            q = NEXT[q]
            yield letter, ROLE[q], "" if letter == "I" else texts[i]
        i += letter != "I"
    if arrived < i:
        yield from (("D", None, "") for _ in range(forced[i]))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with known faults, chosen by a checksum of where they stand: dropped, emptied, without ends of sentences, repeated, of the user's role."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind_")).where("kind_ <> 0")
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind_") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time_")).drop("time_")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with how often they stand (``copies``) and their first one's ``fault``: b, d, t or an empty string."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("digest_", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    again = rows.groupBy("conv_id", "digest_").agg(F.min(F.struct("turn")).alias("first_"), F.count("*").alias("times_")).where("times_ > 1")
    again = again.select(F.col("conv_id").alias("other_"), F.col("digest_").alias("same_"), F.col("first_.turn").alias("first_"), "times_")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("other_")) & (F.col("digest_") == F.col("same_")), "left")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    seen = F.col("times_").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_"))
    fault = F.when(bare == "", "b").when(seen, "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_FACTS = "part int, seg long, min_turn long, max_turn long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, pattern string, deletes long, matrix array<long>"
_BODY = "forced array<long>, roles array<string>, texts array<string>"


def _segments(rows: DataFrame) -> DataFrame:
    key = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string(f"{_FACTS}, {_BODY}").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def segment(conv_id, part: int, seg: int, held: list[tuple]) -> pa.RecordBatch:
        turns = [t for t, *_ in held if t is not None]
        pattern, forced, roles, texts, illegal, before, count = [], [0], [], [], 0, None, {"b": 0, "d": 0, "t": 0}
        for _, role, text, copies, fault in held:
            initial = role[:1]
            if before is not None:
                illegal += before + initial not in ("su", "ua", "au")
            before, illegal = initial, illegal + copies - 1
            if fault:
                count[fault] += 1
            count["b" if fault == "b" else "d"] += copies - 1
            if fault in ("b", "d"):
                forced[-1] += copies
                continue
            letter = initial if initial in ("s", "u", "a") else "x"
            pattern.append(letter.upper() if fault == "t" else letter)
            roles.append(role)
            texts.append(text)
            forced.append(copies - 1)
        pattern = "".join(pattern)
        row = (conv_id, part, seg, min(turns, default=None), max(turns, default=None), len(set(turns)), held[0][1][:1], before, illegal, count["b"], count["d"], count["t"], pattern, sum(forced), matrix(pattern), forced, roles, texts)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, arrow.types, strict=True)], arrow.names)

    def run(batches):
        part, seg, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for b in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (conv_id != now or len(held) >= SEGMENT or size + len(row[2]) > SEGMENT_BYTES):
                    yield segment(now, part, seg, held)
                    seg, held, size = seg + 1, [], 0
                now, size = conv_id, size + len(row[2])
                held.append(row)
        if held:
            yield segment(now, part, seg, held)

    spread = rows.withColumn("start_", F.left("text", F.lit(64))).repartitionByRange("conv_id", "turn", "role", "start_").drop("start_")
    return spread.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def _in_order(segments: DataFrame, fn, schema: T.StructType, back: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """``fn`` over each task's segments, those of a conversation in their order or in the opposite one."""
    order = [F.col("conv_id"), *[F.desc(c) if back else F.asc(c) for c in ("part", "seg")]]
    return segments.select("conv_id", "part", "seg", *columns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(fn, schema)


def _planned(segments: DataFrame) -> DataFrame:
    """``segments`` with the letters of their edits, and the states in which they begin and which follow."""
    key = T.StructField("conv_id", segments.schema["conv_id"].dataType)
    fields = lambda text: T.StructType([key, *T._parse_datatype_string(text).fields])
    columns = lambda b: zip(*(c.to_pylist() for c in b.columns), strict=True)

    def backward(batches):
        now, known = None, None
        for b in batches:
            after, last = [], []
            for conv_id, _, _, _, m in columns(b):
                last.append(known is None or conv_id != now)
                now, known = conv_id, ENDS if last[-1] else known
                least = min(known)  # costs so far don't matter to what follows, only their differences
                after.append([d - least for d in known])
                known = tuple(min(m[4 * q + end] + known[end] for end in range(4)) for q in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(after, pa.list_(pa.int64())), pa.array(last)], ["conv_id", "part", "seg", "pattern", "after", "closes"])

    def forward(batches):
        now, q, begun = None, START, False
        for b in batches:
            out = []
            for conv_id, _, _, pattern, after, closes in columns(b):
                q = START if not begun or conv_id != now else q
                now, begun = conv_id, not closes
                letters, end = _walks(pattern, tuple(after))[1][q]
                out.append((letters, q, "I" * (ENDS[end] // INSERT) if closes else "", end))
                q = end
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True))], ["part", "seg", "letters", "state", "closing", "end_state"])

    known = _in_order(segments, backward, fields("part int, seg long, pattern string, after array<long>, closes boolean"), True, ("pattern", "matrix"))
    plan = _in_order(known, forward, T._parse_datatype_string("part int, seg long, letters string, state int, closing string, end_state int"), False, ("pattern", "after", "closes"))
    return segments.join(plan, ["part", "seg"])


def _edits(r: dict) -> Iterator[tuple[str, str | None, str]]:
    yield from edited(r["letters"], r["state"], r["forced"], r["roles"], r["texts"])
    q = r["end_state"]
    for letter in r["closing"]:
        q = NEXT[q]
        yield letter, ROLE[q], ""


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, part, seg, place, edit, role, text``: the repaired conversations, in order of part, segment and place; deleted rows with edit ``D``, role and text null."""
    planned = _planned(cut(_segments(judged(rows))))
    schema = T.StructType([T.StructField("conv_id", planned.schema["conv_id"].dataType), *T._parse_datatype_string("part int, seg long, place int, edit string, role string, text string").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                out = [(r["conv_id"], r["part"], r["seg"], place, letter, role, text if role is not None else None) for place, (letter, role, text) in enumerate(_edits(r))]
                for at in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 4096], strict=True), arrow.types, strict=True)], arrow.names)

    return planned.mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """A row for each conversation in ``rows``: its faults, the cheapest edits, and the digest of what is left."""
    planned = _planned(cut(_segments(judged(rows))))
    key = planned.schema["conv_id"]
    schema = T.StructType([key, *T._parse_datatype_string(RESULT).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        now, facts = None, None

        def ended() -> pa.RecordBatch:
            low, high, turns, _, _, counts, audit, digest, _ = facts
            row = (now, high - low + 1 - turns if turns else 0, *counts, "".join(audit), digest.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, arrow.types, strict=True)], arrow.names)

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if facts is None or r["conv_id"] != now:
                    if facts is not None:
                        yield ended()
                    now, facts = r["conv_id"], [None, None, 0, None, None, [0] * 5, [], hashlib.sha256(), False]
                low, high, turns, before, last, counts, audit, digest, any_row = facts
                if r["turns"]:
                    turns += r["turns"] - (high == r["min_turn"])
                    low, high = r["min_turn"] if low is None else low, r["max_turn"]
                for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    counts[k] += r[name]
                counts[3] += last is not None and last + r["first"] not in ("su", "ua", "au")
                at = 0
                for letter, role, text in _edits(r):
                    audit.append(letter)
                    counts[4] += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter]
                    if role is not None:
                        digest.update((("\n" if any_row else "") + role + ":" + text).encode())
                        any_row = True
                letters = r["letters"]
                for letter in letters:
                    if letter != "I":
                        counts[4] += UNFINISHED * (letter != "D" and r["pattern"][at].isupper())
                        at += 1
                audit[:] = ["".join(audit)]
                facts = [low, high, turns, before, r["last"], counts, audit, digest, any_row]
        if facts is not None:
            yield ended()

    order = [F.col("conv_id"), F.col("part"), F.col("seg")]
    return planned.drop("matrix").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def repair(original: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`report` of ``rows`` for every conversation in ``original``, also those that have no row left."""
    ids = original.select("conv_id").distinct()
    found = report(rows).withColumnRenamed("conv_id", "other_")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("other_")), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(rows, damage(rows))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}


def _step(state: str, cost: int, letter: str, role: str | None = None, text: str = "''") -> str:
    line = f" || chr(10) || {role} || ':' || {text}" if role else ""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o{line}}} END"


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN left(role, 1) = '{initial}' AND {state} IS NOT NULL THEN {{'c': {state}.c + late, 'a': {state}.a || 'K', 'o': {state}.o || chr(10) || role || ':' || text}} END"


def _reroled(state: str, role: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2 + late, 'a': {state}.a || 'R', 'o': {state}.o || chr(10) || '{role}' || ':' || text}} END"


#: All edits row by row, forward, keeping for each state the cheapest way and of those the least audit.
_SPACE = "[\\x20\\x09-\\x0D]"
_KIND = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda e, k: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384::BIGINT) ELSE e >> 1 END)), 4294967295::BIGINT) % 20"
ORACLE_SQL = {
    "op13_conversation_repair": f"""
WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} AS kind FROM conversations),
d1 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again FROM d0 WHERE kind <> 0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d1),
d3 AS (SELECT *, regexp_replace(text, '{_SPACE}+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM d2),
d AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM d3),
r AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'o': ''}} AS z, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS s, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS u, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {_step('z', 3, 'D')},
    CASE WHEN fault IN ('b', 'd') THEN {_step('s', 3, 'D')} ELSE {_least(_step('s', 3, 'D'), _kept('z', 's'))} END,
    CASE WHEN fault IN ('b', 'd') THEN {_step('u', 3, 'D')} ELSE {_least(_step('iu', 3, 'D'), *(_kept(x, 'u') for x in ('z', 's', 'ia')), *(_reroled(x, 'user') for x in ('z', 's', 'ia')))} END,
    CASE WHEN fault IN ('b', 'd') THEN {_step('a', 3, 'D')} ELSE {_least(_step('ia', 3, 'D'), _kept('iu', 'a'), _reroled('iu', 'assistant'))} END
  FROM (SELECT *, {_least('a', _step('iu', 2, 'I', "'assistant'"))} AS ia FROM (
    SELECT r.conv_id, d.n, d.role, d.text, d.fault, CAST(d.fault = 't' AS INT) AS late, z, s, u, a, {_least('u', *(_step(x, 2, 'I', "'user'") for x in ('z', 's', 'a')))} AS iu
    FROM r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.n = r.n + 1))
),
last AS (SELECT conv_id, z, u, a, s, {_least('u', _step('s', 2, 'I', "'user'"))} AS iu FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
best AS (SELECT conv_id, {_least('z', 'a', _step('iu', 2, 'I', "'assistant'"))} AS b FROM last),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c::BIGINT AS cost, b.a AS audit, sha256(substr(b.o, 2)) AS repaired_sha256
FROM best LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id"""
}
