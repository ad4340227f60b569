"""URL filters: a sort-merge range join of page urls with host and path rules.

A host is turned into a key of its labels in reverse (``www.example.org`` to ``org.example.www.``),
so that a rule's host and all its subdomains are one interval of keys; below a rule's host the paths
that start with the rule's path are one interval too. Pages and interval bounds are sorted together
and swept once; a stack of the rules that are active at each bound, nested in each other, says which
decide up to the next bound. Hosts are swept first, which gives a page's hosts with rules, nested in each other; then
paths, once for each depth of that nest. So a rule is held once, however many hosts with rules are below its own.

The sweep runs in salted groups: each holds an even share of the pages, whatever host they are of,
and all bounds, so neither a hot host nor a hot url makes a task larger. A group holds at least as
many pages as bounds, so the copies of the bounds stay below the pages. All sweeps use the same shuffle.

Cases: a null url, or one without ``://``, has an empty host and path and gets the default verdict.
An empty table gives an empty result. Rows repeat as they are given. Of rules with one host and one
path, the last given holds. A longer rule (host and path together) wins, then the one with the longer host.
Columns of the input named ``host``, ``path``, ``rule`` or ``verdict`` are replaced; others stay.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cleared, salts, table


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: Rules are configuration: they are swept on the driver and sent to each group of pages.
MAX_RULES = 100_000
PAGES_A_GROUP = 2_048

RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    after = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^?#]*", 0)).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _after(prefix: str) -> str:
    """The least string above all that start with ``prefix``."""
    while prefix and prefix[-1] == "\U0010ffff":
        prefix = prefix[:-1]
    last = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if last == 0xD800 else last)


def _sweep(intervals: list[tuple[str, str, object]], state) -> list[tuple[str, object]]:
    """(bound, what is active from there on): a sorted sweep with a stack of nested intervals, of which ``state`` makes a value."""
    events = sorted([(lo, 1, hi, x) for lo, hi, x in intervals] + [(hi, 0, lo, x) for lo, hi, x in intervals], key=lambda e: (e[0], e[1], e[2]) if not e[1] else (e[0], 1, _Reverse(e[2])))
    stack: list[tuple[str, object]] = []
    out: list[tuple[str, object]] = []
    for at, opens, other, x in events:
        if opens:
            stack.append((other, x))
        else:
            while stack and stack[-1][0] <= at:
                stack.pop()
        now = state([x for _, x in stack]) if stack else None
        if out and out[-1][0] == at:
            out[-1] = (at, now)
        else:
            out.append((at, now))
    return out


class _Reverse(str):
    """Longer intervals open first."""

    def __lt__(self, other):
        return str.__gt__(self, other)


def segments(rules: Sequence[Rule]) -> list[dict]:
    """Bounds in order. Of sweep 0: the stack of hosts with rules that are active from there on, deepest first. Of sweep
    1: the rule, by its own host alone, whose path decides from there on. Each rule is in one host's interval only,
    however many hosts are below it."""
    held = {(r.host, r.path): r for r in rules}
    if len(held) > MAX_RULES:
        raise ValueError(f"{len(held)} rules; at most {MAX_RULES} can be held")
    hosts = sorted({_key(h) for h, _ in held})
    out = [{"s": 0, "b": at, "hosts": active or []} for at, active in _sweep([(k, k[:-1] + "/", k) for k in hosts], lambda s: s[::-1])]
    starts = [(f"{_key(r.host)}\0{r.path}", r) for r in held.values()]
    for at, r in _sweep([(x, _after(x), r) for x, r in starts], lambda s: s[-1]):
        out.append({"s": 1, "b": at} | ({} if r is None else {"rule": {"n": len(r.host) + len(r.path), "h": len(r.host), "v": r.host + r.path, "d": r.verdict}}))
    return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Each page with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``."""
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = cleared(pages, "host", "path", "rule", "verdict").select(F.struct(*keep).alias("row_"), host_of(F.col(url)).alias("host_"), path_of(F.col(url)).alias("path_"))
    bounds = segments(rules)
    if not bounds:
        return rows.select("row_.*", F.col("host_").alias("host"), F.col("path_").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    depth = max(len(m.get("hosts", ())) for m in bounds)
    n = salts(pages.count(), max(PAGES_A_GROUP, 4 * len(bounds)))
    marks = (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(json.dumps(bounds)), "array<struct<s:int,b:string,hosts:array<string>,rule:struct<n:int,h:int,v:string,d:string>>>")).alias("m"))
        .select("m.*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt_"))
        .select("salt_", F.col("s").alias("kind_"), F.col("b").alias("bound_"), F.col("hosts").alias("mark_hosts_"), F.struct("rule").alias("mark_rule_"))
    )
    salt = F.pmod(F.xxhash64("row_"), F.lit(n)).cast("int")
    both = rows.withColumn("salt_", salt).withColumn("kind_", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    page = F.col("kind_") == 2

    def last(mark: str, kind: int, order: str) -> Column:
        upto = Window.partitionBy("salt_").orderBy(order, "kind_").rowsBetween(Window.unboundedPreceding, 0)
        return F.last(F.when(F.col("kind_") == kind, F.col(mark)), ignorenulls=True).over(upto)

    swept = both.withColumn("key_", F.when(page, host_key(F.col("host_"))).when(F.col("kind_") == 0, F.col("bound_")))
    swept = swept.withColumn("at_", last("mark_hosts_", 0, "key_"))
    hits = []
    for level in range(depth):  # the deepest host with rules, then those above it
        name = f"key{level}_"
        swept = swept.withColumn(name, F.when(page, F.concat(F.get("at_", F.lit(level)), F.lit("\0"), "path_")).when(F.col("kind_") == 1, F.col("bound_")))
        swept = swept.withColumn(f"hit{level}_", last("mark_rule_", 1, name))
        hits.append(F.when(F.col(name).isNotNull(), F.col(f"hit{level}_.rule")))
    best = F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull()))  # longest rule, then longest host
    judged = swept.where(page).withColumn("best_", best)
    return judged.select("row_.*", F.col("host_").alias("host"), F.col("path_").alias("path"), F.col("best_.v").alias("rule"), F.coalesce("best_.d", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


SQL7 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

QUERIES = {"op7_url_filters": op7_url_filters}
ORACLE_SQL = {"op7_url_filters": SQL7}
