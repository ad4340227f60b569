"""Pages to chunks: running lines, cleaning, headings, hierarchical chunks, stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ChunkingError
from ..functions import text as T

# Headings of chapters and sections.
CHAPTER = r"(?i)^\s*Chapter\s+\d+[:.\s]"
SECTION_LINE = r"^\s*\d+(\.\d+)*\s+[A-Z][A-Za-z\s]{3,80}$"


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def usable_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """Pages of at least so many characters, stripped; page numbers stay those of the source."""
    return pages.withColumn("text", _strip(F.col("text"))).where(F.char_length("text") >= least)


def running_lines(pages: DataFrame, share: float = 0.4) -> DataFrame:
    """(source_file, line): first or last lines of at least ``max(2, int(share * pages))`` pages, for documents of 3 pages or more."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), _strip), lambda x: x != "")
    ends = pages.select("source_file", "page_number", lines.alias("lines")).where(F.size("lines") > 0)
    ends = ends.select("source_file", F.explode(F.array_distinct(F.array(F.element_at("lines", 1), F.element_at("lines", -1)))).alias("line"))
    counts = ends.groupBy("source_file", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("source_file").agg(F.count("*").alias("n_pages"))
    rows = counts.join(total, "source_file")
    return rows.where((F.col("n_pages") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * share)))).select("source_file", "line", "n")


def clean_pages(pages: DataFrame, share: float = 0.4) -> DataFrame:
    """Pages with ``cleaned``. A document's running lines are few (their number is at most twice the reciprocal of ``share``, or one for each two pages of a small one)."""
    running = running_lines(pages, share).groupBy("source_file").agg(F.collect_set("line").alias("running"))
    joined = pages.join(running, "source_file", "left").withColumn("running", F.coalesce("running", F.array().cast("array<string>")))
    return joined.withColumn("cleaned", T.clean(F.col("text"), F.col("running"))).drop("running")


def headings(pages: DataFrame) -> DataFrame:
    """Lines that look like headings: ``source_file``, ``page_number``, ``ordinal``, ``heading``, ``level``."""
    rows = pages.select("source_file", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    found = rows.where(F.col("line").rlike(CHAPTER) | F.col("line").rlike(SECTION_LINE))
    return found.select("source_file", "page_number", "ordinal", _strip(F.col("line")).alias("heading"), F.when(F.col("line").rlike(CHAPTER), "chapter").otherwise("section").alias("level"))


def font_headings(lines: DataFrame, times: float = 1.25) -> DataFrame:
    """Headings by size of type: ``lines`` (source_file, page_number, ordinal, spans of size and text) to ``source_file``, ``page_number``, ``ordinal``, ``heading``, ``level``,
    ``size``. A line is one if the mean size of its spans is above ``times`` the upper median of all spans of its page, or if it looks like one. The median
    comes from counts by size, so a page of any length is a few rows; blank lines have no heading, but their spans count."""
    page = ["source_file", "page_number"]
    sizes = lines.select(*page, F.explode("spans.size").alias("size")).groupBy(*page, "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*page).orderBy("size"))
    places = sizes.withColumn("upto", upto).withColumn("middle", F.floor(F.sum("n").over(Window.partitionBy(*page)) / 2) + 1)
    median = places.where("upto >= middle").groupBy(*page).agg(F.min("size").alias("median"))
    text = F.array_join("spans.text", "")
    mean = F.aggregate("spans.size", F.lit(0.0), lambda a, x: a + x) / F.size("spans")
    rows = lines.where(F.size("spans") > 0).select(*page, "ordinal", _strip(text).alias("heading"), mean.alias("size")).where(F.col("heading") != "").join(median, page)
    chapter = F.col("heading").rlike(CHAPTER)
    found = rows.where((F.col("size") > times * F.col("median")) | chapter | F.col("heading").rlike(SECTION_LINE))
    return found.select(*page, "ordinal", "heading", F.when(chapter, "chapter").otherwise("section").alias("level"), "size")


def heading_of_page(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """As-of join: each page's ``heading`` is the first one of the last page with headings up to it."""
    first = heads.groupBy("source_file", "page_number").agg(F.min_by("heading", "ordinal").alias("own"))
    w = Window.partitionBy("source_file").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    both = pages.select("source_file", "page_number").join(first, ["source_file", "page_number"], "left")
    return both.select("source_file", "page_number", F.last("own", ignorenulls=True).over(w).alias("heading"))


def check_sizes(parent: int, child: int, overlap: int) -> None:
    if parent <= 0 or child <= 0 or overlap < 0:
        raise ChunkingError("chunk sizes are positive")
    if overlap >= child:
        raise ChunkingError("the overlap is smaller than a child chunk")


def chunk_pages(pages: DataFrame, text: str = "cleaned", parent: int = 3500, child: int = 300, overlap: int = 35) -> DataFrame:
    """Parents and their children: ``chunk_id`` (a hash of where it is), ``level``, ``parent_id``, ``parent_ord``, ``child_ord``, ``text``, ``tokens``, and the page's columns."""
    check_sizes(parent, child, overlap)
    keep = [c for c in pages.columns if c not in (text, "text")]
    parents = pages.select(*keep, F.posexplode(T.pack_sentences(T.chunk_sentences(F.col(text)), parent)).alias("parent_ord", "text"))
    ident = lambda *more: F.sha2(F.concat_ws("/", F.col("source_file"), F.col("page_number").cast("string"), *more), 256)
    parents = parents.withColumn("parent_key", ident(F.lit("parent"), F.col("parent_ord").cast("string")))
    children = parents.select(*keep, "parent_ord", "parent_key", F.posexplode(T.split_children(T.chunk_sentences(F.col("text")), child, overlap)).alias("child_ord", "text"))
    up = parents.select(*keep, F.col("parent_key").alias("chunk_id"), F.lit("parent").alias("level"), F.lit(None).cast("string").alias("parent_id"), "parent_ord", F.lit(None).cast("int").alias("child_ord"), "text")
    down = children.select(*keep, ident(F.lit("child"), F.col("parent_ord").cast("string"), F.col("child_ord").cast("string")).alias("chunk_id"), F.lit("child").alias("level"), F.col("parent_key").alias("parent_id"), "parent_ord", "child_ord", "text")
    return up.unionByName(down).withColumn("tokens", T.token_estimate(F.col("text")))


def stitch(chunks: DataFrame, group: str, index: str, key: str, text: str) -> DataFrame:
    """Runs of consecutive ``index`` in a group become one row: ``first``, ``n``, ``ids`` (joined by +), ``text`` (joined by newlines). A null index stays alone."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(index), key)
    new = F.col(index).isNull() | F.lag(index).over(w).isNull() | (F.col(index) != F.lag(index).over(w) + 1)
    runs = chunks.withColumn("new_", new.cast("int")).withColumn("run_", F.sum("new_").over(w))
    got = runs.groupBy(group, "run_").agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(key).alias("k"), F.col(text).alias("t")))).alias("xs"))
    return got.select(group, F.element_at("xs", 1)["i"].alias("first"), F.size("xs").alias("n"), F.array_join(F.transform("xs", lambda x: x["k"].cast("string")), "+").alias("ids"), F.array_join(F.transform("xs", lambda x: x["t"]), "\n").alias("text"))
