"""Readers: corpus files and manifests into frames."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.session import cut

BLANK = r"(?U)^\s*$"


def lines_of(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, line_no, line): physical lines from 1; CR LF and CR end a line like LF does.  A null text has no lines."""
    plain = F.regexp_replace(F.col(text), "\r\n|\r", "\n")
    return documents.select(key, *keep, F.posexplode(F.split(plain, "\n", -1)).alias("_at", "line")).select(key, *keep, (F.col("_at") + 1).alias("line_no"), "line")


def segment_id(document: Column, line_no: Column) -> Column:
    """document:l and the line number in eight digits."""
    return F.format_string("%s:l%08d", document.cast("string"), line_no)


def segments(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(segment_id, key, *keep, line_no, text) of every line that isn't blank."""
    rows = lines_of(documents, key=key, text=text, keep=keep).where(~F.col("line").rlike(BLANK))
    return rows.select(segment_id(F.col(key), F.col("line_no")).alias("segment_id"), key, *keep, "line_no", F.col("line").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest; every value is a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def load_segments(manifest: DataFrame, texts: DataFrame, *, splits: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Segments of the manifest's documents, the split filter first; a limit takes the first by (document order, line)."""
    rows = manifest if splits is None else manifest.where(F.col("split").isin(*splits))
    found = segments(rows.join(texts, "canonical_path"), key="document_id", keep=("split", "source", "layer"))
    return found if limit is None else found.orderBy("document_id", "line_no").limit(limit)


def resolved_source(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Adds the path and script that a document is read from: its canonical path, else its own path, else its source path, the first that is present."""
    names = ("canonical_path", "path", "source_path")
    rows = manifest
    for name in names:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
        seen = present.select(F.col("path").alias(name), F.lit(True).alias(f"_{name}"))
        rows = rows.join(seen, name, "left")
    pick = F.coalesce(*(F.when(F.col(f"_{n}"), F.col(n)) for n in names))
    script = F.when(F.col("_canonical_path"), F.col("canonical_script")).when(F.coalesce("_path", "_source_path"), F.coalesce("canonical_script", F.lit("devanagari")))
    return rows.withColumn("resolved_path", pick).withColumn("resolved_script", script).drop(*(f"_{n}" for n in names))


def parse_whitelist(lines: DataFrame) -> DataFrame:
    """(relative_path, problem) of a list whose lines with a leading # are comments: a path must be relative, have no .., end in .htm in any case, and occur once with either slash.

    A list without any path has one row, without a path.
    """
    path = F.regexp_replace(F.translate(F.trim("value"), "\\", "/"), r"(?<=/)\./|^\./|/(?=/)", "")
    rows = lines.select(path.alias("relative_path")).where("relative_path <> '' and relative_path not like '#%'")
    counted = rows.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("relative_path")
    problem = (
        F.when(p.startswith("/"), "absolute").when(p.rlike(r"^[A-Za-z]:"), "drive")
        .when(p.rlike(r"(^|/)\.\.(/|$)"), "parent").when(~p.rlike(r"(?i)[^/]\.htm$"), "suffix").when(F.col("n") > 1, "duplicate")
    )
    none = counted.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("relative_path"), F.lit("empty").alias("problem"))
    return counted.select("relative_path", problem.alias("problem")).unionByName(none)


def missing_sources(whitelist: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths without a file."""
    return whitelist.select("relative_path").join(files.select("relative_path"), "relative_path", "left_anti")


class _Body(HTMLParser):
    """Text of a page; a rule is kept as a mark."""

    DROPPED = frozenset(("head", "style", "script", "nav"))
    BLOCKS = frozenset(("p", "div", "br", "tr", "li", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dl", "dt", "dd", "center"))
    RULE = "\x00"

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.hidden += 1
        elif tag == "hr":
            self.parts.append(self.RULE)
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in self.DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_body(page: str) -> str:
    """Text after the page's second rule; after its only one; all of it without a rule."""
    parser = _Body()
    parser.feed(page)
    parser.close()
    pieces = "".join(parser.parts).split(_Body.RULE)
    return _Body.RULE.join(pieces[min(2, len(pieces) - 1) :]).replace(_Body.RULE, "\n")


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """html_body of each page; null stays null."""
    return pages.map(lambda x: None if x is None or x != x else html_body(x))


def representation_documents(manifest: DataFrame, *, script: str, condition: str, names: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Documents of one script and condition by path, or in the order of `names` (relative_path, ordinal); all must be of one freeze.

    Raises if there is more than one freeze id, or if a name is missing or twice.
    """
    rows = manifest.where((F.col("script") == script) & (F.col("condition") == condition))
    if rows.select("freeze_id").distinct().limit(2).count() > 1:
        raise ValueError("more than one freeze id")
    if rows.groupBy("relative_path").count().where("count > 1").limit(1).count():
        raise ValueError("a document is listed twice")
    if names is not None:
        if names.join(rows, "relative_path", "left_anti").limit(1).count():
            raise ValueError("a listed document is missing")
        rows = rows.join(names, "relative_path").orderBy("ordinal")
    else:
        rows = rows.orderBy("relative_path")
    return rows if limit is None else rows.limit(limit)


def read_rules(spark: SparkSession, path: str, *, active_only: bool = True) -> DataFrame:
    """Boundary rules from a TSV with a header: rule_id, left, right, surface, variant, status."""
    schema = "rule_id string, left string, right string, surface string, variant int, status string"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)
    return rows.where(F.col("status") == "active") if active_only else rows


def read_usage(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A (gzip) TSV of form_key, an item and its expected mass."""
    return spark.read.csv(path, sep="\t", header=True, schema=f"form_key string, {value} string, expected_mass double", enforceSchema=False, quote="")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(rank, piece, score) of a vocabulary file; the rank is the line's number from 0."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\r?\n", -1)).alias("rank", "line")).where("line <> ''")
    return rows.select("rank", F.split("line", "\t")[0].alias("piece"), F.split("line", "\t")[1].cast("double").alias("score"))


def read_jsonl(spark: SparkSession, path: str, schema: str, *, key: str, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines, the first `limit` by key."""
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def not_increasing(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key isn't greater than the one before in the given (unique) order; no task holds more than a range of the rows."""
    parted = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    edges = parted.groupBy("_part").agg(F.max_by(key, order).alias("_last"))
    edges = edges.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))  # one row for each range
    within = F.lag(F.struct(key)).over(Window.partitionBy("_part").orderBy(order))
    seen = parted.withColumn("_before", within).join(F.broadcast(edges), "_part")
    before = F.when(F.col("_before").isNull(), F.col("_edge")).otherwise(F.col(f"_before.{key}"))
    return seen.where(before >= F.col(key)).drop("_before", "_edge", "_part")


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All metrics.json one folder below the root, with the file each row came from, by file."""
    return spark.read.json(f"{root}/*/metrics.json", multiLine=True).withColumn("file", F.input_file_name()).orderBy("file")


def subset(manifest: DataFrame, listed: DataFrame, *, key: str = "relative_path") -> DataFrame:
    """The manifest's rows of a benchmark list (value, one path a line, # comments), in the list's order; raises on a path that is missing."""
    names = listed.where("trim(value) <> '' and trim(value) not like '#%'").select(F.trim("value").alias(key), F.monotonically_increasing_id().alias("_at"))
    gone = names.join(manifest, key, "left_anti").limit(1).collect()
    if gone:
        raise ValueError(f"not in the manifest: {gone[0][key]}")
    return manifest.join(F.broadcast(names), key).orderBy("_at").drop("_at")  # a benchmark list is short
