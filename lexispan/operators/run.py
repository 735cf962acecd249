"""A whole latent-lexicon run that can be taken up again: one table for each pass, then the inspection and its artefacts.

A pass counts as done when its table is committed (Spark's _SUCCESS file), so a run
that was stopped goes on with the first pass that isn't.  The settings are written
first and must be the same when a run is taken up.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.operators import latent
from lexispan.operators.usage import lexicon_export
from lexispan.sources.sinks import write_tsv


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return files.exists(path)


def signature(settings: latent.Settings, rules: list[tuple], passes: int, budget: int | None) -> str:
    """SHA-256 of everything that decides the result of a run but its lines."""
    text = json.dumps([asdict(settings), sorted(map(list, rules)), passes, budget], ensure_ascii=False, sort_keys=True)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _table(df: DataFrame, path: str) -> DataFrame:
    """The table at a path, written first if it isn't complete."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run(lines: DataFrame, rules: list[tuple[str, str, str, str]], path: str, *, key: str, text: str, passes: int, settings: latent.Settings | None = None, budget: int | None = None) -> DataFrame:
    """Trains, inspects and publishes under `path`; returns the lexicon.  Raises if the path holds a run with other settings."""
    spark, s = lines.sparkSession, settings or latent.Settings()
    mark = signature(s, rules, passes, budget)
    if exists(spark, f"{path}/signature"):
        if spark.read.text(f"{path}/signature").first()[0] != mark:
            raise ValueError("the path holds a run with other settings")
    else:
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}/signature")
    grammar, lexicon, allowed = latent.Grammar(rules), None, None
    for number in range(1, passes + 1):
        if number == 1 and budget is not None:
            counts = _table(latent.expectation(lines, grammar, None, key=key, text=text, settings=s), f"{path}/pass1_counts")
            frozen, allowed = latent.freeze_vocabulary(counts, budget)
            lexicon = _table(frozen, f"{path}/lexicon/pass=1")
            continue
        counts = latent.expectation(lines, grammar, lexicon, key=key, text=text, settings=s, allowed=allowed)
        lexicon = _table(counts if allowed is None else latent.with_frozen_rows(counts, allowed), f"{path}/lexicon/pass={number}")
    inspected = _table(latent.inspection(lines, grammar, lexicon, key=key, text=text, settings=s, allowed=allowed), f"{path}/inspection")
    publish(inspected, lexicon, path, s)
    return lexicon


def publish(inspected: DataFrame, lexicon: DataFrame, path: str, s: latent.Settings) -> None:
    """Lexicon and rule usage as TSV, analyses and boundaries as JSON lines, usage tables and the summary; what is there stays."""
    spark = inspected.sparkSession
    surfaces = _table(latent.surface_usage(inspected, s.threshold), f"{path}/surface_usage")
    contexts = _table(latent.context_usage(inspected, s.threshold), f"{path}/context_usage")
    if not exists(spark, f"{path}/latent_lexicon"):
        table = lexicon_export(lexicon, surfaces, contexts, alpha=s.alpha, threshold=s.threshold)
        write_tsv(table.orderBy(F.desc("expected_count"), "form_key"), f"{path}/latent_lexicon")
    if not exists(spark, f"{path}/rule_usage"):
        write_tsv(latent.rule_usage(inspected).orderBy("rank"), f"{path}/rule_usage")
    for name, frame in (
        ("analyses", inspected.drop("counts", "rules", "boundaries")), ("boundary_posteriors", inspected.select("key", "segment_no", "written", "boundaries")), ("summary", latent.pass_metrics(inspected)),
    ):
        if not exists(spark, f"{path}/{name}"):
            frame.write.json(f"{path}/{name}")


def posterior_reduction(inspected: DataFrame) -> DataFrame:
    """(stratum, value, segments, mean_entropy, mean_identity, top_mass): over all segments and by the number of expected words (1, 2-4, 5-8, more)."""
    words = F.col("expected_tokens")
    length = F.when(words <= 1.5, "1").when(words <= 4.5, "2-4").when(words <= 8.5, "5-8").otherwise("9+")
    rows = inspected.select(F.explode(F.array(F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("value")), F.struct(F.lit("words").alias("stratum"), length.alias("value")))).alias("x"), "entropy", "identity_mass", "top")
    top = F.aggregate("top", F.lit(0.0), lambda a, t: a + t["probability"])
    return rows.groupBy("x.stratum", "x.value").agg(F.count(F.lit(1)).alias("segments"), F.avg("entropy").alias("mean_entropy"), F.avg("identity_mass").alias("mean_identity"), F.avg(F.least(F.lit(1.0), top)).alias("top_mass"))


def inventory(tables: dict[str, DataFrame], sums: dict[str, str]) -> DataFrame:
    """(name, rows, total) of each table; `sums` names the column to add up."""
    frames = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), (F.sum(sums[n]) if n in sums else F.lit(None)).cast("double").alias("total")) for n, df in tables.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def inconsistent(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows of an inventory that differ from what was declared (name, rows, total)."""
    both = declared.select("name", F.col("rows").alias("want_rows"), F.col("total").alias("want_total")).join(found, "name", "full")
    near = F.coalesce(F.abs(F.col("total") - F.col("want_total")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("want_total")), F.col("total").isNull() & F.col("want_total").isNull())
    return both.where(~(F.coalesce(F.col("rows") == F.col("want_rows"), F.lit(False)) & near))
