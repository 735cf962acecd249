"""Writers; none overwrites, and those that promise content read it back."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions import script as scripts
from lexispan.functions import spacing
from lexispan.operators.ranking import ranked
from lexispan.session import cut

#: Entries that one hash of a corpus hash covers.
HASHED = 10_000
RESULT_COLUMNS = (
    "run_id", "script", "spacing", "tokenizer", "vocab_size", "model", "seed", "split", "segments", "characters", "bytes", "tokens", "bits_per_char",
    "bits_per_byte", "grapheme_split_rate",
)
REPRESENTATIONS = tuple((s, c) for s in ("iast", "devanagari") for c in ("surface_word", "continuous", "legacy_joined"))


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet; fails if there is something at the path."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def represented(documents: DataFrame, *, text: str = "text", script: str = "script", conditions: tuple[tuple[str, str], ...] = REPRESENTATIONS) -> DataFrame:
    """Every document under every (script, condition); identity and split stay as they are."""
    targets = list(dict.fromkeys(target for target, _ in conditions))
    converted = documents.withColumns({f"_{t}": scripts.converted(F.col(text), F.col(script), t) for t in targets})
    forms = [F.struct(F.lit(t).alias("script"), F.lit(c).alias("condition"), spacing.spaced(F.col(f"_{t}"), c, t).alias("represented")) for t, c in conditions]
    kept = [c for c in documents.columns if c not in (text, script)]
    return converted.select(*kept, F.explode(F.array(*forms)).alias("_r")).select(*kept, "_r.*")


def write_representations(documents: DataFrame, path: str, **options) -> DataFrame:
    """Writes `represented` partitioned by script and condition, and returns the manifest: bytes, characters, lines and hash of each text."""
    write_table(represented(documents, **options), path, partition_by=("script", "condition"))
    t = F.col("represented")
    return documents.sparkSession.read.parquet(path).select(
        "*", F.octet_length(t).alias("byte_count"), F.length(t).alias("char_count"), F.size(F.split(t, "\n", -1)).alias("line_count"), F.sha2(t, 256).alias("hash")
    ).drop("represented")


def freeze(documents: DataFrame, path: str, *, path_column: str, text: str, gate: DataFrame | None = None) -> str:
    """Writes a corpus once and returns its hash, over paths and texts in path order, both with their lengths.

    `gate` holds the violations found before; any of them stops the freeze.
    """
    if gate is not None and gate.limit(1).count():
        raise ValueError("the corpus doesn't pass its gate")
    if documents.groupBy(path_column).count().where("count > 1").limit(1).count():
        raise ValueError("a path is listed twice")
    write_table(documents, path)
    return corpus_hash(documents.sparkSession.read.parquet(path), path_column=path_column, text=text)


def corpus_hash(documents: DataFrame, *, path_column: str, text: str) -> str:
    """SHA-256 over (length and path, length and hash of the text) in path order, as a tree: each hash covers the next `HASHED` of the level below."""
    entry = F.concat_ws(":", F.octet_length(path_column), path_column, F.coalesce(F.octet_length(text), F.lit(-1)), F.coalesce(F.sha2(text, 256), F.lit("")))
    level = ranked(documents.select(F.col(path_column).alias("path"), entry.alias("h")), [F.col("path")]).select("rank", "h")
    n = level.count()
    while True:
        block = F.floor((F.col("rank") - 1) / HASHED) + 1
        inner = F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"])  # at most HASHED rows
        level = cut(level.groupBy(block.alias("rank")).agg(F.sha2(F.array_join(inner, "\n"), 256).alias("h")))
        n = -(-n // HASHED)
        if n <= 1:
            row = level.first()
            return row["h"] if row else hashlib.sha256(b"").hexdigest()


def write_tsv(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    """A TSV with a header and no quoting; doubles keep all their digits."""
    writer = df.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_verified(df: DataFrame, path: str, *, mass: str) -> tuple[int, float]:
    """Writes a gzip TSV, reads it back and compares rows and summed mass; raises if they differ."""
    wanted = df.agg(F.count(F.lit(1)), F.sum(mass)).first()
    write_tsv(df, path, gzip=True)
    found = df.sparkSession.read.csv(path, sep="\t", header=True, schema=df.schema, quote="").agg(F.count(F.lit(1)), F.sum(mass)).first()
    if wanted[0] != found[0] or abs((wanted[1] or 0.0) - (found[1] or 0.0)) > 1e-9 * max(1.0, abs(wanted[1] or 0.0)):
        raise ValueError(f"{path}: read back {found[0]} rows and {found[1]}, wrote {wanted[0]} and {wanted[1]}")
    return wanted[0], wanted[1]


def result_rows(df: DataFrame) -> DataFrame:
    """The fixed columns of a result table; those that are absent are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS))


def write_results(df: DataFrame, path: str) -> None:
    """JSON or CSV by the path's suffix."""
    rows = result_rows(df).coalesce(1).write.mode("errorifexists")
    if path.endswith(".json"):
        rows.json(path)
    elif path.endswith(".csv"):
        rows.option("header", True).csv(path)
    else:
        raise ValueError("a result table is json or csv by its suffix")


def fingerprint(value: object) -> str:
    """SHA-256 of a value of plain dictionaries, lists, strings and numbers, written in one canonical way."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8")).hexdigest()


def data_fingerprint(manifest: DataFrame, *, key: str = "document_id", digest: str = "canonical_hash", **more: object) -> str:
    """The fingerprint of a manifest's documents and their hashes, in key order, and of what else decides a run (representation, seed, limits)."""
    rows = manifest.select(F.col(key).alias("path"), F.concat_ws(":", key, F.coalesce(digest, F.lit(""))).alias("text"))
    return fingerprint({"documents": corpus_hash(rows, path_column="path", text="text"), **more})


def write_or_verify(df: DataFrame, path: str, *, order: list[str]) -> bool:
    """Writes a table once; if there is one at the path it must hold the same rows, else this raises.  True if it was written."""
    from lexispan.operators.run import exists

    rows = df.orderBy(*order)
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        write_table(rows, path)
        return True
    there = df.sparkSession.read.schema(df.schema).parquet(path)
    if not there.exceptAll(df).unionAll(df.exceptAll(there)).isEmpty():
        raise ValueError(f"{path} holds other rows")
    return False


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """A vocabulary (form_key, expected_count) as TSV and as JSON lines, in key order; files that are there must be the same."""
    rows = vocabulary.select("form_key", "expected_count").orderBy("form_key")
    write_or_verify(rows.select(F.concat_ws("\t", "form_key", F.col("expected_count").cast("string")).alias("value")), f"{path}/vocabulary_tsv", order=["value"])
    write_or_verify(rows.select(F.to_json(F.struct("form_key", "expected_count")).alias("value")), f"{path}/vocabulary_json", order=["value"])


def key_ordered(df: DataFrame, required: dict[str, str], key: list[str]) -> DataFrame:
    """The required columns in key order; raises if one is missing or of another type."""
    wrong = [c for c, kind in required.items() if dict(df.dtypes).get(c) != kind]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df.select(*required).orderBy(*key)


STATE = {
    "final_scorer": ({"form_key": "string", "expected_count": "double"}, ["form_key"], "expected_count"),
    "surface_usage": ({"form_key": "string", "surface": "string", "expected_mass": "double"}, ["form_key", "surface"], "expected_mass"),
    "context_usage": ({"form_key": "string", "context": "string", "expected_mass": "double"}, ["form_key", "context"], "expected_mass"),
}


def write_state(tables: dict[str, DataFrame], path: str) -> dict[str, tuple[int, float]]:
    """What a learner has learned: three tables in key order as checked gzip TSV, with the SHA-256 of each file beside them; rows and summed mass of each."""
    spark = next(iter(tables.values())).sparkSession
    found = {name: write_verified(key_ordered(tables[name], required, key), f"{path}/{name}", mass=mass) for name, (required, key, mass) in STATE.items()}
    sums = file_sums(spark, path)
    sums.coalesce(1).write.mode("errorifexists").text(f"{path}/SHA256SUMS")
    return found


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """(value): digest and name of every data file below a path, in order of the names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_replace("path", r"^.*/([^/]+/[^/]+)$", "$1")
    return files.select(F.concat_ws("  ", F.sha2("content", 256), name).alias("value")).orderBy(F.substr("value", F.lit(67)))


def unchanged(spark: SparkSession, path: str) -> bool:
    """Whether all files below a path still have the digests that were written beside them."""
    return file_sums(spark, path).where(~F.col("value").contains("SHA256SUMS/")).exceptAll(spark.read.text(f"{path}/SHA256SUMS")).isEmpty()


def write_injective(documents: DataFrame, path: str, *, text: str = "text", script: str = "script") -> None:
    """Documents in the injective script, once; Devanagari that it has no letter for stops the write."""
    source = F.when(F.col(script) == "devanagari", F.col(text)).otherwise(scripts.to_devanagari(text))
    write_table(documents.withColumn(text, scripts.to_injective(source)).withColumn(script, F.lit("iast_injective")), path)


def write_bundle(spark: SparkSession, path: str, *, config: dict, metrics: dict, fingerprints: dict[str, str], predictions: DataFrame | None = None, logs: list[str] = ()) -> str:
    """What a run leaves: configuration, metrics, fingerprints, logs and predictions under a folder of its own, named by the configuration's fingerprint."""
    folder = f"{path}/{fingerprint(config)[:16]}"
    for name, value in (("config", config), ("metrics", metrics), ("fingerprints", fingerprints)):
        spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/{name}")
    spark.createDataFrame([(x,) for x in logs], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/logs")
    if predictions is not None:
        write_table(predictions, f"{folder}/predictions")
    return folder
