"""The corpus chain: pages to canonical documents with their manifest and reports, weights and the sampled tokenizer corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions import hashing, phonology, spacing
from lexispan.functions.script import nfc
from lexispan.operators import audit, cleaning, duplicates
from lexispan.sources import corpus
from lexispan.sources.sinks import write_table


@dataclass
class Build:
    """Frames of a build; each is lazy over the same cleaned documents."""

    documents: DataFrame
    manifest: DataFrame
    rule_counts: DataFrame
    unknown: DataFrame
    missing: DataFrame


def manifest_columns(text: Column, raw: Column) -> dict[str, Column]:
    """What a manifest says of a document's text."""
    lines = F.split(text, "\n", -1)
    return {
        "char_count": F.length(text), "byte_count": F.octet_length(text), "line_count": F.size(lines),
        "segment_count": F.size(F.filter(lines, lambda x: ~x.rlike(corpus.BLANK))), "has_accent": audit.has_accent(raw),
        "has_unknown_chars": F.length(F.translate(text, audit.ALPHABET, "")) > 0, "source_hash": F.sha2(raw, 256), "canonical_hash": F.sha2(text, 256),
    }


def build_corpus(pages: DataFrame, whitelist: DataFrame, *, source: str) -> Build:
    """Canonical documents of the listed pages (relative_path, html).

    A document's id and split follow from its source and path alone.  Raises if the list has a problem.
    """
    listed = corpus.parse_whitelist(whitelist)
    if not listed.where("problem is not null").isEmpty():
        raise ValueError("the list of sources has problems")
    rows = pages.join(listed.select("relative_path"), "relative_path", "left_semi").withColumn("raw", corpus.html_text("html"))
    done = cleaning.cleaned(rows, "canonical", key="relative_path", text="raw").join(rows.select("relative_path", "raw"), "relative_path")
    path = F.col("relative_path")
    documents = done.withColumn("text", nfc("text")).withColumn("document_id", hashing.document_id(F.lit(source), path))
    documents = documents.withColumns({"source": F.lit(source), "split": hashing.assigned_split(F.col("document_id")), "layer": phonology.layer_of(path)})
    manifest = documents.select("source", "relative_path", "document_id", "layer", "split", *(c.alias(n) for n, c in manifest_columns(F.col("text"), F.col("raw")).items()))
    return Build(
        documents.select("document_id", "relative_path", "source", "layer", "split", "text"), manifest, cleaning.rule_counts(documents, key="relative_path"),
        audit.unknown_characters(documents, key="document_id"), corpus.missing_sources(listed, pages),
    )


def write_build(build: Build, path: str) -> None:
    """One table for each frame; nothing is overwritten."""
    for name in ("documents", "manifest", "rule_counts", "unknown", "missing"):
        write_table(getattr(build, name), f"{path}/{name}")


def stale(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two manifests that differ in any of the columns, or that only one has; none if a rebuild gives the same."""
    both = expected.select(key, *(F.col(c).alias(f"e_{c}") for c in columns)).join(actual.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)), key, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))
    return both.where(~same)


def weighted_manifest(documents: DataFrame, *, key: str = "doc_id", text: str = "text", layer: str = "layer") -> DataFrame:
    """(key, layer, weight, characters, weighted_characters, duplicate): a copy of another document weighs nothing."""
    copies = duplicates.exact_duplicates(documents, key, text).select(key, F.col("matched").alias("_of"))
    rows = documents.join(copies, key, "left")
    doubled = F.col("_of").isNotNull() & (F.col("_of") < F.col(key))
    weight = F.when(doubled, 0.0).otherwise(phonology.layer_weight(F.coalesce(layer, F.lit("other"))))
    chars = F.length(text)
    return rows.select(key, layer, F.format_string("%.3f", weight).alias("weight"), chars.alias("characters"), F.when(chars.isNotNull(), F.format_string("%.1f", weight * chars)).alias("weighted_characters"), doubled.alias("duplicate"))


def weighted_lines(documents: DataFrame, *, path: str = "doc_id", text: str = "text", layer: str = "layer", digest: str = "blake2b") -> DataFrame:
    """(path, layer, line_no, sentence): sampled lines after the comma policy, cut at dandas."""
    lines = corpus.lines_of(documents, key=path, text=text, keep=(layer,))
    kept = lines.where(hashing.included(F.col(path).cast("string"), F.col("line_no"), phonology.layer_weight(F.coalesce(layer, F.lit("other"))), digest=digest))
    return kept.select(path, layer, "line_no", F.explode(spacing.split_on_danda(spacing.commas_to_danda(F.col("line")))).alias("sentence"))
