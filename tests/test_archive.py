"""Exports that promise their content, and reductions over inspected segments."""

import pytest
from pyspark.sql import functions as F

from lexispan.operators import archive
from lexispan.sources import corpus, sinks


def test_state_and_sums(spark, tmp_path):
    tables = {
        "final_scorer": spark.createDataFrame([("V_A", 1.5), ("C_K.V_A", 2.0)], "form_key string, expected_count double"),
        "surface_usage": spark.createDataFrame([("V_A", "a", 1.5), ("C_K.V_A", "ka", 2.0)], "form_key string, surface string, expected_mass double"),
        "context_usage": spark.createDataFrame([("V_A", "<BOS>><EOS>", 0.5)], "form_key string, context string, expected_mass double"),
    }
    assert sinks.write_state(tables, f"{tmp_path}/s") == {"final_scorer": (2, 3.5), "surface_usage": (2, 3.5), "context_usage": (1, 0.5)}
    assert sinks.unchanged(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError, match="expected_count"):
        sinks.write_state(tables | {"final_scorer": tables["final_scorer"].withColumn("expected_count", F.lit(1))}, f"{tmp_path}/t")
    sinks.write_vocabulary(tables["final_scorer"], f"{tmp_path}/v")
    sinks.write_vocabulary(tables["final_scorer"], f"{tmp_path}/v")
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_vocabulary(tables["final_scorer"].limit(1), f"{tmp_path}/v")


def test_bundle_and_fingerprints(spark, tmp_path):
    assert sinks.fingerprint({"b": 1, "a": [2]}) == sinks.fingerprint({"a": [2], "b": 1}) != sinks.fingerprint({"a": [2], "b": 2})
    manifest = spark.createDataFrame([("d2", "y"), ("d1", "x")], "document_id string, canonical_hash string")
    assert sinks.data_fingerprint(manifest, seed=1) == sinks.data_fingerprint(manifest.orderBy("document_id"), seed=1) != sinks.data_fingerprint(manifest, seed=2)
    folder = sinks.write_bundle(spark, str(tmp_path), config={"seed": 1}, metrics={"loss": 0.5}, fingerprints={"data": "x"}, predictions=manifest, logs=["one"])
    assert spark.read.text(f"{folder}/metrics").first()[0] == '{"loss": 0.5}' and spark.read.parquet(f"{folder}/predictions").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_bundle(spark, str(tmp_path), config={"seed": 1}, metrics={}, fingerprints={})
    texts = spark.createDataFrame([("d1", "dadha", "iast"), ("d2", "रम", "devanagari")], "document_id string, text string, script string")
    sinks.write_injective(texts, f"{tmp_path}/i")
    assert {r.text for r in spark.read.parquet(f"{tmp_path}/i").collect()} == {"dadʰa", "rama"}
    listed = spark.createDataFrame([("# few",), ("d2",)], "value string")
    assert [r.document_id for r in corpus.subset(manifest, listed, key="document_id").collect()] == ["d2"]
    with pytest.raises(ValueError, match="d9"):
        corpus.subset(manifest, spark.createDataFrame([("d9",)], "value string"), key="document_id")


INSPECTED = "key string, segment_no int, written string, log_partition double, entropy double, identity_mass double, expected_tokens double, counts array<struct<form_key:string,mass:double>>, top array<struct<probability:double,log_score:double,words:array<string>,rule_ids:array<string>>>"


def test_reductions(spark):
    sound = ("d:l1", 0, "devaḥ api", 0.0, 0.5, 0.25, 2.0, [("a", 1.5), ("b", 0.5)], [(0.7, -0.3, ["a", "b"], []), (0.2, -1.6, ["a"], [])])
    rows = [sound, ("d:l2", 0, "ca", 0.0, 0.0, 1.5, 1.0, [("a", 1.0)], []), ("d:l3", 0, "ca", 0.0, 0.0, 0.5, 1.0, [("a", 1.0)], [(0.1, 0.0, ["a"], []), (0.4, 0.0, ["a"], [])]), ("d:l4", 0, "ca", 0.0, 0.0, 0.5, 3.0, [("a", 1.0)], [])]
    seen = spark.createDataFrame(rows, INSPECTED)
    assert {(r.key, r.fault) for r in archive.cell_faults(seen).collect()} == {("d:l2", "identity mass"), ("d:l3", "order"), ("d:l4", "tokens")}
    out = archive.segment_export(seen).where("key = 'd:l1'").first()
    assert (out.tokens, out.top_words, round(out.residual, 9), out.latent_mass) == (2, "a b", 0.1, 0.75)
    assert archive.segment_strata(seen.where("false"), tokens=[1.0], entropy=[1.0]).count() == 0
    assert {(r.token_stratum, r.entropy_stratum, r.segments) for r in archive.segment_strata(seen, tokens=[1.0], entropy=[0.1]).collect()} == {(1, 1, 1), (0, 0, 3)}
    union = archive.family({"x": seen.select("key"), "y": seen.select("key", "entropy")})
    assert union.count() == 8 and union.where("cell = 'x' and entropy is null").count() == 4
    pairs = spark.createDataFrame([("p", f"f{i}", float(-i)) for i in range(20)] + [("p", "n", None)], "pair string, field string, d double")
    assert [r.field for r in archive.designated_differences(pairs, pair=["pair"], field=["field"], difference="d").orderBy("rank").collect()] == [f"f{i}" for i in range(19, 7, -1)]
    docs = spark.createDataFrame([(1, "a 12 b[3]\nx"), (2, None), (3, "ok")], "doc_id long, text string")
    hits = archive.residual_hits(docs, {"number": "[0-9]+", "bracket": r"[\[\]]"})
    assert {tuple(r) for r in hits.collect()} == {(1, 1, 3, "number", "12"), (1, 1, 8, "number", "3"), (1, 1, 7, "bracket", "["), (1, 1, 9, "bracket", "]")}
    assert {tuple(r) for r in archive.partitioned_files(docs, hits).collect()} == {(1, True, 4), (2, False, 0), (3, False, 0)}
