"""Whole runs: taking up a stopped one, experiments, writers that read back, readers."""

import pytest
from pyspark.sql import functions as F

from lexispan.operators import experiment, latent, rules, run
from lexispan.sources import corpus, sinks

RULES = [(r[0], r[1], r[2], r[3]) for r in rules.seed_rules()]
LINES = [(1, "devo'pi devaḥ ca api ca"), (2, "rāmo'pi rāmaḥ ca api tat")]


def test_run_and_resume(spark, tmp_path):
    lines = spark.createDataFrame(LINES, "id int, t string")
    s = latent.Settings(top_k=4)
    whole = run.run(lines, RULES, f"{tmp_path}/a", key="id", text="t", passes=2, settings=s, budget=60)
    assert whole.count() == 60
    first = run.run(lines, RULES, f"{tmp_path}/b", key="id", text="t", passes=2, settings=s, budget=60)
    assert latent.differing(whole, first, "form_key", "expected_count").isEmpty()
    with pytest.raises(ValueError, match="other settings"):
        run.run(lines, RULES, f"{tmp_path}/a", key="id", text="t", passes=3, settings=s, budget=60)
    again = run.run(lines, RULES, f"{tmp_path}/a", key="id", text="t", passes=2, settings=s, budget=60)
    assert latent.differing(whole, again, "form_key", "expected_count").isEmpty()
    seen = spark.read.parquet(f"{tmp_path}/a/inspection")
    reduced = {(r.stratum, r.value): r for r in run.posterior_reduction(seen).collect()}
    assert reduced["all", "all"].segments == 2
    for name in ("latent_lexicon", "rule_usage", "analyses", "boundary_posteriors", "summary"):
        assert run.exists(spark, f"{tmp_path}/a/{name}/_SUCCESS")
    found = run.inventory({"lexicon": whole, "inspection": seen}, {"lexicon": "expected_count"})
    assert run.inconsistent(found, found).isEmpty()
    assert run.inconsistent(found, found.withColumn("rows", F.col("rows") + 1)).count() == 2


def test_experiment(spark):
    rows = [("d:l1", "train", "devaś ca rāmaś ca", "iast"), ("d:l2", "dev", "sītā paṭhati", "iast"), ("d:l3", "dev", "बालः गच्छति", "devanagari")]
    segments = spark.createDataFrame(rows, "segment_id string, split string, text string, script string")
    config = {"data": {"train": "train"}, "representation": {"script": "devanagari", "spacing": "continuous"}, "tokenizer": {"type": "byte"}, "model": {"type": "ngram"}, "seed": 1, "evaluation": {"split": "dev"}}
    row = experiment.run(config, segments).first()
    assert row.segments == 2 and row.tokens == row.bytes and row.bits_per_char > 0 and row.bits_per_byte < row.bits_per_char
    with pytest.raises(ValueError, match="missing keys: seed"):
        experiment.run({k: v for k, v in config.items() if k != "seed"}, segments)


def test_writers_and_readers(spark, tmp_path):
    table = spark.createDataFrame([("V_A", 1.25), ("V_I", 1 / 3)], "form_key string, expected_mass double")
    assert sinks.write_verified(table, f"{tmp_path}/t", mass="expected_mass")[0] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_tsv(table, f"{tmp_path}/t")
    docs = spark.createDataFrame([("b.txt", "y\r\nz"), ("a.txt", "x")], "path string, text string")
    assert sinks.freeze(docs, f"{tmp_path}/f1", path_column="path", text="text") == sinks.freeze(docs.orderBy("path"), f"{tmp_path}/f2", path_column="path", text="text")
    with pytest.raises(ValueError, match="gate"):
        sinks.freeze(docs, f"{tmp_path}/f3", path_column="path", text="text", gate=docs)
    assert [(r.line_no, r.text) for r in corpus.segments(docs, key="path").where("path = 'b.txt'").orderBy("line_no").collect()] == [(1, "y"), (2, "z")]
    assert corpus.html_body("<head>x</head>a<hr>b<hr>c<p>d<td>e") == "c\nd e" and corpus.html_body("a<hr>b") == "b" and corpus.html_body("a<style>q</style>") == "a"
    lines = spark.createDataFrame([("# c",), ("a/b.htm",), ("/x.htm",), ("a/../b.htm",), ("c.txt",), ("d\\e.HTM",), ("d/e.HTM",), ("f.htm # note",), ("C:x.htm",)], "value string")
    problems = {r.relative_path: r.problem for r in corpus.parse_whitelist(lines).collect()}
    assert problems == {"a/b.htm": None, "/x.htm": "absolute", "a/../b.htm": "parent", "c.txt": "suffix", "d/e.HTM": "duplicate", "f.htm # note": "suffix", "C:x.htm": "drive"}
    assert [tuple(r) for r in corpus.parse_whitelist(lines.where("value = '# c'")).collect()] == [(None, "empty")]
    steps = spark.createDataFrame([(i, i if i not in (7, 40) else 3) for i in range(90)], "n int, k int")
    assert {r.n for r in corpus.not_increasing(steps, "k", "n").collect()} == {7, 40}
    texts = spark.createDataFrame([("d1", "tat tvam asi", "iast")], "document_id string, text string, script string")
    manifest = sinks.write_representations(texts, f"{tmp_path}/r")
    assert manifest.count() == 6 and manifest.where("script = 'iast' and condition = 'continuous'").first().char_count == 10
    with pytest.raises(ValueError, match="json or"):
        sinks.write_results(docs, f"{tmp_path}/x.txt")


def test_build(spark, tmp_path):
    from lexispan.sources import build

    pages = spark.createDataFrame([("1_veda/a.htm", "<body>x<hr>y<hr>12. agním īḷe || 1 ||<br>rāmaḥ"), ("6_sastra/b.htm", "<p>q")], "relative_path string, html string")
    listed = spark.createDataFrame([("1_veda/a.htm",), ("2_epic/c.htm",)], "value string")
    made = build.build_corpus(pages, listed, source="akara")
    row = made.manifest.first()
    assert made.manifest.count() == 1 and row.layer == "veda" and row.segment_count == 2 and row.has_accent and row.document_id.startswith("doc_")
    assert [r[0] for r in made.missing.collect()] == ["2_epic/c.htm"] and made.documents.first().text == "agním īḷe ||\nrāmaḥ"
    build.write_build(made, f"{tmp_path}/b")
    again = spark.read.parquet(f"{tmp_path}/b/manifest")
    assert build.stale(made.manifest, again, "document_id", ["canonical_hash", "split"]).isEmpty()
    assert build.stale(made.manifest, again.withColumn("split", F.lit("x")), "document_id", ["canonical_hash", "split"]).count() == 1
    with pytest.raises(ValueError, match="problems"):
        build.build_corpus(pages, spark.createDataFrame([("/x.htm",)], "value string"), source="akara")
    docs = spark.createDataFrame([(1, "a" * 90, "epic"), (2, "a" * 90, "veda"), (3, "x, y । z", None)], "doc_id long, text string, layer string")
    assert [(r.weight, r.duplicate) for r in build.weighted_manifest(docs).orderBy("doc_id").collect()] == [("1.000", False), ("0.000", True), ("0.700", False)]
    assert build.weighted_lines(docs.where("layer = 'epic'")).count() == 1


def test_weighted_corpus_has_every_layer(spark, tmp_path):
    from lexispan.functions.hashing import included
    from lexispan.plans import catalogue

    layers = ["epic", "poetry", "sastra", "veda", "purana", "rellit", None]
    docs = spark.createDataFrame([(i, "\n".join(f"x{k} y" for k in range(200)), x, "s") for i, x in enumerate(layers)], "doc_id long, text string, layer string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.layer: r.sentences for r in catalogue.queries()["weighted_corpus"](spark, str(tmp_path)).collect()}
    assert set(got) == set(layers) and got["epic"] == got["poetry"] == got["sastra"] == 200
    numbers = build_lines(docs)
    for i, (layer, weight) in enumerate(zip(layers[3:], (0.8, 0.7, 0.7, 0.7), strict=True), 3):
        kept = numbers.where(F.col("doc_id") == i).where(included(F.col("doc_id").cast("string"), F.col("line_no"), F.lit(weight), digest="sha256")).count()
        assert got[layer] == kept and abs(kept / 200 - weight) < 0.12


def build_lines(docs):
    from lexispan.sources import corpus

    return corpus.lines_of(docs, key="doc_id", text="text", keep=("layer",))
