"""Vectors for script conversion, spacing and normalisation."""

import pytest
from pyspark.sql import functions as F

from lexispan.functions import hashing, normalize, phonology, script, spacing
from lexispan.functions.letters import letters, letters_list


def applied(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.out for r in rows.select("i", function(F.col("t")).alias("out")).orderBy("i").collect()]


def test_letters():
    assert letters("Rāma-\nś ca ||2||") == letters("रामश्च") == "ramasca"
    assert letters("ॐ तत् सत्") == "omtatsat"
    assert letters_list([None, "", "123 |", "कक", "Ā", "Ā", "क‍्ष", "क़"]) == ["", "", "", "kaka", "a", "a", "ksa", "ka"]
    assert letters("x" * 100_000 + "क" * 1000) == "x" * 100_000 + "ka" * 1000


def test_script():
    for text, expected in {
        "rāmo 'sti |": "रामो ऽस्ति ।", "tat tvam asi ||": "तत् त्वम् असि ॥", "agnim īḷe purohitaṃ |": "अग्निम् ईऌए पुरोहितं ।",
        "tat tvam asi": "तत् त्वम् असि", "a 'a": "अ ऽअ", "t t": "त् त्", "a t": "अ त्", "oṃ om": "ॐ ओम्",
    }.items():
        assert script.iast_to_devanagari(text) == expected
    for text in ("देवोऽपि रामः।\nसीता गच्छति॥", "संस्कृतम्"):
        assert script.iast_to_devanagari(script.devanagari_to_iast(text)) == text
    assert script.devanagari_to_injective("धद्ह") == "dʰadha"
    assert script.devanagari_to_injective("रमइतिरमउतमैत्रपौत्र") == "ramaitiramautamētrapōtra"
    with pytest.raises(ValueError, match="unsupported Devanagari"):
        script.devanagari_to_injective("०")
    assert script.normalize_iast("ágnìm r̥ṣi saṁ") == "agnim ṛṣi saṃ"


SPACING = [
    ("tat tvam asi", "legacy_joined", "iast", "tattvamasi"),
    ("तत् त्वम् असि", "legacy_joined", "devanagari", "तत्त्वमसि"),
    ("aṃ ka", "legacy_joined", "iast", "aṃ ka"),
    ("aḥ a", "legacy_joined", "iast", "aḥ a"),
    ("a 'sti", "legacy_joined", "iast", "a'sti"),
    ("devaś ca  rāmaś ca\ndhāvanti iti", "continuous", "iast", "devaścarāmaśca\ndhāvantiiti"),
    ("rāmaḥ gacchati | sītā tiṣṭhati\nrāmaḥ gacchati ||\n", "continuous", "iast", "rāmaḥgacchati | sītātiṣṭhati\nrāmaḥgacchati ||\n"),
    ("रामः गच्छति । सीता तिष्ठति\nरामः गच्छति ॥\n", "continuous", "devanagari", "रामःगच्छति। सीतातिष्ठति\nरामःगच्छति॥\n"),
    ("तद् अस्ति", "continuous", "devanagari", "तदस्ति"),
    ("तद् इति", "continuous", "devanagari", "तदिति"),
    ("तद् उक्तम्", "continuous", "devanagari", "तदुक्तम्"),
    ("तद् एव", "continuous", "devanagari", "तदेव"),
    ("तद् अभ्यस्राम्यद् अभ्यतपत् समतपत्", "continuous", "devanagari", "तदभ्यस्राम्यदभ्यतपत्समतपत्"),
    ("रामः  गच्छति ।  सीता तिष्ठति ॥\n", "surface_word", "devanagari", "रामः  गच्छति। सीता तिष्ठति॥\n"),
    ("तत् त्वम् असि ।  रामः ॥\n", "legacy_joined", "devanagari", "तत्त्वमसि। रामः॥\n"),
]


@pytest.mark.parametrize(("text", "condition", "kind", "expected"), SPACING)
def test_spacing(spark, text, condition, kind, expected):
    assert applied(spark, lambda c: spacing.spaced(c, condition, kind), [text, None]) == [expected, None]


# Texts and what must come of them.
NORMALIZED = {
    "अ​ग्नि": "अग्नि", "राम  गच्छति": "राम गच्छति", "राम\tगच्छति\u00a0वनम्\u3000इति": "राम गच्छति वनम् इति", "  रामः  \n  गच्छति  ": "रामः\nगच्छति", "रामः\nगच्छति": "रामः\nगच्छति",
    "रामः\n\n\n\nगच्छति": "रामः\n\nगच्छति", "रामः  ।   गच्छति": "रामः। गच्छति", "रामः |": "रामः।", "रामः ||": "रामः॥", "रामः ||०||": "रामः॥",
    "नारायणं नमस्कृत्य नरं चैव नरोत्तमम् |\nदेवीं सरस्वतीं चैव ततो जयमुदीरयेत् ||०||": "नारायणं नमस्कृत्य नरं चैव नरोत्तमम्।\nदेवीं सरस्वतीं चैव ततो जयमुदीरयेत्॥",
    "रामः॥": "रामः॥", "रामः॥\nगच्छति": "रामः॥\nगच्छति", "रामः॥२३॥": "रामः॥", "रामः॥ २३ ॥": "रामः॥", "रामः॥   २३॥": "रामः॥", "रामः॥ २॥": "रामः॥", "रामः॥\n": "रामः॥",
    "रामः ॥ गच्छति": "रामः॥\nगच्छति", "सोऽहम्": "सोऽहम्", "रामः, गच्छति: वनम्!": "रामः गच्छति वनम्।", "अध्याय 12 ३": "अध्याय", "रामः 123 गच्छति": "रामः गच्छति", "रामः १२३ गच्छति": "रामः गच्छति",
    "रामः abc @@@ गच्छति": "रामः गच्छति", "12\n[रामः]* गच्छति¹\nfooter 3": "रामः गच्छति", "अनुक्रमणीपर्व\n१": "अनुक्रमणीपर्व", "अध्याय\n२": "अध्याय", "१२\nरामः": "रामः",
    "रामः\n६। ७३\nगच्छति": "रामः\nगच्छति", "रामः। गच्छति": "रामः। गच्छति", "रामः\n।\nगच्छति": "रामः\nगच्छति", "रामः\n॥\nगच्छति": "रामः\nगच्छति", "।\n॥": "",
    "रामः\n% File name : mbh01.txt": "रामः", "रामः\nEncoding: ISCII": "रामः", "रामः\nElectronic text prepared in 1999": "रामः", "रामः\nhttp://example.org/source": "रामः",
    "रामः\n02/23/2025 03:52:33": "रामः", "रामः गच्छति।\nसीता पठति।\n% File name : sample.txt\nEncoding: ISCII": "रामः गच्छति।\nसीता पठति।",
}


def test_normalized(spark):
    assert applied(spark, normalize.normalized, [*NORMALIZED, None]) == [*NORMALIZED.values(), None]


def test_commas_and_dandas(spark):
    assert applied(spark, spacing.commas_to_danda, [",a, b ,c,,", "a,b"]) == ["a। b c।।", "a।b"]
    assert applied(spark, spacing.split_on_danda, ["a । b ॥ c", "।॥", ""]) == [["a ।", "b ॥", "c"], [], []]


def test_phonology(spark):
    assert applied(spark, phonology.form_key, ["devaḥ", "aindraḥ", "x", ""]) == ["C_D.V_E.C_V.V_A.M_VISARGA", "V_AI.C_N.C_D.C_R.V_A.M_VISARGA", None, None]
    assert applied(spark, lambda c: phonology.key_iast(c), ["V_O.C_M"]) == ["om"]
    assert applied(spark, phonology.layer_of, ["6_sastra/tika/x.htm", "y"]) == ["sastra", "other"]


def test_hashing(spark):
    rows = spark.createDataFrame([(" Akara", ".\\4_rellit\\a.htm"), ("akara", "4_rellit/a.htm")], "s string, p string")
    ids = [r[0] for r in rows.select(hashing.document_id(F.col("s"), F.col("p"))).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 28
    docs = spark.range(4000).select(F.col("id").cast("string").alias("d"))
    shares = {r[0]: r[1] / 4000 for r in docs.groupBy(hashing.assigned_split(F.col("d"))).count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["dev"] - 0.1) < 0.02


def test_light_normaliser_and_tokens(spark):
    assert applied(spark, normalize.light_devanagari, [" । राम  गच्छति ।सीता ,\r\n\n\n\nवनम् ॥ ", None]) == ["राम गच्छति। सीता,\n\nवनम्॥", None]
    join = lambda c: spacing.joined_tokens(spacing.longest_iast_tokens(c))
    assert applied(spark, join, ["a 'a", "t t", "t a", "a t", "t h"]) == [["a", "'", "a"], ["t", "t"], ["t", "a"], ["a", " ", "t"], ["t", "h"]]


def test_byte_digests_hold_one_text_at_a_time(spark):
    import tracemalloc

    import pandas as pd

    from lexispan.operators import tokenizers

    texts = ["", "rāma", None, "aḥ" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.md5(F.array_join(tokenizers.byte_encoding(F.col("t"))["ids"].cast("array<string>"), " "))
    assert rows.where(~tokenizers.byte_id_digest(F.col("t")).eqNullSafe(plain)).isEmpty()
    many = pd.Series(["rāma" * 500] * 400)
    tracemalloc.start()
    tokenizers._byte_digests(many)
    assert tracemalloc.get_traced_memory()[1] < 1_000_000  # the lists of all ids took over 100 MB
    tracemalloc.stop()
