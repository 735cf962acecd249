"""Cleaning passes: vectors, counts, fixed points and list-driven deletion."""

import unicodedata

import pytest

from lexispan.operators import cleaning as C
from lexispan.operators import passes as P

# Texts and what each pass must make of them.
MECHANICAL = [
    ("\x15bharadvāja uvāca:\ntanno rudraḥ pracodayāt ||\x01\n", "bharadvāja uvāca:\ntanno rudraḥ pracodayāt ||\n", {"control_or_format_removed": 2}),
    ("samohK‍h̲ 'parimukto |\n", "samohKh̲ 'parimukto |\n", {"control_or_format_removed": 1}),
    ("brāhmaṇam_iti\n", "brāhmaṇam iti\n", {"underscore_to_space": 1}),
    ("dhī-gī[ḥ]- |\n", "dhī-gīḥ- |\n", {"square_supplement_unwrapped": 1}),
    ("pracodayāt savitā [ed. pracodayānt, corr. Patyal] iti |\n", "pracodayāt savitā iti |\n", {"square_editorial_removed": 1}),
    ("agnim īḷe [ṚV 1.1.1] iti |\n", "agnim īḷe iti |\n", {"square_citation_removed": 1}),
    ("<agnim īḷe purohitaṃ [ṚV 1.1.1]> ity evam |\n", "agnim īḷe purohitaṃ ity evam |\n", {"square_citation_removed": 1, "angle_unwrapped": 1}),
    ("<1.2.13> agnīt paridhīn |\n", "agnīt paridhīn |\n", {"angle_numeric_locator_removed": 1}),
    ("[h: HV (CE) Appendix I, transliterated by Peter Schreiner :h]\nnārada uvāca |\n", "nārada uvāca |\n", {"hv_metadata_removed": 1}),
    ("[k: K2.4 Ñ2.3 V B Dn ins. appendix I :k]\nrāma uvāca |\n", "rāma uvāca |\n", {"hv_metadata_removed": 1}),
    ("sa rātryā madhyame yāme (SBV I 118) nava daśa |\n", "sa rātryā madhyame yāme nava daśa |\n", {"round_editorial_removed": 1}),
    ("bhavati (79r = GBM 741) anāpattir varṣācchede |\n", "bhavati anāpattir varṣācchede |\n", {"round_editorial_removed": 1}),
    ("\x15<agnim īḷe [ṚV 1.1.1]>_iti |\n", "agnim īḷe iti |\n", {}),
    *((x, x, {}) for x in (
        "atha (agnyādhāna) karma |\n", "ātmabhāvapratilambhe [bskal pa graṅs med pa gsum] bodhimaṇḍe |\n", "kule-kule pañca-pañca anyo-'nyaḥ |\n",
        "apām.idma.nyayanam.samudrasya.niveśanam |\n", "satvāḥ, dharmāḥ, bhikṣavaḥ |\n", "Var-v bhikṣavaḥ |\n", "tūfaro hi prajāpatiḥ |\n",
    )),
]
EDITORIAL = [
    ("2.1.4.\nrāmaḥ |\n", "\nrāmaḥ |\n"), ("1.1.3[[.]]5\n1.4.3[.1]0\n", "\n\n"), ("31\n", "31\n"), ("11.7.4.2prajāpatir ha vai |\n", "prajāpatir ha vai |\n"),
    ("aśvānavaghrāpayati 5.1.5.tadyadājiṃ dhāvanti |\n", "aśvānavaghrāpayati tadyadājiṃ dhāvanti |\n"), ("agnim īḷe ||31|| iti |\n", "agnim īḷe || iti |\n"),
    ("etābhir jayet |27\n", "etābhir jayet |\n"), ("(1.9) āgnīdhrasyottarata upācāraḥ |\n", "āgnīdhrasyottarata upācāraḥ |\n"), ("atha (agnyādhāna) karma |\n", "atha (agnyādhāna) karma |\n"),
    ("rāmaḥ [lacuna] gacchati |\n", "rāmaḥ gacchati |\n"), ("rāmaḥ [thus with Caland, AZ p. 55, n. 5] gacchati |\n", "rāmaḥ gacchati |\n"),
    ("rāmaḥ [Bhattacharyya edits bhujagainava] gacchati |\n", "rāmaḥ gacchati |\n"), ("āhṛte anne [19.52.1, sakala follows thus PS 1.30.5] ity etayā |\n", "āhṛte anne ity etayā |\n"),
    ("suvīryam [.RV 5.13.5c; 8.98.12c; ;SS 20.108.3c] iti |\n", "suvīryam iti |\n"), ("date: fri, jul 1996 -0600\nrāmaḥ |\n", "\nrāmaḥ |\n"),
    ("-version: 1.0status: rokṣ-status:\nrāmaḥ |\n", "\nrāmaḥ |\n"), ("JaimGS 1.20:\nrāmaḥ |\n", "\nrāmaḥ |\n"),
    ("raver gativiśeṣeṇa nityaśaḥ || **HV App.I,2.7**1:1 ||\n", "raver gativiśeṣeṇa nityaśaḥ ||\n"), ("(1.9) rāmaḥ [lacuna] gacchati ||31||\n", "rāmaḥ gacchati ||\n"),
    *((x, x) for x in (
        "rāmaḥ [yad ucchiṣṭam] gacchati |\n", "rāmaḥ [bskal pa graṅs med pa gsum] gacchati |\n", "% note PS mantra in pratīka?\n", "Chapter 1.20:\n",
        "{{vahnir uvāca} **HV App.I,18.748**78:4}\n", "kule-kule, viris.yate; anyo-'nyaḥ: iti |\n", "ā3 o3m a3 i3 |\n", "rāmaḥ gacchati |\n",
    )),
]
SEPARATORS = [
    ("asmin.vai.loka.ubhaye |\n", "asmin vai loka ubhaye |\n", 3, 0), ("anitam.(?).bhavati |\n", "anitam (?) bhavati |\n", 2, 0),
    ("śraddhād.(.eva.asya.).satya |\n", "śraddhād (.eva.asya.) satya |\n", 2, 0), ("deva.[foo.bar].gacchati rāma.{x.y}.vadati indra.<a.b>.eti |\n", "deva [foo.bar] gacchati rāma {x.y} vadati indra <a.b> eti |\n", 6, 0),
    (".pra.vo.vājā |\n", "pra vo vājā |\n", 3, 0), ("tvam.hy.agne.manotā.\n", "tvam hy agne manotā\n", 4, 0), ("ṛV 6.28.\n", "ṛV 6.28.\n", 0, 0), ("1.2.3 iti |\n", "1.2.3 iti |\n", 0, 0),
    ("yājyā.|.viśve.devāḥ |\n", "yājyā | viśve devāḥ |\n", 3, 0), ("agnim.na (soma: sāvitra.graha.etc.) |\n", "agnim na (soma: sāvitra.graha.etc.) |\n", 1, 0), ("foo. anitam.(?).bhavati |\n", "foo. anitam (?) bhavati |\n", 2, 1),
]
HYPHENS = [
    ("kule-kule anyo-'nyaḥ |\n", "kule kule anyo 'nyaḥ |\n"), ("pāda- śaucād |\n", "pāda śaucād |\n"), ("yo '-pūrva |\n", "yo 'pūrva |\n"),
    ("indriyārtha-\nsvarūpa-mahasaiva nipīta-bheda-\n", "indriyārtha\nsvarūpa mahasaiva nipīta bheda\n"), ("-praveṇī-kuthakāstṛtam\n", "-praveṇī kuthakāstṛtam\n"),
    ("yac cāpi yatnā-''dṛta-mantra-vṛttir |\n", "yac cāpi yatnā''dṛta mantra vṛttir |\n"), ("1901-1905 foo--bar |\n", "1901-1905 foo--bar |\n"), ("deva (foo-bar) gacchati |\n", "deva (foo-bar) gacchati |\n"),
    ("kule-kule pāda- śaucād yo '-pūrva yatnā-''dṛta 1901-1905", "kule kule pāda śaucād yo 'pūrva yatnā''dṛta 1901-1905"),
]
PLUTA = [
    ("ā3 ī3 ū3 ṝ3 ḹ3 iti |\n", "ā ī ū ṝ ḹ iti |\n", 5, 0), ("e3 o3 iti |\n", "e o iti |\n", 2, 0), ("ai3 au3 iti |\n", "ai au iti |\n", 2, 0), ("o3m ity ācāryāḥ |\n", "om ity ācāryāḥ |\n", 1, 0),
    ("yātayāmāḥ saṃvatsarā3 ayātayāmā3 iti |\n", "yātayāmāḥ saṃvatsarā ayātayāmā iti |\n", 2, 0), ("a3 i3 u3 ṛ3 ḷ3 iti |\n", "a3 i3 u3 ṛ3 ḷ3 iti |\n", 0, 5), ("á3 iti |\n", "á3 iti |\n", 0, 1),
    ("ā́3 iti |\n", unicodedata.normalize("NFC", "ā́ iti |\n"), 1, 0), ("a\u03043 iti |\n", "ā iti |\n", 1, 0), ("nā3 a3 nū3 u3 iti |\n", "nā a3 nū u3 iti |\n", 2, 2),
    ("1.2.3.\n||31||\n(18.15)\n3050101athāto vapānāṃ homaḥ\n",) * 2 + (0, 0), ("10a3 P.10a3 A_a3 |\n",) * 2 + (0, 0), ("rāmaḥ [ā3 a3] (ī3 i3) {ū3 u3} <o3 a3> gacchati |\n",) * 2 + (0, 0),
]
CANONICAL = [
    ("devaś  ca", "devaś ca"), ("devaś ca rāmaś ca", "devaś ca rāmaś ca"), ("devo'pi", "devo'pi"), ("rāmaśca", "rāmaśca"), ("devaḥ 12 gacchati", "devaḥ gacchati"), ("devaḥ।", "devaḥ|"),
    ("01,000.000*0001_01\tdevaś ca", "devaś ca"), ("01,002.126d*0128_01(127ab)\tkarṇaḥ", "karṇaḥ"), ("(GBr_1,1.1a) rāmaś ca", "rāmaś ca"), ("AB 1.1a/ devo'pi", "devo'pi"), ("div1 agniḥ //143//", "agniḥ ||"),
    ("KAZ01.1.01| arthaḥ || GarP_1,1.1 ||", "arthaḥ ||"), ("padaṃ ||43|||", "padaṃ ||"), ("nested ||57|| || ManGS_1,1. ||", "nested ||"), ("suffix // ManGS_1,1. 17 //", "suffix ||"), ("(GBr_col) samāptam", "samāptam"),
    ("adhvaryo3.ity.āmantritaḥ |",) * 2, ("**** **** ratham āruhya",) * 2, ("**** **** **** ****",) * 2, ("[BhP  10.29.41] iti text", "iti text"), ("001.001. devaś ca", "devaś ca"),
    ("BJ_01.01a/.mūrtitve parikalpitaḥ aśeṣaṃ jagat//(śā.vi)", "mūrtitve parikalpitaḥ aśeṣaṃ jagat||(śā.vi)"), ("deva☃ gacchati aͯ", "deva☃ gacchati aͯ"),
    ("text [RV 10.42/43/44.11a, PS_15.11.1/16.8.11a]", "text [RV 10.42|43|44.11a, PS_15.11.1|16.8.11a]"), ("01,002.126d*0128_01(127ab) text // ManGS_1,1. 17 //", "text ||"),
]


@pytest.mark.parametrize(("text", "expected", "counts"), MECHANICAL)
def test_mechanical(text, expected, counts):
    after, found = P.mechanical(text)
    assert after == expected
    assert {k: found[k] for k in counts} == counts


@pytest.mark.parametrize(("text", "expected"), EDITORIAL)
def test_editorial(text, expected):
    assert P.editorial(text)[0] == expected


def test_editorial_counts():
    assert set(P.editorial("(1.9) rāmaḥ [lacuna] gacchati ||31||\n")[1]) == {"leading_parenthesized_locator_removed", "square_editorial_removed", "double_danda_number_removed"}


@pytest.mark.parametrize(("text", "expected", "auto", "review"), SEPARATORS)
def test_separators(text, expected, auto, review):
    after, counts = P.separated(text)
    assert after == expected
    by = lambda kind: sum(n for rule, n in counts.items() if rule.startswith(kind))
    assert (by("AUTO"), by("REVIEW")) == (auto, review)


@pytest.mark.parametrize(("text", "expected"), HYPHENS)
def test_hyphens(text, expected):
    assert P.dehyphenated(text)[0] == expected


def test_hyphen_rules():
    assert P.dehyphenated("siddhāsanam-\n", line_ends=False)[0] == "siddhāsanam-\n"
    assert P.dehyphenated("kule-kule pāda- śaucād yo '-pūrva yatnā-''dṛta 1901-1905")[1] == {
        "general_separator_to_space": 1, "redundant_hyphen_before_space_removed": 1, "apostrophe_hyphen_removed": 1, "hyphen_before_apostrophe_sequence_removed": 1, "NON_SEPARATOR": 1,
    }
    assert P.dehyphenated("a-\nb-c d-\n")[1]["trailing_hyphen_at_line_end_removed"] == 2
    for line, want in {
        "kule-kule": ("SEPARATOR", "lexical_to_lexical"), "anyo-'nyaḥ": ("SEPARATOR", "to_avagraha_lexical"), "1901-1905": ("NON_SEPARATOR", "adjacent_digit"), "foo--bar": ("NON_SEPARATOR", "repeated_hyphen"),
        "deva (foo-bar) gacchati": ("NON_SEPARATOR", "inside_protected_span"), "(foo)-bar": ("SEPARATOR", "protected_to_lexical"), "foo - bar": ("REVIEW", "adjacent_whitespace"), "-foo": ("REVIEW", "line_edge"),
    }.items():
        assert {(m.decision, m.reason) for m in P.hyphen_marks(line)} == {want}


@pytest.mark.parametrize(("text", "expected", "auto", "review"), PLUTA)
def test_pluta(text, expected, auto, review):
    after, counts = P.without_pluta(text)
    assert after == expected
    assert (counts["AUTO"], counts["REVIEW"]) == (auto, review)


@pytest.mark.parametrize(("text", "expected"), CANONICAL)
def test_canonical(text, expected):
    after, _ = P.canonical(text)
    assert after == expected and P.canonical(after)[0] == after


def test_laterals_and_closure():
    after, counts = P.lateral_to_d("īḷe iḷā puroḷāśa aḷha kḷha kḷpta ḷ ḷh")
    assert after == "īḍe iḍā puroḍāśa aḍha kḍha kḷpta ḷ ḷh" and counts == {"l_to_d": 3, "lh_to_dh": 2}
    dirty = "\r\n  a\u0304  text||next  \r\n|\r||\r\n | second\r\n||third\r\n\r\n\r\nlast |end\r\n"
    after, counts, rounds = P.to_fixed_point(dirty, P.close_once)
    assert after == "ā text || next\nsecond\n|| third\n\nlast | end\n" and rounds == 2
    assert counts == {"unicode_nfc": 1, "standalone_single_danda_lines_removed": 1, "standalone_double_danda_lines_removed": 1, "line_start_single_danda_removed": 1}
    after, counts, rounds = P.to_fixed_point("| | text\n", P.close_once)
    assert after == "text\n" and rounds == 3 and counts["line_start_single_danda_removed"] == 2
    with pytest.raises(RuntimeError, match="did not reach a fixed point"):
        P.to_fixed_point("| text\n", P.close_once, rounds=1)
    assert P.closed("\n rāma  nara||deva \r\n|\r\n")[0] == "rāma nara || deva\n"


def test_projection():
    after, counts = P.projected("Devo 'pi, agni-kāryam | 01naraḥ")
    assert after == "devo 'pi agnikāryam | naraḥ" and counts["textual_sanskrit_uppercase_lowered"] == 1
    assert P.projected("rāma | English apparatus qxz 12 | devo 'pi |")[0] == "rāma | | devo 'pi |"
    assert P.projected("Śivo 'pi; rāmaḥ (variant 12) [ed. X] agni-kāryam\r\n")[0] == "śivo 'pi rāmaḥ agnikāryam\n"
    after, _ = P.projected("Va.1.1 atha^atas^puruṣa.niḥśreyasam ||")
    assert after == "atha atas puruṣa niḥśreyasam ||"
    assert P.valid_avagraha("devo 'pi |", 5) and P.valid_avagraha("mano'nusāriṇaḥ", 4)
    for text in ("'rāma", "rāma 'iti", "devo ''pi", "devo ' pi"):
        assert not P.valid_avagraha(text, text.index("'"))


def test_frames(spark):
    docs = spark.createDataFrame([(1, "k rāma k\nx k"), (2, None), (3, "")], "doc_id long, text string")
    keep = spark.createDataFrame([(1, 2, "k")], "doc_id long, line_no int, token string")
    got = {r.doc_id: r.text for r in C.delete_unlisted(docs, keep, "^k$").collect()}
    assert got == {1: "rāma\nx k", 3: ""}
    done = C.cleaned(docs, "projection")
    assert {r.rule for r in C.rule_counts(done).collect()} == {"editorial_unit_removed"} and C.change_rows(done).count() == 1
    lines = spark.createDataFrame([(1, "TITLE of it\n\nhead\n\nx\nhead\n\nRV\n\nRV = XU\nhead\n")], "doc_id long, text string")
    assert {(r.line, r.rule) for r in C.structure_lines(lines).collect()} == {("TITLE of it", "title"), ("head", "repeated_header"), ("RV", "siglum"), ("RV = XU", "siglum")}
    assert [r.text for r in C.without_lines(lines, C.structure_lines(lines)).collect()] == ["\n\n\n\nx\n\n\n\n\n\n\n"]


def test_occurrence_frames(spark):
    docs = spark.createDataFrame([(1, "kule-kule 1-2 x - y\n" + "a-b " * 30), (2, None), (3, "ā3 a3 iti"), (4, "10a3")], "doc_id long, text string")
    seen = C.mark_rows(docs, "hyphens").groupBy("doc_id", "decision").count().collect()
    assert {(r.doc_id, r.decision): r["count"] for r in seen} == {(1, "SEPARATOR"): 31, (1, "NON_SEPARATOR"): 1, (1, "REVIEW"): 1}
    gate = C.hyphen_candidates(C.mark_rows(docs, "hyphens")).collect()
    assert [(r.doc_id, r.hyphens, r.separators, r.candidate) for r in gate] == [(1, 33, 31, False)]
    assert [r.doc_id for r in C.without_marked(docs, "pluta").orderBy("doc_id").collect()] == [1, 2, 4]
