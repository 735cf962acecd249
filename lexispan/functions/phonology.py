"""Phonemes of a form: keys that don't depend on script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phoneme ids and their IAST spellings.
PHONEMES = {
    "V_A": "a", "V_AA": "ā", "V_I": "i", "V_II": "ī", "V_U": "u", "V_UU": "ū", "V_R": "ṛ", "V_RR": "ṝ", "V_L": "ḷ", "V_LL": "ḹ",
    "V_E": "e", "V_AI": "ai", "V_O": "o", "V_AU": "au",
    "C_K": "k", "C_KH": "kh", "C_G": "g", "C_GH": "gh", "C_NG": "ṅ", "C_C": "c", "C_CH": "ch", "C_J": "j", "C_JH": "jh", "C_NY": "ñ",
    "C_TT": "ṭ", "C_TTH": "ṭh", "C_DD": "ḍ", "C_DDH": "ḍh", "C_NN": "ṇ", "C_T": "t", "C_TH": "th", "C_D": "d", "C_DH": "dh", "C_N": "n",
    "C_P": "p", "C_PH": "ph", "C_B": "b", "C_BH": "bh", "C_M": "m", "C_Y": "y", "C_R": "r", "C_L": "l", "C_V": "v",
    "C_SH": "ś", "C_SS": "ṣ", "C_S": "s", "C_H": "h",
    "M_ANUSVARA": "ṃ", "M_VISARGA": "ḥ", "M_ANUNASIKA": "m̐",
}
OF_IAST = {v: k for k, v in PHONEMES.items()}
LONGEST_FIRST = tuple(sorted(OF_IAST, key=len, reverse=True))
LAYERS = {"1_veda": "veda", "2_epic": "epic", "3_purana": "purana", "4_rellit": "rellit", "5_poetry": "poetry", "6_sastra": "sastra"}
LAYER_WEIGHTS = {"veda": 0.8, "epic": 1.0, "poetry": 1.0, "sastra": 1.0}
OTHER_WEIGHT = 0.7


def phoneme_ids(form: Column) -> Column:
    """Phoneme ids of an IAST form by longest match; null if some character is no phoneme."""
    spelled = F.regexp_extract_all(form, F.lit(f"({'|'.join(LONGEST_FIRST)})"), F.lit(1))
    ids = F.create_map(*(F.lit(x) for pair in OF_IAST.items() for x in pair))
    whole = F.array_join(spelled, "") == form
    return F.when(whole & (form != ""), F.transform(spelled, lambda x: F.element_at(ids, x)))


def form_key(form: Column) -> Column:
    """The ids of an IAST form, joined by dots."""
    return F.array_join(phoneme_ids(form), ".")


def key_ids(key: Column) -> Column:
    return F.split(key, r"\.")


def key_iast(key: Column) -> Column:
    """The IAST spelling of a key."""
    spelled = F.create_map(*(F.lit(x) for pair in PHONEMES.items() for x in pair))
    return F.array_join(F.transform(key_ids(key), lambda x: F.element_at(spelled, x)), "")


def key_has_vowel(key: Column) -> Column:
    return F.exists(key_ids(key), lambda x: x.startswith("V_"))


def layer_of(path: Column) -> Column:
    """The layer named by a path's first folder, else other."""
    top = F.element_at(F.split(path, "/"), 1)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair)), top), F.lit("other"))


def layer_weight(layer: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LAYER_WEIGHTS.items() for x in pair)), layer), F.lit(OTHER_WEIGHT))
