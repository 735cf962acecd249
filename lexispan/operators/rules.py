"""Boundary-rewrite rules as a small table, and the joins between rules and words.

A rule says that a word's end `left` and the next word's start `right` are written
`surface`; a # in it is a boundary that survives as a space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.functions.phonology import LONGEST_FIRST

SCHEMA = "rule_id string, left string, right string, surface string, variant int, status string, ord int"
# Sound classes of the grammars.
VOICED = ("g", "gh", "j", "jh", "ḍ", "ḍh", "d", "dh", "b", "bh", "n", "m", "y", "r", "l", "v", "h")
LONG = {"a": "ā", "i": "ī", "u": "ū"}


def seed_rules() -> list[tuple[str, str, str, str, int, str, int]]:
    """A small inventory derived from the classes above; any other table of this shape serves as well."""
    out: list[tuple[str, str, str, int]] = [("aḥ", "a", "o'", 1)]
    for x, long in LONG.items():
        out += [(a, b, long, 1) for a in (x, long) for b in (x, long)]
    for a in ("a", "ā"):
        out += [(a, b, y, 1) for b, y in (("i", "e"), ("ī", "e"), ("u", "o"), ("ū", "o"), ("e", "ai"), ("ai", "ai"), ("o", "au"), ("au", "au"))]
    for a, glide in (("i", "y"), ("ī", "y"), ("u", "v"), ("ū", "v")):
        out += [(a, b, glide + b, 1) for b in ("a", "ā", "e", "o") if LONG.get(a) != b]
    out += [("e", "a", "e'", 1), ("o", "a", "o'", 1)]
    out += [("aḥ", c, f"o#{c}", 1) for c in VOICED] + [("āḥ", c, f"ā#{c}", 1) for c in VOICED]
    out += [("m", c, f"ṃ#{c}", 1) for c in ("k", "g", "c", "j", "t", "d", "p", "b", "y", "r", "l", "v", "ś", "ṣ", "s", "h")]
    out += [("t", b, f"d#{b}", 1) for b in ("a", "ā", "i", "u", "e", "g", "d", "b", "y", "v")] + [("t", "c", "c#c", 1), ("t", "j", "j#j", 1), ("t", "ś", "c#ch", 1), ("t", "ś", "t#ś", 2)]
    out += [(x, y, f"{x}#{y}", 1) for x in ("a", "i", "u", "m", "n", "ḥ") for y in ("p", "t", "k")] + [("an", "a", "ann#a", 1)]
    seen, rules = set(), []
    for left, right, surface, variant in out:
        if (left, right, surface) not in seen:
            seen.add((left, right, surface))
            rules.append((f"S_{len(rules) + 1:04d}", left, right, surface, variant, "active", len(rules)))
    return rules


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_rules(), SCHEMA)


def rule_problems(rules: DataFrame) -> DataFrame:
    """(rule_id, problem): repeated ids and transitions, empty sides, variants below 1, placeholders and bars."""
    n_id, n_move = F.count(F.lit(1)).over(Window.partitionBy("rule_id")), F.count(F.lit(1)).over(Window.partitionBy("left", "right", "surface", "variant"))
    every = F.concat("left", "right", "surface")
    phonemes = f"^(?:{'|'.join(LONGEST_FIRST)}|['#])+$"
    problem = (
        F.when(n_id > 1, "repeated id").when(n_move > 1, "repeated transition").when((F.length("left") == 0) | (F.length("right") == 0) | (F.length("surface") == 0), "empty")
        .when(F.col("variant") < 1, "variant").when(every.contains("|"), "bar").when(every.rlike("[<>{}_]"), "placeholder")
        .when(F.length(F.regexp_replace("surface", "[^#]", "")) > 1, "two boundaries").when(~every.rlike(phonemes), "no phoneme")
    )
    return rules.withColumn("problem", problem).where("problem is not null").select("rule_id", "problem")


def boundary_matches(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that fit at the boundary of (left_word, right_word), those of the longest total match only; ties are kept.

    Joined on the letters that meet, so the small rule table is broadcast and no pair
    sees rules that can't fit.
    """
    r = F.broadcast(rules.select("rule_id", "left", "right", "surface", "variant", "ord", F.right("left", F.lit(1)).alias("_l"), F.left("right", F.lit(1)).alias("_r")))
    keyed = pairs.withColumn("_l", F.right("left_word", F.lit(1))).withColumn("_r", F.left("right_word", F.lit(1)))
    fits = keyed.join(r, ["_l", "_r"]).where(F.endswith("left_word", "left") & F.startswith("right_word", "right"))
    span = F.length("left") + F.length("right")
    best = fits.withColumn("span", span).withColumn("_k", F.rank().over(Window.partitionBy("left_word", "right_word").orderBy(F.desc("span"))))
    return best.where("_k = 1").drop("_k", "_l", "_r")


def realized(matches: DataFrame) -> DataFrame:
    """Adds `written`: the two words as the rule writes them, a surviving boundary as a space."""
    head = F.substr("left_word", F.lit(1), F.length("left_word") - F.length("left"))
    tail = F.substr("right_word", F.length("right") + 1)
    return matches.withColumn("written", F.concat(head, F.translate("surface", "#", " "), tail))


def pair_lookup(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of exactly (left, right), in the table's order."""
    return pairs.join(F.broadcast(rules), ["left", "right"])


def surface_matches(surfaces: DataFrame, rules: DataFrame, *, key: str = "surface_text") -> DataFrame:
    """(key, start, end, rule_id, left, right): every place where a rule's written form occurs, overlaps included.

    All substrings up to the longest rule meet the rules by an equi-join.
    """
    written = rules.select("rule_id", "left", "right", "ord", F.translate("surface", "#", " ").alias("piece"))
    longest = rules.agg(F.max(F.length("surface"))).first()[0] or 0
    starts = surfaces.select(key, F.explode(F.sequence(F.lit(0), F.length(key) - 1)).alias("start")).where(F.length(key) > 0)
    places = starts.select(key, "start", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("_n")).where(F.col("start") + F.col("_n") <= F.length(key))
    pieces = places.withColumn("piece", F.substr(key, F.col("start") + 1, F.col("_n"))).withColumn("end", F.col("start") + F.col("_n"))
    return pieces.join(F.broadcast(written), "piece").select(key, "start", "end", "rule_id", "left", "right", "ord")


def inverse_pairs(matches: DataFrame, *, key: str = "surface_text") -> DataFrame:
    """(key, left_word, right_word): the word pairs that could lie behind a surface; a pair that several rules give is listed once."""
    head, tail = F.substr(key, F.lit(1), F.col("start")), F.substr(key, F.col("end") + 1)
    pairs = matches.select(key, F.concat(head, "left").alias("left_word"), F.concat("right", tail).alias("right_word"), "start", "ord")
    return pairs.where("left_word <> '' and right_word <> ''").groupBy(key, "left_word", "right_word").agg(F.min(F.struct("start", "ord")).alias("_o")).select(key, "left_word", "right_word")
