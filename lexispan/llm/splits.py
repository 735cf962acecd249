"""Splits that keep related records together.

Documents that share a credit are tied.  A credit is a node like a document is, so
a credit with millions of documents costs as many links as it has documents and
never their pairs.  Components come from Hash-to-Min: every node holds a cluster;
in each round it sends the cluster to the cluster's least node and that least node
to all of the cluster.  A cluster is kept as rows (node, member), never as one
list.  Components then go to splits by weighted rendezvous hashing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.functions.labels import plain_label
from lexispan.functions.letters import letters_list
from lexispan.session import cut, drop_cut

#: An entry only says that the author is not known if, in the letters of its words, nothing but these stands in it:
#: at least one that says so, and any number of words for persons and small words, in any order.
_SAYS_SO = (
    "anon(ym[a-z]*)?", "[a-z]*(ajnat|avijnat|agnat)[a-z]*", "unknown", "unbekannt[a-z]*", "unattributed", "unidentified", "unnamed", "unspecified", "unsigned", "uncertain",
    "incert[a-z]*", "ignot[a-z]*", "not", "no", "non", "none", "null", "nil", "nn", "n n", "sn", "s n", "na", "n a", "nescio", "missing", "without", "various", "ohne", "nicht",
)
_FILLER = (
    "the", "a", "an", "of", "is", "are", "by", "or", "und", "and", "der", "die", "des", "ein", "known", "given", "stated", "recorded", "identified", "named", "bekannt", "genannt",
    "author[a-z]*", "autor[a-z]*", "auctor[a-z]*", "poet[a-z]*", "writer[a-z]*", "verfasser[a-z]*", "scribe[a-z]*", "composer[a-z]*", "sage", "person[a-z]*", "name[a-z]*",
    "kavi[a-z]*", "kart[a-z]*", "kara", "kavih", "hand", "source", "traditional",
)
UNKNOWN = rf"^((({'|'.join(_FILLER)}) )*({'|'.join(_SAYS_SO)}))( ({'|'.join((*_SAYS_SO, *_FILLER))}))*$"
UNKNOWN_COMPOUND = r"^(author|autor|poet)?(unknown|anonym|unbekannt|notknown)[a-z]*(author|autor|poet|kavi|kartr)?[a-z]?$"

SPLITS = (("train", 0.8), ("dev", 0.1), ("test", 0.1))


@F.pandas_udf(T.StringType())
def words_of(texts: pd.Series) -> pd.Series:
    """The letters of each word of a text, with a space between words; see lexispan.functions.letters."""
    parts = [re.split(r"[^\w\u0300-\u036f\u0900-\u0963\u200c\u200d]+|_", x) if isinstance(x, str) else [] for x in texts]
    flat = iter(letters_list([w for p in parts for w in p]))
    return pd.Series([" ".join(w for w in [next(flat) for _ in p] if w) for p in parts], dtype=object)


def document_ties(credits: DataFrame, *, kinds: tuple[str, ...] = ("author", "work"), unknown_kinds: tuple[str, ...] = ("author",)) -> DataFrame:
    """(document_id, credit): the credits that tie documents, named by kind and the letters of the name.

    Rows with a null document, kind or name, of another kind, without letters in the
    name, or (of `unknown_kinds`) that only say that the author is not known are left
    out; repeats count once.
    """
    rows = credits.select("document_id", plain_label(F.col("kind")).alias("kind"), "name").where(
        F.col("document_id").isNotNull() & F.col("kind").isin(*kinds) & F.col("name").isNotNull()
    )
    letters = F.replace("words", F.lit(" "))
    nobody = F.col("kind").isin(*unknown_kinds) & (F.col("words").rlike(UNKNOWN) | letters.rlike(UNKNOWN_COMPOUND))
    named = rows.withColumn("words", words_of("name")).where((F.col("words") != "") & ~nobody).withColumn("letters", letters)
    return named.select("document_id", F.concat_ws(":", "kind", "letters").alias("credit")).distinct()


def _with_least(clusters: DataFrame, size: int, hot: int) -> DataFrame:
    """(least, member): every row of a cluster with the least member of its node.

    Nodes with more than `hot` rows (there are at most size / hot) aren't shuffled
    again: their least members are broadcast to where their rows lie.
    """
    least = clusters.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n"))
    if size <= hot:
        return clusters.join(least, "node").select("least", "member")
    least = cut(least)
    large, small = F.broadcast(least.where(F.col("n") > hot)), least.where(F.col("n") <= hot)
    there = clusters.join(large, "node").select("least", "member")
    return there.unionByName(clusters.join(large, "node", "left_anti").join(small, "node").select("least", "member"))


def hash_to_min(links: DataFrame, left: str, right: str, *, max_rounds: int = 60, hot: int = 100_000) -> DataFrame:
    """(node, component) of the graph with the given links; component is the least node of it.

    Nodes are strings, least in code point order.  Rows with a null end are left
    out; loops make a node of its own.  Each round is written to the shared folder,
    so lineage doesn't grow and a lost executor costs one task.
    """
    links = links.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    a, b = F.col(left), F.col(right)
    start = links.select(a.alias("node"), b.alias("member")).union(links.select(b.alias("node"), a.alias("member")))
    own = start.select("node", F.col("node").alias("member"))
    clusters = cut(start.union(own).distinct())
    size = clusters.count()
    for _ in range(max_rounds):
        sent = _with_least(clusters, size, hot)
        following = cut(sent.select(F.col("least").alias("node"), "member").union(sent.select(F.col("member").alias("node"), F.col("least").alias("member"))).distinct())
        # Stable if nothing moved: as many rows as before, all of which were there.
        new_size = following.count()
        stable = new_size == size and following.join(clusters, ["node", "member"], "left_anti").isEmpty()
        drop_cut(clusters)
        clusters, size = following, new_size
        if stable:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def document_groups(ties: DataFrame) -> DataFrame:
    """(document_id, group_id) of the tied documents: group_id is the smallest document_id of the group."""
    # A mark before credits keeps them after all documents in the order of nodes.
    nodes = ties.select(F.concat(F.lit("0"), "document_id").alias("document"), F.concat(F.lit("1"), "credit").alias("credit"))
    found = hash_to_min(nodes, "document", "credit").where(F.col("node").startswith("0"))
    return found.select(F.substr("node", F.lit(2)).alias("document_id"), F.substr("component", F.lit(2)).alias("group_id"))


def valid_manifest(manifest: DataFrame) -> DataFrame:
    """(document_id, source, split) of the row with the latest built_at of each document; split as a plain label.

    Of rows with the same time the one with the greatest (split, source) counts; rows without document_id are left out.
    """
    rows = manifest.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max(F.struct("built_at", "split", "source")).alias("row"))
    return rows.select("document_id", F.col("row.source").alias("source"), plain_label(F.col("row.split")).alias("split"))


def torn_groups(manifest: DataFrame, credits: DataFrame) -> DataFrame:
    """(document_id, group_id) of every document of each group in which the recorded splits are more than one; a null split counts as none."""
    groups = cut(document_groups(document_ties(credits)))
    recorded = groups.join(valid_manifest(manifest), "document_id")
    torn = recorded.groupBy("group_id").agg(F.min("split").alias("least"), F.max("split").alias("most")).where("least <> most").select("group_id")
    return groups.join(torn, "group_id").select("document_id", "group_id")


def rendezvous(key: Column, weights: dict[str, float], seed: str) -> Column:
    """The split with the highest weighted score for the key: -weight / ln(u), u from a hash of (seed, split, key)."""
    scores = []
    for name, weight in weights.items():
        unit = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}|{name}|"), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-weight) / F.ln(unit)).alias("score"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scores))["name"] if len(scores) > 1 else scores[0]["name"]


def all_groups(manifest: DataFrame, credits: DataFrame) -> DataFrame:
    """(document_id, group_id, group_size) of every document of the manifest; untied documents are groups of their own."""
    documents = valid_manifest(manifest).select("document_id")
    ties = document_groups(document_ties(credits))
    grouped = cut(documents.join(ties, "document_id", "left").withColumn("group_id", F.coalesce("group_id", "document_id")))
    return grouped.join(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")), "group_id").select("document_id", "group_id", "group_size")


def grouped_splits(manifest: DataFrame, credits: DataFrame, *, splits: tuple[tuple[str, float], ...] = SPLITS, seed: str = "lexispan", big: float = 0.05) -> DataFrame:
    """(document_id, group_id, group_size, split) of every document of the manifest, with one split for each group.

    Weights are shares of documents.  A component of more than `big` of all documents
    could spoil a small split, so such components (there are fewer than 1 / `big`)
    are dealt, largest first, to the split that lacks most, and the rest goes by
    weighted rendezvous hashing with what each split then still lacks.  Untied
    documents are groups of their own.  An empty manifest gives no rows.
    """
    grouped = cut(all_groups(manifest, credits))
    sizes = grouped.select("group_id", "group_size").distinct()
    total = grouped.count()
    lacking = {name: share * total for name, share in splits}
    dealt: dict[str, str] = {}
    for row in sizes.where(F.col("group_size") > big * total).orderBy(F.desc("group_size"), "group_id").collect():
        name = max(lacking, key=lambda k: lacking[k])
        dealt[row["group_id"]] = name
        lacking[name] -= row["group_size"]
    weights = {k: v for k, v in lacking.items() if v > 0} or dict(splits)
    split = rendezvous(F.col("group_id"), weights, seed)
    for group, name in dealt.items():
        split = F.when(F.col("group_id") == group, name).otherwise(split)
    return grouped.select("document_id", "group_id", "group_size", split.alias("split"))


def segment_splits(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """(segment_id, document_id, split): every segment takes the split of its document; without one in the manifest it is null."""
    ids = segments.where(F.col("segment_id").isNotNull()).select("segment_id").distinct()
    return ids.withColumn("document_id", F.substring_index("segment_id", ":", 1)).join(documents.select("document_id", "split"), "document_id", "left")


