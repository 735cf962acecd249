"""Tokenizers with one result shape, and the metrics of their tokens.

An encoding is struct<ids, pieces, starts, ends>: four arrays of equal length, the
spans in characters of the text.  A null text has a null encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECIALS = ("<unk>", "<pad>", "<s>", "</s>")
UNK, PAD, BOS, EOS = range(4)
ENCODING = T.StructType(
    [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]
)


def _encoding(ids: Column, pieces: Column, starts: Column, ends: Column) -> Column:
    return F.struct(ids.alias("ids"), pieces.alias("pieces"), starts.alias("starts"), ends.alias("ends"))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def character_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(piece, id): the specials, then all code points of the texts in order.  At most one row for each code point there is."""
    found = texts.select(F.explode(F.array_distinct(characters(F.col(text)))).alias("piece")).distinct()
    spark = texts.sparkSession
    ranked = found.agg(F.array_sort(F.collect_list("piece")).alias("all")).select(F.posexplode("all").alias("at", "piece")).select("piece", (F.col("at") + len(SPECIALS)).alias("id"))
    return spark.createDataFrame(list(zip(SPECIALS, range(4), strict=True)), "piece string, id int").unionByName(ranked)


def encode_characters(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Adds `encoding`; a character that the vocabulary lacks is unknown.  The vocabulary is one map, bounded by the code points."""
    ids = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("piece", "id"))).alias("_map"))
    chars = characters(F.col(text))
    n = F.size(chars)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    coded = _encoding(F.transform(chars, lambda c: F.coalesce(F.element_at("_map", c), F.lit(UNK))), chars, places, F.transform(places, lambda i: i + 1))
    return texts.crossJoin(F.broadcast(ids)).withColumn("encoding", F.when(F.col(text).isNotNull(), coded)).drop("_map")


def _bytes_of(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None or text != text:
            rows.append((None, None, None, None))
            continue
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        owners = np.cumsum((data & 0xC0) != 0x80) - 1  # a byte that doesn't continue a character begins one
        rows.append(((data.astype(np.int32) + len(SPECIALS)).tolist(), [_BYTE_PIECES[x] for x in data.tolist()], owners.tolist(), (owners + 1).tolist()))
    return pd.DataFrame(rows, columns=["ids", "pieces", "starts", "ends"])


_BYTE_PIECES = [f"<0x{x:02X}>" for x in range(256)]


def byte_encoding(text: Column) -> Column:
    """One token for each byte, 4 and more; its span is the character that it belongs to.  One pass over each text."""
    encoded = F.pandas_udf(ENCODING)(_bytes_of)(text)
    return F.when(text.isNotNull(), encoded)


_BYTE_IDS = [str(x + len(SPECIALS)) for x in range(256)]


def _byte_digests(texts: pd.Series) -> pd.Series:
    return pd.Series([None if text is None or text != text else hashlib.md5(" ".join(map(_BYTE_IDS.__getitem__, text.encode("utf-8"))).encode()).hexdigest() for text in texts], dtype=object)


def byte_id_digest(text: Column) -> Column:
    """MD5 of the ids of byte_encoding, separated by spaces; only one text's ids are in memory at once, and none leave the worker."""
    return F.pandas_udf(_byte_digests, T.StringType())(text)


def _spans(split: Callable[[str], list[str]], ids: Callable[[str], int] | None):
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None or text != text:
                rows.append((None, None, None, None))
                continue
            pieces = split(text)
            starts, at = [], 0
            for p in pieces:
                starts.append(at)
                at += len(p)
            rows.append(([ids(p) for p in pieces] if ids else [UNK] * len(pieces), pieces, starts, [s + len(p) for s, p in zip(starts, pieces, strict=True)]))
        return pd.DataFrame(rows, columns=["ids", "pieces", "starts", "ends"])

    return F.pandas_udf(ENCODING)(run)


def clusters(text: str) -> list[str]:
    """Extended grapheme clusters; a Devanagari conjunct is one."""
    import regex

    return regex.findall(r"\X", text)


def grapheme_encoder(vocabulary: dict[str, int] | None = None):
    """A column function for grapheme clusters; ids from the vocabulary, unknown without one."""
    return _spans(clusters, (lambda p: vocabulary.get(p, UNK)) if vocabulary is not None else None)


def sentencepiece_encoder(model: str):
    """A column function for a SentencePiece model; the model is loaded once by each Python worker."""

    def run(texts: pd.Series) -> pd.DataFrame:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        rows = []
        for text in texts:
            if text is None or text != text:
                rows.append((None, None, None, None))
                continue
            parts = processor.encode(text, out_type="immutable_proto").pieces
            rows.append(([p.id for p in parts], [p.piece for p in parts], [p.begin for p in parts], [p.end for p in parts]))
        return pd.DataFrame(rows, columns=["ids", "pieces", "starts", "ends"])

    return F.pandas_udf(ENCODING)(run)


def build_tokenizer(kind: str, *, texts: DataFrame | None = None, text: str = "text", model: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The tokenizer of a name, fitted on the given texts where it needs them: frame in, frame with `encoding` out."""
    if kind == "character":
        vocabulary = character_vocabulary(texts, text)
        return lambda df: encode_characters(df, text, vocabulary)
    if kind == "byte":
        return lambda df: df.withColumn("encoding", byte_encoding(F.col(text)))
    if kind == "grapheme":
        return lambda df: df.withColumn("encoding", grapheme_encoder()(text))
    if kind == "sentencepiece":
        return lambda df: df.withColumn("encoding", sentencepiece_encoder(model)(text))
    raise ValueError(f"unknown tokenizer: {kind}")


def with_ends(ids: Column, *, bos: bool = True, eos: bool = True) -> Column:
    """Ids between begin and end."""
    parts = [F.array(F.lit(BOS))] * bos + [ids] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def blocks(ids: Column, context: int) -> Column:
    """Every window of context + 1 ids that lies within the sequence."""
    n = F.size(ids) - context
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids, i + 1, F.lit(context + 1)))).otherwise(F.array().cast("array<array<int>>"))


def span_coverage(encoding: Column, length: Column) -> Column:
    """Share of the text's characters that lie in some token."""
    places = F.flatten(F.zip_with(encoding["starts"], encoding["ends"], lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))))
    return F.try_divide(F.size(F.array_distinct(places)), length)


def split_rate(encoding: Column, edges: Column) -> Column:
    """Share of the token bounds inside a text that cut a cluster; `edges` holds the clusters' starts."""
    inner = F.array_distinct(F.filter(F.array_union(encoding["starts"], encoding["ends"]), lambda p: (p > 0) & (p < F.array_max(encoding["ends"]))))
    return F.try_divide(F.size(F.array_except(inner, edges)), F.size(inner))


def token_metrics(encoded: DataFrame, text: str) -> DataFrame:
    """One row: texts, tokens, distinct tokens, characters, tokens per character, mean token length, unknown share."""
    rows = encoded.where(F.col(text).isNotNull())
    flat = rows.select(F.explode(F.arrays_zip("encoding.ids", "encoding.pieces")).alias("t")).select("t.*")
    counts = flat.groupBy("ids", "pieces").agg(F.count(F.lit(1)).alias("n"))
    tokens = counts.agg(F.sum("n").alias("tokens"), F.countDistinct("pieces").alias("types"), F.sum(F.length("pieces") * F.col("n")).alias("piece_chars"), F.sum(F.when(F.col("ids") == UNK, F.col("n")).otherwise(0)).alias("unknown"))
    whole = rows.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length(text)).alias("characters"))
    both = whole.crossJoin(F.broadcast(tokens))
    return both.select("texts", "tokens", "types", "characters", F.try_divide("tokens", "characters").alias("tokens_per_character"), F.try_divide("piece_chars", "tokens").alias("mean_token_length"), F.try_divide("unknown", "tokens").alias("unknown_rate"))


def bits_per_unit(rows: DataFrame, *, nll: str, tokens: str, text: str) -> DataFrame:
    """One row: bits per token, character and byte from summed negative log likelihoods in nats; null over nothing."""
    s = rows.agg(F.sum(nll).alias("nll"), F.sum(tokens).alias("t"), F.sum(F.length(text)).alias("c"), F.sum(F.octet_length(text)).alias("b"))
    bits = F.col("nll") / F.ln(F.lit(2.0))
    return s.select(F.try_divide(bits, "t").alias("bits_per_token"), F.try_divide(bits, "c").alias("bits_per_char"), F.try_divide(bits, "b").alias("bits_per_byte"))


def starts_with_vowel_sign(piece: Column) -> Column:
    """Whether a piece begins with a dependent vowel sign."""
    return piece.rlike("^[ा-ौॢॣ]")


def ends_with_virama(piece: Column) -> Column:
    return piece.endswith("्")


def is_simple_cv(piece: Column) -> Column:
    """One consonant, with or without a vowel sign."""
    return piece.rlike("^[क-ह][ा-ौॢॣ]?$")


def review_categories(piece: Column) -> Column:
    """Why a vocabulary piece deserves a look."""
    plain = F.regexp_replace(piece, "^▁", "")
    return F.array_compact(
        F.array(
            F.when(starts_with_vowel_sign(plain), "starts_with_vowel_sign"), F.when(ends_with_virama(plain), "ends_with_virama"), F.when(is_simple_cv(plain), "simple_cv"),
            F.when(plain.rlike(r"[।॥|]"), "danda"), F.when(plain.rlike(r"[0-9०-९]"), "digit"), F.when(F.length(plain) >= 12, "long"),
        )
    )
