"""Rhyme maps: phoneme n-grams that words of a document repeat, scored and ranked per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.functions import text as tx
from cadenza.operators.prosody import first_pronunciation, with_norm

LONGEST = 4


@dataclass(frozen=True)
class Options:
    """Which patterns stay and how they are scored; max_patterns 0 keeps all."""

    min_count: int = 2
    min_length: int = 2
    min_score: float = 0.0
    max_patterns: int = 50
    length_weight: float = 2.0
    vowel_boost: float = 1.0
    consonant_penalty: float = 0.3
    end_of_line_boost: float = 3.0


def words(lines: DataFrame, lex0: DataFrame) -> DataFrame:
    """Every word of the lines: keys, pos, token, pron (null if unknown), stripped, last (ends its line)."""
    keys = [c for c in lines.columns if c != "text"]
    cut = lines.select(*keys, tx.tokens(F.col("text"), "m").alias("_tokens"))
    toks = cut.select(*keys, F.size("_tokens").alias("_size"), F.posexplode("_tokens").alias("pos", "token"))
    found = first_pronunciation(with_norm(toks, "token", True), lex0)
    return found.select(*keys, "pos", "token", "pron", F.expr(ph.strip_stress("coalesce(pron, '')")).alias("stripped"), (F.col("pos") == F.col("_size") - 1).alias("last"))


def hits(tokens: DataFrame, key: str) -> DataFrame:
    """One row per n-gram occurrence: key, line_no, pos, token, start, ngram, last."""
    grams = F.expr(f"flatten(transform(sequence(1, length(stripped)), s -> transform(sequence(1, least({LONGEST}, length(stripped) - s + 1)), n -> struct(s - 1 AS start, substr(stripped, s, n) AS ngram))))")
    return tokens.where("stripped <> ''").select(key, "line_no", "pos", "token", "last", F.explode(grams).alias("g")).select(key, "line_no", "pos", "token", "last", F.col("g.start").alias("start"), F.col("g.ngram").alias("ngram"))


def _ranked(lines: DataFrame, key: str, lex0: DataFrame, options: Options, members: bool) -> DataFrame:
    """The patterns of each document; with ``members`` the words that take part, gathered while they are counted."""
    o = options
    h = hits(words(lines, lex0), key)
    own = [F.first("token").alias("token"), F.sort_array(F.collect_list("start")).alias("starts")] if members else []
    places = h.groupBy(key, "ngram", "line_no", "pos").agg(F.count("*").alias("n"), F.max("last").alias("last"), *own)
    every = [F.collect_list(F.struct("line_no", "pos", "token", "starts")).alias("members")] if members else []  # of one document
    g = places.groupBy(key, "ngram").agg(F.count("*").alias("count"), F.sum("n").alias("hits"), F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).alias("ends"), *every)
    g = g.where((F.col("count") >= o.min_count) & (F.length("ngram") >= o.min_length))
    anchored = F.substring("ngram", 1, 1).between("A", "O")
    position = 1.0 + F.col("ends") / F.col("hits") * F.lit(o.end_of_line_boost - 1.0)
    raw = F.pow(F.length("ngram").cast("double"), F.lit(o.length_weight)) * F.log2(F.col("count").cast("double")) * F.when(anchored, o.vowel_boost).otherwise(o.consonant_penalty) * position
    g = g.withColumn("score", F.round(raw * 10000) / 10000).where(F.col("score") >= o.min_score)
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("count"), "ngram")
    g = g.withColumn("pattern_id", F.row_number().over(order) - 1)
    if o.max_patterns:
        g = g.where(F.col("pattern_id") < o.max_patterns)
    return g.withColumn("is_vowel_anchored", anchored).withColumn("length", F.length("ngram"))


def patterns(lines: DataFrame, key: str, lex0: DataFrame, options: Options = Options()) -> DataFrame:
    """key, pattern_id, ngram, length, count, score, is_vowel_anchored: the patterns of each document by score, count and n-gram."""
    named = F.expr(f"replace({ph.arpabet('ngram')}, ' ', '-')")
    return _ranked(lines, key, lex0, options, False).select(key, "pattern_id", named.alias("ngram"), "length", "count", "score", "is_vowel_anchored", F.col("ngram").alias("code"))


def highlights(lines: DataFrame, key: str, lex0: DataFrame, options: Options = Options()) -> DataFrame:
    """key, line_no, pos, token, pattern_id, start, length: where each word takes part in a pattern."""
    g = _ranked(lines, key, lex0, options, True).select(key, "pattern_id", "length", F.explode("members").alias("m"))
    return g.select(key, "m.line_no", "m.pos", "m.token", "pattern_id", F.explode("m.starts").alias("start"), "length")
