"""The phoneme codec as columns, and the functions by name for SQL text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.functions import syllables


def encode_sql(c: str) -> str:
    """SQL for the character of an ARPAbet name."""
    every = {n: code for code, n in ph.NAMES.items()} | {v: ph.CODES[v] for v in ph.VOWELS}
    cases = " ".join(f"WHEN '{n}' THEN '{code}'" for n, code in every.items())
    base = f"CASE WHEN length({c}) >= 3 AND {c} RLIKE '[0-9]$' AND NOT {c} RLIKE '^[AEIOU].[012]$' THEN left({c}, length({c}) - 1) ELSE {c} END"
    return f"CASE {base} {cases} ELSE '{ph.INVALID}' END"


def encode(column: str) -> Column:
    """The character of an ARPAbet name, ``!`` for anything else."""
    return F.expr(encode_sql(column))


def encode_all(column: str) -> Column:
    """The encoded pronunciation of an array of names."""
    return F.expr(f"array_join(transform({column}, x -> {encode_sql('x')}), '')")


def is_valid(column: str) -> Column:
    return encode(column) != ph.INVALID


def is_valid_base(column: str) -> Column:
    """Validity without one trailing digit, whatever it follows."""
    return F.regexp_replace(F.col(column), "[0-9]$", "").isin(list(ph.CODES))


def decode_all(column: str) -> Column:
    """Space-joined names of an encoded pronunciation."""
    return F.expr(ph.arpabet(column))


#: Functions that SQL text can name once registered: parameters and body. They unfold into built-in expressions.
SQL_FUNCTIONS = {
    "phoneme_encode": ("name STRING", "STRING", encode_sql("name")),
    "phoneme_decode": ("codes STRING", "STRING", ph.arpabet("codes")),
    "phoneme_strip": ("codes STRING", "STRING", ph.strip_stress("codes")),
    "phoneme_syllables": ("codes STRING", "INT", ph.syllable_count("codes")),
    "phoneme_stresses": ("codes STRING", "STRING", ph.stress_digits("codes")),
    "phoneme_tail": ("codes STRING", "STRING", ph.index_tail("codes")),
    "phoneme_drop_g": ("codes STRING", "STRING", ph.drop_g("codes")),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL text of this session; their names."""
    for name, (given, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    spark.udf.register("syllable_split", syllables.split_udf)
    spark.udf.register("syllable_display", syllables.display_udf)
    return [*SQL_FUNCTIONS, "syllable_split", "syllable_display"]


__all__ = ["SQL_FUNCTIONS", "decode_all", "encode", "encode_all", "encode_sql", "is_valid", "is_valid_base", "register"]
