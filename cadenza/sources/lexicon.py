"""Pronouncing dictionaries in the CMU text format as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.phonemes import encode_all

SEED = os.path.join(os.path.dirname(__file__), "seed_lexicon.txt")
SCHEMA = "word string, variant int, pron string"
#: Entries up to which the lexicon is broadcast (the full public dictionary has about 135,000; a row is under 100 bytes).
BROADCAST_ENTRIES = 1_000_000


def parse(lines: Iterable[str]) -> list[tuple[str, int, str]]:
    """(word in upper case, variant from 0 in file order, encoded pronunciation).

    Empty lines and ``;`` comments are skipped, as are lines without a blank. The word ends at the first double
    blank, else the first blank; ``(n)`` is cut from it. A trailing ``# comment`` is dropped.
    """
    count: dict[str, int] = {}
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip("\r")
        if not line.strip() or line.startswith(";"):
            continue
        word, gap, pron = line.partition("  ") if "  " in line else line.partition(" ")
        if not gap:
            continue
        word = re.sub(r"\(\d+\)$", "", word.strip()).upper()
        phonemes = pron.partition("#")[0].split()
        out.append((word, count.get(word, 0), encode_all(phonemes)))
        count[word] = count.get(word, 0) + 1
    return out


def seed() -> list[tuple[str, int, str]]:
    with open(SEED, encoding="utf-8") as f:
        return parse(f)


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The lexicon of a CMU text file that Spark can read, or the seed. Variants follow the file's order, so the
    file (a few megabytes) is parsed in one place."""
    if path is None:
        return spark.createDataFrame(seed(), SCHEMA)
    lines = [r.value for r in spark.read.text(path, wholetext=True).select(F.col("value")).collect()]
    return spark.createDataFrame(parse("\n".join(lines).split("\n")), SCHEMA)


def save(lexicon: DataFrame, path: str) -> None:
    """The lexicon as Parquet; ``read`` gives it back."""
    lexicon.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
