"""Words and lines: lookup, syllable counts, stress scansion, meter, document roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.functions import text as tx
from cadenza.functions.dialect import Spark
from cadenza.functions.syllables import display_udf, split_udf
from cadenza.plans import meter
from cadenza.plans.views import query


def round4(c: Column) -> Column:
    return F.round(c * 10000) / 10000


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text): the lines of every text; a null text is one empty line."""
    return docs.select(key, F.posexplode(tx.lines_of(F.col(text))).alias("line_no", "text"))


def tokenized_lines(lines: DataFrame, kind: str, text: str = "text") -> tuple[DataFrame, list[str]]:
    """One row per token, and one with a null token for a line without any, next to all columns of its line; and the
    columns that name a line. A line is then put together again by one aggregation, which combines its words in the
    task that read them; nothing is joined back."""
    marked = lines.withColumn("_line", F.monotonically_increasing_id())
    return marked.select("*", F.posexplode_outer(tx.tokens(F.col(text), kind)).alias("pos", "token")), [*(c for c in lines.columns if c != text), "_line"]


def in_order(of: str, kept: Column) -> Column:
    """Aggregate: the values of a column of a line's kept tokens in their order."""
    return F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", of)))), lambda x: x[of])


def tokenized(lines: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """One row per token with its position, next to the other columns."""
    kept = [c for c in lines.columns if c != text]
    return lines.select(*kept, F.posexplode(tx.tokens(F.col(text), kind)).alias("pos", "token"))


def with_norm(rows: DataFrame, word: str, token: bool = False) -> DataFrame:
    return rows.withColumn("norm", tx.normalize(F.col(word), token)).withColumn("gdrop", tx.drops_g(F.col(word)))


def first_pronunciation(rows: DataFrame, lex0: DataFrame) -> DataFrame:
    """Rows with ``norm`` and ``gdrop`` gain ``pron`` of the first variant; null where the lexicon lacks the word."""
    found = rows.join(lex0.select(F.col("word").alias("norm"), F.col("pron").alias("_p")), "norm", "left")
    return found.withColumn("pron", F.expr(f"CASE WHEN gdrop THEN {ph.drop_g('_p')} ELSE _p END")).drop("_p")


def lookup(words: DataFrame, lexicon: DataFrame, lex0: DataFrame, word: str = "word") -> DataFrame:
    """word, phonemes, syllable_count, syllables, stress_pattern, stress_display, variant_count of the words found.

    Spellings are cut once per distinct word.
    """
    known = first_pronunciation(with_norm(words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct(), "word"), lex0).where("pron IS NOT NULL")
    count = lexicon.groupBy(F.col("word").alias("norm")).agg(F.count("*").cast("int").alias("variant_count"))
    full = known.join(F.broadcast(count), "norm").withColumn("digits", F.expr(ph.stress_digits("pron")))
    return full.select(
        F.col("norm").alias("word"),
        F.expr(f"split({ph.arpabet('pron')}, ' ')").alias("phonemes"),
        F.length("digits").alias("syllable_count"),
        split_udf(F.lower("norm"), F.length("digits")).alias("syllables"),
        F.when(F.col("digits") == "", F.array().cast("array<int>")).otherwise(F.transform(F.split("digits", ""), lambda x: x.cast("int"))).alias("stress_pattern"),
        display_udf(F.lower("norm"), F.col("digits")).alias("stress_display"),
        "variant_count",
    ).distinct()


def syllables_of(rows: DataFrame, lex0: DataFrame) -> DataFrame:
    """Rows with ``norm``, ``gdrop`` and ``token`` gain ``pron`` and ``syllables``: of the lexicon, else estimated from the spelling."""
    found = first_pronunciation(rows, lex0)
    return found.withColumn("syllables", F.coalesce(F.expr(ph.syllable_count("pron")), tx.estimated_syllables(F.col("token"))).cast("int"))


def line_syllables(lines: DataFrame, keys: list[str], lex0: DataFrame) -> DataFrame:
    """Per line: words (token and syllables in order) and their total; lines without tokens have total 0."""
    toks, line = tokenized_lines(lines.select(*keys, "text"), "w")
    counted = syllables_of(with_norm(toks, "token", True), lex0).withColumn("w", F.struct(F.col("token").alias("word"), "syllables"))
    word = F.col("token").isNotNull()
    per = counted.groupBy(*line).agg(in_order("w", word).alias("words"), F.sum(F.when(word, F.col("syllables"))).alias("total"))
    return per.select(*keys, "words", F.coalesce("total", F.lit(0)).cast("int").alias("total"))


def stressed(toks: DataFrame, lex0: DataFrame, mode: str = "spoken") -> DataFrame:
    """Tokens gain norm, pron (null if unknown) and stress digits; those are null where a token has no normal form.

    ``spoken`` leaves one-syllable function words unstressed; ``dictionary`` keeps the lexicon's stress.
    """
    if mode not in ("spoken", "dictionary"):
        raise ValueError(f"no stress mode {mode!r}")
    found = first_pronunciation(with_norm(toks, "token", True), lex0)
    digits = F.expr(ph.stress_digits("pron"))
    if mode == "spoken":
        digits = F.when((F.length(digits) == 1) & tx.function_word(F.col("norm")), F.lit("0")).otherwise(digits)
    estimate = F.concat(F.lit("1"), F.repeat(F.lit("0"), tx.estimated_syllables(F.col("norm")) - 1))
    return found.withColumn("stress", F.when(F.col("norm") != "", F.when(F.col("pron").isNotNull(), digits).otherwise(estimate)))


def scanned(lines: DataFrame, keys: list[str], lex0: DataFrame, mode: str = "spoken", display: bool = False) -> DataFrame:
    """Per line: keys, text, word_tokens, dictionary_words, stresses (digits), bits (0 and 1), syllable_count and its meter;
    with ``display`` its words by syllable.

    One pass over the texts: the lexicon is joined where the words are, and the only shuffle is that of the lines, each
    already put together by the map side of the aggregation; a text that is not asked for is not in it.
    """
    toks, line = tokenized_lines(lines.select(*keys, "text"), "s")
    words = stressed(toks, lex0, mode)
    kept = F.col("stress").isNotNull()
    shown = []
    if display:
        words = words.withColumn("shown", display_udf("token", "stress"))
        shown = [F.array_join(in_order("shown", kept), " ").alias("stressed_display")]
    per = words.groupBy(*line).agg(
        F.first("text").alias("text"),
        F.count("stress").alias("word_tokens"),
        F.count(F.when(kept, F.col("pron"))).alias("dictionary_words"),
        F.array_join(in_order("stress", kept), "").alias("stresses"),
        *shown,
    )
    return metered(per.drop("_line").withColumn("bits", F.translate("stresses", "2", "1")).withColumn("syllable_count", F.length("stresses").cast("long")))


def metered(rows: DataFrame, bits: str = "bits") -> DataFrame:
    """Rows gain foot_type, foot_count, meter_name and regularity of their pattern."""
    found = query(rows.sparkSession, meter.detected("@rows@", bits, Spark), rows=rows)
    return found.select(*rows.columns, "foot_type", F.col("foot_count").cast("int").alias("foot_count"), "meter_name", "regularity")


def fingerprint() -> Column:
    return F.concat_ws(":", F.col("syllable_count").cast("string"), "foot_type", F.col("foot_count").cast("string"), "bits")


def visual(bits: Column) -> Column:
    """Stressed as /, others as x, parted by blanks."""
    return F.rtrim(F.regexp_replace(F.translate(bits, "01", "x/"), "(.)", "$1 "))


def scan_records(lines: DataFrame, keys: list[str], lex0: DataFrame, mode: str = "spoken") -> DataFrame:
    """The full record of a line: scanned columns with the display of its words by syllable."""
    ints = lambda c: F.when(F.col(c) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ""), lambda x: x.cast("int")))
    full = scanned(lines, keys, lex0, mode, display=True)
    return full.select(
        *keys, "text", "stressed_display", ints("stresses").alias("stress_pattern"), ints("bits").alias("binary_pattern"), F.col("syllable_count").cast("int").alias("syllable_count"),
        visual(F.col("bits")).alias("visual"), F.struct(F.col("meter_name").alias("name"), "foot_type", "foot_count", "regularity").alias("meter"), "word_tokens", "dictionary_words", fingerprint().alias("prosody_fingerprint"),
    )


def deviations(bits: str, foot: str) -> Column:
    """Places where a pattern leaves its foot: array of (position, expected, actual)."""
    name = lambda c: f"CASE WHEN {c} = '1' THEN 'stressed' ELSE 'unstressed' END"
    at = f"substr({foot}, CAST(i % length({foot}) AS INT) + 1, 1)"
    own = f"substr({bits}, i + 1, 1)"
    return F.expr(f"CASE WHEN length({bits}) < length({foot}) THEN array() ELSE filter(transform(sequence(0, length({bits}) - 1), i -> struct(i AS position, {name(at)} AS expected, {name(own)} AS actual)), x -> x.expected <> x.actual) END")


def compared_meter(pairs: DataFrame) -> DataFrame:
    """Rows with bits1, foot_type1, foot_count1, bits2, foot_type2, foot_count2 gain same_meter, same_length, stress_agreement, mismatch_positions."""
    places = F.expr("CASE WHEN greatest(length(bits1), length(bits2)) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE filter(sequence(0, greatest(length(bits1), length(bits2)) - 1), i -> substr(bits1, i + 1, 1) <> substr(bits2, i + 1, 1)) END")
    return pairs.withColumn("same_meter", F.expr("foot_type1 = foot_type2")).withColumn("same_length", F.expr("foot_count1 = foot_count2")).withColumn("stress_agreement", F.expr(meter.agreement("bits1", "bits2", Spark))).withColumn("mismatch_positions", places)


def votes(scans: DataFrame, key: str, *more: Column) -> DataFrame:
    """Per document and meter of its lines: the lines with syllables, foot type and count of the first of them; and more aggregates."""
    some = F.col("syllable_count") > 0
    foot = F.min(F.when(some, F.struct("line_no", "foot_type", "foot_count")))
    return scans.groupBy(key, "meter_name").agg(F.count(F.when(some, 1)).alias("supporting_line_count"), foot.alias("foot"), *more)


def _winner() -> Column:
    """Aggregate over votes: the meter of most lines, the greatest name among equals; null without any."""
    return F.max(F.when(F.col("supporting_line_count") > 0, F.struct("supporting_line_count", "meter_name", "foot.foot_type", "foot.foot_count")))


def dominant_meter(scans: DataFrame, key: str) -> DataFrame:
    """Per document: the meter of most lines, the greatest name among equals; documents without syllables have none."""
    best = votes(scans, key).groupBy(key).agg(_winner().alias("m")).where("m IS NOT NULL")
    return best.select(key, "m.meter_name", "m.foot_type", "m.foot_count", "m.supporting_line_count")


def document_summary(docs: DataFrame, key: str, lex0: DataFrame, mode: str = "spoken", text: str = "text") -> DataFrame:
    """One row per document: counts, coverage, means and dominant meter; one pass over the texts, lines first, then
    their meters, then documents."""
    lines = split_lines(docs, key, text).withColumn("filled", ~tx.blank(F.col("text")))
    scans = scanned(lines, [key, "line_no", "filled"], lex0, mode)
    some = F.col("syllable_count") > 0
    by_meter = votes(
        scans, key,
        F.count("*").alias("line_count"),
        F.count(F.when(F.col("filled"), 1)).alias("non_empty_line_count"),
        F.sum("syllable_count").alias("total_syllables"),
        F.sum("word_tokens").alias("total_word_tokens"),
        F.sum("dictionary_words").alias("dictionary_word_tokens"),
        F.sum(F.when(some, F.round(F.col("regularity") * 10000).cast("long"))).alias("_sum"),
    )
    sums = ["line_count", "non_empty_line_count", "total_syllables", "total_word_tokens", "dictionary_word_tokens", "_sum"]
    full = by_meter.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), F.sum("supporting_line_count").alias("_n"), _winner().alias("m")).select("*", "m.*").drop("m")
    return full.select(
        key, "line_count", "non_empty_line_count", "total_syllables", "total_word_tokens", "dictionary_word_tokens",
        F.when(F.col("total_word_tokens") > 0, round4(F.col("dictionary_word_tokens") / F.col("total_word_tokens"))).otherwise(F.lit(1.0)).alias("dictionary_coverage"),
        (F.round(F.col("total_syllables") * F.lit(10000.0) / F.col("line_count")) / 10000).alias("mean_syllables_per_line"),
        F.when(F.col("_n") > 0, F.round(F.col("_sum") / F.col("_n")) / 10000).otherwise(F.lit(0.0)).alias("mean_meter_regularity"),
        F.coalesce("meter_name", F.lit("none")).alias("meter_name"), F.coalesce("foot_type", F.lit("none")).alias("foot_type"), F.coalesce("foot_count", F.lit(0)).alias("foot_count"), F.coalesce("supporting_line_count", F.lit(0)).cast("long").alias("supporting_line_count"),
    )
