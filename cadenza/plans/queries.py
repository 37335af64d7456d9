"""The queries that the driver runs, each with SQL for DuckDB over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.engine import Engine
from cadenza.functions import phonemes as ph
from cadenza.functions import text as tx
from cadenza.functions.dialect import Duck, round4
from cadenza.operators import prosody, rhymemap
from cadenza.plans import compare, meter, rhymes
from cadenza.sources import lexicon as lx

_engines: dict[str, Engine] = {}
K = 20
BIG = 500


def engine(spark: SparkSession) -> Engine:
    app = spark.sparkContext.applicationId
    if app not in _engines:
        _engines[app] = Engine(spark)
    return _engines[app]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Common inputs. Words: every word of part names and market segments, once.


def _words(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.explode(tx.tokens(F.col("p_name"), "w")).alias("word"))
    seg = table(spark, d, "customer").select(F.explode(tx.tokens(F.col("c_mktsegment"), "w")).alias("word"))
    return part.unionByName(seg).select(F.lower("word").alias("word")).distinct()


_D_WORDS = f"SELECT DISTINCT lower(unnest({tx.duck_tokens('s', 'w')})) AS word FROM (SELECT p_name AS s FROM part UNION ALL SELECT c_mktsegment FROM customer) t"


def _duck(*ctes: str) -> str:
    rows = ", ".join("('{}', {}, '{}')".format(w.replace("'", "''"), v, p) for w, v, p in lx.seed())
    lex = f"lex(word, variant, pron) AS (VALUES {rows})"
    keys = f"keys AS (SELECT word, {tx.duck_normalize('word')} AS norm, {tx.duck_drops_g('word')} AS gdrop FROM (SELECT DISTINCT word FROM lex) t)"
    vd = "vd(a, b, d) AS (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for a, b, n in ph.vowel_distances()) + ")"
    fw = "fw(norm) AS (VALUES " + ", ".join(f"('{w}')" for w in tx.FUNCTION_WORDS) + ")"
    return "WITH " + ", ".join([lex, keys, vd, fw, *ctes])


def _d_queries(limit: int) -> str:
    return f"qn AS (SELECT word, {tx.duck_normalize('word')} AS norm, {tx.duck_drops_g('word')} AS gdrop, {limit} AS k FROM ({_D_WORDS}) w)"


def _d_lines(tab: str, key: str) -> str:
    return f"lines AS (SELECT {key}, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS text FROM (SELECT {key}, string_split(coalesce(text, ''), chr(10)) AS l FROM {tab}) t)"


def _d_tokens(keys: str, kind: str) -> str:
    return f"toks AS (SELECT {keys}, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS token FROM (SELECT {keys}, {tx.duck_tokens('text', kind)} AS a FROM lines) t)"


def _d_pron() -> str:
    return f"CASE WHEN {tx.duck_drops_g('t.token')} THEN {ph.drop_g('l.pron')} ELSE l.pron END"


def _d_scan(keys: str) -> str:
    on = " AND ".join(f"p.{k} = s.{k}" for k in (x.strip() for x in keys.split(",")))
    own = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    digits = ph.stress_digits("pron", Duck)
    return f"""{_d_tokens(keys, 's')},
found AS (SELECT {", ".join("t." + k.strip() for k in keys.split(","))}, t.pos, {tx.duck_normalize('t.token')} AS norm, {_d_pron()} AS pron FROM toks t LEFT JOIN lex l ON l.variant = 0 AND l.word = {tx.duck_normalize('t.token')} WHERE {tx.duck_normalize('t.token')} <> ''),
stressed AS (SELECT {keys}, pos, pron, CASE WHEN pron IS NULL THEN '1' || repeat('0', CAST({tx.duck_estimated('norm')} - 1 AS INT)) WHEN length({digits}) = 1 AND norm IN (SELECT norm FROM fw) THEN '0' ELSE {digits} END AS stress FROM found),
per AS (SELECT {keys}, string_agg(stress, '' ORDER BY pos) AS stresses, count(*) AS word_tokens, count(pron) AS dictionary_words FROM stressed GROUP BY {keys}),
full_ AS (SELECT {own}, s.text, coalesce(p.word_tokens, 0) AS word_tokens, coalesce(p.dictionary_words, 0) AS dictionary_words, coalesce(p.stresses, '') AS stresses, translate(coalesce(p.stresses, ''), '2', '1') AS bits, length(coalesce(p.stresses, '')) AS syllable_count FROM lines s LEFT JOIN per p ON {on}),
scans AS ({meter.detected('full_', 'bits', Duck)})"""


_FINGER = "concat_ws(':', CAST(syllable_count AS STRING), foot_type, CAST(foot_count AS STRING), bits)"


# Text functions.


def _token_counts(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"), kind)).alias("token"))
        return t.groupBy("token").agg(F.count("*").alias("n"))

    sql = f"SELECT token, count(*) AS n FROM (SELECT unnest({tx.duck_tokens('text', kind)}) AS token FROM documents) t GROUP BY token"
    return run, sql


def normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"), "w")).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    t = t.select(tx.normalize(F.col("token"), True).alias("norm"), tx.drops_g(F.col("token")).alias("gdrop"), "c")
    return t.groupBy("norm").agg(F.sum("c").alias("n"), F.sum(F.col("gdrop").cast("long")).alias("dropped"))


def estimated_syllables(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", F.explode(tx.tokens(F.col("text"), "s")).alias("token"))
    return t.groupBy("lang", tx.estimated_syllables(F.col("token")).cast("long").alias("syllables")).agg(F.count("*").alias("n"))


def phoneme_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every pronunciation of the lexicon through the scalar functions."""
    return engine(spark).lexicon.selectExpr(
        "word", "variant", f"{ph.arpabet('pron')} AS phonemes", f"{ph.strip_stress('pron')} AS stripped", f"CAST({ph.syllable_count('pron')} AS BIGINT) AS syllables", f"{ph.stress_digits('pron')} AS stresses",
        f"coalesce({ph.index_tail('pron')}, '') AS tail", f"{ph.tail_any('pron')} AS last_tail", f"{ph.drop_g('pron')} AS dropped",
    )


def vowel_distance(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(ph.vowel_distances(), "a string, b string, d int").selectExpr(f"{ph.arpabet('a')} AS a", f"{ph.arpabet('b')} AS b", "CAST(d AS BIGINT) AS d")


# Words.


def lookup_words(spark: SparkSession, d: str) -> DataFrame:
    full = engine(spark).lookup(_words(spark, d))
    return full.select("word", F.array_join("phonemes", " ").alias("phonemes"), F.col("syllable_count").cast("long").alias("syllable_count"), F.array_join(F.col("stress_pattern").cast("array<string>"), "").alias("stress_pattern"), F.col("variant_count").cast("long").alias("variant_count"))


def syllable_split(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).lookup(_words(spark, d)).select("word", F.array_join("syllables", "-").alias("syllables"), "stress_display")


def contains_words(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).contains(_words(spark, d))


def syllable_counts_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text"))
    got = engine(spark).syllable_counts(c, ["conv_id", "turn"])
    return got.select("conv_id", "turn", F.size("words").cast("long").alias("words"), F.col("total").cast("long").alias("total"))


# Indexes.


def rhyme_groups(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).index("SELECT tail, count(*) AS n, array_join(sort_array(collect_set(word)), ' ') AS words FROM rg GROUP BY tail")


def coda_groups(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).index("SELECT coda, nucleus, count(*) AS n, array_join(sort_array(collect_set(word)), ' ') AS words FROM grp GROUP BY coda, nucleus")


def coda_edges(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).index("SELECT DISTINCT coda, neighbor FROM edges")


def suffix_index(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).index("SELECT substr(coda, i) AS suffix, coda FROM (SELECT coda, explode(sequence(2, length(coda) - 1)) AS i FROM (SELECT DISTINCT coda FROM grp) c WHERE length(coda) > 2) t")


# Rhymes and pairs.


def perfect_rhymes_parts(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).perfect_rhymes(_words(spark, d))


def slant_rhymes_parts(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).slant_rhymes(_words(spark, d), K)


def near_rhymes_parts(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).near_rhymes(_words(spark, d), K)


def rhymes_merged_parts(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).rhymes(_words(spark, d), K)


def rhymes_merged_all(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the lexicon as a query, at the largest limit."""
    e = engine(spark)
    return e.rhymes(e.lexicon.select(F.lower("word").alias("word")).distinct(), BIG)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent words of part names and of segments with part words sold together: pairs met in one part name."""
    t = table(spark, d, "part").select("p_partkey", F.posexplode(tx.tokens(F.col("p_name"), "w")).alias("pos", "w"))
    a, b = t.select("p_partkey", F.col("pos").alias("i"), F.col("w").alias("word1")), t.select("p_partkey", F.col("pos").alias("j"), F.col("w").alias("word2"))
    return a.join(b, "p_partkey").where("i <> j").select("word1", "word2").distinct()


_D_PAIRS = f"""tk AS (SELECT p_partkey, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS w FROM (SELECT p_partkey, {tx.duck_tokens('p_name', 'w')} AS a FROM part) t),
pairs AS (SELECT word1, {tx.duck_normalize('word1')} AS norm1, {tx.duck_drops_g('word1')} AS gdrop1, word2, {tx.duck_normalize('word2')} AS norm2, {tx.duck_drops_g('word2')} AS gdrop2 FROM (SELECT DISTINCT a.w AS word1, b.w AS word2 FROM tk a JOIN tk b ON a.p_partkey = b.p_partkey AND a.pos <> b.pos) t)"""


def compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).compare(_pairs(spark, d))


#: Pronunciations after a given one, among those with its last phoneme, that it is compared with.
NEXT = 8


def _lexicon_pairs(e: Engine) -> DataFrame:
    """Every pronunciation with itself and the next ones of its last phoneme, in order of word and variant: rows in
    proportion to the lexicon."""
    lex = e.lexicon.select("word", "variant", F.col("pron").alias("p"), F.expr("right(pron, 1)").alias("z"))
    own = Window.partitionBy("z").orderBy("word", "variant").rowsBetween(0, NEXT)
    pairs = lex.withColumn("next", F.collect_list(F.struct("word", "variant", "p")).over(own)).withColumn("y", F.explode("next"))
    return pairs.select(F.col("word").alias("word1"), F.col("variant").alias("v1"), F.col("p").alias("a"), F.col("y.word").alias("word2"), F.col("y.variant").alias("v2"), F.col("y.p").alias("b"))


def analyze_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark)
    return e.analyze(_lexicon_pairs(e)).drop("a", "b")


def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark)
    s = round4(compare.similarity(ph.strip_stress("a"), ph.strip_stress("b")))
    return _lexicon_pairs(e).selectExpr("word1", "v1", "word2", "v2", f"{s} AS similarity")


_D_LEXPAIRS = f"""nb AS (SELECT *, right(pron, 1) AS z, row_number() OVER (PARTITION BY right(pron, 1) ORDER BY word, variant) AS i FROM lex),
lp AS (SELECT x.word AS word1, x.variant AS v1, y.word AS word2, y.variant AS v2, x.pron AS a, y.pron AS b FROM nb x JOIN nb y ON x.z = y.z AND y.i BETWEEN x.i AND x.i + {NEXT})"""


# Lines and documents.


def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", "text")
    s = engine(spark).scan(prosody.split_lines(b, "item_id", "text"), ["item_id", "line_no"])
    return s.select("item_id", "line_no", "stresses", "bits", "syllable_count", "meter_name", "foot_type", "foot_count", "regularity", prosody.visual(F.col("bits")).alias("visual"))


def scan_dictionary_mode(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", "text")
    s = engine(spark).scan(prosody.split_lines(b, "item_id", "text"), ["item_id", "line_no"], "dictionary")
    return s.select("item_id", "line_no", "stresses", "meter_name", "regularity")


def scan_records(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", "text")
    s = engine(spark).scan_records(prosody.split_lines(b, "item_id", "text"), ["item_id", "line_no"])
    return s.select("item_id", "line_no", "stressed_display", "visual", "prosody_fingerprint")


def _scans(docs: DataFrame) -> DataFrame:
    return engine(docs.sparkSession).scan(prosody.split_lines(docs.select("doc_id", "text"), "doc_id", "text"), ["doc_id", "line_no"])


def meter_distribution(spark: SparkSession, d: str) -> DataFrame:
    """How often document lines have each meter, and how regular they are."""
    g = _scans(table(spark, d, "documents")).where("syllable_count > 0").groupBy("meter_name").agg(F.count("*").alias("lines"), F.sum(F.round(F.col("regularity") * 10000).cast("long")).alias("r"))
    return g.select("meter_name", "lines", (F.round(F.col("r") / F.col("lines")) / 10000).alias("mean_regularity"))


def prosody_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return engine(spark).scan(c, ["conv_id", "turn"]).select("conv_id", "turn", prosody.fingerprint().alias("fingerprint"))


def meter_compare_turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's pattern against the turn before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    s = engine(spark).scan(c, ["conv_id", "turn"])
    w = Window.partitionBy("conv_id").orderBy("turn")
    cols = ["bits", "foot_type", "foot_count"]
    p = s.select("conv_id", "turn", *(F.lag(x).over(w).alias(f"{x}1") for x in cols), *(F.col(x).alias(f"{x}2") for x in cols)).where("bits1 IS NOT NULL")
    return engine(spark).compare_meter(p).select("conv_id", "turn", "same_meter", "same_length", "stress_agreement", F.size("mismatch_positions").cast("long").alias("mismatches"))


def dominant_meter_docs(spark: SparkSession, d: str) -> DataFrame:
    return prosody.dominant_meter(_scans(table(spark, d, "documents")), "doc_id").select("doc_id", "meter_name", "foot_type", F.col("foot_count").cast("long").alias("foot_count"), "supporting_line_count")


def document_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = engine(spark).summary(docs, "doc_id")
    return s.withColumn("mean_regularity_4dp", F.round(F.col("mean_meter_regularity") * 10000).cast("long")).drop("mean_meter_regularity", "foot_count", "foot_type")


def dictionary_coverage_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "source", "text")
    t = prosody.with_norm(docs.select("lang", "source", F.explode(tx.tokens(F.col("text"), "s")).alias("token")), "token", True).where("norm <> ''")
    f = prosody.first_pronunciation(t, engine(spark).lex0)
    return f.rollup("lang", "source").agg(F.count("*").alias("tokens"), F.count("pron").alias("known"))


def _turn_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), "text")


def rhyme_map_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern of every conversation, uncapped."""
    return engine(spark).rhyme_map(_turn_lines(spark, d), "conv_id", rhymemap.Options(max_patterns=0)).select("conv_id", "ngram", "length", "count", "score", "is_vowel_anchored")


def rhyme_map_topk(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark).rhyme_map(_turn_lines(spark, d), "conv_id").select("conv_id", "pattern_id", "ngram", "score")


def word_highlights(spark: SparkSession, d: str) -> DataFrame:
    h = engine(spark).highlights(_turn_lines(spark, d), "conv_id")
    return h.groupBy("conv_id", "line_no", "pos", "token").agg(F.count("*").alias("parts"), F.countDistinct("pattern_id").alias("patterns"))


def _d_rhymemap(cap: str) -> str:
    return f"""lines AS (SELECT conv_id, turn AS line_no, text FROM conversations), {_d_tokens('conv_id, line_no', 'm')},
ws AS (SELECT t.conv_id, t.line_no, t.pos, t.token, {ph.strip_stress(f"coalesce({_d_pron()}, '')")} AS st, t.pos = max(t.pos) OVER (PARTITION BY t.conv_id, t.line_no) AS last FROM toks t LEFT JOIN lex l ON l.variant = 0 AND l.word = {tx.duck_normalize('t.token')}),
hit AS (SELECT conv_id, line_no, pos, token, last, s - 1 AS start, substr(st, CAST(s AS INT), CAST(n AS INT)) AS g FROM (SELECT *, unnest(range(1, length(st) + 1)) AS s FROM ws WHERE st <> '') a, (SELECT unnest([1, 2, 3, 4]) AS n) b WHERE n <= length(st) - s + 1),
grams AS (SELECT conv_id, g, count(DISTINCT (line_no, pos)) AS c, count(*) AS h, count(CASE WHEN last THEN 1 END) AS e FROM hit GROUP BY conv_id, g),
scored AS (SELECT *, round(pow(CAST(length(g) AS DOUBLE), CAST(2 AS DOUBLE)) * log2(CAST(c AS DOUBLE)) * CASE WHEN substr(g, 1, 1) BETWEEN 'A' AND 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * (CAST(1 AS DOUBLE) + e / h * CAST(2 AS DOUBLE)) * 10000) / 10000 AS score FROM grams WHERE c >= 2 AND length(g) >= 2),
pats AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, c DESC, g) - 1 AS id FROM scored),
kept AS (SELECT *, replace({ph.arpabet('g', Duck)}, ' ', '-') AS ngram FROM pats WHERE {cap})"""


def _registry() -> dict[str, tuple]:
    base = f"{rhymes.indexes(Duck)}"
    q = lambda k: f"{_d_queries(k)}, {base}, {rhymes.queries(Duck)}"
    conv = "lines AS (SELECT conv_id, turn, text FROM conversations)"
    bench, docs = _d_lines("benchmark", "item_id"), _d_lines("documents", "doc_id")
    scan_cols = "item_id, line_no, stresses, bits, CAST(syllable_count AS BIGINT) AS syllable_count, meter_name, foot_type, foot_count, regularity, rtrim(regexp_replace(translate(bits, '01', 'x/'), '(.)', '\\1 ', 'g')) AS visual"
    norm = tx.duck_normalize("token")
    dom = """votes AS (SELECT doc_id, meter_name, count(*) AS supporting_line_count, arg_min({'t': foot_type, 'c': foot_count}, line_no) AS m FROM scans WHERE syllable_count > 0 GROUP BY ALL),
dom AS (SELECT doc_id, meter_name, m.t AS foot_type, CAST(m.c AS BIGINT) AS foot_count, supporting_line_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY supporting_line_count DESC, meter_name DESC) AS r FROM votes) t WHERE r = 1)"""
    full_q = f"qn AS (SELECT word, {tx.duck_normalize('word')} AS norm, {tx.duck_drops_g('word')} AS gdrop, {BIG} AS k FROM (SELECT DISTINCT lower(word) AS word FROM lex) w)"
    lexnorm = f"wn AS (SELECT word, {tx.duck_normalize('word')} AS norm, {tx.duck_drops_g('word')} AS gdrop FROM ({_D_WORDS}) w)"
    return {
        "tokenize_w": _token_counts("w"),
        "tokenize_s": _token_counts("s"),
        "tokenize_m": _token_counts("m"),
        "normalize_tokens": (normalize_tokens, f"SELECT norm, CAST(sum(c) AS BIGINT) AS n, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM (SELECT {norm} AS norm, {tx.duck_drops_g('token')} AS g, c FROM (SELECT token, count(*) AS c FROM (SELECT unnest({tx.duck_tokens('text', 'w')}) AS token FROM documents) a GROUP BY token) b) t GROUP BY norm"),
        "estimated_syllables": (estimated_syllables, f"SELECT lang, CAST({tx.duck_estimated('token')} AS BIGINT) AS syllables, count(*) AS n FROM (SELECT lang, unnest({tx.duck_tokens('text', 's')}) AS token FROM documents) t GROUP BY ALL"),
        "phoneme_codec": (phoneme_codec, f"{_duck()} SELECT word, variant, {ph.arpabet('pron', Duck)} AS phonemes, {ph.strip_stress('pron')} AS stripped, CAST({ph.syllable_count('pron', Duck)} AS BIGINT) AS syllables, {ph.stress_digits('pron', Duck)} AS stresses, coalesce({ph.index_tail('pron')}, '') AS tail, {ph.tail_any('pron')} AS last_tail, {ph.drop_g('pron')} AS dropped FROM lex"),
        "vowel_distance": (vowel_distance, f"{_duck()} SELECT {ph.arpabet('a', Duck)} AS a, {ph.arpabet('b', Duck)} AS b, CAST(d AS BIGINT) AS d FROM vd"),
        "lookup_words": (lookup_words, f"{_duck(lexnorm)} SELECT DISTINCT w.norm AS word, {ph.arpabet('p', Duck)} AS phonemes, CAST({ph.syllable_count('p', Duck)} AS BIGINT) AS syllable_count, {ph.stress_digits('p', Duck)} AS stress_pattern, CAST(n AS BIGINT) AS variant_count FROM (SELECT w.norm, CASE WHEN w.gdrop THEN {ph.drop_g('l.pron')} ELSE l.pron END AS p, (SELECT count(*) FROM lex x WHERE x.word = w.norm) AS n FROM wn w JOIN lex l ON l.word = w.norm AND l.variant = 0) w"),
        "syllable_split": (syllable_split, None),
        "contains_words": (contains_words, f"{_duck(lexnorm)} SELECT word, norm IN (SELECT word FROM lex) AS known FROM wn"),
        "syllable_counts_lines": (syllable_counts_lines, f"{_duck(conv, _d_tokens('conv_id, turn', 'w'))}, c AS (SELECT t.conv_id, t.turn, coalesce({ph.syllable_count(_d_pron(), Duck)}, {tx.duck_estimated('t.token')}) AS s FROM toks t LEFT JOIN lex l ON l.variant = 0 AND l.word = {tx.duck_normalize('t.token')}) SELECT l.conv_id, l.turn, count(c.s) AS words, CAST(coalesce(sum(c.s), 0) AS BIGINT) AS total FROM lines l LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn GROUP BY l.conv_id, l.turn"),
        "rhyme_groups": (rhyme_groups, f"{_duck(base)} SELECT tail, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS words FROM rg GROUP BY tail"),
        "coda_groups": (coda_groups, f"{_duck(base)} SELECT coda, nucleus, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS words FROM grp GROUP BY coda, nucleus"),
        "coda_edges": (coda_edges, f"{_duck(base)}, c AS (SELECT DISTINCT substr(tail, 2) AS coda FROM lexi WHERE tail IS NOT NULL AND length(tail) <= 4) SELECT a.coda, b.coda AS neighbor FROM c a JOIN c b ON levenshtein(a.coda, b.coda) = 1"),
        "suffix_index": (suffix_index, f"{_duck(base)}, c AS (SELECT DISTINCT coda FROM grp) SELECT suffix, coda FROM (SELECT coda, unnest(list_transform(range(2, length(coda)), lambda i: substr(coda, CAST(i AS INT)))) AS suffix FROM c) t"),
        "perfect_rhymes_parts": (perfect_rhymes_parts, f"{_duck(q(BIG), rhymes.perfect(Duck))} {rhymes.described(Duck, 'pf', 'perfect')}"),
        "slant_rhymes_parts": (slant_rhymes_parts, f"{_duck(q(K), rhymes.slant(Duck))} {rhymes.described(Duck, 'sl', 'slant')}"),
        "near_rhymes_parts": (near_rhymes_parts, f"{_duck(q(K), rhymes.coda_keys(Duck), rhymes.near(Duck))} {rhymes.described(Duck, 'nr', 'near')}"),
        "rhymes_merged_parts": (rhymes_merged_parts, f"{_duck(q(K), rhymes.coda_keys(Duck), rhymes.merged(Duck))} {rhymes.described(Duck, 'all_', None)}"),
        "rhymes_merged_all": (rhymes_merged_all, f"{_duck(full_q, base, rhymes.queries(Duck), rhymes.coda_keys(Duck), rhymes.merged(Duck))} {rhymes.described(Duck, 'all_', None)}"),
        "compare_pairs": (compare_pairs, f"{_duck(_D_PAIRS, compare.compared(Duck))} SELECT * FROM cmp"),
        "analyze_pairs": (analyze_pairs, f"{_duck(_D_LEXPAIRS)} SELECT word1, v1, word2, v2, rhyme_type, conf AS confidence FROM ({compare.analyze('lp')}) t"),
        "similarity_pairs": (similarity_pairs, f"{_duck(_D_LEXPAIRS)} SELECT word1, v1, word2, v2, {round4(compare.similarity(ph.strip_stress('a'), ph.strip_stress('b')))} AS similarity FROM lp"),
        "scan_lines": (scan_lines, f"{_duck(bench, _d_scan('item_id, line_no'))} SELECT {scan_cols} FROM scans"),
        "scan_dictionary_mode": (scan_dictionary_mode, f"{_duck(bench, _d_scan('item_id, line_no').replace(' AND norm IN (SELECT norm FROM fw)', ' AND 1 = 0'))} SELECT item_id, line_no, stresses, meter_name, regularity FROM scans"),
        "scan_records": (scan_records, None),
        "meter_distribution": (meter_distribution, f"{_duck(docs, _d_scan('doc_id, line_no'))} SELECT meter_name, count(*) AS lines, round(sum(CAST(round(regularity * 10000) AS BIGINT)) / count(*)) / 10000 AS mean_regularity FROM scans WHERE syllable_count > 0 GROUP BY meter_name"),
        "prosody_fingerprints": (prosody_fingerprints, f"{_duck(conv, _d_scan('conv_id, turn'))} SELECT conv_id, turn, {_FINGER} AS fingerprint FROM scans"),
        "meter_compare_turns": (meter_compare_turns, f"{_duck(conv, _d_scan('conv_id, turn'))}, p AS (SELECT conv_id, turn, lag(bits) OVER w AS bits1, lag(foot_type) OVER w AS f1, lag(foot_count) OVER w AS c1, bits AS bits2, foot_type AS f2, foot_count AS c2 FROM scans WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, f1 = f2 AS same_meter, c1 = c2 AS same_length, {meter.agreement('bits1', 'bits2', Duck)} AS stress_agreement, CASE WHEN greatest(length(bits1), length(bits2)) = 0 THEN 0 WHEN least(length(bits1), length(bits2)) = 0 THEN greatest(length(bits1), length(bits2)) ELSE hamming(substr(bits1, 1, least(length(bits1), length(bits2))), substr(bits2, 1, least(length(bits1), length(bits2)))) + abs(length(bits1) - length(bits2)) END AS mismatches FROM p WHERE bits1 IS NOT NULL"),
        "dominant_meter_docs": (dominant_meter_docs, f"{_duck(docs, _d_scan('doc_id, line_no'))}, {dom} SELECT * FROM dom"),
        "document_summary": (document_summary, f"""{_duck(docs, _d_scan('doc_id, line_no'))}, {dom}, own AS (SELECT doc_id, count(*) AS line_count, count(CASE WHEN regexp_matches(text, '[^\\s]') THEN 1 END) AS non_empty_line_count, CAST(sum(syllable_count) AS BIGINT) AS total_syllables, CAST(sum(word_tokens) AS BIGINT) AS total_word_tokens, CAST(sum(dictionary_words) AS BIGINT) AS dictionary_word_tokens, sum(CASE WHEN syllable_count > 0 THEN CAST(round(regularity * 10000) AS BIGINT) END) AS rs, count(CASE WHEN syllable_count > 0 THEN 1 END) AS rn FROM scans GROUP BY doc_id)
SELECT o.doc_id, line_count, non_empty_line_count, total_syllables, total_word_tokens, dictionary_word_tokens, CASE WHEN total_word_tokens > 0 THEN round(CAST(dictionary_word_tokens AS DOUBLE) / total_word_tokens * 10000) / 10000 ELSE CAST(1 AS DOUBLE) END AS dictionary_coverage, round(CAST(total_syllables AS DOUBLE) * 10000 / line_count) / 10000 AS mean_syllables_per_line, coalesce(meter_name, 'none') AS meter_name, coalesce(supporting_line_count, 0) AS supporting_line_count, CASE WHEN rn > 0 THEN CAST(round(rs / rn) AS BIGINT) ELSE 0 END AS mean_regularity_4dp FROM own o LEFT JOIN dom d ON d.doc_id = o.doc_id"""),
        "dictionary_coverage_by_lang": (dictionary_coverage_by_lang, f"{_duck()}, t AS (SELECT lang, source, unnest({tx.duck_tokens('text', 's')}) AS token FROM documents), f AS (SELECT t.lang, t.source, l.pron FROM t LEFT JOIN lex l ON l.variant = 0 AND l.word = {tx.duck_normalize('t.token')} WHERE {tx.duck_normalize('t.token')} <> '') SELECT lang, source, count(*) AS tokens, count(pron) AS known FROM f GROUP BY ROLLUP (lang, source)"),
        "rhyme_map_ngrams": (rhyme_map_ngrams, f"{_duck(_d_rhymemap('1 = 1'))} SELECT conv_id, ngram, length(g) AS length, c AS count, score, substr(g, 1, 1) BETWEEN 'A' AND 'O' AS is_vowel_anchored FROM kept"),
        "rhyme_map_topk": (rhyme_map_topk, f"{_duck(_d_rhymemap('id < 50'))} SELECT conv_id, id AS pattern_id, ngram, score FROM kept"),
        "word_highlights": (word_highlights, f"{_duck(_d_rhymemap('id < 50'))} SELECT h.conv_id, h.line_no, h.pos, h.token, count(*) AS parts, count(DISTINCT k.id) AS patterns FROM hit h JOIN kept k ON k.conv_id = h.conv_id AND k.g = h.g GROUP BY ALL"),
    }


QUERIES = {name: x[0] for name, x in _registry().items()}
SQL = {name: x[1] for name, x in _registry().items() if x[1]}
