"""SQL of the pairwise comparison: similarity, and the decision tree of rhyme types, in layers of columns."""

from __future__ import annotations

from cadenza.functions import phonemes as ph
from cadenza.functions.dialect import double, round4


def similarity(a: str, b: str) -> str:
    """1 - edit distance / longer length; 1 for two empty strings."""
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN {double(1)} ELSE {double(1)} - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def _suffix(a: str, b: str) -> str:
    """The shorter of two unequally long tails starts with a vowel and ends the longer."""
    s, t = f"(CASE WHEN length({a}) < length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) < length({b}) THEN {b} ELSE {a} END)"
    return f"(length({a}) <> length({b}) AND length({s}) > 0 AND substr({s}, 1, 1) BETWEEN 'A' AND 'O' AND right({t}, length({s})) = {s})"


def _endings(a: str, b: str) -> str:
    return f"(length({a}) >= 3 AND length({b}) >= 3 AND substr({a}, 2) = substr({b}, 2))"


def analyze(rows: str) -> str:
    """Rows with ``a`` and ``b`` (encoded pronunciations) gain rhyme_type and conf.

    Order of the decision: no tail; one tail a suffix of the other; equal tails; equal vowels; equal endings;
    similar tails; else the last-vowel fallback wherever that is surer. Unstressed pairs count half.
    """

    def tail(c: str) -> str:
        return f"CASE WHEN {ph.tail_at(c, 1)} <> '' THEN {ph.tail_at(c, 1)} WHEN {ph.tail_at(c, 2)} <> '' THEN {ph.tail_at(c, 2)} ELSE {ph.tail_any(c)} END"

    stressed = lambda c: f"({ph.tail_at(c, 1)} <> '' OR {ph.tail_at(c, 2)} <> '')"
    half = lambda v: f"CASE WHEN weak THEN ({v}) * {double(0.5)} ELSE ({v}) END"
    onset = lambda c, n: f"substr({c}, 1, length({c}) - {n})"
    one = f"SELECT *, {tail('a')} AS ra, {tail('b')} AS rb, (NOT {stressed('a')} AND NOT {stressed('b')}) AS weak, {ph.strip_stress(ph.tail_any('a'))} AS ea, {ph.strip_stress(ph.tail_any('b'))} AS eb FROM {rows}"
    two = f"SELECT *, {ph.strip_stress('ra')} AS ta, {ph.strip_stress('rb')} AS tb FROM ({one}) t1"
    three = (
        f"SELECT *, {similarity('ta', 'tb')} AS sim, {similarity('ea', 'eb')} AS esim, {_suffix('ta', 'tb')} AS suf, {_suffix('ea', 'eb')} AS esuf, least(length(ta), length(tb)) AS n, "
        f"{_endings('ta', 'tb')} AS en, {_endings('ea', 'eb')} AS een FROM ({two}) t2"
    )
    four = (
        f"SELECT *, {onset('a', 'n')} = {onset('b', 'n')} AS same_on, {onset('a', 'length(ta)')} = {onset('b', 'length(tb)')} AS same_full, "
        f"{onset('a', 'length(ea)')} = {onset('b', 'length(eb)')} AS same_end FROM ({three}) t3"
    )
    main_type = "CASE WHEN ta = tb AND same_full THEN 'identity' WHEN ta = tb THEN 'perfect' WHEN substr(ta, 1, 1) = substr(tb, 1, 1) AND sim >= 0.5 THEN 'near' WHEN en AND sim >= 0.3 THEN 'slant' WHEN sim >= 0.4 THEN 'near' ELSE 'none' END"
    main_conf = f"CASE WHEN ta = tb THEN sim WHEN substr(ta, 1, 1) = substr(tb, 1, 1) AND sim >= 0.5 THEN sim WHEN en AND sim >= 0.3 THEN sim * {double(0.8)} WHEN sim >= 0.4 THEN sim * {double(0.7)} ELSE sim * {double(0.3)} END"
    end_type = "CASE WHEN ea = '' OR eb = '' THEN NULL WHEN ea = eb AND same_end THEN 'identity' WHEN ea = eb THEN 'near' WHEN esuf THEN 'near' WHEN substr(ea, 1, 1) = substr(eb, 1, 1) AND esim >= 0.6 THEN 'near' WHEN een AND esim >= 0.5 THEN 'slant' END"
    end_conf = f"CASE WHEN ea = eb AND same_end THEN {double(0.85)} WHEN ea = eb THEN {double(0.8)} WHEN esuf THEN {double(0.75)} WHEN substr(ea, 1, 1) = substr(eb, 1, 1) AND esim >= 0.6 THEN esim * {double(0.75)} WHEN een AND esim >= 0.5 THEN esim * {double(0.65)} END"
    five = f"SELECT *, {main_type} AS mt, {main_conf} AS mc, {end_type} AS et, {round4(half(end_conf))} AS ec FROM ({four}) t4"
    weaker = lambda t: f"CASE WHEN weak AND {t} = 'perfect' THEN 'near' ELSE {t} END"
    suffix_type = "CASE WHEN same_on THEN 'identity' ELSE 'perfect' END"
    suffix_conf = f"CASE WHEN same_on THEN {double(1)} ELSE {double(0.95)} END"
    fallback = "((mt = 'none' OR mc < 0.5) AND et IS NOT NULL AND ec > mc)"
    types = f"CASE WHEN ta = '' OR tb = '' THEN 'none' WHEN suf THEN {weaker(f'({suffix_type})')} WHEN {fallback} THEN et ELSE {weaker('mt')} END"
    confs = f"CASE WHEN ta = '' OR tb = '' THEN {double(0)} WHEN suf THEN {round4(half(suffix_conf))} WHEN {fallback} THEN ec ELSE {round4(f'least(greatest(CASE WHEN weak AND mt <> {chr(39)}none{chr(39)} THEN mc * {double(0.5)} ELSE mc END, {double(0)}), {double(1)})')} END"
    return f"SELECT *, {types} AS rhyme_type, {confs} AS conf FROM ({five}) t5"


def compared(d) -> str:
    """cmp(word1, word2, similarity, rhyme_type, confidence, phonemes1, phonemes2) of pairs(word1, norm1, gdrop1, word2, norm2, gdrop2).

    Pairs with a word that the lexicon lacks are left out. Similarity and phonemes come from the most similar pair
    of variants, type and confidence from the surest one; the first variants win ties.
    """
    from cadenza.plans.rhymes import pronounced

    first = lambda order: f"row_number() OVER (PARTITION BY word1, word2 ORDER BY {order}, va, vb)"
    return f"""
vp AS (SELECT p.word1, p.word2, x.variant AS va, y.variant AS vb, {pronounced('x.pron', 'p.gdrop1')} AS a, {pronounced('y.pron', 'p.gdrop2')} AS b
  FROM pairs p JOIN lex x ON x.word = p.norm1 JOIN lex y ON y.word = p.norm2),
scored AS (SELECT *, {similarity(ph.strip_stress('a'), ph.strip_stress('b'))} AS s FROM ({analyze('vp')}) t),
ranked AS (SELECT *, {first('s DESC')} AS by_s, {first('conf DESC')} AS by_c FROM scored),
cmp AS (SELECT x.word1, x.word2, {round4('x.s')} AS similarity, CASE WHEN y.rhyme_type = 'identity' THEN 'perfect' ELSE y.rhyme_type END AS rhyme_type, y.conf AS confidence, {ph.arpabet('x.a', d)} AS phonemes1, {ph.arpabet('x.b', d)} AS phonemes2
  FROM ranked x JOIN ranked y ON x.word1 = y.word1 AND x.word2 = y.word2 WHERE x.by_s = 1 AND y.by_c = 1)"""
