"""SQL of the rhyme indexes and searches, for Spark and for the oracle.

Every builder takes a dialect and gives the text of common table expressions, so that searches over a whole
column of query words are equi-joins with the lexicon's derived keys:

lex(word, variant, pron)            the lexicon
qn(word, norm, gdrop, k)            query words with normal form, dropped g and limit
keys(word, norm, gdrop)             the lexicon's own words with their normal form
"""

from __future__ import annotations

from cadenza.functions import phonemes as ph
from cadenza.functions.dialect import double, round4

NEAREST = 50  # vowel distance up to which rhymes are slant
LONGEST_CODA = 3  # of near rhymes
SHORTEST_SUFFIX = 2
SAME_VOWEL = 5  # distance of equal vowels where codas differ
PER_EXTRA, FLOOR = 0.06, 0.15
LIMIT = 500


def pronounced(pron: str, gdrop: str) -> str:
    return f"CASE WHEN {gdrop} THEN {ph.drop_g(pron)} ELSE {pron} END"


def indexes(d) -> str:
    """lexi: lexicon with tails; keyv: variants under which a word is found; key0: its first; grp: nucleus and coda groups, words numbered; rg: rhyme groups; edges; suffixes."""
    return f"""
lexi AS (SELECT word, variant, pron, {ph.index_tail('pron')} AS tail FROM lex),
keyv AS (SELECT k.word, l.variant, {pronounced('l.pron', 'k.gdrop')} AS pron FROM keys k JOIN lex l ON l.word = k.norm),
key0 AS (SELECT word, pron, {ph.syllable_count('pron', d)} AS syllables FROM keyv WHERE variant = 0),
grp AS (SELECT word, nucleus, coda, row_number() OVER (PARTITION BY nucleus, coda ORDER BY word) AS turn FROM (SELECT DISTINCT word, substr(tail, 1, 1) AS nucleus, substr(tail, 2) AS coda FROM (SELECT word, {ph.index_tail('pron')} AS tail FROM keyv) t WHERE tail IS NOT NULL) g),
rg AS (SELECT word, tail FROM (SELECT word, tail, count(*) OVER (PARTITION BY tail) AS n FROM (SELECT DISTINCT word, tail FROM lexi WHERE tail IS NOT NULL) t) u WHERE n >= 2)"""


def coda_keys(d) -> str:
    """codas(coda): short codas of the raw entries; edges(coda, neighbor): those one substitution, insertion or deletion apart.

    No pair of codas is compared: a substitution is met under the coda with one place masked, an insertion under
    the longer coda with one place left out.
    """
    return f"""
codas AS (SELECT DISTINCT substr(tail, 2) AS coda FROM lexi WHERE tail IS NOT NULL AND length(tail) <= {LONGEST_CODA + 1}),
place AS ({d.each('codas', 'coda', '1', 'length(coda)')}),
cut AS (SELECT coda, i, concat(substr(coda, 1, CAST(i - 1 AS INT)), substr(coda, CAST(i + 1 AS INT))) AS rest FROM place),
edges AS (
  SELECT a.coda, b.coda AS neighbor FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.coda) = length(b.coda) AND a.coda <> b.coda
  UNION SELECT a.coda, b.coda FROM cut a JOIN codas b ON a.rest = b.coda
  UNION SELECT b.coda, a.coda FROM cut a JOIN codas b ON a.rest = b.coda)"""


def queries(d) -> str:
    """qv: variants of the query words with tail, nucleus and coda."""
    return f"""
qv AS (SELECT word, norm, k, variant, pron, tail, substr(tail, 1, 1) AS nucleus, substr(tail, 2) AS coda FROM (
  SELECT word, norm, k, variant, pron, {ph.index_tail('pron')} AS tail FROM (
    SELECT q.word, q.norm, q.k, l.variant, {pronounced('l.pron', 'q.gdrop')} AS pron FROM qn q JOIN lex l ON l.word = q.norm) t) u)"""


def best_variant(rows: str) -> str:
    """Rows of the variant with most matches, the first among equals."""
    return f"(SELECT * FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY n DESC, variant) AS best FROM (SELECT *, count(*) OVER (PARTITION BY word, variant) AS n FROM {rows}) c) b WHERE best = 1)"


def perfect(d) -> str:
    """pf(word, match, conf, ord): all words with the tail of the best variant, in order of the word."""
    return f"""
pf_all AS (SELECT q.word, q.variant, m.word AS match FROM qv q JOIN rg m ON m.tail = q.tail WHERE m.word <> q.norm),
pf AS (SELECT word, match, {double(1.0)} AS conf, row_number() OVER (PARTITION BY word ORDER BY match) AS ord FROM {best_variant('pf_all')} x)"""


def _left(rows: str, taken: str | None) -> str:
    """Rows with ``k`` less the matches that earlier kinds took."""
    return rows if taken is None else f"(SELECT r.*, r.k - coalesce(t.taken, 0) AS left_ FROM {rows} r LEFT JOIN {taken} t ON t.word = r.word)"


def slant(d, taken: str | None = None) -> str:
    """sl(word, match, conf, nucleus, ord): equal coda with a near vowel, then longer and shorter codas of one ending.

    A match counts where it comes first: equal codas before longer ones before shorter ones, near vowels first.
    The first k stay; they are listed by confidence. Words of a group are met in their order, so 2 k + 1 of each are
    enough: of those that matter less than k came in an earlier group, and one may be the query itself.
    """
    base = f"{double(1.0)} - (CAST(dist AS DOUBLE) / 100)"
    penalty = f"extra * {double(PER_EXTRA)}"
    last = f"length(coda) - {SHORTEST_SUFFIX - 1}"
    k = "k" if taken is None else "left_"
    return f"""
sl_cut AS ({d.each('(SELECT DISTINCT coda FROM grp) c', 'coda', '2', last)}),
sl_long AS (SELECT coda AS longer, substr(coda, CAST(i AS INT)) AS suffix, CAST(i - 1 AS INT) AS extra FROM sl_cut),
sl_own AS ({d.each('qv', 'word, variant, norm, k, nucleus, coda', '2', last)}),
sl_target AS (
  SELECT word, variant, norm, k, nucleus, coda AS target, 0 AS layer, 0 AS extra, '' AS place FROM qv WHERE coda IS NOT NULL
  UNION ALL SELECT q.word, q.variant, q.norm, q.k, q.nucleus, s.longer, 1, s.extra, s.longer FROM qv q JOIN sl_long s ON s.suffix = q.coda
  UNION ALL SELECT word, variant, norm, k, nucleus, substr(coda, CAST(i AS INT)), 2, CAST(i - 1 AS INT), '' FROM sl_own),
sl_met AS (
  SELECT t.word, t.variant, t.k, t.layer, t.extra, t.place, g.word AS match, g.nucleus, CASE WHEN t.layer > 0 AND g.nucleus = t.nucleus THEN {SAME_VOWEL} ELSE v.d END AS dist
  FROM sl_target t JOIN grp g ON g.coda = t.target JOIN vd v ON v.a = t.nucleus AND v.b = g.nucleus
  WHERE g.turn <= 2 * t.k + 1 AND g.word <> t.norm AND (t.layer > 0 OR g.nucleus <> t.nucleus)),
sl_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, variant, match ORDER BY layer, place, extra, dist, nucleus) AS dup FROM sl_met WHERE dist <= {NEAREST}) t WHERE dup = 1),
sl_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, variant ORDER BY layer, place, extra, dist, nucleus, match) AS r FROM {_left('sl_first', taken)} f) t WHERE r <= {k}),
sl_conf AS (SELECT word, match, nucleus, {round4(f'CASE WHEN layer = 0 THEN {base} ELSE greatest(({base}) - {penalty}, {double(FLOOR)}) END')} AS conf FROM {best_variant('sl_kept')} x),
sl AS (SELECT word, match, conf, nucleus, row_number() OVER (PARTITION BY word ORDER BY conf DESC, match) AS ord FROM sl_conf)"""


def near(d, taken: str | None = None) -> str:
    """nr(word, match, conf, coda, ord): equal vowel, coda one phoneme apart; short codas only.

    Words are met in the order of codas and words, max(4 k, 200) of them; the k with the closest length stay.
    """
    k = "k" if taken is None else "left_"
    return f"""
nr_q AS (SELECT * FROM qv WHERE coda IS NOT NULL AND length(coda) <= {LONGEST_CODA}),
nr_to AS (
  SELECT q.word, q.variant, q.norm, q.k, q.nucleus, q.coda, e.neighbor, 0 AS branch FROM nr_q q JOIN edges e ON e.coda = q.coda
  UNION ALL SELECT q.word, q.variant, q.norm, q.k, q.nucleus, q.coda, s.coda, 1 FROM nr_q q JOIN (SELECT DISTINCT coda, nucleus FROM grp WHERE length(coda) = 1) s ON s.nucleus = q.nucleus WHERE q.coda = ''
  UNION ALL SELECT q.word, q.variant, q.norm, q.k, q.nucleus, q.coda, '', 1 FROM nr_q q WHERE length(q.coda) = 1),
nr_met AS (SELECT t.word, t.variant, t.k, t.coda, t.neighbor, t.branch, g.word AS match FROM nr_to t JOIN grp g ON g.coda = t.neighbor AND g.nucleus = t.nucleus WHERE g.turn <= 2 * greatest(4 * t.k, 200) + 1 AND g.word <> t.norm),
nr_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, variant, match ORDER BY branch, neighbor) AS dup FROM nr_met) t WHERE dup = 1),
nr_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, variant ORDER BY branch, neighbor, match) AS r FROM {_left('nr_first', taken)} f) t WHERE {k} > 0 AND r <= greatest(4 * {k}, 200)),
nr_rank AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY abs(length(neighbor) - length(coda)), match) AS ord FROM {best_variant('nr_kept')} x),
nr AS (SELECT word, match, {double(0.5)} AS conf, neighbor AS coda, ord FROM nr_rank WHERE ord <= {k})"""


def described(d, rows: str, kind: str | None) -> str:
    """Matches with the pronunciation under which each match itself is found (empty without one), of one kind or (None) of their own."""
    return f"""SELECT r.word, CAST(r.ord AS INT) AS pos, r.match, {ph.arpabet("coalesce(m.pron, '')", d)} AS phonemes, CAST(coalesce(m.syllables, 0) AS INT) AS syllables, {'r.rhyme_type' if kind is None else repr(kind)} AS rhyme_type, r.conf AS confidence FROM {rows} r LEFT JOIN key0 m ON m.word = r.match"""


TAKEN = "n1 AS (SELECT word, count(*) AS taken FROM pf GROUP BY word)"


def rest(d) -> str:
    """all_(word, match, conf, rhyme_type, ord) from qv, pf and sl."""
    return f"""
m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, match ORDER BY step) AS dup FROM (SELECT word, match, conf, 0 AS step, ord FROM pf UNION ALL SELECT word, match, conf, 1, ord FROM sl) t) u WHERE dup = 1),
n2 AS (SELECT word, count(*) AS taken FROM m2 GROUP BY word),
{near(d, 'n2')},
m3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, match ORDER BY step) AS again FROM (SELECT word, match, conf, step, ord FROM m2 UNION ALL SELECT word, match, conf, 2, ord FROM nr) t) u WHERE again = 1),
lim AS (SELECT DISTINCT word, k FROM qv),
all_ AS (SELECT t.word, t.match, t.conf, CASE t.step WHEN 0 THEN 'perfect' WHEN 1 THEN 'slant' ELSE 'near' END AS rhyme_type, t.pos AS ord FROM (SELECT word, match, conf, step, row_number() OVER (PARTITION BY word ORDER BY step, ord) AS pos FROM m3) t JOIN lim ON lim.word = t.word WHERE t.pos <= lim.k)"""


def merged(d) -> str:
    """all_: perfect, then slant, then near rhymes, each with the places the ones before left of k."""
    return f"{perfect(d)}, {TAKEN}, {slant(d, 'n1')}, {rest(d)}"
