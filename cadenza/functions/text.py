"""Words of a line: three tokenizers, normal form, dropped g, estimated syllables. Columns for Spark, SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A = r"\p{IsAlphabetic}"
#: Runs of letters, apostrophes and hyphens.
TOKEN_W = rf"([{A}'\-]+)"
#: Letters, an apostrophe between letters or after a dropped g. Possessive runs, so that no long word recurses.
TOKEN_S = rf"([iI][nN](?='(?!{A}))|{A}++(?:(?:(?<=[iI][nN])')?'{A}++)*+(?:(?<=[iI][nN])')?+)"
#: As S with inner hyphens.
TOKEN_M = rf"([iI][nN](?='(?!{A}))|{A}++(?:(?:(?<=[iI][nN])')?[-']{A}++)*+(?:(?<=[iI][nN])')?+)"
PATTERNS = {"w": TOKEN_W, "s": TOKEN_S, "m": TOKEN_M}
#: DuckDB's engine has no lookaround; these agree on texts without apostrophes.
DUCK_PATTERNS = {"w": r"[\p{L}''\-]+", "s": r"\p{L}+", "m": r"\p{L}+(?:-\p{L}+)*"}

# Words that verse leaves unstressed.
FUNCTION_WORDS = (
    "A AM AN AND ARE AS AT BE BUT BY CAN DID DO FOR FROM HAD HAS HAVE HE HER HIM HIS I IF IN IS IT ITS MAY ME MY NOR NOT OF ON OR "
    "OUR SHALL SHE SO THAN THAT THE THEE THEM THEN THERE THEY THY TILL TO UP US WAS WE WERE WHAT WHEN WHO WHOM WILL WITH WOULD YE "
    "YET YOU YOUR"
).split()


def tokens(text: Column, kind: str) -> Column:
    """Array of tokens; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[kind]), F.lit(1))


def drops_g(word: Column) -> Column:
    """Ends in ``in'`` (before other marks) after at least one more letter."""
    return F.contains(word, F.lit("'")) & F.rlike(word, F.lit(rf"(?s){A}.*[iI][nN]'[^{A}']*\z"))


def normalize(word: Column, token: bool = False) -> Column:
    """Letters in upper case (one code point each), apostrophes and hyphens; a dropped g comes back. A ``token`` of the
    tokenizers above holds nothing else."""
    kept = F.upper(F.translate(word if token else F.regexp_replace(word, rf"[^{A}'\-]", ""), "ß", "S"))
    return F.when(drops_g(word) & F.endswith(kept, F.lit("'")), F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), F.lit("G"))).otherwise(kept)


def estimated_syllables(word: Column) -> Column:
    """Runs of vowel letters, at least one."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(word, F.lit("([aeiouyAEIOUY]+)"), F.lit(1))))


def function_word(norm: Column) -> Column:
    return norm.isin(FUNCTION_WORDS)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def blank(text: Column) -> Column:
    """Nothing but Unicode white space."""
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S"))


# The same for DuckDB.


def duck_tokens(text: str, kind: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{DUCK_PATTERNS[kind]}')"


def duck_kept(word: str) -> str:
    return rf"upper(translate(regexp_replace({word}, '[^\p{{L}}''\-]', '', 'g'), 'ß', 'S'))"


def duck_drops_g(word: str) -> str:
    return rf"regexp_matches({word}, '(?s)\p{{L}}.*[iI][nN]''[^\p{{L}}'']*\z')"


def duck_normalize(word: str) -> str:
    k = duck_kept(word)
    return f"CASE WHEN {duck_drops_g(word)} AND right({k}, 1) = '''' THEN left({k}, length({k}) - 1) || 'G' ELSE {k} END"


def duck_estimated(word: str) -> str:
    return f"greatest(1, len(regexp_extract_all({word}, '[aeiouyAEIOUY]+')))"
