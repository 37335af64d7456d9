"""The few places where Spark SQL and DuckDB spell one expression differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def replace_all(c: str, pattern: str, to: str) -> str:
        return f"regexp_replace({c}, '{pattern}', '{to}')"

    @staticmethod
    def equal_places(a: str, b: str) -> str:
        """Number of places at which two strings of equal length agree."""
        return f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> CASE WHEN x = y THEN 1 ELSE 0 END), 0, (s, x) -> s + x)"

    @staticmethod
    def packed(bits: str) -> str:
        """A string of 0 and 1 as numbers of 60 places each, the last one filled with zeros."""
        return f"transform(sequence(0, greatest(0, (length({bits}) - 1) div 60)), i -> CAST(conv(rpad(substr({bits}, CAST(i * 60 + 1 AS INT), 60), 60, '0'), 2, 10) AS BIGINT))"

    @staticmethod
    def agreeing(bits: str, packed: str, foot: str) -> str:
        """Number of places at which ``bits`` agrees with a foot (of 2 or 3 places) repeated."""
        p = int((foot * 60)[:60], 2)
        filled = f"60 * size({packed}) - length({bits})"
        return f"(length({bits}) - aggregate({packed}, 0, (s, x) -> s + bit_count(x ^ {p}L)) + bit_count({p}L & (shiftleft(1L, {filled}) - 1L)))"

    @staticmethod
    def each(rows: str, columns: str, low: str, high: str) -> str:
        """Rows with a column i of every number from low to high; none where high is less."""
        return f"SELECT {columns}, explode(sequence({low}, {high})) AS i FROM {rows} WHERE {high} >= {low}"

    @staticmethod
    def names(c: str, chars: str, table: list[str]) -> str:
        """Space-joined names of a string's characters."""
        words = ", ".join(f"'{w}'" for w in table)
        return f"CASE WHEN {c} = '' THEN '' ELSE array_join(transform(sequence(1, length({c})), i -> element_at(array({words}), instr('{chars}', substr({c}, i, 1)))), ' ') END"


class Duck:
    name = "duckdb"

    @staticmethod
    def replace_all(c: str, pattern: str, to: str) -> str:
        return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"

    @staticmethod
    def equal_places(a: str, b: str) -> str:
        return f"(length({a}) - hamming({a}, {b}))"

    @staticmethod
    def packed(bits: str) -> str:
        return "NULL"

    @staticmethod
    def agreeing(bits: str, packed: str, foot: str) -> str:
        n = f"length({bits})"
        return Duck.equal_places(bits, f"substr(repeat('{foot}', CAST({n} AS INT)), 1, {n})")

    @staticmethod
    def each(rows: str, columns: str, low: str, high: str) -> str:
        return f"SELECT {columns}, unnest(range({low}, CAST({high} AS BIGINT) + 1)) AS i FROM {rows}"

    @staticmethod
    def names(c: str, chars: str, table: list[str]) -> str:
        words = ", ".join(f"'{w}'" for w in table)
        return f"CASE WHEN {c} = '' THEN '' ELSE array_to_string(list_transform(range(1, length({c}) + 1), lambda i: ([{words}])[instr('{chars}', substr({c}, CAST(i AS INTEGER), 1))]), ' ') END"


def round4(v: str) -> str:
    """Four decimals, halves away from zero, on the binary value."""
    return f"(round(({v}) * 10000) / 10000)"


def double(v: object) -> str:
    return f"CAST({v} AS DOUBLE)"
