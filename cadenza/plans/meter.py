"""SQL of meter detection and of the comparison of two patterns, over strings of 0 and 1."""

from __future__ import annotations

from cadenza.functions.dialect import double, round4

# Feet in the order that decides ties, and the names of meters.
FEET = [("iamb", "01", "iambic"), ("trochee", "10", "trochaic"), ("anapest", "001", "anapestic"), ("dactyl", "100", "dactylic"), ("spondee", "11", "spondaic"), ("pyrrhic", "00", "pyrrhic")]
COUNTS = ["", "monometer", "dimeter", "trimeter", "tetrameter", "pentameter", "hexameter", "heptameter", "octameter"]


def regularity(bits: str, foot: str, d) -> str:
    """Of rows with ``packed`` bits: share of places where the foot repeated agrees, less a twentieth of the part of a foot left over."""
    m, n = len(foot), f"length({bits})"
    agree = d.agreeing(bits, "packed", foot)
    cut = f"CASE WHEN {n} % {m} > 0 THEN {double(1)} - ({double(0.05)} * ({n} % {m}) / {m}) ELSE {double(1)} END"
    return f"CASE WHEN {n} < {m} THEN {double(0)} ELSE {round4(f'(CAST({agree} AS DOUBLE) / {n}) * ({cut})')} END"


def detected(rows: str, bits: str, d) -> str:
    """Rows gain foot_type, foot_count, meter_name and regularity; an empty pattern has none, a pattern too short for
    any foot is a bare iamb of regularity 0."""
    each = ", ".join(f"{regularity(bits, f, d)} AS r_{name}" for name, f, _ in FEET)
    top = f"greatest({', '.join(f'r_{name}' for name, _, _ in FEET)})"
    pick = lambda what: " ".join(f"WHEN r_{name} = top THEN {what(name, f, adj)}" for name, f, adj in FEET)
    one = f"SELECT *, {each} FROM (SELECT *, {d.packed(bits)} AS packed FROM {rows}) m0"
    two = f"SELECT *, {top} AS top FROM ({one}) m1"
    three = f"SELECT *, CASE WHEN {bits} = '' THEN 'none' {pick(lambda n, f, a: repr(n))} END AS foot_type, CASE WHEN {bits} = '' THEN 0 {pick(lambda n, f, a: f'CAST(floor(length({bits}) / {double(len(f))}) AS INT)')} END AS foot_count, CASE WHEN {bits} = '' THEN '' {pick(lambda n, f, a: repr(a))} END AS adjective FROM ({two}) m2"
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(COUNTS) if n)
    return f"SELECT *, CASE WHEN foot_count = 0 THEN foot_type ELSE concat(adjective, ' ', CASE foot_count {names} ELSE concat(CAST(foot_count AS STRING), '-meter') END) END AS meter_name, top AS regularity FROM ({three}) m3"


def agreement(a: str, b: str, d) -> str:
    """Agreeing places over the longer length; 1 for two empty patterns."""
    n, m = f"least(length({a}), length({b}))", f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {m} = 0 THEN {double(1)} WHEN {n} = 0 THEN {double(0)} ELSE {round4(f'CAST({d.equal_places(f"substr({a}, 1, {n})", f"substr({b}, 1, {n})")} AS DOUBLE) / {m}')} END"
