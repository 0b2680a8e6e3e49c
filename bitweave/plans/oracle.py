"""DuckDB SQL of the engine's queries, from the definitions: every term finds its partner by a self-join.

Nothing of the engine is imported: gates, masks and angles are written out here.
"""

from __future__ import annotations

import math

WIDTH = 8  # modes of the narrow operators
NARROW = "BIGINT"


def slots(*places: int) -> int:
    return sum(1 << s for s in places)


def evens(n: int) -> int:
    """The even slots of n modes."""
    return sum(1 << 2 * q for q in range(n))


#: Generators and angles: X1 Z3, Y2 Y6, Z0 X4, X7; Majorana products of 2, 4, 3 and 2 modes; and those of wide systems.
PAULI = [(slots(2, 6, 7), 0.3), (slots(5, 13), -0.45), (slots(0, 1, 8), 0.7), (slots(14), 0.25)]
MAJORANA = [(slots(2, 5), 0.3), (slots(0, 3, 7, 10), -0.45), (slots(1, 6, 12), 0.7), (slots(4, 15), 0.25)]
WIDE = [(slots(6, 14, 15), 0.3), (slots(11, 41), -0.45), (slots(20, 21, 34), 0.7), (slots(46), 0.25)]
TWO_WORDS = [(slots(6, 80, 81), 0.3), (slots(11, 91), -0.45), (slots(20, 21, 100), 0.7)]
LOWEST = (2, 5, 0)  # the lowest slot of the first three Pauli generators
OCCUPIED = slots(0, 6, 10)  # modes 0, 3 and 5

HASH = "l_partkey * 2654435761 + l_suppkey * 40503 + l_linenumber"
OP = f"op AS (SELECT ({HASH}) & 65535 AS m, CAST(SUM(CAST(l_quantity AS BIGINT) - 25) AS DOUBLE) / 1000 AS c FROM lineitem GROUP BY 1)"
WIDE_HASH = "((l_partkey % 1048576) * 2654435761 + (l_suppkey % 1048576) * 40503 + (l_orderkey % 16777216) * 97 + l_linenumber)"
SECOND_HASH = "((l_orderkey % 16777216) * 48271 + (l_partkey % 1048576) * 69621)"


def thin(key: str, bits: int) -> str:
    x = f"(xor({key}, {key} >> 9) & {2**bits - 1})"
    return f"({x} & ({x} >> 5))"


WIDE_OP = f"""op AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN (t & {evens(24)}) * 3 ELSE t END AS m, CAST(SUM(q) AS DOUBLE) / 1000 AS c
FROM (SELECT {thin(WIDE_HASH, 48)} AS t, l_linenumber, CAST(l_quantity AS BIGINT) - 25 AS q FROM lineitem) GROUP BY 1)"""
TWO_WORD_OP = f"""op AS (SELECT (CAST(b AS HUGEINT) << 64) + a AS m, CAST(SUM(q) AS DOUBLE) / 1000 AS c
FROM (SELECT {thin(WIDE_HASH, 40)} AS a, {thin(SECOND_HASH, 40)} AS b, CAST(l_quantity AS BIGINT) - 25 AS q FROM lineitem) GROUP BY 1)"""


# --- formulas over one monomial -------------------------------------------------------------------------------


def pc(x: str) -> str:
    return f"CAST(bit_count({x}) AS INTEGER)"


def weight(g: int) -> int:
    return bin(g).count("1")


def pair_swap(g: int) -> int:
    out = 0
    for s in range(128):
        if g >> s & 1:
            out |= 1 << (s + 1 if s % 2 == 0 else s - 1)
    return out


def odd_below(g: int, n: int) -> int:
    """The slots with an odd number of g's slots below them."""
    return sum(1 << s for s in range(n) if weight(g & (1 << s) - 1) % 2)


def maj_ac(m: str, g: int) -> str:
    return f"(({pc(m)} * {weight(g)} + {pc(f'({m} & {g})')}) % 2 = 1)"


def maj_sign(m: str, g: int) -> str:
    return f"(1 - 2 * ({pc(f'({m} & {odd_below(g, 2 * WIDTH)})')} % 2))"


def maj_phase(m: str, g: int) -> str:
    a, b, common = pc(m), weight(g), pc(f"({m} & {g})")
    i = f"({a} + {b} - 2 * {common})"
    turn = f"((({a} * ({a} - 1)) // 2 + {b * (b - 1) // 2} - ({i} * ({i} - 1)) // 2 + 3) % 4 + 4) % 4"
    return f"({maj_sign(m, g)} * CASE {turn} WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)"


def pauli_ac(m: str, g: int, n: int = WIDTH) -> str:
    return f"({pc(f'({m} & {pair_swap(g)})')} % 2 = 1)"


def pauli_phase(m: str, g: int, n: int, kind: str) -> str:
    """The letters Y before and after, and where Z of the term meets X or Y of the generator."""
    even = evens(n)
    other = f"xor({m}, {g}::{kind})"
    ys = lambda x: pc(f"(({x} >> 1) & {even} & ~({x} & {even}))")
    gx, gz = g & even, g >> 1 & even
    e = f"({weight(gz & ~gx)} + {ys(m)} - {ys(other)} + 2 * {pc(f'(({m} >> 1) & {gx ^ gz})')})"
    return f"(CASE WHEN (({e} % 4) + 4) % 4 = 1 THEN -1 ELSE 1 END)"


def is_paired(m: str, n: int = WIDTH) -> str:
    return f"(xor({m} & {evens(n)}, ({m} >> 1) & {evens(n)}) = 0)"


def support(m: str, n: int = WIDTH) -> str:
    return pc(f"(({m} | ({m} >> 1)) & {evens(n)})")


def state(m: str, basis: str, n: int = WIDTH) -> str:
    power = pc(f"({m} & {OCCUPIED})") + (f" + {pc(m)} // 2" if basis == "majorana" else "")
    return f"(CASE WHEN {is_paired(m, n)} THEN CASE WHEN ({power}) % 2 = 0 THEN 1.0 ELSE -1.0 END END)"


def long_at_most(limit: int) -> str:
    return f"{is_paired('p')} OR {pc('p')} <= {limit}"


def wide_at_most(limit: int, n: int = WIDTH) -> str:
    return f"{is_paired('p', n)} OR {support('p', n)} <= {limit}"


def image(m: str) -> str:
    """The Jordan-Wigner image of a Majorana product: each slot brings itself and the pairs below it."""
    out = "0::BIGINT"
    for k in range(2 * WIDTH):
        brought = slots(*range(k - k % 2), k)
        out = f"xor({out}, (CASE WHEN ({m} >> {k}) & 1 = 1 THEN {brought} ELSE 0 END)::BIGINT)"
    return out


# --- rotations ------------------------------------------------------------------------------------------------


def gate(src: str, out: str, basis: str, g: int, angle: float, keep: str = "TRUE", lower=None, upper=None, longest=None, schrodinger=False, n: int = WIDTH, kind: str = NARROW) -> str:
    """CTEs from src to out. keep: predicate over the partner p. Every row finds its partner by a self-join."""
    ac, phase = (pauli_ac("m", g), pauli_phase("m", g, n, kind)) if basis == "pauli" else (maj_ac("m", g), maj_phase("m", g))
    cos, sin = math.cos(2 * angle), math.sin(2 * angle)
    turn = -sin if schrodinger else sin
    size = f"(abs(c) * {abs(sin)!r})"
    fed = f"({keep})"
    if upper is not None:
        fed = f"({fed} OR {size} >= {upper!r})"
    if lower is not None:
        fed = f"({fed} AND {size} > {lower!r})"
    el = "TRUE" if longest is None else f"({pc('m')} <= {longest})"
    fm, fp = (f"coalesce({state(x, basis)}, 0)" if schrodinger else "0" for x in "mp")
    return f"""{out}_a AS (SELECT m, c, p, {ac} AS ac, {phase} AS ph, {el} AS el, {ac} AND {el} AND {fed} AS fed FROM (SELECT m, c, xor(m, {g}::{kind}) AS p FROM {src})),
{out}_b AS (SELECT x.m, x.p, x.c, x.ac, x.ph, x.el, y.c AS d, x.fed OR coalesce(y.fed, FALSE) AS rot FROM {out}_a x LEFT JOIN {out}_a y ON x.ac AND x.p = y.m),
{out} AS (SELECT m, CASE WHEN NOT ac THEN c WHEN rot THEN (CASE WHEN el THEN {cos!r} ELSE 1 END) * c - ({turn!r} * ph) * coalesce(d, {fp}) WHEN el THEN {cos!r} * c ELSE c END AS c FROM {out}_b
UNION ALL SELECT p, {cos!r} * {fp} + ({turn!r} * ph) * c FROM {out}_b WHERE ac AND rot AND d IS NULL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def chain(basis: str, gates, src: str = OP, name: str = "t", **how) -> tuple[list[str], str]:
    out, last = [src], src.split()[0]
    for i, (g, angle) in enumerate(gates):
        out.append(gate(last, f"{name}{i}", basis, g, angle, **how))
        last = f"{name}{i}"
    return out, last


PUBLIC = "SELECT m, round(c, 9) AS c FROM "


def circuit(basis: str, gates, **how) -> str:
    ctes, last = chain(basis, gates, **how)
    return with_(*ctes) + PUBLIC + last


def expval(basis: str, gates, **how) -> str:
    ctes, last = chain(basis, gates, **how)
    return with_(*ctes) + f"SELECT round(SUM(c * {state('m', basis)}), 6) AS expval FROM {last} WHERE {is_paired('m')}"


def shift_rule(gates, src: str = OP, **how) -> str:
    """Each layer's slope: the difference of the expectation values at angles shifted by an eighth of a turn."""
    n = how.get("n", WIDTH)
    ctes, slopes = [src], []
    for k in range(len(gates)):
        ends = []
        for s, sign in ((1, "u"), (-1, "d")):
            parts, last = chain("pauli", [(g, a + s * math.pi / 4 * (i == k)) for i, (g, a) in enumerate(gates)], src, f"{sign}{k}_", **how)
            ctes += parts[1:]
            ends.append(f"(SELECT coalesce(SUM(c * {state('m', 'pauli', n)}), 0) FROM {last} WHERE {is_paired('m', n)})")
        slopes.append(f"SELECT {k} AS layer, round({ends[0]} - {ends[1]}, 6) AS slope")
    return with_(*ctes) + " UNION ALL ".join(slopes)


def terms(columns: str) -> str:
    return with_(OP) + f"SELECT m, {columns} FROM op"


def ising(steps: int, qubits: int) -> list[tuple[int, float]]:
    """ZZ bonds of a chain, then X and Z fields, dt = 0.05, J = 1.5, both fields 1."""
    bonds = [(slots(2 * q, 2 * q + 1, 2 * q + 2, 2 * q + 3), -0.075) for q in range(qubits - 1)]
    return (bonds + [(slots(2 * q), -0.05) for q in range(qubits)] + [(slots(2 * q, 2 * q + 1), -0.05) for q in range(qubits)]) * steps


def lattice() -> list[tuple[int, float]]:
    """A Trotter step of the 2 x 2 lattice in the order in which an operator passes it: X fields, Z fields, bonds, each
    group from its end; generators -P/2 driven by dt times the coupling."""
    bonds = [(0, 1), (0, 2), (1, 3), (2, 3)]
    step = [(slots(2 * a, 2 * a + 1, 2 * b, 2 * b + 1), -0.0375) for a, b in bonds]
    step += [(slots(2 * q, 2 * q + 1), -0.025) for q in range(4)] + [(slots(2 * q), -0.025) for q in range(4)]
    return step[::-1]


# --- authoring ------------------------------------------------------------------------------------------------


def sorted_products(rows: str, places: list[str]) -> str:
    """(idx, sign) of products of a few Majoranas given as columns: inversions counted pair by pair."""
    swaps = " + ".join(f"CAST({a} > {b} AS INTEGER)" for i, a in enumerate(places) for b in places[i + 1 :])
    every = f"[{', '.join(places)}]"
    kept = f"list_filter(list_sort(list_distinct({every})), lambda x: len(list_filter({every}, lambda y: y = x)) % 2 = 1)"
    return f"SELECT *, array_to_string({kept}, ',') AS idx, 1 - 2 * (({swaps}) % 2) AS sign FROM {rows}"


LADDERS = "(SELECT CAST(l_partkey % 8 AS INTEGER) AS p, CAST(l_suppkey % 8 AS INTEGER) AS q, l_linenumber AS r, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS v FROM lineitem)"


def ladder_expand() -> str:
    """a+_p a_q: a quarter of (m_2p - i m_2p+1)(m_2q + i m_2q+1)."""
    four = " UNION ALL ".join(f"SELECT 2 * p + {a} AS a, 2 * q + {b} AS b, {re} * v / 4 AS re, {im} * v / 4 AS im FROM {LADDERS}" for a, b, re, im in ((0, 0, 1, 0), (0, 1, 0, 1), (1, 0, 0, -1), (1, 1, 1, 0)))
    return f"SELECT idx, SUM(sign * re) AS re, SUM(sign * im) AS im FROM ({sorted_products(f'({four})', ['a', 'b'])}) GROUP BY idx"


def ladder_canonical() -> str:
    """a_p a+_q a_r: the raising one to the front, then the others ascending."""
    swaps = "1 + CAST(p > r AS INTEGER)"
    name = "concat(q, '+,', least(p, r), '-,', greatest(p, r), '-')"
    return f"SELECT {name} AS ladder, SUM(v * (1 - 2 * (({swaps}) % 2))) AS c FROM {LADDERS} GROUP BY 1"


def integrals() -> str:
    rows = "(SELECT l_partkey % 4 AS p, l_suppkey % 4 AS q, l_orderkey % 4 AS r, l_linenumber % 4 AS t, l_partkey // 4 % 3 AS block, CAST(l_quantity AS BIGINT) - 25 AS v FROM lineitem)"
    one = f"SELECT concat(p + 4 * (block % 2), '+,', q + 4 * (block % 2), '-') AS ladder, v / 1024 AS c FROM {rows}"
    # a+_a a+_b a_c a_d: blocks 0, 1, 2 are of spins up-up, up-down, down-down
    two = f"""SELECT p + CASE block WHEN 2 THEN 4 ELSE 0 END AS a, r + CASE block WHEN 0 THEN 0 ELSE 4 END AS b, t + CASE block WHEN 0 THEN 0 ELSE 4 END AS c, q + CASE block WHEN 2 THEN 4 ELSE 0 END AS d,
    v / 1024 * CASE block WHEN 1 THEN 1.0 ELSE 0.5 END AS v FROM {rows}"""
    pairs = f"SELECT concat(least(a, b), '+,', greatest(a, b), '+,', least(c, d), '-,', greatest(c, d), '-') AS ladder, v * (CASE WHEN a < b THEN 1 ELSE -1 END) * (CASE WHEN c < d THEN 1 ELSE -1 END) AS c FROM ({two}) WHERE a <> b AND c <> d"
    return f"SELECT ladder, round(SUM(c), 9) AS c FROM ({one} UNION ALL {pairs} UNION ALL SELECT '', 0.5) GROUP BY ladder HAVING abs(SUM(c)) > 1e-12"


def jordan_wigner() -> str:
    """Site by site: the string of Z from the odd sites above turns a letter, and each turn or whole pair is a factor i.

    letter l of qubit q (0 I, 1 X, 2 Y, 3 Z) and the number t of letters X and Y above it give the site's content:
    without a string l itself, with one 3 - l; X under a string came from m_2q+1 (factor i), Y from m_2q (factor -i),
    a whole pair is i Z, under a string i.
    """
    letter = [f"((m >> {2 * q}) & 3)" for q in range(WIDTH)]
    above = ["(" + " + ".join(["0", *(f"CAST({letter[k]} IN (1, 2) AS INTEGER)" for k in range(q + 1, WIDTH))]) + ") % 2" for q in range(WIDTH)]
    content = [f"(CASE WHEN {t} = 0 THEN {x} ELSE 3 - {x} END)" for x, t in zip(letter, above)]
    turns = [f"(CASE WHEN {c} = 3 THEN 1 WHEN {t} = 1 AND {x} = 1 THEN 1 WHEN {t} = 1 AND {x} = 2 THEN 3 ELSE 0 END)" for x, t, c in zip(letter, above, content)]
    moved = " + ".join(f"{c} * {4**q}" for q, c in enumerate(content))
    rows = f"SELECT c, CAST({moved} AS BIGINT) AS m, {' + '.join(turns)} AS e FROM op"
    n = pc("m")
    return with_(OP) + f"SELECT m, round(CASE WHEN (e + {n} * ({n} - 1) // 2) % 4 = 0 THEN c ELSE -c END, 9) AS c FROM ({rows})"


def decoded(m: str = "m") -> str:
    """Slots, and the coefficient times i to the power (n choose 2)."""
    turn = f"({pc(m)} * ({pc(m)} - 1) // 2) % 4"
    idx = f"array_to_string(list_filter(range(0, {2 * WIDTH}), lambda s: ({m} >> s) & 1 = 1), ',')"
    return f"{idx} AS idx, CASE {turn} WHEN 0 THEN c WHEN 2 THEN -c ELSE 0.0 END AS re, CASE {turn} WHEN 1 THEN c WHEN 3 THEN -c ELSE 0.0 END AS im"


def commuting() -> str:
    row = f"SELECT DISTINCT l_orderkey AS gate, ({HASH}) & 65535 AS m FROM lineitem"
    swapped = f"(((y.m & {evens(WIDTH)}) << 1) | ((y.m >> 1) & {evens(WIDTH)}))"
    pauli = f"{pc(f'(x.m & {swapped})')} % 2 = 0"
    majorana = f"(x.m = y.m OR ({pc('x.m')} * {pc('y.m')} + {pc('(x.m & y.m)')}) % 2 = 0)"
    return f"WITH g AS ({row}) SELECT x.gate, bool_and({pauli}) AS pauli, bool_and({majorana}) AS majorana FROM g x JOIN g y ON x.gate = y.gate GROUP BY x.gate"


GATE_LIST = """
WITH r AS (SELECT ['rx', 'rzz', 'ryy', 'barrier', 'rxz'][l_linenumber % 5 + 1] AS name, l_partkey % 8 AS a, (l_partkey + 1 + l_suppkey % 7) % 8 AS b, l_discount AS v FROM lineitem),
s AS (SELECT CASE name WHEN 'rx' THEN [2 * a] WHEN 'rzz' THEN [2 * a, 2 * a + 1, 2 * b, 2 * b + 1] WHEN 'ryy' THEN [2 * a + 1, 2 * b + 1] ELSE [2 * a, 2 * b, 2 * b + 1] END AS idx, v FROM r WHERE name <> 'barrier')
SELECT array_to_string(list_sort(idx), ',') AS idx, -0.5 AS gcoef, COUNT(*) AS gates, round(SUM(v), 6) AS angle FROM s GROUP BY 1"""
GATE_GROUPS = """
SELECT l_orderkey, gate, COUNT(*) AS terms FROM (
  SELECT l_orderkey, CAST(SUM(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) - 1 AS gate FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = l_returnflag THEN 0 ELSE 1 END AS new FROM lineitem)) GROUP BY 1, 2"""


def edges(ctes: list[str], n: int = 3) -> str:
    """The lower end of each rotated pair: the one without its generator's lowest slot."""
    return with_(*ctes) + " UNION ALL ".join(f"SELECT DISTINCT CASE WHEN (m >> {LOWEST[i]}) & 1 = 0 THEN m ELSE p END AS m, {i} AS layer FROM t{i}_b WHERE ac AND rot" for i in range(n))


def oracle_sql() -> dict[str, str]:
    g, p, triple = MAJORANA[1][0], PAULI[1][0], MAJORANA[2][0]
    four, three = {"keep": wide_at_most(4)}, PAULI[:3]
    graph, last = chain("pauli", three, **four)
    ends = " UNION ".join(f"SELECT unnest([m, p]) AS m FROM t{i}_b WHERE ac AND rot" for i in range(3))
    rotated = " UNION ALL ".join(f"SELECT DISTINCT least(m, p) AS m, {i} AS layer FROM t{i}_b WHERE ac AND rot" for i in range(3))
    spread = " + ".join(f"((id >> {q}) & 1) * {3 << 2 * q}" for q in range(WIDTH))
    start = f"st AS (SELECT m, {state('m', 'majorana')} AS c FROM (SELECT CAST({spread} AS BIGINT) AS m FROM range(0, {1 << WIDTH}) r(id)))"
    both, evolved = chain("majorana", MAJORANA[:2], start, "s", schrodinger=True)
    first, once = chain("majorana", MAJORANA[:1], start, "s", schrodinger=True)
    fields = ", ".join(f"({m}, {c!r})" for m, c in [(slots(4, 5, 6, 7), 1.0)])
    n24 = {"n": 24, "src": WIDE_OP}
    wide, wide_last = chain("pauli", WIDE, keep=wide_at_most(12, 24), **n24)
    out = {
        "op_merge": with_(OP) + "SELECT m, round(SUM(c), 9) AS c FROM (SELECT * FROM op UNION ALL SELECT * FROM op) GROUP BY m",
        "op_popcount": terms(f"{pc('m')} AS length"),
        "op_support": terms(f"{support('m')} AS support"),
        "op_paired": terms(f"{is_paired('m')} AS paired"),
        "op_state_phase": terms(f"CAST({state('m', 'majorana')} AS INTEGER) AS majorana, CAST({state('m', 'pauli')} AS INTEGER) AS pauli"),
        "antihermitian": terms(f"{pc('m')} % 4 IN (2, 3) AS antihermitian"),
        "maj_anticommute": terms(f"{maj_ac('m', g)} AS even_g, {maj_ac('m', triple)} AS odd_g"),
        "pauli_anticommute": terms(f"{pauli_ac('m', p)} AS ac"),
        "partner": terms(f"xor(m, {g}::BIGINT) AS partner, least(m, xor(m, {g}::BIGINT)) AS pair_key"),
        "interleave_sign": terms(f"{maj_sign('m', g)} AS sign"),
        "hermitian_phase": terms(f"CASE WHEN {maj_ac('m', g)} THEN {maj_phase('m', g)} ELSE 0 END AS phase"),
        "pauli_sign": terms(f"CASE WHEN {pauli_ac('m', p)} THEN {pauli_phase('m', p, WIDTH, NARROW)} ELSE 0 END AS phase"),
        "jw_support": with_(OP) + f"SELECT m, image, {support('image')} AS support FROM (SELECT m, {image('m')} AS image FROM op)",
        "maj_gate": circuit("majorana", MAJORANA[1:2]),
        "maj_gate_odd": circuit("majorana", MAJORANA[2:3]),
        "pauli_gate": circuit("pauli", PAULI[:1]),
        "gate_length": circuit("majorana", MAJORANA[1:2], keep=long_at_most(8)),
        "gate_support": circuit("pauli", PAULI[1:2], keep=wide_at_most(5)),
        "gate_lower_atol": circuit("pauli", PAULI[2:3], keep=wide_at_most(5), lower=0.005),
        "gate_upper_atol": circuit("pauli", PAULI[2:3], keep=wide_at_most(4), lower=0.005, upper=0.02),
        "gate_len_k": circuit("majorana", MAJORANA[:1], keep=long_at_most(10), longest=8),
        "schrodinger_gate": circuit("majorana", MAJORANA[:1], schrodinger=True),
        "gate_basis_change": circuit("majorana", MAJORANA[1:2], keep=f"{is_paired(image('p'))} OR {pc(image('p'))} <= 8"),
        "gate_predicate": circuit("pauli", PAULI[:1], keep="(p & 512) = 0"),
        "circuit_3": circuit("pauli", three, keep=wide_at_most(5), lower=0.001),
        "maj_circuit_batch": circuit("majorana", MAJORANA[:3], keep=long_at_most(9)),
        "circuit_batch": circuit("pauli", three, keep=wide_at_most(5), lower=0.001),
        "propagate_buckets": circuit("pauli", three, keep=wide_at_most(5), lower=0.001),
        "propagate_majorana": circuit("majorana", MAJORANA[:3], keep=long_at_most(9)),
        "propagate_tolerances": circuit("majorana", MAJORANA[:2], keep=long_at_most(6), lower=0.003, upper=0.03),
        "propagate_len_k": circuit("majorana", MAJORANA[:1], keep=long_at_most(10), longest=8),
        "propagate_schrodinger": with_(*both) + PUBLIC + evolved,
        "untouched_gate": circuit("pauli", PAULI[:1]),
        "identity_dropped": circuit("pauli", PAULI[:1]),
        "circuit_sum": circuit("pauli", three, keep=wide_at_most(5), lower=0.001),
        "copied": with_(OP) + PUBLIC + "op",
        "expval": expval("pauli", three),
        "maj_expval": expval("majorana", MAJORANA[:3]),
        "expval_shifted": expval("pauli", [(x, a + math.pi / 4 * (i == 0)) for i, (x, a) in enumerate(three)]),
        "schrodinger_expval": with_(OP, *both) + f"SELECT round(SUM(op.c * s.c), 6) AS expval FROM op JOIN {evolved} s ON op.m = s.m",
        "core_term": with_(OP) + f"SELECT 1.25 AS core, CAST(COUNT(*) AS BIGINT) AS terms, round(1.25 + SUM(c * coalesce({state('m', 'pauli')}, 0)), 6) AS expval FROM op WHERE m <> 0",
        "gradient": shift_rule(three),
        "functional_value": with_(*graph) + " UNION ALL ".join(f"SELECT '{f}' AS functional, round(SUM(c * {state('m', 'pauli')}), 6) AS expval FROM {last} WHERE {is_paired('m')}" for f in ("whole", "pared")),
        "functional_gradient": shift_rule(three),
        "norm_check": with_(*(c := chain("majorana", MAJORANA))[0]) + f"SELECT 'before' AS step, round(SUM(c * c), 4) AS norm FROM op UNION ALL SELECT 'after', round(SUM(c * c), 4) FROM {c[1]}",
        "graph_edges": edges(graph),
        "graph_structural": edges(graph),
        "graph_size": with_(*graph) + " UNION ALL ".join(f"SELECT {i} AS layer, CAST(SUM(CAST(ac AND NOT rot AS BIGINT)) AS BIGINT) AS cosine_only, COUNT(DISTINCT CASE WHEN ac AND rot THEN least(m, p) END) AS cycles FROM t{i}_b" for i in range(3)),
        "graph_slice": with_(*graph) + " UNION ALL ".join(f"SELECT {i} AS layer, COUNT(DISTINCT least(m, p)) AS pairs FROM t{i}_b WHERE ac AND rot" for i in range(2)),
        "replay": with_(*graph) + PUBLIC + last,
        "replay_buckets": with_(*graph) + PUBLIC + last,
        "contract": with_(*graph) + PUBLIC + last,
        "graph_seeded": with_(*graph) + PUBLIC + last,
        "replay_expval": with_(*graph) + f"SELECT round(SUM(c * {state('m', 'pauli')}), 6) AS expval FROM {last} WHERE {is_paired('m')}",
        "rewired_expval": "SELECT *, CAST(1 AS BIGINT) AS parameters FROM (" + expval("pauli", [(x, 0.35) for x, _ in three]) + ")",
        "pare_mask": with_(*graph) + f"SELECT m FROM {last} WHERE m <> 0 AND (m IN ({ends}) OR {is_paired('m')})",
        "sizes": with_(*graph)
        + f"SELECT t.n AS terms, t.n * 20 AS term_bytes, e.n AS edges, e.n * 12 AS edge_bytes, 3::BIGINT AS gates, 3::BIGINT AS parameters, 3::BIGINT AS layers FROM (SELECT COUNT(*) AS n FROM {last} WHERE m <> 0) t, (SELECT COUNT(*) AS n FROM ({rotated})) e",
        "trotter_ising": circuit("pauli", ising(2, 8), keep=wide_at_most(5), lower=1e-3),
        "update_initial_operator": with_(OP, f"new AS (SELECT ({HASH}) & 65535 AS m, CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)")
        + "SELECT op.m, coalesce(new.c, 0.0) AS c FROM op LEFT JOIN new ON op.m = new.m WHERE op.m <> 0",
        "isclose_join": with_(*(c := chain("pauli", PAULI[:1]))[0])
        + f"SELECT COUNT(*) AS terms, CAST(SUM(CAST(ok AS BIGINT)) AS BIGINT) AS close, bool_and(ok) AS equal FROM (SELECT abs(coalesce(op.c, 0) - coalesce(t.c, 0)) <= 1e-8 + 1e-5 * abs(coalesce(t.c, 0)) AS ok FROM op FULL JOIN {c[1]} t ON op.m = t.m)",
        "slot_postings": with_(OP) + f"SELECT CAST(s AS INTEGER) AS slot, CAST(SUM((m >> s) & 1) AS BIGINT) AS n FROM op, range(0, {2 * WIDTH}) r(s) GROUP BY s",
        "row_parity": with_(OP) + f"SELECT CAST(s AS INTEGER) AS slot, CAST(SUM((m >> s) & 1) % 2 AS BIGINT) AS n FROM op, range(0, {2 * WIDTH}) r(s) GROUP BY s",
        "majorana_products": f"""SELECT idx, SUM(sign * v) AS re, SUM(sign * -1.0) AS im FROM ({sorted_products("(SELECT l_partkey % 16 AS a, l_suppkey % 16 AS b, l_linenumber % 16 AS c, CAST(l_quantity AS BIGINT) % 16 AS d, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS v FROM lineitem)", ["a", "b", "c", "d"])}) GROUP BY idx""",
        "ladder_expand": ladder_expand(),
        "ladder_canonical": ladder_canonical(),
        "integrals": integrals(),
        "jw_map": jordan_wigner(),
        "decoded_terms": with_(OP) + f"SELECT {decoded()} FROM op",
        "encode_decode": with_(OP) + PUBLIC + "op",
        "slots_round_trip": with_(OP) + f"SELECT m, array_to_string(list_filter(range(0, {2 * WIDTH}), lambda s: (m >> s) & 1 = 1), ',') AS slots, m AS back FROM op",
        "pauli_strings": with_(OP) + "SELECT m, letters, reverse(letters) AS reversed, m AS back FROM (SELECT m, " + " || ".join(f"['I', 'X', 'Y', 'Z'][((m >> {2 * q}) & 3) + 1]" for q in range(WIDTH)) + " AS letters FROM op)",
        "gate_list": GATE_LIST,
        "gate_groups": GATE_GROUPS,
        "commuting_generators": commuting(),
        "problem_fixture": "SELECT CAST((1 << n_regionkey) | (1 << (n_regionkey + 2)) AS BIGINT) AS m, CAST(SUM(n_nationkey) AS DOUBLE) AS c, 2 AS gates, 0.25 AS energy FROM nation GROUP BY n_regionkey",
        "evolved_sink": with_(*(c := chain("majorana", MAJORANA[:2]))[0]) + PUBLIC + f"{c[1]} WHERE abs(c) >= 0.02",
        "schrodinger_state": with_(start) + f"SELECT m, c FROM st WHERE {pc('m')} <= 6",
        "picture_agreement": with_(OP, gate("op", "h", "majorana", *MAJORANA[0]), *first)
        + f"SELECT 'heisenberg' AS picture, round(SUM(c * {state('m', 'majorana')}), 6) AS expval FROM h WHERE {is_paired('m')} UNION ALL SELECT 'schrodinger', round(SUM(op.c * s.c), 6) FROM op JOIN {once} s ON op.m = s.m",
        "ising_model": with_(*(c := chain("pauli", lattice() * 2, f"op AS (SELECT CAST(m AS BIGINT) AS m, CAST(c AS DOUBLE) AS c FROM (VALUES {fields}) v(m, c))"))[0]) + f"{PUBLIC}{c[1]} WHERE abs(c) >= 1e-12",
        "wide_gate": circuit("pauli", WIDE[:1], keep=wide_at_most(12, 24), **n24),
        "wide_circuit": with_(*wide) + PUBLIC + wide_last,
        "wide_trotter": circuit("pauli", ising(1, 12), keep=wide_at_most(10, 24), lower=0.004, **n24),
        "wide_expval": with_(*wide) + f"SELECT round(SUM(c * coalesce({state('m', 'pauli', 24)}, 0)), 6) AS expval, CAST(SUM(CAST(m <> 0 AS INTEGER)) AS BIGINT) AS terms FROM {wide_last}",
        "wide_gradient": shift_rule(WIDE[:3], WIDE_OP, n=24),
        "two_word_circuit": with_(*(c := chain("pauli", TWO_WORDS, TWO_WORD_OP, keep=wide_at_most(18, 64), n=64, kind="HUGEINT"))[0])
        + f"SELECT CAST(m & 18446744073709551615 AS BIGINT) AS w0, CAST(m >> 64 AS BIGINT) AS w1, round(c, 9) AS c FROM {c[1]}",
    }
    return out
