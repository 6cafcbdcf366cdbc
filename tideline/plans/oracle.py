"""The catalogue's queries in SQL, written independently of the DataFrame versions."""

from __future__ import annotations


def _cells(aln: str) -> str:
    return f"""
w{aln[0]} AS (SELECT {aln} AS aln, vec_id AS seq, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(0, 64)) AS t(i)),
c{aln[0]} AS (SELECT aln, seq, pos, CASE WHEN abs(x) < 0.002 THEN 'N' WHEN abs(x) < 0.004 THEN '-'
  WHEN x < -0.26 THEN substr('ACGT', (pos + 1) % 4 + 1, 1) WHEN x > 0.26 THEN substr('ACGT', (pos + 2) % 4 + 1, 1)
  WHEN x > 0.24 THEN substr('ACGT', (pos + 3) % 4 + 1, 1) ELSE substr('ACGT', pos % 4 + 1, 1) END AS ch FROM w{aln[0]}),
n{aln[0]} AS (SELECT aln, count(DISTINCT seq) AS n FROM c{aln[0]} GROUP BY aln),
k{aln[0]} AS (SELECT aln, pos, ch, seq, row_number() OVER (PARTITION BY aln, pos, ch ORDER BY seq) AS k FROM c{aln[0]} WHERE ch <> '-'),
h{aln[0]} AS (SELECT k.aln, pos, min_by(ch, seq) AS ch FROM k{aln[0]} k JOIN n{aln[0]} USING (aln) WHERE k = greatest(n // 2, 1) GROUP BY k.aln, pos),
f{aln[0]} AS (SELECT aln, pos, ch FROM (SELECT aln, pos, ch, row_number() OVER (PARTITION BY aln, pos ORDER BY count(*) DESC, ch) AS p FROM c{aln[0]} WHERE ch <> '-' GROUP BY aln, pos, ch) WHERE p = 1),
r{aln[0]} AS (SELECT s.aln, s.pos, CASE WHEN coalesce(h.ch, f.ch) IN ('A', 'C', 'G', 'T') THEN coalesce(h.ch, f.ch) ELSE 'A' END AS ref
  FROM (SELECT DISTINCT aln, pos FROM c{aln[0]}) s LEFT JOIN h{aln[0]} h ON h.aln = s.aln AND h.pos = s.pos LEFT JOIN f{aln[0]} f ON f.aln = s.aln AND f.pos = s.pos),
d{aln[0]} AS (SELECT c.aln, seq, c.pos, ch AS type, CASE WHEN ch IN ('N', '-') THEN c.pos - row_number() OVER (PARTITION BY c.aln, seq, ch ORDER BY c.pos) ELSE c.pos END AS run
  FROM c{aln[0]} c JOIN r{aln[0]} r ON r.aln = c.aln AND r.pos = c.pos WHERE ch <> ref),
m{aln[0]} AS (SELECT aln, seq, type, min(pos) AS pos, CAST(count(*) AS INTEGER) AS len FROM d{aln[0]} GROUP BY aln, seq, type, run)"""


ALL, LABEL = _cells("0"), _cells("label")
# In names: 0 is the alignment of all rows, l the alignment of each label.

_REGIONS = f"""{ALL},
o AS (SELECT seq, pos, pos + len - 1 AS stop, type, coalesce(lag(pos + len - 1) OVER (PARTITION BY seq ORDER BY pos), -1) AS before FROM m0),
rg AS (SELECT seq, pos AS start, stop, CASE WHEN type IN ('N', '-') THEN 'N' ELSE type END AS type FROM o
  UNION ALL SELECT seq, before + 1, pos - 1, 'R' FROM o WHERE pos > before + 1
  UNION ALL SELECT s.seq, coalesce(t.last, -1) + 1, 63, 'R' FROM (SELECT DISTINCT seq FROM c0) s LEFT JOIN (SELECT seq, max(stop) AS last FROM o GROUP BY seq) t ON t.seq = s.seq WHERE coalesce(t.last, -1) < 63)"""
_OVERLAY = f"""{_REGIONS},
ov AS (SELECT a.seq, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop, a.type AS a, b.type AS b
  FROM rg a JOIN rg b ON b.seq = a.seq + 1 AND a.start <= b.stop AND b.start <= a.stop)"""
_SEEDS = "(VALUES ('A','C',1.0),('A','G',5.0),('A','T',2.0),('C','A',2.0),('C','G',1.0),('C','T',40.0),('G','A',5.0),('G','C',2.0),('G','T',20.0),('T','A',2.0),('T','C',3.0),('T','G',1.0))"


def _matrix(name: str, symmetric: bool, where: str = "true") -> str:
    both = f"UNION ALL SELECT b, a, n FROM {name}_n" if symmetric else ""
    return f"""
{name}_n AS (SELECT ref AS a, ch AS b, CAST(count(*) AS DOUBLE) AS n FROM cl JOIN rl USING (aln, pos) WHERE ch IN ('A','C','G','T') AND ref <> ch AND {where} GROUP BY ref, ch
  UNION ALL SELECT a, b, CAST(n AS DOUBLE) FROM {_SEEDS} AS t(a, b, n)),
{name}_s AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM {name}_n {both}) GROUP BY a, b),
{name}_q AS (SELECT a, b, n / freq AS q, freq FROM {name}_s JOIN pi ON pi.state = a),
{name}_d AS (SELECT a, freq, -sum(q) AS q FROM {name}_q GROUP BY a, freq),
{name}_m AS (SELECT -sum(freq * q) AS mean FROM {name}_d),
{name} AS (SELECT a, b, q / mean AS q FROM {name}_q, {name}_m UNION ALL SELECT a, a, q / mean FROM {name}_d, {name}_m)"""


_PI = "pi AS (SELECT ref AS state, count(*) / sum(count(*)) OVER () AS freq FROM r0 GROUP BY ref)"
_GTR = f"{ALL}, {LABEL}, {_PI}, {_matrix('g', True)}"
_PAIRS = f"""{_GTR},
site AS (SELECT c0.seq, c0.pos, ref, CASE WHEN ch IN ('N', '-') THEN 'N' ELSE ch END AS ch FROM c0 JOIN r0 ON r0.pos = c0.pos),
pairs AS (SELECT x.seq, x.pos, x.ref, x.ch AS a, y.ch AS b FROM site x JOIN site y ON y.seq = x.seq + 1 AND y.pos = x.pos WHERE x.seq % 2 = 0),
mix AS (SELECT gx.b AS x, gy.b AS y, ln(sum(freq * (CASE WHEN gx.a = gx.b THEN 1 ELSE 0 END + gx.q / 64) * (CASE WHEN gy.a = gy.b THEN 1 ELSE 0 END + gy.q / 64))) AS lh FROM g gx JOIN g gy ON gy.a = gx.a JOIN pi ON state = gx.a GROUP BY gx.b, gy.b),
gg AS (SELECT a AS ga, b AS gb, q FROM g)"""
_STEPS = """
st AS (SELECT user_id, event_type AS from_type, lead(event_type) OVER w AS to_type, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS wait_us
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
steps AS (SELECT * FROM st WHERE to_type IS NOT NULL)"""
_COSTS = f"""{_GTR},
cost AS (SELECT seq, rl.aln AS label, sum(CASE WHEN ref = ch THEN q / 64.0 ELSE ln(q / 64.0) END) AS lh
  FROM c0 JOIN rl ON rl.pos = c0.pos JOIN g ON g.a = ref AND g.b = ch WHERE ch IN ('A','C','G','T') GROUP BY seq, rl.aln),
sc AS (SELECT seq, label, round(lh, 6) AS lh FROM cost),
near AS (SELECT seq, label, lh, max(lh) OVER (PARTITION BY seq) AS best FROM sc)"""


def _star(orders: bool) -> str:
    more = "UNION ALL SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders" if orders else ""
    return f"""
tree AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent
  UNION ALL SELECT 'r' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0'), 'root' FROM region
  UNION ALL SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), 'r' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') FROM nation
  UNION ALL SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'n' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') FROM customer {more})"""


_TEXTS = f"{ALL}, tx AS (SELECT seq, string_agg(ch, '' ORDER BY pos) AS text FROM c0 GROUP BY seq)"
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


# Runs of one site as (ty, n, r, v): a state, N or O, lengths, and a list of four numbers; all branches have the length 1/64.
_T = "(CAST(1 AS DOUBLE) / 64)"


def _far(x: str, t: str = _T) -> str:
    return f"(coalesce({x}.n, 0) + {t})"


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a.format(k)} * {b.format(k)}" for k in range(1, 5)) + ")"


def _below(x: str, i: int, far: str) -> str:
    """Likelihood of state i at the upper end of a length, of a run below."""
    own = f"1 + {far} * q[{i}][{i}]"
    return f"CASE WHEN {x}.ty = 'O' THEN {x}.v[{i}] + {far} * {_dot(f'q[{i}][{{}}]', f'{x}.v[{{}}]')} WHEN instr('ACGT', {x}.ty) = {i} THEN CASE WHEN {own} < 0 THEN 0.25 ELSE {own} END WHEN {x}.ty <> 'N' THEN {far} * q[{i}][instr('ACGT', {x}.ty)] END"


def _above(x: str, j: int) -> str:
    """The same at the lower end, of a run above."""
    start = lambda i: f"pi[{i}] * (CASE WHEN instr('ACGT', {x}.ty) = {i} THEN 1 ELSE 0 END + coalesce({x}.n, 0) * q[{i}][instr('ACGT', {x}.ty)])"
    past = f"{start(j)} + ({x}.r + {_T}) * ({' + '.join(f'{start(i)} * q[{i}][{j}]' for i in range(1, 5))})"
    return f"CASE WHEN {x}.ty = 'O' THEN {x}.v[{j}] + {_far(x)} * {_dot(f'{x}.v[{{}}]', f'q[{{}}][{j}]')} WHEN {x}.ty = 'N' THEN NULL WHEN {x}.r IS NOT NULL THEN {past} ELSE CASE WHEN instr('ACGT', {x}.ty) = {j} THEN 1 ELSE 0 END + {_far(x)} * q[instr('ACGT', {x}.ty)][{j}] END"


def _list(f) -> str:  # noqa: ANN001
    return "[" + ", ".join(f(i) for i in range(1, 5)) + "]"


_SIMPLE = "CASE WHEN list_sum([CAST(z > 1e-8 AS INTEGER) FOR z IN w]) = 1 THEN substr('ACGT', list_position([z > 1e-8 FOR z IN w], true), 1) ELSE 'O' END"
_JOIN = "FROM {a} a JOIN {b} b ON b.tree = a.tree AND b.pos = a.pos JOIN {qm} qm ON qm.pos = a.pos"
_NORMAL = "[z / list_sum(p) FOR z IN p] AS w"


def _lower(name: str, a: str, b: str, qm: str = "qm", t: str = _T) -> str:
    """The CTE `name` (tree, pos, ty, n, r, v, gain): two runs merged from below."""
    product = _list(lambda i: f"({_below('a', i, _far('a', t))}) * ({_below('b', i, _far('b', t))})")
    return f"""
{name}_p AS (SELECT a.tree, a.pos, a.ty AS ka, b.ty AS kb, {_far('a', t)} AS fa, {_far('b', t)} AS fb, a.v AS av, b.v AS bv, q[instr('ACGT', CASE WHEN a.ty IN ('N', 'O') THEN 'A' ELSE a.ty END)][instr('ACGT', CASE WHEN a.ty IN ('N', 'O') THEN 'A' ELSE a.ty END)] AS own, {product} AS p {_JOIN.format(a=a, b=b, qm=qm)}),
{name}_w AS (SELECT *, {_NORMAL}, list_sum(p) AS s FROM {name}_p),
{name} AS MATERIALIZED (SELECT tree, pos, CASE WHEN ka = 'N' THEN kb WHEN kb = 'N' OR ka = kb AND ka <> 'O' THEN ka ELSE {_SIMPLE} END AS ty,
  CASE WHEN ka = 'N' AND kb <> 'N' THEN fb WHEN kb = 'N' AND ka <> 'N' THEN fa END AS n, CAST(NULL AS DOUBLE) AS r, CASE WHEN ka = 'N' THEN bv WHEN kb = 'N' THEN av ELSE w END AS v,
  CASE WHEN ka = 'N' OR kb = 'N' THEN 0 WHEN ka = kb AND ka <> 'O' THEN (fa + fb) * own ELSE ln(s) END AS gain FROM {name}_w)"""


def _upper(name: str, a: str, b: str, qm: str = "qm") -> str:
    """The CTE `name`: a run above met by one below."""
    product = _list(lambda i: f"({_above('a', i)}) * ({_below('b', i, _far('b'))})")
    of_b, of_a = _list(lambda i: f"pi[{i}] * ({_below('b', i, _far('b'))})"), _list(lambda i: _above("a", i))
    return f"""
{name}_p AS (SELECT a.tree, a.pos, a.ty AS ka, b.ty AS kb, a.n AS an, a.r AS ar, {_far('a')} AS fa, {_far('b')} AS fb, {of_a} AS av, {of_b} AS bv, {product} AS p {_JOIN.format(a=a, b=b, qm=qm)}),
{name}_w AS (SELECT *, {_NORMAL} FROM {name}_p),
{name} AS MATERIALIZED (SELECT tree, pos, CASE WHEN ka = 'N' THEN kb WHEN kb = 'N' OR ka = kb AND ka <> 'O' THEN ka WHEN ka <> 'O' AND kb <> 'O' THEN 'O' ELSE {_SIMPLE} END AS ty,
  CASE WHEN ka = 'N' AND kb = 'N' THEN NULL WHEN ka = 'N' THEN CASE WHEN kb = 'O' THEN 0 ELSE fb END WHEN kb = 'N' THEN CASE WHEN ka = 'O' THEN 0 WHEN ar IS NOT NULL THEN an ELSE fa END END AS n,
  CASE WHEN ka = 'N' AND kb = 'N' THEN NULL WHEN ka = 'N' THEN 0 WHEN kb = 'N' THEN CASE WHEN ka = 'O' THEN 0 ELSE ar + {_T} END END AS r,
  CASE WHEN ka = 'N' THEN [z / list_sum(bv) FOR z IN bv] WHEN kb = 'N' THEN av ELSE w END AS v FROM {name}_w)"""


def _root(name: str, x: str, qm: str = "qm") -> str:
    """The CTE `name`: what a child of the root sees of the other child's run."""
    return f"""
{name}_p AS (SELECT tree, x.pos, ty, n, r, CASE WHEN ty = 'O' THEN {_list(lambda i: f"pi[{i}] * ({_below('x', i, _far('x'))})")} END AS p FROM {x} x JOIN {qm} qm ON qm.pos = x.pos),
{name} AS MATERIALIZED (SELECT tree, pos, ty, CASE WHEN ty = 'N' OR ty = 'O' THEN n ELSE coalesce(n, 0) + {_T} END AS n, CASE WHEN ty = 'N' OR ty = 'O' THEN r ELSE CAST(0 AS DOUBLE) END AS r, [z / list_sum(p) FOR z IN p] AS v FROM {name}_p)"""


def _type(text: str) -> str:
    body = f"regexp_replace({_UP.format(text)}, '[-?.~\\x09-\\x0D\\x20]', '', 'g')"
    count = lambda p: f"length(regexp_replace({body}, '[^{p}]', '', 'g'))"
    return f"CASE WHEN length({body}) = 0 THEN 'unknown' WHEN {count('ACGTU')} > CAST(0.9 AS DOUBLE) * (length({body}) - {count('NX')}) THEN 'dna' WHEN {count('A-Z*')} > CAST(0.9 AS DOUBLE) * length({body}) THEN 'protein' ELSE 'unknown' END"



def _body(text: str) -> str:
    stripped = f"regexp_replace({text}, '[\\x00-\\x20]', '', 'g')"
    plain = f"regexp_replace({_UP.format(stripped)}, '\\([^)]*\\)|\\{{[^}}]*\\}}', '?', 'g')"
    return f"CASE WHEN regexp_full_match({plain}, '[A-Z0-9?.*~-]*') THEN {plain} END"


def _passes(t: str, qm: str) -> str:
    """Both passes over trees of four rows, with names that begin with `t`, by the matrices of sites in `qm`."""
    l1, l2, l3 = (f"{t}l{k}" for k in (1, 2, 3))
    tips = " ".join(f"UNION ALL SELECT tree, pos, 4 * tree + {k}, ty, n, r, v FROM {t}v{k}" for k in range(4))
    return f"""{_lower(l2, 't0', 't1', qm)}, {_lower(l3, 't2', 't3', qm)}, {_lower(l1, l2, l3, qm)},
{t}site_lh AS (SELECT a.tree, a.pos, a.gain + b.gain + c.gain + CASE WHEN a.ty = 'N' THEN 0 WHEN a.ty = 'O' THEN ln({_dot('a.v[{}]', 'pi[{}]')}) ELSE ln(pi[instr('ACGT', a.ty)]) END AS lh
  FROM {l1} a JOIN {l2} b ON b.tree = a.tree AND b.pos = a.pos JOIN {l3} c ON c.tree = a.tree AND c.pos = a.pos JOIN {qm} qm ON qm.pos = a.pos),
{t}lows AS (SELECT tree, pos, -1 AS node, ty, n, v FROM {l1} UNION ALL SELECT tree, pos, -2, ty, n, v FROM {l2} UNION ALL SELECT tree, pos, -3, ty, n, v FROM {l3} UNION ALL SELECT tree, pos, seq, ty, n, v FROM tip),
{_root(f'{t}u2', l3, qm)}, {_root(f'{t}u3', l2, qm)}, {_upper(f'{t}v0', f'{t}u2', 't1', qm)}, {_upper(f'{t}v1', f'{t}u2', 't0', qm)}, {_upper(f'{t}v2', f'{t}u3', 't3', qm)}, {_upper(f'{t}v3', f'{t}u3', 't2', qm)},
{t}ups AS (SELECT tree, pos, -2 AS node, ty, n, r, v FROM {t}u2 UNION ALL SELECT tree, pos, -3, ty, n, r, v FROM {t}u3 {tips}),
{t}ends AS (SELECT u.pos, u.ty AS a, l.ty AS b, u.n AS an, u.r AS ar, u.v AS av, l.n AS bn, l.v AS bv FROM {t}ups u JOIN {t}lows l ON l.tree = u.tree AND l.pos = u.pos AND l.node = u.node WHERE u.ty <> 'N' AND l.ty <> 'N')"""


_QUARTETS = f"""{_GTR},
q1 AS (SELECT (SELECT list(row ORDER BY a) FROM (SELECT a, list(q ORDER BY b) AS row FROM g GROUP BY a)) AS q, (SELECT list(freq ORDER BY state) FROM pi) AS pi),
qm AS (SELECT pos, q, pi FROM r0, q1),
four AS (SELECT seq // 4 AS tree FROM (SELECT DISTINCT seq FROM c0) GROUP BY seq // 4 HAVING count(*) = 4),
tip AS (SELECT seq // 4 AS tree, c0.seq, c0.pos, ref, CASE WHEN ch IN ('N', '-') THEN 'N' ELSE ch END AS ty, CAST(NULL AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS r, CAST(NULL AS DOUBLE[]) AS v FROM c0 JOIN r0 ON r0.pos = c0.pos WHERE seq // 4 IN (SELECT tree FROM four)),
{', '.join(f"t{k} AS MATERIALIZED (SELECT * FROM tip WHERE seq % 4 = {k})" for k in range(4))},
{_passes('', 'qm')}"""
_COUNTED = f"""{_QUARTETS}, counted AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM ends WHERE a <> 'O' AND b <> 'O' AND a <> b GROUP BY a, b)"""


def _turn(t: str, qm: str, new: str) -> str:
    """The CTE `new` (pos, q, pi): matrices of sites from the changes and waiting times that the ends of branches under `t` say by `qm`."""
    vector = lambda ty, v: f"CASE WHEN {ty} = 'O' THEN [floor(z * 1000 + 0.5) / 1000 FOR z IN {v}] ELSE [CASE WHEN instr('ACGT', {ty}) = z THEN 1.0::DOUBLE ELSE 0.0 END FOR z IN [1, 2, 3, 4]] END"
    return f"""
{new}_e AS (SELECT pos, {vector('a', 'av')} AS x, {vector('b', 'bv')} AS y, {_T} + CASE WHEN coalesce(ar, 0) > 0 THEN ar ELSE coalesce(an, 0) END AS far, CASE WHEN a <> 'O' AND b <> 'O' THEN coalesce(ar, 0) > 0 ELSE ar IS NOT NULL END AS across,
  {_T} + coalesce(ar, 0) AS dr, coalesce(an, 0) AS dn, row_number() OVER () AS id FROM {t}ends WHERE coalesce(bn, 0) <= 0),
{new}_w AS (SELECT id, e.pos, far, across, dr, dn, i, j, q, pi, x[i] * y[j] * CASE WHEN i = j THEN 1 - far * q[i][j] ELSE far * q[i][j] END AS w FROM {new}_e e JOIN {qm} qm ON qm.pos = e.pos, unnest([1, 2, 3, 4]) AS t1(i), unnest([1, 2, 3, 4]) AS t2(j)),
{new}_p AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS p FROM {new}_w),
{new}_s AS (SELECT *, CASE WHEN NOT across THEN 1 WHEN i = j THEN 0 ELSE pi[i] * q[i][j] * dr / (pi[i] * q[i][j] * dr + pi[j] * q[j][i] * dn) END AS share, CASE WHEN across THEN dr ELSE far END AS len FROM {new}_p WHERE w > 0),
{new}_c AS (SELECT pos, i, j, sum(p * share) AS c FROM {new}_s WHERE i <> j GROUP BY pos, i, j),
{new}_t AS (SELECT pos, i, sum(wait) AS wait FROM (SELECT pos, i, CASE WHEN i = j THEN p * len ELSE p * share * len / 2 END AS wait FROM {new}_s
  UNION ALL SELECT pos, j, p * share * len / 2 + CASE WHEN across THEN p * (1 - share) * len ELSE 0 END FROM {new}_s WHERE i <> j) GROUP BY pos, i),
{new}_g AS (SELECT r0.pos, instr('ACGT', ref) AS r, i, j FROM r0, unnest([1, 2, 3, 4]) AS t1(i), unnest([1, 2, 3, 4]) AS t2(j) WHERE i <> j),
{new}_ct AS (SELECT i, j, sum(c) AS c FROM {new}_c GROUP BY i, j), {new}_tt AS (SELECT i, sum(wait) AS wait FROM {new}_t GROUP BY i),
{new}_r AS (SELECT g.pos, g.r, g.i, g.j, (coalesce(c.c, 0) + coalesce(ct.c * CAST(0.1 AS DOUBLE) / tt.wait, 0)) / (coalesce(t.wait, 0) + CAST(0.1 AS DOUBLE)) AS rate
  FROM {new}_g g LEFT JOIN {new}_c c ON c.pos = g.pos AND c.i = g.i AND c.j = g.j LEFT JOIN {new}_t t ON t.pos = g.pos AND t.i = g.i LEFT JOIN {new}_ct ct ON ct.i = g.i AND ct.j = g.j LEFT JOIN {new}_tt tt ON tt.i = g.i),
{new}_m AS (SELECT sum(rate) / (SELECT count(*) FROM r0) AS mean FROM {new}_r WHERE i = r),
{new}_q AS (SELECT pos, i, j, least(greatest(rate / mean, CAST(0.001 AS DOUBLE)), CAST(250 AS DOUBLE)) AS q FROM {new}_r, {new}_m),
{new}_d AS (SELECT pos, i, j, q FROM {new}_q UNION ALL SELECT pos, i, i, -sum(q) FROM {new}_q GROUP BY pos, i),
{new} AS MATERIALIZED (SELECT pos, (SELECT list(row ORDER BY i) FROM (SELECT i, list(q ORDER BY j) AS row FROM {new}_d d WHERE d.pos = r0.pos GROUP BY i)) AS q, pi FROM r0, q1)"""


_KIND = "CASE WHEN ty = ref THEN 'R' ELSE ty END"


def _hung() -> str:
    """The CTE `hung` (tree, pos, node, lh): sites of trees of four rows, hung from the middle of the branch above each node."""
    half = "(CAST(1 AS DOUBLE) / 128)"
    moved = lambda name, x: f"{name} AS (SELECT tree, pos, ty, CASE WHEN ty <> 'N' THEN coalesce(n, 0) + {_T} END AS n, r, v FROM {x})"
    pi_of = f"CASE WHEN z.ty = 'N' THEN 0 WHEN z.ty = 'O' THEN ln({_dot('z.v[{}]', 'pi[{}]')}) ELSE ln(pi[instr('ACGT', z.ty)]) END"
    parts, found = [moved("m2", "l3"), moved("m3", "l2")], ["SELECT tree, pos, -1 AS node, lh FROM site_lh"]
    for node, rest, own, other, far in ((-2, "m2", "l2", None, "l3"), (-3, "m3", "l3", None, "l2"), *((f"4 * z.tree + {k}", f"g{k}", f"t{k}", "l3" if k < 2 else "l2", None) for k in range(4))):
        k = str(node)[-1]
        kept = [f"SELECT tree, pos, gain FROM {x}" for x in ("l2", "l3")]
        if own[0] == "t":  # the cherry's own merge goes, one with its sibling comes
            parts.append(_lower(rest, "m2" if k in "01" else "m3", f"t{int(k) ^ 1}"))
            kept = [f"SELECT tree, pos, gain FROM {other}", f"SELECT tree, pos, gain FROM {rest}"]
        parts.append(_lower(f"z{own}", rest, own, t=half))
        found.append(f"SELECT z.tree, z.pos, {node}, z.gain + c.gain + d.gain + {pi_of} FROM z{own} z JOIN ({kept[0]}) c ON c.tree = z.tree AND c.pos = z.pos JOIN ({kept[1]}) d ON d.tree = z.tree AND d.pos = z.pos JOIN qm ON qm.pos = z.pos")
    return ", ".join(parts) + ", hung AS (" + " UNION ALL ".join(found) + ")"


def _swapped() -> str:
    """The CTEs `swap2` and `swap3` (tree, pos, lh): sites of the two neighbouring trees of four rows."""
    pi_of = f"CASE WHEN a.ty = 'N' THEN 0 WHEN a.ty = 'O' THEN ln({_dot('a.v[{}]', 'pi[{}]')}) ELSE ln(pi[instr('ACGT', a.ty)]) END"
    parts = []
    for name, (i, j), (k, l) in (("swap2", (2, 1), (0, 3)), ("swap3", (0, 2), (1, 3))):
        parts += [_lower(f"{name}a", f"t{i}", f"t{j}"), _lower(f"{name}b", f"t{k}", f"t{l}"), _lower(f"{name}c", f"{name}a", f"{name}b")]
        parts.append(f"{name} AS (SELECT a.tree, a.pos, a.gain + b.gain + c.gain + {pi_of} AS lh FROM {name}c a JOIN {name}a b ON b.tree = a.tree AND b.pos = a.pos JOIN {name}b c ON c.tree = a.tree AND c.pos = a.pos JOIN qm ON qm.pos = a.pos)")
    return ", ".join(parts)


_PARTS = """t AS (SELECT substr(p_type, 1, 1) AS aln, p_partkey AS seq,
  translate(lpad(split_part(p_brand, '#', 2), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0') || substr(p_type, 1, 1) || substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1), '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTNACGTNACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') AS text FROM part)"""


def oracle_sql() -> dict[str, str]:
    return {
        "q01_consensus": f"WITH {LABEL} SELECT aln, pos, ref FROM rl",
        "q02_differences": f"WITH {ALL} SELECT seq, type, pos, len FROM m0",
        "q03_distance_order": f"""WITH {ALL},
p AS (SELECT seq, count(*) AS records, sum(CASE WHEN type IN ('A','C','G','T') THEN 0 ELSE len END) AS ambiguous FROM m0 GROUP BY seq),
e AS (SELECT s.seq, CAST(coalesce(records, 0) AS BIGINT) AS records, CAST(coalesce(ambiguous, 0) AS BIGINT) AS ambiguous FROM (SELECT DISTINCT seq FROM c0) s LEFT JOIN p ON p.seq = s.seq)
SELECT seq, records, ambiguous, records * 1000 + ambiguous AS distance, CAST(row_number() OVER (ORDER BY records * 1000 + ambiguous, seq) AS INTEGER) AS ord FROM e""",
        "q04_effectiveness": f"""WITH {LABEL},
p AS (SELECT aln, max(k) AS most, sum(k) AS total FROM (SELECT aln, seq, count(*) AS k FROM ml GROUP BY aln, seq) GROUP BY aln)
SELECT nl.aln, n, CAST(coalesce(most, 0) AS BIGINT) AS most, CAST(coalesce(total, 0) AS BIGINT) AS total,
  coalesce(most, 0) <= 64 * CAST(0.14 AS DOUBLE) AND coalesce(total, 0) <= 64 * CAST(0.075 AS DOUBLE) * n AS effective FROM nl LEFT JOIN p ON p.aln = nl.aln""",
        "q05_reconstruct": f"WITH {_TEXTS} SELECT seq, text FROM tx",
        "q06_delta_lines": f"""WITH {ALL}
SELECT seq, string_agg(CASE WHEN type IN ('N', '-') THEN '-' || chr(9) || (pos + 1) || chr(9) || len ELSE lower(type) || chr(9) || (pos + 1) END, chr(10) ORDER BY pos) AS lines FROM m0 GROUP BY seq""",
        "q07_padded_rows": f"""WITH {_TEXTS}, w AS (SELECT greatest(max(length('seq_' || seq)), 9) + 1 AS width FROM tx)
SELECT seq, rpad('seq_' || seq, CAST(width AS INTEGER), ' ') || text AS line FROM tx, w""",
        "q08_sequence_type": f"SELECT p_partkey, {_type('p_name')} AS by_name, {_type('''translate(p_brand, 'Brand#12345', 'ACGTACGTACG')''')} AS by_brand FROM part",
        "q09_clean_body": f"SELECT page_id, {_body('''regexp_replace(url, '[:/]', ' ', 'g')''')} AS url_body, {_body('html')} AS html_body FROM pages",
        "q10_regions": f"WITH {_REGIONS} SELECT seq, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, type FROM rg",
        "q11_state_codes": """WITH t(ch, code, back, bits) AS (VALUES ('A',0,'A',1),('C',1,'C',2),('G',2,'G',4),('T',3,'T',8),('U',3,'T',8),('M',6,'M',3),('R',8,'R',5),('S',9,'S',6),('V',10,'V',7),
  ('W',12,'W',9),('Y',13,'Y',10),('H',14,'H',11),('K',15,'K',12),('D',16,'D',13),('B',17,'B',14),('N',252,'-',0),('O',252,'-',0),('X',252,'-',0)),
l AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(upper(coalesce(p_name, '') || coalesce(p_brand, '') || coalesce(p_type, '')), '')) AS ch FROM part) GROUP BY ch)
SELECT t.ch, CAST(n AS BIGINT) AS n, code, back, CASE WHEN bits = 0 THEN '' ELSE array_to_string([printf('%.4f', CASE WHEN bits & b > 0 THEN 1.0 / bit_count(bits) ELSE 0.0 END) FOR b IN [1, 2, 4, 8]], ',') END AS vector FROM t JOIN l ON l.ch = t.ch""",
        "q12_overlay": f"WITH {_OVERLAY} SELECT seq, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, a, b FROM ov",
        "q12_shared_segments": f"WITH {_OVERLAY} SELECT seq, count(*) + 1 AS n_segments FROM ov GROUP BY seq",
        "q13_informativeness": f"""WITH {_OVERLAY},
v AS (SELECT seq, bool_or(a <> b AND a <> 'N' AND b <> 'N') AS clash, bool_or(b = 'N' AND a <> 'N') AS more, bool_or(a = 'N' AND b <> 'N') AS less FROM ov GROUP BY seq)
SELECT seq, CASE WHEN clash OR (more AND less) THEN 0 WHEN less THEN -1 ELSE 1 END AS code FROM v""",
        "q14_changed": f"WITH {_OVERLAY} SELECT seq, bool_or(a <> b) AS differs FROM ov GROUP BY seq",
        "q15_coalesced_runs": """WITH o AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS island FROM o),
g AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM i GROUP BY l_orderkey, l_returnflag, island)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS run, l_returnflag, first, last, n FROM g""",
        "q16_prefix_sums": f"""WITH {_GTR}
SELECT CAST(pos AS INTEGER) AS pos, round(sum(q) OVER w, 6) AS rate, CAST(sum(CAST(ref = 'A' AS INTEGER)) OVER w AS BIGINT) AS "n_A", CAST(sum(CAST(ref = 'C' AS INTEGER)) OVER w AS BIGINT) AS "n_C",
  CAST(sum(CAST(ref = 'G' AS INTEGER)) OVER w AS BIGINT) AS "n_G", CAST(sum(CAST(ref = 'T' AS INTEGER)) OVER w AS BIGINT) AS "n_T" FROM r0 JOIN g ON g.a = ref AND g.b = ref WINDOW w AS (ORDER BY pos)""",
        "q17_root_frequencies": f"WITH {LABEL} SELECT aln, ref AS state, round(count(*) / sum(count(*)) OVER (PARTITION BY aln), 6) AS freq FROM rl GROUP BY aln, ref",
        "q18_transition_counts": f"WITH {_GTR} SELECT a AS from_state, b AS to_state, sum(n) AS n FROM g_n GROUP BY a, b",
        "q19_rate_matrices": f"WITH {_GTR}, {_matrix('u', False)} SELECT 'GTR' AS model, a AS from_state, b AS to_state, round(q, 6) AS q FROM g UNION ALL SELECT 'UNREST', a, b, round(q, 6) FROM u",
        "q20_matrix_change": f"""WITH {ALL}, {LABEL}, {_PI}, {_matrix('e', False, 'seq % 2 = 0')}, {_matrix('d', False, 'seq % 2 = 1')},
t AS (SELECT sum(abs(e.q - d.q)) AS change FROM e JOIN d ON e.a = d.a AND e.b = d.b WHERE e.a <> e.b) SELECT round(change, 6) AS change, change > 0.001 AS updated FROM t""",
        "q21_key_rates": f"""WITH {_STEPS},
p AS (SELECT from_type, sum(CAST(from_type <> to_type AS INTEGER)) AS n, sum(wait_us / 86400000000.0) AS e FROM steps GROUP BY from_type),
r AS (SELECT from_type, CASE WHEN n = 0 THEN 0.001 WHEN e <= 0.01 THEN 1.0 ELSE n / e END AS raw FROM p)
SELECT from_type, round(least(greatest(raw / (SELECT avg(raw) FROM r), 0.0001), 100.0), 6) AS rate FROM r""",
        "q22_count_matrices": f"""WITH {_STEPS},
w AS (SELECT user_id, from_type, sum(wait_us) / 86400000000.0 AS wait FROM steps GROUP BY user_id, from_type),
c AS (SELECT user_id, from_type, to_type, count(*) AS c FROM steps WHERE from_type <> to_type GROUP BY ALL),
mw AS (SELECT from_type, avg(wait) AS mean_wait FROM w GROUP BY from_type), mc AS (SELECT from_type, to_type, avg(c) AS mean_c FROM c GROUP BY from_type, to_type)
SELECT c.user_id, c.from_type, c.to_type, round(least(greatest((c + CAST(0.1 AS DOUBLE) * mean_c) / (wait + CAST(0.1 AS DOUBLE) * mean_wait), 0.001), 250.0), 6) AS rate
FROM c JOIN w ON w.user_id = c.user_id AND w.from_type = c.from_type JOIN mw ON mw.from_type = c.from_type JOIN mc ON mc.from_type = c.from_type AND mc.to_type = c.to_type""",
        "q23_root_likelihood": f"WITH {ALL}, {_PI} SELECT seq, round(sum(ln(freq)), 6) AS lh FROM c0 JOIN pi ON pi.state = ch GROUP BY seq",
        "q24_placement_cost": f"WITH {_COSTS} SELECT seq, label, lh FROM sc",
        "q25_best_labels": f"WITH {_COSTS} SELECT seq, label, lh, CAST(row_number() OVER (PARTITION BY seq ORDER BY lh DESC, label) AS INTEGER) AS place FROM near WHERE lh >= best - round(ln(64.0), 6)",
        "q26_supports": f"WITH {_COSTS} SELECT seq, label, round(exp(lh - best) / sum(exp(lh - best)) OVER (PARTITION BY seq), 6) AS support FROM near WHERE lh >= best - round(ln(64.0), 6)",
        "q27_descendants": f"""WITH RECURSIVE {_star(True)}, leaf AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)),
up(node, leaf) AS (SELECT node, node FROM leaf UNION ALL SELECT t.parent, up.leaf FROM up JOIN tree t ON t.node = up.node WHERE t.parent IS NOT NULL)
SELECT node, count(*) AS n FROM up GROUP BY node""",
        "q28_pre_order": f"""WITH RECURSIVE {_star(False)}, walk(node, depth, path) AS (SELECT node, 0, [node] FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.node, walk.depth + 1, list_append(walk.path, t.node) FROM walk JOIN tree t ON t.parent = walk.node)
SELECT node, depth, row_number() OVER (ORDER BY path) - 1 AS place FROM walk""",
        "q29_newick": """SELECT CAST(n_nationkey AS BIGINT) AS tree, CASE WHEN count(c_custkey) = 0 THEN '' ELSE '(' || string_agg('c' || c_custkey || ':0.5', ',' ORDER BY c_custkey) || ')' END || 'n' || n_nationkey || ';' AS text
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
        "q30_reroot": f"""WITH RECURSIVE {_star(False)}, path(node, parent) AS (SELECT node, parent FROM tree WHERE node = 'c000000001'
  UNION ALL SELECT t.node, t.parent FROM path JOIN tree t ON t.node = path.parent)
SELECT t.node, CASE WHEN t.node = 'c000000001' THEN NULL ELSE coalesce(p.node, t.parent) END AS parent FROM tree t LEFT JOIN path p ON p.parent = t.node""",
        "q31_unplaced": "SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "q32_resampled_support": f"""WITH {_QUARTETS}, {_swapped()},
d AS (SELECT s.tree, s.pos, b.lh - s.lh AS d2, c.lh - s.lh AS d3 FROM site_lh s JOIN swap2 b ON b.tree = s.tree AND b.pos = s.pos JOIN swap3 c ON c.tree = s.tree AND c.pos = s.pos),
t AS (SELECT tree, sum(d2) AS d2, sum(d3) AS d3 FROM d GROUP BY tree),
w AS (SELECT b, pos, count(*) AS n FROM (SELECT b, CAST('0x' || substr(md5('0:' || b || ':' || j), 1, 8) AS BIGINT) % 64 AS pos FROM unnest(range(0, 100)) AS t1(b), unnest(range(0, 64)) AS t2(j)) GROUP BY b, pos),
x AS (SELECT d.tree, g.b, sum(d2 * (coalesce(n, 0) - 1)) AS x2, sum(d3 * (coalesce(n, 0) - 1)) AS x3 FROM d CROSS JOIN unnest(range(0, 100)) AS g(b) LEFT JOIN w ON w.b = g.b AND w.pos = d.pos GROUP BY d.tree, g.b),
h AS (SELECT x.tree, count(*) FILTER (WHERE -greatest(d2, d3) > list_sort([0, x2, x3])[3] - list_sort([0, x2, x3])[2] + CAST(0.05 AS DOUBLE)) AS hits FROM x JOIN t ON t.tree = x.tree GROUP BY x.tree)
SELECT CAST(t.tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, round(d2, 6) AS d2, round(d3, 6) AS d3, round(CAST(100 AS DOUBLE) * hits / 100, 4) AS support FROM t JOIN h ON h.tree = t.tree, (VALUES (-2), (-3)) AS n(node)""",
        "q33_two_largest": """SELECT l_orderkey, l_linenumber, l_partkey, round(list_sort([l_tax, l_discount, l_linenumber / 100.0])[3], 6) AS first, round(list_sort([l_tax, l_discount, l_linenumber / 100.0])[2], 6) AS second FROM lineitem""",
        "q37_cherry_likelihoods": f"""WITH {_PAIRS}
SELECT seq, round(sum(CASE WHEN a = 'N' AND b = 'N' THEN 0 WHEN a = 'N' THEN ln(pb.freq) WHEN b = 'N' THEN ln(pa.freq) WHEN a = b THEN ln(pa.freq) + gs.q * 2 / 64 ELSE mix.lh END), 6) AS lh
FROM pairs LEFT JOIN pi pa ON pa.state = a LEFT JOIN pi pb ON pb.state = b LEFT JOIN gg gs ON gs.ga = pairs.a AND gs.gb = pairs.a LEFT JOIN mix ON x = pairs.a AND y = pairs.b GROUP BY seq""",
        "q38_upper_runs": f"""WITH {_PAIRS}
SELECT seq, CASE WHEN a = 'N' AND b = 'N' THEN 'N' WHEN a = 'N' AND b = ref OR b = 'N' AND a = ref OR a = b AND a = ref THEN 'R' WHEN a = 'N' THEN b WHEN b = 'N' OR a = b THEN a ELSE 'O' END AS type,
  CASE WHEN a = 'N' AND b <> 'N' OR b = 'N' AND a <> 'N' THEN CAST(1 AS DOUBLE) / 64 END AS n, CASE WHEN a = 'N' AND b <> 'N' THEN CAST(1 AS DOUBLE) / 64 WHEN b = 'N' AND a <> 'N' THEN CAST(0 AS DOUBLE) END AS r, CAST(count(*) AS BIGINT) AS sites
FROM pairs GROUP BY ALL""",
        "q39_sample_costs": f"""WITH {_PAIRS}
SELECT seq, round(sum(CASE WHEN a = 'N' OR b = 'N' THEN 0 WHEN a = b THEN q / 64 ELSE ln(q / 64) END), 6) AS cost FROM pairs LEFT JOIN gg ON ga = pairs.a AND gb = pairs.b GROUP BY seq""",
        "q40_branch_lengths": f"""WITH {_PAIRS},
t AS (SELECT seq, sum(CASE WHEN a = b THEN q ELSE 0 END) AS linear, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS m FROM pairs LEFT JOIN gg ON ga = pairs.a AND gb = pairs.b WHERE a <> 'N' AND b <> 'N' GROUP BY seq)
SELECT seq, round(linear, 6) AS linear, CAST(m AS BIGINT) AS n_ratios, CASE WHEN m > 0 THEN round(least(CAST(0.1 AS DOUBLE), m / -linear), 6) END AS length FROM t""",
        "q41_subtree_costs": f"""WITH {_PAIRS}
SELECT seq, round(-1 + sum(CASE WHEN a = 'N' OR b = 'N' OR a = b AND a = ref THEN 0 WHEN a = b THEN q / 64 ELSE ln(q / 64) END), 6) AS cost FROM pairs LEFT JOIN gg ON ga = pairs.a AND gb = pairs.b GROUP BY seq""",
        "q42_models": f"""WITH {LABEL}, s AS (SELECT DISTINCT ref AS state FROM rl)
SELECT 'JC' AS model, x.state AS from_state, y.state AS to_state, CASE WHEN x.state = y.state THEN CAST(-1 AS DOUBLE) ELSE round(CAST(1 AS DOUBLE) / ((SELECT count(*) FROM s) - 1), 6) END AS q FROM s x, s y""",
        "q43_collapsed_leaves": """SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS node, host FROM (SELECT c_custkey, 'c' || lpad(CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS VARCHAR), 9, '0') AS host FROM customer WHERE c_acctbal <= 0) WHERE 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') <> host""",
        "q44_bound_leaves": """SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, c_custkey AS seq, CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') GROUP BY ALL""",
        "q45_support_rows": f"""WITH {_COSTS}, s AS (SELECT seq, label, exp(lh - best) / sum(exp(lh - best)) OVER (PARTITION BY seq) AS support, row_number() OVER (PARTITION BY seq ORDER BY lh DESC, label) AS place, count(*) OVER (PARTITION BY seq) AS n FROM near WHERE lh >= best - round(ln(64.0), 6))
SELECT a.seq, 's' || a.seq || chr(9) || a.label || chr(9) || printf('%.5f', a.support) || chr(9) || coalesce(string_agg('in' || b.label || ':' || printf('%.5f', b.support), ',' ORDER BY b.place), '') AS line
FROM s a LEFT JOIN s b ON b.seq = a.seq AND b.place > 1 AND b.support >= 0.01 WHERE a.place = 1 GROUP BY a.seq, a.label, a.support""",
        "q46_minor_clades": f"""WITH {_PARTS},
h AS (SELECT b.aln, b.seq, min(a.seq) AS host FROM t b JOIN t a ON a.aln = b.aln AND regexp_full_match(a.text, replace(b.text, 'N', '.')) GROUP BY b.aln, b.seq)
SELECT aln, host, '(' || 's' || host || ':0,' || string_agg('s' || seq || ':0', ',' ORDER BY seq) || ')' AS clade FROM h WHERE host < seq GROUP BY aln, host""",
        "q36_streamed_placements": f"WITH {_COSTS} SELECT seq, min(label) AS label, max(lh) AS lh FROM near WHERE lh = best GROUP BY seq",
        "q34_absorbed": f"""WITH {_PARTS}
SELECT b.aln, b.seq, min(a.seq) AS host FROM t b JOIN t a ON a.aln = b.aln AND regexp_full_match(a.text, replace(b.text, 'N', '.')) GROUP BY b.aln, b.seq HAVING min(a.seq) < b.seq""",
        "q35_site_likelihoods": f"WITH {_QUARTETS} SELECT CAST(tree AS BIGINT) AS tree, CAST(pos AS INTEGER) AS pos, round(lh, 6) AS lh FROM site_lh",
        "q50_tree_likelihoods": f"WITH {_QUARTETS} SELECT CAST(tree AS BIGINT) AS tree, round(sum(lh), 6) AS lh FROM site_lh GROUP BY tree",
        "q51_lower_runs": f"WITH {_QUARTETS} SELECT CAST(tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, {_KIND} AS type, CAST(count(*) AS BIGINT) AS sites, round(sum(coalesce(n, 0)), 6) AS length FROM lows JOIN r0 USING (pos) WHERE node < 0 GROUP BY ALL",
        "q52_upper_sites": f"WITH {_QUARTETS} SELECT CAST(tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, {_KIND} AS type, CAST(count(*) AS BIGINT) AS sites, round(sum(coalesce(n, 0)), 6) AS length, round(sum(coalesce(r, 0)), 6) AS beyond FROM ups JOIN r0 USING (pos) GROUP BY ALL",
        "q53_branch_counts": f"WITH {_COUNTED} SELECT a AS from_state, b AS to_state, n FROM counted",
        "q54_tree_matrix": f"""WITH {_COUNTED},
every AS (SELECT a, b, n FROM counted UNION ALL SELECT a, b, CAST(n AS DOUBLE) FROM {_SEEDS} AS t(a, b, n)),
twice AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM every UNION ALL SELECT b, a, n FROM every) GROUP BY a, b),
rate AS (SELECT a, b, n / freq AS q, freq FROM twice JOIN pi ON pi.state = a), diag AS (SELECT a, freq, -sum(q) AS q FROM rate GROUP BY a, freq), mean AS (SELECT -sum(freq * q) AS mean FROM diag)
SELECT a AS from_state, b AS to_state, round(q / mean, 6) AS q FROM rate, mean UNION ALL SELECT a, a, round(q / mean, 6) FROM diag, mean""",
        "q55_tree_site_rates": f"""WITH {_QUARTETS},
n AS (SELECT pos, count(*) AS n FROM ends WHERE a <> 'O' AND b <> 'O' AND a <> b GROUP BY pos),
e AS (SELECT ends.pos, sum({_T} * abs(q[instr('ACGT', a)][instr('ACGT', a)])) AS e FROM ends, q1 WHERE a <> 'O' AND a = b GROUP BY ends.pos),
raw AS (SELECT r0.pos, CASE WHEN coalesce(n, 0) = 0 THEN 0.001::DOUBLE WHEN coalesce(e, 0) <= 0.01 THEN 1 ELSE n / e END AS raw FROM r0 LEFT JOIN n ON n.pos = r0.pos LEFT JOIN e ON e.pos = r0.pos)
SELECT CAST(pos AS INTEGER) AS pos, round(least(greatest(raw / (SELECT avg(raw) FROM raw), 0.0001), 100.0), 6) AS rate FROM raw""",
        "q56_iterated_matrices": f"""WITH {_QUARTETS}, {_turn('', 'qm', 'qa')}, {_passes('x', 'qa')}, {_turn('x', 'qa', 'qb')}
SELECT CAST(pos AS INTEGER) AS pos, substr('ACGT', i, 1) AS from_state, round(q[i][1], 5) AS to_a, round(q[i][2], 5) AS to_c, round(q[i][3], 5) AS to_g, round(q[i][4], 5) AS to_t FROM qb, unnest([1, 2, 3, 4]) AS t1(i)""",
        "q57_root_supports": f"""WITH {_QUARTETS}, {_hung()},
h AS (SELECT tree, node, round(sum(lh), 6) AS lh FROM hung GROUP BY tree, node), b AS (SELECT *, max(lh) OVER (PARTITION BY tree) AS best FROM h),
s AS (SELECT tree, node, lh, exp(lh - best) / sum(exp(lh - best)) OVER (PARTITION BY tree) AS support FROM b WHERE lh >= best - round(ln(64.0), 6))
SELECT CAST(tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, lh, round(support, 5) AS support FROM s WHERE support >= 0.01""",
        "q58_rerooted_branch": f"""WITH RECURSIVE {_star(False)},
t AS (SELECT node, parent, CASE WHEN parent IS NOT NULL THEN (CAST(substr(node, 2, 9) AS BIGINT) % 7 + 1) / CAST(8 AS DOUBLE) END AS length, concat_ws('-', node, parent) AS note FROM tree),
path AS (SELECT * FROM t WHERE node = 'c000000001' UNION ALL SELECT t.* FROM path JOIN t ON t.node = path.parent)
SELECT t.node, CASE WHEN t.node = 'c000000001' OR p.node = 'c000000001' THEN 'top' ELSE coalesce(p.node, t.parent) END AS parent,
  CASE WHEN t.node = 'c000000001' THEN t.length * 0.25::DOUBLE WHEN p.node = 'c000000001' THEN p.length * 0.75::DOUBLE WHEN p.node IS NOT NULL THEN p.length ELSE t.length END AS length, coalesce(p.note, t.note) AS note
FROM t LEFT JOIN path p ON p.parent = t.node UNION ALL SELECT 'top', NULL, NULL, NULL""",
        "q59_changed_lists": """WITH v AS (SELECT vec_id AS seq, i, round(abs(CAST(embedding[i + 1] AS DOUBLE)), 4) AS x FROM embeddings, unnest(range(0, 64)) AS t(i)),
p AS (SELECT coalesce(a.seq, b.seq - 1) AS seq, coalesce(a.i, b.i) AS i, a.x AS a, b.x AS b, abs(a.x - b.x) AS d FROM (SELECT * FROM v WHERE seq % 2 = 0) a FULL JOIN (SELECT * FROM v WHERE seq % 2 = 1) b ON b.seq = a.seq + 1 AND b.i = a.i),
s AS (SELECT seq, i // 4 AS k, bool_or(coalesce(d > 0 AND (a = 0 OR b = 0 OR d > 0.32005 OR (d > 0.26005 AND (d > 1.001 * a OR d > 1.001 * b))), true)) AS moved, bool_and(coalesce(d <= 0.30005, false)) AS near FROM p GROUP BY seq, i // 4)
SELECT seq, count(*) FILTER (WHERE moved) AS n_changed, bool_or(moved) AS changed, bool_and(near) AS equal FROM s GROUP BY seq""",
        "q60_coalesced_lengths": """WITH o AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN min(l_linestatus) = 'O' THEN 'R' ELSE 'N' END AS type, min(l_discount) AS n, min(l_tax) AS r FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT *, CASE WHEN type = 'R' AND lag(type) OVER w = 'R' AND abs(n - lag(n) OVER w) < 0.035 AND abs(r - lag(r) OVER w) < 0.035 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY k) AS island FROM f)
SELECT l_orderkey, min(k) AS start, max(k) AS stop, max_by(type, k) AS type, round(max_by(n, k), 6) AS n, round(max_by(r, k), 6) AS r FROM i GROUP BY l_orderkey, island""",
        "q47_length_trials": f"""WITH {_PAIRS}, w AS (SELECT way, CAST(k AS INTEGER) AS k, CAST(1 AS DOUBLE) / 64 * pow(factor, k) AS length FROM (VALUES ('shorter', 0.5::DOUBLE, 5), ('longer', 2.0::DOUBLE, 4)) AS v(way, factor, most), unnest(range(0, 6)) AS t(k) WHERE k <= most),
c AS (SELECT seq, way, k, length, sum(CASE WHEN a = 'N' OR b = 'N' THEN 0 WHEN a = b THEN q * length ELSE ln(q * length) END) AS cost FROM w, pairs LEFT JOIN gg ON ga = pairs.a AND gb = pairs.b GROUP BY seq, way, k, length),
u AS (SELECT *, cost > lag(cost) OVER (PARTITION BY seq, way ORDER BY k) AS gain FROM c),
e AS (SELECT *, min(CASE WHEN NOT gain THEN k END) OVER (PARTITION BY seq, way) AS ended FROM u)
SELECT seq, way, k, length, round(cost, 6) AS cost FROM e WHERE k = coalesce(ended - 1, CASE way WHEN 'shorter' THEN 5 ELSE 4 END)""",
        "q48_exchange_matrices": f"""WITH {LABEL}, s(state) AS (VALUES ('A'), ('C'), ('G'), ('T')),
f AS (SELECT aln, ref AS state, count(*) / CAST(sum(count(*)) OVER (PARTITION BY aln) AS DOUBLE) AS freq FROM rl GROUP BY aln, ref),
r AS (SELECT aln, x.state AS a, y.state AS b, freq * CASE WHEN x.state || y.state IN ('AG', 'GA', 'CT', 'TC') THEN 2 ELSE 1 END AS q FROM s x JOIN f y ON x.state <> y.state),
d AS (SELECT aln, a, -sum(q) AS q FROM r GROUP BY aln, a), mean AS (SELECT d.aln, -sum(d.q * freq) AS mean FROM d JOIN f ON f.aln = d.aln AND f.state = d.a GROUP BY d.aln)
SELECT z.aln, a AS from_state, b AS to_state, round(q / mean, 6) AS q FROM (SELECT aln, a, b, q FROM r UNION ALL SELECT aln, a, a, q FROM d) z JOIN mean ON mean.aln = z.aln""",
        "q49_site_matrices": f"""WITH {_GTR}, p AS (SELECT c0.pos, sum(CAST(ch <> ref AS INTEGER)) AS n, count(*) / CAST(64 AS DOUBLE) AS e FROM c0 JOIN r0 ON r0.pos = c0.pos GROUP BY c0.pos),
raw AS (SELECT pos, CASE WHEN n = 0 THEN 0.001 WHEN e <= 0.01 THEN 1.0 ELSE n / e END AS raw FROM p),
r AS (SELECT pos, least(greatest(raw / (SELECT avg(raw) FROM raw), 0.0001), 100.0) AS rate FROM raw)
SELECT pos, a AS state, round(-q * rate, 6) AS leaves FROM r, g WHERE a = b""",
    }
