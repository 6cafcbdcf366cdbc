"""Likelihoods of runs of sites below and above a point of a tree, by first-order transitions, as column expressions.

A run is a struct (type, n, r, v). Its type is R (equal to the reference), a state, N (unknown) or O (a vector `v` over the states). `n` is
the length since the run was seen and `r` the part of it beyond the root; null means none. Two lists of runs are laid over each other
with `segments.overlay`, and each shared segment is one row: merges are expressions of that row, so Spark plans them like any
other projection, and sums over sites are aggregates.

`ref` is the reference state of a segment; a segment of type R on both sides may be long, everything else has one site. `q` is an
array of rows of rates and `pi` an array of frequencies: literals for one model, columns for a model per site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<type:string,n:double,r:double,v:array<double>>"
#: Below this a likelihood counts as zero when a vector is simplified.
THRESHOLD = 1e-8
#: What stands for a probability that first-order transitions make negative, and from where on a state counts as possible.
INSTEAD, POSSIBLE = 0.25, 0.1


@dataclass
class Model:
    """States as a string, rates q (rows as arrays) and frequencies pi, as columns."""

    states: str
    q: Column
    pi: Column

    @classmethod
    def of(cls, q: list[list[float]], pi: list[float], states: str = "ACGT") -> Model:
        return cls(states, F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in q]), F.array(*[F.lit(float(x)) for x in pi]))

    def index(self, state: Column) -> Column:
        """1-based number of a state."""
        return F.locate(state, F.lit(self.states)) if isinstance(state, str) else F.instr(F.lit(self.states), state)

    def rate(self, i: Column, j: Column) -> Column:
        return F.element_at(F.element_at(self.q, i), j)

    def each(self, f) -> Column:  # noqa: ANN001
        """An array over the states' numbers."""
        return F.transform(F.array(*[F.lit(i + 1) for i in range(len(self.states))]), f)


def bound(x: Column, f) -> Column:  # noqa: ANN001
    """f(x) with `x` worked out once, however often f looks at it: expressions inside of lambdas are not shared."""
    return F.element_at(F.transform(F.array(x), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    return bound(a, lambda v: bound(total(v), lambda s: F.transform(v, lambda x: x / s)))


def possible_sum(a: Column, b: Column) -> Column:
    """The sum of b over states that a has as possible."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > POSSIBLE, y).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def evolved(m: Model, v: Column, t: Column) -> Column:
    """(I + tQ) v: what lies below, seen from `t` above."""
    return bound(F.struct(v.alias("v"), t.alias("t")), lambda a: F.zip_with(a["v"], F.transform(m.q, lambda row: dot(row, a["v"])), lambda x, y: x + a["t"] * y))


def carried(m: Model, v: Column, t: Column) -> Column:
    """(I + tQ)' v: what lies above, seen from `t` below."""
    return bound(F.struct(v.alias("v"), t.alias("t")), lambda a: m.each(lambda j: F.element_at(a["v"], j) + a["t"] * F.aggregate(F.zip_with(a["v"], m.q, lambda x, row: x * F.element_at(row, j)), F.lit(0.0), lambda s, x: s + x)))


def _bounded(x: Column) -> Column:
    return F.when(x < 0, INSTEAD).otherwise(x)


def column_of(m: Model, s: Column, t: Column) -> Column:
    """Chance of the state `s` (its number) at `t` below, from each state."""
    return bound(F.struct(s.alias("s"), t.alias("t")), lambda a: m.each(lambda i: F.when(i == a["s"], _bounded(1 + a["t"] * m.rate(a["s"], a["s"]))).otherwise(a["t"] * m.rate(i, a["s"]))))


def row_of(m: Model, s: Column, t: Column) -> Column:
    """Chance of each state at `t` below the state `s`."""
    return bound(F.struct(s.alias("s"), t.alias("t")), lambda a: m.each(lambda j: F.when(j == a["s"], _bounded(1 + a["t"] * m.rate(a["s"], a["s"]))).otherwise(a["t"] * m.rate(a["s"], j))))


def one_hot(m: Model, s: Column) -> Column:
    return bound(s, lambda k: m.each(lambda i: F.when(i == k, 1.0).otherwise(0.0)))


def run(type_: Column, n: Column | None = None, r: Column | None = None, v: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(type_.alias("type"), (none if n is None else n).cast("double").alias("n"), (none if r is None else r).cast("double").alias("r"), (none if v is None else v).cast("array<double>").alias("v")).cast(RUN)


def positive(t: Column) -> Column:
    return F.greatest(t, F.lit(0.0))


def reach(x: Column, t: Column) -> Column:
    """Length from the far end of a branch of length t to where the run was seen."""
    return F.when(x["n"].isNotNull(), x["n"] + positive(t)).otherwise(t)


def _state(x: Column, ref: Column) -> Column:
    return F.when(x["type"] == "R", ref).otherwise(x["type"])


def _simple(m: Model, v: Column, ref: Column) -> Column:
    """A vector with one state above the threshold is that state."""

    def of(v: Column) -> Column:
        best = F.array_position(F.transform(v, lambda x: x > THRESHOLD), F.lit(True)).cast("int")
        state = F.substring(F.lit(m.states), best, F.lit(1))
        single = F.aggregate(v, F.lit(0), lambda s, x: s + (x > THRESHOLD).cast("int")) == 1
        return F.when(single, run(F.when(state == ref, F.lit("R")).otherwise(state))).otherwise(run(F.lit("O"), v=v))

    return bound(v, of)


def _longer(t: Column) -> Column:
    return F.when(t > 0, t)


def merge_lowers(m: Model, a: Column, t_a: Column, b: Column, t_b: Column, ref: Column, same_rate: Column) -> Column:
    """struct(run, gain): what lies below a node with children at t_a and t_b, and the log-likelihood it adds.

    `same_rate` is the sum of the reference states' own rates over the segment. Two different states at no distance are impossible:
    the run is null and the gain minus infinity.
    """
    far_a, far_b = reach(a, t_a), reach(b, t_b)
    both = lambda r, g: F.struct(r.alias("run"), g.cast("double").alias("gain"))

    def only(x: Column, t: Column, far: Column) -> Column:
        kept = F.when(x["type"] == "O", F.when(t > 0, far).otherwise(x["n"])).otherwise(_longer(far))
        return both(run(x["type"], kept, v=x["v"]), F.lit(0.0))

    s_a, s_b = m.index(_state(a, ref)), m.index(_state(b, ref))
    vector = lambda x, s, far: F.when(x["type"] == "O", F.when(far > 0, evolved(m, x["v"], far)).otherwise(x["v"])).otherwise(F.when(far > 0, column_of(m, s, far)).otherwise(one_hot(m, s)))
    product = F.zip_with(vector(a, s_a, far_a), vector(b, s_b, far_b), lambda x, y: x * y)
    own = F.when(a["type"] == "R", same_rate).otherwise(m.rate(s_a, s_a))
    never = both(F.lit(None).cast(RUN), F.lit(float("-inf")))
    mixed = bound(product, lambda p: bound(total(p), lambda s: F.when(s > 0, both(_simple(m, F.transform(p, lambda x: x / s), ref), F.log(s))).otherwise(never)))
    return (
        F.when((a["type"] == "N") & (b["type"] == "N"), both(run(F.lit("N")), F.lit(0.0)))
        .when(b["type"] == "N", only(a, t_a, far_a))
        .when(a["type"] == "N", only(b, t_b, far_b))
        .when((a["type"] == b["type"]) & (a["type"] != "O"), both(run(a["type"]), (positive(far_a) + positive(far_b)) * own))
        .otherwise(mixed)
    )


def merge_upper_lower(m: Model, a: Column, u: Column, b: Column, low: Column, ref: Column) -> Column:
    """The run at a point with `a` coming from above over a length u, and `b` from below over a length `low`; null if impossible."""
    far_b = reach(b, low)
    far_a = F.when(a["type"] == "O", reach(a, u)).otherwise(reach(a, u) + F.coalesce(a["r"], F.lit(0.0)))
    s_a, s_b = m.index(_state(a, ref)), m.index(_state(b, ref))
    zero = F.lit(0.0)
    below = F.when(b["type"] == "O", F.when(far_b > 0, evolved(m, b["v"], far_b)).otherwise(b["v"])).otherwise(column_of(m, s_b, positive(far_b)))
    # a state beyond the root starts from the frequencies, goes down its own length to where it was seen and then on to the point
    across = carried(m, F.zip_with(m.pi, column_of(m, s_a, F.coalesce(a["n"], zero)), lambda p, x: p * x), a["r"] + positive(u))
    above = F.when(a["type"] == "O", F.when(far_a > 0, carried(m, a["v"], far_a)).otherwise(a["v"])).when(a["r"].isNotNull(), across).otherwise(row_of(m, s_a, positive(far_a)))
    product = F.zip_with(above, below, lambda x, y: x * y)
    mixed = bound(product, lambda p: F.when(total(p) > 0, F.when((a["type"] != "O") & (b["type"] != "O"), run(F.lit("O"), v=normalized(p))).otherwise(_simple(m, normalized(p), ref))))
    from_below = F.when(b["type"] == "O", run(F.lit("O"), zero, zero, normalized(F.zip_with(m.pi, F.when(far_b > 0, evolved(m, b["v"], far_b)).otherwise(b["v"]), lambda p, x: p * x)))).when(far_b > 0, run(b["type"], far_b, zero)).otherwise(run(b["type"]))
    from_above = (
        F.when(a["type"] == "O", F.when(far_a > 0, run(F.lit("O"), zero, zero, carried(m, a["v"], far_a))).otherwise(a))
        .when(a["r"].isNotNull(), run(a["type"], a["n"], a["r"] + positive(u)))
        .otherwise(run(a["type"], _longer(reach(a, u))))
    )
    fixed_a, fixed_b = (a["type"] != "O") & (far_a <= 0), (b["type"] != "O") & (far_b <= 0)
    return (
        F.when((a["type"] == "N") & (b["type"] == "N"), run(F.lit("N")))
        .when(a["type"] == "N", from_below)
        .when(b["type"] == "N", from_above)
        .when((a["type"] == b["type"]) & (a["type"] != "O"), run(a["type"]))
        .when(fixed_a & fixed_b, F.lit(None).cast(RUN))
        .when(fixed_b, run(b["type"]))
        .when(fixed_a, run(a["type"]))
        .otherwise(mixed)
    )


def root_total(m: Model, x: Column, t: Column) -> Column:
    """What a child of the root at distance t sees of the other child's run `x` beyond the root."""
    zero = F.lit(0.0)
    far = reach(x, t)
    vector = normalized(F.zip_with(m.pi, F.when(far > 0, evolved(m, x["v"], far)).otherwise(x["v"]), lambda p, y: p * y))
    return F.when(x["type"] == "N", x).when(x["type"] == "O", run(F.lit("O"), x["n"], x["r"], vector)).when(x["n"].isNotNull(), run(x["type"], x["n"] + positive(t), zero)).when(t > 0, run(x["type"], t, zero)).otherwise(x)


def root_likelihood(m: Model, x: Column, ref: Column, same_pi: Column) -> Column:
    """Log-likelihood of a run at the root; `same_pi` is the sum of the logarithms of the reference states' frequencies."""
    return F.when(x["type"] == "N", 0.0).when(x["type"] == "R", same_pi).when(x["type"] == "O", F.log(dot(x["v"], m.pi))).otherwise(F.log(F.element_at(m.pi, m.index(x["type"]))))


def sample_cost(m: Model, a: Column, b: Column, t: Column, ref: Column, same_rate: Column) -> Column:
    """Log-likelihood change of one segment when a sample with run `b` hangs by t on a place with run `a`; what is unknown says nothing."""
    t, zero = positive(t), F.lit(0.0)
    n, r = F.coalesce(a["n"], zero), F.coalesce(a["r"], zero)
    s, y = m.index(_state(a, ref)), m.index(_state(b, ref))
    can = F.transform(b["v"], lambda x: (x > POSSIBLE).cast("double"))
    far = t + n
    over_root = lambda f: F.aggregate(m.each(lambda i: (F.element_at(m.pi, i) * m.rate(i, s) * n + F.when(i == s, F.element_at(m.pi, i)).otherwise(zero)) * f(i)), zero, lambda acc, x: acc + x) / F.element_at(m.pi, s)
    to_some = lambda i, length: F.element_at(can, i) + length * dot(F.element_at(m.q, i), can)
    state_o = F.when(F.element_at(b["v"], s) > POSSIBLE, m.rate(s, s) * (far + r)).when(a["r"].isNotNull(), F.log(over_root(lambda i: to_some(i, t + r)))).otherwise(F.log(dot(F.element_at(m.q, s), can) * far))
    first = F.when(a["type"] == "R", t).otherwise(t + r)
    across = m.rate(s, y) * first * (1 + m.rate(s, s) * n) + F.element_at(m.pi, y) / F.element_at(m.pi, s) * m.rate(y, s) * n * (1 + m.rate(y, y) * (t + r))
    state_state = F.when(a["r"].isNotNull(), F.log(across)).otherwise(F.log(m.rate(s, y) * far))
    o_o = F.log(dot(a["v"], m.each(lambda i: to_some(i, far))))
    o_state = F.log(F.element_at(a["v"], y) + far * F.aggregate(F.zip_with(m.q, a["v"], lambda row, x: F.element_at(row, y) * x), zero, lambda acc, x: acc + x))
    return (
        F.when((a["type"] == "N") | (b["type"] == "N"), 0.0)
        .when((a["type"] == "O") & (b["type"] == "O"), o_o)
        .when(a["type"] == "O", o_state)
        .when(b["type"] == "O", state_o)
        .when(a["type"] == b["type"], (t + n + r) * F.when(a["type"] == "R", same_rate).otherwise(m.rate(s, s)))
        .otherwise(state_state)
    )


def subtree_cost(m: Model, a: Column, b: Column, t: Column, ref: Column) -> Column:
    """As sample_cost for the root of a subtree with run `b`: vectors count as they are, and equal runs of the reference count as
    nothing here (the caller charges the branch's length once for each site). Null stands for impossible."""
    zero = F.lit(0.0)
    s, y = m.index(_state(a, ref)), m.index(_state(b, ref))
    far = F.when(F.coalesce(a["r"], a["n"]).isNotNull(), F.coalesce(a["r"], a["n"]) + positive(t)).otherwise(positive(t)) + F.coalesce(b["n"], zero)
    down = lambda v: evolved(m, v, far)
    n = F.coalesce(a["n"], zero)
    at_root = lambda v: F.aggregate(m.each(lambda i: F.element_at(m.pi, i) * F.element_at(column_of(m, s, n), i) * F.element_at(down(v), i)), zero, lambda acc, x: acc + x) / F.element_at(m.pi, s)
    state_o = F.when(a["r"].isNotNull(), at_root(b["v"])).otherwise(F.element_at(down(b["v"]), s))
    state_state = F.when(a["r"].isNotNull(), at_root(one_hot(m, y))).otherwise(m.rate(s, y) * far)
    value = F.when((a["type"] == "O") & (b["type"] == "O"), dot(a["v"], down(b["v"]))).when(a["type"] == "O", dot(a["v"], down(one_hot(m, y)))).when(b["type"] == "O", state_o).otherwise(state_state)
    return (
        F.when((a["type"] == "N") | (b["type"] == "N") | ((a["type"] == "R") & (b["type"] == "R")), 0.0)
        .when((a["type"] == b["type"]) & (a["type"] != "O"), m.rate(s, s) * far)
        .when(value > 0, F.log(value))
    )


def length_terms(m: Model, a: Column, b: Column, ref: Column, same_rate: Column) -> Column:
    """struct(linear, ratio): what a segment says about the length of the branch between `a` above and `b` below. The log-likelihood's slope
    is the sum of all `linear` and of 1 / (ratio + length) over all ratios that are not null."""
    zero = F.lit(0.0)
    s, y = m.index(_state(a, ref)), m.index(_state(b, ref))
    base = F.coalesce(a["n"], zero) + F.coalesce(a["r"], zero) + F.coalesce(b["n"], zero)
    v_a = F.when(a["type"] == "O", a["v"]).otherwise(row_of(m, s, zero))
    v_b = F.when(b["type"] == "O", b["v"]).otherwise(one_hot(m, y))
    still, moving = dot(v_a, evolved(m, v_b, base)), dot(v_a, F.transform(m.q, lambda row: dot(row, v_b)))
    both = lambda k, ratio: F.struct(k.cast("double").alias("linear"), ratio.cast("double").alias("ratio"))
    none = F.lit(None)
    return (
        F.when((a["type"] == "N") | (b["type"] == "N"), both(zero, none))
        .when((a["type"] == b["type"]) & (a["type"] != "O"), both(F.when(a["type"] == "R", same_rate).otherwise(m.rate(s, s)), none))
        .when((a["type"] != "O") & (b["type"] != "O"), both(zero, base))
        .when(moving < 0, both(moving / still, none))
        .otherwise(both(zero, still / moving))
    )


def solved_lengths(linear: Column, ratios: Column, sensitivity: float, most: float = 0.1, rounds: int = 40) -> Column:
    """The length at which `linear` + the sum of 1 / (ratio + length) is zero: null where the sum falls short from the start or there is no
    ratio, `most` where it never falls so far. Halving, for all rows at once; the interval ends below `sensitivity`.

    The function falls everywhere, and m ratios bound its zero by m / -linear less the smallest and the largest ratio.
    """
    rounds = min(rounds, max(1, int((most / sensitivity) - 1).bit_length()))
    slope = lambda t: linear + F.aggregate(ratios, F.lit(0.0), lambda s, x: s + 1 / (x + t))
    start = F.struct(F.lit(0.0).alias("low"), F.lit(most).alias("high"))
    half = lambda s: (s["low"] + s["high"]) / 2
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(slope(half(s)) > 0, F.struct(half(s).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high"))), lambda s: s["low"])
    return F.when(F.size(ratios) < 1, F.lit(None)).when((F.array_min(ratios) < 0) | (linear >= 0) | (slope(F.lit(most)) > 0), most).when(F.when(F.array_min(ratios) > 0, slope(F.lit(0.0)) <= 0).otherwise(False), F.lit(None)).otherwise(found).cast("double")


def changed_length(old: Column, new: Column) -> Column:
    """The new length where it differs from the old one by more than a hundredth, or where one of the two is none; else the old one."""
    differs = (F.coalesce(old, F.lit(0.0)) > 0) != (F.coalesce(new, F.lit(0.0)) > 0)
    return F.when(differs | (F.abs(new - old) > 0.01 * old), new).otherwise(old)
