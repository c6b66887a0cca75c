"""Similarities of sets, token lists and vectors, and the order of guard actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard actions from the mildest to the strictest.
ACTIONS = ("allow", "clarify", "abstain", "refuse")


def let(value: Column, fn) -> Column:
    """fn of a value that is evaluated once: lambdas would evaluate an expression again for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running_sums(sizes: Column) -> Column:
    """The running sums of an array of ints, by doubling: each of log2(n) rounds adds the element so far back."""
    rounds = F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int")
    steps = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), F.lit(1), rounds)
    return F.aggregate(steps, sizes, lambda sums, back: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """How much of the set a is in b; 0 if a is empty."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(0.0)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token lists as multisets; 0 without common tokens."""

    def times(xs: Column, t: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == t))

    same = F.aggregate(F.array_intersect(pred, gold), F.lit(0), lambda s, t: s + F.least(times(pred, t), times(gold, t)))
    return F.when(same > 0, 2 * same / (F.size(pred) + F.size(gold))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


cosine = dot


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v at unit length; a vector of (almost) no length is left as it is."""

    def scaled(doubles: Column) -> Column:
        return let(norm(doubles), lambda n: F.when(n > 1e-12, F.transform(doubles, lambda x: x / n)).otherwise(doubles))

    return let(F.transform(v, lambda x: x.cast("double")), scaled)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def add_scaled(v: Column, w: Column, scale: Column | float) -> Column:
    return F.zip_with(v, w, lambda x, y: x + y * scale)


def action_rank(action: Column) -> Column:
    """0 for allow and for unknown actions, up to 3 for refuse."""
    return F.greatest(F.array_position(F.array(*map(F.lit, ACTIONS)), action) - 1, F.lit(0))


def stricter(a: Column, b: Column) -> Column:
    return F.when(action_rank(b) > action_rank(a), b).otherwise(a)


def percentile(values: Column, p: float) -> Column:
    """Of an array: the sorted value at p/100 of the last index, rounded half to even; 0 if empty."""
    at = F.bround(F.lit(p / 100) * (F.size(values) - 1), 0).cast("int")
    return F.coalesce(F.get(F.array_sort(values), at), F.lit(0.0))
