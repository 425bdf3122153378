"""Threshold functions of the three models, as columns and as Python lookup tables.

Thresholds are defined on doubles: floor(pow(k, tau)) without correction.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647


def _col(x) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else (F.col(x) if isinstance(x, str) else x)


def floor_pow(k, tau) -> Column:
    """Least degree inside a set of ``k``: 0 for k <= 0, else floor(k ** tau)."""
    k, tau = _col(k), _col(tau)
    return F.when(k <= 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.pow(k.cast("double"), tau)))


def theta(best, tau) -> Column:
    """Degree that every member of a set of more than ``best`` has: the largest m with m ** (1 / tau) <= best + 1."""
    n, tau = _col(best).cast("double") + 1, _col(tau)
    m = F.floor(F.pow(n, tau))
    root = lambda x: F.pow(x.cast("double"), F.lit(1.0) / tau)
    return F.when((m > 0) & (root(m) > n), m - 1).when(root(m + 1) <= n, m + 1).otherwise(m)


def min_order(k, length) -> Column:
    """Fewest vertices of a connected graph of least degree ``k`` and diameter ``length``."""
    k, length = _col(k).cast("bigint"), _col(length).cast("bigint")
    long_ = k + length + 1 + F.floor(length / 3) * (k - 2)
    return F.when(length <= 0, F.lit(1).cast("bigint")).when(k <= 0, length + 1).when((length <= 2) | (k == 1), k + length).otherwise(long_)


def floor_root(x, tau) -> Column:
    """Largest size whose threshold a degree of ``x`` meets: floor(x ** (1 / tau)), at most INT_MAX."""
    x = _col(x)
    return F.when(x <= 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.least(F.lit(float(INT_MAX)), F.pow(x.cast("double"), F.lit(1.0) / _col(tau)))))


def largest_size(degree, tau) -> Column:
    """The largest k with ``floor_pow(k) <= degree``: the root of degree + 1, corrected by one."""
    degree, tau = _col(degree), _col(tau)
    k = F.floor(F.pow(degree.cast("double") + 1, F.lit(1.0) / tau))
    return F.when(floor_pow(k + 1, tau) <= degree, k + 1).when(floor_pow(k, tau) <= degree, k).otherwise(k - 1)


def model_threshold(model, param, n) -> Column:
    """Least degree inside a set of ``n`` under a model (flexi, quasi, kplex); 0 up to one vertex."""
    model, param, n = _col(model), _col(param), _col(n)
    quasi = F.ceil(param * (n.cast("double") - 1) - 1e-9)
    kplex = F.greatest(F.lit(0).cast("bigint"), n.cast("bigint") - F.round(param).cast("bigint"))
    return F.when(n <= 1, F.lit(0).cast("bigint")).when(model == "flexi", floor_pow(n, param)).when(model == "quasi", quasi).when(model == "kplex", kplex)


def most_members(degree, scope, tau) -> Column:
    """Largest set that a vertex of ``degree`` in a scope of ``scope`` vertices may be in."""
    return F.greatest(F.lit(1).cast("bigint"), F.least(floor_root(_col(degree) + 1, tau), _col(scope).cast("bigint")))


def most_strangers(degree, scope, tau) -> Column:
    """Most other members that such a vertex may not be linked with."""
    s = most_members(degree, scope, tau)
    return s - 1 - floor_pow(s, tau)


def margin(strangers_allowed, size, is_member, degree_inside) -> Column:
    """Strangers that a vertex may still get, in a set of ``size`` of which it has ``degree_inside`` neighbours."""
    return _col(strangers_allowed) - (_col(size) - F.when(_col(is_member), 1).otherwise(0) - _col(degree_inside))


def component_cap(min_degree, tau) -> Column:
    """Size that a component of that least degree may reach before peeling; a guide, no proof."""
    d = _col(min_degree)
    return F.when(d > 0, F.floor(F.pow(d.cast("double"), F.lit(1.0) / _col(tau)))).otherwise(F.lit(0).cast("bigint"))


def edge_key(u, v) -> Column:
    """Both ends of an undirected edge in one number."""
    u, v = _col(u), _col(v)
    return F.shiftleft(F.least(u, v).cast("bigint"), 32).bitwiseOR(F.greatest(u, v).cast("bigint"))


def python_threshold(model: str, param: float) -> Callable[[int], int]:
    """``model_threshold`` as a Python function."""
    if model == "flexi":
        return lambda n: 0 if n <= 1 else math.floor(math.pow(n, param))
    if model == "quasi":
        return lambda n: 0 if n <= 1 else math.ceil(param * (n - 1) - 1e-9)
    if model == "kplex":
        return lambda n: 0 if n <= 1 else max(0, n - int(math.floor(param + 0.5)))
    raise ValueError(f"unknown model {model!r}")


def check_tau(tau: float) -> float:
    """``tau`` if it lies between 0 and 1."""
    if not 0 < tau < 1:
        raise ValueError(f"tau must lie between 0 and 1, not {tau}")
    return tau
