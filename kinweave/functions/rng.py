"""Portable random numbers and hash order.

Draws depend only on (id, step, seed), so a retried or re-planned task repeats
them exactly; ``rand()`` would not.  The SQL text is plain BIGINT arithmetic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
LOW = 1 << 22


def uniform_sql(id_sql: str, step_sql: str, seed: int) -> str:
    """Uniform number in [0, 1) for a BIGINT id and step, as SQL text.

    31 bits of one stream and 22 of another: as many values as a double has below 1.  Ids
    repeat after MODULUS squared, 4.6e18.
    """
    first, second = _stream_sql(id_sql, step_sql, seed, 48271, 69621), _stream_sql(id_sql, step_sql, seed + 1, 69621, 39373)
    return f"(({first} * {LOW} + {second} % {LOW}) / cast({MODULUS * LOW} as double))"


def _stream_sql(id_sql: str, step_sql: str, seed: int, a: int, b: int) -> str:
    """Number in [0, MODULUS); the part of the id above the modulus is mixed in, so ids do not repeat after it."""
    m = MODULUS
    low = f"(({id_sql}) % {m})"
    high = f"cast(round(cast(({id_sql}) - {low} as double) / {m}) as bigint)"
    x1 = f"(({low} * {a} + {high} * 16807 + ({step_sql}) * {b} + {seed * 16807}) % {m})"
    x2 = f"(({x1} * {x1} + {low} + 1) % {m})"
    x3 = f"(({x2} * {a} + {high} + ({step_sql})) % {m})"
    x4 = f"(({x3} * {x3} + {seed}) % {m})"
    return f"(({x4} * {a}) % {m})"


def uniform(id_sql: str, step_sql: str, seed: int) -> Column:
    return F.expr(uniform_sql(f"cast({id_sql} as bigint)", f"cast({step_sql} as bigint)", seed))


def uniforms(ids: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """The numbers of ``uniform`` for arrays of ids and steps, for code inside tasks."""
    first, second = _stream(ids, steps, seed, 48271, 69621), _stream(ids, steps, seed + 1, 69621, 39373)
    return (first * LOW + second % LOW) / float(MODULUS * LOW)


def _stream(ids: np.ndarray, steps: np.ndarray, seed: int, a: int, b: int) -> np.ndarray:
    m, low = MODULUS, ids % MODULUS
    high = (ids - low) // m
    x1 = (low * a + high * 16807 + steps * b + seed * 16807) % m
    x2 = (x1 * x1 + low + 1) % m
    x3 = (x2 * a + high + steps) % m
    return ((x3 * x3 + seed) % m * a) % m


def hash_order(salt: str, *keys: str) -> Column:
    """Text whose order is a fixed shuffle of the keys."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys]))


def hash_order_sql(salt: str, *keys: str) -> str:
    return "md5(concat_ws('|', '" + salt + "', " + ", ".join(keys) + "))"
