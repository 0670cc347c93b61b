"""Seeded hash uniforms: reproducible draws that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(unit, *salt) -> Column:
    """md5 of ``unit:salt[:salt…]``: a total order that is random with respect to the data."""
    parts = [F.col(unit).cast("string") if isinstance(unit, str) else unit.cast("string")]
    for s in salt:
        parts += [F.lit(":"), s.cast("string") if isinstance(s, Column) else F.lit(str(s))]
    return F.md5(F.concat(*parts))


def uniform(unit, *salt) -> Column:
    """A uniform draw in [0, 1) from the first 32 bits of ``hash_key``."""
    return F.conv(F.substring(hash_key(unit, *salt), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def noise(unit, *salt) -> Column:
    """Mean 0, standard deviation 1: the scaled sum of four uniforms."""
    if not salt:
        total = sum((uniform(unit, k) for k in ("n2", "n3", "n4")), uniform(unit, "n1"))
    else:
        suffix = F.concat(*[F.concat(F.lit(":"), s.cast("string") if isinstance(s, Column) else F.lit(str(s)))
                            for s in salt])
        total = sum((uniform(unit, F.concat(F.lit(k), suffix)) for k in ("n2", "n3", "n4")),
                    uniform(unit, F.concat(F.lit("n1"), suffix)))
    return (total - F.lit(2.0)) * F.lit(3.0 ** 0.5)


def poisson_one(unit, *salt) -> Column:
    """A Poisson(1) count by inverse distribution function: bootstrap weights without resampling rows."""
    u = uniform(unit, *salt)
    p, total, out = 2.718281828459045 ** -1, 0.0, F.lit(12)
    steps = []
    for k in range(12):
        total += p
        steps.append((total, k))
        p /= k + 1
    for bound, k in reversed(steps):
        out = F.when(u < F.lit(bound), F.lit(k)).otherwise(out)
    return out
