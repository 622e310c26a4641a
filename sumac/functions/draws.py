"""Repeatable draws and fingerprints from hashes: the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A draw from [0, 1) that the key alone decides: 13 hex digits of its SHA-256."""
    parts = [F.lit(k) if isinstance(k, (str, int)) else k.cast("string") for k in key]
    digits = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def normal(*key: Column | str | int) -> Column:
    """A standard normal draw by Box-Muller from two uniform ones."""
    u = F.greatest(uniform(*key, "u"), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(*key, "v"))


def uniform_sql(*key: str) -> str:
    """The draw of uniform as DuckDB text; each key is an SQL expression."""
    text = " || '|' || ".join(f"CAST({k} AS STRING)" for k in key)
    return f"(CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT) / {float(16**13)})"


def normal_sql(*key: str) -> str:
    u, v = uniform_sql(*key, "'u'"), uniform_sql(*key, "'v'")
    return f"(sqrt(-2 * ln(greatest({u}, 1e-12))) * cos(2 * pi() * {v}))"
