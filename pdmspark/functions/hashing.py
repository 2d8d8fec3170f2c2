"""Reproducible draws: the same keys give the same draw on any cluster and under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are the first 15 hexadecimal digits of a SHA-256, so integers below this.
DRAWS = 1 << 60


def hash_integer(*parts: Column | str | int, seed: str | int = 42) -> Column:
    """A uniform long below DRAWS from the seed and the parts' text, joined by |. Null parts count as empty."""
    cols = [F.lit(str(seed))] + [(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def hash_uniform(*parts: Column | str | int, seed: str | int = 42) -> Column:
    """A uniform double in [0, 1)."""
    return hash_integer(*parts, seed=seed).cast("double") / F.lit(float(DRAWS))
