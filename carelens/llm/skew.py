"""Keys in another form, for joins that must stay splittable.

Spark's skew join splits a hot key only where both sides of the join come straight
from an exchange. A side that was grouped by the join key has none of its own. A
join on ``apart(key)`` of both sides gives each an exchange: one more shuffle of the
grouped (small) side, and a hot key on the other side can be dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(key: Column) -> Column:
    """A long key in another form; null stays null."""
    return key.bitwiseXOR(F.lit(0x5DEECE66D))
