"""Small tables dealt by key before they grow.

A box becomes a dozen scan lines, a point a hundred votes.  Whatever is dealt
by page before that happens needs no further shuffle of the grown rows: every
grouping and window whose keys include the dealt ones runs where the rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Parts per split of the files read: about 200,000 rows of a full split each, so that grown rows still fit the memory of a task.
GRAIN = 48


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, read straight from files, with all rows of a key in one of many small partitions."""
    return df.repartition(GRAIN * max(1, df.rdd.getNumPartitions()), *keys)
