"""Connected components of links by label propagation with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import pin


def components(links: DataFrame) -> DataFrame:
    """(vid, comp): the least vertex reachable, for each vertex of ``links`` (a, b).

    A round gives each vertex the least label among itself and its neighbours, then the label of that
    label; labels only fall, and the rounds end when none has fallen.  Labels are pinned each round, so lineage stays
    short and a lost executor costs one round at most.
    """
    both = pin(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .filter("a <> b").distinct(), "links")
    labels = pin(both.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("m"))
                 .select("vid", F.least("vid", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("vid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("vid")) \
            .agg(F.min("comp").alias("m"))
        low = labels.join(near, "vid").select("vid", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("vid").alias("comp"), F.col("comp").alias("next"))
        labels = pin(low.join(jump, "comp", "left").select("vid", "old", F.least("comp", "next").alias("comp")), "labels")
        fell = labels.filter("comp < old").limit(1).count()
        labels = labels.select("vid", "comp")
        if not fell:
            return labels
