"""Connected components of a table of links, by least-label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, renamed, written


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for the ids in ``links`` (a, b): the smallest id reachable.

    Each round takes the least label of the neighbours, gives each label the least that any
    of its members takes, then jumps to the label's own label. So long chains halve whatever
    the order of their ids; rounds go on until no label moves. Labels are written to the
    shared folder each round. No link is collected. An empty table of links has no components.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        old, labels = labels, labels.select("id", "comp")
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "m").alias("m"))
        hook = step.groupBy(F.col("comp").alias("id")).agg(F.min("m").alias("m")).select("id", F.lit(None).cast(labels.schema["comp"].dataType).alias("comp"), "m")
        # A label is itself an id with a label at most as large.
        step = written(step.union(hook).groupBy("id").agg(F.max("comp").alias("comp"), F.min("m").alias("m")), "hooked")
        jump = step.select(F.col("id").alias("m"), F.col("m").alias("far"))
        labels = written(step.join(jump, "m").select("id", F.least("m", "far").alias("comp"), (F.least("m", "far") < F.col("comp")).alias("moved")), "labels")
        discard(old, step)
    discard(both)
    return renamed(labels, F.col("id"), F.col("comp"))
