"""Connected components of a table of links, by alternating star contractions.

Each round points every node's larger neighbours to its smallest one and then
its smaller neighbours too (large star, small star); the rounds, logarithmic in
the longest path, end when no link changes.  No node's links are gathered: edges of
nodes of high degree meet their minimum by a broadcast of bounded size.  Links live in tables throughout; a
round's links are checkpointed in the session's shared folder, so lost executors
cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ensure_checkpoints


#: Rows of a small table in a task.
EACH = 5000
#: Links that may meet in one task.
SMALL = 20_000


def few(df: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` short rows in as many partitions as it needs, at most those it has.

    A shuffle writes a file for each partition that it reads, whatever is in it.
    """
    parts = max(1, -(-n // EACH))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else df


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges (a, c) with the ``m`` of their ``a`` in ``least`` (a, m, degree).

    A node of high degree would put all of its edges into one task.  There are at most
    2 * 1000 nodes of more than n / 1000 of n links' ends, so those are broadcast, and
    their edges stay where they are.
    """
    if n <= SMALL:  # no node has more links than there are
        return few(edges.join(least.select("a", "m"), "a").select("a", "c", "m"), n)
    high = max(100, n // 1000)
    hubs = least.filter(F.col("degree") > high).select(F.col("a").alias("hub"), F.col("m").alias("hub_m"))  # 2000 rows at most
    marked = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    hot = marked.filter("hub is not null").select("a", "c", F.col("hub_m").alias("m"))
    cold = marked.filter("hub is null").select("a", "c").join(least.filter(F.col("degree") <= high).select("a", "m"), "a")
    return few(hot, n).unionByName(few(cold.select("a", "c", "m"), n))


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """links (a > c): to each node's smallest neighbour go its larger ones, or itself and its smaller ones."""
    smallest = (F.min("c").alias("m"), F.count("*").alias("degree"))
    if large:
        both = links.unionByName(links.select(F.col("c").alias("a"), F.col("a").alias("c")))
        least = both.groupBy("a").agg(*smallest).select("a", F.least("a", "m").alias("m"), "degree")
        return _with_least(both, least, n).filter("c > a").select(F.col("c").alias("a"), F.col("m").alias("c")).distinct()
    least = links.groupBy("a").agg(*smallest)
    own = least.select("a", F.col("m").alias("c"))
    return _with_least(links, least, n).filter("c > m").select(F.col("c").alias("a"), F.col("m").alias("c")).unionByName(own).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, c); the component is its smallest node."""
    ensure_checkpoints(links)
    now = links.select(F.greatest("a", "c").alias("a"), F.least("a", "c").alias("c")).filter("a > c").distinct().checkpoint()
    digest = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "c").cast("decimal(20,0)"))).first()
        if seen == digest or not seen[0]:
            break
        digest = seen
        n = seen[0]
        now = _star(few(_star(few(now, n), True, n), n), False, n).checkpoint()
    return now.select(F.col("a").alias("node"), F.col("c").alias("component")).unionByName(
        now.select(F.col("c").alias("node"), F.col("c").alias("component")).distinct()
    )
