"""Co-purchase graph of categories, on Spark.

The graph is two DataFrames: ``edges(src, dst, weight)`` with one row per
undirected pair, and ``vertices(id)``. The two iterative algorithms
(eigenvector centrality and connected components) are DataFrame loops: one
join + aggregate per step, a reliable ``checkpoint()`` per step to the
session's shared checkpoint folder (cuts lineage and survives executor
loss), and one one-row action per step for the convergence test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tillsight.functions.rounding import money_round
from tillsight.session import checkpointed, delete_path, staging_path


class ConvergenceError(RuntimeError):
    """Power iteration did not reach the tolerance within ``max_iter`` steps."""


def copurchase_pairs(sales: DataFrame, *, basket: tuple[str, ...] = ("store_nbr", "date"),
                     item: str = "family", value: str = "sales", block: int = 512) -> DataFrame:
    """Category pairs bought in the same basket, weighted by the first category's sales.

    For rows t1, t2 of one basket with t1.item < t2.item the weight adds
    t1.value once per matching t2 row, i.e. per pair of categories (a, b):
    sum over baskets of sum(a's values) * count(b's rows). Rows are first
    aggregated to one cell per (basket, item), with a map-side partial step,
    so a basket contributes at most C(k, 2) pairs for k categories however
    many rows it has, and a hot basket is collapsed before any shuffle.

    The cells of a basket form arrays and the pairs are spelt out from them; nothing is joined with
    itself. The basket's measured width decides: up to ``block`` cells are one array, a wider one is cut by a hash of the
    item into blocks of about that size, and every pair of blocks (the triangle, the diagonal included) is
    its own row, so that a task spells out at most about block x block pairs at a time, on any executor.
    """
    keys = list(basket)
    present = F.col(item).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    cells = (sales.where(present)
             .groupBy(*keys, item)
             .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")))
    width = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cut = cells.withColumn("nb", F.ceil(width / block)).withColumn("b", F.pmod(F.xxhash64(item), F.col("nb")))
    # the window has put a basket's cells together, so this aggregate moves nothing
    blocks = (cut.groupBy(*keys, "nb", "b")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "s", "n"))).alias("c")))
    pair = lambda x, y: F.struct(x["i"].alias("src"), y["i"].alias("dst"), (x["s"] * y["n"]).alias("w"))
    within = lambda c: F.flatten(F.transform(c, lambda x, at: F.transform(
        F.slice(c, at + 2, F.size(c)), lambda y: pair(x, y))))
    narrow = blocks.where((F.col("nb") == 1) & (F.size("c") > 1)).select(F.explode(within(F.col("c"))).alias("p"))
    # wide baskets: each block meets each other one once
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")
    sides = (blocks.where(F.col("nb") > 1).select(*keys, "b", "c", partner)
             .groupBy(*keys, F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
             .agg(F.collect_list("c").alias("cs")))
    same = F.col("lo") == F.col("hi")
    x, y = F.col("x"), F.col("y")
    wide = (sides.where(same | (F.size("cs") == 2))
            .select(same.alias("same"), F.col("cs")[0].alias("one"), F.when(same, F.col("cs")[0]).otherwise(F.col("cs")[1]).alias("two"))
            .select("same", "two", F.explode("one").alias("x")).select("same", "x", F.explode("two").alias("y"))
            .where(~F.col("same") | (x["i"] < y["i"]))
            .select(F.when(x["i"] < y["i"], pair(x, y)).otherwise(pair(y, x)).alias("p")))
    return narrow.unionByName(wide).groupBy("p.src", "p.dst").agg(F.sum("p.w").alias("weight"))


def edges(pairs: DataFrame, *, min_weight: float | Column = 2e7) -> DataFrame:
    """Edges over the threshold; a null weight counts as 1.0. ``min_weight`` may be a Column
    (e.g. a scalar subquery such as the mean pair weight)."""
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    thr = min_weight if isinstance(min_weight, Column) else F.lit(float(min_weight))
    return pairs.where(w > thr).select("src", "dst", w.alias("weight"))


def vertices(edge_df: DataFrame) -> DataFrame:
    """Both ends of every edge, once (one pass over the edges, no union)."""
    return edge_df.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _symmetric(edge_df: DataFrame) -> DataFrame:
    """Both directions of each edge (a self-loop once), weight null -> 1.0.

    One pass over the edges: each row emits its two directions, so an
    unmaterialised edge frame is computed once, not once per union side.
    """
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    fwd = F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), w.alias("w"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w"))
    both = F.when(F.col("src") != F.col("dst"), F.array(fwd, back)).otherwise(F.array(fwd))
    return edge_df.select(F.explode(both).alias("e")).select("e.*")


def _empty_scores(spark) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField("id", StringType()),
                                                 StructField("score", DoubleType())]))


def _blocked(sym: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sym`` with their block (``salt``) within ``src``, and per vertex its number of blocks.

    A vertex has a block for each ``block_rows`` of its edges, dealt by a hash of the other end: most have one,
    a hub has as many as its measured degree needs.
    """
    degrees = checkpointed(sym.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    hubs = degrees.where(F.col("blocks") > 1)
    salt = F.pmod(F.xxhash64("dst"), F.coalesce(F.col("blocks"), F.lit(1))).cast("int")
    return (sym.join(hubs, "src", "left").withColumn("salt", salt).drop("blocks"),
            degrees.withColumnRenamed("src", "id"))


def eigenvector_centrality(edge_df: DataFrame, *, max_iter: int = 100, tol: float = 1e-6,
                           block_rows: int = 10_000) -> DataFrame:
    """Weighted eigenvector centrality by power iteration on (A + I).

    Start from 1/n everywhere, each step x <- (A + I) x normalised to unit L2
    length, stop when sum |x - x_prev| < n * tol. The identity shift makes
    the iteration converge on bipartite graphs (a star), where plain A
    oscillates. Scores are positive and have unit L2 norm. An empty graph
    gives an empty frame; no convergence within ``max_iter`` raises.
    Edges must be one row per undirected pair.

    The matrix is blocked in two dimensions: a vertex's edges are dealt to blocks of at most about
    ``block_rows`` (by the vertex and a hash of the other end), a vertex's entry of the vector is copied
    to its own blocks only, and the products are summed per block before they are shuffled (the partial
    step of the aggregate). So the edges of a hub are spread over all tasks on the way out, and its row of the
    result gathers one partial sum a task. The blocks are written once, bucketed, on the shared folder: a step moves
    only the vector to them and the partial sums from them. Each step is a reliable checkpoint
    (a lost executor never recomputes more than one step). One one-row action per step brings
    the new norm and the previous step's change to the driver together: the stop is detected one
    step late and the previous iterate, still held in the step's rows, is
    returned, so the result is exactly the iterate the stopping rule picks.
    """
    spark = edge_df.sparkSession
    sym = checkpointed(_symmetric(edge_df).withColumn("ident", F.lit(False)))
    blocked, nodes = _blocked(sym, block_rows)
    n = nodes.count()
    if n == 0:
        return _empty_scores(spark)
    # (A + I): the identity enters as one marked self-row per vertex, so a step is
    # a single join + aggregate, and the same aggregate carries the previous values
    ident = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"),
                         F.lit(True).alias("ident"), F.lit(0).alias("salt"))
    path = staging_path(spark, "adjacency")
    table = f"adjacency_{path.rsplit('-', 1)[-1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocked.unionByName(ident).repartition(buckets, "src", "salt").write.bucketBy(buckets, "src", "salt")
     .sortBy("src", "salt").option("path", path).saveAsTable(table))
    try:
        adj = spark.table(table)
        x = nodes.select("id", "blocks", F.lit(1.0 / n).alias("x"), F.lit(None).cast("double").alias("x_prev"))
        for i in range(1, max_iter + 2):
            own = F.col("ident")
            copies = x.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            y = checkpointed(adj.join(copies, (adj.src == copies.id) & (adj.salt == copies.copy))
                             .groupBy(F.col("dst").alias("id"))
                             .agg(F.sum(F.col("w") * F.col("x")).alias("y"),
                                  F.max(F.when(own, F.col("blocks"))).alias("blocks"),
                                  F.max(F.when(own, F.col("x"))).alias("x_prev"),
                                  F.max(F.when(own, F.col("x_prev"))).alias("x_prev2")))
            row = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"),
                        F.sum(F.abs(F.col("x_prev") - F.col("x_prev2"))).alias("delta")).first()
            if i >= 2 and row["delta"] is not None and row["delta"] < n * tol:
                return y.select("id", F.col("x_prev").alias("score"))
            x = y.select("id", "blocks", (F.col("y") / F.lit(row["norm"] or 1.0)).alias("x"), "x_prev")
        raise ConvergenceError(f"power iteration did not converge in {max_iter} steps")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(spark, path)


def top_nodes(scores: DataFrame, *, k: int = 100) -> DataFrame:
    """The ``k`` highest scores (ties by id) with their rank; the window sees only k rows."""
    top = scores.orderBy(F.col("score").desc(), F.col("id")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id"))))


def induced(edge_df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (two semi-joins)."""
    ids = nodes.select("id")
    return (edge_df.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            .select("src", "dst", "weight"))


def _undirected(edge_df: DataFrame) -> DataFrame:
    """One row per undirected pair, stored (larger, smaller); self-loops dropped."""
    return (edge_df.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
            .where(F.col("src") != F.col("dst")).distinct())


def _split_join(rows: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """``rows`` with their ``key``'s row of ``low``, an aggregate by ``key``.

    Joined on the key as a struct: an aggregate is already partitioned by the plain key and would be joined
    where it stands, but AQE's skew join only splits a hot key when both sides come from an exchange.
    """
    small = low.withColumnRenamed(key, "_key")
    return rows.join(small, F.struct(F.col(key).alias("k")) == F.struct(F.col("_key").alias("k"))).drop("_key")


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest id around u (u included)."""
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
                                      F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
                    .alias("p")).select("p.*")
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (_split_join(both, low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are all linked to the smallest of them."""
    low = e.groupBy("src").agg(F.min("dst").alias("m"))      # rows are (larger, smaller)
    spokes = (_split_join(e, low, "src")
              .select(F.col("dst").alias("src"), F.col("m").alias("dst")))
    centre = low.select("src", F.col("m").alias("dst"))
    return (spokes.unionByName(centre).where(F.col("src") != F.col("dst"))
            .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())


def _edge_checksum(e: DataFrame) -> tuple:
    """Count and an order-free checksum of an edge set, from one aggregate."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(vertex_df: DataFrame, edge_df: DataFrame) -> DataFrame:
    """Component label (the smallest member id) of every vertex.

    Alternating large-star / small-star rounds (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): each round rewires edges
    towards smaller ids without changing connectivity, and the edge set
    stops changing exactly when every component is a star around its
    smallest id; the number of rounds is O(log^2 n), so long paths do not
    need one round per hop. Every round is one reliable checkpoint and one
    one-row action: a count and checksum of the edges tells whether they changed. Both sides of a star's
    join come from an exchange, so a centre with very many edges is split by AQE's skew join. A vertex
    without edges is its own component.
    """
    e = checkpointed(_undirected(edge_df))
    seen = _edge_checksum(e)
    while True:
        e = checkpointed(_small_star(_large_star(e)))
        last, seen = seen, _edge_checksum(e)
        if seen == last:
            break
    centre = e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("c"))
    return (vertex_df.select("id").join(centre, "id", "left")
            .select("id", F.coalesce(F.col("c"), F.col("id")).alias("component")))


def largest_component(vertex_df: DataFrame, edge_df: DataFrame) -> DataFrame:
    """Members (``id``) of the largest component; a size tie goes to the smallest label."""
    comps = checkpointed(connected_components(vertex_df, edge_df))
    best = (comps.groupBy("component").count()
            .orderBy(F.col("count").desc(), F.col("component")).limit(1).select("component"))
    return comps.join(F.broadcast(best), "component", "left_semi").select("id")


def component_edges(vertex_df: DataFrame, edge_df: DataFrame) -> DataFrame:
    """The largest component as a graph: its edges."""
    return induced(edge_df, checkpointed(largest_component(vertex_df, edge_df)))


def node_profile(nodes: DataFrame, scores: DataFrame, sales: DataFrame, *,
                 item: str = "family", value: str = "sales") -> DataFrame:
    """Per node: total sales of that category (0 when it has none) and its centrality.

    Totals are aggregated per category first (map-side partial step, output
    bounded by the number of categories), then joined to the nodes, so no
    fact-sized join is needed whatever the size of the node set.
    """
    ids = nodes.select("id")
    totals = (sales.groupBy(F.col(item).alias("id"))
              .agg(money_round(F.sum(value), 2).alias("total_sales")))
    return (ids.join(totals, "id", "left").join(scores.select("id", "score"), "id", "left")
            .select("id", F.coalesce(F.col("total_sales"), F.lit(0.0)).alias("total_sales"), "score"))
