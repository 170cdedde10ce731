"""Bill-of-materials graphs: kernel fingerprints, and traversal without repeated nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom.operators.search import Queries, best, fill, query_ids
from bomloom.sources.inputs import default, relation, required
from bomloom.sources.tables import dropped, written

MAX_LEVELS, MAX_DEPTH = 5, 64
#: The share of a query's weight, in its rarest components, by which kernel search finds its first materials.
SEED_SHARE = 0.1
#: By so much a score may miss its bound in binary fractions.
_SLACK = 1e-9
#: Pairs are counted by component unless so many times as many meet there as have to be sent.
_MEETINGS = 4
#: Components of more holders are not joined on: what a material shares of them is looked up where it can be among a query's best.
FREQUENT = 1_000


def kernel_levels(iterations: int | None) -> int:
    return max(1, min(MAX_LEVELS, default(iterations, 3)))


def distinct_edges(bom: DataFrame) -> DataFrame:
    return bom.select(F.col("parent_id").cast("string").alias("parent_id"), F.col("child_id").cast("string").alias("child_id")).where("parent_id IS NOT NULL").distinct()


def fingerprints(bom: DataFrame, iterations: int | None = 3, roots: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """material_id, component, occurrence: at how many depths a component lies below a material (of roots, or of all); stored: bom has distinct edges.

    Depths are 1 to iterations, 5 at most; each level is distinct before the next join, and
    the last where depths are counted. Of all materials, a level is made from the one
    below its children, of which only the parents of something at that depth matter. A
    null child is a component of its own, below which nothing lies.
    """
    levels = kernel_levels(iterations)
    pairs = bom if stored else written(distinct_edges(bom))
    level = pairs.select(F.col("parent_id").alias("material_id"), F.col("child_id").alias("component"))
    if roots is not None:
        level = written(level.join(roots.select(F.col(roots.columns[0]).alias("material_id")).distinct(), "material_id", "left_semi"))
    found = level.withColumn("depth", F.lit(1))
    for depth in range(2, levels + 1):
        if roots is not None:
            level = level.join(pairs, level["component"] == pairs["parent_id"]).select("material_id", F.col("child_id").alias("component"))
        else:
            links = pairs
            if depth > 2:
                above = written(level.select("material_id").distinct())
                links = pairs.join(above, pairs["child_id"] == above["material_id"], "left_semi")
            below = level.withColumnRenamed("material_id", "child_id")
            # A merge join holds the right side's rows of a key in memory: parents of a child, not all that lies below it.
            level = below.join(links, "child_id").select(F.col("parent_id").alias("material_id"), "component")
        if depth < levels:
            level = written(level.distinct())
        found = found.unionAll(level.withColumn("depth", F.lit(1 << depth - 1)))
    return found.groupBy("material_id", "component").agg(F.bit_count(F.bit_or("depth")).cast("long").alias("occurrence"))


def wl_kernel_similarity(spark: SparkSession, pairs: DataFrame, iterations: int | None = 3, bom_table: DataFrame | str | None = "bom_items") -> DataFrame:
    """material_a, material_b, similarity for each of the pairs (its first two columns): weighted Jaccard of the fingerprints.

    A material is 1 to itself, known or not; two without components are 0 to each other.
    """
    bom = relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table")
    a, b = pairs.columns[:2]
    wanted = pairs.select(F.col(a).cast("string").alias("material_a"), F.col(b).cast("string").alias("material_b")).distinct()
    roots = wanted.select(F.explode(F.array("material_a", "material_b")).alias("material_id")).distinct()
    prints = written(fingerprints(bom, iterations, roots))
    totals = written(prints.groupBy("material_id").agg(F.sum("occurrence").alias("total"), F.count("*").alias("n")))
    both = written(wanted.select(F.least("material_a", "material_b").alias("a"), F.greatest("material_a", "material_b").alias("b")).where("a < b").distinct())
    of = lambda side: prints.select(F.col("material_id").alias(side), "component", F.col("occurrence").alias(f"n_{side}"))
    met = prints.groupBy("component").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]
    sent = both.join(totals, both["a"] == totals["material_id"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if met <= _MEETINGS * sent:
        # Most that meet are wanted: pairs are counted where they meet, and no row is sent for each.
        rows = of("a").join(of("b"), "component").where("a < b").join(both, ["a", "b"], "left_semi")
    else:
        rows = both.join(of("a"), "a").join(of("b"), ["b", "component"])
    common = rows.groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    out = wanted.join(common, (F.least("material_a", "material_b") == F.col("a")) & (F.greatest("material_a", "material_b") == F.col("b")), "left").drop("a", "b")
    for side in ("a", "b"):
        out = out.join(totals.select(F.col("material_id").alias(f"material_{side}"), F.col("total").alias(f"total_{side}")), f"material_{side}", "left")
    n, both = F.coalesce("common", F.lit(0)), F.coalesce("total_a", F.lit(0)) + F.coalesce("total_b", F.lit(0))
    score = F.when(F.col("material_a") == F.col("material_b"), 1.0).when(both - n == 0, 0.0).otherwise(n / F.nullif(both - n, F.lit(0)))
    return out.select("material_a", "material_b", score.alias("similarity"))


def total_bounds(pairs: DataFrame, levels: int) -> DataFrame:
    """material_id, least, most: numbers between which its fingerprint's total lies, from distinct edges without a fingerprint.

    Its children are its first level; no more components lie d levels down than paths go
    there, and no fewer than they are if each step after the first counts as one over the
    parents of what it leads to. Each level is one join with two numbers a material.
    """
    parents = pairs.groupBy(F.col("child_id").alias("node")).agg((1.0 / F.count("*")).alias("share"))
    links = written(pairs.join(parents, pairs["child_id"] == parents["node"], "left").select("parent_id", "child_id", F.coalesce("share", F.lit(0.0)).alias("share")))
    level = links.groupBy(F.col("parent_id").alias("material_id")).agg(F.count("*").cast("double").alias("n"), F.sum("share").alias("shares"))
    out = level.select("material_id", F.col("n").alias("least"), F.col("n").alias("most"))
    for _ in range(1, levels):
        below = links.join(level, links["child_id"] == level["material_id"]).groupBy(F.col("parent_id").alias("material_id"))
        level = written(below.agg(F.sum("n").alias("n"), F.sum("shares").alias("least_n"), F.sum(F.col("shares") * F.col("share")).alias("shares")))
        more = lambda c, n: (F.col(c) + F.coalesce(n, F.lit(0.0))).alias(c)
        out = out.join(level, "material_id", "left").select("material_id", more("least", "least_n"), more("most", "n"))
    return out


def _above(pairs: DataFrame, start: DataFrame, levels: int) -> DataFrame:
    """start's columns but node, with material_id: the materials above its nodes, at most so many levels."""
    keys = [c for c in start.columns if c != "node"]
    level, out = start, None
    for _ in range(levels):
        level = pairs.join(level, pairs["child_id"] == level["node"]).select(*keys, F.col("parent_id").alias("node")).distinct()
        out = level if out is None else out.unionAll(level)
    return out.distinct().withColumnRenamed("node", "material_id")


def _counted_above(pairs: DataFrame, own: DataFrame, levels: int) -> DataFrame:
    """query_id, material_id, shared: how much the materials above a query's components (query_id, component, own) share of these."""
    level = own.withColumn("node", F.col("component"))
    out = None
    for _ in range(levels):
        up = pairs.join(level, pairs["child_id"] == level["node"]).select("query_id", "component", "own", F.col("parent_id").alias("node"))
        level = written(up.distinct())
        out = level if out is None else out.unionAll(level)
    each = out.groupBy("query_id", "component", "own", "node").agg(F.count("*").alias("occurrence"))
    return each.groupBy("query_id", F.col("node").alias("material_id")).agg(F.sum(F.least("own", "occurrence")).alias("shared"))


def _rarest(own: DataFrame, bounds: DataFrame) -> DataFrame:
    """query_id, component: the rarest components of each query, so many that who shares others alone has a score below the query's bound.

    Sharing components of weight w gives a score of w / total at most. Components of equally
    many holders are taken or left together, so that numbers of holders are ranked, not
    the components of one query.
    """
    weights = own.groupBy("query_id", "holders").agg(F.sum("own").alias("weight"))
    commoner = F.sum("weight").over(Window.partitionBy("query_id").orderBy(F.desc("holders")))
    kept = weights.withColumn("commoner", commoner).join(bounds, "query_id").where(F.col("commoner") >= (F.col("bound") - _SLACK) * F.col("total"))
    return own.join(kept.select("query_id", "holders"), ["query_id", "holders"], "left_semi").select("query_id", "component")


def _by_holders(own: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own of the components that at most FREQUENT of prints hold, own of the others, prints of the others)."""
    counts = prints.join(own.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.count("*").alias("n"))
    many = written(counts.where(F.col("n") > FREQUENT).select("component"))
    return own.join(many, "component", "left_anti"), own.join(many, "component", "left_semi"), prints.join(many, "component", "left_semi")


def _looked_up(candidates: DataFrame, own: DataFrame, prints: DataFrame) -> DataFrame:
    """query_id, material_id, common: a row for each component that a candidate (query_id, material_id) shares."""
    met = candidates.join(prints, "material_id").join(own, ["query_id", "component"])
    return met.select("query_id", "material_id", F.least("own", "occurrence").alias("common"))


def _kernel_scores(own: DataFrame, totals: DataFrame, candidates: DataFrame, prints: DataFrame) -> DataFrame:
    """query_id, material_id, similarity of the candidates (query_id, material_id) that share a component with the query."""
    size = prints.groupBy("material_id").agg(F.sum("occurrence").alias("n"))
    rare, frequent, held = _by_holders(own.select("query_id", "component", "own"), prints)
    met = rare.join(prints, "component").join(candidates, ["query_id", "material_id"], "left_semi").select("query_id", "material_id", F.least("own", "occurrence").alias("common"))
    met = met.unionAll(_looked_up(candidates, frequent, held))
    common = met.groupBy("query_id", "material_id").agg(F.sum("common").alias("common")).join(size, "material_id").join(totals, "query_id")
    return common.select("query_id", "material_id", (F.col("common") / (F.col("n") + F.col("total") - F.col("common"))).alias("similarity"))


def kernel_candidates(pairs: DataFrame, own: DataFrame, totals: DataFrame, k: int, least: float, iterations: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """(query_id, material_id, similarity of some, query_id, material_id of what else can be among a query's k best of at least that score), as tables.

    pairs: distinct edges; own: query_id, component, own, holders (direct parents) of the
    queries' fingerprints; totals: query_id, total. What materials share of a query's
    rarest components bounds its k-th score from below. Of the components that this bound
    asks for, those of few holders are walked up from, and what a material shares of them
    is counted on the way; of the others it shares their weight at most. The k that this
    puts first are scored, and raise the bound. Materials that hold none of what was
    walked up from are told apart by their totals, if these leave fewer than hold the
    rest. Where fewer than k are met, all that share a component are walked up to.
    """
    levels, key = kernel_levels(iterations), ["query_id", "material_id"]
    size = written(total_bounds(pairs, levels))
    seeds = own.join(_rarest(own, totals.withColumn("bound", F.lit(1.0 - SEED_SHARE))), ["query_id", "component"], "left_semi")
    met = _counted_above(pairs, seeds.select("query_id", "component", "own"), levels).where("material_id <> query_id").join(size, "material_id").join(totals, "query_id")
    low = written(met.select(*key, (F.col("shared") / (F.col("total") + F.col("most") - F.col("shared"))).alias("similarity")))
    bounds = written(_raised(totals.withColumn("bound", F.lit(float(least))), low, k))
    asked = written(own.join(_rarest(own, bounds), ["query_id", "component"], "left_semi").join(bounds.select("query_id", "bound"), "query_id"))
    few = (F.col("holders") <= FREQUENT) | (F.col("bound") <= 0)
    walked = asked.where(few).select("query_id", "component", "own")
    weight = lambda rows, name: rows.groupBy("query_id").agg(F.sum("own").alias(name))
    left = weight(own, "all_own").join(weight(walked, "walked"), "query_id", "left").select("query_id", (F.col("all_own") - F.coalesce("walked", F.lit(0))).alias("left"))
    bounds = written(bounds.join(left, "query_id"))
    met = written(_counted_above(pairs, walked, levels).where("material_id <> query_id").join(size, "material_id").join(bounds, "query_id"))
    # Of a material that shares so much of what was walked up from, this is the score at most.
    most = F.least(F.col("shared") + F.col("left"), F.col("most"))
    reached = most / (F.col("total") + F.greatest(F.col("least"), most) - most)
    first = written(best(met.select(*key, reached.alias("similarity")), k).select(*key))
    prints = written(fingerprints(pairs, levels, first.select("material_id"), stored=True))
    scored = written(_kernel_scores(own, totals, first, prints))
    bounds = written(_raised(bounds, scored, k))
    fits = reached >= F.col("bound") - _SLACK
    others = met.drop("bound").join(bounds.select("query_id", "bound"), "query_id").where(fits).select(*key)
    # Of those that hold none of it, groups of about equal totals are held against the bound, as there are far fewer than materials.
    grouped = size.select("material_id", F.floor("least").alias("least"), F.ceil("most").alias("most"))
    short = bounds.where("bound > 0 AND left > 0").withColumn("shared", F.lit(0))
    near = written(short.crossJoin(grouped.groupBy("least", "most").agg(F.count("*").alias("n"))).where(fits).select("query_id", "least", "most", "n"))
    rest = asked.where(~few).groupBy("query_id").agg(F.sum("holders").alias("holders"))
    many = written(near.groupBy("query_id").agg(F.sum("n").alias("n")).join(rest, "query_id").where("n > holders").select("query_id"))
    unmet = near.join(many, "query_id", "left_anti").join(grouped, ["least", "most"]).select(*key)
    if not many.isEmpty():
        start = asked.where(~few).join(many, "query_id", "left_semi").select("query_id", F.col("component").alias("node"))
        above = _above(pairs, start, levels).join(size, "material_id").join(short, "query_id").where(fits).select(*key)
        unmet = unmet.unionAll(above)
    others = written(others.unionAll(unmet.where("material_id <> query_id").join(met, key, "left_anti")).join(first, key, "left_anti"))
    dropped(size, low, asked, met, first, prints, bounds, near, many)
    return scored, others


def _raised(bounds: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """bounds (query_id, bound and more), each raised to the query's k-th score, if it has so many."""
    found = best(scored, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("kth"))
    return bounds.join(found, "query_id", "left").withColumn("bound", F.greatest("bound", F.coalesce("kth", F.lit(0.0)))).drop("kth")


def kernel_queries(pairs: DataFrame, ids: DataFrame, iterations: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """(query_id, component, own, holders) of the fingerprints of ids and (query_id, total), as tables."""
    holders = pairs.groupBy(F.col("child_id").alias("component")).agg(F.count("*").alias("holders"))
    prints = fingerprints(pairs, iterations, ids, stored=True).select(F.col("material_id").alias("query_id"), "component", F.col("occurrence").alias("own"))
    own = written(prints.join(holders, "component", "left"))
    return own.where("component IS NOT NULL"), written(own.groupBy("query_id").agg(F.sum("own").alias("total")))


def _kernel_common(own: DataFrame, prints: DataFrame, totals: DataFrame, k: int, least: float) -> DataFrame:
    """query_id, material_id, common of all materials that can be among a query's k best of at least that score, and share a component.

    Only components of few holders are joined on. What a material shares of the others is
    at most its own weight of them and at most the query's; the k of the highest scores
    that this allows are counted first, and their least score bounds what else is counted.
    Materials that share nothing rare are told apart by their numbers alone.
    """
    rare, frequent, held = _by_holders(own, prints)
    held = written(held)
    sizes = written(totals.join(held.groupBy("material_id").agg(F.sum("occurrence").alias("often")), "material_id", "left").select("material_id", "total", F.coalesce("often", F.lit(0)).alias("often")))
    asked = own.select("query_id").distinct().join(totals.select(F.col("material_id").alias("query_id"), F.col("total").alias("whole")), "query_id")
    asked = asked.join(frequent.groupBy("query_id").agg(F.sum("own").alias("weight")), "query_id", "left")
    asked = written(asked.select("query_id", "whole", F.coalesce("weight", F.lit(0)).alias("weight")))
    met = rare.join(prints, "component").where("material_id <> query_id").groupBy("query_id", "material_id").agg(F.sum(F.least("own", "occurrence")).alias("rare"))
    most = F.col("rare") + F.least("weight", "often")
    met = written(met.join(sizes, "material_id").join(asked, "query_id").withColumn("similarity", most / (F.col("total") + F.col("whole") - most)))

    def counted(some: DataFrame) -> DataFrame:
        rows = some.select("query_id", "material_id", F.col("rare").alias("common")).unionAll(_looked_up(some.select("query_id", "material_id"), frequent, held))
        return rows.groupBy("query_id", "material_id").agg(F.sum("common").alias("common")).where("common > 0")

    key = ["query_id", "material_id"]
    first = written(best(met, k).select(*key, "rare", "total", "whole"))
    done = written(counted(first))
    score = F.col("common") / (F.col("total") + F.col("whole") - F.col("common"))
    found = done.join(first, key).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min(score)).alias("kth"))
    bounds = written(asked.join(found, "query_id", "left").select("query_id", "whole", "weight", (F.greatest(F.coalesce("kth", F.lit(0.0)), F.lit(float(least))) - _SLACK).alias("bound")))
    others = met.join(bounds.select("query_id", "bound"), "query_id").where(F.col("similarity") >= F.col("bound")).select(*key, "rare").join(first, key, "left_anti")
    # Of those that share nothing rare, groups of equal numbers are held against the bound, as there are far fewer than materials.
    groups = sizes.where("often > 0").select("total", "often").distinct()
    most = F.least("weight", "often")
    near = bounds.where("weight > 0").crossJoin(groups).where(most / (F.col("total") + F.col("whole") - most) >= F.col("bound")).select("query_id", "total", "often")
    unmet = near.join(sizes, ["total", "often"]).where("material_id <> query_id").select(*key, F.lit(0).cast("long").alias("rare")).join(met, key, "left_anti")
    return done.unionAll(counted(others.unionAll(unmet)))


def find_similar_materials_wl_kernel(spark: SparkSession, queries: Queries, k: int, iterations: int | None = 3, min_similarity: float | None = 0.0, bom_table: DataFrame | str | None = "bom_items") -> DataFrame:
    """query_id, material_id, similarity: for each query the k most similar; to an unknown query every material is 0.

    Makes the fingerprints of all materials; find_similar_materials_wl_bounded makes few
    where products share rare components.
    """
    k, least = required(k, "k"), default(min_similarity, 0.0)
    ids = query_ids(spark, queries)
    prints = written(fingerprints(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table"), iterations))
    totals = written(prints.groupBy("material_id").agg(F.sum("occurrence").alias("total")))
    own = written(prints.join(ids, prints["material_id"] == ids["query_id"]).where("component IS NOT NULL").select("query_id", "component", F.col("occurrence").alias("own")))
    common = _kernel_common(own, prints, totals, k, least)
    if least <= 0:
        common = common.unionByName(fill(common, ids, totals, k).withColumn("common", F.lit(0).cast("long")))
    whole = common.join(totals, "material_id").join(totals.select(F.col("material_id").alias("query_id"), F.col("total").alias("own")), "query_id", "left")
    score = F.col("common") / (F.col("total") + F.coalesce("own", F.lit(0)) - F.col("common"))
    return best(whole.select("query_id", "material_id", score.alias("similarity")).where(F.col("similarity") >= least), k)


def find_similar_materials_wl_bounded(spark: SparkSession, queries: Queries, k: int, iterations: int | None = 3, min_similarity: float | None = 0.0, bom_table: DataFrame | str | None = "bom_items") -> DataFrame:
    """As find_similar_materials_wl_kernel, with fingerprints of the queries and of kernel_candidates only."""
    k, least = required(k, "k"), default(min_similarity, 0.0)
    ids = query_ids(spark, queries)
    pairs = written(distinct_edges(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table")))
    own, totals = kernel_queries(pairs, ids, iterations)
    scored, candidates = kernel_candidates(pairs, own, totals, k, least, iterations)
    scored = scored.unionByName(_kernel_scores(own, totals, candidates, written(fingerprints(pairs, iterations, candidates.select("material_id"), stored=True))))
    if least <= 0:
        materials = pairs.select(F.col("parent_id").alias("material_id")).distinct()
        scored = scored.unionByName(fill(scored, ids, materials, k).withColumn("similarity", F.lit(0.0)))
    return best(scored.where(F.col("similarity") >= least), k)


def bom_edges(header: DataFrame, component: DataFrame) -> DataFrame:
    """parent_material_id, child_material_id, quantity_per of header and component tables."""
    return header.select("bom_id", "parent_material_id").join(component.select("bom_id", "child_material_id", "quantity_per"), "bom_id").drop("bom_id")


def bom_explosion_1level(material: str, header: DataFrame, component: DataFrame) -> DataFrame:
    return bom_edges(header.where(F.col("parent_material_id") == material), component).orderBy("child_material_id")


def bom_where_used(material: str, header: DataFrame, component: DataFrame) -> DataFrame:
    return bom_edges(header, component.where(F.col("child_material_id") == material)).orderBy("parent_material_id")


def reached(links: DataFrame, root: str, max_depth: int | None, otherwise: int, stored: bool = False) -> DataFrame:
    """node, depth: the nodes that 1 to max_depth steps over links (a, b) reach from root, each at its least depth; stored: links are distinct rows of a table.

    Breadth first, one join a level; nodes that were met aren't followed again, so cycles
    and diamonds end. The root is reached only over a cycle.
    """
    depth = min(default(max_depth, otherwise), MAX_DEPTH)
    spark = links.sparkSession
    links = links if stored else written(links.select("a", "b").dropna().distinct())
    front = spark.createDataFrame([(root,)], "node string")
    met = spark.createDataFrame([], "node string, depth int")
    for step in range(1, depth + 1):
        new = links.join(front, links["a"] == front["node"], "left_semi").select(F.col("b").alias("node")).distinct().join(met, "node", "left_anti")
        front = written(new)
        if front.isEmpty():
            break
        met = met.unionAll(front.withColumn("depth", F.lit(step)))
    return met


def bom_explosion_multilevel(material: str, header: DataFrame, component: DataFrame, max_depth: int | None = 10) -> DataFrame:
    """The distinct edges that a walk of at most max_depth steps from the material uses."""
    whole = bom_edges(header, component)
    depth = min(default(max_depth, 10), MAX_DEPTH)
    if depth < 1:
        return whole.limit(0)
    spark, whole = whole.sparkSession, written(whole.distinct())
    links = whole.select(F.col("parent_material_id").alias("a"), F.col("child_material_id").alias("b")).dropna()
    below = reached(links, material, depth - 1, 10, stored=True).select("node")
    start = below.unionAll(spark.createDataFrame([(material,)], "node string")).distinct()
    return whole.join(start, whole["parent_material_id"] == start["node"], "left_semi")


def bom_dfs_neighborhood(bom: DataFrame, root: str, max_depth: int | None = 3) -> DataFrame:
    """component: what lies within max_depth steps below root."""
    return reached(bom.select(F.col("parent_id").cast("string").alias("a"), F.col("child_id").cast("string").alias("b")), root, max_depth, 3).select(F.col("node").alias("component"))


def bom_common_components(material_1: str, material_2: str, header: DataFrame, component: DataFrame) -> DataFrame:
    whole = bom_edges(header, component)
    of = lambda m: whole.where(F.col("parent_material_id") == m).select("child_material_id").distinct()
    both = of(material_1).join(of(material_2), "child_material_id")
    return both.select(F.col("child_material_id").alias("child_material_id_1"), F.col("child_material_id").alias("child_material_id_2")).orderBy("child_material_id_1")


def bom_property_graph(header: DataFrame, component: DataFrame, source_system: str = "TEST") -> DataFrame:
    """One row: graph_name, source, num_nodes, num_edges of a source's bills of materials."""
    own = header.where(F.col("source_system") == source_system)
    nodes = own.agg(F.count_distinct("parent_material_id").alias("num_nodes"))
    lines = component.join(own.select("bom_id"), "bom_id").agg(F.count("*").alias("num_edges"))
    return nodes.crossJoin(lines).select(F.lit(f"BOM_PROPERTY_GRAPH_{source_system}").alias("graph_name"), F.lit(source_system).alias("source"), "num_nodes", "num_edges")


def quantity_rollup(bom: DataFrame, root: str, max_depth: int = 4) -> DataFrame:
    """component, depth, path, quantity: every path below root with the product of its quantities; a path never meets a node twice."""
    pairs = written(bom.select(F.col("parent_id").alias("p"), F.col("child_id").alias("c"), F.col("quantity").cast("double").alias("q")))
    level = pairs.where(F.col("p") == root).select(F.col("c").alias("component"), F.array("p", "c").alias("nodes"), F.col("q").alias("quantity"))
    out = level.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        step = level.join(pairs, level["component"] == pairs["p"]).where(~F.array_contains("nodes", F.col("c")))
        level = written(step.select(F.col("c").alias("component"), F.concat("nodes", F.array("c")).alias("nodes"), (F.col("quantity") * F.col("q")).alias("quantity")))
        out = out.unionAll(level.withColumn("depth", F.lit(depth)))
    return out.select("component", "depth", F.array_join("nodes", "/").alias("path"), "quantity")


def refined_labels(bom: DataFrame, rounds: int = 2) -> DataFrame:
    """node, label: labels by which structure differs, each round the MD5 of a node's label and its children's sorted ones."""
    pairs = bom.select(F.col("parent_id").alias("p"), F.col("child_id").alias("c")).dropna().distinct()
    nodes = pairs.select(F.explode(F.array("p", "c")).alias("node")).distinct()
    label = nodes.withColumn("label", F.md5(F.lit("").cast("binary")))
    for _ in range(rounds):
        below = pairs.join(label, pairs["c"] == label["node"]).groupBy("p").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("below"))
        label = label.join(below, label["node"] == below["p"], "left").select("node", F.md5(F.concat_ws("|", "label", F.coalesce("below", F.lit(""))).cast("binary")).alias("label"))
    return label
