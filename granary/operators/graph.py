"""Graphs over tags and files: co-occurrence, containment, nearest neighbours, induced subgraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize, shared_dir

#: The kinds of a tag graph in order, and its bounds.
KINDS = ("topic", "doctype", "author", "custom", "pattern", "entity", "date")
MAX_NODES, MAX_EDGES, PER_KIND, MIN_WEIGHT = 60, 240, 12, 2
#: Fixed values of the file graph: share of files above which a tag is dropped, shared tags, cosine, neighbours.
DF_CAP, MIN_SHARED, MIN_COSINE, NEIGHBOURS = 0.25, 2, 0.35, 5
CONTAINED = 0.6


def tag_nodes(asset_tag: DataFrame, contents: DataFrame, *, per_kind: int = PER_KIND, most: int = MAX_NODES, key: str = "asset_id") -> DataFrame:
    """(kind, name, n): the most frequent tags of each kind among ``contents``, at most ``most`` in kind order."""
    t = asset_tag.filter(F.col("kind").isin(*KINDS)).join(contents.select(key).distinct(), key, "left_semi").select(key, "kind", "name").distinct()
    n = t.groupBy("kind", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    n = n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_kind)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return n.orderBy(order, F.desc("n"), "name").limit(most).select("kind", "name", "n")


def tag_edges(asset_tag: DataFrame, contents: DataFrame, nodes: DataFrame, *, least: int = MIN_WEIGHT, most: int | None = MAX_EDGES, key: str = "asset_id") -> DataFrame:
    """Pairs of node tags that meet in at least ``least`` contents; strength is the share of the rarer tag.

    ``key`` says what is counted: contents, or files where tags and ``contents`` have a file_id.

    Only tags of the (at most 60) nodes enter, so each content gives a bounded number of pairs,
    which are generated from its own array instead of by a self-join.
    """
    live = contents.select(key).distinct()
    t = asset_tag.select(key, "kind", "name").distinct().join(F.broadcast(nodes), ["kind", "name"]).join(live, key, "left_semi")
    own = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "name", "n"))).alias("ts"))
    pairs = own.select(F.explode("ts").alias("a"), "ts").select("a", F.explode(F.filter("ts", lambda x: x > F.col("a"))).alias("b"))
    w = pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    out = w.select(
        F.concat_ws(":", "a.kind", "a.name").alias("source"), F.concat_ws(":", "b.kind", "b.name").alias("target"), "weight",
        F.round(F.col("weight") / F.least("a.n", "b.n"), 4).alias("strength"), F.col("a.n").alias("n_source"), F.col("b.n").alias("n_target"),
    )
    return out.orderBy(F.desc("strength"), F.desc("weight"), "source", "target").limit(most) if most else out


def containment(edges: DataFrame, least: float = CONTAINED) -> DataFrame:
    """(parent, child, share): the broader tag of an edge contains the narrower if most of that meets it.

    Tags rank by count, then by id; an edge leads from the broader to the narrower.
    """
    s_first = (F.col("n_source") > F.col("n_target")) | ((F.col("n_source") == F.col("n_target")) & (F.col("source") < F.col("target")))
    e = edges.select(F.when(s_first, F.col("source")).otherwise(F.col("target")).alias("parent"), F.when(s_first, F.col("target")).otherwise(F.col("source")).alias("child"), (F.col("weight") / F.least("n_source", "n_target")).alias("share"))
    return e.filter(F.col("share") >= least)


def reduced(dag: DataFrame) -> DataFrame:
    """Drop the edges of a DAG that a longer path also gives; one join a step of the longest path. A cycle is an error."""
    shared_dir(dag.sparkSession)
    base = dag.select("parent", "child").distinct().checkpoint()
    nodes = base.select(F.explode(F.array("parent", "child")).alias("node")).distinct().count()
    nxt = base.select(F.col("parent").alias("child"), F.col("child").alias("next"))
    reach, longer = base, None
    for _ in range(nodes + 1):
        reach = reach.join(nxt, "child").select("parent", F.col("next").alias("child")).distinct().checkpoint()
        if not reach.limit(1).count():
            return base.join(longer, ["parent", "child"], "left_anti") if longer is not None else base
        longer = (reach if longer is None else longer.union(reach).distinct()).checkpoint()
    raise ValueError("the edges have a cycle")


def depths(dag: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth): the longest path from a root of a DAG, one level a round. A cycle is an error."""
    shared_dir(dag.sparkSession)
    base = dag.select("parent", "child").distinct().checkpoint()
    ends = [base.select(F.col("parent").alias("node")), base.select(F.col("child").alias("node"))] + ([nodes.select("node")] if nodes is not None else [])
    level = reduce(DataFrame.union, ends).distinct().withColumn("depth", F.lit(0)).checkpoint()
    for _ in range(level.count() + 1):  # no path is longer than the nodes
        nxt = base.join(level.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg((F.max("depth") + 1).alias("d"))
        new = level.join(nxt, "node", "left").select("node", F.coalesce("d", "depth").alias("depth")).checkpoint()
        if not new.join(level, ["node", "depth"], "left_anti").limit(1).count():
            return new
        level = new
    raise ValueError("the edges have a cycle")


def components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "source", b: str = "target") -> DataFrame:
    """(node, component): each node of an undirected tag graph with the least node it is connected with.

    Every round a node takes the least label of itself and its neighbours, and then the label of
    its label, so a path of n nodes settles in about log n rounds; each round is checkpointed.
    """
    shared_dir(edges.sparkSession)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.union(both.select("v", "u")).distinct().checkpoint()
    every = both.select(F.col("u").alias("node"))
    label = (every if nodes is None else every.union(nodes.select("node"))).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        seen = both.join(label.toDF("v", "near"), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        new = label.join(seen, "node", "left").select("node", F.least("component", "near").alias("component"))
        new = new.join(new.toDF("component", "up"), "component").select("node", F.col("up").alias("component")).checkpoint()
        if not new.join(label, ["node", "component"], "left_anti").limit(1).count():
            return new
        label = new


def wrapped(nodes: DataFrame, dag: DataFrame, width: int = 12) -> DataFrame:
    """(node, row, col): tags that no edge of the DAG touches, most frequent first, in rows of ``width`` below the base.

    nodes(node, n); the rows follow the deepest level of the DAG.
    """
    loose = nodes.join(dag.select(F.explode(F.array("parent", "child")).alias("node")).distinct(), "node", "left_anti")
    base = depths(dag).agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("base"))
    k = F.row_number().over(Window.orderBy(F.desc("n"), "node")) - 1  # nodes of a tag graph, of which there are at most MAX_NODES
    return loose.select("node", k.alias("k")).crossJoin(F.broadcast(base)).select("node", (F.col("base") + 1 + F.floor(F.col("k") / width)).cast("long").alias("row"), (F.col("k") % width).cast("long").alias("col"))


def tag_idf(asset_tag: DataFrame) -> DataFrame:
    """(kind, name, df, idf) with idf = ln(contents / df)."""
    t = asset_tag.select("asset_id", "kind", "name").distinct()
    n = t.agg(F.countDistinct("asset_id").alias("total"))
    return t.groupBy("kind", "name").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("kind", "name", "df", F.log(F.col("total") / F.col("df")).alias("idf"))


def _weighted(asset_tag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, name, asset_id, idf) and (asset_id, norm)."""
    t = materialize(asset_tag.select("asset_id", "kind", "name").distinct().join(tag_idf(asset_tag).drop("df"), ["kind", "name"]), "tag-weights")
    return t, t.groupBy("asset_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))


#: Vectors of a block; lists of more vectors under one pair of tags are compared block by block.
BLOCK = 2000


def _pairs_of_tags(v: DataFrame, least: float) -> DataFrame:
    """Vectors (cls, tags, norm) under each pair of their tags (h1, h2), rarest first, that may be the two rarest of a likely pair.

    If two tags are the two rarest that a vector shares, the shared weight is at most theirs
    and that of all tags after them (``most``). As it is no more than that for the other vector either, nor
    than the other's whole norm, the cosine can only reach ``least`` if ``most`` is at least ``least``
    squared of the vector's own squared norm: keys beyond that prefix of the vector are not posted.
    """
    n = F.size("tags")
    square = lambda t: t["idf"] * t["idf"]
    v = v.withColumn("rest", F.transform("tags", lambda _, i: F.aggregate(F.slice("tags", i + 1, n), F.lit(0.0), lambda s, t: s + square(t))))
    tag = lambda i: F.get("tags", i)
    key = lambda i, j: F.struct(tag(i)["h"].alias("h1"), tag(j)["h"].alias("h2"), (square(tag(i)) + F.get("rest", j)).alias("most"))
    keys = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: key(i, j))))
    likely = F.filter(keys, lambda x: x["most"] >= F.lit(least * least * (1 - 1e-9)) * F.col("norm") * F.col("norm"))
    return v.filter(n >= 2).withColumn("key", F.explode(likely)).select("key.h1", "key.h2", "key.most", "cls", F.col("tags.h").alias("hs"), F.transform("tags", square).alias("ws"), "norm")


def nearest(asset_tag: DataFrame, *, cap: float = DF_CAP, shared: int = MIN_SHARED, least: float = MIN_COSINE, k: int = NEIGHBOURS) -> DataFrame:
    """Edges (a < b) of the k nearest neighbours by IDF-weighted cosine, kept if either end chose the other.

    Frequent tags are dropped. Contents with the same tags are one vector, of which only the
    k + 1 least ids can be anyone's neighbour, so the join is between different vectors. As
    neighbours share two tags, vectors are joined on pairs of tags, and a pair of vectors is only formed
    under its two rarest shared tags: once, and never by one frequent tag. Only the prefix of a vector that can still
    reach ``least`` is posted, and a pair whose bounds cannot is dropped before its tags are compared. Long lists are
    compared block by block. ``shared`` is at least 2.
    """
    if shared < 2:
        raise ValueError("neighbours share at least two tags")
    idf = tag_idf(asset_tag)
    total = asset_tag.agg(F.countDistinct("asset_id")).first()[0]
    rare = idf.filter(F.col("df") <= cap * total).select("kind", "name", F.struct("df", F.xxhash64("kind", "name").alias("h"), "idf").alias("t"))
    t = asset_tag.select("asset_id", "kind", "name").distinct().join(rare, ["kind", "name"])
    vectors = t.groupBy("asset_id").agg(F.array_sort(F.collect_list("t")).alias("tags")).withColumn("cls", F.xxhash64("tags"))
    vectors = materialize(vectors, "knn-vectors")
    w = Window.partitionBy("cls").orderBy("asset_id")
    norm = F.sqrt(F.aggregate("tags", F.lit(0.0), lambda s, x: s + x["idf"] * x["idf"]))
    v = vectors.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1).groupBy("cls").agg(F.array_sort(F.collect_list("asset_id")).alias("ids"), F.first("tags").alias("tags"))
    v = materialize(v.withColumn("norm", norm), "knn-classes")
    keyed = _pairs_of_tags(v, least)
    sizes = keyed.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1")
    keyed = keyed.join(sizes, ["h1", "h2"])
    nb = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls"), nb).cast("int")
    ij = F.explode(F.transform(F.sequence(F.lit(0), nb - 1), lambda x: F.struct(F.least(mine, x).alias("i"), F.greatest(mine, x).alias("j"))))
    dealt = keyed.withColumn("ij", ij).select("h1", "h2", "ij.i", "ij.j", "most", "cls", "hs", "ws", "norm", mine.alias("blk"))
    other = dealt.select("h1", "h2", "i", "j", *[F.col(x).alias(f"{x}2") for x in ("most", "cls", "hs", "norm", "blk")])
    reach = F.least("most", "most2") >= F.lit(least * (1 - 1e-9)) * F.col("norm") * F.col("norm2")  # what both still share can be enough
    met = dealt.join(other, ["h1", "h2", "i", "j"]).filter("cls < cls2").filter("blk <> blk2 OR i = j").filter(reach)
    # generated, so that the shared tags (rarest first, as both arrays are) are computed once for each pair
    met = met.withColumn("both", F.explode(F.array(F.array_intersect("hs", "hs2"))))
    met = met.filter((F.get("both", F.lit(0)) == F.col("h1")) & (F.get("both", F.lit(1)) == F.col("h2")) & (F.size("both") >= shared))
    dot = F.aggregate(F.zip_with("hs", "ws", lambda h, x: F.when(F.array_contains("both", h), x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    met = met.select("cls", "cls2", (dot / (F.col("norm") * F.col("norm2"))).alias("sim"), F.size("both").cast("long").alias("shared"))
    met = materialize(met.filter(F.col("sim") >= least), "knn-pairs")
    ends = met.select("cls", F.col("cls2").alias("of"), "sim", "shared").unionByName(met.select(F.col("cls2").alias("cls"), F.col("cls").alias("of"), "sim", "shared"))
    n = F.size("tags").cast("long")
    own = v.filter(n >= shared).select("cls", F.lit(1.0).alias("sim"), n.alias("shared"), F.explode("ids").alias("other"))
    # the nearest k + 1 contents are among those of the k + 1 nearest classes, of equally near ones those with the least ids
    ends = ends.join(v.select(F.col("cls").alias("of"), F.get("ids", F.lit(0)).alias("first")), "of")
    nearer = Window.partitionBy("cls").orderBy(F.desc(F.round("sim", 9)), "first")
    ends = ends.withColumn("place", F.row_number().over(nearer)).filter(F.col("place") <= k + 1)
    near = ends.join(v.select(F.col("cls").alias("of"), "ids"), "of").select("cls", "sim", "shared", F.explode("ids").alias("other")).unionByName(own)
    order = Window.partitionBy("cls").orderBy(F.desc(F.round("sim", 9)), "other")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = near.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("place", "other", "sim", "shared"))).alias("near"))
    mine = vectors.select("asset_id", "cls").join(lists, "cls").select("asset_id", F.explode(F.slice(F.filter("near", lambda x: x["other"] != F.col("asset_id")), 1, k)).alias("x"))
    pairs = mine.select(F.least("asset_id", "x.other").alias("a"), F.greatest("asset_id", "x.other").alias("b"), "x.sim", "x.shared")
    weight = F.least(F.greatest(F.round(F.lit(255) * F.max("sim")), F.lit(1)), F.lit(255)).cast("long")
    return pairs.groupBy("a", "b").agg(F.max("shared").alias("shared"), weight.alias("weight"))


def related(asset_tag: DataFrame, content: str, *, top: int = 8) -> DataFrame:
    """The contents most like one, by IDF-weighted cosine over all its tags, with a shared tag named."""
    t, norm = _weighted(asset_tag)
    mine = t.filter(F.col("asset_id") == content).select("kind", "name")
    dot = t.filter(F.col("asset_id") != content).join(F.broadcast(mine), ["kind", "name"]).groupBy("asset_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.max_by("name", F.struct("idf", "name")).alias("through"))
    own = norm.filter(F.col("asset_id") == content).select(F.col("norm").alias("own"))
    out = dot.join(norm, "asset_id").crossJoin(F.broadcast(own)).withColumn("score", F.col("dot") / (F.col("norm") * F.col("own"))).filter("score > 0")
    return out.orderBy(F.desc(F.round("score", 9)), "asset_id").limit(top).select("asset_id", F.round("score", 4).alias("score"), "through")


def induced(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The edges whose both ends are among ``nodes`` (column node)."""
    return edges.join(nodes.select(F.col("node").alias(a)), a, "left_semi").join(nodes.select(F.col("node").alias(b)), b, "left_semi")


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def thinned(nodes: DataFrame, degree: DataFrame, most: int = 2000) -> DataFrame:
    """At most ``most`` nodes: connected ones by degree, orphans in proportion and in even strides by id."""
    d = nodes.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    total, lone = d.agg(F.count("*"), F.count_if(F.col("degree") == 0)).first()
    if total <= most:
        return d
    keep_lone = int(most * lone / total)
    keep = most - keep_lone
    top = d.filter("degree > 0").orderBy(F.desc("degree"), "node").limit(keep)
    if not keep_lone:
        return top
    # every step-th orphan in id order: ranks come from range partitions and their offsets, not from one task
    alone = materialize(d.filter("degree = 0").repartitionByRange("node").sortWithinPartitions("node").withColumn("_id", F.monotonically_increasing_id()), "orphans")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    offsets = alone.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("before"))
    ranked = alone.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + place)
    step = lambda r: F.floor(r * F.lit(keep_lone) / F.lit(lone))
    return top.unionByName(ranked.filter(step(F.col("rank")) != step(F.col("rank") - 1)).select(*top.columns))


def tag_matrix(asset_tag: DataFrame, nodes: DataFrame, most: int = 2000) -> DataFrame:
    """One row per node with its sorted tags and the running offset of a compressed sparse row layout.

    Offsets need one order over the nodes, so more than ``most`` nodes (``thinned`` keeps to that) are an error.
    """
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    t = asset_tag.join(nodes.select(F.col("node").alias("asset_id")), "asset_id", "left_semi").groupBy(F.col("asset_id").alias("node")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))).alias("tags"))
    w = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("offset", F.coalesce(F.sum(F.size("tags")).over(w), F.lit(0)))
