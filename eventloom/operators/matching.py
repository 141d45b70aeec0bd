"""Join shapes that theta predicates are turned into, and clustering of matched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def pieces(text: Column, sizes: Column) -> Column:
    """Distinct substrings of ``text`` for each length in the array ``sizes``."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                sizes,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)
                ),
            )
        )
    )


def _begins(text: Column) -> Column:
    """One of 512 marks of a text's first five characters."""
    return F.pmod(F.xxhash64(F.substring(text, 1, 5)), F.lit(512)).cast("int")


def contained_pairs(
    needles: DataFrame, hays: DataFrame, scope: list[str], needle: str, hay: str
) -> DataFrame:
    """Distinct (scope, needle, hay) where the needle is a substring of the hay.

    Each hay is taken apart into its substrings of the lengths that needles of the same scope
    have, so the join is an equality on the text itself: it has no blocking key that could run
    hot, loses nothing, and yields matching pairs only. Of the substrings only those go to the join
    that begin as a needle does; for that, beginnings are told apart by a few
    hundred marks, which bounds the row of a scope however many needles it has.
    """
    wanted = needles.where(F.length(needle) > 0).select(*scope, needle).distinct()
    sizes = wanted.groupBy(*scope).agg(
        F.collect_set(F.length(needle)).alias("_sizes"), F.collect_set(_begins(F.col(needle))).alias("_begins")
    )
    parts = (
        hays.select(*scope, hay)
        .distinct()
        .join(sizes, scope)
        .select(
            *scope,
            hay,
            F.explode(
                F.filter(
                    pieces(F.col(hay), F.filter("_sizes", lambda n: n <= F.length(hay))),
                    lambda p: F.array_contains("_begins", _begins(p)),
                )
            ).alias(needle),
        )
    )
    return parts.join(wanted, [*scope, needle]).select(*scope, needle, hay)


def with_ends(edges: DataFrame, nodes: DataFrame, src: dict[str, Column], dst: dict[str, Column]) -> DataFrame:
    """Edges with what the last node of their source and of their target says, under the names given.

    Edges whose ends have no node in their analysis are left out. Nodes and edges are stacked and placed by
    analysis, one payload, once: both lookups are windows inside it, and what is grouped or joined by
    analysis afterwards needs no exchange either. Two joins on local ids would move the edges twice. Only
    the rows of one local id are held together, and Spark keeps those on disk where they are many.
    """
    known = nodes.where("analysis_id is not null and local_id is not null")
    return nodes_and_edges(edges, known, src, dst).where("_edge").drop("_edge")


def nodes_and_edges(
    edges: DataFrame, nodes: DataFrame, src: dict[str, Column], dst: dict[str, Column], keep: tuple[str, ...] = ()
) -> DataFrame:
    """The edges of :func:`with_ends` (``_edge`` true) and every node (``_edge`` false) in one frame, so that work
    on both reads nodes once. A node's row says of itself what the columns in ``src`` say of a source, and has
    its analysis and its columns named in ``keep`` as a struct ``_node``; its other columns are null.
    """
    # what is said of both ends goes along once
    said = {id(value): value for value in (*src.values(), *dst.values())}
    place = {key: f"_said_{i}" for i, key in enumerate(said)}
    known = nodes.select(
        "analysis_id", F.col("local_id").alias("source_id"), F.lit(False).alias("_edge"),
        F.col("node_seq").alias("_place"), *[value.alias(place[key]) for key, value in said.items()],
        *([F.struct(*keep).alias("_node")] if keep else []),
    )
    linked = edges.where("analysis_id is not null and source_id is not null and target_id is not null")
    rows = known.unionByName(linked.withColumn("_edge", F.lit(True)), allowMissingColumns=True).repartition("analysis_id")
    node = F.when(~F.col("_edge"), F.struct(*place.values()))
    for end, local in (("_src", "source_id"), ("_dst", "_local")):
        # nodes come before edges: the latest node up to an edge is the last one of its local id
        window = W.partitionBy("analysis_id", local).orderBy("_edge", "_place").rowsBetween(W.unboundedPreceding, 0)
        latest = F.when(F.col("_edge"), F.last(node, ignorenulls=True).over(window))
        rows = rows.withColumn(end, latest).where(f"not _edge or {end} is not null")
        rows = rows.withColumn("_local", F.coalesce("target_id", "source_id"))

    def told(end: str, value: Column, own: Column) -> Column:
        return F.when(F.col("_edge"), F.col(f"{end}.{place[id(value)]}")).otherwise(own)

    return rows.select(
        "_edge", "analysis_id", *[F.when(F.col("_edge"), F.col(c)).alias(c) for c in edges.columns if c != "analysis_id"],
        *[told("_src", value, F.col(place[id(value)])).alias(name) for name, value in src.items()],
        *[told("_dst", value, F.lit(None)).alias(name) for name, value in dst.items()], *(["_node"] if keep else []),
    )


def containment_pairs(names: DataFrame, max_ratio: float = 1.5) -> DataFrame:
    """Pairs of names of one type where one contains the other and the lengths are close.

    ``names`` is (node_type, norm, ord), distinct. A contained name covers at least 1/ratio of
    the longer one, so the longer name gives only about len^2/18 substrings at ratio 1.5.
    """
    long = names.select(
        "node_type",
        F.col("ord").alias("long_ord"),
        F.explode(
            pieces(
                F.col("norm"),
                F.filter(
                    F.sequence(
                        F.greatest(F.lit(1), F.ceil(F.length("norm") / max_ratio).cast("int")),
                        F.greatest(F.lit(1), F.length("norm")),
                    ),
                    lambda n: (n < F.length("norm")) & (F.length("norm") / n <= max_ratio),
                ),
            )
        ).alias("norm"),
    )
    short = names.select("node_type", "norm", F.col("ord").alias("short_ord"))
    return long.join(short, ["node_type", "norm"]).select(
        "node_type",
        F.least("long_ord", "short_ord").alias("earlier"),
        F.greatest("long_ord", "short_ord").alias("later"),
    )


def first_fit(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Resolve names in insertion order: a name joins the earliest leader it matches, else leads.

    ``names`` is (ord, fixed): fixed names lead in any case. ``pairs`` is (earlier, later).
    Returns (ord, leader). Rounds settle every name whose earlier neighbours are settled, so the
    number of rounds is the longest chain of dependencies, not the number of names.
    """
    pairs = cut(pairs.select("earlier", "later").distinct())
    fixed = names.where("fixed").select("ord")
    leaders = cut(
        names.select("ord")
        .join(pairs.select(F.col("later").alias("ord")), "ord", "left_anti")
        .union(fixed)
        .distinct()
    )
    open_pairs = cut(pairs.join(fixed.withColumnRenamed("ord", "later"), "later", "left_anti"))
    while not open_pairs.isEmpty():
        covered = (
            open_pairs.join(leaders.withColumnRenamed("ord", "earlier"), "earlier", "left_semi")
            .select("later")
            .distinct()
        )
        rest = open_pairs.join(covered, "later", "left_anti")
        # a covered name leads nobody, so its pairs as the earlier side fall away
        live = rest.join(covered.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
        freed = rest.select(F.col("later").alias("ord")).distinct().join(
            live.select(F.col("later").alias("ord")), "ord", "left_anti"
        )
        leaders = cut(leaders.union(freed).distinct())
        open_pairs = cut(live)
    chosen = (
        pairs.join(leaders.withColumnRenamed("ord", "earlier"), "earlier", "left_semi")
        .join(leaders.withColumnRenamed("ord", "later"), "later", "left_anti")
        .groupBy(F.col("later").alias("ord"))
        .agg(F.min("earlier").alias("leader"))
    )
    return names.select("ord").join(chosen, "ord", "left").select(
        "ord", F.coalesce("leader", "ord").alias("leader")
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, component), the component being its smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014) over (a, b) edges; each
    step is a group-by and a join on one node, and never lists a node's neighbours.
    """
    links = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _fingerprint(links)
    while True:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        links = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(links.where("a <> b").distinct())
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        hung = links.join(low, "a")
        links = (
            hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(hung.select("a", "m"))
            .where("a <> b")
            .distinct()
        )
        links = cut(links)
        after = _fingerprint(links)
        if after == state:
            break
        state = after
    return nodes.select("id").join(
        links.withColumnRenamed("a", "id").withColumnRenamed("b", "component"), "id", "left"
    ).select("id", F.coalesce("component", "id").alias("component"))


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )
