"""Event mentions, signatures, weights and the two-stage event aggregation.

Lists that grow with a group (sources of a node, members of an event) are returned as frames of
their own, one row per member, never as arrays collected into a group's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.maps import last_value, merge_maps, merged_entries
from ..session import cut
from .matching import nodes_and_edges, with_ends
from .ordered import with_nearest

RECENT_EVENTS = 100
SIGNATURE_PARTS = ["sig_actor", "sig_action", "sig_date", "sig_location"]


# ---- mentions ----------------------------------------------------------------------------


def explode_nodes(analyses: DataFrame) -> DataFrame:
    """Payload nodes, one row each, keyed by analysis and local id."""
    return analyses.select(
        "analysis_id",
        document_of(analyses).alias("document_id"),
        F.posexplode("kg_payload.nodes").alias("node_pos", "n"),
        *(["analysis_seq"] if "analysis_seq" in analyses.columns else []),
    ).select(
        "analysis_id", "document_id", "node_pos", F.col("n.id").alias("local_id"), "n.node_type",
        "n.name", "n.confidence", "n.timestamp", "n.source_sentence", "n.attributes", "n.citations",
        *(["analysis_seq"] if "analysis_seq" in analyses.columns else []),
    )


def explode_edges(analyses: DataFrame) -> DataFrame:
    return analyses.select(
        "analysis_id",
        document_of(analyses).alias("document_id"),
        F.posexplode("kg_payload.edges").alias("edge_pos", "e"),
        *(["analysis_seq"] if "analysis_seq" in analyses.columns else []),
    ).select(
        "analysis_id", "document_id", "edge_pos", "e.source_id", "e.relation", "e.target_id",
        "e.confidence", "e.timestamp", "e.evidence_quote", "e.attributes", "e.citations",
        *(["analysis_seq"] if "analysis_seq" in analyses.columns else []),
    )


def document_of(analyses: DataFrame) -> Column:
    """Document id in either analysis layout."""
    inner = F.col("article.document_id")
    return F.coalesce(inner, F.col("document_id")) if "document_id" in analyses.columns else inner


def extract_mentions(analyses: DataFrame, titles: bool = False, normalize: bool = False) -> DataFrame:
    """Facts events, graph event nodes and, with ``titles``, headline events of each analysis.

    ``analyses`` carries ``analysis_seq``, its place in the input. With ``normalize`` dates are
    brought to ISO and a missing date is '' everywhere; otherwise a graph node without a date
    has "N/A".
    """
    common = ["analysis_seq", "analysis_id", document_of(analyses).alias("document_id")]

    def shaped(df: DataFrame, origin: int, pos: Column, local: Column, name, date, actors, action, location, description):
        return df.select(
            "analysis_seq", "analysis_id", "document_id",
            F.lit(origin).alias("origin"), pos.cast("int").alias("pos"), local.alias("local_id"),
            F.coalesce(name, F.lit("")).alias("name"), date.alias("date_raw"),
            F.array_compact(F.coalesce(actors, F.array().cast("array<string>"))).alias("actors"),
            T.event_action(action, name).alias("action"),
            F.coalesce(location, F.lit("")).alias("location"),
            F.coalesce(description, F.lit("")).alias("description"),
        )

    none = F.lit(None).cast("string")
    facts = analyses.select(*common, F.posexplode("facts_data.events").alias("p", "f"))
    fact_date = D.normalize_date(F.col("f.date")) if normalize else F.coalesce("f.date", F.lit(""))
    out = shaped(
        facts, 0, F.col("p"), none, F.col("f.name"), fact_date, F.col("f.actors"),
        F.col("f.action"), F.col("f.location"), F.col("f.description"),
    )
    nodes = analyses.select(*common, F.posexplode("kg_payload.nodes").alias("p", "n")).where(
        F.col("n.node_type") == "event"
    )
    attr = lambda key: F.try_element_at(F.col("n.attributes"), F.lit(key))
    if normalize:
        node_date = D.normalize_date(F.col("n.timestamp"))
        description = F.col("n.source_sentence")
    else:
        node_date = F.coalesce("n.timestamp", F.lit("N/A"))
        description = attr("description")
    out = out.unionByName(
        shaped(
            nodes, 1, F.col("p"), F.col("n.id"), F.col("n.name"), node_date, F.array(attr("actor")),
            F.col("n.name"), attr("location"), description,
        )
    )
    if titles:
        title = F.coalesce(F.col("article.title"), F.lit(""))
        heads = analyses.where(F.contains(title, F.lit("signs"))).select(
            *common, title.alias("title"), F.coalesce("article.published", F.lit("")).alias("day")
        )
        out = out.unionByName(
            shaped(
                heads, 2, F.lit(0), none, F.col("title"), F.col("day"),
                F.array(T.title_actor(F.col("title"))), F.lit("signs"), none, F.col("title"),
            )
        )
    return out


def with_signature(mentions: DataFrame) -> DataFrame:
    """Add the four normalised parts and the signature. Needs actor, action, date_raw, location."""
    return mentions.withColumns(
        {
            "sig_actor": T.normalize_actor(F.col("actor")),
            "sig_action": T.normalize_action(F.col("action")),
            "sig_date": D.normalize_date(F.col("date_raw")),
            "sig_location": T.normalize_location(F.col("location")),
        }
    ).withColumn("signature", T.event_signature(*[F.col(c) for c in SIGNATURE_PARTS]))


# ---- signature matching and weights ------------------------------------------------------


def recent_events(events: DataFrame, limit: int | None = RECENT_EVENTS) -> DataFrame:
    """List the most recently updated events; matching always looks at all."""
    if limit is None:
        return events
    return events.orderBy(F.desc("last_updated"), "event_id").limit(limit)


def signature_matches(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New events whose four parts are non-empty and equal an existing event's; first hit wins.

    Of several existing events with one signature the most recently updated counts, settled
    before the join.
    """
    known = existing.groupBy(*SIGNATURE_PARTS).agg(
        F.max_by("event_id", "last_updated").alias("matched_event_id")
    )
    full = new
    for part in SIGNATURE_PARTS:
        full = full.where(F.col(part) != "")
    return full.join(known, SIGNATURE_PARTS)


def _sides(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct signatures of both sides: parts, new_id (null: not new), event_id (null: not known)."""
    parts = list(SIGNATURE_PARTS)
    sides = new.select(*parts, "new_id", F.lit(None).cast("string").alias("event_id")).unionByName(
        existing.select(*parts, F.lit(None).cast(dict(new.dtypes)["new_id"]).alias("new_id"), F.col("event_id").cast("string"))
    )
    return sides.groupBy(*parts).agg(F.min("new_id").alias("new_id"), F.min("event_id").alias("event_id"))


def signature_groups(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Members of every group of signatures that share three non-empty parts, one row each.

    Columns: differs_in, the four parts with a null for the odd one (the group's key), odd_part,
    new_id (null: not new) and event_id (null: not known). At most four rows for a signature, so the
    frame is linear; all candidates of a new signature are the known members of its groups whose
    odd part is another one or empty.
    """
    known = cut(_sides(new, existing))
    out = None
    for odd in SIGNATURE_PARTS:
        rows = known
        for p in SIGNATURE_PARTS:
            rows = rows if p == odd else rows.where(F.col(p) != "")
        members = rows.select(
            F.lit(odd).alias("differs_in"),
            *[F.lit(None).cast("string").alias(p) if p == odd else F.col(p) for p in SIGNATURE_PARTS],
            F.col(odd).alias("odd_part"), "new_id", "event_id",
        )
        out = members if out is None else out.unionByName(members)
    return out


def signature_candidates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Nearest signatures that agree in exactly three non-empty parts, for review.

    ``new`` is (new_id, parts), ``existing`` (event_id, parts). Both sides are reduced to distinct
    signatures. Those that share three parts are put in the order of the fourth, and each new one is
    paired with the nearest known one before and after it, however many other new ones lie between.
    Every new signature of a group with another known one has a candidate; all members of the groups,
    linear in the signatures where all pairs would be quadratic, are :func:`signature_groups`.
    """
    parts = list(SIGNATURE_PARTS)
    known = cut(_sides(new, existing))
    out = None
    for odd in parts:
        same = [p for p in parts if p != odd]
        rows = known
        for p in same:
            rows = rows.where(F.col(p) != "")
        near = with_nearest(rows, same, [odd], ["event_id"], F.col("event_id").isNotNull(), filled=True)
        empty = F.when(F.col(odd) == "", F.col("event_id"))  # two empty parts do not agree
        pairs = near.where("new_id is not null").select(
            "new_id", F.explode(F.array("before.event_id", "after.event_id", empty)).alias("event_id"),
            F.lit(odd).alias("differs_in"), F.lit(0.75).alias("similarity"),
        ).where("event_id is not null")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def observation_partials(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Additive counts per (key, bias, source, date) of (source_name, source_bias, date_raw) rows.

    Partials of several batches can simply be stacked: :func:`weights_from_partials` adds them up.
    """
    bias = F.nullif(F.col("source_bias"), F.lit(""))
    return observations.groupBy(*keys, bias.alias("bias"), "source_name", "date_raw").agg(
        F.count(F.lit(1)).alias("n")
    )


def event_weights(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Weight, diversity and confidence per event from (source_name, source_bias, date_raw).

    Rows shrink to counts before the distinct counts are taken; every step is a hash aggregate
    that combines before its shuffle, so an event with most of the observations is no hot task.
    """
    return weights_from_partials(observation_partials(observations, keys), keys)


def weights_from_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    grouped = partials.groupBy(*keys).agg(
        F.sum("n").alias("source_count"),
        F.count_distinct("bias").alias("biases"),
        F.count_distinct("source_name").alias("named"),
        F.count_distinct("date_raw").alias("dates"),
        F.max(F.col("source_name").isNull().cast("int")).alias("unnamed"),
        F.max(F.col("date_raw").isNull().cast("int")).alias("undated"),
    )
    return weights_from_counts(grouped, keys)


def weights_from_counts(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Weight fields from source_count, biases, named, dates, unnamed and undated of each key."""
    # a missing date counts as one more value
    consistent = F.col("dates") + F.col("undated") <= 1
    diversity = F.col("biases") / F.col("source_count")
    consistency = F.when(consistent, 1.0).otherwise(0.5)
    return grouped.select(
        *keys,
        "source_count",
        (F.col("source_count") * diversity * consistency).alias("weight"),
        diversity.alias("source_diversity"),
        consistency.alias("temporal_consistency"),
        ((diversity + consistency + 1.0) / 3).alias("confidence_score"),
        (F.col("named") + F.col("unnamed")).alias("unique_sources"),
    )


def no_observation_weight() -> dict[str, float]:
    """Weight fields of an event without observations."""
    return {
        "source_count": 0, "weight": 0.0, "source_diversity": 0.0, "temporal_consistency": 1.0,
        "confidence_score": 2.0 / 3, "unique_sources": 0,
    }


def attach_observations(observations: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every observation (observation_id, parts, signature) its event.

    Observations with all parts filled share an event per signature, an existing one first;
    one with an empty part never matches and founds an event of its own.
    """
    known = existing.groupBy("signature").agg(F.max_by("event_id", "last_updated").alias("_known"))
    whole = F.lit(True)
    for part in SIGNATURE_PARTS:
        whole = whole & (F.col(part) != "")
    joined = observations.join(known, "signature", "left")
    own = F.sha2(F.concat_ws("|", "signature", F.col("observation_id").cast("string")), 256)
    return joined.select(
        *observations.columns,
        F.when(whole, F.coalesce("_known", F.sha2("signature", 256))).otherwise(own).alias("event_id"),
        (~whole | F.col("_known").isNull()).alias("is_new"),
    )


def new_event_rows(attached: DataFrame, now: Column | None = None) -> DataFrame:
    """Event rows to insert for new events: weight 1, both times now."""
    stamp = F.current_timestamp() if now is None else now
    return (
        attached.where("is_new")
        .groupBy("event_id")
        .agg(F.min("signature").alias("event_signature"), F.min("action").alias("event_type"))
        .select(
            "event_id", "event_signature", "event_type", stamp.alias("first_seen"),
            stamp.alias("last_updated"), F.lit(1.0).alias("weight"), F.lit("active").alias("status"),
        )
    )


def heavy_events(weighted: DataFrame, minimum: float = 2.0, limit: int | None = None) -> DataFrame:
    """Events of at least the given weight, heaviest first."""
    keys = [c for c in ("event_id", "signature", "sig_action", "sig_location") if c in weighted.columns]
    out = weighted.where(F.col("weight") >= minimum).orderBy(F.desc("weight"), *keys)
    return out if limit is None else out.limit(limit)


def with_observation_counts(events: DataFrame, observations: DataFrame) -> DataFrame:
    counts = observations.groupBy("event_id").agg(F.count(F.lit(1)).alias("observation_count"))
    return events.join(counts, "event_id", "left").withColumn(
        "observation_count", F.coalesce("observation_count", F.lit(0))
    )


def event_detail(events: DataFrame, observations: DataFrame, event_id: str) -> DataFrame:
    """One event with its observations, newest first, JSON text decoded."""
    of = F.col("event_id") == event_id
    obs = observations.where(of).withColumn(
        "extracted_data", F.from_json("extracted_data", "map<string,string>")
    )
    return events.where(of).join(obs, "event_id").orderBy(F.desc("observed_at"), "observation_id")


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id).withColumn(
        "core_attributes", F.from_json("core_attributes", "map<string,string>")
    )


def timeline(events: DataFrame) -> DataFrame:
    """Events by date, undated first."""
    return events.orderBy(F.coalesce("date_raw", F.lit("")), "event_id")


# ---- two-stage aggregation ---------------------------------------------------------------


def event_groups(mentions: DataFrame, dedupe_mentions: bool = False) -> DataFrame:
    """(event_key, analysis_id, document_id, n_mentions): how often an analysis enters a group.

    Each mention counts, so an event told in facts and graph enters twice unless deduplicated.
    """
    n = F.lit(1).cast("bigint") if dedupe_mentions else F.count(F.lit(1))
    return (
        mentions.groupBy(
            T.event_key(F.col("name"), F.col("date_raw")).alias("event_key"), "analysis_id", "document_id"
        )
        .agg(F.count(F.lit(1)).alias("_n"), F.min("mention_seq").alias("first_seq"))
        .withColumn("n_mentions", F.lit(1).cast("bigint") if dedupe_mentions else F.col("_n"))
        .drop("_n")
    )


def group_members(groups: DataFrame) -> DataFrame:
    """Per event: contributing analyses (repeats counted) and distinct documents."""
    return groups.groupBy("event_key").agg(
        F.sum("n_mentions").alias("contributing_analyses"),
        F.count_distinct("document_id").alias("documents"),
    )


def event_node_sources(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weight that each node of each analysis gives to an event: the members of its source lists.

    Mentions are one count per (event, analysis) before they meet the nodes.
    """
    return groups.select("event_key", "analysis_id", "n_mentions").join(nodes, "analysis_id").select(
        "event_key", "node_type", F.lower("name").alias("lname"), "analysis_id",
        (F.coalesce("confidence", F.lit(1.0)) * F.col("n_mentions")).alias("weight"),
        F.col("n_mentions").alias("appearances"),
        "node_seq",
    )


def event_nodes(sources: DataFrame) -> DataFrame:
    """Stage one: consolidated nodes per event."""
    return sources.groupBy("event_key", "node_type", "lname").agg(
        F.sum("weight").alias("weight"),
        F.sum("appearances").alias("source_entries"),
        F.min("node_seq").alias("node_seq"),
    )


NODE_KEY = ["event_key", "node_type", "lname"]


def event_node_attributes(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attributes of an event's node, the last node in order winning per attribute."""
    return merge_maps(_told_nodes(groups, nodes), NODE_KEY, "attributes", F.col("node_seq"), True)


def event_node_attribute_rows(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries of :func:`event_node_attributes`, a row each: no map is built to be taken apart."""
    return merged_entries(_told_nodes(groups, nodes), NODE_KEY, "attributes", F.col("node_seq"), True, "attribute", "value")


def event_node_attribute(groups: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """One attribute of :func:`event_node_attributes`, null for nodes that have others only."""
    return last_value(_told_nodes(groups, nodes), NODE_KEY, "attributes", name, F.col("node_seq"))


def _told_nodes(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    return groups.select("event_key", "analysis_id").join(nodes.withColumn("lname", F.lower("name")), "analysis_id")


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace local endpoint ids by entity keys; unresolved edges are dropped.

    Of several nodes with one local id the last one counts.
    """
    return with_ends(edges, nodes, *_entity_ends())


def _entity_ends() -> tuple[dict[str, Column], dict[str, Column]]:
    kind, lname = F.col("node_type"), F.lower("name")
    return {"src_type": kind, "src_name": lname}, {"dst_type": kind, "dst_name": lname}


EDGE_KEY = ["src_type", "src_name", "relation", "dst_type", "dst_name"]


def event_edge_sources(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    return groups.select("event_key", "analysis_id", "n_mentions").join(resolved, "analysis_id").select(
        "event_key", *EDGE_KEY, "analysis_id",
        (F.coalesce("confidence", F.lit(1.0)) * F.col("n_mentions")).alias("weight"),
        F.col("n_mentions").alias("appearances"),
    )


def event_edges(sources: DataFrame) -> DataFrame:
    return sources.groupBy("event_key", *EDGE_KEY).agg(
        F.sum("weight").alias("weight"), F.sum("appearances").alias("source_entries")
    )


def unified_nodes(nodes: DataFrame) -> DataFrame:
    """Stage two: nodes across events. The linkages are the stage-one rows themselves."""
    return nodes.groupBy("node_type", "lname").agg(
        F.sum("weight").alias("total_weight"),
        F.count(F.lit(1)).alias("event_appearances"),
        F.min("node_seq").alias("node_seq"),
    )


def node_names(nodes: DataFrame) -> DataFrame:
    """Spelling and date of the first node of each entity. Spellings are few per entity, dates may be as
    many as nodes: folded by spelling before the pick."""
    spelled = nodes.groupBy("node_type", "name").agg(
        F.min("node_seq").alias("node_seq"), F.min_by("timestamp", "node_seq").alias("timestamp")
    )
    return spelled.groupBy("node_type", F.lower("name").alias("lname")).agg(
        F.min_by("name", "node_seq").alias("name"),
        F.coalesce(F.min_by("timestamp", "node_seq"), F.lit("N/A")).alias("timestamp"),
    )


def unified_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*EDGE_KEY).agg(
        F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("event_appearances")
    )


def batch_unified_edges(sources: DataFrame) -> DataFrame:
    """:func:`unified_edges` of a batch of which the edges per event are not wanted: its sources are sent once, by
    edge, and folded there by event and then over events. The rows of one edge meet in one task, which holds
    a row for each of its events at most and spills them where they are many."""
    placed = sources.select(*EDGE_KEY, "event_key", "weight", "appearances").repartition(*EDGE_KEY)
    return unified_edges(event_edges(placed))


def unified_stats(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: nodes, edges, events, and the sum over events of their distinct documents."""
    counts = nodes.select(F.lit(False).alias("_edge")).unionByName(edges.select(F.lit(True).alias("_edge")))
    return _stats(counts.groupBy("_edge").agg(F.count(F.lit(1)).alias("n")), members)


def batch_stats(groups: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """:func:`unified_stats` of a batch of which nothing else is wanted: nodes and edges are read once, placed by
    analysis once, and of those whose analysis tells of an event only the entity keys go on."""
    edges = edges.select("analysis_id", "source_id", "relation", "target_id")
    rows = nodes_and_edges(edges, nodes, *_entity_ends()).join(groups.select("analysis_id"), "analysis_id", "left_semi")
    entities = rows.select("_edge", *EDGE_KEY).distinct()
    return _stats(entities.groupBy("_edge").agg(F.count(F.lit(1)).alias("n")), group_members(groups))


def _stats(counts: DataFrame, members: DataFrame) -> DataFrame:
    """The row of :func:`unified_stats` from (_edge, n) and the events' members."""
    none = F.lit(None).cast("bigint")
    events = members.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
    both = counts.select("_edge", "n", none.alias("events"), none.alias("documents")).unionByName(
        events.withColumns({"_edge": F.lit(None).cast("boolean"), "n": none})
    )
    found = lambda edge: F.coalesce(F.max(F.when(F.col("_edge") == edge, F.col("n"))), F.lit(0))
    return both.agg(
        found(False).alias("total_nodes"), found(True).alias("total_edges"),
        F.max("events").alias("events_processed"), F.max("documents").alias("total_documents"),
    )


# ---- pair scoring ------------------------------------------------------------------------


def score_pairs(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Weighted similarity of event pairs (name1, name2, description1, ... location2).

    The cheap parts are settled first; only pairs whose length bound can still reach the
    threshold are sent to the text comparison, the others cannot match. ``date_score`` and
    ``location_score`` are taken from the pairs where they have them.
    """
    from ..functions.fuzzy import fuzzy_ratio, ratio_bound

    low = pairs
    for c in ("name", "description"):
        for i in (1, 2):
            low = low.withColumn(f"_{c}{i}", F.lower(F.coalesce(F.col(f"{c}{i}"), F.lit(""))))
    cheap = {
        "date_score": lambda: D.temporal_score(F.col("date1"), F.col("date2")),
        "location_score": lambda: T.location_score(F.col("location1"), F.col("location2")),
    }
    low = low.withColumns({c: score() for c, score in cheap.items() if c not in pairs.columns})

    def total(name, description):
        # summed left to right: the order decides ties at the threshold
        return (
            0.6 * name + 0.2 * description + 0.1 * F.col("date_score") + 0.1 * F.col("location_score")
        )

    bound = total(
        ratio_bound(F.col("_name1"), F.col("_name2")),
        ratio_bound(F.col("_description1"), F.col("_description2")),
    )
    possible = low.where(bound >= threshold - 1e-9)
    scored = possible.withColumns(
        {
            "name_score": fuzzy_ratio(F.col("_name1"), F.col("_name2")),
            "description_score": fuzzy_ratio(F.col("_description1"), F.col("_description2")),
        }
    )
    return (
        scored.withColumn("score", total(F.col("name_score"), F.col("description_score")))
        .where(F.col("score") >= threshold)
        .select(*pairs.columns, "name_score", "description_score", "score")
    )
