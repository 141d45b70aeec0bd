"""Events of one document told by several analyses, and the graph around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import components, contained_pairs
from .ordered import with_next

TARGET_RELATIONS = ["targets", "affects", "restricts", "undermines", "opposes"]
NODE = ["document_id", "node_type", "name"]


def match_keys(mentions: DataFrame) -> DataFrame:
    """Keys under which two mentions of a document match if their dates agree.

    The score is 1 for a shared actor, 1 for an equal action, 0.5 for an equal location, and 1.5
    is enough. That is: any two of the three agree, so the three pairs of parts are equi-join
    keys and no pair of mentions has to be looked at. Two missing locations count as equal.
    """
    action = F.lower(F.coalesce("action", F.lit("")))
    location = F.coalesce("location", F.lit(""))
    actors = F.array_distinct(
        F.transform(F.array_compact(F.coalesce("actors", F.array().cast("array<string>"))), F.lower)
    )

    def key(kind, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("k1"), b.alias("k2"))

    with_action = F.when(action != "", action)
    keys = F.concat(
        F.transform(actors, lambda a: F.when(with_action.isNotNull(), key("actor+action", a, action))),
        F.transform(actors, lambda a: key("actor+location", a, location)),
        F.array(F.when(with_action.isNotNull(), key("action+location", action, location))),
    )
    return mentions.select(
        "document_id", "mention_seq", F.coalesce("date_raw", F.lit("")).alias("day"),
        F.inline(F.array_compact(keys)),
    )


_KEY = ["document_id", "kind", "k1", "k2"]


def first_matches(mentions: DataFrame) -> DataFrame:
    """(document_id, mention_seq, first_seq): the earliest mention each mention matches.

    Only the first mention of a (key, date) can be an answer, so the keys are reduced to those
    before anything is joined. A mention without a date agrees with every date.
    """
    keyed = match_keys(mentions)
    per_day = keyed.groupBy(*_KEY, "day").agg(F.min("mention_seq").alias("same_day"))
    per_key = per_day.groupBy(*_KEY).agg(
        F.min("same_day").alias("any_day"),
        F.min(F.when(F.col("day") == "", F.col("same_day"))).alias("undated"),
    )
    answer = per_day.join(per_key, _KEY).select(
        *_KEY, "day",
        F.when(F.col("day") == "", F.col("any_day"))
        .otherwise(F.least("same_day", "undated"))
        .alias("hit"),
    )
    best = keyed.join(answer, [*_KEY, "day"]).groupBy("document_id", "mention_seq").agg(
        F.min("hit").alias("hit")
    )
    return mentions.select("document_id", "mention_seq").join(
        best, ["document_id", "mention_seq"], "left"
    ).select("document_id", "mention_seq", F.coalesce("hit", "mention_seq").alias("first_seq"))


def clusters(mentions: DataFrame) -> DataFrame:
    """(mention_seq, cluster): connected components of matching mentions.

    Inside a (key, date) every mention is tied to the first one, and the first ones of all dates
    to the first undated mention of the key, if there is one: linear in the mentions, with the
    same components as all matching pairs.
    """
    keyed = match_keys(mentions)
    per_day = keyed.groupBy(*_KEY, "day").agg(F.min("mention_seq").alias("head"))
    undated = per_day.where("day = ''").select(*_KEY, F.col("head").alias("b"))
    to_head = keyed.join(per_day, [*_KEY, "day"]).select(
        F.col("mention_seq").alias("a"), F.col("head").alias("b")
    )
    to_undated = per_day.join(undated, _KEY).select(F.col("head").alias("a"), "b")
    found = components(mentions.select(F.col("mention_seq").alias("id")), to_head.union(to_undated))
    return found.select(F.col("id").alias("mention_seq"), F.col("component").alias("cluster"))


def merged_events(mentions: DataFrame, assigned: DataFrame) -> DataFrame:
    """One event per cluster: the first mention's fields, gaps filled by later mentions."""
    m = mentions.join(assigned, "mention_seq")
    first = lambda c: F.min_by(c, "mention_seq")

    def first_filled(c: str):
        return F.coalesce(
            F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("mention_seq"))), F.lit("")
        )

    return m.groupBy("document_id", "cluster").agg(
        first("name").alias("name"),
        first("date_raw").alias("date_raw"),
        first("action").alias("action"),
        first_filled("location").alias("location"),
        first_filled("description").alias("description"),
        F.count(F.lit(1)).alias("source_count"),
    )


def merged_actors(mentions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Distinct actors per event, one row each."""
    return mentions.join(assigned, "mention_seq").select(
        "document_id", "cluster", F.explode("actors").alias("actor")
    ).distinct()


def node_id(document_id, node_type, name):
    """Id of a document-graph node: its key, hashed."""
    return F.substring(F.sha2(F.to_json(F.struct(
        document_id.alias("d"), node_type.alias("t"), name.alias("n"))), 256), 1, 16)


def get_or_add_nodes(rows: DataFrame) -> DataFrame:
    """One node per (document, type, name)."""
    return rows.select(*NODE).distinct().withColumn("node_id", node_id(*[F.col(c) for c in NODE]))


def actor_links(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Actor performs every event of its document whose name holds the actor's name."""
    actors = nodes.where("node_type = 'actor'").select("document_id", F.col("name").alias("actor"))
    named = events.select("document_id", F.col("name").alias("event"))
    return contained_pairs(actors, named, ["document_id"], "actor", "event").select(
        "document_id", F.lit("actor").alias("src_type"), F.col("actor").alias("src_name"),
        F.lit("performs").alias("relation"), F.lit("event").alias("dst_type"),
        F.col("event").alias("dst_name"),
    )


def narrative_links(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Narrative justifies an event if it holds one of the first three words of its name."""
    narratives = nodes.where("node_type = 'narrative'").select(
        "document_id", F.col("name").alias("narrative"), F.lower("name").alias("hay")
    ).distinct()
    split = F.filter(F.split(F.lower("event"), r"(?U)\s+"), lambda w: w != "")
    named = events.select("document_id", F.col("name").alias("event")).distinct()
    words = named.withColumn("words", F.array_distinct(F.slice(split, 1, 3))).select(
        "document_id", "event", "words", F.posexplode("words").alias("pos", "word")
    )
    # an event meets a narrative by the first of its words that the narrative holds, so links come once, and
    # narratives are joined before the events: the links, far more than both, go through no shuffle
    told = contained_pairs(words, narratives, ["document_id"], "word", "hay").join(narratives, ["document_id", "hay"])
    earlier = F.exists(F.slice("words", F.lit(1), F.col("pos")), lambda w: F.contains(F.col("hay"), w))
    return told.join(words, ["document_id", "word"]).where(~earlier).select(
        "document_id", F.lit("narrative").alias("src_type"), F.col("narrative").alias("src_name"),
        F.lit("justifies").alias("relation"), F.lit("event").alias("dst_type"),
        F.col("event").alias("dst_name"),
    )


def target_links(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Acting edges that start at an event; ``edges`` has names and types of both ends."""
    known = events.select("document_id", F.col("name").alias("src_name")).distinct()
    return (
        edges.where(F.col("relation").isin(TARGET_RELATIONS))
        .join(known, ["document_id", "src_name"])
        .select(
            "document_id", F.lit("event").alias("src_type"), "src_name", "relation",
            F.coalesce("dst_type", F.lit("target")).alias("dst_type"),
            F.coalesce("dst_name", F.lit("Unknown Target")).alias("dst_name"),
        )
        .distinct()
    )


def actor_sequences(performed: DataFrame) -> DataFrame:
    """Consecutive events of one actor: (keys, src_event, dst_event), relation ``precedes``.

    ``performed`` is (document_id, actor, event, timestamp, seq).
    """
    following = with_next(performed, ["document_id", "actor"], ["timestamp", "seq"], ["event"])
    return following.where("next is not null").select(
        "document_id", "actor", F.col("event").alias("src_event"),
        F.lit("precedes").alias("relation"), F.col("next.event").alias("dst_event"),
    )
