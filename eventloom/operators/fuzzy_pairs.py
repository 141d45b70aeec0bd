"""Event pairs of a fuzzy score over a whole table.

The score is 0.6 name + 0.2 description + 0.1 date + 0.1 location. A pair that reaches the threshold
needs a name ratio of at least what the other parts leave open, 2/3 for the threshold 0.8. Pairs of
distinct names that can reach it (``close_names``) are found tile by tile: names are dealt into blocks, each pair of
blocks is a group of its own, and in it two bounds that lose nothing leave hardly more than the pairs sought
(``functions.fuzzy.alike``). Names of one language have most characters in common, so joins on shared characters
(``near_pairs``) leave a third of all pairs, each met many times; they are not used for pairs any more.

Events are then paired by equal and by close names. The members of a name are dealt in parts, so no task holds
all pairs of one name. Date, location and the lengths are settled before texts are compared (``score_pairs``).

``fuzzy_event_pairs`` pairs classes of events equal in name, description, date and location (``event_classes``), or
with ``events`` every two events that reach the threshold, also those of one class and those equal in name and
description.

Scale: a tile's memory is bounded by ``BLOCK`` names. The number of tiles grows with the square of the distinct names,
as no bound that loses nothing tells apart names whose ratio need only be 2/3, and the pairs of a name with the square
of its events, as does the result.

Defined results: missing and empty names match nothing; missing or empty descriptions, dates and
locations add nothing; unreadable dates add nothing. Empty tables give no pairs. Events without an event_id, and rows
of one event_id, are no pair; a row that comes twice counts once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.fuzzy import alike
from ..functions.lists import bind
from ..functions.text import blank, location_parts, parts_score, strip
from ..session import cut
from .events import score_pairs

FIELDS = ("name", "description", "date", "location")
NAME, DESCRIPTION, DATE, LOCATION = 0.6, 0.2, 0.1, 0.1
DAYS = 3  # a gap of two whole days reaches over at most three borders of days
EASE = 1e-9
BLOCK, LEAST, FEW = 4096, 128, 8  # names in a block at most; in each of few blocks at least
DEALT = 1000  # events of one name in a part
SLOTS = 256  # of places and days: names whose events share none are far


def event_classes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (class_id and the four fields) and members (event_id, class_id) of events that agree in
    all of them; the smallest event_id names the class. A null is a value like others."""
    rows = events.select("event_id", *FIELDS)
    classes = cut(rows.groupBy(*FIELDS).agg(F.min("event_id").alias("class_id")))
    same = F.lit(True)
    for f in FIELDS:
        same = same & rows[f].eqNullSafe(classes[f])
    return classes, rows.join(classes, same).select("event_id", "class_id")


def letters(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("(?s)(.)"), 1)


def tokens(name: Column) -> Column:
    """The characters of a name, each with how often it occurred before."""
    # bound once: a lambda evaluates what it uses anew for each element
    numbered = bind(F.array_sort(letters(name)), lambda held: F.transform(
        held, lambda c, i: F.concat(c, (i + 1 - F.array_position(held, c)).cast("string"))
    ))
    return F.when(name != "", numbered)


def ordered_names(classes: DataFrame) -> DataFrame:
    """Distinct names in lower case with ``order``: their tokens, the rarest in the table first."""
    names = cut(classes.select(F.lower("name").alias("lname")).where("lname <> ''").distinct())
    spread = names.select("lname", F.explode(tokens(F.col("lname"))).alias("token"))
    rarity = spread.groupBy("token").agg(F.count("*").alias("n")).withColumnRenamed("token", "counted")
    return cut(
        spread.join(rarity, F.col("token") == F.col("counted"))
        .groupBy("lname").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("order"))
    )


def prefixes(names: DataFrame, ratio: float) -> DataFrame:
    """lname, length, token and place for the tokens of which two names of at least ``ratio`` share one."""
    shared = ratio / (2 - ratio)  # of a name's tokens, with the shortest name that can reach the ratio
    length = F.size("order")
    keep = length - F.ceil(length * shared - EASE).cast("int") + 1
    return names.select("lname", length.alias("length"), F.posexplode(F.slice("order", F.lit(1), keep)).alias("place", "at")).select(
        "lname", "length", "place", "at.token"
    )


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frame twice, with _a and _b behind the names of its columns."""
    return tuple(rows.select([F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")


def _can_reach(ratio: float) -> Column:
    """Equal tokens that pass the length and positional filters."""
    both = F.col("length_a") + F.col("length_b")
    most = F.least(F.col("length_a") - F.col("place_a"), F.col("length_b") - F.col("place_b"))
    close = (2 * F.least("length_a", "length_b") >= ratio * both - EASE) & (2 * most >= ratio * both - EASE)
    return (F.col("token_a") == F.col("token_b")) & close


def _share_enough(ratio: float) -> Column:
    """Names with as many characters in common as the ratio asks for, counted in full.

    Per distinct character the smaller of both counts, which is the number of common tokens: making the
    tokens of both names anew for each pair took most of the time.
    """
    a, b = F.col("lname_a"), F.col("lname_b")
    count = lambda name, c: F.length(name) - F.length(F.replace(name, c))
    common = F.aggregate(
        F.array_distinct(letters(a)), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c))
    )
    return 2 * common >= ratio * (F.col("length_a") + F.col("length_b")) - EASE


def _sharing(found: DataFrame, pair: list[str], ratio: float) -> DataFrame:
    """Distinct pairs of a token join whose names share enough characters.

    The lengths follow from the names; as aggregates they keep the count behind the shuffle, spread and once
    for each pair. Of plain distinct rows it would be moved into the join, once for each common token.
    """
    once = found.groupBy(*pair).agg(F.max("length_a").alias("length_a"), F.max("length_b").alias("length_b"))
    return once.where(_share_enough(ratio))


def near_pairs(classes: DataFrame, names: DataFrame, ratio: float) -> DataFrame:
    """Class pairs whose dates and locations may both add to the score, and whose names may reach ``ratio``."""
    part = F.lower(strip(F.element_at(F.split("location", ","), -1)))
    day = F.floor(F.unix_seconds(D.event_date(F.col("date"))) / 86400)
    placed = classes.select("class_id", F.lower("name").alias("named"), part.alias("part"), day.alias("day"))
    rows = prefixes(names, ratio).join(placed, F.col("lname") == F.col("named")).where("part is not null and day is not null").drop("named")
    a, b = _sides(cut(rows))
    b = b.withColumn("day_b", F.explode(F.sequence(F.col("day_b") - DAYS, F.col("day_b") + DAYS)))
    on = (F.col("part_a") == F.col("part_b")) & (F.col("day_a") == F.col("day_b")) & (F.col("class_id_a") < F.col("class_id_b"))
    both = ["class_id_a", "class_id_b", "lname_a", "lname_b"]
    pairs = _sharing(a.join(b, on & _can_reach(ratio)), both, ratio)
    return pairs.select(F.col("class_id_a").alias("id1"), F.col("class_id_b").alias("id2"))


def _slots(rows: pd.Series) -> np.ndarray:
    out = np.zeros((len(rows), SLOTS), np.float32)
    for i, slots in enumerate(rows):
        out[i, slots] = 1
    return out


def _tile(rows: pd.DataFrame, near: float, far: float) -> pd.DataFrame:
    asks, holds = rows[rows["asks"]], rows[rows["holds"]]
    asked, held = asks["lname"].tolist(), holds["lname"].tolist()
    around, slots = _slots(asks["around"]), _slots(holds["slots"]).T.copy()
    ratio = lambda some, places: np.where(around[some] @ slots[:, places] > 0, near, far)
    same = bool((rows["block"] == rows["other"]).all())
    found = [(asked[i], held[j]) for i, places in alike(asked, held, ratio) for j in places]
    # within a block each pair is met from both sides, and a name meets itself
    return pd.DataFrame([p for p in found if not same or p[0] < p[1]], columns=["lname", "other"])


def close_names(names: DataFrame, near: float, far: float) -> DataFrame:
    """Pairs of distinct names (lname, other), in both orders, among which are all whose ratio reaches ``near``, or
    ``far`` where no events of theirs are close in time and place.

    ``names`` is (lname, slots, around), see :func:`_named`. Every two names meet in one tile.
    """
    count = names.count()
    blocks = max(1, -(-count // BLOCK), min(FEW, count // LEAST))
    dealt = names.withColumn("own", F.pmod(F.xxhash64("lname"), F.lit(blocks)))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "lname", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"),
        (F.col("own") >= F.col("with")).alias("asks"), (F.col("own") <= F.col("with")).alias("holds"), "slots", "around",
    )
    # the adaptive planner would merge tiles by their bytes, which tell nothing of the pairs
    met = met.repartition(min(blocks * (blocks + 1) // 2, 4 * _partitions(names)), "block", "other")
    tile = lambda rows: _tile(rows, near, far)
    close = cut(met.groupBy("block", "other").applyInPandas(tile, "lname string, other string"))
    return close.union(close.select("other", "lname"))


def _named(told: DataFrame) -> DataFrame:
    """Distinct names with the number of ``parts`` their events are dealt into, the ``slots`` of their events' places
    and days, and those ``around`` them; events that may add by date and location have a slot in common."""
    slot = lambda day: F.pmod(F.xxhash64(F.element_at("places", -1), day), F.lit(SLOTS)).cast("int")
    day = F.floor(F.col("at") / 86400)
    placed = told.select("lname", "places", day.alias("day")).select(
        "lname", F.when(F.col("places").isNotNull() & F.col("day").isNotNull(), slot(F.col("day"))).alias("slot"),
        F.posexplode_outer(F.when(F.col("places").isNotNull(), F.transform(F.sequence(F.col("day") - DAYS, F.col("day") + DAYS), slot))),
    )
    count = F.count_if(F.coalesce("pos", F.lit(0)) == 0)
    return placed.groupBy("lname").agg(
        F.ceil(count / DEALT).cast("int").alias("parts"), F.collect_set("slot").alias("slots"), F.collect_set("col").alias("around")
    )


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (id1 < id2, and both sides' fields) of rows (event_id, the four fields) among which are all that reach
    the threshold: those of equal or close names."""
    low = (threshold - DESCRIPTION - DATE - LOCATION) / NAME
    if not 0 < low <= 1:
        raise ValueError("the threshold must leave a part to names that they can reach")
    far = (threshold - DESCRIPTION - max(DATE, LOCATION)) / NAME
    told = cut(rows.where("name <> '' and event_id is not null").withColumns({
        "lname": F.lower("name"), "at": F.unix_seconds(D.event_date(F.col("date"))),
        "places": F.when(~blank(F.col("location")), location_parts(F.col("location"))),
    }))
    names = cut(_named(told))
    sizes = names.select("lname", "parts")
    met = close_names(names, low, far).union(names.select("lname", "lname"))
    met = met.join(sizes.withColumnRenamed("lname", "other"), "other")
    fields = ("event_id", *FIELDS, "at", "places")
    one = told.join(met, "lname").select(
        *[F.col(f).alias(f"{f}1") for f in fields], "other", F.explode(F.sequence(F.lit(1), "parts")).alias("part")
    )
    two = told.join(sizes, "lname").select(
        F.col("lname").alias("other"), (F.pmod(F.xxhash64("event_id", *FIELDS), F.col("parts")) + 1).cast("int").alias("part"),
        *[F.col(f).alias(f"{f}2") for f in fields],
    )
    many, on = 4 * _partitions(rows), ["other", "part"]  # as for tiles: bytes tell nothing of the pairs
    return one.repartition(many, *on).join(two.repartition(many, *on), on).where("event_id1 < event_id2").select(
        F.col("event_id1").alias("id1"), F.col("event_id2").alias("id2"), *[f"{f}{i}" for f in FIELDS for i in (1, 2)],
        D.gap_score(F.col("at1"), F.col("at2")).alias("date_score"), parts_score(F.col("places1"), F.col("places2")).alias("location_score"),
    )


def candidates(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Class pairs (id1 < id2) among which are all that reach the threshold."""
    return _pairs(classes.select(F.col("class_id").alias("event_id"), *FIELDS), threshold).select("id1", "id2").distinct()


def fuzzy_event_pairs(classes: DataFrame, threshold: float = 0.8, events: DataFrame | None = None) -> DataFrame:
    """id1, id2, name_score, description_score and score of event pairs that reach the threshold.

    ``classes`` is the first frame of :func:`event_classes`. With ``events``, the frame that they were made of, all
    pairs of events are returned. Without, pairs of classes by their first events; then up to the threshold 0.8, pairs
    of classes with the same given name and description are left out: they reach it whatever else differs.
    """
    if events is not None:
        pairs = _pairs(events.select("event_id", *FIELDS).distinct(), threshold)
    else:
        pairs = _pairs(classes.select(F.col("class_id").alias("event_id"), *FIELDS), threshold)
        if threshold <= NAME + DESCRIPTION:
            lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
            same = [(lower(F.col(f"{f}1")) == lower(F.col(f"{f}2"))) & (lower(F.col(f"{f}1")) != "") for f in ("name", "description")]
            pairs = pairs.where(~(same[0] & same[1]))
    return score_pairs(pairs, threshold).select("id1", "id2", "name_score", "description_score", "score")
