"""Date functions. Raw strings stay strings; parsed values are null where nothing fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted full-date and date-time layouts beside ISO ----------------------
LOOSE_LAYOUTS = [
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "d MMM yyyy HH:mm:ss Z"),
]
ENTRY_DATE_FIELDS = [
    "fr_citation_date",
    "publication_date",
    "lastmod_date",
    "date",
    "dc_date",
    "prism_publicationDate",
    "dc:date",
    "prism:publicationDate",
]
URL_DATE_PATTERNS = [
    r"/documents/(\d{4})/(\d{2})/(\d{2})/",
    r"/(\d{4})/(\d{2})/(\d{2})/",
    r"-(\d{4})-(\d{2})-(\d{2})(?:/|$)",
]
# ------------------------------------------------------------------------------------------


def _layout(c: Column, shape: str, layout: str) -> Column:
    """Parse only strings of the right shape, so that no parse error is raised per row."""
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(layout)))


def iso_timestamp(c: Column) -> Column:
    """ISO date or date-time, ``Z`` and offsets included, in UTC."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(c.rlike(shape), c.try_cast("timestamp"))


def normalize_date(c: Column) -> Column:
    """ISO day for the three known layouts; any other input unchanged; null gives ''."""
    parsed = F.coalesce(
        _layout(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _layout(c, r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
        _layout(c, r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    )
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), c, F.lit(""))


def parse_date_string(c: Column) -> Column:
    """``YYYY-MM`` and ``YYYY`` go to their first day, else the accepted layouts."""
    # mail-style stamps: the week day says nothing new, GMT is the zero offset
    mail = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), r" (GMT|UTC|Z)$", " +0000")
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM")))
        .when(c.rlike(r"^\d{4}$"), F.try_to_timestamp(c, F.lit("yyyy")))
        .otherwise(
            F.coalesce(
                iso_timestamp(c),
                _layout(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
                *[_layout(mail, shape, layout) for shape, layout in LOOSE_LAYOUTS],
            )
        )
    )


def date_from_url(url: Column) -> Column:
    """Day, month or year written in a URL path; an impossible day falls to the next pattern."""

    def day(y: Column, m: Column, d: Column) -> Column:
        text = F.concat_ws("-", y, m, d)
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))

    full = [day(*[F.regexp_extract(url, p, i) for i in (1, 2, 3)]) for p in URL_DATE_PATTERNS]
    month_pattern, year_pattern = r"/(\d{4})/(\d{2})/", r"/(\d{4})/"
    month = day(
        F.regexp_extract(url, month_pattern, 1), F.regexp_extract(url, month_pattern, 2), F.lit("01")
    )
    year = day(F.regexp_extract(url, year_pattern, 1), F.lit("01"), F.lit("01"))
    tail = F.when(url.rlike(month_pattern), month).otherwise(year)
    return F.coalesce(*full, tail)


def entry_date(columns: list[str]) -> Column:
    """Publication time of a feed entry: parsed stamps, text fields in order, then the link."""
    tries: list[Column] = []
    for name in ("published_parsed", "updated_parsed", "created_parsed"):
        if name in columns:
            tries.append(F.col(name).try_cast("timestamp"))
    for name in ENTRY_DATE_FIELDS:
        if name in columns:
            tries.append(parse_date_string(F.col(f"`{name}`")))
    for name in ("link", "url"):
        if name in columns:
            tries.append(date_from_url(F.col(name)))
            break
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp")


def event_date(c: Column) -> Column:
    """Event date for scoring: ``N/A``, empty and unreadable give null."""
    return iso_timestamp(F.nullif(F.nullif(c, F.lit("N/A")), F.lit("")))


def temporal_score(left: Column, right: Column) -> Column:
    """1.0 same day, 0.8 one day apart, 0.6 two days, else 0.0."""
    return gap_score(F.unix_seconds(event_date(left)), F.unix_seconds(event_date(right)))


def gap_score(left: Column, right: Column) -> Column:
    """:func:`temporal_score` of the seconds of two event dates."""
    days = F.abs(F.floor((left - right) / 86400))
    return F.coalesce(
        F.when(days == 0, 1.0).when(days == 1, 0.8).when(days == 2, 0.6), F.lit(0.0)
    )


def year_bucket(c: Column) -> Column:
    """Year as text, ``N/A`` where absent, ``invalid`` where unreadable."""
    stamp = iso_timestamp(c)
    return (
        F.when(F.coalesce(c, F.lit("N/A")) == "N/A", "N/A")
        .when(stamp.isNull(), "invalid")
        .otherwise(F.year(stamp).cast("string"))
    )
