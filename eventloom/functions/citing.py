"""Where a piece of text stands inside a source text (offsets count characters from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import bind

CONTEXT_CHARS = 50


def _before(c: Column, position: Column) -> Column:
    return F.substr(c, F.lit(1), position)


def span(
    source: Column, position: Column, length: Column, confidence: Column, kind: Column
) -> Column:
    """Citation struct for ``length`` characters at offset ``position``."""
    head = _before(source, position)
    start = F.greatest(F.lit(0), position - CONTEXT_CHARS)
    end = F.least(F.length(source), position + length + CONTEXT_CHARS)
    breaks = (F.length(head) - F.length(F.replace(head, F.lit("\n\n"), F.lit("")))) / 2
    stops = F.length(head) - F.length(F.replace(head, F.lit("."), F.lit("")))
    return F.struct(
        F.substr(source, position + 1, length).alias("source_text"),
        F.substr(source, start + 1, end - start).alias("context"),
        (breaks.cast("int") + 1).alias("paragraph_num"),
        (stops + 1).alias("sentence_num"),
        position.alias("char_start"),
        (position + length).alias("char_end"),
        confidence.alias("match_confidence"),
        kind.alias("match_type"),
    )


def _hit(position: Column, length: Column, confidence: float, kind: str) -> Column:
    """A match, or null where ``position`` (counted from 1) is 0 or null."""
    return F.when(
        position > 0,
        F.struct(
            (position - 1).alias("pos"),
            length.alias("len"),
            F.lit(confidence).alias("confidence"),
            F.lit(kind).alias("kind"),
        ),
    )


def exact_match(text: Column, source: Column) -> Column:
    """Case-insensitive first occurrence."""
    found = F.call_function("locate", F.lower(text), F.lower(source))
    return F.when(text != "", _hit(found, F.length(text), 1.0, "exact"))


def normalized_match(text: Column, source: Column) -> Column:
    """The same words with any punctuation between them."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    pattern = F.concat(F.lit(r"(?iU)\b"), F.array_join(words, r"\W*"), F.lit(r"\b"))
    matched = F.length(F.regexp_substr(source, pattern))
    return F.when(
        F.size(words) > 0, _hit(F.regexp_instr(source, pattern), matched, 0.9, "normalized")
    )


def partial_entity_match(name: Column, source: Column) -> Column:
    """Last name of more than three letters, else first and last name."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    short = F.concat_ws(" ", first, last)

    def find(needle: Column) -> Column:
        at = F.call_function("locate", F.lower(needle), F.lower(source))
        return _hit(at, F.length(needle), 0.8, "partial")

    return F.coalesce(
        F.when((F.size(words) > 1) & (F.length(last) > 3), find(last)),
        F.when(F.size(words) > 2, find(short)),
    )


def all_occurrences(text: Column, source: Column, most: int | None = None) -> Column:
    """Offsets of all occurrences (or the first ``most``), overlapping ones included.

    A search starts behind the last find and stops at the first failure. Every occurrence starts
    inside one of those that do not overlap, so the characters of the latter bound the steps.
    """
    empty = F.array().cast("array<int>")

    def offsets(needle: Column, hay: Column) -> Column:
        def step(state: Column, _i: Column) -> Column:
            found = state["found"]
            last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(-1))
            at = F.when(~state["done"], F.call_function("locate", needle, hay, last + 2)).otherwise(0)
            return F.struct(
                F.when(at > 0, F.array_append(found, at - 1)).otherwise(found).alias("found"), (at == 0).alias("done")
            )

        start = F.struct(empty.alias("found"), F.lit(False).alias("done"))
        steps = F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))
        if most is not None:
            steps = F.least(steps, F.lit(most))
        found = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda state: state["found"])
        return F.when((needle != "") & (steps > 0), found).otherwise(empty)

    # both are lowered once, not at every step
    return bind(F.lower(text), lambda needle: bind(F.lower(source), lambda hay: offsets(needle, hay)))
