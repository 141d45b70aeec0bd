"""Reading JSON out of free text: the first strategy that gives a value of the wanted type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import bind
from .text import strip

# --- fixed values -------------------------------------------------------------------------
ANSWER_PREFIXES = ["Here is the JSON:", "Here's the JSON:", "JSON:", "```json", "```"]
FENCED_BLOCK = r"```(?:json)?\s*([\s\S]*?)\s*```"
BRACKETED = r"(?s)(\[.*?\]|\{.*?\})"
WHOLE_LIST = r"(?s)(\[\s*\{[^\]]+\]\s*\])"
FLAT_OBJECT = r"(?s)(\{[^{}]+\})"
NODE_PAIR = r'("node_type"\s*:\s*"[^"]+"[^}]*"name"\s*:\s*"[^"]+")'
NODE_TYPE_FIELD = r'"node_type"\s*:\s*"([^"]+)"'
NODE_NAME_FIELD = r'"name"\s*:\s*"([^"]+)"$'
# ------------------------------------------------------------------------------------------


def _parses(c: Column) -> Column:
    """True for valid JSON of any type."""
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False)) & (strip(c) != "")


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _is_kind(c: Column, kind: str) -> Column:
    return F.ltrim(strip(c)).startswith("[" if kind == "list" else "{")


def _not_empty(c: Column) -> Column:
    return ~strip(c).rlike(r"^(\[\s*\]|\{\s*\}|\"\"|null|false|0|0\.0)$")


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _longest_first(items: Column) -> Column:
    keyed = F.transform(
        items, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.array_sort(keyed), lambda e: e["x"])


def plain_json(text: Column) -> Column:
    """Fenced block, else the whole text, else the first bracketed piece that parses."""
    blocks = F.filter(F.transform(_all(text, FENCED_BLOCK), strip), _parses)
    pieces = F.filter(_all(text, BRACKETED), _parses)
    return F.coalesce(_first(blocks), F.when(_parses(text), text), _first(pieces))


def cleaned_json(text: Column) -> Column:
    """Drop answer prefixes and back-ticks and close open brackets."""
    out = text
    for prefix in ANSWER_PREFIXES:
        starts = strip(out).startswith(prefix)
        out = F.when(starts, strip(F.substr(out, F.lit(len(prefix) + 1)))).otherwise(out)
    out = strip(F.regexp_replace(out, "`+$", ""))

    def close(c: Column, opening: str, closing: str) -> Column:
        def count(ch: str) -> Column:
            return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))

        return F.concat(
            c, F.repeat(F.lit(closing), F.greatest(F.lit(0), count(opening) - count(closing)))
        )

    return bind(
        bind(out, lambda c: close(c, "[", "]")), lambda c: close(c, "{", "}")
    )


def rebuilt_nodes(text: Column) -> Column:
    """Node list pieced together from type and name fields of broken JSON."""
    nodes = F.transform(
        _all(text, NODE_PAIR),
        lambda m: F.struct(
            F.regexp_extract(m, NODE_TYPE_FIELD, 1).alias("node_type"),
            F.regexp_extract(m, NODE_NAME_FIELD, 1).alias("name"),
            F.create_map().cast("map<string,string>").alias("attributes"),
        ),
    )
    return bind(nodes, lambda n: F.when(F.size(n) > 0, F.to_json(n)))


def recover_json(text: Column, kind: str) -> Column:
    """JSON text of the wanted kind (``list`` or ``dict``) found in ``text``, or null.

    Rows that give null belong in a quarantine table, see ``operators.quality.recover``.
    """

    def usable(c: Column) -> Column:
        return F.when(_is_kind(c, kind), c)

    standard = bind(plain_json(text), lambda c: F.when(_not_empty(c), usable(c)))
    cleaned = bind(cleaned_json(text), lambda c: F.when(_parses(c), usable(c)))
    pattern = WHOLE_LIST if kind == "list" else FLAT_OBJECT
    pieces = F.filter(
        _longest_first(_all(text, pattern)),
        lambda c: _parses(c) & _is_kind(c, kind) & (F.lit(kind == "dict") | _not_empty(c)),
    )
    tries = [standard, cleaned, _first(pieces)]
    if kind == "list":
        tries.append(F.when(F.contains(text, F.lit("node_type")), rebuilt_nodes(text)))
    return F.coalesce(*tries)
