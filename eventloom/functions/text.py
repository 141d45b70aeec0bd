"""Text functions: every function maps columns to a column and stays inside the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import bind, mark_repeats

# --- fixed values -------------------------------------------------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ACTOR_TITLES = ["judge", "mr.", "mrs.", "ms.", "dr."]
ACTION_SYNONYMS = {
    "detained": "arrested",
    "taken into custody": "arrested",
    "apprehended": "arrested",
    "dismissed": "fired",
    "removed": "fired",
    "terminated": "fired",
    "approved": "passed",
    "enacted": "passed",
    "adopted": "passed",
}
INDICATOR_PHRASES = [
    "elite capture",
    "power concentration",
    "institution capture",
    "narrative weaponization",
    "legitimacy attack",
    "opposition suppression",
    "democratic erosion",
    "authoritarian",
    "autocratic",
]
ERROR_MARKERS = ["I cannot", "I'm unable", "ERROR:", "FAILED:"]
REQUIRED_ROUNDS = ["fact_extraction", "article_analysis", "node_extraction"]
SCORE_PATTERNS = [
    r"(?iud)manipulation.*?score.*?([0-9]+(?:\.[0-9]+)?)",
    r"(?iud)score.*?([0-9]+(?:\.[0-9]+)?)",
    r"(?iud)([0-9]+(?:\.[0-9]+)?)\s*(?:out of|/)\s*10",
]
REPEAT_MARKER = "[Similar content repeated - details omitted]"
CONTENT_BUDGET = 12000
CHARS_PER_TOKEN = 4
HTML_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&amp;": "&",
}
# ------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Trim any leading and trailing white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def normalize_actor(c: Column) -> Column:
    out = F.lower(F.coalesce(c, F.lit("")))
    for title in ACTOR_TITLES:
        out = F.replace(out, F.lit(title), F.lit(""))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    return F.replace(strip(out), F.lit(" "), F.lit("_"))


def normalize_action(c: Column) -> Column:
    plain = strip(F.lower(F.coalesce(c, F.lit(""))))
    synonyms = F.create_map(*[F.lit(x) for pair in ACTION_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(synonyms, plain), plain)


def normalize_location(c: Column) -> Column:
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("_"))


def event_signature(actor: Column, action: Column, date: Column, location: Column) -> Column:
    """Join four already normalised parts."""
    return F.concat_ws("|", actor, action, date, location)


def signature_similarity(left: Column, right: Column) -> Column:
    """Share of equal, non-empty signature parts; 0.0 where a signature is missing."""
    a, b = F.split(left, r"\|"), F.split(right, r"\|")
    hits = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != "")), lambda hit: hit))
    score = hits / F.greatest(F.size(a), F.size(b))
    return F.when(blank(left) | blank(right), F.lit(0.0)).otherwise(score)


def event_key(name: Column, date: Column) -> Column:
    return F.concat(
        strip(F.lower(F.coalesce(name, F.lit("")))), F.lit("_"), F.coalesce(date, F.lit(""))
    )


def location_score(left: Column, right: Column) -> Column:
    """Comma parts: all equal 1.0, last two equal 0.6, last one equal 0.3."""
    scored = bind(location_parts(left), lambda a: bind(location_parts(right), lambda b: parts_score(a, b)))
    return F.when(blank(left) | blank(right), F.lit(0.0)).otherwise(scored)


def location_parts(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda p: F.lower(strip(p)))


def parts_score(a: Column, b: Column) -> Column:
    """:func:`location_score` of the parts of two locations; 0.0 where a side is null."""
    return (
        F.when(a == b, 1.0)
        .when(
            (F.size(a) >= 2)
            & (F.size(b) >= 2)
            & (F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)))
            & (F.try_element_at(a, F.lit(-2)) == F.try_element_at(b, F.lit(-2))),
            0.6,
        )
        .when(F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)), 0.3)
        .otherwise(0.0)
    )


def title_actor(title: Column) -> Column:
    """Actor of a "... signs ..." headline; null where the headline has no such verb."""
    return F.when(F.contains(title, F.lit("signs")), F.substring_index(title, " signs ", 1))


def primary_actor(actors: Column, description: Column) -> Column:
    """First listed actor, else the words before " arrested ", else Unknown."""
    from_text = F.when(
        F.contains(description, F.lit(" arrested ")),
        strip(F.substring_index(description, " arrested ", 1)),
    )
    return F.coalesce(F.try_element_at(actors, F.lit(1)), from_text, F.lit("Unknown"))


def node_actor(attributes: Column) -> Column:
    """Actor named by a graph node's attributes. A JSON list gives its first member."""

    def value(key: str) -> Column:
        raw = F.try_element_at(attributes, F.lit(key))
        first = F.when(F.startswith(raw, F.lit("[")), F.get_json_object(raw, "$[0]")).otherwise(raw)
        return F.nullif(first, F.lit(""))

    return F.coalesce(value("actor"), value("primary_actor"), F.lit("Unknown"))


def event_action(action: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(action, F.lit("")), name, F.lit(""))


def strip_reasoning(c: Column) -> Column:
    """Drop everything up to the first closing think tag."""
    tag = "</think>"
    rest = F.substr(c, F.locate(tag, c) + len(tag))
    return strip(F.when(F.contains(c, F.lit(tag)), rest).otherwise(c))


def dedup_paragraphs(c: Column, separator: str = "\n\n", prefix: int | None = None) -> Column:
    """Keep the first paragraph of each signature, put one marker for every repeat.

    The signature is the whole text without case and white space, or its first ``prefix`` characters.
    """
    paragraphs = F.filter(
        F.transform(_split_literal(c, separator), strip), lambda p: p != ""
    )

    def signature(p: Column) -> Column:
        whole = F.regexp_replace(F.lower(p), r"(?U)\s+", "")
        return whole if prefix is None else F.substring(whole, 1, prefix)

    kept = F.transform(
        mark_repeats(paragraphs, signature),
        lambda x: F.when(x["repeat"], F.lit(REPEAT_MARKER)).otherwise(x["item"]),
    )
    return F.array_join(kept, separator)


def fit_content(
    c: Column, budget: int | None = None, separator: str = "\n\n"
) -> Column:
    """Whole distinct sentences up to a length budget if one is given, then paragraph dedup."""
    if budget is None:
        return dedup_paragraphs(c, separator)

    def within(sentences: Column) -> Column:
        """Number of leading sentences that fit before the first overflow."""
        state = F.aggregate(
            sentences,
            F.struct(
                F.lit(0).cast("bigint").alias("used"),
                F.lit(0).alias("n"),
                F.lit(False).alias("full"),
            ),
            lambda acc, s: F.when(
                ~acc["full"] & (acc["used"] + F.length(s) + 2 <= budget),
                F.struct(
                    (acc["used"] + F.length(s) + 2).cast("bigint").alias("used"),
                    (acc["n"] + 1).alias("n"),
                    F.lit(False).alias("full"),
                ),
            ).otherwise(
                F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(True).alias("full"))
            ),
        )
        return state["n"]

    sentences = F.filter(F.transform(F.split(c, r"\. "), strip), lambda s: s != "")
    distinct = F.transform(
        F.filter(
            mark_repeats(sentences, F.lower),
            lambda x: ~x["repeat"],
        ),
        lambda x: x["item"],
    )
    chosen = bind(distinct, lambda d: F.slice(d, F.lit(1), within(d)))
    fitted = bind(
        chosen,
        lambda k: F.when(
            F.size(k) > 0, F.concat(F.array_join(k, ". "), F.lit("."))
        ).otherwise(F.concat(F.substring(c, 1, budget), F.lit("..."))),
    )
    shortened = F.when(F.length(c) <= budget, c).otherwise(fitted)
    return dedup_paragraphs(shortened, separator)


def manipulation_score(c: Column) -> Column:
    """First number found by the score patterns, tried in order; 0.0 if none."""
    found = [F.regexp_extract(c, p, 1).try_cast("double") for p in SCORE_PATTERNS]
    return F.coalesce(*found, F.lit(0.0))


def indicators(c: Column) -> Column:
    return bind(
        F.lower(F.coalesce(c, F.lit(""))),
        lambda t: F.filter(
            F.array(*[F.lit(p) for p in INDICATOR_PHRASES]), lambda p: F.contains(t, p)
        ),
    )


def concern_level(found: Column) -> Column:
    return F.when(F.size(found) >= 3, "HIGH").when(F.size(found) >= 1, "MEDIUM").otherwise("LOW")


def validation(template_status: Column, has_article: Column, rounds: Column) -> Column:
    """Status, reason and single checks of one analysis.

    ``rounds`` is ``array<struct<name, response, error>>``.
    """
    names = F.transform(F.filter(rounds, lambda r: r["error"].isNull()), lambda r: r["name"])
    has_required = F.size(
        F.array_except(F.array(*[F.lit(r) for r in REQUIRED_ROUNDS]), names)
    ) == 0
    clean = ~F.exists(
        rounds,
        lambda r: F.coalesce(
            F.exists(
                F.array(*[F.lit(m) for m in ERROR_MARKERS]), lambda m: F.contains(r["response"], m)
            ),
            F.lit(False),
        ),
    )
    checks = [
        ("has_article", F.coalesce(has_article, F.lit(False))),
        ("has_rounds", F.coalesce(F.size(rounds) > 0, F.lit(False))),
        ("json_parseable", F.lit(True)),
        ("required_fields", F.coalesce(has_required, F.lit(False))),
        ("no_llm_errors", F.coalesce(clean, F.lit(True))),
    ]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    status = F.coalesce(template_status, F.lit("TESTING"))
    return F.struct(
        F.when(status == "TESTING", "REVIEW")
        .when(F.size(failed) > 0, "FAILED")
        .otherwise("VALID")
        .alias("status"),
        F.when(status == "TESTING", "Testing template requires human review")
        .when(
            F.size(failed) > 0,
            F.concat(F.lit("Failed validation checks: "), F.array_join(failed, ", ")),
        )
        .otherwise("Passed all validation checks")
        .alias("reason"),
        F.struct(*[ok.alias(name) for name, ok in checks]).alias("checks"),
        status.alias("template_status"),
    )


def node_text(
    node_type: Column, name: Column, attributes: Column, sentence: Column
) -> Column:
    """Text form of a node for embedding. Nested attribute values (JSON) are left out."""
    scalar = F.filter(
        F.array_sort(F.map_entries(attributes)),
        lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^\s*[\[{]"),
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("Type: "), F.coalesce(node_type, F.lit("unknown"))),
        F.concat(F.lit("Name: "), F.coalesce(name, F.lit(""))),
        F.transform(scalar, lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
        F.when(~blank(sentence), F.concat(F.lit("Context: "), sentence)),
    )


def unescape_html(c: Column) -> Column:
    for entity, char in HTML_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_title(html: Column) -> Column:
    """``og:title`` content, else the title element, else Untitled."""
    og_first = r"(?is)<meta[^>]*property\s*=\s*[\"']og:title[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']+)"
    og_last = r"(?is)<meta[^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"'][^>]*property\s*=\s*[\"']og:title"
    title = r"(?is)<title[^>]*>(.*?)</title>"
    has_title = html.rlike(r"(?is)<title[^>]*>.*?</title>")
    og = F.coalesce(
        F.nullif(F.regexp_extract(html, og_first, 1), F.lit("")),
        F.nullif(F.regexp_extract(html, og_last, 1), F.lit("")),
    )
    plain = F.when(has_title, F.regexp_extract(html, title, 1))
    return F.coalesce(strip(unescape_html(og)), strip(unescape_html(plain)), F.lit("Untitled"))


def strip_tags(html: Column) -> Column:
    return strip(unescape_html(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", "")))


def url_host(url: Column) -> Column:
    """Network location of a URL without "www."."""
    return F.replace(_netloc(url), F.lit("www."), F.lit(""))


def _netloc(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def url_netloc(url: Column) -> Column:
    return _netloc(url)


def recovery_query(url: Column, source_name: Column) -> Column:
    """Search phrase for a lost page: host and the words of the last path part."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    slug = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[a-zA-Z0-9]+$", "")
    words = strip(F.regexp_replace(slug, r"[^a-zA-Z0-9]+", " "))
    site = F.concat(F.lit("site:"), _netloc(url))
    return strip(F.concat_ws(" ", site, F.when(words != "", words).otherwise(source_name)))


def article_id(url: Column, millis: Column | None = None) -> Column:
    short = F.substring(F.md5(url.cast("binary")), 1, 12)
    return short if millis is None else F.concat_ws("_", short, millis.cast("string"))


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int"))


def output_budget(prompt: Column, requested: Column, window: Column) -> Column:
    """Tokens left for the answer, at least 512."""
    margin = F.greatest(F.lit(256), F.floor(window / 10).cast("int"))
    available = window - token_estimate(prompt) - margin
    return F.greatest(F.lit(512), F.least(requested, available))


def render_prompt(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template in one pass."""
    parts: list[Column] = []
    for literal, field, _spec, _conv in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _split_literal(c: Column, separator: str) -> Column:
    return F.split(c, r"\Q" + separator + r"\E")
