"""Queries over articles, pages, texts, vectors, lineage and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import hashing as H
from ..functions import text as T
from ..operators import citations as ci
from ..operators import filters as fl
from ..operators import ingest as ing
from ..operators import lineage as ln
from ..operators import quality as ql
from ..operators import stats as st
from ..operators import vectors as ve
from ..session import fresh_dir
from ..sources import tables as t
from ..sources.vector_index import VectorIndex
from .registry import ARTICLES, MENTIONS, NODES, ORACLES, query, r6

KEYWORDS = ["the ", "tion", "eau", "lichk", "que", "ung"]
_HITS = " + ".join(f"CAST(contains(txt, '{k}') AS INT)" for k in KEYWORDS)


@query("keyword_filter", f"""WITH x AS (SELECT doc_id, lower(source || ' ' || text) AS txt FROM documents)
SELECT doc_id, CAST({_HITS} AS INTEGER) AS hits FROM x WHERE {_HITS} >= 2""")
def keyword_filter(spark, sf):
    docs = t.table(spark, sf, "documents")
    hits = docs.select("doc_id", fl.keyword_hits(F.col("source"), F.col("text"), KEYWORDS).alias("hits"))
    return hits.where("hits >= 2")


@query("date_range_filter", f"""WITH {ARTICLES}
SELECT doc_id, published FROM articles
WHERE published IS NULL OR published BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'""")
def date_range_filter(spark, sf):
    import datetime as dt

    a = t.articles(spark, sf).select("doc_id", "published")
    return a.where(fl.in_date_range(F.col("published"), dt.date(2024, 3, 1), dt.date(2024, 6, 30)))


@query("cutoff_filter", f"""WITH {ARTICLES}
SELECT doc_id, published FROM articles WHERE published IS NULL OR published >= DATE '2024-07-01'""")
def cutoff_filter(spark, sf):
    import datetime as dt

    a = t.articles(spark, sf).select("doc_id", "published")
    return a.where(fl.after_cutoff(F.col("published"), dt.date(2024, 7, 1)))


_URL_PARTS = " AND ".join(f"NOT contains(lower(u), '{p}')" for p in fl.SKIPPED_URL_PARTS)
_PAGE_URL = "CASE page_id % 4 WHEN 0 THEN url || '/tag/x' WHEN 1 THEN url || '/Feed/' WHEN 2 THEN url || '.PDF' ELSE url END"


@query("article_url_filter", f"""WITH x AS (
  SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, {_PAGE_URL} FROM pages)
SELECT page_id, u AS url FROM x WHERE {_URL_PARTS}""")
def article_url_filter(spark, sf):
    pages = t.table(spark, sf, "pages")
    kind = F.col("page_id") % 4
    variant = (
        F.when(kind == 0, F.concat("url", F.lit("/tag/x"))).when(kind == 1, F.concat("url", F.lit("/Feed/")))
        .when(kind == 2, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    )
    urls = pages.select("page_id", "url").union(pages.select("page_id", variant))
    return urls.where(fl.is_article_url(F.col("url")))


@query("min_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE length(text) > 200")
def min_length(spark, sf):
    docs = t.table(spark, sf, "documents").where(fl.long_enough(F.col("text")))
    return docs.select("doc_id", F.length("text").alias("chars"))


def _channels(spark, sf):
    pages = t.table(spark, sf, "pages")
    feed = pages.select("url", (F.col("page_id") * 2).alias("seq"), F.lit(False).alias("via_google_news"))
    second = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("&ch=2")))
    search = pages.select(
        second.alias("url"), (F.col("page_id") * 2 + 1).alias("seq"), F.lit(True).alias("via_google_news"),
        F.lit(False).alias("via_gdelt"),
    )
    return ing.union_channels(feed, search)


_CHANNELS = """ch AS (
  SELECT url, page_id * 2 AS seq, FALSE AS via_google_news, CAST(NULL AS BOOLEAN) AS via_gdelt FROM pages
  UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '&ch=2' END, page_id * 2 + 1, TRUE, FALSE FROM pages)"""


@query("url_dedup", f"""WITH {_CHANNELS}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM ch)
SELECT url, seq, via_google_news, via_gdelt FROM r WHERE rn = 1""")
def url_dedup(spark, sf):
    return ing.first_per_url(_channels(spark, sf))


@query("source_limit", """SELECT source, doc_id AS pos FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5""")
def source_limit(spark, sf):
    docs = t.table(spark, sf, "documents").select("source", F.col("doc_id").alias("pos"))
    return ing.limit_per_source(docs, 5)


@query("circuit_breaker", """WITH e AS (
  SELECT user_id AS source, event_id AS pos, event_type IN ('click', 'view') AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk,
         sum(CAST(event_type IN ('click', 'view') AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS oks FROM events),
f AS (SELECT *, rk - coalesce(max(CASE WHEN ok THEN rk END) OVER (PARTITION BY source ORDER BY pos), 0) AS run FROM e),
s AS (SELECT source, least(min(CASE WHEN run = 5 THEN rk END), min(CASE WHEN oks = 20 THEN rk END)) AS stop FROM f GROUP BY source)
SELECT source, pos, ok FROM f JOIN s USING (source) WHERE rk <= coalesce(stop, 9223372036854775807)""")
def circuit_breaker(spark, sf):
    entries = t.table(spark, sf, "events").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("pos"),
        F.col("event_type").isin("click", "view").alias("ok"),
    )
    return ing.circuit_breaker(entries, limit=20)


@query("unanalyzed_docs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unanalyzed_docs(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id")
    return ing.unanalyzed(docs, t.table(spark, sf, "labels"))


@query("analysis_targets", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20")
def analysis_targets(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id")
    return ing.select_targets(docs, t.table(spark, sf, "labels"), cap=20)


@query("recovered_urls", """WITH h AS (SELECT *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages),
best AS (SELECT host, arg_min(url || '#alt', page_id) AS candidate_url FROM h GROUP BY host)
SELECT url, h.host AS source, candidate_url FROM h JOIN best USING (host)""")
def recovered_urls(spark, sf):
    pages = t.table(spark, sf, "pages")
    failed = pages.select("url", T.url_netloc(F.col("url")).alias("source"), F.col("page_id").alias("seq"))
    found = pages.select(F.concat("url", F.lit("#alt")).alias("candidate_url"), F.col("page_id").alias("rank"))
    return ing.recover_failed(failed, found)


@query("collection_stats", """SELECT
  CAST(count_if(event_type = 'click') AS BIGINT) AS article_attempted,
  CAST(count_if(event_type = 'click' AND value > 50) AS BIGINT) AS article_succeeded,
  printf('%.1f%%', count_if(event_type = 'click' AND value > 50) / greatest(1, count_if(event_type = 'click')) * 100) AS article_rate,
  CAST(count_if(event_type = 'view') AS BIGINT) AS source_attempted,
  CAST(count_if(event_type = 'view' AND value > 50) AS BIGINT) AS source_succeeded,
  printf('%.1f%%', count_if(event_type = 'view' AND value > 50) / greatest(1, count_if(event_type = 'view')) * 100) AS source_rate
FROM events""")
def collection_stats(spark, sf):
    e = F.col("event_type")
    entries = t.table(spark, sf, "events").select(
        F.when(e == "click", "article").when(e == "view", "source").otherwise("other").alias("stage"),
        (F.col("value") > 50).alias("ok"),
    )
    out = ing.collection_stats(entries)
    return out.select(*[c for c in out.columns if c.split("_")[0] in ("article", "source")])


@query("filter_reasons", """SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE event_type WHEN 'error' THEN 'no_link' WHEN 'view' THEN 'outside_date_range' END AS reason FROM events)
WHERE reason IS NOT NULL GROUP BY reason""")
def filter_reasons(spark, sf):
    e = F.col("event_type")
    return ing.filter_reasons(
        t.table(spark, sf, "events").select(F.when(e == "error", "no_link").when(e == "view", "outside_date_range").alias("reason"))
    )


@query("daily_history", f"""WITH {ARTICLES}, h AS (
  SELECT published AS day, count(*) AS n FROM articles WHERE published IS NOT NULL GROUP BY published
  UNION ALL SELECT CAST(ts AS DATE), count(*) FROM events GROUP BY CAST(ts AS DATE))
SELECT day, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY day""")
def daily_history(spark, sf):
    stored = t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return ing.daily_history(t.articles(spark, sf), stored)


@query("channel_counts", f"""WITH {ARTICLES}
SELECT CAST(count_if(NOT via_google_news AND NOT via_gdelt) AS BIGINT) AS rss, CAST(count_if(via_google_news) AS BIGINT) AS google_news,
       CAST(count_if(via_gdelt) AS BIGINT) AS gdelt, CAST(count_if(via_gov_api) AS BIGINT) AS government FROM articles""")
def channel_counts(spark, sf):
    return ing.channel_counts(t.articles(spark, sf))


@query("article_metadata", f"""WITH {ARTICLES}
SELECT 'Untitled' AS title, '' AS url, source, 'unknown' AS bias_label, CAST(published AS VARCHAR) AS published,
       substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS id, via_google_news, via_gdelt, via_gov_api FROM articles""")
def article_metadata(spark, sf):
    a = t.articles(spark, sf).withColumn("id", T.article_id(F.col("doc_id").cast("string")))
    out = ing.article_metadata(a.withColumn("published", F.col("published").cast("string")))
    return out.drop("collected_at", "author", "extraction_method")


@query("source_registry", """WITH s AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'archive' END AS type,
         CASE page_id % 2 WHEN 0 THEN url || '/feed.xml' ELSE url END AS u FROM pages)
SELECT page_id, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS name,
       CASE WHEN type = 'auto' THEN CASE WHEN contains(lower(u), 'sitemap') OR lower(u) LIKE '%.xml' THEN 'sitemap'
            WHEN NOT contains(lower(u), '/rss') AND NOT contains(lower(u), '/feed') AND NOT contains(lower(u), '.xml') THEN 'article'
            ELSE 'rss' END ELSE 'rss' END AS type
FROM s WHERE type IS NULL OR type <> 'archive'""")
def source_registry(spark, sf):
    p = F.col("page_id")
    sources = t.table(spark, sf, "pages").select(
        "page_id", F.when(p % 3 == 0, "auto").when(p % 3 == 1, "archive").alias("type"),
        F.when(p % 2 == 0, F.concat("url", F.lit("/feed.xml"))).otherwise(F.col("url")).alias("url"),
        F.lit(None).cast("boolean").alias("enabled"), F.lit(None).cast("string").alias("bias"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("limit"),
    )
    return fl.active_sources(sources).select("page_id", "name", "type")


@query("normalized_dates", """SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normalized,
  CASE o_orderkey % 5 WHEN 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed,
  CASE o_orderkey % 5 WHEN 4 THEN 'N/A' WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'invalid' END AS bucket
FROM orders""")
def normalized_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 2, F.date_format(d, "MMM d, yyyy")).when(k == 3, F.date_format(d, "yyyy-MM")).otherwise("N/A")
    )
    orders = t.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select(
        "o_orderkey", D.normalize_date(F.col("raw")).alias("normalized"),
        F.to_date(D.parse_date_string(F.col("raw"))).alias("parsed"), D.year_bucket(F.col("raw")).alias("bucket"),
    )


@query("url_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE)
  ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS day FROM orders""")
def url_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    url = (
        F.when(k == 0, F.concat(F.lit("https://a.gov/documents/"), F.date_format(d, "yyyy/MM/dd"), F.lit("/x")))
        .when(k == 1, F.concat(F.lit("https://a.org/"), F.date_format(d, "yyyy/MM/dd"), F.lit("/x")))
        .when(k == 2, F.concat(F.lit("https://a.org/story-"), F.date_format(d, "yyyy-MM-dd")))
        .otherwise(F.concat(F.lit("https://a.org/"), F.date_format(d, "yyyy/MM"), F.lit("/x")))
    )
    return t.table(spark, sf, "orders").select("o_orderkey", F.to_date(D.date_from_url(url)).alias("day"))


# ---- texts -------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PARAS = f"""parts AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS p, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM fitted),
clean AS (SELECT doc_id, {_STRIP.format('p')} AS p, pos FROM parts),
keyed AS (SELECT doc_id, p, pos, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(p), '\\s+', '', 'g') ORDER BY pos) AS rn
          FROM clean WHERE p <> ''),
joined AS (SELECT doc_id, string_agg(CASE WHEN rn = 1 THEN p ELSE '{T.REPEAT_MARKER}' END, chr(10) ORDER BY pos) AS out FROM keyed GROUP BY doc_id)
SELECT doc_id, sha256(coalesce(out, '')) AS digest, CAST(length(coalesce(out, '')) AS INTEGER) AS chars FROM fitted LEFT JOIN joined USING (doc_id)"""


def _digested(df, column):
    return df.select("doc_id", F.sha2(column, 256).alias("digest"), F.length(column).alias("chars"))


@query("paragraph_dedup", f"WITH fitted AS (SELECT doc_id, text AS content FROM documents), {_PARAS}")
def paragraph_dedup(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", T.dedup_paragraphs(F.col("text"), "\n").alias("out"))
    return _digested(docs, F.col("out"))


@query("content_budget", f"""WITH sent AS (
  SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS pos
  FROM documents WHERE length(text) > 12000),
cs AS (SELECT doc_id, {_STRIP.format('s')} AS s, pos FROM sent),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY pos) AS rn FROM cs WHERE s <> ''),
run AS (SELECT doc_id, s, pos, sum(length(s) + 2) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM firsts WHERE rn = 1),
kept AS (SELECT doc_id, string_agg(s, '. ' ORDER BY pos) || '.' AS content FROM run WHERE used <= 12000 GROUP BY doc_id),
fitted AS (SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text ELSE coalesce(content, substr(text, 1, 12000) || '...') END AS content
           FROM documents LEFT JOIN kept USING (doc_id)), {_PARAS}""")
def content_budget(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", T.fit_content(F.col("text"), T.CONTENT_BUDGET, "\n").alias("out"))
    return _digested(docs, F.col("out"))


_FLAGGED = """flagged AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 1 THEN ' An AUTHORITARIAN turn; manipulation has a high score of 7.5 here.'
  WHEN 2 THEN ' Elite capture, power concentration and an autocratic style. Score: 3' WHEN 3 THEN ' It is 8 out of 10 bad.' ELSE '' END AS t FROM documents)"""


def _flagged(spark, sf):
    k = F.col("doc_id") % 4
    tail = (
        F.when(k == 1, " An AUTHORITARIAN turn; manipulation has a high score of 7.5 here.")
        .when(k == 2, " Elite capture, power concentration and an autocratic style. Score: 3")
        .when(k == 3, " It is 8 out of 10 bad.").otherwise("")
    )
    return t.table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("t"))


_FOUND = "list_filter([" + ", ".join(f"'{p}'" for p in T.INDICATOR_PHRASES) + "], lambda p: contains(lower(t), p))"


@query("indicator_scan", f"""WITH {_FLAGGED}, f AS (SELECT doc_id, {_FOUND} AS found FROM flagged)
SELECT doc_id, array_to_string(found, ',') AS found, CASE WHEN len(found) >= 3 THEN 'HIGH' WHEN len(found) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM f""")
def indicator_scan(spark, sf):
    found = _flagged(spark, sf).select("doc_id", T.indicators(F.col("t")).alias("f"))
    return found.select("doc_id", F.array_join("f", ",").alias("found"), T.concern_level(F.col("f")).alias("level"))


_NUM = r"([0-9]+(?:\.[0-9]+)?)"


@query("score_extract", f"""WITH {_FLAGGED}
SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(t, '(?i)manipulation.*?score.*?{_NUM}', 1), '') AS DOUBLE),
  TRY_CAST(nullif(regexp_extract(t, '(?i)score.*?{_NUM}', 1), '') AS DOUBLE),
  TRY_CAST(nullif(regexp_extract(t, '(?i){_NUM}\\s*(?:out of|/)\\s*10', 1), '') AS DOUBLE), 0.0) AS score FROM flagged""")
def score_extract(spark, sf):
    return _flagged(spark, sf).select("doc_id", T.manipulation_score(F.col("t")).alias("score"))


_UNESC = "x"
for _e, _c in T.HTML_ENTITIES.items():
    _UNESC = f"replace({_UNESC}, '{_e}', {'chr(39)' if _c == chr(39) else repr(_c)})"


@query("html_title", f"""WITH x AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS x FROM pages)
SELECT page_id, {_STRIP.format(_UNESC)} AS title FROM x""")
def html_title(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("url_host", """WITH x AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)', ['host', 'path']) AS p, url FROM pages),
y AS (SELECT page_id, url, p.host AS host, trim(regexp_replace(regexp_replace(list_extract(string_split(p.path, '/'), -1), '\\.[a-zA-Z0-9]+$', ''), '[^a-zA-Z0-9]+', ' ', 'g')) AS words FROM x)
SELECT page_id, replace(host, 'www.', '') AS host, trim('site:' || host || ' ' || CASE WHEN words <> '' THEN words ELSE 'unknown source' END) AS search,
       substr(md5(url), 1, 12) AS id FROM y""")
def url_host(spark, sf):
    u = F.col("url")
    return t.table(spark, sf, "pages").select(
        "page_id", T.url_host(u).alias("host"), T.recovery_query(u, F.lit("unknown source")).alias("search"),
        T.article_id(u).alias("id"),
    )


@query("token_budget", """SELECT conv_id, turn, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens,
  CAST(greatest(512, least(2000, 4096 - greatest(1, length(text) // 4) - greatest(256, 4096 // 10))) AS INTEGER) AS budget FROM conversations""")
def token_budget(spark, sf):
    turns = t.table(spark, sf, "conversations")
    return turns.select(
        "conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"),
        T.output_budget(F.col("text"), F.lit(2000), F.lit(4096)).alias("budget"),
    )


@query("rendered_prompts", """SELECT conv_id, turn, 'Turn ' || turn || ' by {' || role || '}: ' || text AS prompt FROM conversations""")
def rendered_prompts(spark, sf):
    turns = t.table(spark, sf, "conversations")
    values = {c: F.col(c) for c in ("turn", "role", "text")}
    return turns.select("conv_id", "turn", T.render_prompt("Turn {turn} by {{{role}}}: {text}", values).alias("prompt"))


def _answers(spark, sf):
    """Model-like answers around each turn: fenced, in prose, cut short, or without JSON."""
    k = F.col("turn") % 4
    body = F.to_json(F.array(F.struct(F.lit("actor").alias("node_type"), F.col("role").alias("name"))))
    response = (
        F.when(k == 0, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(k == 1, F.concat(F.lit("The nodes are "), body, F.lit(" as asked.")))
        .when(k == 2, body.substr(F.lit(1), F.length(body) - 1))
        .otherwise(F.lit("I found nothing."))
    )
    return t.table(spark, sf, "conversations").select("conv_id", "turn", response.alias("response"))


@query("json_recovery", """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN '[{"node_type":"actor","name":"' || role || '"}]' END AS recovered,
  CASE WHEN turn % 4 < 3 THEN role END AS name FROM conversations""")
def json_recovery(spark, sf):
    good, bad = ql.recover(_answers(spark, sf), "list", "array<struct<node_type string, name string>>")
    read = good.select("conv_id", "turn", "recovered", F.col("parsed")[0]["name"].alias("name"))
    return read.unionByName(bad.select("conv_id", "turn"), allowMissingColumns=True)


# ---- citations ---------------------------------------------------------------------------


def _cited_items(spark, sf):
    """Per document: its last sentence as evidence, its first line as fact, two words as entity."""
    docs = t.table(spark, sf, "documents")
    last = T.strip(F.element_at(F.split("text", r"\. "), -1))
    line = F.substring_index("text", "\n", 1)
    entity = F.concat(F.lit("Nobody "), F.regexp_extract("text", r"([a-z]{5,})", 1))

    def item(kind, text, name):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), name.alias("name"))

    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id",
        F.inline(F.array(item("edge", last, none), item("fact", F.upper(line), none), item("node", none, entity))),
    ).withColumn("item_id", F.concat_ws("/", F.col("doc_id").cast("string"), "kind"))


def _contents(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))


@query("citation_exact", f"""WITH s AS (SELECT doc_id, text AS content, lower({_STRIP.format("list_extract(string_split(text, '. '), -1)")}) AS needle FROM documents),
p AS (SELECT *, CASE WHEN needle <> '' THEN strpos(lower(content), needle) ELSE 0 END AS found FROM s),
h AS (SELECT *, substr(content, 1, found - 1) AS head FROM p WHERE found > 0)
SELECT doc_id, CAST(found - 1 AS INTEGER) AS char_start, CAST(found - 1 + length(needle) AS INTEGER) AS char_end,
  CAST(length(head) - length(replace(head, '.', '')) + 1 AS INTEGER) AS sentence_num,
  CAST((length(head) - length(replace(head, chr(10) || chr(10), ''))) // 2 + 1 AS INTEGER) AS paragraph_num, 'exact' AS match_type FROM h""")
def citation_exact(spark, sf):
    items = _cited_items(spark, sf).where("kind = 'edge'")
    cited = ci.cite(items, _contents(spark, sf), fuzzy=False)
    return cited.where("citation is not null").select(
        "doc_id", "citation.char_start", "citation.char_end", "citation.sentence_num", "citation.paragraph_num",
        "citation.match_type",
    )


@query("citation_all_kinds", f"""WITH s AS (SELECT doc_id, text AS content, unnest([
    {{kind: 'edge', match_type: 'exact', needle: lower({_STRIP.format("list_extract(string_split(text, '. '), -1)")})}},
    {{kind: 'fact', match_type: 'exact', needle: lower(replace(string_split(text, chr(10))[1], 'ß', 'ss'))}},
    {{kind: 'node', match_type: 'partial', needle: regexp_extract(text, '([a-z]{{5,}})', 1)}}]) AS item FROM documents),
p AS (SELECT *, CASE WHEN item.needle <> '' THEN strpos(lower(content), item.needle) ELSE 0 END AS found FROM s),
h AS (SELECT *, substr(content, 1, found - 1) AS head FROM p WHERE found > 0)
SELECT doc_id, item.kind AS kind, CAST(found - 1 AS INTEGER) AS char_start, CAST(found - 1 + length(item.needle) AS INTEGER) AS char_end,
  CAST(length(head) - length(replace(head, '.', '')) + 1 AS INTEGER) AS sentence_num,
  CAST((length(head) - length(replace(head, chr(10) || chr(10), ''))) // 2 + 1 AS INTEGER) AS paragraph_num, item.match_type AS match_type FROM h""")
def citation_all_kinds(spark, sf):
    """Cited items of all kinds: edges, facts and nodes."""
    cited = ci.cite(_cited_items(spark, sf), _contents(spark, sf), fuzzy=False)
    return cited.where("citation is not null").select(
        "doc_id", "kind", "citation.char_start", "citation.char_end", "citation.sentence_num",
        "citation.paragraph_num", "citation.match_type",
    )


@query("citation_summary", f"""WITH s AS (SELECT lower(text) AS content, {_STRIP.format("list_extract(string_split(text, '. '), -1)")} AS last,
  string_split(text, chr(10))[1] AS line, regexp_extract(text, '([a-z]{{5,}})', 1) AS word FROM documents),
i AS (SELECT unnest([
  CASE WHEN last <> '' THEN 1.0 END,
  CASE WHEN line <> '' AND contains(content, lower(replace(line, 'ß', 'ss'))) THEN 1.0 END,
  CASE WHEN word <> '' THEN 0.8 END]) AS confidence FROM s)
SELECT CAST(count(*) AS BIGINT) AS total_citations, CAST(count_if(confidence = 1) AS BIGINT) AS exact_matches,
  CAST(count_if(confidence < 1) AS BIGINT) AS fuzzy_matches, CAST(count_if(confidence IS NULL) AS BIGINT) AS unmatched,
  round(coalesce(sum(CAST(confidence AS DOUBLE)), 0) / count(*), 6) AS avg_confidence FROM i""")
def citation_summary(spark, sf):
    cited = ci.cite(_cited_items(spark, sf), _contents(spark, sf), fuzzy=False)
    per_doc = ci.citation_summary(cited, ["doc_id"])
    merged = ci.merge_summaries(per_doc.withColumn("all", F.lit("all")), ["all"])
    return merged.drop("all").withColumn("avg_confidence", r6("avg_confidence"))


@query("citation_occurrences", """WITH RECURSIVE
s AS (SELECT doc_id, lower(text) AS t, regexp_extract(text, '([a-z]{5,})', 1) AS w FROM documents),
o AS (SELECT doc_id, t, w, strpos(t, w) AS p, 0 AS occurrence FROM s WHERE w <> ''
  UNION ALL
  SELECT doc_id, t, w, p + strpos(substr(t, p + 1), w), occurrence + 1 FROM o WHERE contains(substr(t, p + 1), w))
SELECT doc_id, CAST(occurrence AS INTEGER) AS occurrence, CAST(p - 1 AS INTEGER) AS char_start FROM o WHERE p > 0""")
def citation_occurrences(spark, sf):
    items = t.table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", r"([a-z]{5,})", 1).alias("text"))
    return ci.occurrences(items, _contents(spark, sf)).select("doc_id", "occurrence", "citation.char_start")


# ---- vectors -----------------------------------------------------------------------------

QUERY_VECTOR = [((i * 37) % 17 - 8) / 40 for i in range(64)]
_QV = "[" + ", ".join(repr(x) for x in QUERY_VECTOR) + "]"
_DIST = """list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - q[i]) * (CAST(embedding[i] AS DOUBLE) - q[i])))"""
_RANKED = f"""ranked AS (SELECT vec_id AS item_id, 'type_' || label AS item_type, {_DIST} AS d
  FROM embeddings, (SELECT CAST({_QV} AS DOUBLE[]) AS q))"""


def _scored(df):
    return df.select("item_id", "item_type", r6("score").alias("score"))


@query("vector_topk", f"WITH {_RANKED} SELECT item_id, item_type, round(1.0 / (1.0 + d), 6) AS score FROM ranked ORDER BY d, item_id LIMIT 10")
def vector_topk(spark, sf):
    return _scored(ve.search(t.vectors(spark, sf), QUERY_VECTOR, 10))


@query("vector_typed_topk", f"WITH {_RANKED} SELECT item_id, item_type, round(1.0 / (1.0 + d), 6) AS score FROM ranked WHERE item_type = 'type_3' ORDER BY d, item_id LIMIT 10")
def vector_typed_topk(spark, sf):
    return _scored(ve.search(t.vectors(spark, sf), QUERY_VECTOR, 10, "type_3"))


@query("vector_similar_item", f"""WITH r AS (SELECT vec_id AS item_id, 'type_' || label AS item_type, {_DIST} AS d
  FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7))
SELECT item_id, item_type, round(1.0 / (1.0 + d), 6) AS score FROM (SELECT * FROM r ORDER BY d, item_id LIMIT 11) WHERE item_id <> 7 ORDER BY d, item_id LIMIT 10""")
def vector_similar_item(spark, sf):
    return _scored(ve.similar_to_item(t.vectors(spark, sf), 7, 10))


def _vector_index(spark, sf):
    """A stored index in two batches: the second is added without reading the first."""
    rows = t.vectors(spark, sf)
    index = VectorIndex.create(rows.where("item_id % 2 = 0"), fresh_dir(spark, "vector_index"))
    index.add(rows.where("item_id % 2 <> 0"))
    return index


@query("vector_index_topk", ORACLES["vector_topk"])
def vector_index_topk(spark, sf):
    return _scored(_vector_index(spark, sf).search(QUERY_VECTOR, 10))


@query("vector_index_typed_topk", ORACLES["vector_typed_topk"])
def vector_index_typed_topk(spark, sf):
    return _scored(_vector_index(spark, sf).search(QUERY_VECTOR, 10, "type_3"))


@query("vector_index_similar_item", ORACLES["vector_similar_item"])
def vector_index_similar_item(spark, sf):
    return _scored(_vector_index(spark, sf).similar_to_item(7, 10))


@query("vector_index_items", "SELECT 'type_' || label AS item_type, CAST(count(*) AS BIGINT) AS items FROM embeddings GROUP BY label")
def vector_index_items(spark, sf):
    """Items by type from the index's cell table, without a scan of vectors."""
    return _vector_index(spark, sf).cells().groupBy("item_type").agg(F.sum("items").alias("items"))


@query("vector_stats", "SELECT 'type_' || label AS item_type, CAST(count(*) AS BIGINT) AS items, CAST(64 AS BIGINT) AS dimension FROM embeddings GROUP BY label")
def vector_stats(spark, sf):
    return ve.vector_statistics(t.vectors(spark, sf))


@query("unindexed_nodes", """SELECT 'node_' || p_partkey AS item_id,
  'Type: part Name: ' || p_name || ' brand: ' || p_brand || ' kind: ' || p_type || ' Context: size ' || p_size AS text
FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)""")
def unindexed_nodes(spark, sf):
    part = t.table(spark, sf, "part").select(
        F.concat(F.lit("node_"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("part").alias("type"),
        F.col("p_name").alias("name"), F.create_map(F.lit("kind"), "p_type", F.lit("brand"), "p_brand").alias("attributes"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("source_sentence"),
    )
    indexed = t.vectors(spark, sf).select(F.concat(F.lit("node_"), F.col("item_id").cast("string")).alias("item_id"))
    return ve.unindexed_nodes(part, indexed).select("item_id", "text")


# ---- hashes, lineage, manifests ----------------------------------------------------------


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS content_id FROM documents")
def content_hash(spark, sf):
    return t.table(spark, sf, "documents").select(
        "doc_id", H.content_hash(F.col("text")).alias("content_hash"), T.content_id(F.col("text")).alias("content_id")
    )


_WORDS = "||'|'||".join(
    f"CAST(sum(CAST(('0x' || substr(h, {16 * i + 1}, 16)) AS UBIGINT)) AS VARCHAR)" for i in range(4)
)


@query("derived_ids", f"""WITH {NODES}, ids AS (SELECT DISTINCT document_id, sha256(analysis_id) AS h FROM kg_nodes)
SELECT document_id, sha256({_WORDS} || '|' || count(*)) AS aggregation_id FROM ids GROUP BY document_id""")
def derived_ids(spark, sf):
    nodes = t.kg_nodes(spark, sf).select("document_id", "analysis_id").distinct()
    return nodes.groupBy("document_id").agg(H.id_set_digest(F.col("analysis_id")).alias("aggregation_id"))


@query("hmac_verify", """SELECT CASE WHEN text = '' THEN 'empty content' WHEN doc_id % 5 = 1 THEN 'content hash mismatch' WHEN doc_id % 5 = 2 THEN 'metadata mismatch'
  WHEN doc_id % 5 = 3 THEN 'signature mismatch' WHEN doc_id % 5 = 4 THEN 'no signature' ELSE 'verified' END AS outcome, CAST(count(*) AS BIGINT) AS total
FROM documents GROUP BY ALL""")
def hmac_verify(spark, sf):
    key = H.derive_key("test secret", b"0123456789abcdef")
    docs = t.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("content"), H.canonical_json("source", "lang").alias("metadata")
    )
    k = F.col("doc_id") % 5
    signed = ln.sign(docs, key, F.lit("2024-01-01T00:00:00Z")).where(k != 4).withColumn(
        "signature", F.when(k == 3, F.reverse("signature")).otherwise(F.col("signature"))
    )
    changed = docs.withColumns(
        {
            "content": F.when(k == 1, F.concat("content", F.lit("."))).otherwise(F.col("content")),
            "metadata": F.when(k == 2, F.concat("metadata", F.lit(" "))).otherwise(F.col("metadata")),
        }
    )
    checked = ln.verify(changed, signed, key).withColumn("outcome", F.coalesce("reason", F.lit("verified")))
    return ln.verification_summary(checked, ["outcome"]).select("outcome", "total")


@query("manifest_verify", """SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents) GROUP BY status""")
def manifest_verify(spark, sf):
    docs, k = t.table(spark, sf, "documents"), F.col("doc_id")
    path = F.format_string("content/%d.txt", k).alias("path")
    manifest = docs.select(path, F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("sha256"))
    text = F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    files = docs.where(k % 10 != 0).select(path, F.sha2(text, 256).alias("sha256"))
    return ln.verify_manifest(manifest, files).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("lineage_tree", """SELECT 'doc_' || o_custkey AS document_id, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS analyses,
  CAST(count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS BIGINT) AS aggregations FROM orders GROUP BY o_custkey""")
def lineage_tree(spark, sf):
    orders = t.table(spark, sf, "orders")
    doc = F.concat(F.lit("doc_"), F.col("o_custkey").cast("string")).alias("document_id")
    an = F.concat(F.lit("an_"), F.col("o_orderkey").cast("string")).alias("analysis_id")
    documents = t.table(spark, sf, "customer").select(F.concat(F.lit("doc_"), F.col("c_custkey").cast("string")).alias("document_id"))
    aggregations = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("aggregation_id"), an)
    return ln.derivation_map(ln.derivations(documents, orders.select(an, doc), aggregations))


@query("version_chain", """SELECT conv_id AS package, printf('v%03d', turn + 1) AS version, turn = 0 OR turn % 5 <> 4 AS ok FROM conversations""")
def version_chain(spark, sf):
    return ln.audit_versions(_versions(spark, sf))


@query("version_ancestry", """WITH RECURSIVE v AS (SELECT conv_id, turn, turn = 0 OR turn % 5 <> 4 AS ok FROM conversations),
c AS (SELECT conv_id, turn, ok AS valid FROM v WHERE turn = 0
  UNION ALL
  SELECT v.conv_id, v.turn, c.valid AND v.ok FROM c JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn + 1)
SELECT conv_id AS package, printf('v%03d', turn + 1) AS version, valid FROM c""")
def version_ancestry(spark, sf):
    return ln.valid_versions(_versions(spark, sf))


def _versions(spark, sf):
    turns = t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("package"), "turn", F.sha2("text", 256).alias("hash")
    )
    before = turns.select("package", (F.col("turn") + 1).alias("turn"), F.col("hash").alias("before"))
    return turns.join(before, ["package", "turn"], "left").select(
        "package", F.format_string("v%03d", F.col("turn") + 1).alias("version"), "hash",
        F.format_string("v%03d", "turn").alias("previous_version"),
        F.when(F.col("turn") % 5 == 4, "broken").otherwise(F.col("before")).alias("previous_hash"),
        (F.col("turn") == 0).alias("genesis"),
    )


@query("next_version", """SELECT printf('v%03d', max(CASE WHEN event_type <> 'error' THEN user_id END) + 1) AS version FROM (
  SELECT * FROM events WHERE ts = (SELECT max(ts) FROM events WHERE event_type <> 'error'))""")
def next_version(spark, sf):
    history = t.table(spark, sf, "events").select(
        F.format_string("v%03d", "user_id").alias("version"), (F.col("event_type") != "error").alias("success"),
        F.col("ts").alias("time"),
    )
    return ln.next_package_version(history)


# ---- roll-ups and review -----------------------------------------------------------------


@query("profile_grouping_sets", f"""WITH {NODES}
SELECT 'node_type' AS section, node_type AS value, CAST(count(*) AS BIGINT) AS n FROM kg_nodes GROUP BY node_type
UNION ALL SELECT 'event_type', name, CAST(count(*) AS BIGINT) FROM kg_nodes WHERE node_type = 'event' GROUP BY name
UNION ALL SELECT 'event_source', substr(document_id, 1, 6), CAST(count(*) AS BIGINT) FROM kg_nodes WHERE node_type = 'event' GROUP BY ALL
UNION ALL SELECT 'event_year', substr(timestamp, 1, 4), CAST(count(*) AS BIGINT) FROM kg_nodes WHERE node_type = 'event' GROUP BY ALL""")
def profile_grouping_sets(spark, sf):
    nodes = t.kg_nodes(spark, sf).withColumns(
        {"event_type": F.col("name"), "source": F.substring("document_id", 1, 6)}
    )
    return st.profile(nodes)


@query("status_rollup", """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS analyzed,
  (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS pending, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events) AS observations""")
def status_rollup(spark, sf):
    table = lambda n: t.table(spark, sf, n)
    return st.status_rollup(table("documents"), table("labels"), vectors=table("embeddings"), observations=table("events"))


@query("repository_stats", """SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM labels) AS total_analyses,
  CAST((SELECT sum(octet_length(encode(text))) FROM documents) AS BIGINT) AS total_size_bytes,
  round((SELECT sum(octet_length(encode(text))) FROM documents) / 1024.0 / 1024.0, 2) AS total_size_mb""")
def repository_stats(spark, sf):
    docs = _contents(spark, sf)
    return st.repository_statistics(docs, t.table(spark, sf, "labels"))


@query("top_sources", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, sf):
    return st.top_sources(t.table(spark, sf, "documents"))


_ANALYSES = """an AS (SELECT l.doc_id, 'an_' || l.doc_id AS analysis_id, 'template_' || (l.doc_id % 7) AS template_name, source,
  CASE WHEN toxic = 1 THEN 'REVIEW' WHEN quality = 0 THEN 'FAILED' ELSE 'VALID' END AS status
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _analyses(spark, sf):
    """Labelled documents as analyses: quality and toxicity give the validation status."""
    rows = t.table(spark, sf, "labels").join(t.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    none = F.lit(None).cast("string")
    status = F.when(F.col("toxic") == 1, "REVIEW").when(F.col("quality") == 0, "FAILED").otherwise("VALID")
    return rows.select(
        F.concat(F.lit("an_"), F.col("doc_id").cast("string")).alias("analysis_id"),
        F.concat(F.lit("template_"), (F.col("doc_id") % 7).cast("string")).alias("template_name"),
        F.struct(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source"), none.alias("title")).alias("article"),
        F.struct(
            status.alias("status"), F.lit("").alias("reason"), none.alias("template_status"), none.alias("approved_by"),
            none.alias("approved_at"), none.alias("rejected_by"), none.alias("rejected_at"), none.alias("notes"),
        ).alias("validation"),
        F.format_string("2024-01-%02dT%05d", (F.col("doc_id") % 28 + 1), "doc_id").alias("analyzed_at"),
        (F.col("doc_id") % 10).cast("double").alias("manipulation_score"), none.alias("concern_level"),
        F.array().cast("array<string>").alias("authoritarian_indicators"),
    )


@query("review_queue", f"WITH {_ANALYSES} SELECT analysis_id, template_name, status AS validation_status FROM an WHERE status = 'REVIEW'")
def review_queue(spark, sf):
    return st.review_queue(_analyses(spark, sf)).select("analysis_id", "template_name", "validation_status")


@query("review_decisions", f"""WITH {_ANALYSES}
SELECT analysis_id, CASE WHEN status = 'REVIEW' THEN CASE WHEN doc_id % 2 = 0 THEN 'VALID' ELSE 'REJECTED' END ELSE status END AS status,
       CASE WHEN status = 'REVIEW' AND doc_id % 2 = 0 THEN 'editor' END AS approved_by, CASE WHEN status = 'REVIEW' AND doc_id % 2 = 1 THEN 'editor' END AS rejected_by FROM an""")
def review_decisions(spark, sf):
    analyses = _analyses(spark, sf)
    number = F.substring("analysis_id", 4, 20).cast("bigint")
    decisions = st.review_queue(analyses).select(
        "analysis_id", (number % 2 == 0).alias("approve"), F.lit("editor").alias("actor"),
        F.lit("2024-02-01").alias("decided_at"), F.lit("").alias("notes"),
    )
    return st.apply_decisions(analyses, decisions).select(
        "analysis_id", "validation.status", "validation.approved_by", "validation.rejected_by"
    )


@query("template_approval", f"""WITH {_ANALYSES}
SELECT template_name, CASE WHEN status = 'REVIEW' AND template_name IN ('template_1', 'template_4') THEN 'VALID' ELSE status END AS status, CAST(count(*) AS BIGINT) AS n FROM an GROUP BY ALL""")
def template_approval(spark, sf):
    approvals = spark.createDataFrame(
        [("template_1", "editor", "2024-02-01"), ("template_4", "editor", "2024-02-01")], "template_name string, actor string, at string"
    )
    out = st.approve_templates(_analyses(spark, sf), approvals)
    return out.groupBy("template_name", "validation.status").agg(F.count(F.lit(1)).alias("n"))


@query("recent_analyses", f"""WITH {_ANALYSES}
SELECT analysis_id, source AS article_source, status AS validation_status, CAST(doc_id % 10 AS DOUBLE) AS manipulation_score
FROM an ORDER BY printf('2024-01-%02dT%05d', doc_id % 28 + 1, doc_id) DESC, analysis_id LIMIT 20""")
def recent_analyses(spark, sf):
    return st.recent_analyses(_analyses(spark, sf)).select(
        "analysis_id", "article_source", "validation_status", "manipulation_score"
    )


@query("validation_status", """WITH v AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'TESTING' ELSE 'PRODUCTION' END AS ts,
  count(DISTINCT CASE turn % 4 WHEN 0 THEN 'fact_extraction' WHEN 1 THEN 'article_analysis' WHEN 2 THEN 'node_extraction' END) AS have,
  max(CAST(contains(text, 'ERROR:') OR contains(text, 'FAILED:') OR contains(text, 'I cannot') OR contains(text, 'I''m unable') AS INT)) AS bad
  FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN ts = 'TESTING' THEN 'REVIEW' WHEN have < 3 OR bad = 1 THEN 'FAILED' ELSE 'VALID' END AS status FROM v""")
def validation_status(spark, sf):
    turn = F.col("turn") % 4
    name = F.when(turn == 0, "fact_extraction").when(turn == 1, "article_analysis").when(turn == 2, "node_extraction").otherwise("other")
    rounds = t.table(spark, sf, "conversations").select(
        "conv_id", F.when(F.col("conv_id") % 3 == 0, "TESTING").otherwise("PRODUCTION").alias("template_status"),
        F.lit(True).alias("has_article"), name.alias("name"), F.col("text").alias("response"),
        F.lit(None).cast("string").alias("error"),
    )
    return ql.validate_rounds(rounds, ["conv_id"]).select("conv_id", "status")


@query("mention_fields", f"""WITH {MENTIONS}
SELECT mention_seq, CASE WHEN source_bias IS NULL THEN 'Unknown' ELSE actor END AS actor, name AS action FROM mentions""")
def mention_fields(spark, sf):
    m = t.mentions(spark, sf)
    actors = F.when(F.col("source_bias").isNotNull(), F.array("actor")).otherwise(F.array().cast("array<string>"))
    return m.select(
        "mention_seq", T.primary_actor(actors, F.col("name")).alias("actor"),
        T.event_action(F.lit(""), F.col("name")).alias("action"),
    )
