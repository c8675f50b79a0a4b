"""Checked queries over hosts, official domains, pages and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import names, urls
from clauseflow.operators import selection
from clauseflow.plans import jobs, shapes as S
from clauseflow.plans.registry import checked, table, texts
from clauseflow.session import scratch_dir, written
from clauseflow.sources import html
from clauseflow.sources.store import ChunkStore

MIN_CHARS = 700  # some pages are shorter
WORDS = {"terms": ("queque", "onth", "terms of use"), "privacy": ("erer", "ciónción", "privacy policy")}

_HOST = "regexp_extract(url, '://([^/]+)', 1)"
_LABEL = "regexp_extract(url, '([a-z-]+)[.]example', 1)"
_DOMAIN = "regexp_extract(url, '([^./]+[.]example[.][a-z]+)', 1)"


def _label(url="url"):
    return F.regexp_extract(url, r"([a-z-]+)[.]example", 1)


def _domain(url="url"):
    return F.regexp_extract(url, r"([^./]+[.]example[.][a-z]+)", 1)


# ----------------------------------------------------------------------- hosts
@checked(f"""
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '' ELSE {_HOST} END AS host FROM pages""")
def host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper case, bare hosts, user info and ports are all read as the plain host."""
    i, host = F.col("page_id") % 5, F.regexp_extract("url", "://([^/]+)", 1)
    value = (
        F.when(i == 0, F.concat(F.lit(" "), F.upper("url")))
        .when(i == 1, host)
        .when(i == 2, F.concat(F.lit("ftp://me:pw@"), host, F.lit(":8080/x?y=http://z")))
        .when(i == 3, F.concat(host, F.lit("/a#b")))
        .otherwise("  ")
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.host_name(value).alias("host"))


@checked(f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS inside FROM pages""")
def in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, domain = F.col("page_id") % 4, _domain()
    asked = (
        F.when(i == 0, domain).when(i == 1, F.concat(F.lit("https://"), domain, F.lit("/")))
        .when(i == 2, F.expr("substring(url, 9, 1)")).otherwise("")
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.in_domain(F.col("url"), asked).alias("inside"))


_HOSTS = ("netflix.com", "x.com", "blog.naver.com", "www.google.co.kr", "mybing.com", "a.example.org")


@checked("""
SELECT page_id, page_id % 3 <> 2 AND page_id % 6 NOT IN (1, 2, 3) AS by_suffix, page_id % 3 <> 2 AND page_id % 6 = 5 AS by_substring
FROM (SELECT page_id FROM pages)""")
def usable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    url = F.concat(S.pick(("https://", "http://", "ftp://"), i), S.pick(_HOSTS, i), F.lit("/p"))
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.is_usable_url(url, match="suffix").alias("by_suffix"),
        urls.is_usable_url(url, match="substring").alias("by_substring"),
    )


# ------------------------------------------------------------- official domains
def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as one search response with three results and one odd item."""
    i, host = F.col("page_id"), F.regexp_extract("url", "://([^/]+)", 1)

    def result(url, title):
        return F.to_json(F.struct(url.alias("url"), title.alias("title"), F.lit("some words").alias("content")))

    root = F.concat(F.lit("https://"), host, F.lit("/"))
    items = F.concat_ws(
        ",",
        result(F.when(i % 4 == 0, root).otherwise(F.col("url")), F.when(i % 3 == 0, F.lit("Official site")).otherwise("Site")),
        F.lit('"not an object"'),
        result(F.concat(F.lit("https://en.wikipedia.org/wiki/"), i.cast("string")), F.lit("공식")),
        result(F.concat(F.lit("https://other-"), _label(), F.lit(".org?p="), i.cast("string")), F.lit("공식")),
    )
    return table(spark, sf_dir, "pages").select(
        F.when(i % 2 == 0, _label()).otherwise(F.concat(F.lit("The "), _label(), F.lit("!"))).alias("service_name"),
        i.alias("query_no"),
        F.when(i % 10 == 9, F.lit('{"results": "none"}')).otherwise(F.concat(F.lit('{"results":['), items, F.lit("]}"))).alias("response"),
    )


_RESULTS = f"""
raw AS (SELECT page_id, url AS u, {_HOST} AS host, {_LABEL} AS label, CASE WHEN page_id % 2 = 0 THEN {_LABEL} ELSE 'The ' || {_LABEL} || '!' END AS service_name
        FROM pages WHERE page_id % 10 <> 9),
results AS (
  SELECT service_name, page_id AS query_no, 0 AS rank, CASE WHEN page_id % 4 = 0 THEN 'https://' || host || '/' ELSE u END AS url,
         CASE WHEN page_id % 3 = 0 THEN 'Official site' ELSE 'Site' END AS title FROM raw
  UNION ALL SELECT service_name, page_id, 1, 'https://en.wikipedia.org/wiki/' || page_id, '공식' FROM raw
  UNION ALL SELECT service_name, page_id, 2, 'https://other-' || label || '.org?p=' || page_id, '공식' FROM raw),
scored AS (
  SELECT service_name, query_no, rank, url, split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1) AS host,
    20 - rank
    + CASE WHEN contains(regexp_replace(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '[^0-9a-z]', '', 'g'),
                         regexp_replace(lower(service_name), '[^0-9a-z]', '', 'g')) THEN 80 ELSE 0 END
    + CASE WHEN title IN ('Official site', '공식') THEN 25 ELSE 0 END
    + CASE WHEN url LIKE 'https://%/' AND length(url) - length(replace(url, '/', '')) = 3 THEN 10 WHEN url LIKE '%.org?p=%' THEN 10 ELSE 0 END AS score
  FROM results WHERE url NOT LIKE '%wikipedia.org%')"""


@checked(f"WITH {_RESULTS} SELECT service_name, query_no, rank, url, title FROM results")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.flatten_results(search_responses(spark, sf_dir), ["service_name", "query_no"])
    return found.select("service_name", "query_no", "rank", "url", "title")


@checked(f"WITH {_RESULTS} SELECT service_name, query_no, rank, host, score FROM scored")
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.flatten_results(search_responses(spark, sf_dir), ["service_name", "query_no"])
    return selection.score_domains(found).select("service_name", "query_no", "rank", "host", "score")


@checked(f"""
WITH {_RESULTS},
best AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY score DESC, query_no, rank) AS n FROM scored)
SELECT service_name, host AS domain, score FROM best WHERE n = 1 AND score >= 60""")
def official_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.flatten_results(search_responses(spark, sf_dir), ["service_name", "query_no"])
    return selection.pick_domains(selection.score_domains(found))


@checked(f"""
WITH {_RESULTS},
best AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY score DESC, query_no, rank) AS n FROM scored),
found AS (SELECT service_name, host FROM best WHERE n = 1 AND score >= 60),
asked AS (SELECT page_id, {_LABEL} AS label, CASE WHEN page_id % 5 = 0 THEN 'Disney +' ELSE {_LABEL} END AS service_name,
                 {_DOMAIN} AS domain, {_HOST} AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN a.domain WHEN page_id % 5 = 0 THEN 'disneyplus.com' WHEN page_id % 4 = 0 THEN a.host ELSE f.host END AS domain
FROM asked a LEFT JOIN found f USING (service_name)""")
def resolved_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given domain, profile, host of the explicit URL, discovered domain.

    'Disney +' has the compact form of the alias 'disney+', so its profile is found.
    """
    i = F.col("page_id")
    found = selection.pick_domains(selection.score_domains(
        selection.flatten_results(search_responses(spark, sf_dir), ["service_name", "query_no"])
    ))
    asked = table(spark, sf_dir, "pages").select(
        "page_id", F.when(i % 5 == 0, "Disney +").otherwise(_label()).alias("service_name"),
        F.when(i % 3 == 0, F.concat(F.lit(" "), _domain())).otherwise("").alias("given_domain"),
        F.when((i % 4 == 0) & (i % 5 != 0), F.col("url")).alias("explicit_url"),
    )
    return selection.resolve_domains(asked, found).select("page_id", "domain")


# ------------------------------------------------------------------------ pages
def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with their whole text; every seventh was redirected away."""
    i = F.col("page_id")
    text = html.element_text(F.col("html"), "article")
    return texts(spark, sf_dir, "pages", "page_id", "url", "html").select(
        "page_id", "url",
        F.when(i % 7 == 0, F.concat(F.lit("https://elsewhere.net/"), i.cast("string"))).otherwise(F.col("url")).alias("final_url"),
        F.lit("").alias("title"),
        text.alias("text"),
    )


def sql_element_text(tag: str) -> str:
    text = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}>|\\z)', 1)"
    text = f"regexp_replace({text}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)<br[^>]*>|</?(p|div|li|ul|h[1-6]|article|nav|footer)(\\s[^>]*)?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    text = f"regexp_replace({text}, '{html.OPEN_ENTITIES}', '&\\1;', 'g')"
    for entity, char in html.ENTITIES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    text = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    return S.sql_strip(f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')")


_FETCHED = f"""
fetched AS (
  SELECT page_id, url, {_LABEL} AS service_name, {_DOMAIN} AS domain, ['terms', 'privacy'][page_id % 2 + 1] AS kind,
    CASE WHEN page_id % 7 = 0 THEN 'https://elsewhere.net/' || page_id ELSE url END AS final_url,
    t AS text
  FROM (SELECT *, {sql_element_text('article')} AS t FROM pages)),
tested AS (
  SELECT *, page_id % 7 <> 0 AS inside, length({S.sql_strip('text')}) >= {MIN_CHARS}
    AND CASE kind WHEN 'terms' THEN {S.sql_any("lower(final_url || chr(10) || chr(10) || text)", WORDS['terms'])}
                  ELSE {S.sql_any("lower(final_url || chr(10) || chr(10) || text)", WORDS['privacy'])} END AS policy
  FROM fetched)"""


@checked(f"WITH {_FETCHED} SELECT page_id, policy FROM tested")
def policy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _fetched(spark, sf_dir)
    test = {k: urls.is_policy_page(F.col("final_url"), F.col("title"), F.col("text"), w, min_chars=MIN_CHARS) for k, w in WORDS.items()}
    return pages.select("page_id", F.when(F.col("page_id") % 2 == 0, test["terms"]).otherwise(test["privacy"]).alias("policy"))


@checked(f"WITH {_FETCHED} SELECT page_id, inside AND policy AS accepted FROM tested")
def accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = S.pick(("terms", "privacy"), F.col("page_id"))
    return _fetched(spark, sf_dir).select("page_id", selection.page_accepted(
        F.col("final_url"), F.col("title"), F.col("text"), _domain(), kind, WORDS, min_chars=MIN_CHARS
    ).alias("accepted"))


def _with_keys(pages: DataFrame) -> DataFrame:
    i = F.col("page_id")
    return pages.select(
        "*", _label().alias("service_name"), S.pick(("terms", "privacy"), i).alias("kind"), _domain().alias("domain"), i.alias("rank")
    )


@checked(f"""
WITH {_FETCHED}, u AS (SELECT service_name, kind, CASE WHEN page_id % 6 = 5 THEN final_url ELSE url END AS url, min(page_id) AS rank
  FROM fetched WHERE NOT (page_id % 6 = 5 AND page_id % 7 = 0) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY service_name, kind ORDER BY rank, url) AS place FROM u""")
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page twice in the results; some were found under an address off the domain."""
    listed = _with_keys(_fetched(spark, sf_dir)).withColumn(
        "url", F.when(F.col("page_id") % 6 == 5, F.col("final_url")).otherwise(F.col("url"))
    ).select("service_name", "kind", "domain", "url", "rank")
    again = listed.withColumn("rank", F.col("rank") + 1000000)
    return selection.search_candidates(listed.unionByName(again)).select("service_name", "kind", "url", "rank", "place")


@checked(f"""
WITH {_FETCHED},
tried AS (SELECT *, page_id % 3 AS priority, bool_or(page_id % 3 = 0) OVER (PARTITION BY service_name, kind) AS given FROM tested),
good AS (SELECT * FROM tried WHERE CASE priority WHEN 0 THEN text <> '' WHEN 1 THEN NOT given AND inside AND policy ELSE inside AND policy END)
SELECT service_name, kind, page_id, final_url FROM good
QUALIFY row_number() OVER (PARTITION BY service_name, kind ORDER BY priority, page_id, url) = 1""")
def chosen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _fetched(spark, sf_dir)
    candidates = _with_keys(pages).select(
        "service_name", "kind", "domain", "rank", "url", (F.col("page_id") % 3).alias("priority")
    )
    return selection.choose_pages(candidates, pages, WORDS, min_chars=MIN_CHARS).select("service_name", "kind", "page_id", "final_url")


@checked(f"""
WITH {_FETCHED},
tried AS (SELECT *, page_id % 3 AS priority, bool_or(page_id % 3 = 0) OVER (PARTITION BY service_name, kind) AS given FROM tested),
good AS (SELECT service_name, kind, text, final_url FROM tried
         WHERE CASE priority WHEN 0 THEN text <> '' WHEN 1 THEN NOT given AND inside AND policy ELSE inside AND policy END
         QUALIFY row_number() OVER (PARTITION BY service_name, kind ORDER BY priority, page_id, url) = 1)
SELECT service_name, coalesce(bool_or(kind = 'terms'), false) AS has_terms, coalesce(bool_or(kind = 'privacy'), false) AS has_privacy
FROM (SELECT DISTINCT service_name FROM fetched) LEFT JOIN good USING (service_name) GROUP BY service_name""")
def prepared_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an empty store: pages are chosen, written as policy files, read back, ingested; then the status."""
    pages = written(_fetched(spark, sf_dir), "fetched")
    candidates = _with_keys(pages).select(
        "service_name", "kind", "domain", "rank", "url", (F.col("page_id") % 3).alias("priority")
    )
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    status = jobs.prepare_services(
        store, candidates.select("service_name"), candidates, pages, scratch_dir(spark, "policies"), keywords=WORDS, min_chars=MIN_CHARS
    )
    return status.select("service_name", "has_terms", "has_privacy")


_PROFILE_URLS = ", ".join(
    f"('{names._compact(a)}', '{k}', {n}, '{u}')"
    for p in V.SERVICE_PROFILES for a in dict.fromkeys(names._compact(x) for x in p["aliases"])
    for k, us in p["policy_urls"].items() for n, u in enumerate(us)
)


@checked(f"""
WITH known(k, kind, rank, url) AS (VALUES {_PROFILE_URLS}),
asked AS (SELECT DISTINCT trim({S.sql_pick(S.SERVICES, 'doc_id')}) AS service_name, ['terms', 'privacy'][doc_id % 2 + 1] AS kind FROM documents)
SELECT service_name, asked.kind, rank, url FROM asked JOIN known
  ON k = regexp_replace(lower(service_name), '[^0-9a-z가-힣]', '', 'g') AND known.kind = asked.kind""")
def known_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    asked = table(spark, sf_dir, "documents").select(
        F.trim(S.pick(S.SERVICES, i)).alias("service_name"), S.pick(("terms", "privacy"), i).alias("kind"), F.lit("").alias("domain")
    ).distinct()
    return selection.known_candidates(asked).select("service_name", "kind", "rank", "url")


@checked("""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'static ' || text ELSE text END AS text FROM conversations""")
def preferred_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.when(F.col("turn") % 3 != 0, F.col("text")).when(F.col("turn") % 2 == 0, F.lit(" \n"))
    static = F.concat(F.lit("static "), "text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", selection.rendered_or_static(rendered, static).alias("text")
    )


@checked(f"""
SELECT page_id, CASE WHEN length(a) >= 200 THEN a WHEN length(m) >= 200 THEN m WHEN length(b) >= 200 THEN b ELSE '' END AS text
FROM (SELECT page_id, {sql_element_text('article')} AS a, {sql_element_text('main')} AS m, {sql_element_text('body')} AS b FROM pages)""")
def builtin_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", html.builtin_main_text(F.col("html")).alias("text"))


@checked(f"""
SELECT page_id, length(regexp_replace(CASE WHEN length(a) >= 200 THEN a WHEN length(b) >= 200 THEN b ELSE '' END, '{V.WS}', '', 'g')) AS ink
FROM (SELECT page_id, {sql_element_text('article')} AS a, {sql_element_text('body')} AS b FROM pages)""")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser's choice; the SQL counts its visible characters."""
    text = html.main_text(F.col("html"))
    ink = F.length(F.regexp_replace(text, V.WS, "")).cast("long")
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", ink.alias("ink"))
