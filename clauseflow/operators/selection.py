"""Choosing official domains and policy pages from search results and fetched pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import names, text as tx, urls

_RESPONSE = "results array<struct<url:string,title:string,content:string>>"


def flatten_results(responses: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(keys, response JSON) to one row per result that is an object, with its rank.

    The items are first read as raw JSON, so that one odd item does not lose the rest.
    """
    keys = list(keys)
    raw = F.from_json(F.get_json_object("response", "$.results"), "array<string>")
    objects = F.filter(raw, lambda item: F.ltrim(item).startswith("{"))
    fields = "url string, title string, content string"
    item = F.from_json("_item", fields)
    return (
        responses.select(*keys, F.posexplode_outer(objects).alias("rank", "_item"))
        .where(F.col("_item").isNotNull())
        .select(*keys, "rank", F.inline_outer(F.array(item)))
        .select(
            *keys, "rank",
            *[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "content")],
        )
    )


def domain_score(service: Column, rank: Column, url: Column, title: Column, content: Column) -> Column:
    """How likely a result is the official home page of the service."""
    key = names.compact_name(service)
    host = F.regexp_replace(urls.host_name(url), r"[^0-9a-z\x{ac00}-\x{d7a3}]", "")
    said = F.lower(F.concat_ws(" ", title, content))
    return (
        F.lit(V.DOMAIN_BASE) - rank
        + F.when((key != "") & F.contains(host, key), V.DOMAIN_NAME).otherwise(0)
        + F.when(tx.contains_any(said, V.OFFICIAL_WORDS), V.DOMAIN_OFFICIAL).otherwise(0)
        + F.when(urls.url_path(url).isin("", "/"), V.DOMAIN_ROOT).otherwise(0)
    ).cast("int")


def score_domains(results: DataFrame, match: str = "suffix") -> DataFrame:
    """(service_name, query_no, rank, url, title, content): usable results with host and score."""
    score = domain_score(*[F.col(c) for c in ("service_name", "rank", "url", "title", "content")])
    return (
        results.where(urls.is_usable_url(F.col("url"), match=match))
        .withColumn("host", urls.host_name(F.col("url")))
        .withColumn("score", score)
    )


def _first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """First row per key; Spark keeps one row per key and task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def pick_domains(scored: DataFrame, min_score: int = V.DOMAIN_MIN_SCORE) -> DataFrame:
    """Best host per service over all its queries, if it is good enough."""
    best = _first(scored, ["service_name"], F.desc("score"), "query_no", "rank")
    return best.where(F.col("score") >= min_score).select("service_name", F.col("host").alias("domain"), "score")


def resolve_domains(services: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """(service_name, given_domain, explicit_url) with the domain to search, first source wins."""
    if discovered is not None:
        services = services.join(
            discovered.select("service_name", F.col("domain").alias("_found")), "service_name", "left"
        )
    else:
        services = services.withColumn("_found", F.lit(None).cast("string"))
    none = F.lit("")
    return services.withColumn("domain", F.coalesce(
        F.nullif(urls.host_name(F.col("given_domain")), none),
        names.profile_domain(F.col("service_name")),
        F.nullif(urls.host_name(F.col("explicit_url")), none),
        F.col("_found"),
    )).drop("_found")


def search_candidates(results: DataFrame, limit: int | None = None) -> DataFrame:
    """(service_name, kind, domain, url, rank): distinct in-domain URLs in rank order.

    All of them, unless a ``limit`` per service and kind is asked for.
    """
    keys = ["service_name", "kind"]
    first = (
        results.where(urls.in_domain(F.col("url"), F.col("domain")))
        .groupBy(*keys, "domain", "url").agg(F.min("rank").alias("rank"))
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "url"))
    placed = first.withColumn("place", place)
    return placed if limit is None else placed.where(F.col("place") <= limit)


def known_candidates(services: DataFrame) -> DataFrame:
    """(service_name, kind, domain) to the known policy pages of its profile."""
    listed = names.profile_urls(names.profile_domain(F.col("service_name")), F.col("kind"))
    return services.select("service_name", "kind", "domain", F.posexplode(listed).alias("rank", "url"))


def rendered_or_static(rendered: Column, static: Column) -> Column:
    """Rendered text unless it is blank, then the static one."""
    return F.when(~tx.is_blank(rendered), rendered).otherwise(static)


def page_accepted(
    final_url: Column, title: Column, text: Column, domain: Column, kind: Column,
    keywords: Mapping[str, Iterable[str]] = V.POLICY_KEYWORDS, evidence_chars: int | None = None,
    min_chars: int = V.MIN_BODY_CHARS,
) -> Column:
    """Still on the domain after redirects, and a policy of the requested kind."""
    tests = [(kind == k) & urls.is_policy_page(final_url, title, text, words, evidence_chars, min_chars) for k, words in keywords.items()]
    right_kind = tests[0]
    for test in tests[1:]:
        right_kind = right_kind | test
    return urls.in_domain(final_url, domain) & right_kind


# Candidate priorities.
EXPLICIT, KNOWN, SEARCHED = 0, 1, 2


def choose_pages(
    candidates: DataFrame, pages: DataFrame,
    keywords: Mapping[str, Iterable[str]] = V.POLICY_KEYWORDS, evidence_chars: int | None = None,
    min_chars: int = V.MIN_BODY_CHARS,
) -> DataFrame:
    """First acceptable page per service and kind.

    candidates(service_name, kind, domain, priority, rank, url), pages(url, final_url,
    title, text) with one row per URL.  An explicit URL only has to give text; where one was given, known
    URLs are not tried, but search results are.

    Acceptance is a column that sorts first and is tested after the cut.  As a filter
    it would be pushed below the join and evaluate the page text once per keyword.
    """
    keys = ["service_name", "kind"]
    explicit = candidates.where(F.col("priority") == EXPLICIT).select(*keys).distinct()
    tried = candidates.where(F.col("priority") != KNOWN).unionByName(
        candidates.where(F.col("priority") == KNOWN).join(explicit, keys, "left_anti")
    )
    fetched = tried.join(pages, "url")
    given = (F.col("priority") == EXPLICIT) & urls.is_web_url(F.col("url")) & ~tx.is_blank(F.col("text"))
    found = (F.col("priority") != EXPLICIT) & page_accepted(
        *[F.col(c) for c in ("final_url", "title", "text", "domain", "kind")], keywords, evidence_chars, min_chars
    )
    judged = fetched.withColumn("_fits", F.coalesce(given | found, F.lit(False)))
    # Only narrow rows are sorted; the winners' texts are looked up again.
    best = _first(judged.drop("title", "text"), keys, F.desc("_fits"), "priority", "rank", "url").where("_fits")
    return best.drop("_fits").join(pages.select("url", "title", "text"), "url")
