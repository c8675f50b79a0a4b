"""Hosts, domains and URL tests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions.text import contains_any, strip


def host_name(value: Column) -> Column:
    """Lower-case host of a URL or bare domain, without user info and port; '' if none."""
    text = F.lower(strip(value))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    place = F.regexp_extract(full, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.regexp_extract(place, r"^(?:.*@)?(?:\[([^\]]*)\]|([^:]*))", 2)
    bracketed = F.regexp_extract(place, r"^(?:.*@)?\[([^\]]*)\]", 1)
    return F.coalesce(F.nullif(bracketed, F.lit("")), host)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def in_domain(url: Column, domain: Column) -> Column:
    """Is the URL on the domain or below it?  False when either has no host."""
    host, base = host_name(url), host_name(domain)
    inside = (host != "") & (base != "") & ((host == base) | host.endswith(F.concat(F.lit("."), base)))
    return F.coalesce(inside, F.lit(False))


def is_web_url(url: Column) -> Column:
    return url.startswith("https://") | url.startswith("http://")


def is_usable_url(
    url: Column, ignored: Iterable[str] = V.IGNORED_HOSTS, match: str = "suffix"
) -> Column:
    """A web URL outside the ignored hosts.

    ``substring`` rejects a host that contains a fragment anywhere, so ``x.com`` also
    rejects ``netflix.com``; ``suffix`` compares whole labels.  A fragment that ends
    in a dot stands for any top-level domain.
    """
    host = host_name(url)
    if match == "substring":
        hit = contains_any(host, ignored)
    elif match == "suffix":
        dotted = F.concat(F.lit("."), host)
        hit = reduce(or_, [
            dotted.contains(F.lit("." + f)) if f.endswith(".") else dotted.endswith(F.lit("." + f))
            for f in ignored
        ], F.lit(False))
    else:
        raise ValueError(f"match must be 'substring' or 'suffix', not {match!r}")
    return is_web_url(url) & ~hit


def is_policy_page(
    final_url: Column, title: Column, text: Column, keywords: Iterable[str],
    evidence_chars: int | None = None, min_chars: int = V.MIN_BODY_CHARS,
) -> Column:
    """A policy keyword in URL, title or text, and a body of some length.

    ``evidence_chars`` looks at the opening of the text only; ``EVIDENCE_TEXT_CHARS`` is
    the value that a page check with a bounded cost per page uses.
    """
    opening = text if evidence_chars is None else F.substring(text, 1, evidence_chars)
    evidence = F.lower(F.concat_ws(
        "\n", final_url, F.coalesce(title, F.lit("")), opening,
    ))
    long_enough = F.length(strip(text)) >= min_chars
    return long_enough & contains_any(evidence, [k.lower() for k in keywords])
