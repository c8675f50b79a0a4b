"""Service names: canonical spelling, aliases, profiles, display form, folder form."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseflow import vocab as V
from clauseflow.functions.text import lookup, strip


def has_hangul(text: Column) -> Column:
    return text.rlike(V.HANGUL)


def canonical_name(name: Column, aliases: Mapping[str, str] = V.SERVICE_ALIASES) -> Column:
    """The Hangul spelling of a known service; null for a blank name."""
    cleaned = strip(name)
    alias = lookup(F.lower(cleaned), aliases)
    return F.when(
        cleaned != "",
        F.when(has_hangul(alias), alias)
        .when(has_hangul(cleaned), cleaned)
        .otherwise(F.coalesce(alias, cleaned)),
    )


def alias_names(name: Column, aliases: Mapping[str, str] = V.SERVICE_ALIASES) -> Column:
    """The name and its other spelling, if it has one."""
    both = F.array_compact(F.array(name, lookup(F.lower(name), aliases)))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(both)
    )


def compact_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^0-9a-z\x{ac00}-\x{d7a3}]", "")


def _compact(name: str) -> str:
    return "".join(c for c in name.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz" or "가" <= c <= "힣")


def profile_domain(name: Column, profiles: Sequence[Mapping] = V.SERVICE_PROFILES) -> Column:
    """Official domain of the first profile with this alias, null if there is none."""
    table: dict[str, str] = {}
    for profile in profiles:
        for alias in profile["aliases"]:
            table.setdefault(_compact(alias), profile["official_domain"])
    return lookup(compact_name(name), table)


def profile_urls(domain: Column, kind: Column, profiles: Sequence[Mapping] = V.SERVICE_PROFILES) -> Column:
    """Known policy pages of a profile, by its domain and the policy kind."""
    pairs = []
    for profile in profiles:
        for policy_kind, urls in profile["policy_urls"].items():
            pairs += [
                F.lit(f"{profile['official_domain']} {policy_kind}"),
                F.array(*[F.lit(u) for u in urls]),
            ]
    return F.element_at(F.create_map(*pairs), F.concat_ws(" ", domain, kind))


def display_name(name: Column, table: Sequence[tuple[str, str]] = V.DISPLAY_NAMES) -> Column:
    trimmed = strip(name)
    lowered = F.lower(trimmed)
    picks = [F.when(lowered.contains(F.lit(key)), F.lit(shown)) for key, shown in table]
    return F.when(trimmed.rlike(r"\(.*\)"), trimmed).otherwise(F.coalesce(*picks, trimmed))


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def folder_name(name: Column) -> Column:
    """The name made safe as a folder: compatibility form, forbidden characters to ``_``.

    Only names outside ASCII are sent to Python: ASCII is its own NFKC form.
    """
    ascii_only = name.rlike(r"^[\x00-\x7f]*$")
    form = F.when(ascii_only, name).otherwise(_nfkc(F.when(~ascii_only, name)))
    safe = F.regexp_replace(strip(form), r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.rtrim(safe, F.lit(". ")), F.lit("")), F.lit(V.UNNAMED_SERVICE))
