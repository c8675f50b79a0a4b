"""Article and section labels of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions.text import strip

ARTICLE = rf"제{V.WS}*(\p{{Nd}}+{V.WS}*조(?:{V.WS}*의{V.WS}*\p{{Nd}}+)?)"
SECTION = rf"(?md)^{V.WS}*({V.SECTION_NUMBER}){V.WS}+"
BRACKET = rf"^{V.WS}*\[([^\]\r\n]{{1,100}})\]"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _tight(text: Column) -> Column:
    return F.regexp_replace(text, V.WS + "+", "")


def article_label(chunk: Column) -> Column:
    """``제N조[의M]``, else the first numbered section, else a leading ``[heading]``."""
    bracket = F.when(
        _found(chunk, BRACKET, 0).isNotNull(),
        F.concat(F.lit("["), strip(F.regexp_extract(chunk, BRACKET, 1)), F.lit("]")),
    )
    return F.coalesce(
        _tight(_found(chunk, ARTICLE, 0)), _found(chunk, SECTION, 1), bracket, F.lit("unknown")
    )


def article_number(chunk: Column) -> Column:
    """The label in the form used for filtering: ``12조의3`` or ``2.7``."""
    return F.coalesce(
        _tight(_found(chunk, ARTICLE, 1)),
        F.rtrim(_found(chunk, SECTION, 1), F.lit(".")),
        F.lit("unknown"),
    )
