"""Cleaning, hashing, ids, quality gates and classification of text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseflow import vocab as V

# A word boundary spelled out, so that it does not depend on the JVM's ``\b``.
_EDGE = f"(?:(?<={V.WORD})(?!{V.WORD})|(?<!{V.WORD})(?={V.WORD}))"
# The class names printable ASCII first, which decides most characters at once.
_INK = f"[!-~{V.NON_WS}]"
_DOUBLED_LABEL = f"{_EDGE}({_INK}{{2,10}})\\1{_EDGE}"


def strip(text: Column) -> Column:
    """Trim every kind of white space; touches only the two ends of the string."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def without_whitespace(text: Column) -> Column:
    return F.translate(text, V.WHITESPACE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(F.lit(w)) for w in words], F.lit(False))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a fixed small table, null if absent.  A literal map, so no join."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def upper_letters(text: Column) -> Column:
    """Capitals letter by letter, so the length stays: ``ß`` becomes ``ẞ``; a letter without a capital of its own stays."""
    letters = F.transform(
        F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, V.LONG_UPPER, V.LONG_UPPER_LETTERS)).otherwise(F.upper(c))
    )
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.upper(text)).otherwise(F.array_join(letters, ""))


def squeeze_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(text, r"\n{2,}", "\n")


def clean_text(text: Column) -> Column:
    """Collapse blanks, blank lines and directly doubled labels, then trim."""
    return strip(F.regexp_replace(squeeze_spaces(text), _DOUBLED_LABEL, "$1"))


def document_hash(text: Column) -> Column:
    """MD5 of the text without any white space."""
    return F.md5(without_whitespace(text))


def chunk_id(source: Column, index: Column, chunk: Column) -> Column:
    return F.sha1(F.concat_ws("::", source, index.cast("string"), F.sha1(chunk)))


def pasted_source_id(service: Column, text: Column) -> Column:
    return F.concat_ws("::", F.lit("pasted"), strip(service), F.substring(F.sha1(text), 1, 12))


def upload_source_id(service: Column, file_name: Column, raw_text: Column) -> Column:
    """The hash is taken from the text as it was uploaded, before cleaning."""
    return F.concat_ws(
        "::", F.lit("upload"), strip(service), file_name,
        F.substring(document_hash(raw_text), 1, 12),
    )


def scope(text: Column, markers: Iterable[str] = V.SHARED_SCOPE_MARKERS) -> Column:
    return F.when(contains_any(text, markers), "shared").otherwise("service_specific")


def script_share(text: Column, script: str = V.HANGUL) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(script)) / F.length(text)).otherwise(0.0)


def is_readable(
    text: Column, script: str = V.HANGUL, min_chars: int = 100, min_share: float = 0.1
) -> Column:
    """Is recognised text long enough and mostly in the expected script?"""
    return (F.length(strip(text)) >= min_chars) & (script_share(text, script) >= min_share)


def without_spaces(text: Column) -> Column:
    """Keyword matching ignores the plain space only."""
    return F.replace(text, F.lit(" "), F.lit(""))


def keywords_in(text: Column, keywords: Iterable[str] = V.DOMAIN_KEYWORDS) -> Column:
    """The keywords that occur in the text, in table order, spaces ignored."""
    flat = without_spaces(text)
    hits = [F.when(flat.contains(F.lit(k.replace(" ", ""))), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*hits))


def keyword_matches(text: Column, keywords: Column) -> Column:
    """How many of the given keywords occur in the text, spaces ignored."""

    def count(flat: Column) -> Column:
        return F.size(F.filter(keywords, lambda k: flat.contains(F.replace(k, F.lit(" "), F.lit("")))))

    # Through an array of one, so that the text is rewritten once and not per keyword.
    return F.element_at(F.transform(F.array(without_spaces(text)), count), 1)


def keyword_bits(text: Column, keywords: Iterable[str] = V.DOMAIN_KEYWORDS) -> Column:
    """A bit for each keyword of the table that occurs in the text, 63 to a number."""
    flat, table = without_spaces(text), list(keywords)

    def number(some: list[str]) -> Column:
        bits = [F.when(flat.contains(F.lit(k.replace(" ", ""))), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, k in enumerate(some)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.array(*[number(table[at:at + 63]) for at in range(0, len(table), 63)]).cast("array<long>")


def common_bits(a: Column, b: Column) -> Column:
    """How many keywords two texts share, by their bits of one table."""
    both = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda total, n: total + n)


def first_label(text: Column, table: Mapping[str, Iterable[str]], default: str) -> Column:
    """The first label, in table order, with a word that occurs in the text."""
    picks = [F.when(contains_any(text, words), F.lit(label)) for label, words in table.items()]
    return F.coalesce(*picks, F.lit(default))


def faq_subtype(category: Column, question: Column, answer: Column,
                table: Mapping[str, Iterable[str]] = V.DOC_SUBTYPE_KEYWORDS) -> Column:
    """A category that is itself a subtype wins; else the words of question and answer."""
    both = F.lower(F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))))
    return F.when(category.isin(*table), category).otherwise(first_label(both, table, "unknown"))


def category(problem_type: Column) -> Column:
    return first_label(problem_type, V.CATEGORY_WORDS, V.DEFAULT_CATEGORY)


def intent_label(intent: Column) -> Column:
    return F.coalesce(lookup(intent, V.INTENT_LABELS), F.lit(V.DEFAULT_INTENT_LABEL))


def search_text(question: Column, instruction: Column) -> Column:
    """The question, with a non-empty improvement instruction on a line of its own."""
    return F.concat_ws("\n", question, F.nullif(instruction, F.lit("")))
