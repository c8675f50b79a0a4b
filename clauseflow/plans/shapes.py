"""Inputs derived from the given tables, each in Spark and as SQL text.

The tables hold generated prose; these give it the shape of policy documents, row by
row and over whole tables and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.plans.registry import table, texts

STEMS = ("terms_of_use", "privacy", "refund", "billing", "notice", "이용약관", "개인정보처리방침")
FOLDERS = ("law", "guideline", "terms", "terms", "misc")
SERVICES = ("Netflix", "넷플릭스", "tving", " 쿠팡 ", "YOUTUBE", "Spotify", "disney+", "웨이브", "Zoom Pro", "멜론")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({index}) % {len(values)} + 1]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{V.WS}+|{V.WS}+$', '', 'g')"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_first_label(text: str, labels, default: str) -> str:
    whens = " ".join(f"WHEN {sql_any(text, words)} THEN '{label}'" for label, words in labels.items())
    return f"CASE {whens} ELSE '{default}' END"


# ----------------------------------------------------------- source documents
def source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files below a corpus root, with a service folder for terms."""
    i = F.col("doc_id")
    folder = pick(FOLDERS, i)
    inner = F.when(folder == "terms", F.concat(F.lit("/"), "source")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.col("source").alias("publisher"),
        F.concat(F.lit("/corpus/"), folder, inner, F.lit("/"), pick(STEMS, i), F.lit("-"), i.cast("string"), F.lit(".txt")).alias("path"),
    )


SOURCE_DOCS = f"""
source_docs AS (
  SELECT doc_id, text, lang, source AS publisher,
         '/corpus/' || folder || CASE WHEN folder = 'terms' THEN '/' || source ELSE '' END
           || '/' || {sql_pick(STEMS, 'doc_id')} || '-' || doc_id || '.txt' AS path
  FROM (SELECT *, {sql_pick(FOLDERS, 'doc_id')} AS folder FROM documents))"""


# ------------------------------------------------------------- shaped documents
def _numbered(text: Column, before: str, after: str) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), x))
    return F.array_join(lines, "\n")


def shaped_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their lines written as articles, outline, headed sections or as they are."""
    text, i = F.col("text"), F.col("doc_id")
    headed = F.array_join(
        F.transform(F.split(text, "\n"), lambda x, n: F.concat(F.lit("Section "), (n + 1).cast("string"), F.lit("\n"), x)), "\n"
    )
    body = (
        F.when(i % 4 == 0, _numbered(text, "제", "조 "))
        .when(i % 4 == 1, _numbered(text, "", ". "))
        .when(i % 4 == 2, headed)
        .otherwise(text)
    )
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", pick(("law", "guideline", "terms", "terms", "misc"), F.floor(i / 4)).alias("doc_type"),
        body.alias("text"),
    )


SHAPED_DOCS = f"""
shaped AS (
  SELECT doc_id, {sql_pick(("law", "guideline", "terms", "terms", "misc"), 'doc_id // 4')} AS doc_type,
    CASE doc_id % 4
      WHEN 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, n: '제' || n || '조 ' || x), chr(10))
      WHEN 1 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, n: n || '. ' || x), chr(10))
      WHEN 2 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, n: 'Section ' || n || chr(10) || x), chr(10))
      ELSE text END AS text
  FROM documents)"""


# ------------------------------------------------------------------ cleaning
def sql_clean(rel: str, key: str, text: str = "text", name: str = "cleaned") -> str:
    """CTEs that end in ``name``(id, body): blanks, blank lines and doubled labels collapsed.

    The doubled label needs a back-reference, which RE2 lacks.  It never spans white
    space, so each distinct token is scanned once, position by position.
    """
    word = r"[\p{L}\p{N}_]"

    def edge(p: str) -> str:
        left = f"(({p}) > 1 AND regexp_matches(substr(tok, ({p}) - 1, 1), '{word}'))"
        right = f"(({p}) <= length(tok) AND regexp_matches(substr(tok, {p}, 1), '{word}'))"
        return f"({left} <> {right})"

    longest = (
        "list_max(list_filter([2,3,4,5,6,7,8,9,10], lambda k: i + 2*k - 1 <= length(tok) "
        f"AND substr(tok, i, k) = substr(tok, i + k, k) AND {edge('i')} AND {edge('i + 2*k')}))"
    )
    return f"""
_sq AS (
  SELECT {key} AS id,
         regexp_replace(regexp_replace({text}, '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g') AS t FROM {rel}),
_tk AS (
  SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS n
  FROM (SELECT id, regexp_extract_all(t, '{V.NON_WS}+|{V.WS}+') AS toks FROM _sq)),
_fx AS (
  SELECT tok, list_reduce(range(1, length(tok) + 1), lambda a, i:
    CASE WHEN i < a.nxt THEN a
         ELSE (CASE WHEN {longest} IS NULL THEN {{'nxt': i + 1, 'res': a.res || substr(tok, i, 1)}}
               ELSE {{'nxt': i + 2*{longest}, 'res': a.res || substr(tok, i, {longest})}} END) END,
    {{'nxt': 1::BIGINT, 'res': ''}}).res AS fixed
  FROM (SELECT DISTINCT tok FROM _tk WHERE length(tok) >= 4)),
{name} AS (
  SELECT id, {sql_strip("string_agg(coalesce(fixed, tok), '' ORDER BY n)")} AS body
  FROM _tk LEFT JOIN _fx USING (tok) GROUP BY id)"""


def sql_hash(text: str) -> str:
    return f"md5(regexp_replace({text}, '{V.WS}+', '', 'g'))"


# ------------------------------------------------------------------- windows
def sql_windows(rel: str, name: str = "windows", size: int = 1000, overlap: int = 120) -> str:
    """CTEs from ``rel``(pid, part) to ``name``(pid, pos, piece): line, then word, then character ends.

    Pieces are cut in front of each newline; one of ``size`` or more is cut again in
    front of its blanks, and a longer word at every character.  Windows slide over the
    cut positions of one run of short pieces.
    """
    def pieces(cte: str, src: str, mark: str, keys: str) -> str:
        return f"""
_{cte}a AS (
  SELECT {keys}, base, unnest(list_transform(string_split(t, {mark}), lambda x, n: CASE WHEN n > 1 THEN {mark} || x ELSE x END)) AS piece,
         generate_subscripts(string_split(t, {mark}), 1) AS n
  FROM {src}),
_{cte}b AS (SELECT *, length(piece) AS len FROM _{cte}a WHERE piece <> ''),
_{cte} AS (
  SELECT *, base + sum(len) OVER w - len AS lo, base + sum(len) OVER w AS hi,
         sum((len >= {size})::INT) OVER w AS big
  FROM _{cte}b WINDOW w AS (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING))"""

    return f"""
_w0 AS (SELECT pid, part AS t, 0 AS base FROM {rel}),
{pieces('w1', '_w0', 'chr(10)', 'pid')},
_w1x AS (SELECT pid, n AS line, piece AS t, lo AS base FROM _w1 WHERE len >= {size}),
{pieces('w2', '_w1x', "' '", 'pid, line')},
_runs AS (
  SELECT pid, min(lo)::BIGINT AS s0, list(hi::BIGINT ORDER BY hi) AS ends FROM _w1 WHERE len < {size} GROUP BY pid, big
  UNION ALL
  SELECT pid, min(lo)::BIGINT, list(hi::BIGINT ORDER BY hi) FROM _w2 WHERE len < {size} GROUP BY pid, line, big
  UNION ALL
  SELECT pid, lo::BIGINT, range((lo + 1)::BIGINT, (hi + 1)::BIGINT) FROM _w2 WHERE len >= {size}),
_cuts AS (SELECT pid, s0::BIGINT AS s0, list_prepend(s0::BIGINT, ends::BIGINT[]) AS cuts FROM _runs),
_slide AS (
  SELECT pid, cuts, s0 AS s, list_max(list_filter(cuts, lambda b: b <= s0 + {size})) AS e FROM _cuts
  UNION ALL
  SELECT pid, cuts, s2, list_max(list_filter(cuts, lambda b: b <= s2 + {size})) FROM (
    SELECT pid, cuts,
           least(e, list_min(list_filter(cuts, lambda b: b >= greatest(s, e - {overlap}, nxt - {size})))) AS s2
    FROM (SELECT *, list_min(list_filter(cuts, lambda b: b > e)) AS nxt FROM _slide WHERE e < cuts[-1]))),
{name} AS (
  SELECT pid, s AS pos, {sql_strip('substr(part, s + 1, e - s)')} AS piece
  FROM _slide JOIN {rel} USING (pid)
  WHERE {sql_strip('substr(part, s + 1, e - s)')} <> '')"""


SQL_MERGE = """list_reduce(parts, lambda a, p:
    CASE WHEN length(p) >= 120 THEN
           {'done': list_append(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, p), 'open': ''}
         WHEN length(CASE WHEN a.open = '' THEN p ELSE a.open || chr(10) || p END) >= 120 THEN
           {'done': list_append(a.done, CASE WHEN a.open = '' THEN p ELSE a.open || chr(10) || p END), 'open': ''}
         ELSE {'done': a.done, 'open': CASE WHEN a.open = '' THEN p ELSE a.open || chr(10) || p END} END,
    {'done': []::VARCHAR[], 'open': ''})"""


def sql_merged(rel: str, name: str = "merged") -> str:
    """``rel``(id, parts list) to ``name``(id, chunks list): short parts folded together."""
    return f"""
_folded AS (SELECT id, {SQL_MERGE} AS f FROM {rel}),
{name} AS (
  SELECT id, CASE WHEN f.open = '' THEN f.done
                  WHEN len(f.done) = 0 THEN [f.open]
                  ELSE list_append(f.done[1:len(f.done) - 1], f.done[-1] || chr(10) || f.open) END AS chunks
  FROM _folded)"""


# -------------------------------------------------------------------- splits
_D = r"\p{Nd}"
SQL_ARTICLE_MARK = f"(제{V.WS}*{_D}+{V.WS}*조)"
SQL_OUTLINE_MARK = rf"(?m)^({_D}{{1,3}}(?:\.{_D}+)*\.{V.WS}+[^\n])"
SQL_GUIDELINE_MARK = rf"(?m)^({V.WS}*{_D}+\.{V.WS}+[^\n])"


def sql_split_marked(text: str, pattern: str) -> str:
    """RE2 has no look-ahead: a marker goes in front of each match, then it is split away."""
    marked = f"string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\1', 'g'), chr(1))"
    return f"list_filter(list_transform({marked}, lambda p: {sql_strip('p')}), lambda p: p <> '')"


def sql_headings(rel: str, key: str, text: str, name: str = "sections") -> str:
    """CTEs to ``name``(id, parts): heading lines found one by one, sections by a running count."""
    endings = "".join(V.HEADING_ENDINGS)
    return f"""
_ln AS (
  SELECT {key} AS id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT {key}, string_split(regexp_replace({text}, '{V.LINE_END}', chr(10), 'g'), chr(10)) AS ls FROM {rel})),
_hd AS (
  SELECT id, n, line, n > 1 AND length({sql_strip('line')}) BETWEEN 2 AND 20
         AND NOT contains('{endings}', right({sql_strip('line')}, 1)) AS opens FROM _ln),
_sc AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id ORDER BY n) AS sec FROM _hd),
_bd AS (
  SELECT id, sec, coalesce(max(CASE WHEN opens THEN {sql_strip('line')} END), '{V.FIRST_HEADING}') AS heading,
         {sql_strip("string_agg(line, chr(10) ORDER BY n)")} AS body
  FROM _sc GROUP BY id, sec),
{name} AS (
  SELECT id, list('[' || heading || ']' || chr(10) || body ORDER BY sec) AS parts FROM _bd WHERE body <> '' GROUP BY id)"""
