"""Checked queries over text functions, paths, names and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import articles, chunks, names, paths, text as tx
from clauseflow.operators import chunking
from clauseflow.plans import shapes as S
from clauseflow.plans.registry import checked, table, texts


# ---------------------------------------------------------------- cleaning, ids
@checked(f"""
WITH {S.sql_clean('documents', 'doc_id')}
SELECT id AS doc_id, length(body) AS n, md5(body) AS body_md5 FROM cleaned""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tx.clean_text(F.col("text"))
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.length(body).cast("long").alias("n"), F.md5(body).alias("body_md5")
    )


@checked("""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g')) AS squeezed_md5
FROM documents""")
def squeeze_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.md5(tx.squeeze_spaces(F.col("text"))).alias("squeezed_md5")
    )


@checked(f"SELECT doc_id, {S.sql_hash('text')} AS document_hash FROM documents")
def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.document_hash(F.col("text")).alias("document_hash"))


@checked("""
SELECT conv_id, turn, sha1('conv-' || conv_id || '::' || turn || '::' || sha1(text)) AS chunk_id FROM conversations""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.chunk_id(source, F.col("turn"), F.col("text")).alias("chunk_id")
    )


@checked(f"""
SELECT doc_id, 'pasted::' || source || '::' || left(sha1(text), 12) AS pasted_id,
       'upload::' || source || '::' || doc_id || '.txt::' || left({S.sql_hash('text')}, 12) AS upload_id
FROM documents""")
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), "source", F.lit(" "))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.pasted_source_id(padded, F.col("text")).alias("pasted_id"),
        tx.upload_source_id(padded, name, F.col("text")).alias("upload_id"),
    )


# --------------------------------------------------------------- classification
@checked(f"""
WITH {S.SOURCE_DOCS},
kinds AS (
  SELECT doc_id, path, CASE WHEN path LIKE '%/law/%' THEN 'law' WHEN path LIKE '%/guideline/%' THEN 'guideline'
                      WHEN path LIKE '%/terms/%' THEN 'terms' ELSE 'unknown' END AS doc_type FROM source_docs)
SELECT doc_id, doc_type,
       CASE WHEN doc_type <> 'terms' THEN 'none' ELSE split_part(split_part(path, '/terms/', 2), '/', 1) END AS service_name,
       {S.sql_first_label("lower(regexp_extract(path, '([^/]*)[.]txt$', 1))", V.DOC_SUBTYPE_KEYWORDS, 'unknown')} AS doc_subtype
FROM kinds""")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    kind = paths.doc_type(path)
    return S.source_docs(spark, sf_dir).select(
        "doc_id", kind.alias("doc_type"), paths.service_name(path, kind).alias("service_name"),
        paths.doc_subtype(path).alias("doc_subtype"),
    )


_FAQ_PATHS = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/corpus/terms/' || source || '/a.json'
                               WHEN 1 THEN '/corpus/faq/' || source || '/a.json'
                               WHEN 2 THEN '/corpus/faq/' || source || '.json'
                               ELSE '/corpus/law/a.json' END AS path, source FROM documents"""


@checked(f"""
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN source ELSE 'none' END AS service_name FROM ({_FAQ_PATHS})""")
def faq_service_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, source = F.col("doc_id") % 4, F.col("source")
    path = (
        F.when(i == 0, F.concat(F.lit("/corpus/terms/"), source, F.lit("/a.json")))
        .when(i == 1, F.concat(F.lit("/corpus/faq/"), source, F.lit("/a.json")))
        .when(i == 2, F.concat(F.lit("/corpus/faq/"), source, F.lit(".json")))
        .otherwise("/corpus/law/a.json")
    )
    return table(spark, sf_dir, "documents").select("doc_id", paths.faq_service_name(path).alias("service_name"))


@checked(f"""
WITH {S.SOURCE_DOCS},
found AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'refund_policy' ELSE
            {S.sql_first_label(S.sql_pick(S.STEMS, 'doc_id'), V.DOC_SUBTYPE_KEYWORDS, 'unknown')} END AS sub,
            doc_id % 2 = 0 AS terms FROM source_docs)
SELECT doc_id, CASE WHEN sub = 'unknown' AND terms THEN 'terms_of_use' ELSE sub END AS doc_subtype FROM found""")
def upload_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = F.when(F.col("doc_id") % 3 == 0, "refund_policy")
    kind = F.when(F.col("doc_id") % 2 == 0, "terms").otherwise("law")
    return S.source_docs(spark, sf_dir).select(
        "doc_id", paths.upload_subtype(F.col("path"), explicit, kind).alias("doc_subtype")
    )


@checked(f"""
SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR {S.sql_any('text', V.SHARED_SCOPE_MARKERS)} THEN 'shared' ELSE 'service_specific' END AS scope
FROM documents""")
def text_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("doc_id") % 9 == 0, S.pick(V.SHARED_SCOPE_MARKERS, F.col("doc_id"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", tx.scope(F.concat("text", marker)).alias("scope"))


@checked("""
SELECT doc_id, length(trim(t, ' ' || chr(10))) >= 100
  AND length(regexp_replace(t, '[^가-힣]', '', 'g')) / length(t) >= 0.1 AS hangul_ok,
  length(trim(t, ' ' || chr(10))) >= 100
  AND length(regexp_replace(t, '[^a-m]', '', 'g')) / length(t) >= 0.5 AS latin_ok
FROM (SELECT doc_id, text || repeat('가', (doc_id % 200)::BIGINT) AS t FROM documents)""")
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.repeat(F.lit("가"), (F.col("doc_id") % 200).cast("int")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.is_readable(text).alias("hangul_ok"),
        tx.is_readable(text, script="[a-m]", min_share=0.5).alias("latin_ok"),
    )


_KEYWORD_HITS = " || ".join(
    f"CASE WHEN contains(replace(q, ' ', ''), '{k.replace(' ', '')}') THEN '{k};' ELSE '' END" for k in V.DOMAIN_KEYWORDS
)


@checked(f"""
SELECT conv_id, turn, {_KEYWORD_HITS} AS keywords
FROM (SELECT conv_id, turn, text || ' ' || {S.sql_pick(V.DOMAIN_KEYWORDS, 'conv_id + turn')} || ' ' ||
      {S.sql_pick(V.DOMAIN_KEYWORDS, 'conv_id * 3')} AS q FROM conversations)""")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.concat_ws(
        " ", "text", S.pick(V.DOMAIN_KEYWORDS, F.col("conv_id") + F.col("turn")),
        S.pick(V.DOMAIN_KEYWORDS, F.col("conv_id") * 3),
    )
    hits = F.array_join(F.transform(tx.keywords_in(query), lambda k: F.concat(k, F.lit(";"))), "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hits.alias("keywords"))


_ALIAS_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in V.SERVICE_ALIASES.items())


@checked(f"""
WITH aliases(k, alias) AS (VALUES {_ALIAS_VALUES}),
asked AS (SELECT doc_id, {S.sql_pick(S.SERVICES, 'doc_id')} AS name FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(alias, '[가-힣]') THEN alias WHEN regexp_matches(trim(name), '[가-힣]') THEN trim(name)
                    ELSE coalesce(alias, trim(name)) END AS canonical
FROM asked LEFT JOIN aliases ON k = lower(trim(name))""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.canonical_name(S.pick(S.SERVICES, F.col("doc_id"))).alias("canonical")
    )


@checked(f"""
WITH aliases(k, alias) AS (VALUES {_ALIAS_VALUES}),
asked AS (SELECT doc_id, {S.sql_pick(S.SERVICES, 'doc_id')} AS name FROM documents)
SELECT doc_id, name AS candidate FROM asked
UNION ALL SELECT doc_id, alias FROM asked JOIN aliases ON k = lower(name) WHERE alias <> name""")
def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names.alias_names(S.pick(S.SERVICES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("candidate"))


_PROFILE_VALUES = ", ".join(
    f"({n}, '{names._compact(a)}', '{p['official_domain']}')"
    for n, p in enumerate(V.SERVICE_PROFILES) for a in p["aliases"]
)


@checked(f"""
WITH profiles(ord, k, domain) AS (VALUES {_PROFILE_VALUES}),
asked AS (SELECT doc_id, regexp_replace(lower({S.sql_pick(S.SERVICES, 'doc_id')}), '[^0-9a-z가-힣]', '', 'g') AS k FROM documents)
SELECT doc_id, any_value(asked.k) AS compact, arg_min(domain, ord) AS domain FROM asked LEFT JOIN profiles USING (k) GROUP BY doc_id""")
def profile_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.pick(S.SERVICES, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.compact_name(name).alias("compact"), names.profile_domain(name).alias("domain")
    )


_DISPLAY_VALUES = ", ".join(f"({n}, '{k}', '{d}')" for n, (k, d) in enumerate(V.DISPLAY_NAMES))


@checked(f"""
WITH shown(ord, k, display) AS (VALUES {_DISPLAY_VALUES}),
asked AS (SELECT doc_id, trim({S.sql_pick(S.SERVICES + ('My (own) name', 'Genie Music Plus'), 'doc_id')}) AS name FROM documents),
best AS (SELECT doc_id, arg_min(display, ord) AS display FROM asked JOIN shown ON contains(lower(name), k) GROUP BY doc_id)
SELECT doc_id, CASE WHEN name LIKE '%(%)%' THEN name ELSE coalesce(display, name) END AS display
FROM asked LEFT JOIN best USING (doc_id)""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.pick(S.SERVICES + ("My (own) name", "Genie Music Plus"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", names.display_name(name).alias("display"))


_PROBLEMS = ("환불 문제", "청약철회", "자동 결제", "갱신", "개인정보 문제", "결제 문제", "요금", "위약금 문제", "Privacy", "프라이버시")


@checked(f"""
SELECT event_id, {S.sql_first_label(S.sql_pick(_PROBLEMS, 'event_id'), V.CATEGORY_WORDS, 'other')} AS category FROM events""")
def problem_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", tx.category(S.pick(_PROBLEMS, F.col("event_id"))).alias("category")
    )


_INTENTS = tuple(V.INTENT_LABELS) + ("SOMETHING",)
_INTENT_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in V.INTENT_LABELS.items())


@checked(f"""
WITH labels_(code, label) AS (VALUES {_INTENT_VALUES})
SELECT event_id, coalesce(label, '{V.DEFAULT_INTENT_LABEL}') AS label
FROM (SELECT event_id, {S.sql_pick(_INTENTS, 'event_id')} AS code FROM events) LEFT JOIN labels_ USING (code)""")
def intent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", tx.intent_label(S.pick(_INTENTS, F.col("event_id"))).alias("label")
    )


@checked("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || role END AS query FROM conversations""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    instruction = F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.search_text(F.col("text"), instruction).alias("query")
    )


# --------------------------------------------------------------------- articles
_HEADS = ("제 12 조의 3 (환불) ", "제7조 ", "2.7. ", "15.\n", "[ 환불 안내 ]\n", "", "x 제 3 조")


@checked(f"""
WITH t AS (SELECT doc_id, {S.sql_pick(_HEADS, 'doc_id')} || text AS c FROM documents),
m AS (SELECT doc_id,
  regexp_extract(c, '제{V.WS}*({S._D}+{V.WS}*조(?:{V.WS}*의{V.WS}*{S._D}+)?)', 0) AS art,
  regexp_extract(c, '(?m)^{V.WS}*({S._D}{{1,3}}(?:\\.{S._D}+)*\\.){V.WS}+', 1) AS sec,
  regexp_extract(c, '^{V.WS}*\\[([^\\]\\r\\n]{{1,100}})\\]', 1) AS head FROM t)
SELECT doc_id,
  CASE WHEN art <> '' THEN regexp_replace(art, '{V.WS}', '', 'g') WHEN sec <> '' THEN sec
       WHEN head <> '' THEN '[' || trim(head) || ']' ELSE 'unknown' END AS article,
  CASE WHEN art <> '' THEN substr(regexp_replace(art, '{V.WS}', '', 'g'), 2) WHEN sec <> '' THEN left(sec, length(sec) - 1)
       ELSE 'unknown' END AS article_no
FROM m""")
def article_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.concat(S.pick(_HEADS, F.col("doc_id")), "text")
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", articles.article_label(chunk).alias("article"), articles.article_number(chunk).alias("article_no")
    )


# --------------------------------------------------------------------- chunking
def _exploded(df: DataFrame, parts, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode_outer(parts).alias("n", "part")).where(F.col("part").isNotNull()).select(
        *keys, F.col("n").cast("long").alias("n"), F.md5("part").alias("part_md5")
    )


def _sql_exploded(rel: str, parts: str, key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, n - 1 AS n, md5(part) AS part_md5 FROM "
        f"(SELECT {key}, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS n FROM {rel})"
    )


@checked(f"""
WITH {S.SHAPED_DOCS}, p AS (SELECT doc_id, {S.sql_split_marked('text', S.SQL_ARTICLE_MARK)} AS parts FROM shaped)
{_sql_exploded('p', 'parts')}""")
def article_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(S.shaped_docs(spark, sf_dir), chunks.split_before(F.col("text"), chunks.BEFORE_ARTICLE), "doc_id")


@checked(f"""
WITH {S.SHAPED_DOCS}, p AS (SELECT doc_id, {S.sql_split_marked('text', S.SQL_OUTLINE_MARK)} AS parts FROM shaped)
{_sql_exploded('p', 'parts')}""")
def outline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(S.shaped_docs(spark, sf_dir), chunks.split_before(F.col("text"), chunks.BEFORE_OUTLINE), "doc_id")


@checked(f"""
WITH {S.SHAPED_DOCS}, p AS (SELECT doc_id, {S.sql_split_marked('text', S.SQL_GUIDELINE_MARK)} AS parts FROM shaped)
{_sql_exploded('p', 'parts')}""")
def guideline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(S.shaped_docs(spark, sf_dir), chunks.split_before(F.col("text"), chunks.BEFORE_GUIDELINE), "doc_id")


@checked(f"""
WITH {S.SHAPED_DOCS}, {S.sql_headings('shaped', 'doc_id', 'text')}
{_sql_exploded('sections', 'parts', 'id').replace('SELECT id, n', 'SELECT id AS doc_id, n', 1)}""")
def heading_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(S.shaped_docs(spark, sf_dir), chunks.split_headings(F.col("text")), "doc_id")


@checked(f"""
WITH {S.SHAPED_DOCS}, p AS (SELECT doc_id, {S.sql_split_marked('text', S.SQL_ARTICLE_MARK)} AS parts FROM shaped)
SELECT doc_id, CASE WHEN len(parts) >= 3 THEN len(parts) END AS usable_parts FROM p""")
def minimum_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.enough(chunks.split_before(F.col("text"), chunks.BEFORE_ARTICLE))
    return S.shaped_docs(spark, sf_dir).select("doc_id", parts.alias("parts")).select(
        "doc_id", F.when(F.col("parts").isNotNull(), F.size("parts").cast("long")).alias("usable_parts")
    )


@checked(f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(text) - 121, 0) + 1, 880),
             lambda s: {S.sql_strip('substr(text, s + 1, 1000)')}), lambda p: p <> '') AS parts FROM documents)
{_sql_exploded('w', 'parts')}""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(texts(spark, sf_dir, "documents", "doc_id", "text"), chunks.fixed_windows(F.col("text")), "doc_id")


@checked(f"""
WITH RECURSIVE src AS (SELECT doc_id AS pid, {S.sql_strip('text')} AS part FROM documents),
{S.sql_windows('src')}
SELECT pid AS doc_id, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS n, md5(piece) AS part_md5 FROM windows""")
def recursive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(texts(spark, sf_dir, "documents", "doc_id", "text"), chunks.recursive_windows(F.col("text")), "doc_id")


@checked(f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
src AS (SELECT doc_id * 1000000 + n AS pid, line AS part FROM lines WHERE length(line) > 1500),
{S.sql_windows('src')},
pieces AS (
  SELECT doc_id, n, 0 AS pos, line AS piece FROM lines WHERE length(line) <= 1500
  UNION ALL SELECT pid // 1000000, pid % 1000000, pos, piece FROM windows)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, pos) - 1 AS n, md5(piece) AS part_md5 FROM pieces""")
def long_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.split_long(F.split("text", "\n"))
    return _exploded(texts(spark, sf_dir, "documents", "doc_id", "text"), parts, "doc_id")


@checked(f"""
WITH p AS (SELECT doc_id AS id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS parts FROM documents),
{S.sql_merged('p')}
{_sql_exploded('merged', 'chunks', 'id').replace('SELECT id, n', 'SELECT id AS doc_id, n', 1)}""")
def short_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return _exploded(texts(spark, sf_dir, "documents", "doc_id", "text"), chunks.merge_short(lines), "doc_id")


def sql_cascade(rel: str, key: str, text: str, name: str = "chunked") -> str:
    """CTEs from ``rel``(key, doc_type, text) to ``name``(id, strategy, chunks)."""
    return f"""
_split AS (
  SELECT {key} AS id, doc_type, {text} AS t,
    CASE WHEN doc_type IN ('law', 'terms') THEN {S.sql_split_marked(text, S.SQL_ARTICLE_MARK)} END AS art,
    CASE WHEN doc_type IN ('law', 'terms') THEN {S.sql_split_marked(text, S.SQL_OUTLINE_MARK)} END AS outl,
    CASE WHEN doc_type = 'guideline' THEN {S.sql_split_marked(text, S.SQL_GUIDELINE_MARK)} END AS numb
  FROM {rel}),
{S.sql_headings(rel, key, text, '_sections')},
_chosen AS (
  SELECT id, t, CASE WHEN len(art) >= 3 THEN 'article' WHEN len(outl) >= 3 THEN 'outline' WHEN len(numb) >= 3 THEN 'numbered'
                  WHEN doc_type IN ('terms', 'guideline') AND len(s.parts) >= 3 THEN 'heading' ELSE 'window' END AS strategy,
         art, outl, numb, s.parts AS head
  FROM _split LEFT JOIN _sections s USING (id)),
_raw AS (
  SELECT id, strategy, unnest(ps) AS part, generate_subscripts(ps, 1) AS n
  FROM (SELECT id, strategy, CASE strategy WHEN 'article' THEN art WHEN 'outline' THEN outl WHEN 'numbered' THEN numb
                                  WHEN 'heading' THEN head ELSE [{S.sql_strip('t')}] END AS ps FROM _chosen)),
_whole AS (SELECT *, length(part) > CASE WHEN strategy = 'window' THEN 1000 ELSE 1500 END AS cut FROM _raw),
_long AS (SELECT id::VARCHAR || '#' || n AS pid, part FROM _whole WHERE cut),
{S.sql_windows('_long', '_win')},
_pieces AS (
  SELECT id, n, 0 AS pos, part AS piece FROM _whole WHERE NOT cut AND part <> ''
  UNION ALL SELECT id, n, pos, piece FROM _whole JOIN _win ON pid = id::VARCHAR || '#' || n),
_lists AS (SELECT id, list(piece ORDER BY n, pos) AS parts FROM _pieces GROUP BY id),
{S.sql_merged('_lists', '_merged')},
{name} AS (SELECT id, strategy, chunks FROM _merged JOIN _chosen USING (id))"""


@checked(f"""
WITH RECURSIVE {S.SHAPED_DOCS}, {sql_cascade('shaped', 'doc_id', 'text')}
SELECT id AS doc_id, strategy, n - 1 AS n, md5(part) AS part_md5
FROM (SELECT id, strategy, unnest(chunks) AS part, generate_subscripts(chunks, 1) AS n FROM chunked)""")
def chunk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = chunking.with_parts(S.shaped_docs(spark, sf_dir))
    return _exploded(df, F.col("parts"), "doc_id", "strategy")


@checked(f"""
WITH RECURSIVE {S.SHAPED_DOCS}, {sql_cascade('shaped', 'doc_id', 'text')},
c AS (SELECT 'doc-' || id AS source, unnest(chunks) AS part, generate_subscripts(chunks, 1) - 1 AS n FROM chunked),
m AS (SELECT *,
  regexp_extract(part, '제{V.WS}*({S._D}+{V.WS}*조(?:{V.WS}*의{V.WS}*{S._D}+)?)', 0) AS art,
  regexp_extract(part, '(?m)^{V.WS}*({S._D}{{1,3}}(?:\\.{S._D}+)*\\.){V.WS}+', 1) AS sec,
  regexp_extract(part, '^{V.WS}*\\[([^\\]\\r\\n]{{1,100}})\\]', 1) AS head FROM c)
SELECT source, n AS chunk_index, sha1(source || '::' || n || '::' || sha1(part)) AS chunk_id, md5(part) AS content_hash,
  CASE WHEN art <> '' THEN regexp_replace(art, '{V.WS}', '', 'g') WHEN sec <> '' THEN sec
       WHEN head <> '' THEN '[' || trim(head) || ']' ELSE 'unknown' END AS article,
  CASE WHEN art <> '' THEN substr(regexp_replace(art, '{V.WS}', '', 'g'), 2) WHEN sec <> '' THEN left(sec, length(sec) - 1)
       ELSE 'unknown' END AS article_no
FROM m""")
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunking.with_parts(S.shaped_docs(spark, sf_dir)).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), "parts"
    )
    return chunking.number_parts(docs).select(
        "source", F.col("chunk_index").cast("long").alias("chunk_index"),
        "chunk_id", "content_hash", "article", "article_no",
    )
