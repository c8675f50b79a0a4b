"""Checked queries over answer runs, structured answers and the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.operators import answers, history, runs
from clauseflow.plans import jobs, shapes as S
from clauseflow.plans.registry import checked, table

# ------------------------------------------------------------------------- runs
ACTIONS = ("REGENERATE", "RETRIEVE_AGAIN", "NONE")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a verdict log: a user is a run, a purchase is a PASS."""
    action = F.when(F.col("event_type") == "purchase", "NONE").otherwise(S.pick(ACTIONS, F.col("event_id")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "PASS").otherwise("FAIL").alias("status"), action.alias("action"),
    )


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct().withColumn(
        "in_scope", F.col("run_id") % 10 != 0
    )


VERDICTS = f"""
verdicts AS (SELECT user_id AS run_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'PASS' ELSE 'FAIL' END AS status,
                    CASE event_type WHEN 'purchase' THEN 'NONE' ELSE {S.sql_pick(ACTIONS, 'event_id')} END AS action FROM events),
rounds AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, seq) - 1 AS retry_count FROM verdicts QUALIFY retry_count <= 2)"""


@checked("""
SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 10 <> 0 THEN 'retrieve_context' ELSE 'generate_out_of_scope_answer' END AS next_node FROM events""")
def scope_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_table(spark, sf_dir).select("run_id", runs.route_scope(F.col("in_scope")).alias("next_node"))


@checked("""
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'generate_final_answer' WHEN event_id % 4 >= 2 THEN 'generate_insufficient_evidence_answer'
                      ELSE 'improve_strategy' END AS next_node FROM events""")
def verdict_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = verdicts(spark, sf_dir)
    return log.select(F.col("seq").alias("event_id"), runs.route_verdict(F.col("status"), F.col("seq") % 4).alias("next_node"))


@checked(f"""
WITH {VERDICTS} SELECT seq AS event_id, CASE WHEN action = 'REGENERATE' THEN 'generate_answer' ELSE 'retrieve_context' END AS next_node FROM verdicts""")
def improvement_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select(F.col("seq").alias("event_id"), runs.route_improvement(F.col("action")).alias("next_node"))


@checked("""
SELECT event_id AS run_id, CASE WHEN event_type <> 'purchase' AND event_id % 4 < 2 THEN event_id % 4 + 1 ELSE event_id % 4 END AS retry_count,
       CASE WHEN event_type <> 'purchase' AND event_id % 4 < 2 AND event_id % 3 <> 0 THEN 'look at ' || props ELSE 'first' END AS instruction FROM events""")
def improved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    state = verdicts(spark, sf_dir).select(
        F.col("seq").alias("run_id"), "status", (F.col("seq") % 4).alias("retry_count"), F.lit("first").alias("instruction")
    )
    instructions = events.where("event_id % 3 <> 0").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("look at "), "props").alias("instruction")
    )
    return runs.apply_improvement(state, instructions).select("run_id", "retry_count", "instruction")


@checked("""
SELECT conv_id AS run_id, 'retrieve_context' AS stage, turn AS retry_count, left(text, 300) AS terms_context_preview, NULL AS draft_answer FROM conversations
UNION ALL SELECT conv_id, 'generate_answer', turn, NULL, text FROM conversations WHERE role = 'assistant'""")
def round_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("retry_count"), "role",
        F.col("text").alias("terms_context"), F.col("text").alias("draft_answer"),
    )
    return runs.append_logs(
        runs.log_rows(state, "retrieve_context", "terms_context"),
        runs.log_rows(state.where("role = 'assistant'"), "generate_answer", "draft_answer"),
    )


@checked(f"""
WITH {VERDICTS},
ends AS (SELECT run_id, min(retry_count) FILTER (status = 'PASS' OR retry_count = 2) AS last, max(retry_count) AS logged,
                arg_min(status, retry_count) FILTER (status = 'PASS' OR retry_count = 2) AS final FROM rounds GROUP BY run_id),
steps AS (
  SELECT r.run_id, r.retry_count, 'generate_answer,verify_answer,' || CASE
      WHEN r.status = 'PASS' THEN 'generate_final_answer' WHEN r.retry_count = 2 THEN 'generate_insufficient_evidence_answer'
      WHEN r.action = 'REGENERATE' THEN 'improve_strategy' ELSE 'improve_strategy,retrieve_context' END AS step,
    (r.status <> 'PASS' AND r.retry_count < 2 AND r.action <> 'REGENERATE')::INT AS again
  FROM rounds r JOIN ends e ON r.run_id = e.run_id AND r.retry_count <= coalesce(e.last, e.logged)),
paths AS (SELECT run_id, count(*) AS verifications, 1 + sum(again) AS retrievals,
                 'retrieve_context,' || string_agg(step, ',' ORDER BY retry_count) AS path FROM steps GROUP BY run_id)
SELECT run_id, run_id % 10 <> 0 AS in_scope,
  CASE WHEN run_id % 10 = 0 THEN 'generate_out_of_scope_answer' WHEN last IS NULL THEN 'unfinished'
       WHEN final = 'PASS' THEN 'generate_final_answer' ELSE 'generate_insufficient_evidence_answer' END AS final_node,
  CASE WHEN run_id % 10 = 0 THEN 0 ELSE retrievals::INT END AS retrievals, CASE WHEN run_id % 10 = 0 THEN 0 ELSE verifications::INT END AS verifications,
  CASE WHEN run_id % 10 = 0 THEN 'generate_out_of_scope_answer' ELSE path END AS path
FROM ends JOIN paths USING (run_id)""")
def replayed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.replay(run_table(spark, sf_dir), verdicts(spark, sf_dir))


_STAGES = ("retrieve_context", "generate_answer", "verify_answer", "improve_strategy")


@checked(f"""
SELECT user_id AS run_id, count(*) FILTER (event_id % 4 = 0) AS retrievals, count(*) FILTER (event_id % 4 = 1) AS generations,
       count(*) FILTER (event_id % 4 = 2) AS verifications FROM events GROUP BY user_id""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), S.pick(_STAGES, F.col("event_id")).alias("stage"))
    return runs.stage_counts(log)


@checked(f"SELECT DISTINCT user_id AS run_id, '{V.OUT_OF_SCOPE_TEXT % '이 서비스'}' AS message FROM events WHERE user_id % 10 = 0")
def out_of_scope_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.out_of_scope_answers(run_table(spark, sf_dir))


# ---------------------------------------------------------------------- answers
def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as structured answers, with fields missing or of another type."""
    i, turn = F.col("conv_id"), F.col("turn")
    lines = F.split("text", "\n")
    full = F.to_json(F.struct(
        S.pick(("환불 문제", "자동결제", "개인정보", "요금", "기타", ""), i + turn).alias("problem_type"),
        F.col("role").alias("simple_explanation"), lines.alias("terms_evidence"),
        F.array(F.lit("Terms 1"), F.lit("Terms 2")).alias("source_references"), lines.alias("next_actions"),
        F.array(F.lit(7), F.lit(8)).alias("check_items"), F.lit("no list").alias("required_materials"),
    ))
    answer = F.when(turn % 3 == 2, F.lit('{"message":"out of scope"}')).otherwise(full)
    return table(spark, sf_dir, "conversations").select(
        i.alias("item_id"), (i * 1000 + turn).alias("qa_id"), F.col("role").alias("question"), answer.alias("answer"),
    )


_ANSWERS = f"""
ans AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS qa_id, turn % 3 = 2 AS off, role, string_split(text, chr(10)) AS ls,
    CASE WHEN turn % 3 = 2 OR (conv_id + turn) % 6 = 5 THEN '{V.DEFAULT_PROBLEM_TYPE}' ELSE ['환불 문제', '자동결제', '개인정보', '요금', '기타', ''][(conv_id + turn) % 6 + 1] END AS problem_type
  FROM conversations)"""


@checked(f"""
WITH {_ANSWERS}
SELECT qa_id, problem_type, {S.sql_first_label('problem_type', V.CATEGORY_WORDS, 'other')} AS category,
       CASE WHEN off THEN 'out of scope' ELSE role END AS simple_explanation,
       CASE WHEN off THEN 0 ELSE len(ls) END AS n_evidence, CASE WHEN off THEN '' ELSE '7,8' END AS check_items, 0 AS n_materials, '' AS inquiry_draft
FROM ans""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = answers.parse_answers(raw_answers(spark, sf_dir))
    return parsed.select(
        "qa_id", "problem_type", "category", "simple_explanation", F.size("terms_evidence").alias("n_evidence"),
        F.array_join("check_items", ",").alias("check_items"), F.size("required_materials").alias("n_materials"), "inquiry_draft",
    )


@checked(f"""
WITH {_ANSWERS}
SELECT qa_id, {S.sql_first_label('problem_type', V.CATEGORY_WORDS, 'other')} AS category,
  md5(CASE WHEN off THEN '{V.NO_EVIDENCE_TEXT}' ELSE array_to_string(ls, chr(10) || chr(10)) END) AS evidence,
  CASE WHEN off THEN '{V.NO_SOURCE_TEXT}' ELSE 'Terms 1' || chr(10) || 'Terms 2' END AS original_text,
  CASE WHEN off THEN '' ELSE array_to_string(list_transform(ls, lambda x, n: 'todo-' || (n - 1) || '-' || qa_id || '|' || x), ';') END AS todo
FROM ans""")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.history_rows(answers.parse_answers(raw_answers(spark, sf_dir)))
    todo = F.transform("todo", lambda t: F.concat_ws("|", t["todo_id"], t["text"]))
    return rows.select("qa_id", "category", F.md5("evidence").alias("evidence"), "original_text", F.array_join(todo, ";").alias("todo"))


@checked("""
WITH a AS (SELECT event_id AS run_id, event_id % 7 = 0 AS s, event_id % 5 = 4 AS act, event_id % 3 = 0 AS rep, event_id % 11 = 0 AS pth, event_id % 13 = 0 AS sec FROM events)
SELECT run_id, 'status' AS rule FROM a WHERE s UNION ALL SELECT run_id, 'suggested_action' FROM a WHERE act
UNION ALL SELECT run_id, 'repeated_reference' FROM a WHERE rep UNION ALL SELECT run_id, 'internal_path' FROM a WHERE pth
UNION ALL SELECT run_id, 'secret_material' FROM a WHERE sec""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        i.alias("run_id"), F.when(i % 7 == 0, "MAYBE").when(i % 2 == 0, "PASS").otherwise("FAIL").alias("status"),
        S.pick(("NONE", "REGENERATE", "RETRIEVE_AGAIN", "NONE", "STOP"), i).alias("suggested_action"),
        F.array(
            F.lit("Terms 1"), F.when(i % 3 == 0, "Terms 1").otherwise("Terms 2"),
            F.when(i % 11 == 0, F.lit("RAG/terms/a/b.pdf")).otherwise(F.col("props")),
        ).alias("source_references"),
        F.array(F.col("event_type"), F.when(i % 13 == 0, "계정 비밀번호").otherwise("영수증")).alias("required_materials"),
    )
    return answers.violations(rows)


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A turn is a run: its lines are evidence, its two halves are the hits.

    Every third line is altered, and one line may fall between the halves.
    """
    run, text = F.col("conv_id") * 1000 + F.col("turn"), F.col("text")
    turns = table(spark, sf_dir, "conversations").withColumn("run_id", run)
    lines = turns.select("run_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    evidence = lines.select(
        "run_id", F.col("n").cast("long").alias("sentence_no"),
        F.when((F.col("run_id") + F.col("n")) % 3 == 2, F.concat(F.lit("Not said: "), "line"))
        .otherwise(F.concat(F.lit(" "), "line")).alias("sentence"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length("text")))
    return evidence, turns.select("run_id", F.explode(halves).alias("document"))


_EVIDENCE = """
turns AS (SELECT conv_id * 1000 + turn AS run_id, text, string_split(text, chr(10)) AS ls FROM conversations),
lines AS (SELECT run_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS sentence_no FROM turns),
evidence AS (SELECT run_id, sentence_no, text, regexp_replace(CASE WHEN (run_id + sentence_no) % 3 = 2 THEN 'Not said: ' || line ELSE ' ' || line END, '\\s', '', 'g') AS flat FROM lines),
grounding AS (
  SELECT run_id, sentence_no, contains(regexp_replace(left(text, length(text) // 2), '\\s', '', 'g'), flat)
    OR contains(regexp_replace(substr(text, length(text) // 2 + 1), '\\s', '', 'g'), flat) AS grounded FROM evidence)"""


@checked(f"WITH {_EVIDENCE} SELECT * FROM grounding")
def grounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.grounding(*_evidence(spark, sf_dir))


@checked(f"""
WITH {_EVIDENCE}
SELECT run_id, count(*) AS sentences, count(*) FILTER (grounded) AS grounded, round(avg(grounded::INT::DOUBLE), 6) AS share FROM grounding GROUP BY run_id""")
def grounded_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.grounded_share(answers.grounding(*_evidence(spark, sf_dir))).withColumn("share", F.round("share", 6))


@checked(r"""
WITH turns AS (SELECT conv_id AS run_id, conv_id * 1000 + turn AS qa_id, text, string_split(text, chr(10)) AS ls FROM conversations),
lines AS (SELECT run_id, qa_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM turns),
evidence AS (SELECT run_id, qa_id * 1000 + n AS sentence_no,
               regexp_replace(CASE WHEN (qa_id + n) % 3 = 2 THEN line || line ELSE line END, '\s', '', 'g') AS flat FROM lines),
hits AS (SELECT run_id, regexp_replace(text, '\s', '', 'g') AS t FROM turns)
SELECT e.run_id, sentence_no, bool_or(contains(t, flat)) AS grounded FROM evidence e JOIN hits USING (run_id) GROUP BY ALL""")
def grounded_by_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a run: every line of it is evidence, every third one doubled, and every turn a hit."""
    turns = table(spark, sf_dir, "conversations").withColumn("qa_id", F.col("conv_id") * 1000 + F.col("turn"))
    lines = turns.select(F.col("conv_id").alias("run_id"), "qa_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    evidence = lines.select(
        "run_id", (F.col("qa_id") * 1000 + F.col("n")).alias("sentence_no"),
        F.when((F.col("qa_id") + F.col("n")) % 3 == 2, F.concat("line", "line")).otherwise(F.col("line")).alias("sentence"),
    )
    return answers.grounding_by_anchors(evidence, turns.select(F.col("conv_id").alias("run_id"), F.col("text").alias("document")))


# ---------------------------------------------------------------------- history
_TYPES = ("name", "url", "document")


def history_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A conversation is an item, a user turn a question, each line of it a todo."""
    turns = table(spark, sf_dir, "conversations")
    c = F.col("conv_id")
    items = turns.groupBy(c.alias("item_id")).agg(
        F.max(F.when(F.col("turn") == 0, F.substring("text", 1, 20))).alias("service_name"),
        F.max(F.when(F.col("turn") == 1, F.substring("text", 1, 20))).alias("query"),
    ).select(
        "*", S.pick(_TYPES, F.col("item_id")).alias("type"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 300).cast("int")), "yyyy-MM-dd").alias("date"),
        F.when(F.col("item_id") % 4 != 3, F.col("item_id") * 1000 + F.col("item_id") % 2 * 2).alias("selected_qa_id"),
    )
    asked = turns.where("role = 'user'").select(
        c.alias("item_id"), (c * 1000 + F.col("turn")).alias("qa_id"), F.col("turn").alias("seq"),
        F.col("text").alias("question"), F.split("text", "[.]").alias("follow_ups"),
    )
    todos = asked.select("item_id", "qa_id", F.posexplode(F.split("question", "\n")).alias("todo_id", "text")).withColumn(
        "checked", F.col("todo_id") % 2 == 1
    )
    return items, asked.drop("question").withColumn("question", F.md5(F.array_join("follow_ups", "."))), todos


HISTORY = f"""
items AS (
  SELECT conv_id AS item_id, max(left(text, 20)) FILTER (turn = 0) AS service_name, max(left(text, 20)) FILTER (turn = 1) AS query,
    {S.sql_pick(_TYPES, 'conv_id')} AS type, strftime(DATE '2024-01-01' + (conv_id % 300)::INT, '%Y-%m-%d') AS date,
    CASE WHEN conv_id % 4 <> 3 THEN conv_id * 1000 + conv_id % 2 * 2 END AS selected_qa_id
  FROM conversations GROUP BY conv_id),
questions AS (SELECT conv_id AS item_id, conv_id * 1000 + turn AS qa_id, turn AS seq, text FROM conversations WHERE role = 'user'),
todos AS (SELECT item_id, qa_id, unnest(range(0, len(string_split(text, chr(10))))) AS todo_id FROM questions)"""


@checked(f"""
WITH {HISTORY} SELECT item_id, type, date FROM items
WHERE (contains(lower(service_name), 'en') OR contains(lower(coalesce(query, '')), 'en')) AND type = 'url'""")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, _ = history_tables(spark, sf_dir)
    return history.search(items, "EN", "url").select("item_id", "type", "date")


@checked(f"""
WITH {HISTORY},
clicks AS (SELECT event_id // 2 % 5 AS todo_id, user_id AS item_id, user_id * 1000 + event_id % 3 * 2 AS qa_id, count(*) AS n FROM events GROUP BY ALL)
SELECT t.item_id, t.qa_id, t.todo_id, (t.todo_id % 2 = 1) <> (coalesce(n, 0) % 2 = 1) AS checked FROM todos t LEFT JOIN clicks c USING (item_id, qa_id, todo_id)""")
def toggled_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, todos = history_tables(spark, sf_dir)
    e, u = F.col("event_id"), F.col("user_id")
    clicks = table(spark, sf_dir, "events").select(
        u.alias("item_id"), (u * 1000 + e % 3 * 2).alias("qa_id"), F.floor(e / 2 % 5).cast("int").alias("todo_id")
    )
    return history.toggle_todos(todos, clicks).select(
        "item_id", "qa_id", F.col("todo_id").cast("long").alias("todo_id"), "checked"
    )


def _appended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, asked, _ = history_tables(spark, sf_dir)
    new = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), (F.col("event_id") + 10**9).alias("qa_id"), (F.col("event_id") + 1000).alias("seq")
    )
    return history.append_questions(items, asked, new)


@checked(f"""
WITH {HISTORY}, new AS (SELECT user_id AS item_id, max(event_id) + 1000000000 AS qa_id FROM events GROUP BY user_id)
SELECT item_id, coalesce(qa_id, selected_qa_id) AS selected_qa_id FROM items LEFT JOIN new USING (item_id)""")
def selected_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir)[0].select("item_id", "selected_qa_id")


@checked(f"""
WITH {HISTORY} SELECT item_id, qa_id, seq FROM questions
UNION ALL SELECT user_id, event_id + 1000000000, event_id + 1000 FROM events WHERE user_id IN (SELECT item_id FROM items)""")
def appended_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir)[1].select("item_id", "qa_id", "seq")


_DELETED = "SELECT DISTINCT user_id AS item_id, user_id * 1000 + event_id % 3 * 2 AS qa_id FROM events WHERE event_type = 'error'"


@checked(f"""
WITH {HISTORY}, gone AS ({_DELETED}), remaining AS (SELECT * FROM questions ANTI JOIN gone USING (item_id, qa_id)),
first AS (SELECT item_id, arg_min(qa_id, seq) AS f FROM remaining GROUP BY item_id)
SELECT i.item_id, CASE WHEN g.qa_id IS NOT NULL THEN f ELSE selected_qa_id END AS selected_qa_id, coalesce(n, 0) AS questions
FROM items i LEFT JOIN gone g ON g.item_id = i.item_id AND g.qa_id = i.selected_qa_id LEFT JOIN first ON first.item_id = i.item_id
LEFT JOIN (SELECT item_id, count(*) AS n FROM remaining GROUP BY item_id) c ON c.item_id = i.item_id""")
def deleted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, asked, _ = history_tables(spark, sf_dir)
    u = F.col("user_id")
    gone = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        u.alias("item_id"), (u * 1000 + F.col("event_id") % 3 * 2).alias("qa_id")
    )
    moved, left = history.delete_questions(items, asked, gone)
    counts = left.groupBy("item_id").agg(F.count("*").alias("questions"))
    return moved.join(counts, "item_id", "left").select("item_id", "selected_qa_id", F.coalesce("questions", F.lit(0)).alias("questions"))


@checked(f"""
WITH {HISTORY}, gone AS (SELECT user_id AS item_id FROM events WHERE event_type = 'signup' AND value > 60)
SELECT item_id, 'item' AS what FROM items WHERE item_id NOT IN (SELECT item_id FROM gone)
UNION ALL SELECT qa_id, 'question' FROM questions WHERE item_id NOT IN (SELECT item_id FROM gone)""")
def deleted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, asked, _ = history_tables(spark, sf_dir)
    gone = table(spark, sf_dir, "events").where("event_type = 'signup' AND value > 60").select(F.col("user_id").alias("item_id"))
    items, asked = history.delete_items(gone, items, asked)
    return items.select("item_id", F.lit("item").alias("what")).union(asked.select("qa_id", F.lit("question")))


_ACTIONS = ("toggle", "append", "delete", "toggle", "append", "toggle", "delete")
_ACTION_LOG = f"""
log AS (SELECT user_id AS item_id, event_id + 1000 AS seq, user_id * 1000 + event_id % 5 AS qa_id, event_id // 3 % 3 AS todo_id,
          CASE WHEN event_id % 97 = 0 THEN 'delete_item' ELSE {S.sql_pick(_ACTIONS, '(event_id // 2 + user_id)')} END AS action,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
starts AS (SELECT i.item_id, coalesce(list(qa_id ORDER BY seq) FILTER (qa_id IS NOT NULL), []) AS live, any_value(selected_qa_id) AS sel
           FROM items i LEFT JOIN questions q USING (item_id) GROUP BY i.item_id),
states AS (
  SELECT item_id, 0 AS step, live, sel, []::VARCHAR[] AS flips, []::BIGINT[] AS fresh, false AS dead FROM starts
  UNION ALL
  SELECT s.item_id, l.step,
    CASE action WHEN 'append' THEN list_append(list_filter(live, lambda x: x <> l.qa_id), l.qa_id)
                WHEN 'delete' THEN list_filter(live, lambda x: x <> l.qa_id) ELSE live END,
    CASE WHEN action = 'append' THEN l.qa_id WHEN action = 'delete' AND sel = l.qa_id THEN list_filter(live, lambda x: x <> l.qa_id)[1] ELSE sel END,
    CASE WHEN action IN ('append', 'delete') THEN list_filter(flips, lambda x: NOT starts_with(x, l.qa_id || '/'))
         WHEN action = 'toggle' AND list_contains(live, l.qa_id) THEN
           CASE WHEN list_contains(flips, l.qa_id || '/' || l.todo_id) THEN list_filter(flips, lambda x: x <> l.qa_id || '/' || l.todo_id)
                ELSE list_append(flips, l.qa_id || '/' || l.todo_id) END
         ELSE flips END,
    CASE WHEN action = 'append' THEN list_append(fresh, l.qa_id) ELSE fresh END,
    dead OR action = 'delete_item'
  FROM states s JOIN log l ON l.item_id = s.item_id AND l.step = s.step + 1 WHERE NOT dead),
ended AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY step DESC) = 1),
final AS (SELECT * FROM ended WHERE NOT dead),
lived AS (SELECT item_id, flips, fresh, unnest(live) AS qa_id FROM final)"""


@checked(f"""
WITH RECURSIVE {HISTORY}, {_ACTION_LOG}
SELECT 'item' AS what, item_id, sel AS qa_id, 0 AS todo_id, false AS checked FROM final
UNION ALL SELECT 'question', item_id, qa_id, 0, false FROM lived
UNION ALL SELECT 'todo', l.item_id, l.qa_id, t.todo_id, (t.todo_id % 2 = 1) <> list_contains(flips, l.qa_id || '/' || t.todo_id)
  FROM lived l JOIN todos t ON t.item_id = l.item_id AND t.qa_id = l.qa_id WHERE NOT list_contains(fresh, l.qa_id)
UNION ALL SELECT 'todo', item_id, qa_id, n, list_contains(flips, qa_id || '/' || n)
  FROM lived, (SELECT unnest(range(2)) AS n) WHERE list_contains(fresh, qa_id)""")
def applied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of mixed edits to the history; an appended question has two open todos."""
    items, asked, todos = history_tables(spark, sf_dir)
    e, u = F.col("event_id"), F.col("user_id")
    action = F.when(e % 97 == 0, "delete_item").otherwise(S.pick(_ACTIONS, F.floor(e / 2) + u))
    log = table(spark, sf_dir, "events").select(
        u.alias("item_id"), (e + 1000).alias("seq"), action.alias("action"), (u * 1000 + e % 5).alias("qa_id"),
        (F.floor(e / 3) % 3).cast("int").alias("todo_id"),
    )
    new = log.where("action = 'append'").select("item_id", "qa_id").distinct()
    new_todos = new.withColumn("todo_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("checked", F.lit(False))
    items, asked, todos = history.apply_actions(
        items, asked.select("item_id", "qa_id", "seq"), todos.select("item_id", "qa_id", "todo_id", "checked"), log, new, new_todos
    )
    row = lambda df, what, todo, checked: df.select(
        F.lit(what).alias("what"), "item_id", "qa_id", todo.cast("long").alias("todo_id"), checked.alias("checked")
    )
    none, no = F.lit(0), F.lit(False)
    return row(items.withColumnRenamed("selected_qa_id", "qa_id"), "item", none, no).union(row(asked, "question", none, no)).union(
        row(todos, "todo", F.col("todo_id"), F.col("checked"))
    )


@checked(f"""
WITH {HISTORY}, active AS (
  SELECT item_id, arg_max(qa_id, (coalesce(qa_id = selected_qa_id, false)::INT, seq)) AS qa_id FROM questions JOIN items USING (item_id) GROUP BY item_id)
SELECT item_id, qa_id, array_to_string(string_split(text, '.')[1:3], '|') AS follow_ups FROM active JOIN questions USING (item_id, qa_id)""")
def active_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, asked, _ = history_tables(spark, sf_dir)
    shown = history.active_questions(items, asked, V.FOLLOW_UPS_SHOWN)
    return shown.select("item_id", "qa_id", F.array_join("follow_ups", "|").alias("follow_ups"))


@checked(f"WITH {HISTORY} SELECT (SELECT count(*) FROM items) AS analyses, (SELECT count(*) FROM questions) AS questions")
def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, asked, _ = history_tables(spark, sf_dir)
    return history.totals(items, asked)


@checked(f"""
WITH {HISTORY} SELECT item_id, service_name, count(qa_id) AS questions FROM items LEFT JOIN questions USING (item_id)
GROUP BY item_id, service_name ORDER BY questions DESC, item_id LIMIT 1""")
def most_active_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, asked, _ = history_tables(spark, sf_dir)
    return history.most_active(items, asked)


@checked(f"WITH {HISTORY} SELECT type, count(*) AS items FROM items GROUP BY type")
def history_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, _ = history_tables(spark, sf_dir)
    return history.counts_by_type(items)


@checked(f"""
WITH {VERDICTS}, {_ANSWERS},
asked AS (SELECT conv_id * 1000 + turn AS run_id, conv_id, turn, (conv_id + turn) % 10 <> 0 AS in_scope FROM conversations),
ends AS (SELECT a.run_id, a.conv_id, a.turn, in_scope, coalesce(bool_or(status = 'PASS' AND retry_count <= 2), false) AS passed,
                coalesce(max(retry_count), -1) AS logged FROM asked a LEFT JOIN rounds r ON r.run_id = a.conv_id GROUP BY ALL),
said AS (SELECT run_id, e.conv_id, e.turn, ls, off FROM ends e JOIN ans USING (conv_id, turn) WHERE in_scope AND passed),
held AS (SELECT conv_id * 1000 + turn AS run_id, regexp_replace(text, '[ \\n]', '', 'g') AS t FROM conversations WHERE (conv_id + turn) % 2 = 0
         UNION ALL SELECT conv_id * 1000 + turn + 1, regexp_replace(text, '[ \\n]', '', 'g') FROM conversations),
grounds AS (SELECT run_id, sentence_no, bool_or(coalesce(contains(t, replace(s, ' ', '')), false)) AS whole
            FROM (SELECT run_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS sentence_no FROM said WHERE NOT off) LEFT JOIN held USING (run_id) GROUP BY ALL)
SELECT run_id, 'answer' AS kind, md5(CASE WHEN off THEN '{V.NO_EVIDENCE_TEXT}' ELSE array_to_string(ls, chr(10) || chr(10)) END) AS detail FROM said
UNION ALL SELECT run_id, 'answer', md5('{V.NO_EVIDENCE_TEXT}') FROM ends WHERE NOT in_scope
UNION ALL SELECT run_id, 'problem', CASE WHEN logged >= 2 THEN 'generate_insufficient_evidence_answer' ELSE 'unfinished' END FROM ends WHERE in_scope AND NOT passed
UNION ALL SELECT DISTINCT run_id, 'problem', 'ungrounded' FROM grounds WHERE NOT whole""")
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a run, with the verdicts of the user of the conversation's number.

    The hits of a run are the turn before it, and its own text if conversation and turn are both odd or both even.
    """
    turns = table(spark, sf_dir, "conversations")
    i, turn = F.col("conv_id"), F.col("turn")
    run = i * 1000 + turn
    asked = turns.select(
        run.alias("run_id"), (i % 7).alias("item_id"), run.alias("qa_id"), run.alias("seq"), F.col("role").alias("question"),
        ((i + turn) % 10 != 0).alias("in_scope"),
    )
    log = turns.select(i.alias("_user"), run.alias("_run")).join(verdicts(spark, sf_dir), F.col("_user") == F.col("run_id"))
    log = log.withColumn("run_id", F.col("_run")).drop("_user", "_run")
    raw = raw_answers(spark, sf_dir).select(F.col("qa_id").alias("run_id"), "answer")
    own = turns.where((i + turn) % 2 == 0).select(run.alias("run_id"), F.col("text").alias("document"))
    hits = own.union(turns.select((run + 1).alias("run_id"), "text"))
    items = asked.select("item_id").distinct().withColumn("selected_qa_id", F.lit(None).cast("long"))
    none = spark.createDataFrame([], "item_id long, qa_id long, seq long")
    _, rows, problems = jobs.finish_runs(asked, log, raw, hits, items, none)
    return rows.select(F.col("qa_id").alias("run_id"), F.lit("answer").alias("kind"), F.md5("evidence").alias("detail")).union(
        problems.select("run_id", F.lit("problem").alias("kind"), F.col("problem").alias("detail"))
    )
