"""The analysis history as flat tables, and batches of edits to it.

items(item_id, service_name, type, query, date, selected_qa_id),
questions(item_id, qa_id, seq, ...), todos(item_id, qa_id, todo_id, text, checked).
Nothing is gathered per item, so an item may hold any number of questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested history rows (with ``queries`` and their ``todo`` lists) as the three tables."""
    items = nested.drop("queries")
    asked = nested.select("item_id", F.posexplode("queries").alias("seq", "_q"))
    questions = asked.select("item_id", "seq", "_q.*").drop("todo")
    todos = asked.select(
        "item_id", F.col("_q.qa_id").alias("qa_id"), F.inline(F.col("_q.todo"))
    )
    return items, questions, todos


def search(items: DataFrame, term: str = "", kind: str = "all") -> DataFrame:
    """Items whose service or query holds the term, of one type or all, newest first."""
    word = F.lit(term.lower())
    found = F.lower("service_name").contains(word) | F.lower(F.coalesce("query", F.lit(""))).contains(word)
    rows = items.where(found)
    if kind != "all":
        rows = rows.where(F.col("type") == kind)
    return rows.orderBy(F.desc("date"), F.desc("item_id"))


def toggle_todos(todos: DataFrame, toggles: DataFrame) -> DataFrame:
    """Applies (item_id, qa_id, todo_id) clicks; an even number of them cancels out."""
    keys = ["item_id", "qa_id", "todo_id"]
    odd = toggles.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("_odd")).where("_odd")
    return todos.join(odd, keys, "left").withColumn(
        "checked", F.col("checked") != F.coalesce("_odd", F.lit(False))
    ).drop("_odd")


def append_questions(
    items: DataFrame, questions: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Adds questions (with their ``seq``) and selects the newest new one of each item.

    Questions of unknown items are ignored.
    """
    known = new.join(items.select("item_id"), "item_id", "left_semi")
    newest = known.groupBy("item_id").agg(F.max(F.struct("seq", "qa_id"))["qa_id"].alias("_newest"))
    selected = items.join(newest, "item_id", "left").withColumn(
        "selected_qa_id", F.coalesce("_newest", "selected_qa_id")
    ).drop("_newest")
    return selected, questions.unionByName(known, allowMissingColumns=True)


def delete_questions(
    items: DataFrame, questions: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Removes (item_id, qa_id) rows; a removed selection moves to the first one left, or none."""
    keys = ["item_id", "qa_id"]
    gone = deleted.select(*keys).distinct()
    left = questions.join(gone, keys, "left_anti")
    first = left.groupBy("item_id").agg(F.min(F.struct("seq", "qa_id"))["qa_id"].alias("_first"))
    hit = gone.withColumnRenamed("qa_id", "selected_qa_id").withColumn("_hit", F.lit(True))
    moved = (
        items.join(hit, ["item_id", "selected_qa_id"], "left")
        .join(first, "item_id", "left")
        .withColumn(
            "selected_qa_id",
            F.when(F.col("_hit"), F.col("_first")).otherwise(F.col("selected_qa_id")),
        )
        .drop("_hit", "_first")
    )
    return moved, left


def delete_items(deleted: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Removes items, and their rows from the other tables."""
    gone = deleted.select("item_id").distinct()
    return tuple(t.join(gone, "item_id", "left_anti") for t in tables)


def apply_actions(
    items: DataFrame, questions: DataFrame, todos: DataFrame, actions: DataFrame,
    new_questions: DataFrame, new_todos: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An ordered log of edits, applied as if one by one: (items, questions, todos) afterwards.

    actions(item_id, seq, action, qa_id, todo_id) in any interleaving; ``seq`` is unique within an
    item and beyond that of its stored questions.  ``append`` adds the row of ``new_questions`` and its
    ``new_todos`` at the end (a question that is there starts anew) and selects it;
    ``delete`` removes a question, and if it was selected the first one left is; ``toggle`` flips a
    todo of a question that is there; ``delete_item`` ends the item and whatever follows on it.
    Edits of what is not there change nothing.

    No log is folded row by row.  A question is there if its last append is later than its last
    delete; a todo's flips count from its question's last append; and as nothing is added
    after an item's last append, a selection that goes after it ends at the first question left.
    All of these are partial aggregates by question or item, so a third of the log may be one item's.
    """
    keys = ["item_id", "qa_id"]
    gone = actions.where("action = 'delete_item'").select("item_id").distinct()
    items, questions, todos = (t.join(gone, "item_id", "left_anti") for t in (items, questions, todos))
    log = actions.join(items.select("item_id"), "item_id", "left_semi")
    at = lambda kind: F.max(F.when(F.col("action") == kind, F.col("seq")))
    edited = log.where("action in ('append', 'delete')").groupBy(*keys).agg(at("append").alias("_added"), at("delete").alias("_deleted"))
    alive = edited.where("_added is not null and (_deleted is null or _deleted < _added)").select(*keys, "_added")
    added = new_questions.drop("seq").join(alive, keys).withColumnRenamed("_added", "seq")
    left = questions.join(edited.select(*keys), keys, "left_anti").unionByName(added, allowMissingColumns=True)

    old = todos.join(edited.select(*keys), keys, "left_anti").withColumn("_added", F.lit(None).cast("long"))
    held = old.unionByName(new_todos.join(alive.withColumn("_added", F.col("_added").cast("long")), keys), allowMissingColumns=True)
    flips = log.where("action = 'toggle'").join(alive, keys, "left").where("_added is null or seq > _added")
    odd = flips.groupBy(*keys, "todo_id").agg((F.count("*") % 2 == 1).alias("_odd")).where("_odd")
    # Flips of an old question that was deleted find no todo; those of a new one are counted above.
    held = held.drop("_added").join(odd, [*keys, "todo_id"], "left").withColumn(
        "checked", F.col("checked") != F.coalesce("_odd", F.lit(False))
    ).drop("_odd")

    newest = log.where("action = 'append'").groupBy("item_id").agg(F.max(F.struct("seq", "qa_id")).alias("_newest"))
    first = left.groupBy("item_id").agg(F.min(F.struct("seq", "qa_id"))["qa_id"].alias("_first"))
    chosen = items.join(newest, "item_id", "left").withColumn("_chosen", F.coalesce(F.col("_newest.qa_id"), F.col("selected_qa_id")))
    chosen = chosen.join(edited.select("item_id", F.col("qa_id").alias("_chosen"), "_deleted"), ["item_id", "_chosen"], "left")
    went = F.col("_deleted").isNotNull() & (F.col("_newest").isNull() | (F.col("_deleted") > F.col("_newest.seq")))
    moved = chosen.join(first, "item_id", "left").withColumn(
        "selected_qa_id", F.when(went, F.col("_first")).otherwise(F.col("_chosen"))
    )
    return moved.select(*items.columns), left, held


def active_questions(items: DataFrame, questions: DataFrame, follow_ups: int | None = None) -> DataFrame:
    """The selected question of each item, else its last one."""
    chosen = F.col("qa_id") == F.col("selected_qa_id")
    best = F.max(F.struct(F.coalesce(chosen, F.lit(False)).alias("chosen"), "seq", "qa_id"))
    active = (
        questions.select("item_id", "qa_id", "seq").join(items.select("item_id", "selected_qa_id"), "item_id")
        .groupBy("item_id").agg(best["qa_id"].alias("qa_id"))
    )
    shown = active.join(questions, ["item_id", "qa_id"])
    if follow_ups is not None:
        shown = shown.withColumn("follow_ups", F.slice("follow_ups", 1, follow_ups))
    return shown


def totals(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Number of analyses and of questions."""
    asked = questions.join(items.select("item_id"), "item_id", "left_semi").agg(F.count("*").alias("questions"))
    return items.agg(F.count("*").alias("analyses")).withColumn("questions", asked.scalar())


def most_active(items: DataFrame, questions: DataFrame, order: str = "item_id") -> DataFrame:
    """The item with the most questions; the first in input order on ties."""
    counts = questions.groupBy("item_id").agg(F.count("*").alias("questions"))
    return (
        items.join(counts, "item_id", "left")
        .select("item_id", "service_name", F.coalesce("questions", F.lit(0)).alias("questions"), F.col(order).alias("_order"))
        .orderBy(F.desc("questions"), "_order").limit(1).drop("_order")
    )


def counts_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("type").agg(F.count("*").alias("items"))
