"""Toxicity (6): Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is a trie of terms: whole words, which match within an edit (two for long ones),
and stems, which begin a word.  The edit automaton of a term and the trie are walked together
as one automaton whose states are sets of (trie node, edits so far); it is made deterministic
while words come, so a word is left at the first letter that no term can follow.

Terms come from labelled texts and a small fixed list; each kind of hit (the term, as written
or misspelled, quoted or open) has the log odds that labelled texts give it.  A window of
words around a hit tells a quoted term from abuse.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import given_back, query, saved, table

FIT_ROWS = 20_000  # labelled texts that the lexicon and its weights are learned from, about
THRESHOLD = 0.7
WINDOW = 8
LEAST_DOCS = 5  # toxic texts that must hold a learned term
PURITY = 9  # toxic texts per clean text that hold it, or its share of their words over that in clean ones, at least
DEVIATIONS = 2.0  # that such a share of words is taken to be too high by chance
FLUSH_TERMS = 100_000
STEM_LETTERS = range(4, 11)
KNOWN_WORDS = 100_000  # results kept per task; a full store is emptied
STATES_KEPT = 100_000

# Mild insults of general English, for tables without labels.
SEED_TERMS = (
    "bastard", "clown", "coward", "crap", "cretin", "damn", "degenerate", "despicable", "dimwit", "disgusting",
    "dumb", "dumbass", "filth", "fool", "freak", "garbage", "hateful", "idiot", "imbecile", "jerk", "liar", "loser",
    "lunatic", "moron", "pathetic", "pig", "repulsive", "rubbish", "scum", "scumbag", "shameful", "sleazy", "stupid",
    "trash", "ugly", "useless", "vermin", "vile", "worthless", "wretch",
)
# Words that report what someone else said, and words that address a reader.
REPORTING = frozenset("said says say called calls wrote writes quote quoted word words term terms dit dijo sagte named".split())
ADDRESSING = frozenset("you your youre you're u ur tu vous du ihr usted".split())
QUOTES = "\"“”„«»‹›"
EDGE = ".,;:!?()[]{}<>\"'“”„‚‘’«»‹›…*#%&$|_~^=+-/\\"


def edits_of(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class TermAutomaton:
    """Matches words with the terms of a trie; see ``match``."""

    def __init__(self, words: list[str], stems: list[str]):
        self.below: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.edits = [0]  # of any word below a node
        for term, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            at, path = 0, [0]
            for letter in term:
                if letter not in self.below[at]:
                    self.below[at][letter] = len(self.below)
                    self.below.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.edits.append(0)
                at = self.below[at][letter]
                path.append(at)
            (self.stem if is_stem else self.word)[at] = term
            if not is_stem:
                for node in path:
                    self.edits[node] = max(self.edits[node], edits_of(term))
        self.letters = {letter for node in self.below for letter in node}
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.sets = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, str] | None] = [None]
        self.begins: list[tuple[str, str] | None] = [None]
        self.start = self._number(self._closed({(0, 0, "")}))

    def _closed(self, states: set) -> frozenset:
        """With the states that leave out letters of a term."""
        todo = list(states)
        while todo:
            node, edits, owed = todo.pop()
            if not owed and edits < self.edits[node]:
                for child in self.below[node].values():
                    if edits < self.edits[child] and (new := (child, edits + 1, "")) not in states:
                        states.add(new)
                        todo.append(new)
        return frozenset(states)

    def _number(self, states: frozenset) -> int:
        if states in self.numbers:
            return self.numbers[states]
        number = self.numbers[states] = len(self.sets)
        self.sets.append(states)
        self.steps.append({})
        ends = sorted(
            (edits, self.word[node]) for node, edits, owed in states
            if not owed and self.word[node] and edits <= edits_of(self.word[node])
        )
        self.ends.append((ends[0][1], "near" if ends[0][0] else "exact") if ends else None)
        stems = [self.stem[node] for node, edits, owed in states if not owed and not edits and self.stem[node]]
        self.begins.append((min(stems), "stem") if stems else None)
        return number

    def _step(self, number: int, letter: str) -> int:
        """Where a letter leads: as it is, in place of another, besides, or swapped with the next."""
        out = set()
        for node, edits, owed in self.sets[number]:
            if owed:
                if letter == owed:
                    out.add((node, edits, ""))
                continue
            child = self.below[node].get(letter)
            if child is not None:
                out.add((child, edits, ""))
            if edits < self.edits[node]:
                out.add((node, edits + 1, ""))
                for first, child in self.below[node].items():
                    if edits < self.edits[child]:
                        out.add((child, edits + 1, ""))
                        swapped = self.below[child].get(letter)
                        if swapped is not None and first != letter:
                            out.add((swapped, edits + 1, first))
        return self._number(self._closed(out))

    def match(self, word: str) -> tuple[str, str] | None:
        """(term, "exact", "near" or "stem") for a word, or None."""
        if len(self.sets) > STATES_KEPT:
            self._restart()
        at = self.start
        for letter in word:
            if letter not in self.letters:
                letter = "\0"
            to = self.steps[at].get(letter)
            if to is None:
                to = self.steps[at][letter] = self._step(at, letter)
            if not to:
                return None
            if self.begins[to]:
                return self.begins[to]
            at = to
        return self.ends[at]


class Hits(dict):
    """Words to what they match, worked out when a word is first seen."""

    def __init__(self, automaton: TermAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[str, str] | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = self.automaton.match(word.strip(EDGE))
        return found

    def of(self, text: str | None) -> Counter:
        """(term, kind, context) -> number of hits in a text."""
        if not text:
            return Counter()
        words = text.lower().split()
        if not any(map(self.__getitem__, set(words))):
            return Counter()
        return Counter(
            (*hit, context(words, k)) for k, hit in enumerate(map(self.__getitem__, words)) if hit
        )


def context(words: list[str], at: int) -> str:
    """"quoted", "aimed" or "open" by the window of words around a hit."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    own = words[at]
    opened = any(q in w for w in [*before, own[:1]] for q in QUOTES)
    closed = any(q in w for w in [own[1:], *after] for q in QUOTES)
    if opened and closed or any(w.strip(EDGE) in REPORTING for w in before[-3:]):
        return "quoted"
    return "aimed" if any(w.strip(EDGE) in ADDRESSING for w in [*before, *after]) else "open"


# Prior log odds of a kind of hit without evidence.
PRIOR = {
    ("exact", "open"): 2.5, ("exact", "aimed"): 3.0, ("exact", "quoted"): 0.5,
    ("near", "open"): 1.2, ("near", "aimed"): 1.6, ("near", "quoted"): 0.2,
    ("stem", "open"): 2.0, ("stem", "aimed"): 2.5, ("stem", "quoted"): 0.4,
}
PRIOR_DOCS = 2.0  # texts that a prior counts as
MOST_WEIGHT = 6.0
LEVELS = 4  # of counts of a hit in a text: 1, 2 and 3, 4 to 7, more


def level(count: int) -> int:
    return min(LEVELS, count.bit_length()) - 1


def prior(kind: str, where: str, at: int) -> float:
    """Log odds without evidence of a hit that a text has 2**at times."""
    return PRIOR[kind, where] * (1 + at * math.log(2))


class Model:
    """Terms, weights and bias; plain values, so it travels with a query."""

    def __init__(self, words: list[str], stems: list[str], weights: dict[tuple[str, str, str, int], float], bias: float):
        self.words, self.stems, self.weights, self.bias = words, stems, weights, bias

    def score(self, hits: Counter) -> float:
        total = self.bias
        for (term, kind, where), count in hits.items():
            at = level(count)
            weight = self.weights.get((term, kind, where, at))
            total += prior(kind, where, at) if weight is None else weight
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _prefixes(text: str | None) -> tuple[Counter, int]:
    """(how often words and prefixes of words occur, words in all) of a text."""
    words = (text or "").lower().split()
    found: Counter = Counter()
    for word, n in Counter(w.strip(EDGE) for w in words).items():
        if len(word) >= STEM_LETTERS[0]:
            found[word + " "] += n  # a whole word
            for k in STEM_LETTERS:
                if k <= len(word):
                    found[word[:k]] += n
    return found, len(words)


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each term: toxic and clean texts with it, occurrences in both; of "", all words.

    The counts of a part of the texts come out as soon as they hold ``FLUSH_TERMS`` terms.
    """
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        terms = sorted({*counts[0], *counts[1]})
        out = pd.DataFrame({
            "term": terms, "docs": [docs[1][t] for t in terms], "clean": [docs[0][t] for t in terms],
            "bad": [counts[1][t] for t in terms], "good": [counts[0][t] for t in terms],
        })
        for counter in (*docs, *counts):
            counter.clear()
        return out

    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"]):
            found, n = _prefixes(text)
            found[""] = n
            counts[int(toxic)].update(found)
            docs[int(toxic)].update(found.keys())
            if len(counts[0]) + len(counts[1]) >= FLUSH_TERMS:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()


def chosen_terms(rows: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """(words, stems) from (term, toxic texts with it); whole words end in a space.

    A prefix is a stem if no single word makes up most of it; of prefixes held by the same
    texts the longest counts.  Words that begin with a stem stay words too, as stems have no edits.
    """
    words = {t[:-1]: m for t, m in rows if t.endswith(" ")}
    held = {t: m for t, m in rows if not t.endswith(" ")}
    main: dict[str, int] = {}
    longer: dict[str, int] = {}
    for word, m in words.items():
        for k in STEM_LETTERS:
            if k <= len(word):
                main[word[:k]] = max(main.get(word[:k], 0), m)
    for prefix, m in held.items():
        longer[prefix[:-1]] = max(longer.get(prefix[:-1], 0), m)
    loose = {p for p, m in held.items() if main.get(p, 0) < 0.7 * m and longer.get(p, 0) < 0.95 * m}
    stems = [p for p in sorted(loose) if not any(p[:k] in loose for k in STEM_LETTERS if k < len(p))]
    return sorted(words), stems


def _hit_counts(words: list[str], stems: list[str]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(TermAutomaton(words, stems))
        for batch in batches:
            counts = Counter(
                (*key, level(n), int(t)) for t, text in zip(batch["toxic"], batch["text"]) for key, n in hits.of(text).items()
            )
            data = [(*key, n) for key, n in sorted(counts.items())]
            yield pd.DataFrame(data, columns=["term", "kind", "place", "at", "toxic", "n"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model of about ``fit_rows`` labelled texts, rows of ``held_out`` ids excepted.

    Without labels of both kinds the fixed terms and prior weights are all there is.
    """
    known = labels.where(~held_out(id_col)).where("toxic in (0, 1)").select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > fit_rows:
        part = F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(1 << 30)) < int(fit_rows / total * (1 << 30))
        known = known.where(part)
    # About fit_rows narrow rows: bounded, so only their texts are shuffled, to count equal ones once.
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(
        F.broadcast(known), F.col("_doc") == F.col("_id")
    ).select("text", "toxic").dropDuplicates()
    texts, _ = saved(texts, "labelled")
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    learned: list[tuple[str, int]] = []
    if bad and good:
        counts, _ = saved(
            texts.mapInPandas(given_back(_term_counts), "term string, docs long, clean long, bad long, good long").groupBy("term").agg(
                *(F.sum(c).alias(c) for c in ("docs", "clean", "bad", "good"))
            ),
            "terms",
        )
        whole = counts.where("term = ''").first()
        share = (F.col("bad") - DEVIATIONS * F.sqrt("bad")) * whole["good"] >= PURITY * (F.col("good") + 1.0) * whole["bad"]
        present = (F.col("docs") >= PURITY * F.col("clean")) & (F.col("docs") * good >= PURITY * F.col("clean") * bad)
        pure = counts.where((F.col("term") != "") & (F.col("docs") >= LEAST_DOCS) & (share | present))
        learned = [(r["term"], r["docs"]) for r in pure.collect()]  # from about fit_rows texts
    words, stems = chosen_terms(learned)
    words = sorted({*words, *SEED_TERMS})
    weights: dict[tuple[str, str, str, int], float] = {}
    if bad and good:
        hits = texts.mapInPandas(given_back(_hit_counts(words, stems)), "term string, kind string, place string, at int, toxic int, n long")
        rows = hits.groupBy("term", "kind", "place", "at").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
        ).collect()  # at most nine rows a term and level
        for r in rows:
            share = 1 / (1 + math.exp(-prior(r["kind"], r["place"], r["at"])) * good / bad)  # of toxic texts among those with such a hit
            found = (r["bad"] + PRIOR_DOCS * share) / (r["good"] + PRIOR_DOCS * (1 - share)) * good / bad
            weights[r["term"], r["kind"], r["place"], r["at"]] = max(-1.0, min(MOST_WEIGHT, math.log(found)))
    bias = math.log((bad + 1) / (good + 10)) if bad and good else math.log(0.1)
    return Model(words, stems, weights, max(-4.0, min(-1.0, bias)))


def score(text: str | Column, model: Model) -> Column:
    """Between 0 and 1 for every text; null and empty texts have the score of a text without hits."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits = Hits(TermAutomaton(model.words, model.stems))

        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(np.array([model.score(hits.of(t)) for t in texts], np.float64))

        yield from given_back(scores)(batches)

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted`` (1 from ``THRESHOLD`` on).

    Equal texts have equal scores; a null id is not held out.  Other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(text_col, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(score(text_col, model) < THRESHOLD)


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
