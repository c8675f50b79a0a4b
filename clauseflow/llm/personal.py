"""Personal data (9): exact patterns, and a semi-Markov conditional random field for the rest.

The field scores whole candidate spans, not letters: digits, separators, checksum, cue words
before it, what stands on either side.  A dynamic program over spans of at most
``MOST_ATOMS`` atoms chooses boundaries and kinds together.  It is trained on regions of
a bounded sample of the documents, whose spans the patterns know, and on pairs of such regions
written side by side, where patterns run together; it adds what the patterns miss, such as
two card numbers in a row, a phone number before an address, or a secret.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import query, table

KINDS = ("email", "ip", "card", "phone", "secret")
MOST_ATOMS = 16
FIT_DOCS = 2_000  # documents the field is trained on, about
FIT_REGIONS = 400
PIECE = 4096  # letters of a region that are segmented at once, about
ROUNDS = 6
STEP = 0.05
CUE_CHARS = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwort|clave|(?:api[_ ]?)?key)\b[\x20]*[=:][\x20]*[\"']?([A-Za-z0-9_-]{16,64})")
_REGION = re.compile(r"(?:[^\s0-9@]{0,64}[0-9@]\S*)(?:[\x20](?:[^\s0-9@]{0,3}[0-9@]\S*))*")
_RUN = re.compile(r"[^\W_]{16}")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{16,}")
_LOCAL_PHONE = re.compile(r"\(?0[0-9]{1,4}\)?[\x20/-]?[0-9]{2,5}(?:[\x20-]?[0-9]{2,5})*|\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}")
_ATOM = re.compile(r"[^\W_]+|.", re.S)

# Words that announce a kind.
CUES = {
    "email": ("mail", "email", "e-mail", "contact"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "secret", "password", "key", "passwort", "clave", "aws", "bearer", "credential"),
}

# How keys of widely used services begin.
KEY_BEGINNINGS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_", "pk_", "rk_", "xoxb-", "xoxp-", "eyJ")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    """At most 255; leading zeros may be any number."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and kind; leftmost, not overlapping within a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), 0))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def regions(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, region, what stands before it): words with digits or an @ in a row."""
    if _DIGIT.search(text) or "@" in text:
        for m in _REGION.finditer(text):
            if "@" in m[0] or _RUN.search(m[0]) or sum(map(str.isdigit, m[0])) >= 7:
                yield from pieces(m.start(), m[0], text)


def pieces(start: int, region: str, text: str) -> Iterator[tuple[int, str, str]]:
    """A region in pieces that overlap by more than ``MOST_ATOMS`` atoms, cut between atoms."""
    ends = [m.end() for m in _ATOM.finditer(region)] if len(region) > PIECE else [len(region)]
    first = 0
    while True:
        low = ends[first - 1] if first else 0
        last = first
        while last + 1 < len(ends) and (ends[last] - low < PIECE or last - first < 4 * MOST_ATOMS):
            last += 1
        yield start + low, region[low : ends[last]], text[max(0, start + low - CUE_CHARS) : start + low]
        if last + 1 >= len(ends):
            return
        first = last + 1 - 2 * MOST_ATOMS


N_FEATURES = 23


def features(span: str, left: str, right: str, before: str) -> np.ndarray:
    """Of a whole span with its neighbours and the text before it, the same for every kind."""
    digits = _digits(span)
    n = len(digits)
    plain = not span.strip("0123456789 -")
    parts = span.split(".")
    local, _, domain = span.partition("@")
    cue = before.lower()
    letters = len(span) - n
    alnum = span.isalnum() and span.isascii()
    token = _TOKEN.fullmatch(span) is not None
    return np.array([
        1.0,
        "@" in span and bool(local) and _DOMAIN.fullmatch(domain) is not None and set(local) <= _LOCAL,
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        plain and 12 <= n <= 19 and luhn(digits),
        plain and 12 <= n <= 19,
        n in (15, 16) and plain,
        span[0] == "+" and 9 <= n <= 15 and not span.strip("+0123456789().- "),
        9 <= n <= 12 and not span.strip("+0123456789().- ") and not plain,
        7 <= n <= 15 and not span.strip("+0123456789().- ") and ("-" in span or "(" in span),
        token and n >= 1 and letters >= 4,
        alnum and 32 <= len(span) <= 64 and not span.lower().strip("0123456789abcdef"),
        " " in span,
        left.isalnum() or left in ("@", ".", "-", "+", "_"),
        right.isalnum() or right in ("@", "-", "_"),
        span.count("(") != span.count(")"),
        *(any(w in cue for w in CUES[k]) for k in KINDS),
        token and span.startswith(KEY_BEGINNINGS),
        token and n >= 2 and span.lower() != span and span.upper() != span,
        7 <= n <= 12 and _LOCAL_PHONE.fullmatch(span) is not None,
    ], np.float64)


def start_weights() -> np.ndarray:
    """What the field believes before training: a span needs its kind's shape."""
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -6
    w[:, 12:15] = -4
    w[0, 1], w[1, 2], w[2, 3], w[2, 4], w[2, 5] = 12, 12, 6, 1, 3
    w[3, 6], w[3, 7], w[3, 8], w[4, 9], w[4, 10] = 7, 1, 3, 2, 4
    for k in range(len(KINDS)):
        w[k, 15 + k] = 2
    w[4, 20], w[4, 21], w[3, 22] = 5, 2, 2
    w[2, 11] = -2
    w[4, 11] = -6
    return w


_START = start_weights()


class Lattice:
    """The candidate spans of a region and their features."""

    def __init__(self, region: str, before: str):
        self.atoms = [(m.start(), m.end()) for m in _ATOM.finditer(region)]
        self.spans: list[tuple[int, int]] = []
        rows = []
        for i, (start, _) in enumerate(self.atoms):
            if not (region[start].isalnum() or region[start] in "+("):
                continue
            for j in range(i, min(len(self.atoms), i + MOST_ATOMS)):
                end = self.atoms[j][1]
                span = region[start:end]
                if not region[end - 1].isalnum():
                    continue
                if "@" in span or sum(map(str.isdigit, span)) >= 7 or _TOKEN.fullmatch(span):
                    self.spans.append((i, j + 1))
                    cue = region[start - CUE_CHARS : start] if start >= CUE_CHARS else (before + region[:start])[-CUE_CHARS:]
                    rows.append(features(span, region[start - 1 : start], region[end : end + 1], cue))
        self.features = np.array(rows).reshape(-1, N_FEATURES)

    def best(self, weights: np.ndarray) -> list[Span]:
        """Spans of the best segmentation, in letters of the region."""
        n = len(self.atoms)
        score = self.features @ weights.T
        kind, top = (score.argmax(1), score.max(1)) if len(score) else (score, score)
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(self.spans):
            if top[k] > 0:
                ending.setdefault(j, []).append(k)
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ending.get(j, ()):
                total = value[self.spans[k][0]] + top[k]
                if total > value[j] + 1e-12:
                    value[j], back[j] = total, k
        out, j = [], n
        while j:
            k = back[j]
            if k < 0:
                j -= 1
            else:
                i, _ = self.spans[k]
                out.append((self.atoms[i][0], self.atoms[j - 1][1], int(kind[k])))
                j = i
        return out[::-1]

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """Expected features of each kind over all segmentations, by forward and backward sums."""
        n = len(self.atoms)
        score = self.features @ weights.T
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        whole = np.logaddexp.reduce(score, 1) if len(score) else np.zeros(0)
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(self.spans):
            by_end.setdefault(j, []).append(k)
            by_start.setdefault(i, []).append(k)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[self.spans[k][0]] + whole[k] for k in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[self.spans[k][1]] + whole[k] for k in by_start.get(i, ()))])
        if not len(score):
            return np.zeros_like(weights)
        outer = np.array([ahead[i] + behind[j] for i, j in self.spans]) - ahead[n]
        return np.exp(score + outer[:, None]).T @ self.features

    def observed(self, gold: list[Span]) -> np.ndarray:
        out = np.zeros((len(KINDS), N_FEATURES))
        place = {(self.atoms[i][0], self.atoms[j - 1][1]): k for k, (i, j) in enumerate(self.spans)}
        for start, end, kind in gold:
            if (start, end) in place:
                out[kind] += self.features[place[start, end]]
        return out


def gold_spans(text: str) -> list[Span]:
    """The patterns' spans and assigned secrets, a span within another left out."""
    found = base_spans(text) + [(m.start(1), m.end(1), 4) for m in _SECRET.finditer(text)]
    out: list[Span] = []
    for span in sorted(found, key=lambda s: (-(s[1] - s[0]), s)):
        if all(span[1] <= a or span[0] >= b for a, b, _ in out):
            out.append(span)
    return sorted(out)


def samples_of(text: str) -> list[tuple[str, str, list[Span]]]:
    """The short regions of a text that can teach: (region, what stands before it, gold spans).

    Where whole-span shapes stand that the patterns do not know, such as two cards in a row, the
    patterns are no evidence against them, and the region is left out.
    """
    gold = gold_spans(text)
    out = []
    for start, region, before in regions(text):
        own = [(a - start, b - start, k) for a, b, k in gold if a >= start and b <= start + len(region)]
        if len(region) <= 160:
            likely = Lattice(region, before).best(_START)
            if all(any(a < y and x < b for x, y, _ in own) for a, b, _ in likely):
                out.append((region, before, own))
    return out


def train(samples: list[tuple[str, str, list[Span]]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights by ascent on the log likelihood of (region, before, gold spans), near the start."""
    weights = start = start_weights()
    pairs = list(samples)
    for one, two in zip(samples[::2], samples[1::2]):
        gap = len(one[0]) + 1
        pairs.append((f"{one[0]} {two[0]}", one[1], one[2] + [(a + gap, b + gap, k) for a, b, k in two[2]]))
    lattices = [(Lattice(region, before), gold) for region, before, gold in pairs]
    for _ in range(rounds):
        for lattice, gold in lattices:
            weights = weights + STEP * (lattice.observed(gold) - lattice.expected(weights) - 0.01 * (weights - start))
    return weights


def fit(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS) -> np.ndarray:
    """Weights from regions of about ``fit_docs`` documents, chosen by a hash of their text.

    At most ``FIT_REGIONS`` regions reach the driver.  Without any the start weights stay.
    """
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null and length(text) > 0")
    total = docs.count()
    part = min(1.0, fit_docs / max(1, total))
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 30)) < int(part * (1 << 30)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for text in batch.column("text").to_pylist():
                data += [(region, before, [x for span in own for x in span]) for region, before, own in samples_of(text)]
            columns = zip(*data) if data else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.int32())))],
                ["region", "before", "gold"],
            )

    found = rows.mapInArrow(cut, "region string, before string, gold array<int>").distinct()
    first = found.orderBy(F.xxhash64("region", "before"), "region", "before").limit(FIT_REGIONS).collect()
    return train([(r["region"], r["before"], list(zip(*[iter(r["gold"])] * 3))) for r in first])


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """What the field finds apart from the patterns' spans, and assigned secrets."""
    found = [(m.start(1), m.end(1), 4) for m in _SECRET.finditer(text)]
    out: list[Span] = []
    for start, region, before in regions(text):
        for a, b, kind in Lattice(region, before).best(weights):
            found.append((start + a, start + b, kind))
    end, taken = 0, sorted(base)
    reach = list(itertools.accumulate((y for _, y, _ in taken), max))
    # Overlapping pieces may cut a span short: of two that begin together the longer one counts.
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        before = bisect.bisect_left(taken, (span[1],))
        if span[0] >= end and not (before and reach[before - 1] > span[0]):
            out.append(span)
            end = span[1]
    return out


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def _finder(weights: np.ndarray):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_spans"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                added = added_spans(text or "", base, weights)
                count = [sum(k == kind for _, _, k in base) for kind in range(4)]
                digest = hashlib.sha256(_said(base).encode()).hexdigest()
                data.append((*count, digest, _said(base + added), len(added), sum(k == 4 for _, _, k in added), len(base) + len(added)))
            columns = zip(*data) if data else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], ["doc", *names]
            )

    return rows


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, the digest of
    the patterns' spans, all ``spans`` (kind:start:end in code points), ``n_added`` by the field,
    ``n_secret`` of them secrets, and ``n_spans`` in all.

    A null text is empty and has no span; equal texts have equal spans; repeated rows repeat.
    Other columns are not read.
    """
    weights = fit(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(
        _finder(weights),
        f"doc {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long",
    ).withColumnRenamed("doc", id_col)


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
