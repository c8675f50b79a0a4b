"""Fill-in-middle transformation (11): cuts at unit ends, chosen by rank in a boundary set.

The ends of a text's units are a set of code point offsets, kept in containers of 65,536
neighbouring offsets each: a sorted array where few are set, a bitmap where many are, runs
where they stand side by side.  Cumulative cardinalities find the container of the k-th end,
a select within the container finds its offset.  Both cuts of a document are two selects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import query, table

MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
RATE = 100  # of 100 documents, how many are transformed
SPM_RATE = 50  # of 100 transformed ones, how many have the suffix first
SEED = 7

SPAN = 1 << 16  # offsets of a container
ARRAY_MOST = 4096  # beyond it a bitmap is smaller than an array
PORTION = 4_000_000  # letters of output in a batch, about


class Array:
    """Offsets as they are, sorted."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class Bitmap:
    """A bit for each offset, with the number of bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        word = int(self.words[at])
        for _ in range(rank - int(self.before[at])):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class Runs:
    """First offsets of runs, with the number of offsets before each run."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first = low[first].astype(np.uint16)
        self.before = first.astype(np.int64)

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.first[at]) + rank - int(self.before[at])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest of the three for some offsets, by bytes: 4 a run, 2 an offset, 8192 a bitmap."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    if 4 * runs < min(2 * len(low), SPAN // 8):
        return Runs(low)
    return Array(low) if len(low) <= ARRAY_MOST else Bitmap(low)


class Boundaries:
    """The offsets between a text's units, 0 and its length included; offset k ends k units."""

    def __init__(self, text: str):
        self.bases: list[int] = []
        self.containers: list[Array | Bitmap | Runs] = []
        sizes = [0]
        for base in range(0, len(text) + 1, SPAN):
            # Offset v ends a unit if the letter before it is a line feed.
            piece = text[max(0, base - 1) : base + SPAN - 1]
            letters = np.frombuffer(piece.encode("utf-32-le"), "<u4")
            low = np.flatnonzero(letters == 10) + (0 if base else 1)
            low = np.union1d(low, [v - base for v in (0, len(text)) if base <= v < base + SPAN])
            if len(low):
                self.bases.append(base)
                self.containers.append(container(low.astype(np.int64)))
                sizes.append(sizes[-1] + len(low))
        self.before = np.array(sizes, np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        return self.bases[at] + self.containers[at].select(rank - int(self.before[at]))


def assemble(text: str, draws: tuple[int, int, int, int], marks: tuple[str, str, str], rate: int, spm_rate: int):
    """(units, form, letters of the prefix, of the middle, output) of one text."""
    ends = Boundaries(text)
    units = len(ends) - 1
    if not text or any(m in text for m in marks) or draws[2] % 100 >= rate:
        return units, "plain", None, None, text
    ranks = sorted(h % (units + 1) for h in draws[:2])
    one, two = map(ends.select, ranks)
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    p, s, m = marks
    if draws[3] % 100 < spm_rate:
        return units, "spm", len(prefix), len(middle), "".join((s, suffix, p, prefix, m, middle))
    return units, "psm", len(prefix), len(middle), "".join((p, prefix, s, suffix, m, middle))


def draw(id_col: str, seed: int) -> Column:
    """Four numbers of 32 bits that depend on seed and id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS,
    rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
) -> DataFrame:
    """One row per input row: the id, ``n`` (lines), ``form`` (plain, psm, spm), ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``.

    A null text is empty; empty texts and texts that hold a mark stay plain, so an output is
    always read back exactly (``restored``).  The draws depend on seed and id alone: repeated rows repeat,
    rows with one id share draws, a null id draws as an empty one; reruns agree.  Ids may be of
    any type; other columns are not read.  No rows give no rows.  A long text is held once, its
    boundaries container by container.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), draw(id_col, seed).alias("draws"))
    id_type = rows.schema["doc"].dataType.simpleString()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, first, held = [], 0, 0
            texts, draws = batch.column("text"), batch.column("draws").to_pylist()
            for k in range(batch.num_rows):
                data.append(assemble(texts[k].as_py() or "", draws[k], marks, rate, spm_rate))
                held += len(data[-1][4])
                if held >= PORTION or k + 1 == batch.num_rows:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*data), kinds)]
                    columns[4] = columns[4].cast(pa.string())
                    ids = batch.column("doc").slice(first, len(data))
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc", *names])
                    data, first, held = [], k + 1, 0

    out = rows.mapInArrow(
        transform, f"doc {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return out.withColumnRenamed("doc", id_col)


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of which an output was made; what stands between marks, put back in order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    one, two, three = (F.try_element_at(parts, F.lit(k)) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


_LINES = r"'[^\n]*\n|[^\n]+'"

SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), lines AS (
    SELECT *, regexp_extract_all(text, {_LINES}) AS units,
        list_transform([1, 9, 17, 25], lambda a: ('0x' || substr(digest, a, 8))::UBIGINT::BIGINT) AS h
    FROM texts
), cuts AS (
    SELECT *, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS one,
        greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
    FROM lines
), parts AS (
    SELECT *, array_to_string(units[1:one], '') AS prefix, array_to_string(units[one + 1:two], '') AS middle,
        array_to_string(units[two + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


@query(SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored("output", "form")).alias("restored_sha256"),
    )
