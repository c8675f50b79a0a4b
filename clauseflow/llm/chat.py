"""Chat formatting (3): token-level assembly with escaped control strings.

Every turn is three segments, encoded apart: an opening mark, the text, a closing mark.
Marks are reserved ids above the vocabulary, spliced in as numbers, so no text can make one
and no token spans a boundary.  The loss mask of a turn is the running sum of +1 where a
trained segment begins and -1 where it ends.

In the readable form the marks are strings.  Where a text contains one, a backslash goes after
its first letter, and every backslash of a text is doubled, so the form reads back exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.llm.base import query, saved, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20  # no larger file travels to the tasks

# The marks, in the order of their reserved ids, and each role's pair.
MARKS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE]", "[/ROLE]")
FRAMES = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</s>")  # role name between the first two
TRAINED = "assistant"
# Fixed value: the split of text into pieces that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, MARKS)))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a public byte-level vocabulary; read on the driver, its size checked."""
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Codec:
    """Texts to ids and back; marks are the ids from the vocabulary's end on."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.base = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = {m: self.base + k for k, m in enumerate(MARKS)}

    def text(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of a turn."""
        if role in FRAMES:
            opening, closing = ([self.mark[m]] for m in FRAMES[role])
        else:
            first, second, last = (self.mark[m] for m in OTHER)
            opening, closing = [first, *self.text(escape(role)), second], [last]
        body = self.text(escape(text))
        ids = np.array([*opening, *body, *closing], np.int32)
        change = np.zeros(len(ids) + 1, np.int8)
        if role == TRAINED:
            change[len(opening)] += 1
            change[len(opening) + len(body)] -= 1
        return ids, np.cumsum(change[:-1], dtype=np.int8)

    def pieces(self, ids: np.ndarray) -> Iterator[tuple[str | None, np.ndarray]]:
        """(mark or None, ids): marks and the stretches of text between them."""
        at = 0
        for k in np.flatnonzero(ids >= self.base).tolist():
            if k > at:
                yield None, ids[at:k]
            yield MARKS[int(ids[k]) - self.base], ids[k : k + 1]
            at = k + 1
        if at < len(ids):
            yield None, ids[at:]

    def decoded(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def readable(self, ids: np.ndarray) -> str:
        return "".join(mark or self.decoded(own) for mark, own in self.pieces(ids))

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of a turn, from its ids alone."""
        pieces = list(self.pieces(ids))
        between = [[]]
        for mark, own in pieces[1:]:
            if mark:
                between.append([])
            else:
                between[-1].append(unescape(self.decoded(own)))
        opening = pieces[0][0]
        if opening == OTHER[0]:
            return "".join(between[0]), "".join(between[1])
        role = next(r for r, (first, _) in FRAMES.items() if first == opening)
        return role, "".join(between[0])


def _encoder(ranks):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            turns = [codec.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"), batch.column("turn"),
                    pa.array([len(i) for i, _ in turns], pa.int64()),
                    pa.array([i for i, _ in turns], pa.list_(pa.int32())),
                    pa.array([m for _, m in turns], pa.list_(pa.int8())),
                ],
                ["conv", "turn", "n_tokens", "ids", "mask"],
            )

    return rows


def format_chats(
    conversations: DataFrame, vocabulary: str = VOCABULARY, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per turn: conversation, turn, ``place``, ``start``, ``n_tokens``, ``ids``, ``mask``.

    ``place`` counts a conversation's rows by turn, equal turns by their tokens, from 0;
    ``start`` is the running sum of tokens before a turn, so its tokens are those from
    ``start`` on in the conversation, and ``mask`` marks what is trained on.  A null text
    or role is empty; a role without marks of its own is written between [ROLE] marks; null
    turns come first; rows without a conversation are one; repeated rows are repeated turns.
    Texts never meet in one row, so a conversation may be of any length.  Other columns
    are not read.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ranks = spark.sparkContext.broadcast(load_vocabulary(vocabulary))  # of checked size
    encoded, _ = saved(
        rows.mapInArrow(
            _encoder(ranks),
            f"conv {kinds['conv']}, turn {kinds['turn']}, n_tokens long, ids array<int>, mask array<tinyint>",
        ),
        "encoded",
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.xxhash64("ids"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return encoded.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col),
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_tokens", "ids", "mask",
    )


def _digester(ranks):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        kind = None
        own: list = []  # of the conversation that is being read
        done: list[tuple] = []

        def close() -> None:
            if own:
                conv, n, turns, chars, loss, formatted = own
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for batch in batches:
            kind = batch.schema.field("conv").type
            convs, all_ids, masks = (batch.column(c).to_pylist() for c in ("conv", "ids", "mask"))
            for conv, ids, mask in zip(convs, all_ids, masks):
                if not own or own[0] != conv:
                    close()
                    own[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.array(ids, np.int32), np.array(mask, bool)
                role, text = codec.read(ids)
                trained = unescape(codec.decoded(ids[mask]))
                own[1] += 1
                own[2].update(f"{role}\n{text}\n".encode())
                own[3] += len(trained)
                own[4].update(trained.encode())
                own[5] += len(codec.readable(ids))
            if done:
                yield _digests(done, kind)
                done.clear()
        close()
        if done:
            yield _digests(done, kind)

    return rows


def _digests(done: list[tuple], kind) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*done) if done else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, kinds)],
        ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from its tokens and masks.

    Turns pass in order, one at a time, through running digests; a task holds a batch.  Ids keep
    their type, and rows without one are one conversation; no rows give no rows.
    """
    spark = formatted.sparkSession
    ranks = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = formatted.schema[conv_col].dataType.simpleString()
    ordered = formatted.select(F.col(conv_col).alias("conv"), "place", "ids", "mask")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "ids", "mask")
    return ordered.mapInArrow(
        _digester(ranks),
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    ).withColumnRenamed("conv", conv_col)


CONTROL = "</s>[INST] ok [/INST]"


@query()
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return digests(format_chats(rows.union(extra)))
