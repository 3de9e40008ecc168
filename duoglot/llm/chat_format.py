"""Chat formatting by assembly of tokens.

Every turn is encoded by itself and set between reserved ids, which no text can produce. Where
a turn starts in its conversation is a prefix sum over the lengths of the turns
before it, and so are the spans of the loss mask. For the text form, control strings in contents are
escaped, so that the form can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from duoglot.llm.byte_bpe import read_ranks
from duoglot.llm.common import chunks, stored

# The marks of the text form and other strings that chat models take as control.
TURN, ROLE_END, TURN_END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, ROLE_END, TURN_END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>",
           "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# A control string, possibly with backslashes after its first character: escaping adds one,
# unescaping takes one away, so any text comes back as it was.
PLAIN = re.compile("(" + "|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")"
                                  for c in CONTROL) + r")(\\*)")
ESCAPED = re.compile("(" + "|".join(re.escape(c[0]) + r"(?=\\+" + re.escape(c[1:]) + ")"
                                    for c in CONTROL) + r")\\")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Template:
    """Ids of the marks: the first ones that the vocabulary leaves free."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.turn, self.role_end, self.turn_end = range(max(ranks.values()) + 1,
                                                        max(ranks.values()) + 4)
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})

    def turn_ids(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, and the span of its text with the end mark."""
        role_ids = self.encoding.encode_ordinary(role)
        text_ids = self.encoding.encode_ordinary(text)
        start = len(role_ids) + 2
        ids = [self.turn, *role_ids, self.role_end, *text_ids, self.turn_end]
        return ids, start, start + len(text_ids)


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(conv_id, turn, token_ids, n_ids, first_id, loss_from, loss_to, formatted)``: one row
    per turn, in the order that ``turn`` gives (ties by role, then text; null turns first).

    ``token_ids`` are little-endian 32-bit ids; ``first_id`` is the place of the turn's first id in
    its conversation; ``loss_from`` to ``loss_to`` are the places under the loss mask (text of the
    learned role, without marks), equal where nothing is learned. Null roles and texts count as
    empty. Rows without a conversation id form one conversation with a null id. Repeated rows
    are turns of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path, pattern)
        for part in chunks(batches, "text"):
            rows = []
            for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist()):
                ids, start, stop = template.turn_ids(role, text)
                learned = role == LEARNED_ROLE
                rows.append((np.array(ids, "<u4").tobytes(), len(ids), start if learned else 0,
                             stop if learned else 0,
                             f"{TURN}{escape(role)}{ROLE_END}{escape(text)}{TURN_END}"))
            columns = list(zip(*rows))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            keys = [part.column(k) for k in ("conv_id", "turn", "role", "text_key")]
            yield pa.RecordBatch.from_arrays(
                keys + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "turn", "role", "text_key", "token_ids", "n_ids", "from_",
                       "to_", "formatted"])

    turns = conversations.selectExpr(
        "CAST(conv_id AS bigint) AS conv_id", "CAST(turn AS bigint) AS turn",
        "coalesce(role, '') AS role", "coalesce(text, '') AS text", "xxhash64(text) AS text_key")
    encoded = turns.mapInArrow(run, "conv_id long, turn long, role string, text_key long, "
                               "token_ids binary, n_ids long, from_ long, to_ long, formatted string")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text_key")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (encoded.withColumn("first_id", before)
            .select("conv_id", "turn", "token_ids", "n_ids", "first_id",
                    (F.col("first_id") + F.col("from_")).alias("loss_from"),
                    (F.col("first_id") + F.col("to_")).alias("loss_to"), "formatted"))


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read
    from the ids, masks and text forms of ``format_turns``.

    Conversations are read in order as a stream of turns, so that a long one needs no more
    memory than a short one. The text form and the ids must say the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path, pattern)
        decode, out, now = template.encoding.decode, [], None

        def close() -> None:
            if now:
                out.append((now["id"], now["turns"], now["all"].hexdigest(), now["chars"],
                            now["loss"].hexdigest(), now["formatted"]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                       "formatted_chars"])

        for part in chunks(batches, "formatted"):
            for row in part.to_pylist():
                if now is None or row["conv_id"] != now["id"]:
                    close()
                    now = {"id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "chars": 0,
                           "loss": hashlib.sha256(), "formatted": 0, "next": 0}
                if row["first_id"] != now["next"]:
                    raise ValueError("turns leave a gap or overlap")
                now["next"] += row["n_ids"]
                ids = np.frombuffer(row["token_ids"], "<u4").tolist()
                middle = ids.index(template.role_end)
                role, text = decode(ids[1:middle]), decode(ids[middle + 1:-1])
                head, _, tail = row["formatted"].removeprefix(TURN).removesuffix(TURN_END).partition(ROLE_END)
                if (unescape(head), unescape(tail)) != (role, text):
                    raise ValueError("text form and ids differ")
                now["turns"] += 1
                now["all"].update(f"{role}\n{text}\n".encode())
                start, stop = row["loss_from"] - row["first_id"], row["loss_to"] - row["first_id"]
                learned = decode(ids[start:stop])
                now["chars"] += len(learned)
                now["loss"].update(learned.encode())
                now["formatted"] += len(row["formatted"])
            yield batch_of(out)
            out = []
        close()
        yield batch_of(out)

    kept = stored(formatted, "chat-turns")
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # first_id orders the turns: prefix sums rise from turn to turn.
    return (kept.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "first_id")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                        "loss_sha256 string, formatted_chars long"))
