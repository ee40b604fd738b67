"""Chat formatting at token level, with loss masks and reversible escapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.packing import VOCABULARY, encoder

#: Control strings of the template; the id of the i-th is RESERVED + i, beyond the vocabulary's 50,257 ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
RESERVED = 50_300
BEGIN, END, OPEN, CLOSE = (CONTROLS.index(x) for x in ("<s>", "</s>", "[INST]", "[/INST]"))
LOSS_ROLES = ("assistant",)
_ESCAPE = "\\"
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in sorted((*CONTROLS, _ESCAPE), key=lambda c: -len(c))))


def escape(text: str) -> str:
    """A backslash is doubled, and one is put after the first character of every control string in the text."""
    return _TO_ESCAPE.sub(lambda m: _ESCAPE * 2 if m[0] == _ESCAPE else m[0][0] + _ESCAPE + m[0][1:], text)


_ESCAPED = re.compile(r"\\\\|\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _ESCAPE if len(m[0]) == 2 else "", text)


def encode_turn(role: str, text: str, coder, loss_roles: tuple = LOSS_ROLES) -> tuple[np.ndarray, int, int, int]:
    """Ids of `<s>role[INST]text[/INST]</s>`, where its text's ids begin and end if they carry loss, and its characters.

    Role and text are escaped and encoded apart from each other and from the control strings, whose reserved ids are
    spliced between them. So no merge crosses a border and no content gives a reserved id.
    """
    name, body = escape(role), escape(text)
    segments = [[RESERVED + BEGIN], coder.encode(name), [RESERVED + OPEN], coder.encode(body), [RESERVED + CLOSE, RESERVED + END]]
    ends = np.cumsum([len(s) for s in segments])
    loss = (int(ends[2]), int(ends[3])) if role in loss_roles else (0, 0)
    chars = len(name) + len(body) + sum(len(CONTROLS[i]) for i in (BEGIN, OPEN, CLOSE, END))
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), *loss, chars


def format_turns(conversations: DataFrame, vocabulary: str = VOCABULARY, loss_roles: tuple = LOSS_ROLES) -> DataFrame:
    """One row per turn: conv_id, turn, seq, ids, n_tokens, token_start, loss_start, loss_end, char_start, n_chars.

    The conversation's ids are its rows' ids in order of seq (turn, nulls first, then role and text); token_start and
    the loss span (token positions in the conversation, end exclusive, empty without loss) are prefix sums over the
    lengths, so a conversation of any length is never held whole. Null roles and texts count as empty; repeated rows
    are turns of their own; a null conv_id is one conversation. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary)
        for batch in batches:
            rows = [encode_turn(r, t, coder, loss_roles) for r, t in zip(batch["role"], batch["text"], strict=True)]
            yield pd.DataFrame({
                "conv_id": batch["conv_id"].astype("Int64"), "turn": batch["turn"].astype("Int64"), "role": batch["role"],
                "tie": [hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in batch["text"]],
                "ids": [r[0] for r in rows], "n_tokens": [len(r[0]) for r in rows], "own_start": [r[1] for r in rows], "own_end": [r[2] for r in rows], "n_chars": [r[3] for r in rows],
            })

    clean = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    turns = clean.mapInPandas(run, "conv_id long, turn long, role string, tie string, ids array<int>, n_tokens long, own_start long, own_end long, n_chars long")
    order = [F.asc_nulls_first("turn"), "role", "tie"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)
    for name, of in (("token_start", "n_tokens"), ("char_start", "n_chars")):
        sums = sums.withColumn(name, F.coalesce(F.sum(of).over(before), F.lit(0)))
    return sums.select("conv_id", "turn", "seq", "ids", "n_tokens", "token_start", (F.col("token_start") + F.col("own_start")).alias("loss_start"), (F.col("token_start") + F.col("own_end")).alias("loss_end"), "char_start", "n_chars")


def decode(ids: np.ndarray, coder) -> tuple[str, str, str]:
    """Formatted text, role and text of one turn, read back from its ids alone."""
    marks = np.flatnonzero(ids >= RESERVED)
    if [int(ids[i]) - RESERVED for i in marks] != [BEGIN, OPEN, CLOSE, END]:
        raise ValueError("a turn's reserved ids are out of order")
    name, body = (coder.decode(ids[a + 1 : b]) for a, b in ((marks[0], marks[1]), (marks[1], marks[2])))
    written = f"{CONTROLS[BEGIN]}{name}{CONTROLS[OPEN]}{body}{CONTROLS[CLOSE]}{CONTROLS[END]}"
    return written, unescape(name), unescape(body)


def digest(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read back from format_turns's ids and masks: counts and SHA-256 digests.

    A digest runs over a conversation in order, so its rows meet in one sorted stream; a task keeps one turn and two
    hash states, however long the conversation is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary)
        state: list | None = None

        def row(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for batch in batches:
            out = []
            for conv, ids, start, lo, hi in zip(batch["conv_id"], batch["ids"], batch["token_start"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.asarray(ids)
                written, role, text = decode(ids, coder)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if hi > lo:
                    learnt = unescape(coder.decode(ids[lo - start : hi - start]))
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "replace"))
                state[5] += len(written)
            yield frame(out)
        if state is not None:
            yield frame([row(state)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return out.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    dealt = turns.select("conv_id", "seq", "ids", "token_start", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
