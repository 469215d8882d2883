"""Chat formatting by columnar byte assembly.

A conversation is ``<s>``, then for each turn ``<|turn|>``, the role, a line feed, the text and ``</s>``. Control strings
inside roles and texts are broken by a backslash after their first character, and backslashes are doubled, so that no
control string remains and reading back restores every character. The loss mask covers the texts of assistant turns.

For a block of turns, headers and contents lie end to end in one source buffer; segment lengths give cumulative offsets,
these give the scatter indices, and one numpy assignment copies all short segments into the preallocated buffer of the Arrow
column. Segments over ``LONG`` bytes are copied as slices: an index for each of their bytes would take eight times the room.

Rows are ordered by turn (then role and text where turns tie) and a conversation's rows come to one task, in order, as it
becomes one value; tasks hold a block of at most ``block_turns`` turns and about ``block_bytes`` of text, and the conversation
that runs over its end.

Defined cases: null text and null role are empty; rows without an id are one conversation; repeated rows are turns of their
own; a very long text is one segment of its block, and a conversation may hold what a string column's value may (2 GB);
other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_arrays as W

BEGIN, TURN, END = "<s>", "<|turn|>", "</s>"
#: Control strings that may not occur in contents.
CONTROL = (BEGIN, END, TURN, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL_AT = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
#: Bytes of the longest segment that is copied by indices.
LONG = 512
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(s: str) -> str:
    s = s.replace("\\", "\\\\")
    return CONTROL_AT.sub(lambda m: m[0] + "\\", s) if "<" in s or "[" in s else s


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1", s) if "\\" in s else s


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        body = part[: -len(END)]
        cut = re.match(r"(?:[^\\\n]|\\.)*", body, re.DOTALL).end()  # the role's end: a line feed that isn't escaped
        turns.append((unescape(body[:cut]), unescape(body[cut + 1 :])))
    return turns


def gathered(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The source's segments end to end, and where each ends."""
    ends = np.cumsum(size)
    to = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    short = np.flatnonzero(size <= LONG)
    n = size[short]
    step = np.arange(n.sum(), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to[short], n) + step] = source[np.repeat(begin[short], n) + step]
    for k in np.flatnonzero(size > LONG).tolist():
        out[to[k] : ends[k]] = source[begin[k] : begin[k] + size[k]]
    return out, ends


def assemble(pieces: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of six segments a turn (beginning, opening, role, line feed, text, end), and each segment's end.

    pieces: role and text of each turn, by turn; first: each conversation's first turn, which alone has a beginning. The
    marks are taken from one shared place in the source.
    """
    marks = [BEGIN.encode(), TURN.encode(), b"\n", END.encode()]
    source = np.frombuffer(b"".join([*marks, *pieces]), np.uint8)
    m = np.array([len(x) for x in marks], np.int64)
    at = np.cumsum(m) - m
    lengths = np.array([len(p) for p in pieces], np.int64)
    begins = m.sum() + np.cumsum(lengths) - lengths
    n = len(pieces) // 2
    size, begin = np.zeros((n, 6), np.int64), np.zeros((n, 6), np.int64)
    size[first, 0] = m[0]
    for k, column in ((1, 1), (2, 3), (3, 5)):
        size[:, column], begin[:, column] = m[k], at[k]
    size[:, 2], size[:, 4] = lengths[0::2], lengths[1::2]
    begin[:, 2], begin[:, 4] = begins[0::2], begins[1::2]
    out, ends = gathered(source, begin.ravel(), size.ravel())
    return out, ends.reshape(n, 6)


def formatted_block(ids: list, first: np.ndarray, roles: list[str], texts: list[str]) -> pa.RecordBatch:
    """first: the first turn of each conversation."""
    pieces = [b""] * (2 * len(roles))
    pieces[0::2] = [escape(r).replace("\n", "\\\n").encode() for r in roles]
    escaped = [escape(t) for t in texts]
    pieces[1::2] = [t.encode() for t in escaped]
    out, ends = assemble(pieces, first)
    last = np.append(first[1:], len(roles)) - 1
    offsets = np.concatenate([[0], ends[last, 5]])
    column = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out)])
    # code points of the assistant texts
    size = np.array([len(TURN) + len(p) + 1 for p in map(str, (x.decode() for x in pieces[0::2]))], np.int64)
    chars = np.array([len(t) for t in escaped], np.int64)
    after = np.cumsum(size + chars + len(END))
    begin = after - len(END) - chars
    base = np.repeat(np.concatenate([[0], after[last[:-1]]]), np.diff(np.append(first, len(roles)))) - len(BEGIN)
    masked = np.array([r == "assistant" for r in roles], bool)
    where = np.searchsorted(np.flatnonzero(masked), np.append(first, len(roles)))
    spans = [
        pa.ListArray.from_arrays(
            pa.array(where, pa.int32()),
            pa.array(v[masked], pa.int32()),
        ) for v in (begin - base, begin - base + chars)
    ]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column, *spans], ["conv_id", "formatted", "loss_start", "loss_end"])


def format_chats(turns: DataFrame, block_turns: int = 4096, block_bytes: int = 4_000_000) -> DataFrame:
    """(conv_id, formatted, loss_start, loss_end) from rows (conv_id, turn, role, text); loss spans in code points."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roles, texts = [], [], []

        def flush(n: int) -> pa.RecordBatch:
            first = [k for k in range(n) if k == 0 or ids[k] != ids[k - 1]]
            out = formatted_block([ids[k] for k in first], np.array(first, np.int64), roles[:n], texts[:n])
            del ids[:n], roles[:n], texts[:n]
            return out

        for batch in batches:
            for part in (batch.slice(k, min(block_turns, b - k)) for a, b in W.blocks(batch.column(2), block_bytes) for k in range(a, b, block_turns)):
                for to, column in zip((ids, roles, texts), part.columns, strict=True):
                    to += column.to_pylist()
                n = len(ids) - 1
                while n > 0 and ids[n] == ids[n - 1]:
                    n -= 1
                if n > 0:
                    yield flush(n)
        if ids:
            yield flush(len(ids))

    return rows.mapInArrow(run, "conv_id long, formatted string, loss_start array<int>, loss_end array<int>")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations read back as."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(s)
                learned = "".join(unescape(s[x:y]) for x, y in zip(a, b, strict=True))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append(
                    (
                        i,
                        len(turns),
                        hashlib.sha256(said.encode()).hexdigest(),
                        len(learned),
                        hashlib.sha256(learned.encode()).hexdigest(),
                        len(s),
                    )
                )
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, kind)


def oracle() -> str:
    """The query in DuckDB's SQL: what reading back must give, and the formatted length from counts of control strings."""
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, chr(92), ''))" + "".join(
        f" + (length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}" for s in CONTROL
    )
    marks = len(TURN) + 1 + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST({len(BEGIN)} + sum({marks} + {escaped('role')} + length(role) - length(replace(role, chr(10), '')) + {escaped('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
