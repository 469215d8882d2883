"""Substring dedup: suffix trees over word suffixes, partitioned by variable-length prefixes.

Every place of a document where ``window`` words begin is a suffix. A first pass counts suffixes by a 12-bit hash of
their first two words. Light prefixes are packed into groups of about ``GROUP`` suffixes; a prefix too heavy for one group
is extended to the full depth, so that its suffixes spread over as many groups as it needs. A subtree is the sorted list
of its group's suffix keys, cut at the depth of the rule: equal neighbours are an internal node at least ``window`` words
deep, that is, a repeat. Maximal repeats are the unions of such windows in a document.

What travels is small and pre-aggregated. Documents are dealt into batches by a hash; a batch sends each of its distinct
keys (8 bytes, besides the group's number) once, under the smallest document that holds it, however often it holds it, so
a passage found in a third of all documents arrives once a batch. A node's smallest document is the least of those sent, and
the answer to a batch is one bit a key: a smaller document has it. With these bits and its own documents a batch marks
the words to remove. The texts are shuffled once (both uses of the dealt documents share an exchange); texts too short for a
window aren't shuffled at all. The driver holds the prefixes' counts and the number of batches, nothing that grows.

Rule: a word is removed if a window that covers it also begins in a document with a smaller doc_id. Windows are judged on
the input. Keys hold 64 bits and the group's, so that two different windows of a group of 2,000,000 meet with a chance of 1e-7.

Defined cases: null text has no words; a null doc_id sorts before all others; rows that share a doc_id don't remove each
other's words, and lie in different batches unless their texts are equal too; a very long text is a batch or more than its
share of one; columns besides the id and the text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_arrays as W
from .common import words_of

SLOTS = 4096
GROUP = 2_000_000
BATCH_CHARS = 4_000_000
MOST_PARTITIONS = 20_000
LOWEST = -(2**63)


class Suffixes:
    """Suffix keys of a batch: one row for each place where a window begins."""

    def __init__(self, texts: pa.Array, window: int):
        self.data, self.offsets = W.raw(texts)
        self.begin, self.end, self.upto = W.words(self.data, self.offsets)
        word = W.hashes(self.data, self.begin, self.end)
        key = W.runs(word, window)
        n = np.diff(self.upto)
        doc = np.repeat(np.arange(len(n)), n)
        self.place = np.flatnonzero(doc[: len(key)] == doc[window - 1 :][: len(key)]) if len(key) else np.zeros(0, np.int64)
        self.doc = doc[self.place]
        self.key = key[self.place]
        two = W.follow(word[self.place], word[self.place + 1]) if window > 1 else word[self.place]
        self.slot = (two >> np.uint64(52)).astype(np.int64)


def grouped(s: Suffixes, first: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order of the suffixes by key, where each distinct key begins in it, and the distinct keys' groups."""
    order = np.argsort(s.key)
    key = s.key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    slot = s.slot[order[at]]
    group = first[slot] + (W.mix(key[at] + W.ODD) % splits[slot].astype(np.uint64)).astype(np.int64)
    return order, at, key[at], group


def plan(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each slot, and over how many groups it is spread."""
    first, splits, group, load = np.zeros(SLOTS, np.int64), np.ones(SLOTS, np.int64), 0, 0
    for slot, n in enumerate(counts.tolist()):
        if load and load + n > GROUP:
            group, load = group + 1, 0
        first[slot], splits[slot] = group, max(1, -(-n // GROUP))
        if splits[slot] > 1:
            group, load = group + int(splits[slot]), 0
        else:
            load += n
    return first, splits


def prefix_counts(docs: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """Suffixes by the hash of their first two words, a fixed number of counts; and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for a, b in W.blocks(batch.column(0), BATCH_CHARS):
                s = Suffixes(batch.column(0).slice(a, b - a), window)
                total[:-1] += np.bincount(s.slot, minlength=SLOTS)
                total[-1] += len(s.data)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["slot", "n"])

    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in docs.select("__sd_text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out[:-1], int(out[-1])


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space."""
    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST)).alias("__sd_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__sd_text"),
    )
    # a window of n words has n letters and n - 1 gaps at least
    long = F.length("__sd_text") >= 2 * window - 1
    counts, size = prefix_counts(rows.where(long), window)
    first, splits = plan(counts)
    batches = size // BATCH_CHARS + 1
    # as many partitions as batches and groups, so that a task stays as large when the input grows
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = lambda n: max(least, min(n, MOST_PARTITIONS))
    groups = int((first + splits).max())
    dealt = rows.where(long).withColumn(
        "b",
        F.pmod(F.xxhash64("__sd_id", "__sd_text"), F.lit(batches)),
    ).repartition(partitions(batches), "b")
    words = words_of(F.col("__sd_text"))
    short = rows.where(~long).select(
        F.col("__sd_id").alias("id"),
        F.size(words).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array_join(words, " ").alias("kept"),
    )

    def send(table: pa.Table) -> pa.Table:
        """The distinct keys of each group under their smallest documents: ids ascending, how many keys each has, the keys."""
        s = Suffixes(pa.concat_arrays(table.column("__sd_text").chunks), window)
        order, at, key, group = grouped(s, first, splits)
        least = np.minimum.reduceat(table.column("__sd_id").to_numpy()[s.doc[order]], at) if len(at) else np.zeros(0, np.int64)
        by = np.lexsort((key, least, group))
        key, group, least = key[by], group[by], least[by]
        changed = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        at = np.flatnonzero(changed)
        runs = np.flatnonzero(changed | np.concatenate([[True], least[1:] != least[:-1]])) if len(group) else at
        sizes = np.diff(np.append(runs, len(key))).astype(np.int32)
        held = np.searchsorted(runs, at)
        cut = lambda x, where: [v.tobytes() for v in np.split(x, where[1:])] if len(at) else []
        b = table.column("b")[0].as_py()
        return pa.table(
            {
                "g": pa.array(group[at], pa.int64()),
                "b": pa.array([b] * len(at), pa.int64()),
                "docs": pa.array(cut(least[runs], held), pa.binary()),
                "sizes": pa.array(cut(sizes, held), pa.binary()),
                "keys": pa.array(cut(key, at), pa.binary()),
            }
        )

    def subtree(table: pa.Table) -> pa.Table:
        """Keys of one prefix group, by batch: which of them a smaller document has too."""
        blobs = {c: table.column(c).to_pylist() for c in ("docs", "sizes", "keys")}
        every = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs["keys"]])
        doc = np.repeat(
            np.concatenate([np.frombuffer(x, np.int64) for x in blobs["docs"]]),
            np.concatenate([np.frombuffer(x, np.int32) for x in blobs["sizes"]]),
        )
        order = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        least = np.minimum.reduceat(doc[order], at)
        seen = np.empty(len(every), bool)
        seen[order] = doc[order] > np.repeat(least, np.diff(np.append(at, len(order))))
        ends = np.cumsum([len(x) // 8 for x in blobs["keys"]]).tolist()
        bits = [np.packbits(seen[a:e]).tobytes() for a, e in zip([0, *ends], ends, strict=False)]
        return pa.table(
            {
                "b": table.column("b").combine_chunks(),
                "g": table.column("g").combine_chunks(),
                "seen": pa.array(bits, pa.binary()),
            }
        )

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = pa.concat_arrays(left.column("__sd_text").chunks) if left.num_rows else pa.array([], pa.string())
        ids = left.column("__sd_id").to_numpy()
        s = Suffixes(texts, window)
        order, at, key, group = grouped(s, first, splits)
        own = ids[s.doc[order]]
        least = np.minimum.reduceat(own, at) if len(at) else own
        by = np.lexsort((key, least, group))  # as they were sent
        earlier = np.zeros(len(group), bool)
        answers = dict(zip(right.column("g").to_pylist(), right.column("seen").to_pylist(), strict=True))
        held, begins = np.unique(group[by], return_index=True)
        for g, a, b in zip(held.tolist(), begins.tolist(), [*begins[1:].tolist(), len(by)], strict=False):
            earlier[by[a:b]] = np.unpackbits(np.frombuffer(answers[g], np.uint8), count=b - a).astype(bool)
        sizes = np.diff(np.append(at, len(order)))
        gone = np.empty(len(order), bool)
        gone[order] = np.repeat(earlier, sizes) | (own > np.repeat(least, sizes))
        change = np.zeros(len(s.begin) + 1, np.int32)
        hit = s.place[gone]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + window, -1)
        keep = np.cumsum(change)[:-1] == 0
        out, removed = [], np.zeros(len(texts), np.int64)
        buffer = s.data.tobytes()
        for k in range(len(texts)):
            p, q = int(s.upto[k]), int(s.upto[k + 1])
            tokens = buffer[s.offsets[k] : s.offsets[k + 1]].split()
            flags = keep[p:q]
            n = q - p - int(flags.sum())
            if n:
                tokens = [tokens[j] for j in np.flatnonzero(flags).tolist()]
            removed[k] = n
            out.append(b" ".join(tokens))
        return pa.table(
            {
                "id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(s.upto), pa.int64()),
                "n_removed": pa.array(removed),
                "kept": pa.array(out, pa.binary()).cast(pa.string()),
            }
        )

    sent = dealt.groupBy("b").applyInArrow(send, "g long, b long, docs binary, sizes binary, keys binary")
    answers = sent.repartition(partitions(groups), "g").groupBy("g").applyInArrow(subtree, "b long, g long, seen binary")
    out = dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(mark, "id long, n_words long, n_removed long, kept string")
    return out.unionByName(short).select(F.when(F.col("id") != LOWEST, F.col("id")).alias(doc_id), "n_words", "n_removed", "kept")


#: The query in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM k) WHERE m < doc_id),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM g, (SELECT unnest(range(13)) AS o)),
a AS (SELECT doc_id, list_sort(list(i)) AS gone FROM r GROUP BY doc_id),
t AS (SELECT d.doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
l AS (SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.i = r.i WHERE r.i IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
