"""SimHash near-dedup: exact fingerprint links by tiled comparison.

Fingerprints are made in numpy from XXH64 hashes of word shingles. Distinct fingerprints (with their smallest doc_id)
are compared in tiles: a tile pair is one exclusive-or of two numpy vectors and a bit count, and is skipped if the
population counts of its rows differ by more than the radius. Which rows meet at all follows from the pigeonhole: cut into
``blocks`` blocks, two fingerprints within the radius agree in all but ``radius`` of them, so each choice of the other
blocks is a key and rows meet under equal keys only. Nothing is lost by that. ``blocks`` grows with the number of
fingerprints so that a key holds few. A key with more than ``TILE`` rows is not one task: its rows are cut into tiles
by population count (and hash), and every tile pair within the radius is a task of its own.

Each task reduces its links to a spanning forest, so a large group of near copies yields as many links as it has
members. Connected components of these come from alternating large-star and small-star rounds of joins and minima, each
checkpointed; links and components stay distributed.

Defined cases: a text without words, null or empty, has fingerprint zero and is linked like any other; equal rows and equal
texts share a fingerprint; a very long text is handled alone, in eight bytes a shingle; a null doc_id never names a component
unless all ids of it are null; columns of any name pass through ``one_of_each``, and only the id through ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import word_arrays as W
from .common import cut

SEED = 42
#: Bytes of text handled at once.
BLOCK_BYTES = 2_000_000
TILE = 4096


def fingerprints_of(texts: list[str], width: int = 4) -> np.ndarray:
    """A 64-bit fingerprint for each text."""
    import xxhash

    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII separators
        if not words:
            continue
        if len(words) <= width:
            hashes.append(digest(b" ".join(words), SEED))
            counts[k] = 1
            continue
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begin = (np.concatenate([[0], ends[: len(words) - width]])).tolist()
        hashes += [digest(whole[a:b], SEED) for a, b in zip(begin, (ends[width - 1 :] - 1).tolist(), strict=True)]
        counts[k] = len(begin)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        every, first = np.array(hashes, np.uint64), np.cumsum(counts[some]) - counts[some]
        del hashes
        for b in range(64):  # a bit at a time: 64 bytes a shingle would be too much of a very long text
            over = 2 * np.add.reduceat(every >> np.uint64(b) & np.uint64(1), first, dtype=np.int64) > counts[some]
            out[some[over]] |= np.uint64(1 << b)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """The kept columns and ``fingerprint`` (long)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    df = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("__sh_text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            prints = [fingerprints_of([t or "" for t in texts[a:b].to_pylist()], width) for a, b in W.blocks(texts, BLOCK_BYTES)]
            column = np.concatenate([np.zeros(0, np.uint64), *prints]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(column)], schema.names)

    return df.mapInArrow(run, schema)


def forest(prints: np.ndarray, radius: int, tile: int = 1024) -> np.ndarray:
    """For each fingerprint the smallest index of its component among the links within the radius."""
    n = len(prints)
    ones = np.bitwise_count(prints)
    order = np.argsort(ones, kind="stable")
    rows, ones = prints[order], ones[order].astype(np.int16)
    label = np.arange(n)
    spans = [(a, min(a + tile, n)) for a in range(0, n, tile)]
    pairs = [(x, y) for i, x in enumerate(spans) for y in spans[i:] if ones[y[0]] - ones[x[1] - 1] <= radius]
    kept: dict = {}
    while True:
        before = label.copy()
        for x, y in pairs:
            if (x, y) not in kept:
                near = np.bitwise_count(rows[x[0] : x[1], None] ^ rows[None, y[0] : y[1]]) <= radius
                if x == y:
                    np.fill_diagonal(near, False)
                kept[x, y] = near if near.any() else None
            if (near := kept[x, y]) is None:
                continue
            left, right = label[x[0] : x[1]], label[y[0] : y[1]]
            np.minimum(left, np.where(near, right[None, :], n).min(1), out=left)
            np.minimum(right, np.where(near, left[:, None], n).min(0), out=right)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def key_columns(blocks: int, radius: int) -> Column:
    """An array of keys: the choice of equal blocks and their bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - radius)):
        m = sum(chosen)
        keys.append(
            F.struct(
                F.lit(k).alias("choice"),
                F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits"),
            )
        )
    return F.array(*keys)


def links(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(u, v): a spanning forest of the links of each key. prints: distinct ``fingerprint``."""
    rows = prints.select(
        "fingerprint",
        F.explode(key_columns(blocks, radius)).alias("key"),
    ).select("fingerprint", "key.*", F.bit_count("fingerprint").alias("ones"))
    large = rows.groupBy("choice", "bits", "ones").agg(F.count("*").alias("n"))
    large = large.join(large.groupBy("choice", "bits").agg(F.sum("n").alias("all")).where(f"all > {TILE}").drop("all"), ["choice", "bits"])
    tiles = large.withColumn("salts", F.ceil(F.col("n") * 2 / TILE).cast("int")).withColumn(
        "salt",
        F.explode(F.expr("sequence(0, salts - 1)")),
    )
    a, b = tiles.alias("a"), tiles.alias("b")
    order = "(a.ones < b.ones OR (a.ones = b.ones AND a.salt <= b.salt))"
    pairs = a.join(b, F.expr(f"a.choice = b.choice AND a.bits = b.bits AND abs(a.ones - b.ones) <= {radius} AND {order}"))
    pairs = pairs.selectExpr(
        "a.choice",
        "a.bits",
        "a.salts AS sa",
        "b.salts AS sb",
        "a.ones AS oa",
        "a.salt AS ta",
        "b.ones AS ob",
        "b.salt AS tb",
    )
    pair = F.expr("struct(oa, ta, ob, tb)")
    member = pairs.select(
        "choice",
        "bits",
        F.explode(
            F.expr(
                "array_distinct(array(struct(oa AS ones, sa AS salts, ta AS salt), struct(ob AS ones, sb AS salts, tb AS "
                "salt)))"
            )
        ).alias("m"),
        pair.alias("pair"),
    ).select("choice", "bits", "m.*", "pair")
    salted = rows.join(
        tiles.select("choice", "bits", "ones", "salts").distinct(),
        ["choice", "bits", "ones"],
    ).withColumn("salt", F.expr("CAST(pmod(xxhash64(fingerprint), salts) AS INT)"))
    hot = salted.join(member, ["choice", "bits", "ones", "salts", "salt"]).select("choice", "bits", "pair", "fingerprint")
    none = F.expr("CAST(NULL AS STRUCT<oa: INT, ta: INT, ob: INT, tb: INT>)")
    cool = rows.join(
        large.select("choice", "bits").distinct(),
        ["choice", "bits"],
        "left_anti",
    ).select("choice", "bits", none.alias("pair"), "fingerprint")
    met = cool.unionByName(hot).select(
        F.xxhash64("choice", "bits", "pair").alias("task"),
        "choice",
        "bits",
        F.xxhash64("pair").alias("pair"),
        "fingerprint",
    )
    met = met.repartition("task").sortWithinPartitions("task", "choice", "bits", "pair").drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)

        def edges(block: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            u, v = [], []
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if q - p > 1:
                    own = block[p:q, 3]
                    root = forest(own.view(np.uint64), radius)
                    some = np.flatnonzero(root != np.arange(q - p))
                    u.append(own[some])
                    v.append(own[root[some]])
            both = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["u", "v"])

        for batch in batches:
            block = np.concatenate(
                [
                    rest,
                    np.stack(
                        [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).astype(np.int64) for c in batch.columns],
                        axis=1,
                    ),
                ]
            )
            changed = np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(1)) + 1
            if len(changed):
                cuts = np.concatenate([[0], changed])
                yield edges(np.ascontiguousarray(block[: changed[-1]]), cuts)
                rest = block[changed[-1] :]
            else:
                rest = block
        if len(rest):
            yield edges(np.ascontiguousarray(rest), np.array([0, len(rest)]))

    return met.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component, itself apart."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u != v").distinct())
    last = None
    while (now := state(edges)) != last and now[0]:
        last = now
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        # checkpointed minima: a join with them can split the many edges of one node
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").distinct()
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").selectExpr("v AS u", "m AS v").where("u != v").unionByName(down.selectExpr("u", "m AS v")).distinct()
        edges = cut(small)
    return edges.selectExpr("u AS node", "v AS root")


def blocks_for(n: int, radius: int) -> int:
    """As few blocks as leave about 64 of n evenly spread fingerprints to a key."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > 64:
        blocks += 1
    return blocks


def classes(prints: DataFrame, radius: int = 4, blocks: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(fingerprint, root, component_id) from rows (doc_id, fingerprint)."""
    nodes = cut(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first")))
    found = components(links(nodes.select("fingerprint"), radius, blocks or blocks_for(nodes.count(), radius)))
    nodes = nodes.join(
        found.withColumnRenamed("node", "fingerprint"),
        "fingerprint",
        "left",
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    # checkpointed: the join with it can split the many fingerprints of one component
    least = cut(nodes.groupBy("root").agg(F.min("first").alias("component_id")))
    return nodes.join(least, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    prints = cut(with_fingerprint(docs, text, [doc_id]))
    return prints.join(classes(prints, radius, doc_id=doc_id), "fingerprint").select(doc_id, "fingerprint", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the first (doc_id, then hash of the text) of each component."""
    t = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    keyed = docs.withColumn("__sh_t", t).withColumn("__sh_d", F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(2**63))))
    prints = cut(with_fingerprint(keyed, text, ["__sh_d", "__sh_t"]))
    of = prints.join(classes(prints, radius, doc_id="__sh_d").select("fingerprint", "root"), "fingerprint")
    first = of.groupBy("root").agg(F.min(F.struct("__sh_d", "__sh_t")).alias("first")).select("first.*")
    return keyed.join(
        first,
        ["__sh_d", "__sh_t"],
        "left_semi",
    ).dropDuplicates(["__sh_d", "__sh_t"]).select(*[f"`{c}`" for c in docs.columns])
