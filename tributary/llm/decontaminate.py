"""Benchmark decontamination [native]: spaced seeds propose aligned places, an aligned comparison confirms them.

Tokens are maximal runs of letters and digits of the lower-cased text. A seed is a mask: the offsets whose tokens are
hashed, the others being ignored. Seeds of all places of the documents meet those of the benchmark in a hash join; each
meeting fixes an alignment, and the tokens around it are compared place by place. An item is found if ``WINDOW``
consecutive aligned tokens (or the whole of a shorter item) differ in at most ``allowed()`` places: at least 0.8 alike.
The three masks together hit every such window of 13, 12, 11, 9, 8 and 7 tokens; of ten tokens two substitutions are not
allowed, and items of five or six tokens must occur unchanged. Items under five tokens are not looked for. With
``short_items`` 0.8 holds for every length: items that three masks can't serve have lighter ones of their own (``LIGHT``),
made only if the benchmark holds such items.

The documents are read once for each set of masks, whatever the benchmark's size. One of at most ``block_tokens`` tokens is
broadcast with the tokens around each seed, and only verified meetings are shuffled. Of a larger one a bitmap of its seeds'
hashes is broadcast, 16 bits a seed and ``MOST_BITS`` at most; the few document seeds that the bitmap doesn't rule out are
shuffled with the tokens around them and joined with the benchmark's.

Defined cases: null text has no tokens; rows equal in doc_id and text are one document; null doc_id is an id of its own;
equal items are all reported; an empty benchmark finds nothing; a very long text is one row of tokens, of which only slices
travel; input columns named ``item_ids`` or ``contaminated`` are replaced, all others pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWEST

WINDOW = 13
#: Token offsets that each mask hashes.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 5, 6))
#: Item lengths that MASKS can't serve, and masks that can. Of ten tokens two substitutions leave three in a row, of six one
#: does; of five, one leaves the first or the second mask; shorter items must occur unchanged.
LIGHT = (((1,), ((0,),)), ((2,), ((0, 1),)), ((3, 4, 5, 6, 10), ((0, 1, 2), (0, 1, 3))))
KEY = ["__dc_d", "__dc_t"]
#: Bits of a bitmap of seeds at most: 128 MB. Bits of one of its rows.
MOST_BITS, ROW_BITS = 1 << 30, 1 << 15


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def allowed(length: str) -> str:
    """SQL for the differing places that a window of this many tokens may have."""
    return f"(CASE WHEN {length} >= 11 THEN 2 WHEN {length} >= 7 THEN 1 ELSE 0 END)"


def seeds(df: DataFrame, hashes: str, place: str, carried: list[str], offsets=MASKS) -> DataFrame:
    """A row for each place and mask: ``seed`` besides the carried columns; null where the mask runs over the end."""
    # The generators and projections here stay in one generated loop, in which the array is only pointed to. An outer one:
    # else the optimizer would test the array's size below it, which makes the array twice.
    df = df.select(*carried, F.posexplode_outer(hashes).alias(place, "__dc_x"))
    masks = [F.expr(f"CASE WHEN {place} + {m[-1]} < size({hashes}) THEN xxhash64({k}, {', '.join(f'get({hashes}, {place} + {o})' for o in m)}) END") for k, m in enumerate(offsets)]
    return df.select(*carried, place, F.explode(F.array(*masks)).alias("seed")).where("seed IS NOT NULL")


def bitmap(bench: DataFrame, bits: int) -> DataFrame:
    """(row, words): the seeds' hashes as bits, in rows of 64-bit words; rows without any are left out."""
    at = bench.select(F.expr(f"pmod(seed, {bits})").alias("x"))
    words = at.groupBy(
        F.expr(f"x DIV {ROW_BITS}").alias("row"),
        F.expr(f"CAST((x % {ROW_BITS}) DIV 64 AS INT)").alias("w"),
    ).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x % 64 AS INT))")).alias("m"))
    rows = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("of"))
    return rows.select("row", F.expr(f"transform(sequence(0, {ROW_BITS // 64 - 1}), i -> coalesce(of[i], 0L))").alias("words"))


def found_in(docs: DataFrame, items: DataFrame, offsets=MASKS, bad: str | None = None, bits: int | None = None) -> DataFrame:
    """Verified (document, item): docs with the key and ``dh``, token hashes; items with ``item_id`` and ``ih``."""
    # only the tokens near a seed travel, so that a long item's rows, or a long text's, stay small
    near = "slice({0}, greatest({1} - %d, 0) + 1, %d)" % (WINDOW - 1, 2 * WINDOW - 1)
    bench = seeds(items, "ih", "q", ["item_id", "ih"], offsets).selectExpr(
        "seed",
        "item_id",
        "q",
        "size(ih) AS m",
        f"{near.format('ih', 'q')} AS ctx",
    )
    hits = seeds(docs, "dh", "p", [*KEY, "dh"], offsets)
    if bits is None:
        hits = hits.join(F.broadcast(bench), "seed").withColumn("n", F.size("dh"))
        mine = "slice(dh, p - a + 1, a + b)"
    else:
        hits = hits.withColumns({"x": F.expr(f"pmod(seed, {bits})"), "row": F.expr(f"pmod(seed, {bits}) DIV {ROW_BITS}")})
        hits = hits.join(F.broadcast(bitmap(bench, bits)), "row").where(
            f"(shiftright(get(words, CAST((x % {ROW_BITS}) DIV 64 AS INT)), CAST(x % 64 AS INT)) & 1L) = 1"
        )
        hits = hits.select(
            *KEY,
            "seed",
            "p",
            F.size("dh").alias("n"),
            F.inline(F.array(F.struct(F.expr(near.format("dh", "p")).alias("dctx")))),
        ).join(bench, "seed")
        mine = f"slice(dctx, least(p, {WINDOW - 1}) - a + 1, a + b)"
    # the tokens from `a` before the meeting to `b` after it, in both
    hits = hits.withColumns(
        {
            "a": F.expr(f"least(p, q, {WINDOW - 1})"),
            "b": F.expr(f"least(n - p, m - q, {WINDOW})"),
            "w": F.expr(f"least({WINDOW}, m)"),
        }
    )
    # A generator hands on the slices alone: a projection would be merged with the comparison after it, which is not
    # compiled, so that every meeting of a long document would be copied with all its tokens.
    slices = F.struct(F.expr(mine).alias("x"), F.expr(f"slice(ctx, least(q, {WINDOW - 1}) - a + 1, a + b)").alias("y"))
    hits = hits.select(*KEY, "item_id", "w", F.inline(F.array(slices))).where("size(x) >= w")
    unlike = "zip_with(x, y, (s, t) -> CASE WHEN s = t THEN 0 ELSE 1 END)"
    best = (
        f"exists(array({unlike}), e -> exists(sequence(1, size(e) - w + 1), k -> aggregate(slice(e, k, w), 0, (s, t) -> s + "
        f"t) <= {bad or allowed('w')}))"
    )
    return hits.where(best).select(*KEY, "item_id").distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_tokens: int = 50_000,
    short_items: bool = False,
) -> DataFrame:
    """docs with ``item_ids``, the sorted ids of the items found in each, and ``contaminated``."""
    docs = docs.drop("item_ids", "contaminated")
    rows = docs.withColumns(
        {
            "__dc_d": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST)),
            "__dc_t": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        }
    )
    items = benchmark.select(
        F.col(f"`{item_id}`").cast("long").alias("item_id"),
        F.transform(tokens(F.col(f"`{item_text}`")), lambda x: F.xxhash64(x)).alias("ih"),
    ).where(F.size("ih") >= (1 if short_items else 5))
    kind = F.lit(-1)
    for k, (lengths, _) in enumerate(LIGHT if short_items else ()):
        kind = F.when(F.size("ih").isin(*lengths), k).otherwise(kind)
    total = dict(map(tuple, items.groupBy(kind.alias("k")).agg(F.sum(F.size("ih"))).collect()))
    hashed = rows.select(*KEY, F.transform(tokens(F.col(f"`{text}`")), lambda x: F.xxhash64(x)).alias("dh"))
    parts = []
    for k, n in sorted((total or {-1: 0}).items()):
        offsets, bad = (LIGHT[k][1], "(w DIV 5)") if k >= 0 else (MASKS, None)
        bits = None if n <= block_tokens else min(MOST_BITS, max(ROW_BITS, 1 << (16 * n * len(offsets)).bit_length()))
        parts.append(found_in(hashed, items.where(kind == k), offsets, bad, bits))
    found = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = rows.join(found, KEY, "left")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("item_ids", F.expr("CAST(array() AS ARRAY<LONG>)")).alias("item_ids"),
        F.col("item_ids").isNotNull().alias("contaminated"),
    )


#: Brute force in DuckDB's SQL: every aligned pair of equal tokens, then counts over windows of each alignment.
ORACLE = r"""
WITH dt AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
bt AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark),
d AS (SELECT doc_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM dt),
b AS (SELECT item_id, len(t) AS m, least(13, len(t)) AS win, unnest(t) AS w, generate_subscripts(t, 1) AS q FROM bt WHERE len(t) >= 5),
e AS (SELECT doc_id, item_id, p - q AS g, q, m, win, n FROM d JOIN b USING (w)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY q RANGE BETWEEN 0 PRECEDING AND 12 FOLLOWING) AS k13,
             count(*) OVER (PARTITION BY doc_id, item_id, g) AS k FROM e),
f AS (SELECT DISTINCT doc_id, item_id FROM c
      WHERE CASE WHEN m >= 13 THEN k13 >= 11 AND g + least(q, m - 12) >= 0 AND g + least(q, m - 12) + 12 <= n - 0
                 ELSE k >= win - (CASE WHEN win >= 11 THEN 2 WHEN win >= 7 THEN 1 ELSE 0 END) AND g >= 0 AND g + m <= n END)
SELECT dt.doc_id, count(f.item_id) > 0 AS contaminated, coalesce(string_agg(f.item_id::VARCHAR, ',' ORDER BY f.item_id), '') AS items
FROM dt LEFT JOIN f ON dt.doc_id = f.doc_id GROUP BY dt.doc_id
"""
