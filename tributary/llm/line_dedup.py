"""Line dedup [native]: repeated line runs from a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of ids of its lines that hold a word; a suffix is a place in it. Round k ranks every place by
its next 2**k lines: the pair of its rank and of that 2**k-1 lines on is counted, the pairs that occur twice or more are
sorted by range, and their order numbers are the new ranks. Equal ranks are an interval of the suffix array whose longest
common prefix is 2**k lines or more; a pair that occurs once is a suffix whose rank is distinct, and leaves. Doubling ends
when all have left, after about log2 of the longest repeated run's lines. Ranks are exact: only line ids are hashes (96 bits).

Each round's intervals name their earliest suffix, so a later place knows, at its greatest depth, a run of lines that
occurs earlier and where. Such runs that continue one another at the same distance from their copies are joined:
``repeated_runs`` lists them without those inside a longer one.

Rule: a line is deleted if it lies in ``min_lines`` consecutive lines that also occur earlier, or if it has
``min_words`` words and occurs earlier. "Earlier" is the order of (doc_id, hash of the text, line). Each first copy stays.
Lines without a word are never deleted. With 1 and 1 every later copy of a line goes, whatever its length.

Defined cases: null text is empty text; a null doc_id sorts before all others; rows equal in doc_id and text are one
document (each such row gets the same result); an empty table gives an empty result; a very long text is one row of lines,
never gathered with others; input columns named ``n_lines`` or ``n_removed`` are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_GAP, cut

LOWEST = -(2**63)
KEY = ["__ld_d", "__ld_t"]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.withColumns(
        {
            "__ld_d": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST)),
            "__ld_t": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        }
    )


def line_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line with a word: document, place among such lines, id and words; no text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # An outer generator: for another the optimizer would test the array's size below it, which makes the array twice.
    lines = docs.select(*KEY, F.posexplode_outer(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias("seq", "line"))
    return lines.where("line IS NOT NULL").select(
        *KEY,
        "seq",
        F.xxhash64("line").alias("h1"),
        F.hash("line").alias("h2"),
        F.size(F.array_remove(F.split("line", WORD_GAP), "")).alias("words"),
    )


def ranked(places: DataFrame, *by: str) -> DataFrame:
    """Places whose ``by`` occurs twice or more, with its order number as ``rank`` and its earliest place as ``first``.

    Partial aggregation keeps a hot run small. The order numbers are those of rows sorted by range: they ascend from one
    partition to the next. They are checkpointed, so that they are fixed, and so that the join with them shuffles them anew:
    adaptive execution splits a hot run's rows only in a join whose two sides come straight from a shuffle.
    """
    found = places.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "seq")).alias("first")).where("n > 1").drop("n")
    found = cut(found.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))
    return places.join(found, list(by)).drop(*by)


def paired(level: DataFrame, offset: int) -> DataFrame:
    """The rank ``a`` at each place beside that ``offset`` places on in the same document, ``b``, where both are there."""
    ahead = Window.partitionBy(*KEY).orderBy("seq").rangeBetween(offset, offset)
    return level.select(*KEY, "seq", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b")).where("b IS NOT NULL")


def levels(lines: DataFrame, min_lines: int) -> Iterator[tuple[int, DataFrame]]:
    """(span, places with rank and first) for runs of 1, 2, 4, ... lines, while any occurs twice; and of ``min_lines``."""
    span, level = 1, cut(ranked(lines, "h1", "h2"))
    while not level.isEmpty():
        yield span, level
        if span < min_lines < 2 * span:  # two overlapping runs
            yield min_lines, cut(ranked(paired(level, min_lines - span), "a", "b"))
        span, level = 2 * span, cut(ranked(paired(level, span), "a", "b"))


def later_runs(found: list[tuple[int, DataFrame]]) -> DataFrame:
    """(document, begin, n, of_d, of_t, of_seq): runs of n lines that occur earlier, at ``of``; none inside a longer one.

    Places are dealt by document once for all that follows.
    """
    later = [level.where(F.struct(*KEY, "seq") != F.col("first")).select(*KEY, "seq", F.lit(span).alias("span"), "first") for span, level in found]
    deepest = reduce(DataFrame.unionByName, later).repartition(*KEY).groupBy(*KEY, "seq").agg(F.max(F.struct("span", "first")).alias("m"))
    deepest = deepest.select(
        *KEY,
        "seq",
        F.expr("seq + m.span").alias("end"),
        F.col(f"m.first.{KEY[0]}").alias("of_d"),
        F.col(f"m.first.{KEY[1]}").alias("of_t"),
        F.expr("seq - m.first.seq").alias("shift"),
    )
    aligned = Window.partitionBy(*KEY, "of_d", "of_t", "shift").orderBy("seq")
    before = F.max("end").over(aligned.rowsBetween(Window.unboundedPreceding, -1))
    parts = deepest.withColumn(
        "new",
        (F.coalesce(before, F.lit(-1)) < F.col("seq")).cast("int"),
    ).withColumn("part", F.sum("new").over(aligned))
    runs = parts.groupBy(*KEY, "of_d", "of_t", "shift", "part").agg(F.min("seq").alias("begin"), F.max("end").alias("end"))
    longer = Window.partitionBy(*KEY).orderBy("begin", F.desc("end"), "shift").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("reach", F.coalesce(F.max("end").over(longer), F.lit(-1))).where("end > reach")
    return runs.select(*KEY, "begin", F.expr("end - begin").alias("n"), "of_d", "of_t", F.expr("begin - shift").alias("of_seq"))


def repeated_runs(docs: DataFrame, min_lines: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, begin, n_lines, of_doc_id, of_begin): repeated runs of ``min_lines`` or more, in places among lines with words."""
    found = list(levels(line_ids(keyed(docs, doc_id, text), text), min_lines))
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{doc_id}` long, begin int, n_lines int, of_doc_id long, of_begin int")
    runs = later_runs(found).where(F.col("n") >= min_lines)
    own, of = (F.when(F.col(c) != LOWEST, F.col(c)) for c in (KEY[0], "of_d"))
    return runs.select(own.alias(doc_id), "begin", F.col("n").alias("n_lines"), of.alias("of_doc_id"), F.col("of_seq").alias("of_begin"))


def removed_lines(docs: DataFrame, min_lines: int, min_words: int, text: str = "text") -> DataFrame:
    """(document, ``gone``: places of its deleted lines), for documents that lose a line."""
    lines = line_ids(docs, text)
    words = lines.select(*KEY, "seq", "h1", "h2", (F.col("words") >= min_words).alias("counts"))
    found = list(levels(words, min_lines))
    if not found:
        return docs.select(*KEY, F.expr("CAST(array() AS ARRAY<INT>)").alias("__ld_gone")).where("false")
    gone = later_runs(found).where(F.col("n") >= min_lines).select(*KEY, "begin", "n")
    if min_lines > 1:
        alone = found[0][1].where(F.col("counts") & (F.struct(*KEY, "seq") != F.col("first")))
        gone = gone.unionByName(alone.select(*KEY, F.col("seq").alias("begin"), F.lit(1).alias("n")))
    return gone.groupBy(*KEY).agg(F.flatten(F.collect_list(F.sequence("begin", F.col("begin") + F.col("n") - 1))).alias("__ld_gone"))


def line_dedup(docs: DataFrame, min_lines: int = 2, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the remaining text and the added columns ``n_lines`` and ``n_removed`` (lines with a word)."""
    docs = docs.drop("n_lines", "n_removed")
    rows = keyed(docs, doc_id, text)
    df = rows.join(removed_lines(rows.select(*KEY, F.col(f"`{text}`")), min_lines, min_words, text), KEY, "left")
    df = df.withColumn("__ld_gone", F.array_distinct("__ld_gone")).withColumn(
        "__ld_l",
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"),
    )
    df = df.withColumn("__ld_n", F.expr(r"filter(sequence(0, size(__ld_l) - 1), i -> get(__ld_l, i) rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("__ld_k", F.expr("array_except(sequence(0, size(__ld_l) - 1), transform(__ld_gone, s -> get(__ld_n, s)))"))
    left = F.when(F.col("__ld_gone").isNull(), F.col(f"`{text}`")).otherwise(
        F.expr(r"array_join(transform(__ld_k, i -> get(__ld_l, i)), '\n')")
    )
    return df.select(
        *[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.size("__ld_n").cast("long").alias("n_lines"),
        F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: The query in DuckDB's SQL, for min_lines 2 and min_words 8.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
      FROM s WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT doc_id, i, seq, line, words, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS next FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) AS nth,
             row_number() OVER (PARTITION BY line, next ORDER BY doc_id, seq) AS nth2 FROM p),
g AS (SELECT doc_id, seq FROM o WHERE words >= 8 AND nth > 1
      UNION SELECT doc_id, seq + x FROM o, (VALUES (0), (1)) AS v(x) WHERE next IS NOT NULL AND nth2 > 1),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.i) AS text
      FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.i = l.i LEFT JOIN g ON l.doc_id = g.doc_id AND l.seq = g.seq
      WHERE g.seq IS NULL GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

#: Every later copy of a line, for min_lines 1 and min_words 1.
ORACLE_EVERY_LINE = r"""
WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
m AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS said FROM s),
o AS (SELECT *, said AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS gone FROM m)
SELECT doc_id, count(*) FILTER (WHERE said) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""
