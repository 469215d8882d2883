"""Quality rules [native]: a threshold table compiled into one projection.

Each rule is a row ``(name, value, of, low, high)``; a document is kept if every ratio lies inside its bounds. All
features are SQL expressions over arrays of the document's own words and lines, so a row is judged where it was read:
no shuffle, no Python.

Defined cases: a null text counts as a text without words and fails; an empty text likewise; repeated rows are judged
one by one; very long texts are judged whole, in memory of a few times their size; other columns pass through unless their
names are those of the result, which replace them.

Repeated three-word windows are found in two steps inside the row. Numbers whose low bits hold a window's place and
whose other bits its hash are sorted: a window beside one of equal hash may be a repeat. Of these few the words themselves
are sorted and compared, so that hashes that meet by chance, as they do in a text of millions of words, count for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with in is it for on was as this are by or from at a an not "
    "le la les de des du et en un une que qui dans pour par sur est pas au aux ou "
    "der die das und zu den von mit sich auf ist im dem nicht ein eine es auch als an "
    "el los las del y que se por con para una su al lo como más es"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= value / of <= high; None: unbounded on that side. Without anything to divide by the rule fails."""

    name: str
    value: str
    of: str = "1"
    low: float | None = None
    high: float | None = None


#: Production thresholds. Ratios are of words, characters or lines as the feature names say.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("shouted_marks_per_word", "n_exclaims", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.7),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def failed(rule: Rule) -> Column:
    value = F.expr(f"try_divide(CAST({rule.value} AS DOUBLE), {rule.of})")
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (value < rule.low)
    if rule.high is not None:
        bad = bad | (value > rule.high)
    return F.coalesce(bad, F.lit(True))


def measure(docs: DataFrame, text: str = "text", place_bits: int = 1) -> DataFrame:
    """docs with the features; helper columns are gone again. place_bits: bits that a place takes from the hash, at least."""
    keep = [c for c in docs.columns if c not in (*BASE, "n_exclaims", "n_stop_words", "n_lines")]
    t = "__q_text"
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    df = df.withColumns({"__q_w": words_of(F.col(t)), "__q_l": F.expr(r"filter(split(__q_text, '\n'), l -> l rlike '[^ \\t-\\r]')")})
    df = df.withColumns(
        {
            "n_words": F.size("__q_w").cast("long"),
            "word_chars": F.expr("CAST(length(array_join(__q_w, '')) AS LONG)"),
            "n_symbols": F.expr(r"CAST(length(regexp_replace(__q_text, '[^#*$%&|<>]+', '')) AS LONG)"),
            "n_exclaims": F.expr("CAST(length(regexp_replace(__q_text, '[^!]+', '')) AS LONG)"),
            "n_lines": F.size("__q_l").cast("long"),
            "n_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
            "n_stop_words": F.expr(f"CAST(size(filter(__q_w, w -> w IN ({stop}))) AS LONG)"),
            "__q_b": F.expr(f"greatest(length(bin(size(__q_w))), {int(place_bits)})"),
        }
    )
    df = df.withColumn(
        "__q_s",
        F.expr("sort_array(CASE WHEN n_words >= 3 THEN transform(sequence(0, size(__q_w) - 3), i -> shiftleft(xxhash64(get(__q_w, i), get(__q_w, i + 1), get(__q_w, i + 2)), __q_b) | CAST(i AS LONG)) ELSE CAST(array() AS ARRAY<LONG>) END)"),
    )
    same = "shiftrightunsigned(x, __q_b) = shiftrightunsigned(get(__q_s, j {}), __q_b)"
    df = df.withColumn(
        "__q_c",
        F.expr(
            f"transform(filter(__q_s, (x, j) -> {same.format('- 1')} OR {same.format('+ 1')}), x -> CAST(x & (shiftleft(1L, "
            f"__q_b) - 1) AS INT))"
        ),
    )
    df = df.withColumn(
        "__q_e",
        F.expr(
            "sort_array(transform(__q_c, i -> struct(concat_ws(' ', get(__q_w, i), get(__q_w, i + 1), get(__q_w, i + 2)) "
            "AS k, i)))"
        ),
    )
    df = df.withColumn(
        "__q_p",
        F.expr(
            "sort_array(transform(filter(__q_e, (x, j) -> x.k = get(__q_e, j - 1).k OR x.k = get(__q_e, j + 1).k), x -> x.i))"
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(transform(__q_p, (x, j) -> least(3L, coalesce(CAST(get(__q_p, j + 1) - x AS LONG), 3L))), 0L, (a, "
            "x) -> a + x)"
        ),
    )
    features = [*BASE, "n_exclaims", "n_stop_words", "n_lines"]
    # A generator ends here what the optimizer may substitute: a later filter on a feature would else be pushed below all
    # these projections, with the word array's expression copied at each of its uses.
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*features))))


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """docs with features, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    df = measure(docs.drop("base_failed", "failed_rules", "kept"), text)
    names = [F.when(failed(r), F.lit(r.name)) for r in rules]
    df = df.withColumns(
        {
            "base_failed": F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"),
            "failed_rules": F.array_compact(F.array(*names)) if names else F.expr("CAST(array() AS ARRAY<STRING>)"),
        }
    )
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


#: The features in DuckDB's SQL, for the check of the query.
def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    rules = []
    for r in RULES:
        feature = f"{r.value}::DOUBLE / nullif({r.of}, 0)"
        if r.low is not None:
            rules.append(f"{feature} >= {r.low}")
        if r.high is not None:
            rules.append(f"{feature} <= {r.high}")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND coalesce({' AND '.join(rules)}, false) AS kept
FROM f
"""
