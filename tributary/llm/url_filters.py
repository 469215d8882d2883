"""URL filters [native]: rules by host and path, then a path-template tree judged by its labelled purity.

``rule_of`` gives the longest rule that fits a url. For urls without a rule the method decides. It grows a tree per host
from the path segments: numbers, hexadecimal ids and long tokens become wildcards at once (``{n}``); at each node,
segments too rare to stand alone become ``*`` where the node has many different ones, and a branch whose share of blocked
pages doesn't differ from that of its siblings together (two-proportion z below ``merge_z``) is merged into them. Pages
that a rule blocks or allows are the labels. A leaf template's share of blocked pages, smoothed towards ``prior`` by
``strength`` pages, is compared with ``reject``: a template without labelled pages is therefore allowed. Deeper segments
than ``depth`` are read as one; without a ``depth`` (None) the tree is as deep as its paths.

With ``inherit`` a template is smoothed towards the share of the node above it, that towards its own, and a host towards
``prior``: a branch without labelled pages is judged as what surrounds it. A node that holds all labelled pages of the one
above has nothing to add to it and takes its share.

All of it is grouping and joining of counts by (host, template, segment): a hot host is pre-aggregated. Rounds follow the
depth at which paths part, not their length, where there is no ``depth``: a path that is alone at its node is done.

Defined cases: null urls and urls without ``://`` have an empty host and path, no rule, and are allowed; repeated rows count
as often as they occur and are judged alike; a longer rule wins, and of two as long the later listed; a very long segment is
a wildcard; an empty table gives none; input columns with the names of the results are replaced, all others pass through.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path): fixed by the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int | None) -> Column:
    """Path segments with variable ones generalised by their look; those beyond depth joined."""
    parts = F.array_remove(F.split(path, "/"), "")
    variable = lambda s: s.rlike(r"^[0-9a-fA-F-]{16,}$") | (F.length(s) > 60)
    look = F.transform(parts, lambda s: F.when(variable(s), F.lit("{n}")).otherwise(F.regexp_replace(s, r"[0-9]+", "{n}")))
    if depth is None:
        return look
    return F.when(F.size(look) > depth, F.concat(F.slice(look, 1, depth - 1), F.array(F.lit("**")))).otherwise(look)


def templates(paths: DataFrame, depth: int | None, many: int, min_share: float, merge_z: float) -> DataFrame:
    """(host, segs) with its template. paths: host, segs, n, labelled, blocked."""
    df = paths.withColumn("tmpl", F.lit(""))
    done = []
    for d in itertools.count() if depth is None else range(depth):
        if depth is None:
            done.append(df.where(F.size("segs") <= d))
            df = df.where(F.size("segs") > d)
            if df.isEmpty():
                break
        df = df.withColumn("seg", F.get("segs", F.lit(d)))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        child = df.where("seg IS NOT NULL").groupBy("host", "tmpl", "seg").agg(*sums, F.count("*").alias("paths"))
        node = child.groupBy("host", "tmpl").agg(
            F.count("*").alias("kinds"),
            F.sum("n").alias("all_n"),
            F.sum("labelled").alias("all_l"),
            F.sum("blocked").alias("all_b"),
            (F.sum("paths") == 1).alias("lone"),
        )
        child = child.join(node, ["host", "tmpl"]).withColumns(
            {"rest_l": F.expr("all_l - labelled"), "rest_b": F.expr("all_b - blocked"), "p": F.expr("try_divide(all_b, all_l)")}
        )
        rare = f"(kinds >= {many} AND n < {min_share} * all_n)"
        # share of blocked pages of the branch against that of its siblings, both labelled
        apart = "abs(try_divide(blocked, labelled) - try_divide(rest_b, rest_l))"
        spread = "sqrt(greatest(p * (1 - p), 1e-9) * (try_divide(1, labelled) + try_divide(1, rest_l)))"
        alike = f"(kinds >= {many} AND coalesce(try_divide({apart}, {spread}) < {merge_z}, false))"
        # checkpointed: a join with it can split the rows of a hot host's branch
        token = cut(
            child.select(
                "host",
                "tmpl",
                "seg",
                F.expr(f"CASE WHEN {rare} OR {alike} THEN '*' ELSE seg END").alias("token"),
                "lone",
            )
        )
        longer = "CASE WHEN seg IS NULL THEN tmpl ELSE concat(tmpl, '/', token) END"
        if depth is None:
            longer = (
                f"CASE WHEN lone THEN concat(tmpl, '/', array_join(slice(segs, {d + 1}, size(segs)), '/')) ELSE "
                f"concat(tmpl, '/', token) END"
            )
        df = df.join(token, ["host", "tmpl", "seg"], "left").withColumn("tmpl", F.expr(longer)).drop("token", "seg")
        if depth is not None:
            df = cut(df.drop("lone"))
        else:
            df = cut(df)
            done.append(df.where("lone").drop("lone"))
            df = df.where("NOT lone").drop("lone")
    return reduce(DataFrame.unionByName, done) if depth is None else df


def inherited(leaf: DataFrame, strength: float, prior: float) -> DataFrame:
    """(host, tmpl) with ``blocked_share``, smoothed from the host down. leaf: host, tmpl, all_l, all_b."""
    nodes = "transform(sequence(1, size(split(tmpl, '/'))), k -> array_join(slice(split(tmpl, '/'), 1, k), '/'))"
    way = leaf.select("host", "tmpl", "all_l", "all_b", F.posexplode(F.expr(nodes)).alias("k", "node"))
    # checkpointed: the join can split the templates of a hot host
    sums = cut(way.groupBy("host", "node").agg(F.sum("all_l").alias("l"), F.sum("all_b").alias("b")))
    steps = way.select("host", "tmpl", "k", "node").join(sums, ["host", "node"])
    steps = steps.groupBy("host", "tmpl").agg(F.array_sort(F.collect_list(F.struct("k", "l", "b"))).alias("steps"))
    start = f"named_struct('l', -1L, 'share', {prior}D)"
    step = f"named_struct('l', e.l, 'share', CASE WHEN e.l = a.l THEN a.share ELSE (e.b + {strength}D * a.share) / (e.l + {strength}D) END)"
    return steps.select("host", "tmpl", F.expr(f"aggregate(steps, {start}, (a, e) -> {step}, a -> a.share)").alias("blocked_share"))


def url_filters(
    pages: DataFrame,
    rules=RULES,
    url: str = "url",
    depth: int | None = 4,
    many: int = 5,
    min_share: float = 0.02,
    merge_z: float = 1.96,
    strength: float = 4.0,
    prior: float = 0.2,
    reject: float = 0.5,
    inherit: bool = False,
) -> DataFrame:
    """pages with ``host``, ``path``, ``rule``, ``template``, ``blocked_share`` and ``verdict``."""
    own = ["host", "path", "rule", "template", "blocked_share", "verdict"]
    host, path = parts(F.col(f"`{url}`"))
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in own or c == url], host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": name, "__uf_v": verdict, "__uf_s": segments(F.col("path"), depth)})
    paths = pages.groupBy("host", F.col("__uf_s").alias("segs")).agg(
        F.count("*").alias("n"), F.count("__uf_v").alias("labelled"), F.count_if(F.col("__uf_v") == "block").alias("blocked")
    )
    tree = templates(paths, depth, many, min_share, merge_z)
    leaf = tree.groupBy("host", "tmpl").agg(F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b"))
    if inherit:
        shares = cut(inherited(leaf, strength, prior))
    else:
        share = (F.col("all_b") + strength * prior) / (F.col("all_l") + strength)
        shares = leaf.select("host", "tmpl", share.alias("blocked_share"))
    judged = tree.select("host", "segs", "tmpl").join(shares, ["host", "tmpl"])
    judged = judged.withColumnRenamed("segs", "__uf_s").withColumnRenamed("tmpl", "template")
    out = pages.join(judged, ["host", "__uf_s"], "left")
    by_method = F.when((F.col("host") != "") & (F.col("blocked_share") > reject), "block").otherwise("allow")
    given = [c for c in pages.columns if not c.startswith("__uf_")]
    return out.withColumn("verdict", F.coalesce("__uf_v", by_method)).select(*given, "template", "blocked_share", "verdict")


def oracle(
    rules=RULES,
    depth: int = 4,
    many: int = 5,
    min_share: float = 0.02,
    merge_z: float = 1.96,
    strength: float = 4.0,
    prior: float = 0.2,
    reject: float = 0.5,
    inherit: bool = False,
) -> str:
    """The query in DuckDB's SQL: a common table expression for each step of each level; ``depth`` is the levels written."""
    fits = [(v, h + p, f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    levels = []
    for d in range(depth):
        levels.append(rf"""
s{d} AS (SELECT *, segs[{d + 1}] AS seg FROM t{d}),
c{d} AS (SELECT host, tmpl, seg, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM s{d} WHERE seg IS NOT NULL GROUP BY ALL),
k{d} AS (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS all_n, sum(l) OVER w AS all_l, sum(b) OVER w AS all_b FROM c{d} WINDOW w AS (PARTITION BY host, tmpl)),
z{d} AS (SELECT *, abs(b / nullif(l, 0) - (all_b - b) / nullif(all_l - l, 0)) / nullif(sqrt(greatest((all_b / nullif(all_l, 0)) * (1 - all_b / nullif(all_l, 0)), 1e-9) * (1 / nullif(l, 0) + 1 / nullif(all_l - l, 0))), 0) AS z FROM k{d}),
t{d + 1} AS (SELECT s.host, s.segs, s.n, s.l, s.b, CASE WHEN s.seg IS NULL THEN s.tmpl ELSE s.tmpl || '/' || CASE WHEN kinds >= {many} AND (z.n < {min_share} * all_n OR coalesce(z < {merge_z}, false)) THEN '*' ELSE s.seg END END AS tmpl
  FROM s{d} s LEFT JOIN z{d} z ON s.host = z.host AND s.tmpl = z.tmpl AND s.seg = z.seg)""")
    f = f"f AS (SELECT host, tmpl, (sum(b) + {strength * prior}) / (sum(l) + {strength}) AS share FROM t{depth} GROUP BY ALL)"
    if inherit:
        f = f"""
x AS (SELECT host, l, b, unnest(generate_series(1, len(string_split(tmpl, '/')))) AS k, string_split(tmpl, '/') AS way FROM t{depth}),
y AS (SELECT host, k, array_to_string(way[1:k], '/') AS tmpl, array_to_string(way[1:k - 1], '/') AS above, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b
  FROM x GROUP BY ALL),
f AS (SELECT host, k, tmpl, l, (b + {strength * prior}::DOUBLE) / (l + {strength}::DOUBLE) AS share FROM y WHERE k = 1
  UNION ALL SELECT y.host, y.k, y.tmpl, y.l, CASE WHEN y.l = f.l THEN f.share ELSE (y.b + {strength}::DOUBLE * f.share) / (y.l + {strength}::DOUBLE) END
  FROM f JOIN y ON y.host = f.host AND y.k = f.k + 1 AND y.above = f.tmpl)"""
    return rf"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for _, n, c in fits)} END AS rule, CASE {' '.join(f"WHEN {c} THEN '{v}'" for v, _, c in fits)} END AS v,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{{16,}}$') OR length(x) > 60 THEN '{{n}}' ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END) AS look FROM h),
q AS (SELECT *, CASE WHEN len(look) > {depth} THEN list_concat(look[1:{depth - 1}], ['**']) ELSE look END AS segs FROM p),
t0 AS (SELECT host, segs, count(*) AS n, count(v) AS l, count(*) FILTER (WHERE v = 'block') AS b, '' AS tmpl FROM q GROUP BY host, segs),{','.join(levels)},
{f}
SELECT page_id, q.host, path, rule, coalesce(v, CASE WHEN q.host <> '' AND share > {reject} THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN t{depth} t ON q.host = t.host AND q.segs = t.segs JOIN f ON t.host = f.host AND t.tmpl = f.tmpl
"""
