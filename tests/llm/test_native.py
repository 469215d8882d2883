"""Quality rules, decontamination, url filters, line dedup: SQL at sf0.001, awkward rows, brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tests.compare import duck_rows, spark_rows
from tributary.llm import decontaminate, line_dedup, quality_rules, queries, url_filters

from .data import frame, rows, words

GAP = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(queries.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(queries.variants()))
def test_variants_against_sql(spark, sf_dir, name):
    assert spark_rows(queries.variants()[name](spark, sf_dir)) == duck_rows(queries.variant_sql()[name], sf_dir)


def base_of(text):
    text = text or ""
    w = GAP.findall(text)
    lines = [x for x in text.split("\n") if GAP.search(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + o for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    df = quality_rules.quality_rules(frame(spark))
    assert "lang" in df.columns and df.columns.count("n_words") == 1 and df.columns.count("kept") == 1
    got = df.collect()
    assert len(got) == len(rows())
    for r in got:
        b = base_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, r.text
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
    assert df.where("kept").count() == sum(r.kept for r in got)
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


@pytest.mark.parametrize("place_bits", [56, 60])
def test_repeats_are_of_words_not_of_hashes(spark, place_bits):
    """With a hash of a few bits nearly all windows meet; counts stay right."""
    df = quality_rules.measure(
        frame(
            spark,
            rows() + [(900, " ".join(f"v{k}" for k in range(5000)), "en", True, "m", 1, "f", 0, "i", "p", "s", "q", 9)],
        ),
        place_bits=place_bits,
    )
    for r in df.collect():
        assert r.n_repeat_words == base_of(r.text)[4], r.text


def test_quality_rules_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert all(r.kept for r in got if r.quality == 1) and not any(r.kept for r in got if r.quality == 0)


def test_line_dedup_rule(spark):
    r = random.Random(4)
    pool = [" ".join(words(r.choice([2, 3, 9]), s)) for s in range(14)]
    docs = [(k, "\n".join(r.choice([*pool, "", " "]) for _ in range(r.randrange(14)))) for k in range(60)]
    for min_lines, min_words in ((1, 1), (2, 8), (3, 100), (5, 9)):
        seen, want = set(), {}
        for i, text in sorted(docs):
            lines = [x for x in text.split("\n") if GAP.search(x)]
            gone, mine = set(), []
            for k in range(len(lines)):
                for size in {1, min_lines}:
                    key = (size, tuple(lines[k : k + size]))
                    if k + size > len(lines) or size == 1 and min_lines > 1 and len(lines[k].split()) < min_words:
                        continue
                    if key in seen or key in mine:
                        gone |= set(range(k, k + size))
                    mine.append(key)
            seen |= set(mine)
            n, kept = -1, []
            for x in text.split("\n"):
                if GAP.search(x):
                    n += 1
                    if n in gone:
                        continue
                kept.append(x)
            want[i] = (len(lines), len(gone), "\n".join(kept))
        got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_lines, min_words).collect()
        assert {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in got} == want


def test_repeated_runs_of_any_length(spark):
    """Runs of 2, 5 and 40 lines, one run a row; a run inside a longer one isn't listed; ranks end up distinct."""
    line = lambda k: f"line number {k}"
    run = {n: [line(1000 * n + k) for k in range(n)] for n in (2, 5, 40)}
    own = lambda d, n: [f"own {d} {k}" for k in range(n)]
    docs = {
        1: own(1, 3) + run[2] + own(11, 1) + run[5],
        2: run[40] + own(2, 2),
        3: own(3, 1) + run[5] + own(31, 2) + run[40],
        4: run[2],
        5: own(5, 4) + run[40][10:30] + ["", " "] + run[40][30:35] + run[5][1:4],
        6: own(6, 70),
    }
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.repeated_runs(df).collect()))
    assert got == [(3, 1, 5, 1, 6), (3, 8, 40, 2, 0), (4, 0, 2, 1, 3), (5, 4, 25, 2, 10), (5, 29, 3, 1, 7)]
    spans = [n for n, _ in line_dedup.levels(line_dedup.line_ids(line_dedup.keyed(df)), 3)]
    assert spans == [1, 2, 3, 4, 8, 16, 32]
    left = {x.doc_id: x.text for x in line_dedup.line_dedup(df, 2, 8).collect()}
    assert left[3] == "\n".join(own(3, 1) + own(31, 2)) and left[4] == "" and left[6] == "\n".join(docs[6])
    assert line_dedup.repeated_runs(frame(spark, [])).count() == 0 and line_dedup.repeated_runs(df.where("doc_id = 6")).count() == 0


def test_ranks_are_the_order_of_runs(spark):
    r = random.Random(5)
    df = spark.createDataFrame(
        [(k, "\n".join(f"l{r.randrange(4)}" for _ in range(r.randrange(30)))) for k in range(20)],
        "doc_id long, text string",
    )
    lines = line_dedup.line_ids(line_dedup.keyed(df))
    at = {}
    for x in lines.orderBy("__ld_d", "seq").collect():
        at.setdefault(x["__ld_d"], []).append((x.h1, x.h2))
    runs = lambda n: [(d, k, tuple(v[k : k + n])) for d, v in at.items() for k in range(len(v) - n + 1)]
    for span, level in line_dedup.levels(lines, 1):
        count = Counter(x for *_, x in runs(span))
        rank = {(x["__ld_d"], x.seq): x["rank"] for x in level.collect()}
        kept = [(d, k, x) for d, k, x in runs(span) if count[x] > 1]
        assert rank.keys() == {(d, k) for d, k, _ in kept}
        order = sorted({(rank[d, k], x) for d, k, x in kept})
        assert [x for _, x in order] == sorted({x for *_, x in kept})


def test_long_texts_and_clashing_columns_in_lines(spark):
    long = "\n".join(f"line {k} of a very long text that has words" for k in range(30_000))
    df = spark.createDataFrame(
        [(1, long, 5, 6, "r"), (2, long + "\nlast", 7, 8, "r"), (3, None, 1, 1, None)],
        "doc_id long, text string, n_lines int, seq int, `rank` string",
    )
    got = {x.doc_id: x for x in line_dedup.line_dedup(df).collect()}
    assert (
        got[1].n_removed,
        got[2].n_removed,
        got[2].text,
        got[2].n_lines,
        got[2].seq,
        got[3].text,
    ) == (0, 30_000, "last", 30_001, 8, None)


def test_line_dedup_awkward_rows(spark):
    got = line_dedup.line_dedup(frame(spark)).collect()
    assert len(got) == len(rows()) and {c for c in got[0].asDict()} >= {"lang", "kept", "n_words", "__row"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text is None and by[3][0].text == ""
    assert len(by[15]) == 3 and len({x.text for x in by[15]}) == 1 and by[15][0].n_removed == 0  # one document, thrice
    assert by[18][0].text == "" and by[18][0].n_removed == 1  # the same text under a later id
    assert by[30][0].text == "new first line of nine words in this one"
    assert by[51][0].text == "same line again of eight words it has"
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def leaks(text, item):
    d, m = (re.findall(r"[^\W_]+", t.lower()) for t in (text, item))
    w = min(13, len(m))
    if w < 5:
        return False
    bad = 2 if w >= 11 else 1 if w >= 7 else 0
    for g in range(-len(m), len(d)):
        for q in range(len(m) - w + 1):
            if 0 <= g + q and g + q + w <= len(d) and sum(d[g + q + k] != m[q + k] for k in range(w)) <= bad:
                return True
    return False


def test_decontamination_against_brute_force(spark):
    r = random.Random(9)
    items = [(k, " ".join(words(n, 100 + k, 5000))) for k, n in enumerate([40, 25, 13, 12, 9, 7, 6, 5, 4, 3, 0])] + [(20, None), (21, " ".join(words(40, 100, 5000)))]
    docs = []
    for k in range(160):
        body, item = words(r.randrange(60), 900 + k, 5000), (r.choice(items[:9])[1] or "").split()
        cut = item[: r.randrange(len(item) + 1)] if r.random() < 0.3 else list(item)
        for _ in range(r.randrange(4)):
            if cut:
                cut[r.randrange(len(cut))] = "sub"
        at = r.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:at] + [w.upper() + "," for w in cut] + body[at:])))
    docs += [(None, items[0][1]), (None, "clean"), (900, None), (901, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (50_000, 30):
        got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_tokens=block).collect()
        assert len(got) == len(docs)
        for x in got:
            want = [i for i, t in items if leaks(x.text or "", t or "")]
            # ten tokens may differ in one place only; no item here has ten
            assert x.item_ids == sorted(want) and x.contaminated == bool(want), (x, want)


def test_a_large_benchmark_is_one_pass(spark):
    """Beyond the broadcast size the documents are scanned once, and a seed of many documents is no cross product."""
    items = spark.createDataFrame([(k, " ".join(words(30, 5000 + k, 9000))) for k in range(300)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(k, " ".join(words(25, 7000 + k, 9000) + words(30, 5000 + k % 310, 9000))) for k in range(620)],
        "doc_id long, text string",
    )
    small, large = (decontaminate.contaminated(docs, items, block_tokens=n, short_items=True) for n in (50_000, 100))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert large.where("contaminated").count() == 600
    seeds = decontaminate.seeds(
        items.select(
            "item_id",
            decontaminate.tokens(items.text).alias("t"),
        ).selectExpr("item_id", "transform(t, x -> xxhash64(x)) AS ih"),
        "ih",
        "q",
        ["ih"],
    )
    rows_of = {r["row"]: r.words for r in decontaminate.bitmap(seeds, 1 << 17).collect()}
    found = {r.seed % (1 << 17) for r in seeds.select("seed").collect()}
    held = {row * decontaminate.ROW_BITS + 64 * w + b for row, words_ in rows_of.items() for w, m in enumerate(words_) for b in range(64) if m >> b & 1}
    assert held == found and all(len(w) == decontaminate.ROW_BITS // 64 for w in rows_of.values())


def test_decontamination_awkward_rows(spark):
    bench = spark.createDataFrame([(1, " ".join(words(20, 1)))], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark), bench).collect()
    assert len(got) == len(rows())
    assert {x.doc_id for x in got if x.contaminated} == {15, 18, 21, 24}
    long = spark.createDataFrame(
        [(1, " ".join(words(200_000, 8)) + " " + " ".join(words(20, 1)), "mine"), (2, None, None)],
        "doc_id long, text string, item_ids string",
    )
    for block in (50_000, 1):
        assert [
            (x.doc_id, x.item_ids) for x in decontaminate.contaminated(
                long,
                bench,
                block_tokens=block,
            ).orderBy("doc_id").collect()
        ] == [(1, [1]), (2, [])]
    assert decontaminate.contaminated(frame(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p) for _, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_url_rules(spark):
    urls = [
        None,
        "",
        "x",
        "http://",
        "HTTP://Example.NET/en/1",
        "http://example.net/EN/",
        "http://a.example.net/en/",
        "ftp://example.net/en",
        "http://net/",
        "http://net",
        "http://fnet/",
        "http://é.ORG/fr/x?y#z",
        "http://org/fr/",
        "http://a.example.com/de/?q=http://b.net/",
        "http://a.example.com?/de/",
        "//a.net/",
        "a://b://c.net/",
        "http://a.net/x\ny#z",
        "http://b.net#/en/",
        "http://.net/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filters.url_filters(df.selectExpr("*", "'mine' AS host", "1 AS verdict", "2 AS extra")).collect()}
    verdict = {h + p: v for v, h, p in url_filters.RULES}
    for k, u in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule) == rule_of(u), u
        assert got[k].verdict == verdict.get(got[k].rule, "allow") and got[k].extra == 2
    assert url_filters.url_filters(df.where("false")).count() == 0


def test_url_templates(spark):
    """A host's unlabelled branch is judged with the siblings it can't be told from; other hosts are left alone."""
    rules = (("block", "bad.test", "/spam/1"), ("allow", "bad.test", "/good/"))
    pages = [f"http://bad.test/spam/{n}" for n in range(100, 400)] + [f"http://bad.test/good/{n}" for n in range(200)] + [
        f"http://ok.test/{a}/{n}" for a in "abc" for n in range(40)
    ]
    got = url_filters.url_filters(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()
    verdict = {r.url: (r.template, r.verdict) for r in got}
    assert verdict["http://bad.test/spam/300"] == ("/spam/{n}", "block") and verdict["http://bad.test/good/7"] == ("/good/{n}", "allow")
    assert all(v == "allow" for u, (_, v) in verdict.items() if "ok.test" in u)


def judged(spark, urls, rules, **options):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in url_filters.url_filters(df, rules, inherit=True, **options).collect()}


def test_unlabelled_branches_are_judged_as_what_surrounds_them(spark):
    """No rule names /shop/ or /new/; their hosts' labels decide. A host without labels keeps the prior."""
    rules = (("block", "bad.test", "/spam/"), ("allow", "good.test", "/news/"))
    urls = [f"http://{h}/{s}/{n}" for h, s in (("bad.test", "spam"), ("bad.test", "shop"), ("good.test", "news"), ("good.test", "new"), ("other.test", "spam")) for n in range(20)]
    got = judged(spark, urls, rules)
    assert {urls[k].rsplit("/", 1)[0]: r.verdict for k, r in got.items()} == {
        "http://bad.test/spam": "block", "http://bad.test/shop": "block", "http://good.test/news": "allow", "http://good.test/new": "allow", "http://other.test/spam": "allow",
    }
    plain = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.verdict for r in url_filters.url_filters(plain, rules).where("rule IS NULL").collect()} == {"allow"}


def test_inherited_shares_against_plain_python(spark):
    """Shares of the whole tree, paths of any depth, without merging; a node with all labels of the one above adds nothing."""
    r = random.Random(5)
    rules = (
        ("block", "a.test", "/x/y/"),
        ("allow", "a.test", "/x/"),
        ("block", "b.test", "/y/z/x/"),
        ("allow", "b.test", "/z/"),
        ("block", "b.test", "/x/y/z/x/y/"),
    )
    urls = [f"http://{r.choice('ab')}.test/" + "/".join(r.choice("xyz") for _ in range(r.randrange(9))) for _ in range(400)]
    urls += [None, "http://a.test", "http://a.test//x//y/", *["http://a.test/x/y/z"] * 30]
    urls += ["http://a.test/" + "/".join(f"s{chr(97 + k % 26)}" for k in range(n)) for n in (90, 90, 4)]
    # two paths that part late: rounds reach there
    urls += ["http://c.test/" + "k/" * 7 + e for e in ("p", "q", "q/r")]
    verdict = {h + p: v for v, h, p in rules}

    def fits(url):
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        found = [h + p for _, h, p in rules if host == h and path.startswith(p)]
        return verdict[max(found, key=len)] if found else None

    label = [fits(u) if u else None for u in urls]
    ways = [[u.split("/")[2], *[s for s in u.split("/")[3:] if s]] if u else [""] for u in urls]
    total = Counter()
    for way, v in zip(ways, label, strict=True):
        for k in range(1, len(way) + 1):
            total[tuple(way[:k]), "l"] += v is not None
            total[tuple(way[:k]), "b"] += v == "block"
    got = judged(spark, urls, rules, depth=None, many=10**6)
    for k, way in enumerate(ways):
        share, above = 0.2, -1
        for j in range(1, len(way) + 1):
            labels, blocked = total[tuple(way[:j]), "l"], total[tuple(way[:j]), "b"]
            if labels != above:
                share = (blocked + 4.0 * share) / (labels + 4.0)
            above = labels
        assert got[k].template == "".join(f"/{s}" for s in way[1:]), way
        assert got[k].blocked_share == pytest.approx(share), way
        assert got[k].verdict == (label[k] or ("block" if way[0] and share > 0.5 else "allow")), way


@pytest.mark.parametrize("options", [{}, {"depth": None, "many": 2, "inherit": True}])
def test_url_templates_awkward_rows(spark, options):
    long = "http://a.test/" + "y" * 100_000 + "/b?" + "z" * 100_000
    urls = [
        "http://a.test/x/1",
        "http://a.test/x/1",
        "http://a.test/x/1",
        None,
        None,
        "",
        long,
        "http://a.test/" + "d/" * 30 + "e",
        "http://a.test/?",
        "http://a.test",
    ]
    df = spark.createDataFrame(
        [(k % 4, u) for k, u in enumerate(urls)],
        "page_id long, url string",
    ).selectExpr("*", "1 AS template", "2 AS lone", "3 AS seg", "4 AS l")
    got = url_filters.url_filters(df, (("block", "a.test", "/x/"),), **options)
    assert got.columns == ["page_id", "url", "lone", "seg", "l", "host", "path", "rule", "template", "blocked_share", "verdict"]
    rows = got.collect()
    assert Counter(x.url for x in rows) == Counter(urls)
    assert all(x.verdict == "block" for x in rows if x.rule) and {x.verdict for x in rows if x.host == ""} == {"allow"}
    assert {x.template for x in rows if x.url == long} == {"/{n}/b"}
    assert url_filters.url_filters(df.where("false"), **options).count() == 0
