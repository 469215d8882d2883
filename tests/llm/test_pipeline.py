"""The pipeline against plain Python, stage by stage, on documents that hold every case."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tributary.llm import quality_rules

from .data import rows, words
from .test_native import base_of, leaks
from .test_numpy import grouped, plain_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, item_ids string, fingerprint string"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    r = random.Random(seed)
    return [w if r.random() < 0.7 else r.choice(["the", "of", "and", "is"]) for w in words(n, seed, 4000)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    r = random.Random(12)
    items = [(k, " ".join(prose(30, 500 + k))) for k in range(4)]
    shared = ["\n".join(" ".join(prose(15, 600 + 10 * k + j)) for j in range(3)) for k in range(3)]
    docs = []
    for k in range(70):
        parts = [" ".join(prose(r.randrange(30, 80), 700 + k))]
        if r.random() < 0.3:
            parts.insert(r.randrange(2), r.choice(shared))
        if r.random() < 0.2:
            parts.append(" ".join(prose(5, k) + [r.choice(items)[1]] + prose(5, k + 1)))
        docs.append("\n".join(parts))
    docs += docs[:6] + [t.replace(" the ", " a ", 1) for t in docs[6:12]] + [
        " ".join(f"{w}$$$" for w in prose(60, k)) for k in range(4)
    ] + ["short", None, ""]
    table = [(k, t, "en", "s", len(t or ""), 1, "i", "f") for k, t in enumerate(docs)] + [(i, t, "en", "s", 3, 1, "i", "f") for i, t, *_ in rows() if i is None]
    spark.createDataFrame(table, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), [(x[0], x[1]) for x in table], items


def kept_by_rules(t):
    n, chars, symbols, dups, repeats = base_of(t)
    if n < 50 or 100 * repeats > 50 * n:
        return False
    w, lines = GAP.findall(t), [x for x in t.split("\n") if GAP.search(x)]
    stops = sum(x in quality_rules.STOP_WORDS for x in w)
    return 2 <= chars / n <= 15 and symbols / n <= 0.25 and t.count("!") / n <= 0.5 and stops >= 2 and dups / len(lines) <= 0.7


def without_repeated_lines(docs):
    seen, out = set(), []
    for i, t in sorted(docs):
        lines = [x for x in t.split("\n") if GAP.search(x)]
        gone, mine = set(), set()
        for k in range(len(lines)):
            for size in (1, 2):
                key = tuple(lines[k : k + size])
                if len(key) < size or size == 1 and len(lines[k].split()) < 8:
                    continue
                if (size, key) in seen | mine:
                    gone |= set(range(k, k + size))
                mine.add((size, key))
        seen |= mine
        n, kept = -1, []
        for x in t.split("\n"):
            n += bool(GAP.search(x))
            if not (GAP.search(x) and n in gone):
                kept.append(x)
        out.append((i, "\n".join(kept)))
    return out


def test_pipeline_against_plain_python(spark, corpus):
    d, docs, items = corpus
    frame, want = spark.read.parquet(f"{d}/documents.parquet"), [(i, t) for i, t in docs if kept_by_rules(t or "")]
    columns = frame.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality_rules",
        "line_dedup",
        "simhash_near_dedup",
        "benchmark_decontamination",
        "byte_bpe",
    ]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        out = stages[name](spark, frame, d)
        out.write.mode("overwrite").parquet(f"{d}/{name}")
        return spark.read.parquet(f"{d}/{name}")

    def same(frame, want):
        assert frame.columns == columns
        assert Counter((x.doc_id, x.text) for x in frame.collect()) == Counter(want)

    frame = step("quality_rules", frame)
    same(frame, want)
    frame, want = step("line_dedup", frame), without_repeated_lines(want)
    same(frame, want)
    assert all(x.n_chars == len(x.text) for x in frame.collect())
    frame = step("simhash_near_dedup", frame)
    want = [w for k, (w, g) in enumerate(zip(want, grouped([plain_fingerprint(t) for _, t in want]), strict=True)) if k == g]
    same(frame, want)
    frame, want = step("benchmark_decontamination", frame), [(i, t) for i, t in want if not any(leaks(t, b) for _, b in items)]
    same(frame, want)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: encoding.encode_ordinary(t) for i, t in want}
    final = {(i, len(v), sha(",".join(map(str, v))), sha(dict(want)[i])) for i, v in ids.items()}
    assert {tuple(x) for x in step("byte_bpe", frame).collect()} == final
    assert {tuple(x) for x in corpus_pipeline.run(spark, d).collect()} == final and len(final) > 30


def test_pipeline_of_nothing(spark, corpus):
    d = corpus[0]
    frame = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, d)
        assert frame.count() == 0
