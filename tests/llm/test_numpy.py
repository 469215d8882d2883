"""Chats, personal data, substring dedup, SimHash, byte pairs, classifier: brute force, round trips, held-out labels."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from tests.compare import duck_rows, shaped, spark_rows
from tributary.llm import byte_bpe, chat_format, private_data, quality_classifier, queries, simhash, substring_dedup, word_arrays

from .data import frame, rows, words

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
GAP = re.compile(r"[^\x20\x09-\x0D]+")


# Chats


def chat_digests(turns):
    by = {}
    for c, t, r, x in sorted(turns, key=lambda q: (q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, v in by.items():
        learned = "".join(x for r, x in v if r == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), len(learned), sha(learned))
    return out


CONTROL_PARTS = ["<", "s", ">", "/", "\\", "[INST]", "<s>", "</s>", "<<SYS>>", "|turn|>", "<|", "[/", "INST]", "\n", "é", "😀", ""]


def test_chats_read_back(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(CONTROL_PARTS) for _ in range(r.randrange(9)))
    turns = [
        (
            r.choice([None, *range(40)]),
            r.randrange(4),
            r.choice(["user", "assistant", "system", None, word()]),
            r.choice([None, word(), word() * 40]),
        ) for _ in range(600)
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for size in (4096, 7):
        chats = chat_format.format_chats(df.selectExpr("*", "1 AS formatted"), size)
        got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat_format.digests(chats).collect()}
        assert got == chat_digests(turns)
    for x in chats.collect():
        body = x.formatted[len(chat_format.BEGIN) :]
        assert not any(c in part[: -len(chat_format.END)] for part in body.split(chat_format.TURN)[1:] for c in chat_format.CONTROL)
    assert chat_format.digests(chat_format.format_chats(df.where("false"))).count() == 0


def test_long_chats_and_clashing_columns(spark):
    """Texts above a block and above the copied slices; other columns don't matter."""
    long = "</s>é" * 400_000
    turns = [
        (1, 0, "user", long),
        (1, 1, "assistant", "x" * 600),
        (2, 0, "assistant", long[1:]),
        (3, 0, "user", "short"),
        (3, 1, "assistant", "y" * 512),
    ]
    df = spark.createDataFrame(
        turns,
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "1 AS loss_start", "'x' AS formatted", "2 AS n_turns")
    for size in (4_000_000, 1000):
        got = {
            x.conv_id: (
                x.n_turns,
                x.turns_sha256,
                x.loss_chars,
                x.loss_sha256,
            ) for x in chat_format.digests(chat_format.format_chats(df, block_bytes=size)).collect()
        }
        assert got == chat_digests(turns)


def test_segments_are_gathered_in_order():
    r = np.random.default_rng(1)
    source = r.integers(0, 256, 5000).astype(np.uint8)
    begin = r.integers(0, 3000, 40)
    size = r.choice([0, 1, 7, 511, 512, 513, 1900], 40)
    out, ends = chat_format.gathered(source, begin, size)
    assert out.tobytes() == b"".join(source[a : a + n].tobytes() for a, n in zip(begin, size, strict=True)) and ends.tolist() == np.cumsum(size).tolist()


def test_chat_query(spark, sf_dir):
    turns = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    got = {x.conv_id: tuple(x)[1:5] for x in queries.op2_chat_format(spark, sf_dir).collect()}
    assert got == chat_digests(turns)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


def test_base_spans_against_plain_scan():
    r = random.Random(3)
    parts = [
        *"00192.. --+@()ab_%",
        "4539578763621486",
        "4539-5787 6362-1486",
        "@a.b",
        "x@y.z-w.q",
        " +1 (555) 555-1234",
        "10.0.0.1",
        "1.2.3.256",
        "é",
    ]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        got = sorted(private_data.base_spans(text), key=lambda x: (x[1], list(PATTERNS).index(x[0])))
        assert got == base_spans(text), text


def test_base_kinds_in_sql_against_plain_scan():
    r = random.Random(4)
    parts = [
        *"00192.. --+@()ab_%",
        "4539578763621486",
        "4539-5787 6362-1486",
        "@a.b",
        "x@y.z-w.q",
        " +1 (555) 555-1234",
        "10.0.0.1",
        "1.2.3.256",
        "0" * 30 + "1.2.3.4",
        "9" * 30 + ".2.3.4",
        "é",
        "\U0001d7d8",
    ]
    texts = [None, "", *["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(5_000)]]
    ids = [k // 2 for k in range(len(texts))]
    spans = [base_spans(t or "") for t in texts]
    want = [(i, *[sum(k == z for k, _, _ in s) for z in PATTERNS], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))) for i, s in zip(ids, spans, strict=True)]
    names, got = duck_rows(private_data.base_oracle(), documents=pa.table({"doc_id": ids, "text": texts}))
    assert (names, got) == shaped(["doc_id", *[f"n_{k}" for k in PATTERNS], "base_sha256"], want)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000, "a" * 300_000 + "@", "1 " * 150_000):
        private_data.spans_of(text)


def test_added_kinds_need_checksum_and_context():
    kinds = lambda t: [k for k, *_ in private_data.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"] and kinds("IBAN DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("order 123-45-6789") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3"') == ["credential"] and kinds("sha1: 24be64439e3e49cf46b2d7c90f3602a3") == []
    assert private_data.redacted("mail a@b.co now", private_data.spans_of("mail a@b.co now")) == "mail <email> now"


def test_context_is_whole_words():
    kinds = lambda t: [k for k, *_ in private_data.spans_of(t)]
    assert kinds(
        "my ssn is 123-45-6789 of the sales department"
    ) == ["ssn"] and kinds("part 123-45-6789 ssn") == [] and kinds("monkey: 24be64439e3e49cf46b2d7c90f3602a3") == []
    for name in ("accessKey", "API_KEY", "token2", "my-secret", "PASSWORD"):
        assert kinds(f"{name} = 24be64439e3e49cf46b2d7c90f3602a3") == ["credential"], name
    assert kinds("commitKey = 24be64439e3e49cf46b2d7c90f3602a3") == []


def test_ibans_end_where_their_country_s_do():
    found = lambda t: [t[a:b] for k, a, b, _ in private_data.spans_of(t) if k == "iban"]
    assert found(
        "IBAN BE71 0961 2345 6769 PAID"
    ) == ["BE71 0961 2345 6769"] and found("BE71096123456769 PAID IN FULL") == ["BE71096123456769"]
    assert found("DE89 3704 0044 0532 0130 00 2024") == ["DE89 3704 0044 0532 0130 00"] and found("DE89370400440532013000X") == []
    assert found("NO93 8601 1117 947, NO9386011117947") == ["NO93 8601 1117 947", "NO9386011117947"]
    assert found("BE7 1096 1234 56769") == [] and found("xBE71 0961 2345 6769") == [] and found("BE71 0961 2345 6768") == []
    private_data.spans_of("BE71 " * 50_000), private_data.spans_of("ZZ71" * 50_000)


def test_private_data_awkward_rows(spark):
    some = [(1, "a@b.co 10.0.0.1"), (2, None), (3, ""), (1, "a@b.co 10.0.0.1")]
    got = private_data.find_private_data(
        spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 AS pii"),
        redact=True,
    ).collect()
    assert sorted((x.doc_id, len(x.pii), x.redacted) for x in got) == [
        (1, 2, "<email> <ip>"),
        (1, 2, "<email> <ip>"),
        (2, 0, ""),
        (3, 0, ""),
    ]
    assert private_data.find_private_data(frame(spark)).count() == len(rows())
    assert private_data.find_private_data(frame(spark, [])).count() == 0


def test_private_data_query(spark, sf_dir):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for x in queries.op3_private_data(spark, sf_dir).collect():
        want = base_spans(texts[x.doc_id])
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert x.base_sha256 == sha(",".join(said)) and set(said) <= set(x.spans.split(",")) | {""}
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == z for k, _, _ in want) for z in PATTERNS]


# Substring dedup


def kept_words(docs, window):
    starts = {}
    split = [(i, GAP.findall(t or "")) for i, t in docs]
    low = lambda i: -(2**63) if i is None else i
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, 2**63), low(i))
    out = []
    for i, w in split:
        gone = {k + o for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] < low(i) for o in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group,batch", [(2_000_000, 4_000_000), (300, 2_000)])
def test_substring_dedup(spark, monkeypatch, group, batch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "BATCH_CHARS", batch)
    r = random.Random(6)
    shared = [words(r.randrange(10, 30), 70 + k) for k in range(6)]
    docs = [
        (
            k,
            " ".join(sum((r.choice([*shared, words(r.randrange(20), 1000 + 50 * k + j, 3000)]) for j in range(4)), [])),
        ) for k in range(80)
    ]
    docs += [(i, t) for i, t, *_ in rows()]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == kept_words(docs, 13)


def test_rows_of_one_id_are_dealt_apart(spark, monkeypatch):
    """Batches follow id and text, and what a batch's keys say holds whichever batch the smallest document lies in."""
    monkeypatch.setattr(substring_dedup, "BATCH_CHARS", 500)
    shared = words(40, 5)
    docs = [(None if k % 2 else 7 + k % 3, " ".join(words(30, 100 + k) + shared[k % 10 :])) for k in range(60)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == kept_words(docs, 13)


def test_substring_dedup_of_long_texts_and_clashing_columns(spark):
    text = " ".join(words(150_000, 8, 50_000))
    docs = [(2, text, 1, "x", None), (1, text + " one more", 2, "y", None), (3, "  ", 3, "z", None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, b int, kept string, n_words int")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got) == [
        (1, 150_002, 0, text + " one more"),
        (2, 150_000, 150_000, ""),
        (3, 0, 0, ""),
    ]


def test_substring_dedup_without_rows_or_words(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert [
        tuple(x) for x in substring_dedup.remove_repeats(
            spark.createDataFrame([(1, None), (1, " ")], "doc_id long, text string")
        ).collect()
    ] == [(1, 0, 0, "")] * 2


def test_word_arrays():
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()]
    data, offsets = word_arrays.raw(pa.array(texts)[2:])
    begin, end, upto = word_arrays.words(data, offsets)
    raw = data.tobytes()
    found = [[raw[a:b].decode() for a, b in zip(begin[p:q], end[p:q], strict=True)] for p, q in zip(upto[:-1], upto[1:], strict=True)]
    assert found == [GAP.findall(t or "") for t in texts[2:]]
    h = word_arrays.hashes(data, begin, end)
    flat = [w for f in found for w in f]
    assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat))
    for n in (1, 2, 5, 13):
        keys, tuples = word_arrays.runs(h, n), [tuple(flat[k : k + n]) for k in range(len(flat) - n + 1)]
        assert len(set(keys.tolist())) == len(set(tuples)) == len(set(zip(keys.tolist(), tuples, strict=True)))


# SimHash


def plain_fingerprint(text):
    w = GAP.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, radius=4):
    """The root's place for each fingerprint, by comparing all."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(prints))]


def test_simhash_query(spark, sf_dir):
    docs = sorted((x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    want = {i: (f"{p:016x}", docs[g][0]) for (i, _), p, g in zip(docs, prints, grouped(prints), strict=True)}
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op6_simhash(spark, sf_dir).collect()} == want


def test_simhash_of_a_very_long_text(spark):
    text = " ".join(words(200_000, 3, 50_000))
    assert simhash.fingerprints_of([text, "a b c d e", ""]).tolist() == [plain_fingerprint(t) for t in (text, "a b c d e", "")]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tributary.llm import common

    class Empty:
        getCheckpointDir = lambda self: SimpleNamespace(isEmpty=lambda: True)

    session = SimpleNamespace(
        sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=Empty), master="spark://host:7077"),
        conf=SimpleNamespace(get=lambda k, d: d),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(session)


def test_simhash_awkward_rows(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(rows())
    of = {x.doc_id: x for x in got}
    assert of[0].fingerprint == of[3].fingerprint == of[6].fingerprint == 0 and of[6].component_id == 0
    assert of[15].component_id == of[18].component_id == 15 and of[21].component_id == 15
    once = simhash.one_of_each(frame(spark)).collect()
    assert [x.doc_id for x in once].count(15) == 1 and 18 not in [x.doc_id for x in once] and once[0].asDict().keys() == frame(spark).first().asDict().keys()
    assert len({simhash.fingerprints_of([x.text or ""])[0] for x in once}) == len(once)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("tile,blocks", [(4096, None), (16, None), (4096, 6)])
def test_simhash_links_of_hot_keys(spark, monkeypatch, tile, blocks):
    """A large key is cut into tile pairs; chains of links hold together."""
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(8)
    prints, p = {r.getrandbits(64) for _ in range(150)}, r.getrandbits(64)
    for _ in range(150):
        p ^= 1 << r.randrange(64) | 1 << r.randrange(64) | 1 << r.randrange(64)
        prints.add(p)
    prints |= {p ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)) ^ (1 << r.randrange(64)) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(prints)], "doc_id long, fingerprint long")
    got = {x.fingerprint % (1 << 64): x.component_id for x in simhash.classes(df, blocks=blocks).collect()}
    assert [got[x] for x in prints] == grouped(prints)


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (10**5, 10**7, 10**9, 10**12)] == [5, 6, 7, 8]


# Byte pairs


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_against_the_library(reference_encoding):
    r = random.Random(1)
    alphabet = [*"ab'srtvemld  \n\t12.!é漢\u3000\u0085😀'Ⅷ\u001c", "'s", "'re", "'ll", " '", "  "]
    texts = ["", "'", "''s", "a's 's\n's", "a'", "x're've'll'lx", " " * 5, " a  ", "a" * 3000 + "é" * 300, "<|endoftext|>"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(20_000)]
    v = byte_bpe.Vocabulary(VOCABULARY)
    ids, offsets, said = v.encode(texts)
    back = v.decode(ids, offsets)
    for k, t in enumerate(texts):
        want = reference_encoding.encode_ordinary(t)
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want and back[k] == t.encode() and said[k] == ",".join(map(str, want)), t
    assert v.merged(b"abc" * 15) == v.merged_long(b"abc" * 15)


def test_every_code_point_as_the_library_reads_it(reference_encoding):
    """Each code point before a contraction, alone, doubled and behind a space: classes and boundaries together."""
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    v = byte_bpe.Vocabulary(VOCABULARY)
    for k in range(0, len(every), 50_000):
        texts = ["".join(f"{x}'s {x}{x}" for x in every[a : a + 500]) for a in range(k, min(k + 50_000, len(every)), 500)]
        ids, offsets, _ = v.encode(texts)
        assert ids.tolist() == [i for t in texts for i in reference_encoding.encode_ordinary(t)]


def test_class_table_is_the_library_s():
    classes = byte_bpe.class_table()
    assert classes[0x558] == byte_bpe.OTHER and classes[ord("é")] == byte_bpe.LETTER and classes[ord("Ⅷ")] == byte_bpe.NUMBER and classes[0x85] == byte_bpe.WHITE
    for kind, expression in ((byte_bpe.LETTER, r"\p{L}"), (byte_bpe.NUMBER, r"\p{N}")):
        assert sorted(byte_bpe.matching(expression, "".join(map(chr, range(0x3000))))) == np.flatnonzero(classes[:0x3000] == kind).tolist()


def test_scan_composes_the_automaton_s_functions():
    numbers, products, result, _ = byte_bpe.monoid()
    r = random.Random(4)
    for n in (1, 2, 255, 256, 257, 70_000):
        some = [r.randrange(2 * byte_bpe.SYMBOLS) if r.random() < 0.02 else r.randrange(byte_bpe.SYMBOLS) for _ in range(n)]
        got = byte_bpe.scanned(numbers[some], products)
        for begin in byte_bpe.STATES:
            state, want = begin, []
            for x in some:
                state = byte_bpe.step(byte_bpe.NOTHING if x >= byte_bpe.SYMBOLS else state, x % byte_bpe.SYMBOLS)[0]
                want.append(state)
            assert result[got, begin].tolist() == want
    for a in range(len(products)):  # associative, as compositions are
        assert (products[products[a]] == products[a][products]).all()


def test_pieces_merged_together_as_one_by_one():
    v, r = byte_bpe.Vocabulary(VOCABULARY), random.Random(3)
    pieces = list(
        {
            "".join(r.choice("abcdefé 漢\x00lingtheouer") for _ in range(r.randrange(1, 60))).encode() for _ in range(3000)
        } | {b"aaaa", b"aaaaaaa", b"\xff\xfe"}
    )
    assert [np.frombuffer(x, np.int32).tolist() for x in v.merged_together(pieces)] == [v.merged(p) for p in pieces]


def test_byte_pairs_awkward_rows(spark, reference_encoding):
    got = byte_bpe.encode_decode(frame(spark).selectExpr("*", "'x' AS n_tokens"), VOCABULARY).collect()
    assert len(got) == len(rows()) and got[0].ids is not None
    for x, (i, t, *_) in zip(got, rows(), strict=True):
        want = reference_encoding.encode_ordinary(t or "")
        assert (x.doc_id, x.text, x.ids, x.n_tokens) == (i, t or "", want, len(want))
        assert x.ids_sha256 == sha(",".join(map(str, want))) and x.decoded_sha256 == sha(t or "")
    assert byte_bpe.encode_decode(frame(spark, []), VOCABULARY).count() == 0


def test_byte_pair_query(spark, sf_dir, reference_encoding):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for x in queries.op7_byte_bpe(spark, sf_dir).collect():
        ids = reference_encoding.encode_ordinary(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[x.doc_id]))


# Classifier


def test_gradients():
    r = np.random.default_rng(0)
    x, first, y = r.normal(size=(9, quality_classifier.FEATURES)), np.array([0, 2, 5, 9]), np.array([0.0, 1, 1])
    net = quality_classifier.Network(1)

    def loss():
        logit = net.forward(x, first)[-1]
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    for k, grad in enumerate(net.gradients(x, first, y)):
        at = tuple(0 for _ in grad.shape)
        was = net.values[k][at]
        net.values[k][at] = was + 1e-5
        up = loss()
        net.values[k][at] = was - 1e-5
        down = loss()
        net.values[k][at] = was
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_held_out_labels_are_predicted(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {x.doc_id: x for x in queries.op9_quality_classifier(spark, d).collect()}
    assert len(got) == docs.count()
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    for x in got.values():
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)
    out = [(x.quality, got[x.doc_id].predicted) for x in labels if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) > 0.95 and np.mean([b for a, b in out if a]) > 0.97


def test_classifier_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame(
        [(12, 1, 0), (15, 1, 0), (15, 1, 0), (18, 0, 0), (None, 0, 0), (27, None, 0), (45, 0, 1), (9999, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= x.score <= 1 for x in got)
    scores = [tuple(x) for x in got]
    assert sorted(scores, key=repr) == sorted([tuple(x) for x in quality_classifier.classify(docs, labels).collect()], key=repr)
    assert {x.score for x in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(frame(spark, []), labels).count() == 0


def plain_passages(text):
    """Features by plain Python: shares and logarithms of byte classes, word lengths, stop words, repeats, fill."""
    data = (text or "").encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if not at:
        return [[0.0] * quality_classifier.FEATURES]
    out = []
    for k in range(0, len(at), quality_classifier.PASSAGE):
        mine = at[k : k + quality_classifier.PASSAGE]
        to = at[k + len(mine)][0] if k + len(mine) < len(at) else len(data)
        kinds = [0] * quality_classifier.CLASSES
        for b in data[mine[0][0] : to]:
            kinds[quality_classifier.CLASS[b]] += 1
        w, n = [data[a:b].decode() for a, b in mine], len(mine)
        tail = [
            np.log1p(sum(len(x.encode()) for x in w) / n),
            sum(len(x.encode()) == 1 for x in w) / n,
            sum(x in set(quality_classifier.STOP_WORDS) for x in w) / n,
            (n - len(set(w))) / n,
            n / quality_classifier.PASSAGE,
        ]
        out.append([x / max(sum(kinds), 1) for x in kinds] + [np.log1p(x / n) for x in kinds] + tail)
    return out


def test_passages_against_plain_python():
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()] + ["The the THE of. " * 70 + "!?#$ 123\n", " lead  and trail \n"]
    x, first = quality_classifier.passages(pa.array(texts))
    want = [plain_passages(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    assert np.allclose(x, np.array([p for w in want for p in w]), atol=1e-6)


def test_training_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(k, " ".join(words(80, k)) if k % 2 else "### $$$ " * 40) for k in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    a, b = (quality_classifier.train(d, labels) for d in (docs, docs.unionByName(docs)))
    assert all((x == y).all() for x, y in zip(a.values, b.values, strict=True))


def test_labels_of_held_out_rows_are_not_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr(
        "doc_id",
        "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality",
        "toxic",
    )
    a, b = (sorted(map(tuple, quality_classifier.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_queries_have_names(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert duck_rows("SELECT 1 AS a") == spark_rows(spark.sql("SELECT 1 AS a"))
