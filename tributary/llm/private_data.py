"""PII: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) follow fixed expressions and checks and stay whatever their context. The method adds
IBANs (mod 97, as long as their country's are), social security numbers and credentials, kept if their score, raised or
lowered by whole words within ``NEAR`` characters, reaches ``threshold``. Offsets are code points, ends exclusive.

Each text is scanned once for runs of digits and separators, for ``@``, ``+`` and ``=`` or ``:``; the expressions run only
there. That finds what a leftmost scan of the whole text finds, in time linear in the text: an email's local part reaches
left from its ``@``, and an ip or card lies within one run.

Defined cases: null text is empty text, without spans; rows are judged one by one, repeated ones alike; a very long text is
scanned whole; of spans that begin together the kinds stand in the order listed; other columns pass through unless named
``pii`` or ``redacted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "credential")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT_RUN = re.compile(r"[0-9][0-9 .-]*")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IN_FOURS = re.compile(r"[A-Z0-9]{4}(?: ?[A-Z0-9]{4})*(?: ?[A-Z0-9]{1,3})?")
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
CREDENTIAL = re.compile(r"[=:]\s?[\"']?([A-Za-z0-9_/+=-]{16,})")
WORD, CAMEL = re.compile(r"[^\W_]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NEAR = 40
#: Scores before context, and words that raise or lower them.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "credential": 0.3}
RAISES = {
    "email": ("mail", "email", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "credit"), "phone": ("phone", "telephone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"), "credential": ("token", "secret", "password", "passwd", "apikey", "key"),
}
LOWERS = {"credential": ("checksum", "sha1", "sha256", "md5", "commit", "digest"), "ssn": ("order", "invoice", "isbn", "part")}
SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban_end(text: str, at: int) -> int | None:
    """The end of the IBAN that begins at ``at``: as long as its country's are, or the longest valid one elsewhere."""
    if not (m := IBAN.match(text, at)):
        return None
    signs = [k for k in range(at, m.end()) if text[k] != " "]
    lengths = [IBAN_LENGTH[c]] if (c := text[at : at + 2]) in IBAN_LENGTH else range(len(signs), 14, -1)
    for n in lengths:
        if n <= len(signs):
            end = signs[n - 1] + 1
            alone = not (end < len(text) and text[end].isalnum())
            if alone and IN_FOURS.fullmatch(text, at, end) and mod97(text[at:end].replace(" ", "")):
                return end
    return None


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in emails(text):
        yield "email", a, b
    for run in DIGIT_RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        if "." in run[0]:
            for m in IP.finditer(text, a, b):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    yield "ip", *m.span()
        if b - a >= 12:
            for m in CARD.finditer(text, a, b):
                if 12 <= len(m[0]) <= 37 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    yield "card", *m.span()
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= len(digits_of(m[0])) <= 15:
            yield "phone", *m.span()
        at = text.find("+", m.end() if m else at + 1)


def added_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for run in DIGIT_RUN.finditer(text):
        a, b = run.span()
        if b - a >= 2 and a >= 2 and text[a - 2 : a].isupper() and text[a - 2 : a].isascii() and not (
            a > 2 and text[a - 3].isalnum()
        ) and (end := iban_end(text, a - 2)):
            yield "iban", a - 2, end
        if b - a >= 11 and "-" in run[0]:
            for m in SSN.finditer(text, a, b):
                if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                    yield "ssn", *m.span()
    if "=" in text or ":" in text:
        for m in CREDENTIAL.finditer(text):
            if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                yield "credential", *m.span(1)


def words_near(text: str, start: int, end: int) -> set[str]:
    """Lower-cased whole words within NEAR characters; underscores, digits' ends and capitals inside a word part it."""
    a, b = max(0, start - NEAR), end + NEAR
    while a > 0 and start - a < 2 * NEAR and text[a - 1].isalnum() and text[a].isalnum():  # not to begin inside a word
        a -= 1
    while b < len(text) and b - end < 2 * NEAR and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    found = set()
    for w in WORD.findall(f"{text[a:start]} {text[end:b]}"):
        parts = (w, w.rstrip("0123456789"), *CAMEL.findall(w))
        found.update(p.lower() for p in parts)
    return found


def score(kind: str, text: str, start: int, end: int) -> float:
    near = words_near(text, start, end)
    s = SCORES[kind] + 0.3 * (not near.isdisjoint(RAISES[kind])) - 0.4 * (not near.isdisjoint(LOWERS.get(kind, ())))
    return round(min(1.0, max(0.0, s)), 2)


def spans_of(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind."""
    found = [(k, a, b, score(k, text, a, b)) for k, a, b in base_spans(text)]
    found += [(k, a, b, s) for k, a, b in added_spans(text) if (s := score(k, text, a, b)) >= threshold]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def find_private_data(docs: DataFrame, text: str = "text", threshold: float = 0.5, redact: bool = False) -> DataFrame:
    """docs with ``pii``, an array of (kind, start, end, score), and with ``redacted`` texts if asked."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("pii", "redacted")])
    place = docs.columns.index(text)
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("pii", T.ArrayType(SPAN)),
            *([T.StructField("redacted", T.StringType())] if redact else []),
        ]
    )
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = [spans_of(t, threshold) for t in texts]
            columns = [
                *batch.columns,
                pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], kind),
            ]
            if redact:
                columns.append(pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def base_oracle() -> str:
    """Counts and digest of the base kinds in DuckDB's SQL. A match starts after the pieces and matches before it."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = "(CAST(substr(reverse(d), i + 1, 1) AS INT) * (1 + i % 2))"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (
            r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
            "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))",
        ),
        "card": (
            r"[0-9](?:[\x20-]?[0-9])+",
            f"length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: {doubled} // 10 + {doubled} % 10)) % 10 = 0",
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    }
    tables = []
    for k, (kind, (pattern, holds)) in enumerate(kinds.items()):
        tables.append(rf"""
a{k} AS (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM t),
b{k} AS (SELECT r, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS j, gaps, ms FROM a{k}),
c{k} AS (SELECT r, m, {digits} AS d, list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS s FROM b{k}),
f{k} AS (SELECT r, '{kind}' AS kind, {k} AS o, s, s + length(m) AS e FROM c{k} WHERE {holds})""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),{','.join(tables)},
u AS ({' UNION ALL '.join(f"SELECT * FROM f{k}" for k in range(len(kinds)))})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256
FROM t LEFT JOIN u USING (r) GROUP BY r, doc_id
"""
