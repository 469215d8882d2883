"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised. Code points become classes by a table (letter, number, space, other white space, other),
and with their neighbours symbols: white space knows whether its run ends here, an apostrophe whether a contraction
follows. Each symbol is a transition function of the pattern's automaton (``STATES``). These functions form a small monoid,
whose members are numbered and whose products are a table, so that composing two is a table look-up. An associative scan
over the numbers (``scanned``: inside rows, over the rows' totals, back) gives the automaton's state before every code
point, and state and symbol say whether a token starts there. No regular expression runs over the text.

The slices found are an Arrow dictionary: each different slice of a block is merged once, pair by pair, lowest rank first,
or found in a cache. Ids come with the offsets of each document's tokens; decoding gathers the vocabulary's bytes by them.

Texts are handled in blocks of ``BLOCK_BYTES`` at least one document long, so that memory is bounded by the longest text.

Defined cases: null text is empty text and gives no ids; other columns pass through unless named like the result's;
repeated rows are encoded one by one; a very long text is a block of its own. Ids are those of the tiktoken library for the
same ranks and pattern, without special tokens: the class table is read off that library.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import word_arrays as W

#: Bytes of text handled at once.
BLOCK_BYTES = 2_000_000
CACHE_PIECES = 300_000
#: Longer pieces are merged one by one.
TOGETHER = 48
NONE = np.iinfo(np.int32).max
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE = range(6)


def matching(expression: str, every: str) -> np.ndarray:
    """Code points of ``every`` that the library's expression engine matches."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    found = tiktoken.Encoding("class", pat_str=expression, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
    return np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)


@lru_cache(1)
def class_table() -> np.ndarray:
    """A class for each code point, by the tables of the library whose ids are to be met."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        table[matching(name, every)] = kind
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


#: What a code point does: its class, white space inside a run (or at the text's end), a plain space or other white space
#: before something else, an apostrophe with a contraction of one or two letters behind it.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_RUN, LAST_SPACE, LAST_WHITE, SHORT, LONG = range(8)
SYMBOLS = 8
#: What is open after a code point: nothing, a token of letters, numbers, others, white space, a space that what follows
#: joins, a contraction with one or two letters to come.
NOTHING, LETTERS, NUMBERS, OTHERS, BLANKS, JOINING, ONE_MORE, TWO_MORE = STATES = range(8)
#: From a state in which the next code point starts a token.
OPENS = {
    IN_LETTER: LETTERS,
    IN_NUMBER: NUMBERS,
    IN_OTHER: OTHERS,
    IN_RUN: BLANKS,
    LAST_SPACE: JOINING,
    LAST_WHITE: NOTHING,
    SHORT: ONE_MORE,
    LONG: TWO_MORE,
}


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the code point."""
    if state in (ONE_MORE, TWO_MORE):
        return (NOTHING if state == ONE_MORE else ONE_MORE), False
    goes_on = {
        LETTERS: (IN_LETTER,),
        NUMBERS: (IN_NUMBER,),
        OTHERS: (IN_OTHER, SHORT, LONG),
        BLANKS: (IN_RUN,),
        JOINING: (IN_LETTER, IN_NUMBER, IN_OTHER, SHORT, LONG),
    }
    if symbol in goes_on.get(state, ()):
        return (OTHERS if symbol in (SHORT, LONG) else OPENS[symbol]), False
    return OPENS[symbol], True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton's transition functions, closed under composition.

    The number of each symbol's function (those of a text's first code point, which forget the state, behind the others),
    products[a, b]: the number of "a, then b", result[a, s]: the state after a from s, and starts[s, symbol].
    """
    plain = [tuple(step(s, x)[0] for s in STATES) for x in range(SYMBOLS)]
    first = [tuple(step(NOTHING, x)[0] for _ in STATES) for x in range(SYMBOLS)]
    known = {tuple(STATES): 0}
    for f in (*plain, *first):
        known.setdefault(f, len(known))
    todo, members = 0, list(known)
    while todo < len(members):
        for g in (*plain, *first):
            made = tuple(g[s] for s in members[todo])
            if made not in known:
                known[made] = len(known)
                members.append(made)
        todo += 1
    products = np.array([[known[tuple(b[s] for s in a)] for b in members] for a in members], np.uint16)
    starts = np.array([[step(s, x)[1] for x in range(SYMBOLS)] for s in STATES])
    return np.array([known[f] for f in (*plain, *first)], np.uint16), products, np.array(members, np.uint8), starts


def scanned(functions: np.ndarray, products: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive scan: the product of all functions up to each place.

    Rows of ``width`` are scanned side by side; their totals are scanned likewise, and each row takes in what came before.
    """
    n = len(functions)
    flat, size = products.ravel(), len(products)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)  # number 0 changes nothing
    padded[:n] = functions
    table = np.ascontiguousarray(padded.reshape(rows, width).T)  # a column for each stretch
    for k in range(1, width):
        table[k] = flat[table[k - 1].astype(np.intp) * size + table[k]]
    if rows > 1:
        before = scanned(table[-1], products, width)[:-1]
        table[:, 1:] = flat[before.astype(np.intp)[None, :] * size + table[:, 1:]]
    return table.T.ravel()[:n]


def symbols(points: np.ndarray, head: np.ndarray) -> np.ndarray:
    """head: where texts begin, and one more True at the end."""
    n = len(points)
    kind = class_table()[points]
    last = head[1:]
    out = np.array([IN_LETTER, IN_NUMBER, IN_RUN, IN_RUN, IN_OTHER, IN_OTHER], np.uint8)[kind]
    white = out == IN_RUN
    tail = white & ~last
    tail[:-1] &= ~white[1:]
    out[tail] = np.where(kind[tail] == SPACE, LAST_SPACE, LAST_WHITE)
    at = np.flatnonzero((kind == QUOTE) & ~last)
    if len(at):
        one = points[at + 1]
        two = np.where(head[np.minimum(at + 2, n)], 0, points[np.minimum(at + 2, n - 1)])
        longer = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[at[longer]] = LONG
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    return out


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start. points: code points of texts on end; first: where each non-empty text starts."""
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    symbol = symbols(points, head)
    numbers, products, result, opens = monoid()
    upto = scanned(numbers[symbol + SYMBOLS * head[:-1]], products)
    before = np.empty(n, np.uint8)
    before[:1] = NOTHING
    before[1:] = result[upto[:-1], NOTHING]
    before[head[:-1]] = NOTHING
    return np.flatnonzero(opens[before, symbol])


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.names = pa.array([b"%d," % k for k in range(size)], pa.large_binary())
        self.cache: dict[bytes, bytes] = {}
        self.single = [r.to_bytes(4, sys.byteorder) for r in range(size)]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to make a token of two others, in an open hash table
        ranks = self.ranks
        made = [(x << 32 | y, r) for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        keys, values = np.array(made, np.int64).reshape(-1, 2).T.copy()
        self.pair_keys, self.pair_values = np.full(4 * len(keys) + 1, -1, np.int64), np.zeros(4 * len(keys) + 1, np.int32)
        slot, left = self.slot_of(keys), np.arange(len(keys))
        while len(left):
            free = self.pair_keys[slot] < 0
            self.pair_keys[slot[free]] = keys[left[free]]  # of several the last one stays; the others go on
            put = self.pair_keys[slot] == keys[left]
            self.pair_values[slot[put]] = values[left[put]]
            left, slot = left[~put], (slot[~put] + 1) % len(self.pair_keys)

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self.merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 60:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """As merged(), with a heap: a run of letters may be as long as a text."""
        n, ranks = len(piece), self.ranks
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray([1]) * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != to:
                continue
            end[i], alive[j], after[i] = to, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's joined bytes, or NONE: probes of the hash table until the pair or an empty slot."""
        key = left.astype(np.int64) << 32 | right
        slot = self.slot_of(key)
        out, open_ = np.full(len(key), NONE, np.int32), np.arange(len(key))
        while len(open_):
            there = self.pair_keys[slot]
            met = there == key[open_]
            out[open_[met]] = self.pair_values[slot[met]]
            on = ~met & (there >= 0)
            open_, slot = open_[on], (slot[on] + 1) % len(self.pair_keys)
        return out

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        return (W.mix(key.astype(np.uint64)) % np.uint64(len(self.pair_keys))).astype(np.int64)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of 32-bit numbers.

        Pieces of one length are a matrix of ids beside one of their neighbours' pair ranks; in a step every row that has
        a pair left joins its lowest, leftmost one, so the rows stay equally long.
        """
        out, by = [b""] * len(pieces), {}
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[k] = self.single[r]
            elif len(p) > TOGETHER:
                out[k] = np.array(self.merged(p), np.int32).tobytes()
            else:
                by.setdefault(len(p), []).append(k)
        for size, rows in by.items():
            rows = np.array(rows)
            ids = self.byte_ids[np.frombuffer(b"".join([pieces[k] for k in rows.tolist()]), np.uint8).reshape(-1, size)]
            ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, size - 1)
            while True:
                at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
                low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
                done = low == NONE
                if done.any():
                    width = 4 * ids.shape[1]
                    raw = ids[done].tobytes()
                    for j, k in enumerate(rows[done].tolist()):
                        out[k] = raw[j * width : (j + 1) * width]
                    rows, ids, ranks, at, low = rows[~done], ids[~done], ranks[~done], at[~done], low[~done]
                if not len(rows):
                    break
                every, w = np.arange(len(rows)), ids.shape[1] - 1
                take = np.arange(w) + (np.arange(w) > at[:, None])
                ids = np.take_along_axis(ids, take, 1)
                ids[every, at] = low
                take = take[:, : w - 1] if w > 1 else np.zeros((len(rows), 0), np.int64)
                ranks = np.take_along_axis(ranks, take, 1)
                for some, j in ((at > 0, at - 1), (at < w - 1, at)):
                    r, c = every[some], j[some]
                    ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
        return out

    def looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different slices on end, and where each slice's ids begin (and the end)."""
        cache, pieces = self.cache, pieces.to_pylist()
        if len(cache) > CACHE_PIECES:
            cache.clear()
        found = list(map(cache.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(new, self.merged_together([pieces[k] for k in new]), strict=True):
            found[k] = ids
            if len(pieces[k]) <= 64:
                cache[pieces[k]] = ids
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts on end, where each text's ids begin (and the end), and each text's ids as decimal text."""
        data, offsets = W.raw(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), [""] * (len(offsets) - 1)
        joined = data.tobytes()
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            place, begin = None, offsets
        else:  # bytes before each code point
            place = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))])
            begin = np.searchsorted(place, offsets)
        at = starts(points, begin[:-1][np.diff(begin) > 0])
        cuts = np.append(at if place is None else place[at], len(data))
        slices = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(joined)])
        coded = slices.dictionary_encode()
        own, own_at = self.looked_up(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = np.diff(own_at)[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = own[np.repeat(own_at[which] - upto[:-1], counts) + np.arange(upto[-1])]
        of = upto[np.searchsorted(at, begin)]
        return ids, of, [x[:-1].decode() for x in gathered(self.names, ids, of)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        return gathered(self.tokens, ids, offsets)


def gathered(table: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The table's entries for each text's ids, on end."""
    _, upto, data = table.take(pa.array(ids, pa.int32())).buffers()
    upto = np.frombuffer(upto, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    ends, raw = upto[offsets].tolist(), memoryview(data or b"")
    return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process; its cache outlives the task."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, vocabulary_path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if with_ids, ``ids``; ``text`` is replaced by what
    the ids decode to."""
    own = {
        "n_tokens": T.LongType(),
        "ids_sha256": T.StringType(),
        "decoded_sha256": T.StringType(),
    } | ({"ids": T.ArrayType(T.IntegerType())} if with_ids else {})
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in own])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in own.items()]])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path)
        for batch in batches:
            for a, b in W.blocks(batch.column(place), BLOCK_BYTES):
                columns = batch.slice(a, b - a).columns
                ids, offsets, said = words.encode(columns[place])
                back = words.decode(ids, offsets)
                columns[place] = pa.array([x.decode() for x in back], pa.string())
                columns += [
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)
