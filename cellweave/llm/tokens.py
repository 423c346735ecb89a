"""Encoding of whole corpora with a public byte-level BPE vocabulary by speculation and verification.

A batch of texts is one array of bytes. Its words (the vocabulary's splitting pattern) are found from character classes, then every word
is cut greedily into the longest entries of the vocabulary, all words at once. The cut is the true encoding exactly if each pair of
neighbours is compatible, that is, if merging the two alone would not cross their border; a vectorised check finds the words with a
pair that isn't, and only those are merged step by step. Everything happens on Arrow buffers inside tasks.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary of p7_ids.
DEFAULT_VOCABULARY = os.environ.get("CELLWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 21
#: Bytes of a word from which it is merged alone.
LONG = 256
SPACE, LETTER, NUMBER, OTHER, BORDER = 0, 1, 2, 3, 4
#: Characters of the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BIG = np.int32(2**31 - 1)


class Vocabulary:
    """A rank file as arrays: a trie of the entries and, per entry, the two entries that it is merged from."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.byte_token = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.left = np.full(self.size, -1, np.int32)
        self.right = np.full(self.size, -1, np.int32)
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for entry, rank in ranks.items():
            at = 0
            for byte in entry:
                following = nodes.get((at, byte))
                if following is None:
                    following = nodes[(at, byte)] = len(token)
                    token.append(-1)
                at = following
            token[at] = rank
            if len(entry) > 1:
                a, b = self._last_merge(entry, rank, ranks)
                self.left[rank], self.right[rank] = ranks[a], ranks[b]
        self.token = np.array(token, np.int32)
        self.edges = np.array([(a << 8) | b for a, b in nodes], np.int64)
        self.ends = np.array(list(nodes.values()), np.int32)
        classes = bytearray(0x110000)
        kinds = {"L": LETTER, "N": NUMBER}
        for cp in range(0x110000):
            classes[cp] = kinds.get(unicodedata.category(chr(cp))[0], OTHER)
        for cp in WHITE:
            classes[cp] = SPACE
        self.classes = bytes(classes)

    @staticmethod
    def _last_merge(entry: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
        parts = [entry[i : i + 1] for i in range(len(entry))]
        while len(parts) > 2:
            found = min((ranks.get(parts[i] + parts[i + 1], _BIG), i) for i in range(len(parts) - 1))
            if found[0] >= rank:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], b"".join(parts[1:])


class Encoder:
    """What a task holds of a vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.classes = np.frombuffer(v.classes, np.uint8)
        self.byte_class = np.full(256, BORDER, np.uint8)
        self.byte_class[:128] = self.classes[:128]
        self.trie = np.zeros((len(v.token), 256), np.int32)
        self.trie.reshape(-1)[v.edges] = v.ends
        self.flat = self.trie.reshape(-1)
        merged = np.flatnonzero(v.left >= 0)
        keys = v.left[merged].astype(np.int64) * v.size + v.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_tokens = keys[order], merged[order].astype(np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.pair_keys)] = True
        self.first = np.where(v.left >= 0, v.left, np.arange(v.size, dtype=np.int32)).astype(np.int32)
        self.second = np.where(v.right >= 0, v.right, np.arange(v.size, dtype=np.int32)).astype(np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry that a and b merge to, or _BIG."""
        keys = a.astype(np.int64) * self.v.size + b
        out = np.full(keys.shape, _BIG, np.int32)
        hit = np.flatnonzero(self.maybe[self._slot(keys.reshape(-1))])
        k = keys.reshape(-1)[hit]
        at = np.minimum(np.searchsorted(self.pair_keys, k), len(self.pair_keys) - 1)
        same = self.pair_keys[at] == k
        out.reshape(-1)[hit[same]] = self.pair_tokens[at[same]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's and b's bytes together is a, b. The later merge of the two is undone again and again; at
        each border pair that appears, a merge that would have come before the one undone last breaks it."""
        n = len(a)
        good = np.zeros(n, bool)
        at, a, b = np.arange(n), a.copy(), b.copy()
        limit = np.full(n, _BIG, np.int32)
        while len(at):
            crossing = self.merge(a, b) < limit
            if crossing.any():
                keep = ~crossing
                at, a, b, limit = at[keep], a[keep], b[keep], limit[keep]
            inner_a, inner_b = self.second[a], self.first[b]
            can_a, can_b = inner_a != a, inner_b != b
            # undo the left one if it was merged later, the right one otherwise; bytes can't be undone
            take_a = can_a & ((a > b) | ~can_b)
            take_b = can_b & ~take_a
            done = ~(take_a | take_b)
            good[at[done]] = True
            limit = np.where(take_a, a, b + 1).astype(np.int32)
            a, b = np.where(take_a, inner_a, a), np.where(take_b, inner_b, b)
            if done.any():
                keep = ~done
                at, a, b, limit = at[keep], a[keep], b[keep], limit[keep]
        return good

    def word_starts(self, b: np.ndarray) -> np.ndarray:
        """Mask of the bytes at which a word or border begins. b: texts in UTF-8 with a byte 255 after each."""
        n = len(b)
        cls = self.byte_class[b]
        lead = np.flatnonzero((b >= 0xC0) & (b != 0xFF))
        if len(lead):
            x = b[lead].astype(np.int32)
            c1 = b[lead + 1].astype(np.int32) & 0x3F
            c2 = b[np.minimum(lead + 2, n - 1)].astype(np.int32) & 0x3F
            c3 = b[np.minimum(lead + 3, n - 1)].astype(np.int32) & 0x3F
            cp = np.where(x < 0xE0, ((x & 0x1F) << 6) | c1, np.where(x < 0xF0, ((x & 0xF) << 12) | (c1 << 6) | c2, ((x & 7) << 18) | (c1 << 12) | (c2 << 6) | c3))
            kind = self.classes[cp]
            cls[lead] = kind
            cls[lead + 1] = kind
            three, four = x >= 0xE0, x >= 0xF0
            cls[lead[three] + 2] = kind[three]
            cls[lead[four] + 3] = kind[four]
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(cls[1:], cls[:-1], out=change[1:])
        after_blank = np.zeros(n, bool)
        after_blank[1:] = b[:-1] == 32
        start = change & ((cls == SPACE) | ~after_blank) | (b == 0xFF)
        # the last white character before a word is a start of its own
        ends = np.flatnonzero(change[1:] & (cls[:-1] == SPACE) & (cls[1:] != BORDER))
        while len(ends):
            inner = (b[ends] & 0xC0) == 0x80
            start[ends[~inner]] = True
            ends = ends[inner] - 1
        quote = np.flatnonzero((b == 39) & change & ~after_blank)
        quote = quote[quote + 1 < n]
        quote = quote[cls[quote + 1] == LETTER]
        if len(quote):
            x = b[quote + 1]
            y = b[np.minimum(quote + 2, n - 1)]
            one = (x == 115) | (x == 116) | (x == 109) | (x == 100)
            two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
            start[quote[one | two] + 1] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
        return start

    def encode(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, ids): where in b each token begins, and the token. b as in word_starts."""
        n = len(b)
        start = self.word_starts(b)
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        text = b[s] != 0xFF
        s, e = s[text], e[text]
        tokens = np.full(n, -1, np.int32)
        b32 = b.astype(np.int32)
        pos, end = s, e
        while len(pos):
            best, length = self._longest(b32, pos, end)
            tokens[pos] = best
            pos = pos + length
            more = pos < end
            pos, end = pos[more], end[more]
        places = np.flatnonzero(tokens >= 0)
        ids = tokens[places]
        inner = np.flatnonzero(~start[places[1:]] if len(places) else np.zeros(0, bool))
        # a pair's border lies inside a word
        bad = inner[~self.compatible(ids[inner], ids[inner + 1])] if len(inner) else inner
        if len(bad):
            word = np.unique(np.searchsorted(s, places[bad], side="right") - 1)
            self._remerge(b, s[word], e[word], tokens)
            places = np.flatnonzero(tokens >= 0)
            ids = tokens[places]
        return places, ids

    def _longest(self, b32: np.ndarray, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros(len(pos), np.int32)
        length = np.zeros(len(pos), np.int64)
        at = np.arange(len(pos))
        state = np.zeros(len(pos), np.int32)
        p, stop, k = pos, end, 0
        while len(at):
            state = self.flat[(state << 8) | b32[p]]
            token = self.v.token[state]
            k += 1
            hit = token >= 0
            if hit.all():
                best[at], length[at] = token, k
            else:
                best[at[hit]], length[at[hit]] = token[hit], k
            p = p + 1
            alive = np.flatnonzero((state > 0) & (p < stop))
            at, state, p, stop = at[alive], state[alive], p[alive], stop[alive]
        return best, length

    def _remerge(self, b: np.ndarray, s: np.ndarray, e: np.ndarray, tokens: np.ndarray) -> None:
        """Exact merging of words, each different one once, those of about a length together."""
        sizes = e - s
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        s = s[order]
        at = 0
        while at < len(s):
            width = int(sizes[at])
            upper = int(np.searchsorted(sizes, max(width + width // 8, 8), side="right"))
            upper = min(upper, at + max(1, (1 << 23) // max(int(sizes[upper - 1]), 1)))
            own, starts = sizes[at:upper], s[at:upper]
            at = upper
            w = int(own[-1])
            if w > LONG:
                for i, n in zip(starts, own):
                    tokens[i : i + n] = self._merged_word(b[i : i + n])
                continue
            inside = np.arange(w) < own[:, None]
            flat = starts[:, None] + np.arange(w)
            raw = np.where(inside, b[np.minimum(flat, len(b) - 1)], 0).astype(np.uint8)
            # the border byte 255 is in no word, so it may tell padding from bytes
            raw[~inside] = 0xFF
            one, back = np.unique(np.ascontiguousarray(raw).view(np.dtype((np.void, w))).ravel(), return_inverse=True)
            found = self._merged(one.view(np.uint8).reshape(len(one), w))[back]
            tokens[flat[inside]] = -1
            ok = found >= 0
            tokens[flat[ok]] = found[ok]

    def _merged_word(self, raw: np.ndarray) -> np.ndarray:
        """One long word to its tokens at the places of their first bytes, -1 elsewhere, with a heap of the pairs that can merge."""
        n = len(raw)
        pairs = self.pairs
        ids = self.v.byte_token[raw].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(t, i) for i in range(n - 1) if (t := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            t, i = heapq.heappop(heap)
            j = after[i]
            # a pair of which either side has merged since is no longer there
            if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != t:
                continue
            ids[i], ids[j], after[i] = t, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (u := pairs.get((t, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (u, i))
            if before[i] >= 0 and (u := pairs.get((ids[before[i]], t))) is not None:
                heapq.heappush(heap, (u, before[i]))
        return np.array(ids, np.int32)

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {(a, b): t for a, b, t in zip((self.pair_keys // self.v.size).tolist(), (self.pair_keys % self.v.size).tolist(), self.pair_tokens.tolist())}

    def _merged(self, raw: np.ndarray) -> np.ndarray:
        """Words as rows of bytes, padded with 255, to rows with each token at the place of its first byte and -1 elsewhere."""
        n, w = raw.shape
        out = np.full((n, w), -1, np.int32)
        m = np.where(raw == 0xFF, -1, self.v.byte_token[raw]).astype(np.int32)
        where = np.broadcast_to(np.arange(w), (n, w)).copy()
        pairs = np.full((n, w), _BIG, np.int32)
        pairs[:, :-1] = self._pair(m[:, :-1], m[:, 1:])
        live = np.arange(n)
        columns = np.arange(w)
        while len(live):
            r = np.arange(len(live))
            j = pairs.argmin(1)
            low = pairs[r, j]
            stop = low == _BIG
            if stop.any():
                rows, cols = np.nonzero(m[stop] >= 0)
                out[live[stop][rows], where[stop][rows, cols]] = m[stop][rows, cols]
                go = ~stop
                live, m, where, pairs, j, low = live[go], m[go], where[go], pairs[go], j[go], low[go]
                if not len(live):
                    break
                r = np.arange(len(live))
            # close the gap behind the merged pair; a row's last column falls free
            take = np.minimum(columns + (columns > j[:, None]), w - 1) + (r * w)[:, None]
            m[r, j] = low
            m, where, pairs = m.reshape(-1)[take], where.reshape(-1)[take], pairs.reshape(-1)[take]
            m[:, -1], pairs[:, -1] = -1, _BIG
            following = np.where(j + 1 < w, m[r, np.minimum(j + 1, w - 1)], -1)
            pairs[r, j] = self._pair(low, following)
            some = np.flatnonzero(j > 0)
            pairs[some, j[some] - 1] = self._pair(m[some, j[some] - 1], low[some])
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.merge(np.maximum(a, 0), np.maximum(b, 0))
        out[(a < 0) | (b < 0)] = _BIG
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary, made once per Python worker."""
    v = shared.value
    key = id(v)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def encode_strings(enc: Encoder, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, token counts per row, ids) for runs of rows of about CHUNK bytes; NULL counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
        upto = min(max(upto, row + 1), len(texts))
        own = offsets[row : upto + 1] - offsets[row]
        b = np.full(int(own[-1]) + upto - row, 0xFF, np.uint8)
        sizes = np.diff(own)
        shift = np.repeat(np.arange(upto - row), sizes)
        b[np.arange(own[-1]) + shift] = data[offsets[row] : offsets[upto]]
        places, ids = enc.encode(b)
        bounds = own + np.arange(upto - row + 1)
        counts = np.diff(np.searchsorted(places, bounds))
        yield upto - row, counts, ids
        row = upto


def _shared(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): each text as its list of token ids, without special tokens; strings that look like special tokens are ordinary
    text. NULL and empty texts give an empty list. Repeated rows are kept. The vocabulary's size is fixed by its file: it is shared with
    the tasks as arrays of about 3 MB, of which each worker makes a table of some 100 MB."""
    shared = _shared(df, vocabulary)

    def run(batches):
        enc = encoder_of(shared)
        for batch in batches:
            keys = batch.column(0)
            at = 0
            for rows, counts, ids in encode_strings(enc, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, rows), lists], names=[key, "ids"])
                at += rows

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df without `text`, with `out`, the number of tokens of the text, in place of a column of that name; 0 for a NULL or empty one."""
    shared = _shared(df, vocabulary)
    others = [c for c in df.columns if c not in (text, out)]

    def run(batches):
        enc = encoder_of(shared)
        for batch in batches:
            counts = [np.zeros(0, np.int64), *(c for _, c, _ in encode_strings(enc, batch.column(len(others))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(counts), pa.int64())], names=[*others, out])

    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.LongType())])
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(text)).mapInArrow(run, schema)
