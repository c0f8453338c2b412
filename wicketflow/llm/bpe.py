"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that never occurs inside any token of the vocabulary can't be joined by any merge, so it marks a certain cut:
the fragments between cuts are encoded one by one and their ids concatenated. The pre-tokenizer's cuts come first (they
are cuts that the tokenizer makes before any merge); each piece is then split at its forced boundaries, so that a piece
of any length is merged in short fragments. Pieces repeat, so each worker keeps a bounded table of those it has encoded;
the pieces of a batch that are new are cut and merged together, in arrays, so that a rare piece costs little more than a
frequent one.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketflow.llm.common import python_ready, refuse_taken, sent

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary. \p{White_Space}: what \s means there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces that a worker keeps encoded.
KEPT = 100_000
#: Pieces, and fragments, that are encoded at a time: bounds the arrays.
PIECES, FRAGMENTS = 1 << 16, 1 << 13
#: Longest fragments merged in one table each; what is longer is merged by itself.
WIDTHS = (4, 8, 16, 32)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


#: Characters that the regex module counts as letters or numbers and the tokenizers library doesn't (its
#: Unicode tables are older), as ranges of code points.
UNASSIGNED = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1"
    " 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6"
    " 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_RARE = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in UNASSIGNED.split()) + "]")


def pieces_of(pattern: regex.Pattern, text: str) -> list[str]:
    """What pattern finds in text, with the tokenizers library's letters and numbers."""
    if text.isascii() or not _RARE.search(text):
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(_RARE.sub("†", text))]  # a sign, for that library, like the others


class Merges:
    """Pairs of symbol numbers -> rank, rank -> the joined symbol's number, and merging by them."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.never = len(pairs)
        self.none = 1 + max(vocab.values())  # no symbol: stands in no pair
        keys = np.array([self._key(a, b) for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._ranks = np.append(np.fromiter(self.rank.values(), np.int32)[order], np.int32(self.never))

    def _key(self, a, b):
        return a * (self.none + 1) + b

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, never where it's no merge."""
        keys = self._key(a.astype(np.int64), b)
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._ranks[at], np.int32(self.never))

    def join(self, symbols: np.ndarray, ranks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """symbols after all merges within each fragment, lowest rank first, leftmost among equals; -1 for those that were joined to the one before.

        ranks: of each symbol's pair with the next one. A fragment is sizes[k] symbols from starts[k] on.
        """
        out = symbols.copy()
        least = 2  # one symbol alone has no pair
        for width in WIDTHS:
            of_width = np.flatnonzero((least <= sizes) & (sizes <= width))
            for k in range(0, len(of_width), FRAGMENTS):
                some = of_width[k : k + FRAGMENTS]
                self._join_short(out, ranks, starts[some], sizes[some], width)
            least = width + 1
        for k in np.flatnonzero(sizes >= least).tolist():
            i, n = int(starts[k]), int(sizes[k])
            ids = self._join_long(symbols[i : i + n].tolist())
            out[i : i + len(ids)], out[i + len(ids) : i + n] = ids, -1
        return out

    def _join_short(self, out: np.ndarray, ranks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> None:
        """A row a fragment, with a place at either end for no symbol; each round makes the first merge of every row that has one."""
        n, across, never = len(starts), width + 2, np.int32(self.never)
        column = np.arange(width)
        places, taken, paired = starts[:, None] + column, column < sizes[:, None], column < sizes[:, None] - 1
        symbol, rank = np.full((n, across), self.none, np.int32), np.full((n, across), never, np.int32)
        symbol[:, 1:-1][taken] = out[places[taken]]
        rank[:, 1:-1][paired] = ranks[places[paired]]
        s, r = symbol.reshape(-1), rank.reshape(-1)
        before, after = np.arange(-1, n * across - 1, dtype=np.int32), np.arange(1, n * across + 1, dtype=np.int32)
        rows = np.arange(n)
        while len(rows):
            at = rows * across + rank[rows].argmin(axis=1)
            best = r[at]
            going = best < never
            rows, at, best = rows[going], at[going], best[going]
            other = after[at]
            following, preceding = after[other], before[at]
            s[at], s[other] = self.joined[best], -1
            r[other] = never
            after[at], before[following] = following, at
            r[at] = self.ranks(s[at], s[following])
            r[preceding] = self.ranks(s[preceding], s[at])
        out[places[taken]] = symbol[:, 1:-1][taken]

    def _join_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap and links, O(n log n)."""
        n, rank = len(symbols), self.rank
        left, right, s = list(range(-1, n - 1)), [*range(1, n), -1], symbols[:]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(s, s[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (s[i], s[j]) != pair:
                continue
            s[i], s[j] = int(self.joined[r]), -1
            right[i], right[j] = right[j], -1
            if (k := right[i]) >= 0:
                left[k] = i
            for at in (left[i], i):
                if at >= 0 and right[at] >= 0 and (p := (s[at], s[right[at]])) in rank:
                    heapq.heappush(heap, (rank[p], at, p))
        return [x for x in s if x >= 0]


class ByteBpe:
    """A byte-level vocabulary read from a tokenizer's JSON."""

    def __init__(self, spec: bytes) -> None:
        j = json.loads(spec)
        vocab, letters = j["model"]["vocab"], byte_letters()
        code = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.merges = Merges(vocab, j["model"]["merges"])
        self.first = [vocab[c] for c in letters]
        self._first = np.array(self.first, np.int32)
        self.ranks = self.merges.ranks(np.repeat(self._first, 256), np.tile(self._first, 256))  # at 256 a + b: of bytes a, b
        self.bytes = [b""] * (1 + max([*vocab.values(), *added.values()]))
        inside = self.inside = np.zeros(1 << 16, bool)  # at 256 a + b: whether bytes a, b occur so in some token
        for token, i in vocab.items():
            self.bytes[i] = raw = bytes(code[c] for c in token)
            for a, b in zip(raw, raw[1:]):
                inside[a << 8 | b] = True
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = {t: np.int32(i).tobytes() for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN)
        self.kept = dict(self.added)  # piece -> ids; a piece is never an added token's string, since those are cut out first

    def encode(self, text: str) -> bytes:
        """Ids as int32."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32."""
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
            kept.update(self.added)
        found = [self._pieces(t) for t in texts]
        new = list(set().union(*found).difference(kept))
        for k in range(0, len(new), PIECES):
            some = new[k : k + PIECES]
            kept.update(zip(some, self._encoded(some)))
        ids = [b"".join(map(kept.__getitem__, f)) for f in found]
        for piece in new:
            if len(piece) > 64:  # longer pieces hardly repeat
                del kept[piece]
        return ids

    def _pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces, with the added tokens' strings between them."""
        if self.special is None or not self.special.search(text):
            return pieces_of(self.pieces, text)
        return [x for k, p in enumerate(self.special.split(text)) for x in ([p] if k % 2 else pieces_of(self.pieces, p))]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: cut wherever two neighbouring bytes occur inside no token, the fragments merged."""
        raw = [p.encode("utf-8") for p in pieces]
        ends = np.cumsum([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        pairs = flat[:-1].astype(np.uint16) << 8 | flat[1:]
        cut = np.ones(len(flat) + 1, bool)
        cut[1:-1] = ~self.inside[pairs]
        cut[ends] = True
        bounds = np.flatnonzero(cut)
        symbols = self.merges.join(self._first[flat], self.ranks[pairs], bounds[:-1], np.diff(bounds))
        there = symbols >= 0
        ids = symbols[there].tobytes()
        at = (4 * np.cumsum(there)[ends - 1]).tolist()
        return [ids[i:j] for i, j in zip([0, *at], at)]

    def decode(self, ids: list[int]) -> str:
        """Unknown ids give no text; bytes that aren't UTF-8 give U+FFFD."""
        n = len(self.bytes)
        return b"".join(self.bytes[i] for i in ids if 0 <= i < n).decode("utf-8", "replace")


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's bytes (about 1.5 MB, independent of the data) for all executors."""
    with open(path, "rb") as f:
        return sent(spark, f.read())


@lru_cache(maxsize=2)
def _model(spec: bytes) -> ByteBpe:
    """One for each worker process, kept between tasks."""
    return ByteBpe(spec)


def encode(df: DataFrame, vocab: Broadcast, text: str = "text", *, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with ids: the token ids of the whole text, special tokens' strings inside texts as their ids, none added.

    decoded: a column for the text that the ids decode to, made in the same pass. A null text counts as empty and gets
    no ids. Other columns stay as they are; raises ValueError if df has ids or decoded, in whatever case.
    """
    refuse_taken(df, ids, decoded)
    python_ready(df.sparkSession)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(vocab.value)
        for batch in batches:
            k = batch.schema.get_field_index(text)
            raw = bpe.encode_all([t or "" for t in batch.column(k).to_pylist()])
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64)
            flat = np.frombuffer(b"".join(raw), dtype=np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
            if decoded:
                out.append(pa.array([bpe.decode(flat[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode(df: DataFrame, vocab: Broadcast, ids: str = "ids", *, decoded: str = "decoded") -> DataFrame:
    """df with decoded: the text that ids stand for, special tokens included; null ids give null."""
    refuse_taken(df, decoded)
    python_ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(vocab.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else bpe.decode([i for i in x if i is not None]) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType(), True)]))


def digest(ids: str) -> F.Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


