"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol a byte, the last one marked as the word's end. The heap gives the adjacent pair of the lowest
rank (the leftmost among equals); joining it relinks its neighbours and pushes their new pairs. The count is the number
of initial symbols minus the number of merges; no ids are made. Words repeat, so a worker keeps a bounded table of counts.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wicketflow.llm.bpe import byte_letters, pieces_of
from wicketflow.llm.common import python_ready, refuse_taken

#: Fixed value: the word pattern of the vocabulary with word ends. \p{White_Space}: what \s means there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Capitals, as code points, whose small letters the tokenizers library knows and Python doesn't.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS = re.compile(f"[{''.join(map(chr, LOWER))}]")
#: Words whose counts a worker keeps.
KEPT = 200_000


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizer's JSON."""

    def __init__(self, spec: bytes) -> None:
        j = json.loads(spec)
        vocab, letters, end = j["model"]["vocab"], byte_letters(), j["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.of = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        added = sorted((t["content"] for t in j["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words = regex.compile(PATTERN)
        self.kept = _Kept(self)

    def merged(self, word: bytes) -> int:
        """Symbols of a word after all merges."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        n, merges, of = len(symbols), 0, self.of
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*of[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in of]
        heapq.heapify(heap)
        while heap:
            _, joined, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (symbols[i], symbols[j]) != pair:
                continue  # one of the two has been joined with another
            merges += 1
            symbols[i], symbols[j] = joined, -1
            after[i], after[j] = after[j], -1
            if (k := after[i]) >= 0:
                before[k] = i
                if hit := of.get(p := (joined, symbols[k])):
                    heapq.heappush(heap, (*hit, i, p))
            if (h := before[i]) >= 0 and (hit := of.get(p := (symbols[h], joined))):
                heapq.heappush(heap, (*hit, h, p))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special token's string counts as one."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        if self.special is None or not (found := len(self.special.findall(text))):
            return self._plain(text)
        return found + sum(map(self._plain, self.special.split(text)))

    def _plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        # letter by letter: str.lower() alone gives a sigma at a word's end another form
        text = text.replace("Σ", "σ").lower()
        if not text.isascii() and _CAPITALS.search(text):
            text = text.translate(LOWER)
        return sum(map(self.kept.__getitem__, pieces_of(self.words, text)))


class _Kept(dict):
    """word -> count, filled as words come."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        n = self.bpe.merged(word.encode("utf-8"))
        if len(word) <= 64:  # longer words hardly repeat
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _model(spec: bytes) -> WordBpe:
    """One for each worker process, kept between tasks."""
    return WordBpe(spec)


def count_tokens(df: DataFrame, vocab: Broadcast, text: str = "text", *, into: str = "n_tokens") -> DataFrame:
    """df with into: the number of tokens of the whole text, nothing added or cut off; a null or empty text has none.

    Rows that repeat are all counted. Raises ValueError if df has into, in whatever case.
    """
    refuse_taken(df, into)
    python_ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(vocab.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            counts = pa.array([bpe.count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.LongType(), False)]))
