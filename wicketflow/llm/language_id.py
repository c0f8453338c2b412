"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces of the product of their probabilities, which the forward algorithm gives in one pass;
a text's score is the product over its words. Training is expectation-maximisation: the expected use of each piece in the
words of the training texts, which Spark counts, from the forward and backward sums of the pass before.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketflow.llm.common import python_ready, refuse_taken, sent, utf8

#: What is predicted for a text without letters.
UNDETERMINED = "und"
#: About so many training texts of each language are used, taken by hash (all, where there are fewer).
TEXTS_PER_LANGUAGE = 1000
ITERATIONS = 2
#: Added to each piece's expected use; the probability of a letter that is no piece.
SMOOTHING, UNKNOWN = 0.01, 1e-8
#: Words whose scores a worker keeps; more languages than this are refused.
KEPT, LANGUAGES = 100_000, 2000
START = "▁"
#: Words of up to so many letters need no scaling.
UNSCALED = 36
_BASE = np.uint64(0x9E3779B97F4A7C15)


_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased text's runs of letters."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # Python's word characters also hold numbers such as ² and Ⅳ, which are no letters
    return [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]


def read_pieces(path: str) -> list[str]:
    """The lower-case pieces of letters in a sentencepiece model, with or without a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in every if p == START or (body := p.removeprefix(START)) and body.isalpha() and p == p.lower()]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class Segmenter:
    """Forward and backward sums over all segmentations of words, for several languages at once.

    Pieces are found by a 64-bit rolling hash of their letters, for all words of one length at once.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.none, self.unknown = len(pieces), len(pieces) + 1
        hashes, by_length = np.zeros(len(pieces), np.uint64), defaultdict(list)
        for i, p in enumerate(pieces):
            by_length[len(p)].append(i)
        for n, own in by_length.items():
            for letters in _points("".join(pieces[i] for i in own)).reshape(len(own), n).T:
                hashes[own] = hashes[own] * _BASE + letters
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 20, bool)  # by the hash's upper bits: whether a piece may have it
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def table(self, p: np.ndarray) -> np.ndarray:
        """Piece probabilities (pieces, languages) with the rows for no piece and for an unknown letter."""
        return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNKNOWN)])

    def ids(self, words: list[str]) -> np.ndarray:
        """Of words of one length: [length - 1, end, word] -> the piece that ends there, or none."""
        b, n = len(words), len(words[0]) + 1
        out = np.full((min(n, self.longest), n, b), self.none, dtype=np.int32)
        letters = _points("".join(START + w for w in words)).reshape(b, n).T
        h = np.zeros((n, b), np.uint64)
        for k in range(len(out) if len(self.sorted) else 0):
            h = h[: n - k] * _BASE + letters[k:]
            start, word = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            found = h[start, word]
            at = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
            ok = self.sorted[at] == found
            out[k, start[ok] + k, word[ok]] = self.order[at[ok]]
        out[0][out[0] == self.none] = self.unknown
        return out

    def forward(self, ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[end + 1, word, language] in units of exp(scale[end + 1, word])."""
        longest, n, b = ids.shape
        alpha, scale = np.zeros((n + 1, b, p.shape[1])), np.zeros((n + 1, b))
        alpha[0] = 1
        for j in range(n):
            for k in range(min(j + 1, longest)):
                own = np.flatnonzero(ids[k, j] != self.none)
                if not len(own):
                    continue
                part = alpha[j - k, own] * p[ids[k, j, own]]
                if n > UNSCALED:  # units differ where a long word was rescaled in between
                    part *= np.exp(scale[j - k, own] - scale[j, own])[:, None]
                alpha[j + 1, own] += part
            if n > UNSCALED:  # shorter words, even of unknown letters alone, stay far above the smallest double
                top = alpha[j + 1].max(axis=1)
                alpha[j + 1] /= top[:, None]
                scale[j + 1] = scale[j] + np.log(top)
        return alpha, scale

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language, over all segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        for at, ids in self._by_length(words):
            alpha, scale = self.forward(ids, p)
            out[at] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected use of each piece in words that occur counts[word, language] times, in each language by itself."""
        used = np.zeros_like(p)
        for at, ids in self._by_length(words):
            n = counts[at]
            for lang in np.flatnonzero(n.any(axis=0)):
                own = np.flatnonzero(n[:, lang])
                x, q = ids[:, :, own], p[:, lang]
                alpha, up = self.forward(x, q[:, None])
                longest, length, _ = x.shape
                beta, down = np.zeros((length + 1, len(own))), np.zeros((length + 1, len(own)))
                beta[length] = 1
                for i in range(length - 1, -1, -1):
                    new = np.zeros(len(own))
                    for k in range(min(length - i, longest)):
                        new += beta[i + k + 1] * q[x[k, i + k]] * np.exp(down[i + k + 1] - down[i + 1])
                    beta[i], down[i] = 1, down[i + 1] + np.log(new)
                for k in range(longest):
                    ends = np.arange(k, length)
                    logs = up[ends - k] + down[ends + 1] - up[-1]
                    share = alpha[ends - k, :, 0] * beta[ends + 1] * q[x[k, ends]] * np.exp(logs) / alpha[-1, :, 0]
                    used[:, lang] += np.bincount(x[k, ends].ravel(), (share * n[own, lang]).ravel(), len(p))
        return used

    def _by_length(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        groups = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        for n, at in groups.items():
            step = max(1, 400_000 // ((n + 1) * min(n + 1, self.longest)))
            for k in range(0, len(at), step):
                yield at[k : k + step], self.ids([words[i] for i in at[k : k + step]])


@dataclass(eq=False)
class Model:
    """languages in order; p: piece probabilities (pieces, languages). Its size is vocabulary times languages."""

    pieces: list[str]
    languages: list[str]
    p: np.ndarray

    @cached_property
    def segmenter(self) -> Segmenter:
        """Made once in each worker that has the model."""
        return Segmenter(self.pieces)


def held_out(doc_id: Column) -> Column:
    """The documents that training leaves out: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, pieces: list[str], *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = TEXTS_PER_LANGUAGE, iterations: int = ITERATIONS
) -> Model:
    """Fits piece probabilities on docs with text and language. Rows where either is null are left out.

    The bounded sample is taken by a hash of text and, where docs has that column, doc_id: a text that many documents
    repeat is taken about as often as its share, and only rows that repeat both are taken or left together. More than
    LANGUAGES languages raise ValueError.
    """
    spark = docs.sparkSession
    python_ready(spark)
    key = F.col(f"`{doc_id}`").cast("string") if doc_id.lower() in {c.lower() for c in docs.columns} else F.lit("")
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), key.alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()  # a row a language
    if len(counts) > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values")
    sizes = {r["lang"]: r["n"] for r in counts}
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces), 0)))
    span = 1 << 30
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(span, span * per_language // n))) for x, n in sizes.items()])
    some = rows.where(F.pmod(F.xxhash64(utf8(F.col("text")), "key"), F.lit(span)) < share).select("text", "lang")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((x, w) for w in words_of(t))
            langs, found = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    counted = some.mapInArrow(words, "lang string, word string, n long").groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by")).checkpoint()
    at = {x: i for i, x in enumerate(languages)}
    p = np.tile(np.array([[10.0 ** -len(x)] for x in pieces]), (1, len(languages)))
    for _ in range(iterations):
        known = spark.sparkContext.broadcast(p / p.sum(axis=0))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seg = Segmenter(pieces)
            table = seg.table(known.value)
            used = np.zeros_like(table)
            for batch in batches:
                found, by = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                counts = np.zeros((len(found), len(at)))
                for i, own in enumerate(by):
                    for x in own:
                        counts[i, at[x["lang"]]] += x["n"]
                used += seg.expected(found, counts, table)
            i, k = np.nonzero(used[: len(pieces)])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(used[i, k])], names=["piece", "lang", "used"])

        p = np.full((len(pieces), len(languages)), SMOOTHING)
        for r in counted.mapInArrow(expect, "piece int, lang int, used double").groupBy("piece", "lang").agg(F.sum("used").alias("used")).toLocalIterator():
            p[r["piece"], r["lang"]] += r["used"]  # at most vocabulary times languages rows
        known.destroy()
    return Model(pieces, languages, p / p.sum(axis=0))


def identify(df: DataFrame, model: Model, text: str = "text", *, into: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the most probable language of each whole text and its posterior probability under equal priors.

    A null text, and one without letters, is ``und`` with score 0; so is every text where the model has no language.
    Ties go to the language first in order. Only the text is looked at. Raises ValueError if df has into or score.
    """
    refuse_taken(df, into, score)
    spark = df.sparkSession
    python_ready(spark)
    shared = sent(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seg, languages = m.segmenter, len(m.languages)
        table, kept, known = seg.table(m.p), {}, np.empty((KEPT, languages))
        for batch in batches:
            found = [words_of(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            new = {w for own in found for w in own}.difference(kept)
            if len(kept) + len(new) > len(known):  # the table starts anew, with the words of this batch
                kept, new = {}, {w for own in found for w in own}
                known = np.empty((max(KEPT, len(new)), languages))
            new = list(new)
            known[len(kept) : len(kept) + len(new)] = seg.scores(new, table)
            kept.update(zip(new, range(len(kept), len(kept) + len(new))))
            ends = np.cumsum([0, *map(len, found)])
            each = known[np.fromiter((kept[w] for own in found for w in own), np.int64, ends[-1])]
            langs, scores = [], []
            for i, j in zip(ends, ends[1:]):
                if i == j or not languages:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = each[i:j].sum(axis=0)
                best = int(total.argmax())
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, into, score])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType(), False), T.StructField(score, T.DoubleType(), False)]))

