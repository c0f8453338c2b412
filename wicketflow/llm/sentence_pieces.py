"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

Every prefix of a text has one encoding, so one last token. The tokens that end at a letter are the matches of an automaton
over the vocabulary; the one that is the prefix's last token is the one that is compatible with the last token of the
prefix before it, i.e. that merging the two tokens' letters gives just these two (a sequence is an encoding if and only if
all its neighbours are compatible). The table takes one step a letter, whatever the text; the ids are read from its end.

A text is cut before a space sign that follows another letter, if no token holds such a pair, and again wherever no token
holds the two neighbouring letters: nothing can be merged across. The pieces repeat, so a worker keeps a bounded table of
those it has encoded.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wicketflow.llm.bpe import vocabulary
from wicketflow.llm.common import python_ready, refuse_taken

__all__ = ["Pieces", "decode", "encode", "vocabulary"]

SPACE = "▁"
#: Fixed value: what the library gives for the unknown id when it decodes.
UNKNOWN_TEXT = " ⁇ "
#: Marks that often follow words.
MARKS = ",.!?;:%*&$\n"
#: Pieces that a worker keeps encoded (twice: those of late, and those before), and pairs of tokens that it keeps tested.
KEPT, PAIRS = 300_000, 400_000

codecs.register_error("piece-bytes", lambda e: ("�" * (e.end - e.start), e.end))  # one sign for each byte that is no UTF-8


class Pieces:
    """A sentencepiece model of type BPE, without normalisation rules."""

    def __init__(self, spec: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(spec)
        rules = model.normalizer_spec
        kinds = pb.ModelProto.SentencePiece.Type
        if model.trainer_spec.model_type != pb.TrainerSpec.ModelType.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("not a BPE model whose only normalisation is the space sign")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        self.start = SPACE if rules.add_dummy_prefix else ""
        self.texts = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_of = {i: int(p.piece[3:-1], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = {b: i for i, b in self.byte_of.items()} if model.trainer_spec.byte_fallback else {}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.control = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.begin, self.end = self.control.get(model.trainer_spec.bos_piece), self.control.get(model.trainer_spec.eos_piece)
        silent = set(self.control.values())
        self.shown = ["" if i in silent else UNKNOWN_TEXT if i == self.unknown else t.replace(SPACE, " ") for i, t in enumerate(self.texts)]
        self.packed = {t: np.int32(i).tobytes() for t, i in self.id_of.items()}
        self.inside = {(a, b) for t in self.id_of for a, b in zip(t, t[1:])}
        self.edges: dict[str, tuple[set[str], set[str]]] = {}
        self.automaton, self.tested = ahocorasick.Automaton(), 0
        for token in self.id_of:
            if len(token) > 1 and self.merged(token, self.edges.setdefault(token, ({token[0]}, {token[-1]}))) == [token]:  # a token that its own letters don't merge to is never the last of a prefix
                self.automaton.add_word(token, (token, len(token), {}))  # {}: tokens before it -> whether they are compatible
        self.automaton.make_automaton()
        self.cut = self._cuts()
        self.kept = _Kept(self)

    def _cuts(self) -> re.Pattern | None:
        """Finds the pieces of a text between sure cuts: before a space sign, and before a mark, if no token holds the letter there and it.

        Other sure cuts would make the pattern slow; pieces that are new are cut there too.
        """
        if any(a != SPACE and b == SPACE for a, b in self.inside):
            return None
        joined = {c: "".join(re.escape(a) for a, b in sorted(self.inside) if b == c) for c in MARKS}
        marks = "".join(map(re.escape, MARKS))
        more = "|".join(f"(?<=[{a}]){re.escape(c)}" for c, a in joined.items() if a)
        return re.compile(f"{SPACE}*(?:[{marks}]|[^{SPACE}{marks}])[^{SPACE}{marks}]*" + (f"(?:(?=[{marks}])(?:{more})[^{SPACE}{marks}]*)*" if more else "") + f"|{SPACE}+")

    def merged(self, letters: str, edges: tuple[set[str], set[str]] | None = None) -> list[str]:
        """What letters merge to: again and again the neighbours whose joined piece has the highest score, leftmost among equals.

        edges: gets what stood first, and what stood last, in the course of it.
        """
        parts, score = list(letters), self.score
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap = [(-score[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if edges is not None:
                if before[i] < 0:
                    edges[0].add(joined)
                if after[i] < 0:
                    edges[1].add(joined)
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (more := parts[k] + parts[after[k]]) in score:
                    heapq.heappush(heap, (-score[more], k, more))
        return [p for p in parts if p]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their letters are merged.

        What may be joined across their border are symbols that stand at it in the course of their own merges: if no two of
        them make a piece, the answer is yes; else the letters are merged.
        """
        lefts, rights = self.edges[a][1] if a in self.edges else (a,), self.edges[b][0] if b in self.edges else (b,)
        if not any(x + y in self.score for x in lefts for y in rights):
            return True
        return self.merged(a + b) == [a, b]

    def tokens(self, letters: str) -> list[str]:
        """The encoding of letters, single letters that are no tokens included."""
        last = list(letters)  # by a prefix's last letter; that letter alone, unless a longer token is found
        for i, (token, size, known) in self.automaton.iter(letters):
            if len(last[i]) == 1:  # else found already: the automaton gives the longest first, and only one is right
                k = i - size
                if k < 0:
                    last[i] = token
                    continue
                fits = known.get(last[k])
                if fits is None:
                    fits = known[last[k]] = self.compatible(last[k], token)
                    self.tested += 1
                if fits:
                    last[i] = token
        out, i = [], len(letters) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def ids(self, letters: str) -> bytes:
        if self.tested > PAIRS:
            self.tested = 0
            for _, _, known in self.automaton.values():
                known.clear()
        tokens, packed = self.tokens(letters), self.packed
        try:
            return b"".join([packed[t] for t in tokens])
        except KeyError:
            return b"".join([packed[t] if t in packed else self._spelt(t) for t in tokens])

    def _spelt(self, letter: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in letter.encode()] if self.byte_ids else [self.unknown]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as int32, without begin and end."""
        if not text:
            return b""
        letters = self.start + text.replace(" ", SPACE)
        if self.cut is None:
            return self.ids(letters)
        self.kept.renew()
        return b"".join(map(self.kept.__getitem__, self.cut.findall(letters)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; begin, end and other control ids give nothing, ids outside the vocabulary neither."""
        shown, n, out, raw, first = self.shown, len(self.shown), [], bytearray(), bool(self.start)
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "piece-bytes"))
                raw.clear()
                first = False
            if 0 <= i < n and (t := shown[i]):
                out.append(t[1:] if first and t[0] == " " and i != self.unknown else t)
                first = False
        if raw:
            out.append(raw.decode("utf-8", "piece-bytes"))
        return "".join(out)


class _Kept(dict):
    """piece -> ids, filled as pieces come; pieces not met since the last but one renewal are forgotten."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.old = pieces, {}

    def __missing__(self, piece: str) -> bytes:
        own = self.old.get(piece)
        if own is None:
            inside = self.pieces.inside
            cuts = [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in inside]
            own = b"".join([self[piece[i:j]] for i, j in zip([0, *cuts], [*cuts, len(piece)])]) if cuts else self.pieces.ids(piece)
        if len(piece) <= 64:  # longer pieces hardly repeat
            self[piece] = own
        return own

    def renew(self) -> None:
        if len(self) > KEPT:
            self.old = {**self}
            self.clear()


@lru_cache(maxsize=2)
def _model(spec: bytes) -> Pieces:
    """One for each worker process, kept between tasks."""
    return Pieces(spec)


def encode(df: DataFrame, vocab: Broadcast, text: str = "text", *, ids: str = "ids", packed: bool = False, decoded: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """df with ids: the token ids of the whole text, with the model's begin and end ids if asked for.

    packed: ids are binary, little-endian unsigned 32-bit, rather than an array. decoded: a column for the text that the ids
    decode to, made in the same pass (a text's own space signs come back as spaces). A null text counts as empty, which has
    no ids but begin and end. The strings of control tokens inside texts are ordinary letters; letters outside the
    vocabulary become their bytes. Other columns stay as they are; raises ValueError if df has ids or decoded, in whatever
    case, or if begin or end is asked of a model that has none.
    """
    refuse_taken(df, ids, decoded)
    python_ready(df.sparkSession)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    fields = [T.StructField(ids, kind, False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(vocab.value)
        if begin and pieces.begin is None or end and pieces.end is None:
            raise ValueError("the model has no begin or end id")
        head, tail = (np.array([i], "<i4").tobytes() if wanted else b"" for wanted, i in ((begin, pieces.begin), (end, pieces.end)))
        for batch in batches:
            raw = [head + (pieces.encode(t) if t else b"") + tail for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            if packed:
                out = [pa.array(raw, pa.binary())]
            else:
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
                out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))]
            if decoded:
                out.append(pa.array([pieces.decode(np.frombuffer(r, "<i4").tolist()) for r in raw], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode(df: DataFrame, vocab: Broadcast, ids: str = "ids", *, decoded: str = "decoded") -> DataFrame:
    """df with decoded: the text that ids (an array, or packed) stand for; null ids give null, nulls among them nothing."""
    refuse_taken(df, decoded)
    python_ready(df.sparkSession)

    def listed(x: list[int] | bytes | None) -> list[int] | None:
        return np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(vocab.value)
        for batch in batches:
            lists = map(listed, batch.column(batch.schema.get_field_index(ids)).to_pylist())
            texts = pa.array([None if x is None else pieces.decode([i for i in x if i is not None]) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType(), True)]))
