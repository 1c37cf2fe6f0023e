"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model: the normaliser (a transducer from bytes to strings: the trie of the model's
character map, whose longest rule at each place is rewritten at no weight, every other character passing as it is, and
behind it what becomes of white space: runs shortened if the model asks for it, the dummy prefix, space to the word
mark), the pieces with byte fallback (an arc for each piece, with its weight; a path of byte arcs for each character
that no piece holds), and, for a model trained by merges, an acceptor of neighbours. They are composed with each input
word and the shortest path in the tropical semiring (weights add along a path, the least path wins) is its encoding.

For a unigram model a piece's weight is its negated score and any neighbours are accepted. For a merge model a
segmentation is the one that merging gives exactly if merging leaves each pair of neighbours as it is; so the acceptor
gives such pairs weight 0 and others infinity, and exactly one path to each state is finite. Merging never reaches
across pieces that it leaves apart, hence the pairs decide. The neighbour weights are computed when first asked for.

The arcs into a word mark from another character hold no piece (``Machine`` checks the vocabulary for that), so a text
falls apart into words there, and each Python worker composes a distinct word once while it remembers it. Where the
normaliser has no character map and keeps all white space, words of the input are remembered as they are, so that a
known word passes neither machine again.

Limits: a model with user-defined pieces, or that marks the ends of words instead of their beginnings, is refused.

Defined cases: null and empty text encode to no ids; text that holds the word mark itself decodes to spaces; bytes
that are no UTF-8 decode to U+FFFD; texts of any length are encoded whole; repeated rows encode alike; an empty table
gives an empty result; extra columns pass through ``encode`` and ``decode`` untouched, but for one of the name that
the result gets, which the result replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MARK = "▁"
#: Distinct words (the older half goes when the newer is full), and pairs of neighbours, that a Python worker remembers.
REMEMBERED = 400_000
PAIRS = 400_000
#: Texts that are encoded or decoded at a time.
SLICE = 512
INF = float("inf")


def model_bytes(path: str | None = None) -> bytes:
    """The model, read on the driver and shipped to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Normaliser:
    """The transducer from texts to normalised ones, over the double array that the model holds its character map in.

    Fixed format: four bytes with the size of the array, its units of 32 bits, then strings that end with a zero byte.
    A unit has a label in its low byte and bit 31, a bit 8 that tells of a value one step on, and the offset of its
    children in bits 10 to 30, eight bits further left if bit 9 is set.
    """

    def __init__(self, spec):
        raw = spec.precompiled_charsmap
        size = int.from_bytes(raw[:4], "little")
        self.units = np.frombuffer(raw[4 : 4 + size], "<u4").tolist()
        self.strings = raw[4 + size :]
        self.prefix, self.shorten = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        #: Whether every character passes as it is, behind the dummy prefix.
        self.plain = not self.units and self.prefix and not self.shorten
        self.first = {b for b in range(256) if self.units and self._step(self._children(0, self.units[0]), b) is not None}

    @staticmethod
    def _children(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, node: int, byte: int) -> int | None:
        """The state behind an arc; none where the trie has no such arc."""
        to = node ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def _longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The end of the longest rule from a place on, and what it writes."""
        node, found = self._children(0, self.units[0]), None
        for k in range(at, len(data)):
            to = self._step(node, data[k])
            if to is None:
                break
            unit = self.units[to]
            node = self._children(to, unit)
            if unit & 256:
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1, self.strings[start : self.strings.index(b"\0", start)]
        return found

    def rewritten(self, text: str) -> str:
        """The composition with the character map."""
        if not self.units:
            return text
        data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            hit = self._longest(data, at) if data[at] in self.first else None
            if hit:
                at, written = hit
            else:
                head = data[at]
                end = at + (1 if head < 0xC0 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4)
                written, at = data[at:end], end
            out.append(written)
        return b"".join(out).decode("utf-8", "surrogatepass")

    def __call__(self, text: str) -> str:
        got = self.rewritten(text)
        if self.shorten:
            got = " ".join(w for w in got.split(" ") if w)
        mark = MARK if self.prefix and (got or (text and not self.shorten)) else ""
        return mark + got.replace(" ", MARK)


class Machine:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(model)
        norm, kinds = m.normalizer_spec, pb.ModelProto.SentencePiece
        if not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark the beginnings of words are compiled")
        self.normal = Normaliser(norm)
        if m.trainer_spec.model_type not in (1, 2) or any(p.type == kinds.USER_DEFINED for p in m.pieces):
            raise ValueError("only unigram and merge models without user-defined pieces are compiled")
        self.merges = m.trainer_spec.model_type == 2
        self.ids = {p.piece: k for k, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        self.score = [p.score for p in m.pieces]
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.unknown = next(k for k, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.text = [p.piece for p in m.pieces]
        out = [p.piece.encode() if p.type == kinds.NORMAL else b"" for p in m.pieces]
        for value, k in self.bytes.items():
            out[k] = bytes([value])
        out[self.unknown] = m.trainer_spec.unk_surface.encode()
        self.surface = pa.array(out, pa.large_binary())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the word mark behind another character")
        self.line_apart = not any("\n" in p for p in self.ids)
        #: Texts of pieces to their numbers, other beginnings of pieces to -1.
        self.arcs = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.floor = min(self.score[k] for k in self.ids.values()) - 10.0

    def _merged(self, s: str) -> list[str]:
        """What merging makes of a short string: always the pair of best score, the leftmost of equals."""
        ids, score, parts = self.ids, self.score, list(s)
        while len(parts) > 1:
            best, at = -INF, -1
            for k in range(len(parts) - 1):
                p = ids.get(parts[k] + parts[k + 1])
                if p is not None and score[p] > best:
                    best, at = score[p], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def accepts(self, left: int, right: int) -> bool:
        """The neighbour acceptor: weight 0 or infinity. At the start (-1) stand the pieces that merging makes of their own text; next to a byte path (-2) stands what may begin a word."""
        b = self.text[right]
        return self._merged(b) == [b] if left < 0 else self._merged(self.text[left] + b) == [self.text[left], b]

    def _by_merges(self, word: str, last: list[int], back: list[int]) -> None:
        """Shortest paths for a merge model: each state has one path of finite weight, so the first arc that is accepted is its last."""
        arcs, pairs, n, longest = self.arcs, self.pairs, len(word), self.longest
        for i in range(n):
            left = last[i]
            row = pairs.get(left)
            if row is None:
                row = pairs[left] = {}
            for j in range(i + 1, (i + longest if i + longest < n else n) + 1):
                p = arcs.get(word[i:j])
                if p is None:
                    break
                if p < 0 or last[j] != -3:
                    continue
                ok = row.get(p)
                if ok is None:
                    ok = row[p] = self.accepts(left, p)
                    self.n_pairs += 1
                if ok:
                    last[j], back[j] = p, i
            if last[i + 1] == -3 and word[i] not in self.ids:
                last[i + 1], back[i + 1] = -2, i
        if self.n_pairs > PAIRS:
            self.pairs, self.n_pairs = {}, 0

    def _by_scores(self, word: str, last: list[int], back: list[int]) -> None:
        """Shortest paths for a unigram model."""
        n, cost = len(word), [0.0] + [INF] * len(word)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = self.arcs.get(word[i:j])
                if p is None:
                    break
                if p >= 0 and cost[i] - self.score[p] < cost[j]:
                    cost[j], last[j], back[j] = cost[i] - self.score[p], p, i
            if word[i] not in self.ids and cost[i] - self.floor < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = cost[i] - self.floor, -2, i

    def shortest(self, word: str) -> list[int]:
        """The shortest path of the composition with one normalised word. States are places in the word, each with the last piece of its best path; -2 stands for a path of bytes, -3 for no path."""
        n = len(word)
        last, back = [-3] * (n + 1), [0] * (n + 1)
        last[0] = -1
        (self._by_merges if self.merges else self._by_scores)(word, last, back)
        out: list[int] = []
        j = n
        while j:
            if last[j] >= 0:
                out.append(last[j])
            else:
                found = [self.bytes.get(b, self.unknown) for b in word[back[j] : j].encode("utf-8", "surrogatepass")]
                out += found[::-1] if self.unknown not in found else [self.unknown]
            j = back[j]
        return out[::-1]

    def _word(self, key: str) -> bytes:
        """Ids of a word as text.split gives it: behind a space, or behind a line feed that it begins with."""
        got = self.words.get(key)
        if got is None:
            if len(self.words) >= REMEMBERED // 2:
                self.words, self.older = {}, self.words
            got = self.older.get(key)
            if got is None:
                path = self.shortest("\n") + self.shortest(key[1:]) if key[:1] == "\n" else self.shortest(MARK + key)
                got = np.array(path, np.int32).tobytes()
            self.words[key] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.normal.plain and self.line_apart and MARK not in text:
            words = text.replace("\n", " \n").split(" ")
            if "" not in words:
                try:
                    return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)
                except KeyError:
                    return np.frombuffer(b"".join(map(self._word, words)), np.int32)
        parts = re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.line_apart else f"{MARK}*[^{MARK}]+|{MARK}+", self.normal(text))
        return np.array([k for p in parts for k in self.shortest(p)], np.int32)

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        """The inverse machine: surfaces of pieces and bytes, the mark to a space, without the dummy prefix."""
        flat = np.concatenate([np.zeros(0, np.int32), *lists])
        laid = self.surface.take(pa.array(flat))
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
        at = ends[np.cumsum([0, *map(len, lists)])].tolist()
        data, out = memoryview(laid.buffers()[2] or b""), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            text = str(data[a:b], "utf-8", "replace").replace(MARK, " ")
            out.append(text.lstrip(" ") if self.normal.shorten else text[1:] if self.normal.prefix and text[:1] == " " else text)
        return out

    def decode(self, ids) -> str:
        return self.decode_all([np.asarray(ids, np.int32)])[0]


#: One a Python worker and model, kept from task to task.
@lru_cache(2)
def _machine(model: bytes) -> Machine:
    return Machine(model)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _encoder(model: bytes):
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(model)
        for texts in columns:
            yield _lists([machine.encode(t.as_py() or "") for t in texts])

    return F.arrow_udf(encode, "array<int>")


def _decoder(model: bytes):
    def decode(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _machine(model)
        for ids in columns:
            found = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in ids]
            yield pd.Series([t for k in range(0, len(found), SLICE) for t in machine.decode_all(found[k : k + SLICE])], dtype=object)

    return F.pandas_udf(decode, "string")


def encode(docs: DataFrame, text: str = "text", to: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of a text column."""
    return docs.withColumn(to, _encoder(model_bytes(model))(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", to: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with the text of a column of ids; a null list gives the empty text."""
    return docs.withColumn(to, _decoder(model_bytes(model))(F.col(ids)))


def _round_trip(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for large in batches:
            for at in range(0, large.num_rows, SLICE):
                batch = large.slice(at, SLICE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = list(map(machine.encode, texts))
                same = [a == b for a, b in zip(machine.decode_all(ids), texts, strict=True)]
                made = [batch.column(0), pa.array(list(map(len, ids)), pa.int64()), _lists(ids), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_ids", "ids", "round_trip"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_round_trip(model_bytes()), "doc_id long, n_ids long, ids array<int>, round_trip boolean")
