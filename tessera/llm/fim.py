"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and these are put in the order that a form asks for.

A deterministic automaton over bytes reads the texts once. Its table is compiled from the sentinels: a state knows
whether a run of letters is open, how many continuation bytes of a character are due, and how much of a sentinel has
been read. Each transition says whether it begins a unit (a run of letters, or any other single character), whether
it begins a character, and whether it completes a sentinel; these are counted for each block of bytes. The states
after ``memory`` bytes do not depend on the state before them (the compiler proves it), so all blocks of a batch run
in step, each from a few bytes before its start. Cuts are numbers of units; the second pass finds the block that a
cut lies in by the counts, runs the automaton over that block alone, and gets the byte and the character.

Where to cut, and the form, follow from a hash of the seed and the document's id, so reruns agree. Texts that hold a
sentinel stay plain, and so the output can be taken apart again.

Defined cases: null and empty text is plain, with no units; a null id is hashed as ``null``; rows of equal id are cut
by the same numbers; a byte that is no UTF-8 where it stands is a character and a unit of its own; texts of any length
are treated whole; an empty table gives an empty result; extra columns pass through ``fill_in_middle`` untouched, but
for one of the name that it gives its result, which it replaces.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytescan import pieces
from tessera.llm.common import table

#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = "1"
#: Of 100 documents, how many are cut; of 100 cut ones, how many give the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of a block.
BLOCK = 256
UNIT, CHAR, SENTINEL = 1, 2, 4
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Automaton:
    """``classes`` maps bytes to symbols; the symbol ``fresh`` higher is the same byte as the first of a text. ``moves`` and ``says`` are by state * width + symbol; states in ``moves`` are multiplied by the width already."""

    def __init__(self, sentinels: tuple[str, ...]):
        marks = [s.encode() for s in sentinels]
        for a, b in itertools.product(marks, repeat=2):
            if not a or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)) + (a is not b))) or (a is not b and a in b):
                raise ValueError("sentinels must be distinct, and none may begin as one ends or lie inside one")
        if len(set(marks)) < len(marks):
            raise ValueError("sentinels must be distinct, and none may begin as one ends or lie inside one")
        heads = {m[:k] for m in marks for k in range(len(m))}

        def move(state: tuple[bool, int, bytes], b: int) -> tuple[tuple[bool, int, bytes], int]:
            letters, due, read = state
            read += bytes([b])
            says = SENTINEL if any(read.endswith(m) for m in marks) else 0
            while read not in heads:
                read = read[1:]
            if due and 0x80 <= b < 0xC0:
                return (False, due - 1, read), says
            letter = b in _LETTERS
            due = 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
            return (letter, due, read), says | CHAR | (0 if letter and letters else UNIT)

        start = (False, 0, b"")
        states, rows = [start], []
        for state in states:
            row = [move(state, b) for b in range(256)]
            states += [s for s in dict.fromkeys(s for s, _ in row) if s not in states]
            rows.append(row)
        number = {s: k for k, s in enumerate(states)}
        to = np.array([[number[s] for s, _ in row] for row in rows])
        says = np.array([[x for _, x in row] for row in rows])
        # Bytes that act alike in every state are one symbol.
        columns, classes = np.unique(np.concatenate([to, says]), axis=1, return_inverse=True)
        to, says = columns[: len(states)], columns[len(states) :]
        self.fresh = to.shape[1]
        self.width = 2 * self.fresh
        self.classes = classes.reshape(-1).astype(np.uint8)
        self.moves = (np.concatenate([to, np.broadcast_to(to[:1], to.shape)], axis=1) * self.width).reshape(-1).astype(np.intp)
        self.says = np.concatenate([says, np.broadcast_to(says[:1], says.shape)], axis=1).reshape(-1).astype(np.uint8)
        self.memory = self._memory(to)

    @staticmethod
    def _memory(to: np.ndarray) -> int:
        """The number of symbols after which all states have become one, whatever the symbols."""
        sets, n = {frozenset(range(len(to)))}, 0
        while any(len(s) > 1 for s in sets):
            sets, n = {frozenset(column) for s in sets for column in to[sorted(s)].T}, n + 1
            if n > 64:
                raise ValueError("the automaton does not forget its state")
        return n

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """What each transition says, for lanes of symbols (steps x lanes) that all move on together. The first ``memory`` rows only lead to the right state and are not returned."""
        state, out = np.zeros(symbols.shape[1], np.intp), np.empty((len(symbols) - self.memory, symbols.shape[1]), np.uint8)
        for k, row in enumerate(symbols):
            here = state + row
            if k >= self.memory:
                np.take(self.says, here, out=out[k - self.memory])
            state = self.moves[here]
        return out


@lru_cache(8)
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


class Scan:
    """One pass over the texts of a piece: for each text the number of units (``units``), of characters (``chars``) and of sentinels (``marks``)."""

    def __init__(self, a: Automaton, raw: np.ndarray, at: np.ndarray):
        self.a, self.at = a, at
        n_blocks = max(1, -(-len(raw) // BLOCK))
        # A few bytes before the first block, which begins with the first byte of a text; the last block is filled up.
        self.symbols = np.zeros(a.memory + n_blocks * BLOCK, np.uint8)
        self.symbols[a.memory : a.memory + len(raw)] = a.classes[raw]
        self.symbols[a.memory + at[:-1][at[1:] > at[:-1]]] += a.fresh
        says = np.ascontiguousarray(a.run(self._lanes(np.arange(n_blocks))).T)
        self.before = np.zeros((2, n_blocks + 1), np.int64)  # units and characters before each block
        per_text = np.zeros((3, len(at) - 1), np.int64)
        flat, full = says.reshape(-1)[: len(raw)], np.flatnonzero(at[1:] > at[:-1])
        for k, bit in enumerate((UNIT, CHAR, SENTINEL)):
            hit = (flat & bit) != 0
            if len(full):
                per_text[k, full] = np.add.reduceat(hit, at[:-1][full], dtype=np.int64)
            if k < 2:
                inner = np.add.reduceat(hit, np.arange(0, len(hit), BLOCK), dtype=np.int64) if len(hit) else [0]
                np.cumsum(inner, out=self.before[k, 1:])
        self.units, self.chars, self.marks = per_text
        self.first = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_text[:2], axis=1)], axis=1)

    def _lanes(self, blocks: np.ndarray) -> np.ndarray:
        steps = self.a.memory + BLOCK
        return np.lib.stride_tricks.sliding_window_view(self.symbols, steps)[::BLOCK][blocks].T.copy()

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the byte (in the piece) and the character (in the text) that follow its first ``units`` units."""
        byte, char = self.at[1:].copy(), self.chars.copy()
        inside = np.flatnonzero(units < self.units)
        wanted = self.first[0, inside] + units[inside]
        blocks = np.searchsorted(self.before[0], wanted, side="right") - 1
        for lo in range(0, len(inside), 4096):
            part, block = inside[lo : lo + 4096], blocks[lo : lo + 4096]
            says = self.a.run(self._lanes(block))
            nth = wanted[lo : lo + 4096] - self.before[0, block]
            place = (np.cumsum((says & UNIT) != 0, axis=0, dtype=np.int16) > nth).argmax(axis=0)
            chars = np.cumsum((says & CHAR) != 0, axis=0, dtype=np.int16)[place, np.arange(len(part))] - 1
            byte[part] = block * BLOCK + place
            char[part] = self.before[1, block] + chars - self.first[1, part]
        return byte, char


_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _cutter(sentinels: tuple[str, ...], cut: int, suffix_first: int):
    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        a, (p, s, m) = automaton(sentinels), (x.encode() for x in sentinels)
        h = np.stack([x.to_numpy(zero_copy_only=False) for x in (h1, h2, h3, h4)]).astype(np.int64)
        done, n, forms, prefix, middle, out = 0, [], [], [], [], []
        for raw, at in pieces(texts):
            scan, here = Scan(a, raw, at), h[:, done : done + len(at) - 1]
            done += len(at) - 1
            plain = (at[1:] == at[:-1]) | (scan.marks > 0) | (here[2] % 100 >= cut)
            first, second = np.sort(here[:2] % (scan.units + 1), axis=0)
            (b1, c1), (b2, c2) = scan.cut(first), scan.cut(second)
            kinds = np.where(plain, 0, np.where(here[3] % 100 < suffix_first, 1, 2))
            data = raw.tobytes()
            for lo, x, y, hi, kind in zip(at[:-1].tolist(), b1.tolist(), b2.tolist(), at[1:].tolist(), kinds.tolist(), strict=True):
                if kind == 2:
                    out.append(b"".join((p, data[lo:x], s, data[y:hi], m, data[x:y])))
                elif kind == 1:
                    out.append(b"".join((s, data[y:hi], p, data[lo:x], m, data[x:y])))
                else:
                    out.append(data[lo:hi])
            n.append(scan.units)
            forms.append(kinds)
            prefix.append(np.ma.array(c1, mask=plain))
            middle.append(np.ma.array(c2 - c1, mask=plain))
        names = np.array(["plain", "spm", "psm"], object)

        def whole(parts: list) -> pa.Array:
            x = np.ma.concatenate(parts) if parts else np.ma.zeros(0, np.int64)
            return pa.array(np.asarray(x.data, np.int64), pa.int64(), mask=np.ma.getmaskarray(x))

        form = pa.array(names[np.concatenate(forms)] if forms else [], pa.string())
        return pa.StructArray.from_arrays([whole(n), form, whole(prefix), whole(middle), pa.array(out, pa.binary()).view(pa.string())], ["n", "form", "prefix_chars", "middle_chars", "output"])

    return F.arrow_udf(run, _RESULT)


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four whole numbers below 2 ** 32 from the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", to: str = "fim", sentinels: tuple[str, str, str] = SENTINELS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``docs`` with a struct column: n (units), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    automaton(tuple(sentinels))  # refuses what cannot be taken apart again
    return docs.withColumn(to, _cutter(tuple(sentinels), cut, suffix_first)(F.col(text), *draws(F.col(key), seed)))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from, by the form."""
    p, s, m = sentinels
    lead = F.when(form == "psm", len(p)).otherwise(len(s))
    body = F.substr(output, F.lit(1) + lead)

    def parts(second: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(first) + len(second) + 1)
        last = F.substring_index(rest, m, 1)
        return first, last, F.substr(rest, F.length(last) + len(m) + 1)

    prefix, suffix, middle = parts(s)
    suffix2, prefix2, middle2 = parts(p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), d AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t
), p AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
