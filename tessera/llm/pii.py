"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on a small labelled table of token sequences (``labelled_table``: invented prose around personal
data as people type it, and around look-alikes that are none). Its features are the shapes of a token and of its two
neighbours, so a token's score under each label is a row of a small matrix for each of the three, and the field is
applied to a batch of texts with numpy: tokens are reduced to distinct words, words to scores, and Viterbi runs over
all uncertain stretches of the batch at once.

A token whose score for "none" leads by more than any two transitions can make good is "none" on the best path,
whatever its neighbours. Such tokens split a text into independent stretches, and only the rest is decoded; the result
is the best path of the whole text.

Spans of the field that overlap a base span are dropped: base spans always stay. Offsets are code points, end
exclusive.

Defined cases: null and empty text has no spans and stays as it is; repeated rows give equal spans; texts of any length
are treated whole and in linear time; an empty table gives an empty result; extra columns pass through ``find`` and
``redact`` untouched, but for one of the name that ``find`` gives its spans, which they replace.
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

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- base patterns

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, without overlap: every match begins where its run of local characters does, or where the match before it ended. One pass, each character looked at once."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    # A number in front of a dot can only begin at its first digit, hence the look-behind.
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- the field

LABELS = ("none", "email", "ip", "card", "phone")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'()[]{}<>*#$%&|"
_SHAPES = (
    ("wordy", re.compile(r"[^\W\d_]+$")),
    ("digits", re.compile(r"[0-9]+$")),
    ("phone_part", re.compile(r"[+(]?[0-9][0-9().-]*$|\([0-9]+\)$")),
    ("dotted_quad", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?$")),
    ("mail", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+$")),
    ("mail_cue", re.compile(r"(?i)e?-?mail$|(?i:contact)$|(?i:write)$")),
    ("phone_cue", re.compile(r"(?i:phone|tel|call|mobile|fax)$")),
    ("card_cue", re.compile(r"(?i:card|visa|credit)$")),
    ("ip_cue", re.compile(r"(?i:ip|host|address|server)$")),
)


def _quad(core: str) -> bool:
    return all(int(p) <= 255 for p in core.split(":")[0].split("."))


def shape(token: str) -> list[str]:
    """The features of one token."""
    core = token.strip(_TRIM)
    if len(core) > 64:
        return ["bias", "long"]
    out = ["bias"] + [name for name, p in _SHAPES if p.match(core)]
    if "dotted_quad" in out and not _quad(core):
        out[out.index("dotted_quad")] = "odd_quad"
    digits = [c for c in core if "0" <= c <= "9"]
    if digits and len(digits) == sum(c.isdigit() for c in core):
        n = len(digits)
        out.append(f"n_digits_{n if n <= 20 else 'many'}")
        if "digits" in out and 13 <= n <= 19:
            out.append("luhn" if luhn("".join(digits)) else "no_luhn")
        if core.startswith("+"):
            out.append("plus")
        if token.startswith("(") and token.rstrip(_TRIM).lstrip("(").isdigit():
            out.append("bracketed")
        if re.fullmatch(r"[0-9]{3}-[0-9]{4}", core):
            out.append("local_number")
    elif "wordy" not in out:
        out.append("mixed")
    return out


def labelled_table(n: int = 250, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sequences of tokens with a label each."""
    r = np.random.default_rng(seed)
    parts = ["the", "tion", "er", "an", "ing", "le", "que", "en", "sch", "ung", "ción", "ar", "of", "he", "é", "nd", "ou", "ß"]
    word = lambda: "".join(r.choice(parts, r.integers(1, 4)))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))

    def card(n: int, good: bool) -> str:
        body = str(r.integers(1, 10)) + num(n - 2)
        check = next(d for d in "0123456789" if luhn(body + d))
        return body + (check if good else str((int(check) + int(r.integers(1, 10))) % 10))

    quad = lambda top: ".".join(str(x) for x in r.integers(0, top, 4))

    def piece() -> tuple[list[str], str]:
        kind = r.integers(0, 17)
        match kind:
            case 0:
                return [f"{word()}.{num(2)}@{word()}.example.{r.choice(['com', 'org', 'net'])}".replace("é", "e").replace("ó", "o").replace("ß", "s")], "email"
            case 1:
                return [f"{word()}é.{word()}@{word()}ß{num(1)}.example.org"], "email"
            case 2:
                return [quad(256)], "ip"
            case 3:
                return [f"{quad(256)}:{num(4)}"], "ip"
            case 4 | 5:
                return [card(16, True)], "card"
            case 6:
                return [card(int(r.integers(17, 20)), True)], "card"
            case 7 | 8:
                return [f"+{r.integers(1, 99)}", f"({r.integers(200, 999)})", f"{num(3)}-{num(4)}"], "phone"
            case 9:
                return [f"({r.integers(200, 999)})", f"{num(3)}-{num(4)}"], "phone"
            case 10:
                return [f"+{r.integers(1, 99)}-{num(3)}-{num(3)}-{num(4)}"], "phone"
            case 11:
                return [num(int(r.integers(1, 15)))], "none"
            case 12:
                return [card(int(r.integers(13, 20)), False)], "none"
            case 13:
                return [num(int(r.integers(20, 40)))], "none"
            case 14:
                return [str(r.choice(["300.1.2.900", "1.2.3", "12.5", "3.14159", "2024-01-15", "555-1234", "1,000,000", "v2.10.3", "1.2.3.4.5"]))], "none"
            case 15:
                return [str(r.choice(["a@b", "@name", "user@", "x=1", "&amp;", "$5", "100%", "#12", "b2b", '"24be64439e3e49cf46b2d7c90f3602a3"', "http://www.example.org/p/12", "long" * 20, "-", "e-mail", "phone", "card", "host"]))], "none"
            case _:
                return [f"({num(int(r.integers(1, 5)))})", word()], "none"

    rows = []
    for _ in range(n):
        tokens, labels = [], []
        for _ in range(r.integers(1, 5)):
            for _ in range(r.integers(0, 6)):
                tokens.append(word() + str(r.choice(["", "", "", ",", ".", "$$$"])))
                labels.append("none")
            got, label = piece()
            if r.random() < 0.2:
                got = [*got[:-1], got[-1] + str(r.choice([".", ",", "###", "&&&"]))]
            tokens += got
            labels += [label] * len(got)
            while r.random() < 0.25:  # neighbours without a word between
                got, label = piece()
                tokens += got
                labels += [label] * len(got)
        rows.append((tokens, labels))
    return rows


class Field:
    """Scores: one matrix (features x labels) for each of previous, own and next token; transitions between labels."""

    def __init__(self, features: dict[str, int], scores: np.ndarray, moves: np.ndarray):
        self.features, self.scores, self.moves = features, scores, moves

    def rows(self, token: str) -> list[int]:
        return [self.features[f] for f in shape(token) if f in self.features]

    def of(self, token: str) -> np.ndarray:
        """3 x labels: what the token adds to the one after it, to itself, to the one before it."""
        return self.scores[:, self.rows(token)].sum(axis=1)


def _encode(rows: list[tuple[list[str], list[str]]], names: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for tokens, labels in rows:
        x = np.zeros((len(tokens) + 2, len(names)))
        for k, t in enumerate(tokens):
            x[k + 1, [names[f] for f in shape(t) if f in names]] = 1
        out.append((np.stack([x[:-2], x[1:-1], x[2:]]), np.array([LABELS.index(y) for y in labels])))
    return out


def train(rows: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 1.0, decay: float = 1e-5) -> Field:
    """Maximum likelihood with full gradients: forward-backward over the table's sequences, AdaGrad steps."""
    names = {f: k for k, f in enumerate(sorted({f for tokens, _ in rows for t in tokens for f in shape(t)}))}
    data, n = _encode(rows, names), len(LABELS)
    longest = max(len(y) for _, y in data)
    # All sequences at once, padded; a mask holds their true lengths.
    x = np.zeros((3, len(data), longest, len(names)))
    y = np.zeros((len(data), longest), int)
    mask = np.zeros((len(data), longest), bool)
    for k, (a, b) in enumerate(data):
        x[:, k, : len(b)], y[k, : len(b)], mask[k, : len(b)] = a, b, True
    gold, both = np.eye(n)[y] * mask[..., None], mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("kti,ktj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
    scores, moves = np.zeros((3, len(names), n)), np.zeros((n, n))
    seen = [np.full_like(scores, 1e-8), np.full_like(moves, 1e-8)]
    for _ in range(steps):
        e = np.einsum("cktf,cfl->ktl", x, scores, optimize=True)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        grads = [np.einsum("cktf,ktl->cfl", x, gold - p, optimize=True) / len(data) - decay * scores, (gold_moves - pairs.sum((0, 1))) / len(data) - decay * moves]
        for w, g, s in zip((scores, moves), grads, seen, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(names, scores, moves)


@lru_cache(1)
def trained() -> Field:
    return train(labelled_table())


def viterbi(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best label paths of a block of equally long sequences (sequences x tokens x labels)."""
    n, length, _ = e.shape
    best, back = e[:, 0], np.zeros(e.shape, np.int8)
    for t in range(1, length):
        through = best[:, :, None] + moves
        back[:, t] = through.argmax(axis=1)
        best = through.max(axis=1) + e[:, t]
    path = np.zeros((n, length), np.int8)
    path[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


_SUSPECT = re.compile(r"[0-9@]")
#: A token of each shape that tokens without digit and @ can have: letters or not, long, and the cues. Only the cue for
#: mail has a form that is not all letters.
_SAFE = ("word", "-", "w" * 65, "email", "e-mail", "phone", "visa", "host")


class Decoder:
    """Applies a field to texts; remembers the scores of words, up to a number."""

    REMEMBERED = 100_000

    def __init__(self, field: Field):
        self.field, self.known = field, {}
        m = field.moves
        #: What label y can gain over "none" by the transitions around it, at most.
        self.gain = (m - m[:, :1]).max(axis=0) + (m - m[:1]).max(axis=1)
        safe = [self.of(t) for t in _SAFE] + [np.zeros((3, len(LABELS)))]
        #: Whether tokens without digit and @, among their like, are "none" on every best path.
        self.sparse = all(self.sure(b[0] + t[1] + a[2]) for b in safe for t in safe[:-1] for a in safe)

    def of(self, token: str) -> np.ndarray:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            got = self.known[token] = self.field.of(token)
        return got

    def sure(self, e: np.ndarray) -> bool:
        return bool((e[0] - e[1:] > self.gain[1:]).all())

    def paths(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, end, label) of its tokens that have a label other than none."""
        stretches: dict[int, list] = {}
        for d, text in enumerate(texts):
            if self.sparse and not _SUSPECT.search(text):
                continue
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = np.concatenate([[False], ~((c == 32) | ((c >= 9) & (c <= 13))), [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            n = len(starts)
            if not n:
                continue
            count = np.concatenate([[0], np.cumsum(((c >= 48) & (c <= 57)) | (c == 64))])
            suspect = count[ends] > count[starts] if self.sparse else np.ones(n, bool)

            def at(k: int, text=text, starts=starts, ends=ends, n=n) -> np.ndarray:
                return self.of(text[starts[k] : ends[k]]) if 0 <= k < n else np.zeros((3, len(LABELS)))

            def score(k: int, at=at) -> np.ndarray:
                return at(k - 1)[0] + at(k)[1] + at(k + 1)[2]

            done = 0
            for k in np.flatnonzero(suspect):
                if k < done:
                    continue
                lo = hi = int(k)
                while lo > done and not self.sure(score(lo - 1)):
                    lo -= 1
                while hi + 1 < n and (suspect[hi + 1] or not self.sure(score(hi + 1))):
                    hi += 1
                done = hi + 1
                e = np.stack([score(j) for j in range(lo, hi + 1)])
                if lo > 0:
                    e[0] += self.field.moves[0]
                if hi + 1 < n:
                    e[-1] += self.field.moves[:, 0]
                stretches.setdefault(len(e), []).append((d, starts[lo : hi + 1], ends[lo : hi + 1], e))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for same in stretches.values():
            for (d, starts, ends, _), path in zip(same, viterbi(np.stack([x[3] for x in same]), self.field.moves), strict=True):
                out[d] += [(int(starts[k]), int(ends[k]), int(path[k])) for k in np.flatnonzero(path)]
        return [sorted(x) for x in out]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out = []
        for text, path in zip(texts, self.paths(texts), strict=True):
            got: list[tuple[str, int, int]] = []
            for start, end, y in path:
                phone, token = LABELS[y] == "phone", text[start:end]
                a = start + len(token) - len(token.lstrip(_TRIM.replace("(", "") if phone else _TRIM))
                b = end - (len(token) - len(token.rstrip(_TRIM)))
                if a >= b:
                    continue
                if phone:  # one bracket may open a number, and is closed inside it
                    a += max(0, len(text[a:b]) - len(text[a:b].lstrip("(")) - 1)
                    b += text[a:b].count("(") > text[a:b].count(")") and text[b : b + 1] == ")"
                last = got[-1] if got else None
                if phone and last and last[0] == "phone" and text[a] != "+" and not text[last[2] : a].strip("\x20"):
                    got[-1] = ("phone", last[1], b)
                else:
                    got.append((LABELS[y], a, b))
            out.append(got)
        return out


# ---------------------------------------------------------------- over a table

_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def all_spans(decoder: Decoder, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """Base spans and those the field adds, by kind as listed, then start."""
    out = []
    for text, added in zip(texts, decoder.spans(texts), strict=True):
        base = sorted(base_spans(text), key=lambda s: s[1])
        if added and base:
            starts, ends = np.array([s[1] for s in base]), np.maximum.accumulate([s[2] for s in base])
            # Of the base spans that begin before the added one ends, none may reach beyond its start.
            added = [s for s in added if not (k := np.searchsorted(starts, s[2])) or ends[k - 1] <= s[1]]
        got = [(*s, True) for s in base] + [(*s, False) for s in added]
        out.append(sorted(got, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def _finder(field: Field):
    def find(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(field)
        for texts in columns:
            found = all_spans(decoder, [t or "" for t in texts])
            yield pd.Series([[{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in spans] for spans in found], dtype=object)

    return F.pandas_udf(find, _SPANS)


def find(docs: DataFrame, text: str = "text", to: str = "pii_spans", field: Field | None = None) -> DataFrame:
    """``docs`` with a column of spans (kind, start, end, base)."""
    return docs.withColumn(to, _finder(field or trained())(F.col(text)))


def _redactor(field: Field):
    def redact(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(field)
        for texts in columns:
            found, out = all_spans(decoder, [t or "" for t in texts]), []
            for text, spans in zip(texts, found, strict=True):
                if spans:
                    parts, at = [], 0
                    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            parts += [text[at:a], f"<{kind.upper()}>"]
                        at = max(at, b)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(redact, "string")


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; of spans that overlap, the first names the place and all are gone."""
    return docs.withColumn(text, _redactor(field or trained())(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = [f"CAST(size(filter(pii_spans, s -> s.base AND s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS]
    base = joined.format("filter(pii_spans, s -> s.base)")
    return found.selectExpr("doc_id", *count, f"sha2({base}, 256) AS base_sha256", f"{joined.format('pii_spans')} AS spans", "CAST(size(filter(pii_spans, s -> NOT s.base)) AS BIGINT) AS n_added")
