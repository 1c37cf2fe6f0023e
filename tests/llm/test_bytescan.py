import random
import re
import zlib

import numpy as np
import pyarrow as pa
from tessera.llm import bytescan as B

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", "   ", "one Two", "two", "ÄÖ straße x", "a" * 70 + " " + "b" * 64, "日本 語1", "z" * 100_000, "end ", "É"]


def test_words_stay_inside_their_texts():
    for cut in (0, 3):
        texts = pa.array(TEXTS, pa.string()).slice(cut)
        for size in (1, 50, 1 << 22):
            got, n = [], 0
            for raw, at in B.pieces(texts, size):
                w = B.Words(raw, at)
                n += len(at) - 1
                got += [[w.word(k) for k in range(w.first[d], w.first[d + 1])] for d in range(len(at) - 1)]
            lower = [re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()) for t in TEXTS[cut:]]
            assert n == len(texts) and got == [WORD.findall(t) for t in lower]


def test_nothing_to_read():
    assert list(B.pieces(pa.array([], pa.string()))) == []
    (raw, at), = B.pieces(pa.array([None, ""], pa.string()))
    assert len(B.Words(raw, at)) == 0 and at.tolist() == [0, 0, 0]


def test_checksums_of_many_stretches():
    r = random.Random(3)
    data = np.array([r.randrange(256) for _ in range(5000)], np.uint8)
    starts = np.array([r.randrange(4000) for _ in range(400)] + [7, 7, 4999])
    ends = starts + np.array([r.choice([0, 1, 5, 63, 64, 65, 900]) for _ in range(400)] + [0, 1, 1])
    got = B.checksums(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    half = B.advance(np.full(len(starts), B.OPEN), data, starts, (starts + ends) // 2)
    assert (B.advance(half, data, (starts + ends) // 2, ends) ^ B.OPEN).tolist() == got.tolist()
