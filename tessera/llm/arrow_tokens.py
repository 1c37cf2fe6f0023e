"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds record batches of SEQUENCES rows; a row is ``ids`` (a fixed-size list of LENGTH unsigned integers) and
``mask`` (as long a list of bits: true where an id is real; only a file's last row is padded). All batches of a file
are equally large, so sequence n is row n % SEQUENCES of batch n // SEQUENCES, and a memory map serves it without
copying or decoding. Beside each file lies a small stream of (doc_id, start, n_tokens), the places of its documents.

Documents are shuffled once, by ranges of doc_id; each range is one task, which encodes as it writes, and one file.
Files get their final name by one rename after they are complete, and a task that is run again writes the same bytes,
so lost executors do no harm. The start of a file is the sum of the files before it, taken
from the files' own totals; no count of documents passes through the driver.

Words recur, so each Python worker encodes a distinct word once while it remembers it. That is exact for a tokenizer
that splits at white space in the one way that ``splits_at_space`` compares its definition with; others get whole texts.

Defined cases: null text is empty and has the end id only; rows of equal doc_id, which may fill several files, are
ordered by a hash of their texts, then the texts; a null doc_id comes first; an empty table writes no file and gives
no row; extra columns are ignored, whatever their names. Files on a store that cannot be mapped are read whole, so one
task's share of the texts is what a reader holds.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_path, table

LENGTH = 1024
SEQUENCES = 64
END = 1
#: Distinct pieces of texts that a Python worker remembers.
PIECES = 900_000


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's definition, read on the driver and shipped to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: The one normaliser and the one way of splitting whose pieces ``_cut`` makes too.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_space(definition: str) -> bool:
    """Whether the tokenizer splits texts as ``_cut`` does: exactly this normaliser and pre-tokenizer, added tokens without white space, nothing behind."""
    d = json.loads(definition)
    added = d.get("added_tokens", [])
    bare = not any(c.isspace() for t in added for c in t["content"]) and all("<" in t["content"][:1] for t in added) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    return bare and d.get("normalizer") == NORMALIZER and d.get("pre_tokenizer") == PRE_TOKENIZER and not d.get("post_processor")


#: Texts of nothing but these are cut by ``_PIECE`` as the tokenizer's own pattern cuts them, after lower-casing, which
#: maps each of their letters to one letter and leaves them composed. No apostrophe: contractions are pieces too. No
#: angle bracket: special tokens are found before all else.
_SIMPLE = re.compile(r"[ \n\t!-&(-;=-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ \n\ta-zß-öø-ÿ0-9]+")


class Encoder:
    """A tokenizer with a memory of pieces: runs of letters or signs, single digits, and words of other texts."""

    def __init__(self, definition: str, wide: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_str(definition), np.uint32 if wide else np.uint16
        self.by_word = splits_at_space(definition)
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if _SIMPLE.fullmatch(text):
            return _PIECE.findall(text.lower())
        # Space, line feed, tab: white space for the tokenizer too. Other kinds are left to it.
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def _coded(self, distinct: list[str]) -> list[bytes]:
        known = list(map(self.pieces.get, distinct))
        missing = [k for k, x in enumerate(known) if x is None]
        if len(self.pieces) + len(missing) > PIECES:
            self.pieces.clear()
        for at in range(0, len(missing), 2048):
            part = [distinct[k] for k in missing[at : at + 2048]]
            for k, p, x in zip(missing[at : at + 2048], part, self.whole(part), strict=True):
                known[k] = self.pieces[p] = x
        return known

    def __call__(self, texts: list[str], tail: bytes = b"") -> list[bytes]:
        if not self.by_word:
            return [x + tail for x in self.whole(texts)]
        cut = [self._cut(text) for text in texts]
        coded = pc.dictionary_encode(pa.array(chain.from_iterable(cut), pa.large_string()))
        # Taking a piece's bytes for each of its places lays the ids of all texts side by side.
        laid = pa.array(self._coded(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1) if len(laid) else np.zeros(1, np.int64)
        at = ends[np.cumsum([0, *map(len, cut)])].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        return [bytes(data[a:b]) + tail for a, b in zip(at[:-1], at[1:], strict=True)]


#: One a Python worker and definition, kept from task to task.
@lru_cache(2)
def _encoder(definition: str, wide: bool) -> Encoder:
    return Encoder(definition, wide)


def _encode(definition: str, end: int | None, wide: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition, wide)
        tail = b"" if end is None else np.array([end], encoder.kind).tobytes()
        for large in batches:
            for at in range(0, large.num_rows, 512):
                batch = large.slice(at, 512)
                ids = encoder([t or "" for t in batch.column(1).to_pylist()], tail)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return encode


def _is_wide(definition: str, end: int | None) -> bool:
    d = json.loads(definition)
    return max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens", [])), end or 0]) > 0xFFFF


def encode(docs: DataFrame, tokenizer: str | None = None, end: int | None = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): little-endian bytes, of 16 bits each if the vocabulary allows it, of 32 else."""
    definition = tokenizer_json(tokenizer)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_encode(definition, end, _is_wide(definition, end)), "doc_id long, ids binary")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


class _Writer:
    """One file and its index, complete or not there."""

    def __init__(self, folder: str, wide: bool, length: int):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.temp, self.base, self.length = f"{base}/.{uuid.uuid4().hex}", base, length
        self.kind = np.uint32 if wide else np.uint16
        ids = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "sequences": str(SEQUENCES)})
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(f"{self.temp}.ids")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.index_out = self.fs.open_output_stream(f"{self.temp}.docs")
        self.index = pa.ipc.new_stream(self.index_out, self.places)
        self.rest, self.pending, self.total = [], 0, 0

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        sizes = np.array([len(x) // self.kind().itemsize for x in ids], np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.places))
        self.total += int(sizes.sum())
        self.rest += ids
        self.pending += int(sizes.sum())
        if self.pending >= self.length * SEQUENCES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat, step = np.frombuffer(b"".join(self.rest), self.kind), self.length * SEQUENCES
        whole = len(flat) // step * step
        for at in range(0, whole, step):
            self._write(flat[at : at + step], step)
        left = flat[whole:]
        if last and len(left):
            self._write(left, -(-len(left) // self.length) * self.length)
            left = left[:0]
        self.rest, self.pending = [left.tobytes()], len(left)

    def _write(self, ids: np.ndarray, room: int) -> None:
        full = np.zeros(room, self.kind)
        full[: len(ids)] = ids
        mask = np.arange(room) < len(ids)
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self, name: str) -> None:
        self._flush(True)
        for x in (self.stream, self.out, self.index, self.index_out):
            x.close()
        for end in ("docs", "ids"):
            self.fs.move(f"{self.temp}.{end}", f"{self.base}/{name}.{end}")


def _write(folder: str, definition: str, end: int | None, length: int):
    wide = _is_wide(definition, end)
    encoded = _encode(definition, end, wide)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, first, n = None, None, 0
        for batch in encoded(batches):
            if not batch.num_rows:
                continue
            if out is None:
                out, first = _Writer(folder, wide, length), batch.column(0)[0].as_py()
            out.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            n += batch.num_rows
        if out is not None:
            name = f"part-{TaskContext.get().partitionId():09d}"
            out.close(name)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "first_id": pa.array([first], pa.int64()), "n_docs": [n], "n_ids": [out.total]})

    return write


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end: int | None = END, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of ``docs`` in ascending order of the key; returns the manifest (file, first_id, n_docs, n_ids, base), a row a file."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "arrow-tokens")
    # The hash lets rows that share an id fill several ranges; texts themselves would go to the driver as samples.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    parts = materialize(ranged.mapInArrow(_write(folder, tokenizer_json(tokenizer), end, length), "file string, first_id long, n_docs long, n_ids long"), "arrow-manifest")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # names count the ranges; a row a file
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


class TokenFile:
    """Random access to one file. Local files are memory-mapped: ``sequence(n)`` is a view into the map."""

    def __init__(self, name: str):
        self.fs, path = _filesystem(name)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        source = pa.memory_map(f"{path}.ids") if local else self.fs.open_input_file(f"{path}.ids")
        self.batches = list(pa.ipc.open_stream(source))
        with self.fs.open_input_file(f"{path}.docs") as f:
            self.docs = pa.ipc.open_stream(f).read_all()
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def _values(self, column: int, at: int) -> pa.Array:
        # A fixed-size list's values are one flat array; slicing keeps the buffer.
        return self.batches[at].column(column).values

    def sequence(self, n: int) -> tuple[np.ndarray, pa.Array]:
        batch, row = divmod(n, SEQUENCES)
        ids = self._values(0, batch).slice(row * self.length, self.length)
        return ids.to_numpy(zero_copy_only=True), self._values(1, batch).slice(row * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids of a stretch; a view if it lies within one batch."""
        step, parts = self.length * SEQUENCES, []
        while n > 0:
            batch, at = divmod(start, step)
            k = min(n, step - at)
            parts.append(self._values(0, batch).slice(at, k).to_numpy(zero_copy_only=True))
            start, n = start + k, n - k
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            f = TokenFile(row["file"])
            for docs in f.docs.to_batches(max_chunksize=4096):
                starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crc = [zlib.crc32(f.ids(int(a), int(n)).astype("<u4").tobytes()) for a, n in zip(starts, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + row["base"]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest; a task a file, however small the manifest's rows are."""
    spread = manifest.select("file", "base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
