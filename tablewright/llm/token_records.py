"""Token ids as length-delimited binary records with an offset index.

A record file is a row of frames: length (unsigned 64 bits), masked checksum of the length (32 bits), payload, masked
checksum of the payload. The payload holds the document id (64 bits), a null flag, the width of an id in bytes, and the
token ids. All numbers are little-endian. The checksum is CRC-32, rotated right by 15 bits plus a constant, so that
checksums of data that hold checksums stay useful. Beside it lies an index of the offsets of all frames, which lets
readers fetch records in any order. Tasks write both files to the shared folder under names of their own attempt;
the manifest, written by Spark, names those of the attempts that counted.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.batches import importable, pieces, stored
from tablewright.session import scratch_path

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_DOCUMENT = struct.Struct("<q?B")
# The split of byte-level vocabularies into words, for texts of the letters below. Other texts are encoded
# whole, because Unicode classes differ between libraries.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORDS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\sA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|\s+(?!\S)|\s+"
)
_OTHER = re.compile(rf"[^\x20-\x7e\n\t{_LETTERS}]")
#: Words whose ids a worker remembers before it begins anew.
REMEMBERED = 800_000


def masked(checksum: int) -> int:
    return (((checksum >> 15) | (checksum << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def read_frame(data: memoryview) -> tuple[memoryview, int]:
    """Payload and full size of the frame at the start of ``data``; raises if a checksum differs."""
    length, check = _HEAD.unpack(data[: _HEAD.size])
    if masked(zlib.crc32(data[:8])) != check:
        raise ValueError("the length of a record is damaged")
    payload = data[_HEAD.size : _HEAD.size + length]
    (check,) = struct.unpack("<I", data[_HEAD.size + length : _HEAD.size + length + 4])
    if masked(zlib.crc32(payload)) != check:
        raise ValueError("a record is damaged")
    return payload, _HEAD.size + length + 4


class WordEncoder:
    """A tokenizer that looks up words it has met.

    A byte-level vocabulary with its usual split and no normalization encodes every word by itself, so the ids of a text
    are those of its words in turn. Texts with rare characters or with an added token in them, and all texts of other
    kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        # A task has one core. Threads of the library's own would only wait for each other beside the other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        self.by_word = (
            made.get("normalizer") is None and split.get("type") == "ByteLevel"
            and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        )
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in encoded]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian numbers of ``width`` bytes."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        by_word = [self.by_word and not _OTHER.search(t) and not any(a in t for a in self.added) for t in texts]
        words = [_WORDS.findall(t) if plain else [] for t, plain in zip(texts, by_word)]
        found = [list(map(self.known.get, w)) for w in words]
        # One look-up for each word; only words that it does not find are gathered and encoded together.
        gaps = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        new = list({w[i] for w, g in zip(words, gaps) for i in g})
        if new:
            self.known.update(zip(new, self._whole(new)))
            for w, f, g in zip(words, found, gaps):
                for i in g:
                    f[i] = self.known[w[i]]
        out = [b"".join(f) for f in found]
        whole = [i for i, plain in enumerate(by_word) if not plain]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    own = encoder(tokenizer_path)
    if not 0 <= end_id < 1 << (8 * own.width):
        raise ValueError("the end id does not fit the vocabulary")
    end = end_id.to_bytes(own.width, "little")
    part = TaskContext.get().partitionId()
    store, path = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    out, offsets, at, tokens = None, [0], 0, 0
    for batch in pieces(batches, "text", 2 << 20):
        ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
        frames = []
        for doc_id, row in zip(batch.column("doc_id").to_pylist(), ids):
            row += end
            frames.append(frame(_DOCUMENT.pack(doc_id or 0, doc_id is None, own.width) + row))
            at += len(frames[-1])
            offsets.append(at)
            tokens += len(row) // own.width
        out = out or store.open_output_stream(f"{path}/{name}.rec")
        out.write(b"".join(frames))
    if out:
        out.close()
        with store.open_output_stream(f"{path}/{name}.idx") as index:
            index.write(np.asarray(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": f"{folder}/{name}", "n_records": len(offsets) - 1, "n_tokens": tokens}],
            pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]),
        )


def write_records(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the token ids of ``documents`` (doc_id, text) in ascending doc_id order; returns the manifest.

    Null text is an empty one; every document ends with ``end_id``. A null id comes first and is marked. Rows that repeat
    an id follow each other, by text. Other columns are ignored. The manifest (part, file, n_records, n_tokens,
    first_token) has one row per file, in order; it is empty for an empty table. ``folder`` must be one that all
    executors reach (default: a new one below the shared folder), by a scheme that Arrow's file systems know.
    """
    spark = documents.sparkSession
    importable(spark)
    folder = (folder or scratch_path(spark, "records")).rstrip("/")

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    written = stored(ordered.mapInArrow(lambda b: _write_part(b, folder, tokenizer_path, end_id), "part int, file string, n_records long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _records(store, path: str, shuffle_seed: int | None) -> Iterator[tuple[int, memoryview]]:
    with store.open_input_stream(f"{path}.idx") as index:
        offsets = np.frombuffer(index.read(), "<u8").astype(np.int64)
    sizes = np.diff(offsets)
    if shuffle_seed is None:
        at = 0
        with store.open_input_stream(f"{path}.rec") as stream:
            while at < len(sizes):
                last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20))) - 1)
                block = memoryview(stream.read(int(offsets[last] - offsets[at])))
                for i in range(at, last):
                    yield i, block[offsets[i] - offsets[at] : offsets[i + 1] - offsets[at]]
                at = last
    else:
        with store.open_input_file(f"{path}.rec") as random:
            for i in np.random.default_rng(shuffle_seed).permutation(len(sizes)):
                yield int(i), memoryview(random.read_at(int(sizes[i]), int(offsets[i])))


def _read_files(batches: Iterator[pa.RecordBatch], shuffle_seed: int | None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            store, path = arrow_fs.FileSystem.from_uri(row["file"])
            with store.open_input_stream(f"{path}.idx") as index:
                offsets = np.frombuffer(index.read(), "<u8").astype(np.int64)
            out, held, starts, running = [], 0, None, row["first_token"]
            # Lengths follow from the index, so starts are known before any record is read.
            width = None
            for i, data in _records(store, path, shuffle_seed):
                payload, size = read_frame(data)
                if size != len(data):
                    raise ValueError("the index does not match the records")
                doc_id, missing, width = _DOCUMENT.unpack(payload[: _DOCUMENT.size])
                if starts is None:
                    frame_size = _HEAD.size + 4 + _DOCUMENT.size
                    counts = (np.diff(offsets) - frame_size) // width
                    starts = running + np.concatenate([[0], np.cumsum(counts)[:-1]])
                ids = np.frombuffer(payload[_DOCUMENT.size :], f"<u{width}").astype("<u4").tobytes()
                out.append({"doc_id": None if missing else doc_id, "start": int(starts[i]), "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "ids": ids})
                held += len(ids)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)


def read_records(manifest: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the files of a manifest, every checksum verified.

    ``start`` counts the ids of all documents before, also when ``shuffle_seed`` has each file read in random order by
    its index. ``ids`` are unsigned 32-bit little-endian numbers, of which ``ids_crc32`` is the checksum.
    """
    importable(manifest.sparkSession)

    files = manifest.select("part", "file", "first_token")
    # A task for each file. The rows of a manifest are tiny, so a plain exchange would be merged into one task.
    tasks = (manifest.agg(F.max("part")).first()[0] or 0) + 1
    return files.repartitionById(tasks, "part").mapInArrow(lambda b: _read_files(b, shuffle_seed), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
