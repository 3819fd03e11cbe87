"""Token ids in binary files with one shared zstandard dictionary.

The texts are encoded with a tokenizer file, an end id is appended to each, and the
ids are written in the order of the keys. A folder holds ``dictionary.zdict`` and one
file for each part of the order:

    magic, id width (1 byte), SHA-256 of the dictionary
    one zstandard frame for each document: its ids, little-endian
    index: keys (int64), offsets of the frames (uint64, one more), numbers of ids
    (uint64), one byte for each key that is null
    offset of the index, number of documents (uint64 each), magic

so a short document is read by its own frame (``read_one``). The dictionary is trained
on the ids of at most ``SAMPLE`` documents, chosen by a hash of the key, and at most
``SAMPLE_CHARS`` characters of each; it bears on size only, never on content. Where
there is too little to train on, the sample itself is the dictionary.

Files are written by tasks under a name of their own and renamed when whole, into a
folder that all executors share; a task that runs again writes the same file again.

Cases: null and empty texts are just the end id; null keys come first; rows that share
a key are ordered by text; a repeated row is written each time; an empty table gives
no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earshot.llm import arrow
from earshot.llm.memo import IdTable, Memo
from earshot.session import pin

MAGIC = b"IDFILE01"
SAMPLE = 400
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Texts encoded together are cut after about so many bytes.
TOGETHER_BYTES = 8 << 20
#: Most tasks that read files.
MAX_READERS = 100_000
_END = struct.Struct("<QQ8s")

#: White space, which the normal form makes one space and the word pattern leaves out.
_WHITE = re.compile(r"\s+")
_LATIN = re.compile(r"[\x00-ɏ]*")
#: The word pattern of the tokenizer file, over lower-cased Latin text.
_PART = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:(?!\d)[^\w\s]|_)+")
#: Characters in this range that are numbers or modifiers to one library only.
_MARK = b"\xff\xff\xff\xff"
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")


class WordEncoder:
    """A tokenizer whose words are encoded once and remembered.

    It serves tokenizer files that drop white space between words, so the ids of a text
    are those of its words, one after another. Where a sample shows otherwise, whole
    texts are encoded.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words = IdTable(self._words, 48 << 20)
        self.parts = Memo(self._parts, 80 << 20)
        self.by_word = True
        sample = "It's a TEST, of l'été; 10 words_and a\tü—ß."
        self.by_word = self._whole([sample])[0] == b"".join(self.encode([sample]))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Many parts in one text; the ids that end a word tell them apart."""
        out: list[bytes] = []
        for at in range(0, len(parts), 5000):
            some = parts[at:at + 5000]
            raw = self._whole([" ".join(some)])[0]
            ends = 4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)
            cuts = [0, *ends.tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])] if len(ends) == len(some) else self._whole(some)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Cut into parts all at once; a mark that is no id keeps the words apart."""
        if not words:
            return []
        lines = "\n".join(words)
        if not _PLAIN.fullmatch(lines) or "<|" in lines:
            plain = [bool(_PLAIN.fullmatch(w)) and "<|" not in w for w in words]
            simple = iter(self._words([w for w, ok in zip(words, plain) if ok]))
            other = iter(self._whole([w for w, ok in zip(words, plain) if not ok]))
            return [next(simple) if ok else next(other) for ok in plain]
        parts = _PART.findall(lines.lower())
        known = self.parts.of(set(parts) - {"\n"})
        known["\n"] = _MARK
        raw = b"".join(map(known.__getitem__, parts)).split(_MARK)
        del known["\n"]
        return raw

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        # Four control characters are white space to Python alone.
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        found = self.words.join_all(["" if bad else t for t, bad in zip(texts, odd)])
        return [self._whole([t])[0] if bad else ids for t, bad, ids in zip(texts, odd, found)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder on any store that is shared; Spark may name a local one by ``file:/``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def train_dictionary(docs: DataFrame, tokenizer: str, key: str, text: str) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES`` from a bounded sample of the table."""
    order = F.xxhash64(F.col(key))
    keys = docs.where(F.length(text) > 0).select(F.col(key).alias("_chosen"), order.alias("_order"))
    chosen = keys.orderBy("_order", "_chosen").limit(SAMPLE).distinct()
    rows = (
        docs.join(F.broadcast(chosen), F.col(key) == F.col("_chosen"), "left_semi")
        .select(F.substring(text, 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE).collect()
    )
    samples = [narrow(b) for b in encoder(tokenizer).encode([r.text for r in rows if r.text])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def footer(index: int, documents: int) -> bytes:
    return _END.pack(index, documents, MAGIC)


def narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits; the vocabulary is small enough."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() >= 1 << 16:
        raise ValueError("ids over 65535 need files of another width")
    return wide.astype("<u2").tobytes()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the files; one row for each: ``part, file, n_docs, n_tokens`` (in order of ``part``)."""
    raw = train_dictionary(docs, tokenizer, key, text)
    files, root = open_store(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(raw)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(tokenizer)
        shared = _dictionary(raw)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        end = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        store, base = open_store(folder)
        keys, offsets, counts, nulls = [], [], [], []
        name, draft = f"{base}/part-{part:06d}.ids", f"{base}/.part-{part:06d}.{uuid.uuid4().hex}"
        out = None
        for whole in batches:
            for batch in arrow.cut(whole, TOGETHER_BYTES):
                if not batch.num_rows:
                    continue
                if out is None:
                    out = store.open_output_stream(draft)
                    out.write(MAGIC + bytes([2]) + hashlib.sha256(raw).digest())
                for k, ids in zip(batch.column("key").to_pylist(), held.encode(arrow.strings(batch.column("text")))):
                    keys.append(k or 0)
                    nulls.append(k is None)
                    offsets.append(out.tell())
                    counts.append(len(ids) // 4 + 1)
                    out.write(packer.compress(narrow(ids + end)))
        if out is None:
            return
        index = out.tell()
        for values, kind in ((keys, "<i8"), ([*offsets, index], "<u8"), (counts, "<u8"), (nulls, "u1")):
            out.write(np.array(values, kind).tobytes())
        out.write(footer(index, len(keys)))
        out.close()
        store.move(draft, name)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "file": [os.path.basename(name)],
            "n_docs": [len(keys)], "n_tokens": [sum(counts)],
        })

    rows = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return pin(ordered.mapInArrow(save, "part int, file string, n_docs long, n_tokens long"))


class TokenFile:
    """One file, opened for reading whole or by document."""

    def __init__(self, folder: str, name: str):
        self.files, root = open_store(folder)
        with self.files.open_input_stream(f"{root}/dictionary.zdict") as source:
            raw = source.read()
        self.source = self.files.open_input_file(f"{root}/{name}")
        head = self.source.read(len(MAGIC) + 33)
        if head[:8] != MAGIC or head[9:] != hashlib.sha256(raw).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.width = head[8]
        size = self.source.size()
        self.source.seek(size - _END.size)
        self.index, self.n, magic = _END.unpack(self.source.read(_END.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is cut off")
        self.source.seek(self.index)
        tail = self.source.read(size - _END.size - self.index)
        self.keys = np.frombuffer(tail, "<i8", self.n)
        self.offsets = np.frombuffer(tail, "<u8", self.n + 1, 8 * self.n)
        self.counts = np.frombuffer(tail, "<u8", self.n, 16 * self.n + 8)
        self.nulls = np.frombuffer(tail, "u1", self.n, 24 * self.n + 8)
        shared = _dictionary(raw)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def ids(self, at: int) -> np.ndarray:
        self.source.seek(int(self.offsets[at]))
        frame = self.source.read(int(self.offsets[at + 1] - self.offsets[at]))
        return np.frombuffer(self.unpacker.decompress(frame), f"<u{self.width}").astype("<u4")


def read_one(folder: str, name: str, key: int) -> np.ndarray:
    """The ids of one document, by its frame alone."""
    file = TokenFile(folder, name)
    return file.ids(int(np.flatnonzero((file.keys == key) & (file.nulls == 0))[0]))


def read(folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and the ``ids`` of each document, from the files.

    ``start`` is the number of ids of all documents before; the totals of the files,
    one number for each, give where each file begins.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A stated number of partitions: the rows are few, and would be read by one task else.
    listed = manifest.select(
        "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    ).repartition(max(1, min(MAX_READERS, manifest.count())), "file")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                file = TokenFile(folder, name)
                starts = base + np.cumsum([0, *file.counts[:-1].tolist()])
                for at in range(0, file.n, 256):
                    some = range(at, min(at + 256, file.n))
                    ids = [file.ids(i) for i in some]
                    columns = {
                        "doc_id": pa.array(file.keys[at:some.stop], mask=file.nulls[at:some.stop].astype(bool)),
                        "start": pa.array(starts[at:some.stop], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        ends = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return listed.mapInArrow(load, schema)
