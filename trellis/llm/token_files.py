"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

A file is::

    magic, 32 bytes SHA-256 of the dictionary, 1 byte id width, 7 bytes zero
    one zstandard frame per document (its ids as little-endian unsigned integers of that width)
    index: an Arrow stream of (doc_id, offset, size, n_tokens), one row per document
    8 bytes length of the index, magic

so any short document is read with one look at the index and one small frame, and a file cannot be read with
a dictionary other than its own.  The dictionary, ``dictionary-<hash>.zdict``, lies beside the files.

Writing.  Rows are dealt by ranges of the id and sorted there; a task writes files of about ``FILE_BYTES`` under
names of its own attempt and returns their manifest rows.  Only files named in the committed manifest count, so
a lost or repeated attempt leaves nothing that is read.  Where a file's documents start in the whole sequence
follows from the manifest alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.files import open_folder
from trellis.llm.library import encoder, tokenizer
from trellis.llm.memory import held
from trellis.llm.pieces import Pieces
from trellis.llm.shipping import ship
from trellis.session import stage, staging_root

MAGIC = b"TRLSIDS1"
HEADER = struct.Struct("<8s32sB7x")
#: Compressed bytes after which a new file is begun.
FILE_BYTES = 64 << 20
#: Bounds of the sample that the dictionary is trained on: documents, and code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def id_width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _serializer(path: str, width: int) -> Callable[[Iterable[str]], Iterator[bytes]]:
    ids, code = encoder(path), {2: "H", 4: "I"}[width]
    pieces = Pieces(lambda texts: [array(code, i).tobytes() for i in ids(texts)])
    return lambda texts: map(b"".join, pieces.each(texts))


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary for serialized ids; of too few samples, their own bytes."""
    samples = [s for s in samples if len(s) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or bytes(16)


def _compression(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(dictionary)


class FileWriter:
    """One token-id file being written."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int, id_type: pa.DataType):
        fs, base = open_folder(folder)
        self.name, self.id_type = name, id_type
        self.out = fs.open_output_stream(f"{base}/{name}")
        self.out.write(HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_compression(dictionary))
        self.ids, self.offsets, self.sizes, self.counts = [], array("q"), array("q"), array("q")
        self.width, self.at = width, HEADER.size

    def add(self, doc_id, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        for column, value in ((self.ids, doc_id), (self.offsets, self.at), (self.sizes, len(frame)), (self.counts, len(ids) // self.width)):
            column.append(value)
        self.at += len(frame)

    def close(self) -> dict:
        index = pa.table({
            "doc_id": pa.array(self.ids, self.id_type), "offset": np.array(self.offsets), "size": np.array(self.sizes), "n_tokens": np.array(self.counts)
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        packed = sink.getvalue()
        self.out.write(packed)
        self.out.write(struct.pack("<Q", packed.size) + MAGIC)
        self.out.close()
        return {"file": self.name, "n_docs": len(self.ids), "n_tokens": sum(self.counts)}


class FileReader:
    """Random access to the documents of one token-id file."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        fs, base = open_folder(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        magic, digest, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if magic != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a token-id file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        (length,) = struct.unpack("<Q", tail[:8])
        self.index = pa.ipc.open_stream(self.file.read_at(length, size - 16 - length)).read_all()
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_compression(dictionary))
        self.offsets, self.sizes = self.index["offset"].to_numpy(), self.index["size"].to_numpy()

    def ids(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document."""
        frame = self.file.read_at(int(self.sizes[k]), int(self.offsets[k]))
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


class TokenFiles:
    """Written files: folder, dictionary, and the manifest (file, part, seq, n_docs, n_tokens, start)."""

    def __init__(self, folder: str, dictionary: bytes, manifest: DataFrame, id_type: str):
        self.folder, self.dictionary, self.manifest, self.id_type = folder, dictionary, manifest, id_type


def _sample(docs: DataFrame, text: str) -> list[str]:
    """A window of SAMPLE_CHARS from each of at most SAMPLE_DOCS texts; which and where is decided by hash, so from all over the table."""
    n = docs.count()
    drawn = F.xxhash64(text, F.lit(7))
    some = docs.where(F.length(text) > 0)
    if n > 2 * SAMPLE_DOCS:  # about so many rows meet in the last step
        some = some.where(F.pmod(drawn, F.lit(n)) < 2 * SAMPLE_DOCS)
    begin = 1 + F.pmod(F.shiftright(drawn, 7), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS + 1)).cast("int")
    return [r.t for r in some.orderBy(drawn).limit(SAMPLE_DOCS).select(F.substring(text, begin, F.lit(SAMPLE_CHARS)).alias("t")).collect()]


def write_token_files(docs: DataFrame, path: str, *, end_id: int | None = 0, text: str = "text", doc_id: str = "doc_id", folder: str | None = None, file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Encode every whole text with the vocabulary at ``path`` and write the ids in ascending order of ``doc_id``.

    ``end_id`` is appended to each document.  Null and empty texts have no other id.  Null ids come first; rows
    that repeat an id follow each other, ordered by text.  Other columns are ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{staging_root(spark)}/token-files-{uuid.uuid4().hex}"
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    width = id_width(path)
    serialize = _serializer(path, width)
    dictionary = train_dictionary(list(serialize(_sample(docs, text))))
    with fs.open_output_stream(f"{base}/dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict") as out:
        out.write(dictionary)
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes, part, seq, open_file, done = held(("token files", path, width), lambda: _serializer(path, width)), TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for key, ids in zip(batch.column(0), to_bytes(value.as_py() for value in texts)):
                if open_file is None:
                    name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                    open_file = FileWriter(folder, name, dictionary, width, batch.column(0).type)
                open_file.add(key.as_py(), ids + end)
                if open_file.at >= file_bytes:
                    done.append({"part": part, "seq": seq} | open_file.close())
                    open_file, seq = None, seq + 1
        if open_file:
            done.append({"part": part, "seq": seq} | open_file.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = stage(ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_tokens long"))
    # One task over one row a file: enough for some millions of files.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return TokenFiles(folder, dictionary, manifest, picked.schema["doc_id"].dataType.simpleString())


def read_token_files(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    start counts the ids of all documents before it; ids_crc32 is the CRC-32 of its ids as little-endian
    unsigned 32-bit integers.
    """
    folder, dictionary = files.folder, files.dictionary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FileReader(folder, row["file"], dictionary)
                counts = reader.index["n_tokens"].to_numpy()
                starts = row["start"] + np.cumsum(counts) - counts
                crc = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(counts))]
                reader.close()
                table = pa.table({"doc_id": reader.index["doc_id"], "start": starts, "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})
                yield from table.to_batches(10_000)

    n = max(1, files.manifest.count())  # a file a task, or so: the number is given because the rows themselves are tiny
    spread = files.manifest.select("file", "start").repartition(n, "file")
    return spread.mapInArrow(read, f"doc_id {files.id_type}, start long, n_tokens long, ids_crc32 long")
