"""Token-ID output: Arrow IPC files of fixed-size-list batches.

Documents are tokenized whole with a public tokenizer (its path is a parameter), closed with the end id,
and joined to one stream per input partition, which is cut into sequences of LENGTH ids; only the last
sequence of a partition is padded, its mask false there. Each partition writes one Arrow file whose record batches hold
BATCH sequences in two fixed-size-list columns, ``input_ids`` (uint16 or int32) and ``mask`` (uint8, a byte an id), so
sequence k is row k % BATCH of batch k // BATCH: a reader maps the file and slices both, without copying (`open_file`).

A task writes to a name of its own and moves it, so a task that runs again or twice leaves one whole file.
Nothing is shuffled. The files go to `out_dir`, on any file system that pyarrow knows by its scheme (file, hdfs, s3, gs, ...); an unknown
scheme is refused before anything runs. The query writes to the folder that spark.checkpoint.dir names. The files are written once, when `write_tokens` is
called; its rows are kept in the shared folder. The vocabulary is read by the driver and sent along, at most MAX_VOCABULARY bytes.

The result has a row for each sequence: (path, batch, row, n_tokens, first_doc, doc_ids, id_sum), with the ids
of the documents that the sequence holds a part of.

Defined results
- null and empty texts give no tokens and are in no sequence. An empty table gives no file and no row.
- null ids are kept as null in doc_ids. Repeated rows are tokenized as often as they occur; there is no order to tie, documents follow each other as in their partition.
- text that looks like a special token is tokenized as ordinary text. A text of any length is written whole.
- a lone surrogate can't occur in a Spark string; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import col, cut, fresh_dir, table, tokenizer_path

LENGTH, BATCH = 2048, 256
SCHEMA = "path string, batch int, row int, n_tokens int, first_doc long, doc_ids array<long>, id_sum long"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


MAX_VOCABULARY = 64 << 20


@functools.lru_cache(maxsize=4)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"[{path}] is larger than a vocabulary that is sent to the executors ({MAX_VOCABULARY} bytes)")
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str):
    """A tiktoken encoding from a file of ranks; its number of ids is the end id."""
    return _encoding(_read(path))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path on it. ValueError for a scheme that isn't known."""
    try:
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    except pa.ArrowInvalid as e:
        raise ValueError(f"no file system for [{uri}]: {e}") from e


def schema_of(length: int, end: int) -> pa.Schema:
    ids = pa.uint16() if end < 1 << 16 else pa.int32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.uint8(), length))], metadata={"end_id": str(end), "length": str(length)})


def _batch(tokens: np.ndarray, schema: pa.Schema, length: int, end: int) -> tuple[pa.RecordBatch, np.ndarray]:
    n = -(-len(tokens) // length)
    ids = np.full(n * length, end, dtype=schema.field(0).type.value_type.to_pandas_dtype())
    ids[: len(tokens)] = tokens
    mask = np.zeros(n * length, dtype=np.uint8)
    mask[: len(tokens)] = 1
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
    return pa.record_batch(lists, schema=schema), ids.reshape(n, length).astype(np.int64).sum(axis=1)


class Sequences:
    """Writes one partition's stream; add() documents, then close(). Yields the rows of the result."""

    def __init__(self, folder: str, name: str, end: int, length: int, batch: int):
        self.path, self.end, self.length, self.batch = f"{folder}/{name}", end, length, batch
        self.fs, where = file_system(folder)
        self.folder, self.name = where, name
        self.schema, self.writer, self.done = schema_of(length, end), None, 0
        self.parts, self.docs, self.ends, self.held = [], [], [], 0

    def add(self, doc, tokens: list[int]):
        self.parts.append(np.array([*tokens, self.end], dtype=np.int64))
        self.held += len(tokens) + 1
        self.docs.append(doc)
        self.ends.append(self.held)
        if self.held >= self.length * self.batch:
            yield from self._write(self.held // (self.length * self.batch) * self.batch * self.length)

    def _write(self, n: int):
        tokens = np.concatenate(self.parts)
        out, rest = tokens[:n], tokens[n:]
        if self.writer is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.part = f"{self.folder}/{self.name}.{uuid.uuid4().hex}"
            self.sink = self.fs.open_output_stream(self.part)
            self.writer = pa.ipc.new_file(self.sink, self.schema)
        ends = np.array(self.ends)
        starts = np.concatenate([[0], ends[:-1]])
        for a in range(0, n, self.length * self.batch):
            data, sums = _batch(out[a : a + self.length * self.batch], self.schema, self.length, self.end)
            self.writer.write_batch(data)
            for k in range(data.num_rows):
                lo = a + k * self.length
                hi = min(lo + self.length, n)
                i, j = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
                ids = self.docs[i:j]
                yield self.path, self.done // self.batch, k, hi - lo, ids[0], ids, int(sums[k])
            self.done += self.batch
        keep = int(np.searchsorted(ends, n, "right"))
        self.docs, self.ends = self.docs[keep:], [int(e) - n for e in ends[keep:]]
        self.parts, self.held = [rest], len(rest)

    def close(self):
        if self.held:
            yield from self._write(self.held)
        if self.writer is not None:
            self.writer.close()
            self.sink.close()
            self.fs.move(self.part, f"{self.folder}/{self.name}")


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Writes the files; a row for each sequence."""
    file_system(out_dir)
    vocabulary = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))

    def run(it):
        enc = _encoding(vocabulary.value)
        out = Sequences(out_dir.rstrip("/"), f"part-{TaskContext.get().partitionId():06d}.arrow", enc.n_vocab, length, batch)
        for data in it:
            for at in range(0, data.num_rows, 256):  # bounds what is tokenized at once
                part = data.slice(at, 256).to_pydict()
                rows = [r for i, t in zip(part["id"], part["text"]) if t for r in out.add(i, enc.encode_ordinary(t))]
                if rows:
                    yield _rows(rows)
        if rows := list(out.close()):
            yield _rows(rows)

    return cut(docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text")).mapInArrow(run, SCHEMA))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class open_file:  # noqa: N801
    """Random access to a token file: file[k] is (ids, mask) of sequence k, both views of the file, which is mapped where it is local."""

    def __init__(self, path: str):
        system, where = file_system(path)
        self.reader = pa.ipc.open_file(pa.memory_map(where) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(where))
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        data = self.reader.get_batch(k // self.batch)
        ids, mask = (data.column(j).slice(k % self.batch, 1).flatten().to_numpy(zero_copy_only=True) for j in (0, 1))
        return ids, mask.view(bool)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), tokenizer_path("byte_bpe_50k.tiktoken"))


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
