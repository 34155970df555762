"""Token counts from flat token files without an index, by scanning for the end-of-document identifier."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.secrets import encoding
from tidemark.session import durable, work_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The identifier that is free in that vocabulary and ends a document.
END = 50256
#: Tokens are little-endian unsigned 16-bit numbers.
WIDTH = 2
#: Tokens of a block that one task scans at a time.
BLOCK_TOKENS = 1 << 22
#: Characters of a text that are tokenised at once (cut before white space, where no token spans).
TEXT_BLOCK = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def token_blocks(text: str, vocabulary: str) -> Iterator[np.ndarray]:
    """Identifiers of a text's tokens, a block at a time.

    A block ends before a single space that follows a letter and precedes one: there the vocabulary's pattern always begins a
    new piece. A text without such a place is one block.
    """
    codec, start = encoding(vocabulary), 0
    while start < len(text):
        stop = start + TEXT_BLOCK
        while stop < len(text) and not (text[stop] == " " and text[stop - 1].isalpha() and text[stop + 1 : stop + 2].isalpha()):
            stop += 1
        yield codec.encode_to_numpy(text[start:stop], disallowed_special=())
        start = stop


def write_tokens(
    docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write flat token files in the shared folder; return ``(path, ordinal, doc_id, tokens)``.

    Each task writes one file: the tokens of its documents, each followed by ``end``. A row with ordinal -1 gives the number
    of tokens in a file, the others tell which document is which of a file. Names are unique to an attempt, and only
    files of attempts that succeeded are listed, so lost executors leave nothing wrong behind.
    """
    folder = folder or work_folder(docs.sparkSession, "tokens")
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tokens"
        path, ordinal, tokens = f"{folder}/{name}", 0, 0
        closing = np.array([end], "<u2").tobytes()
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for text in batch.column(1):
                    for block in token_blocks(text.as_py() or "", vocabulary):
                        out.write(block.astype("<u2").tobytes())
                        tokens += len(block)
                    out.write(closing)
                    tokens += 1
                n = batch.num_rows
                places = pa.array(range(ordinal, ordinal + n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), places, batch.column(0), pa.nulls(n, pa.int64())], schema=schema)
                ordinal += n
        yield pa.RecordBatch.from_pylist([{"path": path, "ordinal": -1, "doc_id": None, "tokens": tokens}], schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return durable(rows.mapInArrow(run, "path string, ordinal long, doc_id long, tokens long"), "token-manifest")


def _ends(blocks: DataFrame, end: int) -> DataFrame:
    """``(path, start, ends)``: the places of the identifier in each block, found by one vectorised comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = _open(row["path"])
                with store.open_input_file(name) as file:
                    data = file.read_at((row["stop"] - row["start"]) * WIDTH, row["start"] * WIDTH)
                found = np.flatnonzero(np.frombuffer(data, "<u2") == end) + row["start"]
                arrays = [pa.array([row["path"]]), pa.array([row["start"]], pa.int64()), pa.array([found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "start", "ends"])

    return blocks.mapInArrow(run, "path string, start long, ends array<long>")


def _cut(files: DataFrame, block_tokens: int) -> tuple[DataFrame, int]:
    """``(path, start, stop)`` for each block of the files, and how many tasks to spread them over."""
    blocks = files.agg(F.sum(F.ceil(F.col("tokens") / block_tokens))).first()[0]
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens).cast("long"))
    cut = files.where("tokens > 0").select("path", "tokens", F.explode(starts).alias("start"))
    stop: Column = F.least(F.col("start") + block_tokens, F.col("tokens"))
    return cut.select("path", "start", stop.alias("stop")), max(1, min(int(blocks or 0), 20_000))


def scan(files: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(path, ordinal, start, n_tokens)`` for each document of the flat files ``(path, tokens)``.

    Tasks look for ``end`` in blocks of ``block_tokens``. Where a document crosses blocks, a prefix scan over the blocks of its file (one
    narrow row each) gives the number of documents that ended before and the place after the last of them. The closing
    identifier isn't counted. Tokens after the last one are no document. Empty files and no files give no rows.
    """
    cut, tasks = _cut(files, block_tokens)
    found = durable(_ends(cut.repartition(tasks), end), "token-ends")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("ends")
    carried = found.select(
        "path",
        "start",
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max(F.element_at("ends", F.when(size > 0, F.lit(-1)))).over(before) + 1, F.lit(0)).alias("open"),
    )
    last = F.when(F.col("place") == 0, F.col("open")).otherwise(F.get("ends", F.col("place") - 1) + 1)
    rows = found.join(carried, ["path", "start"]).select("path", "earlier", "open", "ends", F.posexplode("ends").alias("place", "stop"))
    return rows.select(
        "path", (F.col("earlier") + F.col("place")).alias("ordinal"), last.alias("start"), (F.col("stop") - last).alias("n_tokens")
    )


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` for each row: documents are written to flat token files, which are then scanned.

    Null and empty texts have no tokens. Special strings in a text are ordinary text. Repeated rows are returned as often as they come, rows
    without an id keep a null; an empty table gives no rows, other columns are not read.
    """
    listed = write_tokens(docs, None, vocabulary, end, id_col, text_col)
    counts = scan(listed.where("ordinal < 0").select("path", "tokens"), end)
    return listed.where("ordinal >= 0").select("path", "ordinal", "doc_id").join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
