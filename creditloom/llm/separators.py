"""Document boundaries in flat token files without an index.

A file is a row of fixed-width token ids in which one id ends each document.  Files are read in blocks
by range, so a file may be of any size; each block is searched for the id with one vector comparison.  A prefix
scan over the blocks' summaries (separators so far, place of the last one) then gives every block what
it needs to number and measure its documents, also those that began many blocks earlier.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .encode import encoder

BLOCK_TOKENS = 1 << 20
FILES = "file string, bytes long"
BLOCKS = "file string, block long, first long, tokens long, ends binary, n_ends long, last long"


def opened(uri: str):
    """File system and path of an address: local, HDFS, S3 or GCS, whatever Arrow can open in a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def token_writer(folder: str, tokenizer: str, end: int, width: int):
    """Task function: the tokens of a partition's texts as one flat file, named after the partition and the attempt.

    A task that runs again writes a file of its own; only files named by the rows that come out count.
    """
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        kind = f"<u{width}"
        mark = np.array([end], kind).tobytes()
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        encode, size = encoder(tokenizer), 0
        with system.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                for text in batch.column(0).cast(pa.large_string()).cast(pa.large_binary()):
                    ids = np.frombuffer(encode.ids(text.as_py() or b""), "<u4")
                    if (ids == end).any():
                        raise ValueError(f"token {end} occurs in a text and cannot end documents")
                    data = ids.astype(kind).tobytes() + mark
                    out.write(data)
                    size += len(data)
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["file", "bytes"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int, width: int = 2) -> DataFrame:
    """Flat token files of the texts of ``docs``, one for each partition: file, bytes.

    Each row is its ids and the end id; NULL, empty and blank texts are the end id alone.  The end id must be one that no
    text gives, such as one beyond the vocabulary; a text that holds it is an error, never two documents.
    """
    files = docs.select("text").mapInArrow(token_writer(folder, tokenizer, end, width), FILES)
    return written(files.where("bytes > 0"), "token-files")


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes of a folder that any program has written."""
    from pyarrow import fs

    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path))
    rows = [(f"{folder}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(".")]
    return spark.createDataFrame(rows, FILES)


def scanner(end: int, width: int):
    """Task function: each block's number of tokens and the places of its separators, counted from the file's start."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for file, block, first, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                system, path = opened(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(tokens * width, first * width)
                ids = np.frombuffer(data, f"<u{width}")
                if len(ids) != tokens:
                    raise OSError(f"{file}: {len(ids)} tokens at {first}, expected {tokens}")
                ends = np.flatnonzero(ids == end) + first
                last = int(ends[-1]) if len(ends) else None
                columns = [file, block, first, tokens, ends.astype("<i8").tobytes(), len(ends), last]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                names = ["file", "block", "first", "tokens", "ends", "n_ends", "last"]
                yield pa.record_batch([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def stitched(batches):
    """Task function: the documents that end in each block, and the open rest of a file's last block."""
    import pyarrow as pa

    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            row = {n: c[r] for n, c in columns.items()}
            ends = np.frombuffer(row["ends"], "<i8")
            begin = row["last_end"] + 1
            start = np.concatenate(([begin], ends[:-1] + 1))[: len(ends)]
            size, closed = ends - start, np.ones(len(ends), bool)
            after = ends[-1] + 1 if len(ends) else begin
            if row["is_last"] and row["first"] + row["tokens"] > after:
                start, size = np.append(start, after), np.append(size, row["first"] + row["tokens"] - after)
                closed = np.append(closed, False)
            number = row["docs_before"] + np.arange(len(start))
            yield pa.record_batch(
                [pa.array([row["file"]] * len(start), pa.string()), *(pa.array(x, pa.int64()) for x in (number, start, size)), pa.array(closed)],
                names=["file", "doc", "start", "n_tokens", "closed"],
            )


def count_tokens(files: DataFrame, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc, start, n_tokens, closed of every document of flat token files.

    ``files`` needs file and bytes; other columns are ignored, NULL and empty files give nothing.  doc counts from 0 in each
    file, start and n_tokens are in tokens without separators; documents may be empty.  Tokens after a file's last separator are a
    document that is not closed.  A file whose size is no multiple of the token width is an error; repeated files are read once.
    """
    size = F.col("bytes").cast("long")
    files = files.where(F.col("file").isNotNull() & (size > 0)).select("file", size.alias("bytes")).distinct()
    odd = files.where(F.col("bytes") % width != 0).select("file").first()
    if odd:
        raise ValueError(f"{odd.file} is no row of {width}-byte tokens")
    total = F.expr(f"bytes div {width}")
    blocks = files.select("file", total.alias("total"), F.posexplode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(block_tokens).cast("long"))).alias("block", "first"))
    blocks = blocks.select("file", F.col("block").cast("long").alias("block"), "first", F.least(F.lit(block_tokens), F.col("total") - F.col("first")).alias("tokens"))
    blocks = blocks.repartition("file", "block")
    found = written(blocks.mapInArrow(scanner(end, width), BLOCKS), "blocks")
    before = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    scanned = found.select(  # numbers only: the places of the separators stay out of the window
        "file",
        "block",
        F.expr(f"coalesce(sum(n_ends) {before}, 0)").alias("docs_before"),
        F.expr(f"coalesce(last(last, true) {before}, -1)").alias("last_end"),
        F.expr("lead(block) OVER (PARTITION BY file ORDER BY block) IS NULL").alias("is_last"),
    )
    scanned = found.select("file", "block", "first", "tokens", "ends").join(scanned, ["file", "block"])
    scanned = scanned.select("file", "first", "tokens", "ends", "docs_before", "last_end", "is_last")
    return scanned.mapInArrow(stitched, "file string, doc long, start long, n_tokens long, closed boolean")
