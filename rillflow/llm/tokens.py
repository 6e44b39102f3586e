"""Token ids of whole texts in files of directly addressable codes, in ascending order of doc_id.

Null texts are empty; every document ends with the end id. Null doc_ids come first; rows of equal
doc_id lie next to each other, by a hash of their text, and may be spread over several files. Texts of
any length are encoded whole. An empty table writes no file. Only doc_id and text are read, whatever
other columns there are; doc_id is an integer.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dac
from .common import filesystem, fresh_path, written
from .tokenizer import encoder

FILE_IDS = 4 << 20
TEXTS = 1024  # encoded at once


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes and writes; returns the manifest (part, file, path, n_docs, n_ids), itself a written table.

    Files have unique names, and the manifest lists only those of tasks that were committed, so
    repeated and speculative tasks do no harm. A worker holds one file of FILE_IDS ids, or one text.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")

    def task(batches):
        part, run, file = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        encode = encoder(tokenizer).encode_many
        end = np.array([end_id], "<u4").tobytes()
        ids, doc_ids, sizes, total = [], [], [], 0

        def flush():
            name = f"part-{part:06d}-{file:06d}-{run}.dac"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(dac.encode(np.frombuffer(b"".join(ids), "<u4"), doc_ids, np.concatenate([[0], np.cumsum(sizes)])))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(doc_ids)], "n_ids": [total]})

        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                some = batch.slice(first, TEXTS)
                for doc_id, own in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    ids += [own, end]
                    doc_ids.append(doc_id)
                    sizes.append(len(own) // 4 + 1)
                    total += sizes[-1]
                    if total >= FILE_IDS:
                        yield flush()
                        ids, doc_ids, sizes, total, file = [], [], [], 0, file + 1
        if doc_ids:
            yield flush()

    # the hash and the row's number keep rows of one doc_id, or of none, from meeting in one task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("doc_id", "text").mapInArrow(task, "part int, file int, path string, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, addressed one by one in the files that the manifest lists."""

    def task(batches):
        for batch in batches:
            for path, first in zip(*(batch.column(i).to_pylist() for i in range(2))):
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as f:
                    reader = dac.Reader(f.read())
                at = reader.starts
                crc = [zlib.crc32(reader.slice(a, b).astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(reader.doc_ids, pa.int64()), "start": pa.array(first + at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_base"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    files = manifest.select("part", "path", before.alias("_before")).join(parts, "part").select("path", (F.col("_base") + F.col("_before")).alias("first"))
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
