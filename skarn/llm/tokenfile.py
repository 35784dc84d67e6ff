"""Token ids as Arrow files of fixed-size-list batches (op 7).

A file holds equal-length rows: ``ids`` (fixed-size list of 16- or 32-bit integers) and
``mask`` (fixed-size list of booleans, false where the last row is filled up). Files are
Arrow's random-access container around its stream format, uncompressed, so any row can
be mapped from a local store without copying. Where documents lie in a file is in its
companion of the same name, ``.index``: id, first id within the file, number of ids.

Documents are dealt to files by ranges of their id; a table of files with running sums
(one row per file) gives the place of every file in the whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.bpe import encoder
from skarn.llm.shared import new_path, qualified, slices, trim, written

#: Ids of a row, rows of a batch, ids after which a task begins another file.
ROW, BATCH_ROWS, FILE_IDS = 2048, 256, 64_000_000


class _Writer:
    """One file and its index, written under their own names; a lost attempt's files are in no table of files."""

    def __init__(self, base: str, width: np.dtype, id_type: pa.DataType, row: int):
        self.row, self.id_type, self.name = row, id_type, f"{uuid.uuid4().hex}"
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        self.fs, self.path = fs, f"{root}/{self.name}"
        self.kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(self.kind, row)), ("mask", pa.list_(pa.bool_(), row))])
        self.sink = fs.open_output_stream(self.path + ".arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest = np.zeros(0, width)
        self.n = 0
        self.first, self.docs = None, 0
        self.places = pa.schema([("key", id_type), ("start", pa.int64()), ("n", pa.int64())])
        self.index_sink = fs.open_output_stream(self.path + ".index")
        self.index = pa.ipc.new_file(self.index_sink, self.places)

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < valid)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.row) for x in (pa.array(ids, self.kind), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        if not self.docs:
            self.first = keys[0].as_py()
        self.index.write_batch(pa.RecordBatch.from_arrays([keys.cast(self.id_type), pa.array(self.n + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64())], schema=self.places))
        self.docs += len(keys)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(self.rest.dtype)])
        step = self.row * BATCH_ROWS
        at = 0
        while len(ids) - at >= step:
            self._batch(ids[at : at + step], step)
            at += step
        self.rest = ids[at:].copy()

    def close(self) -> tuple[str, object, int, int]:
        if len(self.rest):
            full = np.zeros(-(-len(self.rest) // self.row) * self.row, self.rest.dtype)
            full[: len(self.rest)] = self.rest
            self._batch(full, len(self.rest))
        self.out.close()
        self.sink.close()
        self.index.close()
        self.index_sink.close()
        return self.name, self.first, self.docs, self.n


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, to: str | None = None) -> DataFrame:
    """Writes ids of whole texts, each followed by ``end_id``, in ascending order of ``id_col``; returns the table of files.

    Columns: ``dir``, ``name``, ``key`` (first id), ``docs``, ``n``, ``part`` and ``seq`` (place of
    the file), ``base`` (ids in all files before).
    ``to``: a folder that all executors share (by default one in the cluster's shared
    folder). A null text is empty and leaves its end id alone; a null id comes first;
    repeated ids follow each other in the order of a hash of their texts; other columns are left out, whatever
    their names. An empty table writes no file.
    """
    spark = docs.sparkSession
    base = qualified(spark, to or new_path(spark, "token-files"))
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import IntegerType, LongType, StringType, StructType

    arrow_id = to_arrow_type(id_type)
    schema = StructType().add("dir", StringType()).add("name", StringType()).add("key", id_type).add("docs", IntegerType()).add("n", LongType()).add("part", IntegerType()).add("seq", IntegerType())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        width = np.dtype("u2" if len(coder.tokens) <= 65_536 and end_id < 65_536 else "u4")
        made, writer, part = [], None, TaskContext.get().partitionId()
        for b in slices(it):
            for first, after, ids, offsets in coder.encode(b.column(1)):
                writer = writer or _Writer(base, width, arrow_id, row)
                n = after - first
                ended = np.insert(ids, offsets[1:], np.uint32(end_id))
                writer.add(b.column(0).slice(first, n), ended, offsets + np.arange(n + 1))
                if writer.n >= FILE_IDS:
                    made.append(writer.close())
                    writer = None
        if writer:
            made.append(writer.close())
        trim()
        if made:
            name, key, count, total = zip(*made, strict=True)
            columns = [pa.array([base] * len(made)), pa.array(name), pa.array(key, arrow_id), pa.array(count, pa.int32()), pa.array(total, pa.int64())]
            places = [pa.array([part] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *places], schema.names)

    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(F.col(text_col))]  # the hash parts rows of an id that very many have
    ordered = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    files = written(ordered.mapInArrow(batches, schema), "token-file-table")
    # One row per file, of which a corpus has one for every 64 million ids or task.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: id, ``start``, ``n_tokens``, ``ids_crc32``. One file at a time, row batch by row batch."""
    schema = files.select(F.col("key").alias(id_col)).schema.add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for f in b.to_pylist():
                fs, root = pyarrow.fs.FileSystem.from_uri(f["dir"])
                with fs.open_input_file(f"{root}/{f['name']}.index") as source:
                    index = pa.ipc.open_file(source).read_all()
                starts, counts = (index.column(c).to_numpy() for c in ("start", "n"))
                crcs, doc, crc, at = np.zeros(len(starts), np.int64), 0, 0, 0
                with fs.open_input_file(f"{root}/{f['name']}.arrow") as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        batch = reader.get_batch(k)
                        valid = int(batch.column(1).flatten().true_count)
                        ids = batch.column(0).flatten().to_numpy()[:valid].astype("<u4")
                        while doc < len(starts) and starts[doc] < at + len(ids):
                            end = starts[doc] + counts[doc]
                            crc = zlib.crc32(ids[max(0, starts[doc] - at) : end - at].tobytes(), crc)
                            if end > at + len(ids):
                                break
                            crcs[doc], doc, crc = crc, doc + 1, 0
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([index.column("key").combine_chunks(), pa.array(starts + f["base"]), pa.array(counts), pa.array(crcs)], schema.names)

    # A number of parts of our own: the table is small, and what lies behind its rows is not.
    return files.select("dir", "name", "key", "base").repartition(max(1, files.count()), "name").mapInArrow(batches, schema)


def sequences(files: DataFrame) -> DataFrame:
    """``row`` (number within the whole, file after file), ``ids array<int>``, ``mask array<boolean>`` of every equal-length row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for f in b.to_pylist():
                fs, root = pyarrow.fs.FileSystem.from_uri(f["dir"])
                with fs.open_input_file(f"{root}/{f['name']}.arrow") as source:
                    reader = pa.ipc.open_file(source)
                    at = 0
                    for k in range(reader.num_record_batches):
                        batch = reader.get_batch(k)
                        n = batch.num_rows
                        lists = [batch.column(0).cast(pa.list_(pa.int32())), batch.column(1).cast(pa.list_(pa.bool_()))]
                        yield pa.RecordBatch.from_arrays([pa.array([f["name"]] * n), pa.array(np.arange(at, at + n)), *lists], ["name", "row", "ids", "mask"])
                        at += n

    return files.select("dir", "name").mapInArrow(batches, "name string, row long, ids array<int>, mask array<boolean>")
