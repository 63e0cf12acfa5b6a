"""Token ids in length-delimited binary record files, with a separate offset index for shuffled reads.

A record: the length of its payload (64 bits, little-endian), a masked checksum of the length (32 bits), the payload, a masked checksum
of the payload. The checksum is CRC-32; masked: turned right by 15 bits, plus 0xA282EAD8. A payload: whether the document has an id (one
byte), its id (64 bits), the width of a token id in bytes (one byte, 2 or 4), then the token ids, little-endian. The index of a
file has the offset of each record, as 64-bit numbers in record order.

Documents are range-partitioned by id, so files in the order of their partitions have them in ascending order of id. Each task
writes one file under a name of its own attempt into the shared folder; the manifest, which Spark commits, names the files that count,
so a lost or repeated task leaves at most a file that nobody reads.

A null text is empty: its record has the end id alone. Null ids come first. Rows of one id follow each other by a hash of their text. An
empty table writes no file. A damaged record is an error that names file and offset.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import tokens
from corpuslens.llm.common import parallel_paths, written
from corpuslens.session import scratch_path

END_ID = 2
HEAD = 12
MANIFEST = "part long, file string, index string, documents long, ids long, bytes long"


def masked(data: bytes) -> int:
    """Checksum of some bytes, masked so that a checksum of data with checksums in it stays useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


KEY = "<?qB"


def payload(key: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return struct.pack(KEY, key is not None, key or 0, width) + ids.astype(f"<u{width}").tobytes()


def content(data: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and token ids of a payload."""
    known, key, width = struct.unpack_from(KEY, data)
    return key if known else None, np.frombuffer(data, f"<u{width}", offset=struct.calcsize(KEY)).astype("<u4")


def read_record(stream, where: str) -> bytes | None:
    """The next payload of a file, or None at its end."""
    head = stream.read(HEAD)
    if not head:
        return None
    if len(head) < HEAD or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"{where}: damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    data, tail = stream.read(size), stream.read(4)
    if len(data) < size or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(data):
        raise ValueError(f"{where}: damaged record")
    return data


def read_at(file: str, index: str, number: int) -> tuple[int | None, np.ndarray]:
    """Content of one record, found through the index: what a shuffled reader does."""
    system, path = parallel_paths(index)
    with system.open_input_file(path) as f:
        f.seek(8 * number)
        at = struct.unpack("<Q", f.read(8))[0]
    system, path = parallel_paths(file)
    with system.open_input_file(path) as f:
        f.seek(at)
        return content(read_record(f, f"{file} at {at}"))


def write(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write record files and indexes below folder; their manifest, one row a file, in ascending order of part."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ids_type = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = system = data = None
        part = TaskContext.get().partitionId()
        offsets, at, n_ids = [], 0, 0
        for batch in batches:
            encoder = tokens.encoder(tokenizer)
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for first, last in tokens.in_parts(texts):
                if data is None:
                    system, base = parallel_paths(folder)
                    system.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}"
                    data = system.open_output_stream(f"{base}/{name}.records", compression=None)
                block = []
                for key, ids in zip(keys[first:last], encoder.encode(texts[first:last])):
                    ids = np.append(ids, np.uint32(end_id))
                    record = frame(payload(key, ids))
                    offsets.append(at)
                    at += len(record)
                    n_ids += len(ids)
                    block.append(record)
                data.write(b"".join(block))
        if data is not None:
            data.close()
            with system.open_output_stream(f"{base}/{name}.index", compression=None) as f:
                f.write(np.array(offsets, "<u8").tobytes())
            row = [[part], [f"{folder}/{name}.records"], [f"{folder}/{name}.index"], [len(offsets)], [n_ids], [at]]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "file", "index", "documents", "ids", "bytes"])

    if ids_type.simpleString() not in ("bigint", "int"):
        raise ValueError("record files hold integer ids")
    return written(source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files. The manifest has a row for each file."""
    files = sorted(manifest.select("part", "file", "ids").collect())
    starts = accumulate((r["ids"] for r in files), initial=0)
    rows = [(r["file"], start) for r, start in zip(files, starts)]
    listed = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(batch.column(i).to_pylist() for i in range(2))):
                system, path = parallel_paths(file)
                keys, starts, counts, crcs = [], [], [], []
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    while (data := read_record(stream, file)) is not None:
                        key, ids = content(data)
                        keys.append(key)
                        starts.append(start)
                        counts.append(len(ids))
                        crcs.append(zlib.crc32(ids.tobytes()))
                        start += len(ids)
                        if len(keys) == 10_000:
                            yield _rows(keys, starts, counts, crcs)
                            keys, starts, counts, crcs = [], [], [], []
                yield _rows(keys, starts, counts, crcs)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer, scratch_path(spark, "records"), doc_id, text, end_id))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
