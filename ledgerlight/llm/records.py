"""Token ids as length-delimited binary records with a separate offset index.

A shard ``part-00000.rec`` holds one record per document, in ascending id order:

    length   8 bytes, little-endian
    check    4 bytes, masked crc32 of the length
    payload  the document's ids, little-endian, 2 bytes each if the vocabulary allows it, else 4
    check    4 bytes, masked crc32 of the payload

``part-00000.idx`` has 24 bytes per record: document id, byte offset of the
record, number of ids. A reader that shuffles takes records in any order by
the index; one that reads straight through needs only the lengths. A checksum
is masked (rotated and moved by a constant) so that checksums of data that
hold checksums stay useful. The polynomial is that of zlib.

Shards are consecutive id ranges, so a document's first id in the whole is the
sum of the shards before it and of the records before it. A shard is written
under a name of the task's own and then moved, so a repeated or lost task
leaves whole files only. A folder is written once.

Null texts count as empty and have the end id alone. Missing ids come first and
are stored as the smallest long. Documents with equal ids follow each other in
order of their texts. An empty table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import documents, wide
from ledgerlight.llm.ordered import bounds, part_of
from ledgerlight.llm.tokens import encoder
from ledgerlight.session import settle

#: Chunks that a worker remembers in each of two generations, some 150 MB in all.
CACHE_ENTRIES = 500_000
# Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
NO_ID = -(1 << 63)
HEAD, CHECK, ENTRY = "<QI", "<I", "<qqq"


def masked(data: bytes) -> int:
    check = zlib.crc32(data)
    return (((check >> 15) | (check << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return struct.pack(HEAD, len(payload), masked(length)) + payload + struct.pack(CHECK, masked(payload))


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class _Shard:
    """One shard while it is written."""

    def __init__(self, store: fs.FileSystem, folder: str, number: int):
        self.store, self.name = store, f"{folder}/part-{number:05d}"
        self.own = f"{folder}/_{uuid.uuid4()}"
        self.records = store.open_output_stream(f"{self.own}.rec")
        self.index = store.open_output_stream(f"{self.own}.idx")
        self.number, self.documents, self.tokens, self.bytes = number, 0, 0, 0

    def add(self, doc_id: int | None, payload: bytes, tokens: int) -> None:
        framed = frame(payload)
        self.records.write(framed)
        self.index.write(struct.pack(ENTRY, NO_ID if doc_id is None else doc_id, self.bytes, tokens))
        self.documents, self.tokens, self.bytes = self.documents + 1, self.tokens + tokens, self.bytes + len(framed)

    def close(self) -> tuple[int, int, int]:
        self.records.close()
        self.index.close()
        for kind in ("rec", "idx"):
            self.store.move(f"{self.own}.{kind}", f"{self.name}.{kind}")
        return self.number, self.documents, self.tokens


def _written(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder, shard, done = encoder(path, CACHE_ENTRIES), None, []
    end = np.array([end_id], coder.kind).tobytes()
    store, place = _folder(folder)
    for batch in batches:
        for number, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if shard is None or shard.number != number:
                if shard:
                    done.append(shard.close())
                shard = _Shard(store, place, number)
            payload = coder.encode(text.as_py()) + end
            shard.add(doc_id, payload, len(payload) // coder.width)
    if shard:
        done.append(shard.close())
    columns = list(zip(*done)) if done else [()] * 3
    yield pa.record_batch([pa.array(list(x), pa.int64()) for x in columns], ["shard", "documents", "tokens"])


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write shards to ``folder``, which all executors share: shard, documents, tokens of each."""
    rows = documents(docs, id_col, text_col)
    cuts = bounds(rows)
    store, place = _folder(folder)
    store.create_dir(place, recursive=True)
    dealt = (
        rows.select(part_of(F.col("doc_id"), cuts).alias("shard"), "doc_id", "text")
        .repartitionById(max(wide(docs.sparkSession), len(cuts) + 1), F.col("shard"))
        .sortWithinPartitions("shard", "doc_id", "text")
    )
    shards = dealt.mapInArrow(
        partial(_written, folder=folder, path=tokenizer, end_id=end_id), "shard long, documents long, tokens long"
    )
    return settle(shards)


def read_index(store: fs.FileSystem, name: str) -> list[tuple[int | None, int, int]]:
    with store.open_input_stream(f"{name}.idx") as file:
        return [(None if d == NO_ID else d, at, n) for d, at, n in struct.iter_unpack(ENTRY, file.read())]


def _take(file, at: int) -> bytes:
    head = file.read(struct.calcsize(HEAD))
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError(f"the length of the record at {at} is damaged")
    payload = file.read(length)
    if struct.unpack(CHECK, file.read(struct.calcsize(CHECK)))[0] != masked(payload):
        raise ValueError(f"the record at {at} is damaged")
    return payload


def read_record(folder: str, shard: int, at: int, width: int = 2) -> np.ndarray:
    """The ids of one record by its offset."""
    store, place = _folder(folder)
    with store.open_input_file(f"{place}/part-{shard:05d}.rec") as file:
        file.seek(at)
        return np.frombuffer(_take(file, at), f"<u{width}")


def _read(
    batches: Iterator[pa.RecordBatch], folder: str, width: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    store, place = _folder(folder)
    types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(types)
        return pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, types)], names)

    for batch in batches:
        for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name, rows = f"{place}/part-{shard:05d}", []
            with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as file:
                for doc_id, at, count in read_index(store, name):
                    ids = np.frombuffer(_take(file, at), f"<u{width}")
                    if len(ids) != count:
                        raise ValueError(f"the index of {name} doesn't fit its records")
                    row = (doc_id, start, count, zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.tolist()) if with_ids else row)
                    start += count
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)


def read_records(
    spark: SparkSession, folder: str, shards: DataFrame, width: int = 2, with_ids: bool = False
) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every record, shard by shard.

    ``shards`` is what ``write_records`` returned: one row per shard, summed up
    in shard order for the first id of each.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return starts.repartitionById(wide(spark), F.pmod("shard", F.lit(wide(spark))).cast("int")).mapInArrow(
        partial(_read, folder=folder, width=width, with_ids=with_ids), schema
    )
