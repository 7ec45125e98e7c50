"""Token ids as length-delimited binary records with a separate offset index.

Documents are range-partitioned by id, so shard k holds smaller ids than shard k + 1. A shard
is two files under one folder:

* ``records-KKKKKK.bin``: for each document, as in common record files,
  length (uint64) | masked checksum of those 8 bytes (uint32) | payload | masked checksum of the
  payload (uint32). The payload is has_key (uint8), bytes per id (uint8), key (int64), ids.
* ``records-KKKKKK.idx``: for each record its offset and payload length (two uint64).

All numbers are little-endian. The checksum is CRC-32 as in zlib, rotated right by 15 bits plus
a constant, so that checksums of data that holds checksums stay useful. Files are written under
a name of their task attempt and then renamed: a repeated or lost task cannot leave half a file
under the final name, and repeats write the same bytes.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage, shared_folder

#: Added to a rotated checksum.
MASK_DELTA = 0xA282EAD8
_FRAME, _CHECK, _HEAD, _INDEX = "<Q", "<I", "<BBq", "<QQ"
#: Entries that a Python worker remembers before it starts afresh; memory only, no effect on ids.
CHUNKS, WORDS = 300_000, 500_000
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
_ALL_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split only
_PROBES = ("To be, or not?", "Ça été (déjà) vu.", "It's 42... ÀB#c", "x\n\ty  z", "")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# --- encoding -----------------------------------------------------------------------------

class Encoder:
    """Texts to packed ids. Where a tokenizer drops white space and treats words apart, each
    distinct word is encoded once; this is verified on probes, and any text with characters
    outside the verified ones is encoded whole."""

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        self.spec, self.tokenizer = spec, Tokenizer.from_str(spec)
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.end = np.array([end_id], self.kind).tobytes()
        added = [x["content"] for x in json.loads(spec).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        # workers serve many tasks: what they have encoded stays with the process
        store = sys.modules.setdefault("_token_record_words", types.ModuleType("store")).__dict__
        self.chunks, self.words = store.setdefault(hash(spec), ({}, {}))
        self.bytes_as = self._byte_letters()
        self.apart = all(self._by_words(p) == self._whole(p) for p in _PROBES)

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Code points that stand for byte values in byte-level models, as Latin-1 code points."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                        self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            shown = word if word.isascii() else "".join(map(self.bytes_as.get, word.encode()))
            found = self.words[word] = np.array(
                [t.id for t in self.tokenizer.model.tokenize(shown)], self.kind).tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        if len(self.chunks) >= CHUNKS:
            self.chunks.clear()
        found = self.chunks[chunk] = (
            b"".join(map(self._word, _PLAIN.findall(chunk.lower())))
            if _ALL_PLAIN.fullmatch(chunk) else self._whole(chunk))
        return found

    def _by_words(self, text: str) -> bytes:
        get, make = self.chunks.get, self._chunk
        return b"".join([get(c) or make(c) for c in text.split()])

    def __call__(self, text: str | None) -> bytes:
        """The ids of the whole text and the end id, packed. A null is an empty text."""
        if not text:
            return self.end
        if not self.apart or _SEPARATORS.search(text) or (
                self.special and self.special.search(text)):
            return self._whole(text) + self.end
        return self._by_words(text) + self.end


# --- writing ------------------------------------------------------------------------------

def write_token_records(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str,
                        end_id: int, folder: str | None = None) -> DataFrame:
    """Write the records in ascending order of id; one row per shard.

    (shard, bin, idx, n_records, n_ids, start): start is the number of ids in all shards
    before. Rows without an id come first with has_key 0; rows that share an id stay together,
    ordered by a hash of the text and then by the text. A null text is one end id. Empty
    tables write no file and give no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "records")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    ranks = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("id"), ranks).sortWithinPartitions(
        F.col("id"), ranks, F.col("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode, out, offset, n_records, n_ids = Encoder(spec.value, end_id), None, 0, 0, 0
        files, root = _files(folder)
        final = [f"{root}/records-{shard:06d}.{kind}" for kind in ("bin", "idx")]
        mine = [f"{name}.{uuid.uuid4().hex}" for name in final]
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(root, recursive=True)
                out = [files.open_output_stream(name) for name in mine]
            for key, text in zip(batch.column(0), batch.column(1)):
                key, ids = key.as_py(), encode(text.as_py())
                payload = struct.pack(_HEAD, key is not None, encode.width, key or 0) + ids
                size = struct.pack(_FRAME, len(payload))
                out[0].write(b"".join((size, struct.pack(_CHECK, masked(size)), payload,
                                       struct.pack(_CHECK, masked(payload)))))
                out[1].write(struct.pack(_INDEX, offset, len(payload)))
                offset += len(payload) + 16
                n_records += 1
                n_ids += len(ids) // encode.width
        if out:
            for stream, name, last in zip(out, mine, final):
                stream.close()
                files.move(name, last)
            names = [f"{folder}/{name.rpartition('/')[2]}" for name in final]
            yield pa.record_batch({
                "shard": pa.array([shard], pa.int64()), "bin": [names[0]], "idx": [names[1]],
                "n_records": pa.array([n_records], pa.int64()),
                "n_ids": pa.array([n_ids], pa.int64())})

    shards = cut_lineage(ordered.mapInArrow(
        write, "shard long, bin string, idx string, n_records long, n_ids long"))
    # one row per shard: a few bytes for each file, so one task can add them up
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


# --- reading ------------------------------------------------------------------------------

def _payload(frame: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    size, check = frame[:8], struct.unpack_from(_CHECK, frame, 8)[0]
    payload, end = frame[12:-4], struct.unpack_from(_CHECK, frame, len(frame) - 4)[0]
    if masked(size) != check or masked(payload) != end:
        raise ValueError(f"broken record at byte {offset}")
    has_key, width, key = struct.unpack_from(_HEAD, payload)
    return (key if has_key else None), np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD))


def read_in_order(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each record, read from front to back.

    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit numbers. Every length
    and checksum is verified, and a shard must hold as many records as its index.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _files(row["bin"])
                start, offset, rows = row["start"], 0, []
                with files.open_input_stream(path) as f:
                    while head := f.read(12):
                        size = struct.unpack_from(_FRAME, head)[0]
                        key, ids = _payload(head + f.read(size + 4), offset)
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start, offset = start + len(ids), offset + size + 16
                if len(rows) != row["n_records"]:
                    raise ValueError(f"{path} holds {len(rows)} of {row['n_records']} records")
                yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(
                    ("key", "start", "n_tokens", "ids_crc32"), zip(*rows))})

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").mapInArrow(
        read, "key long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(spark: SparkSession, shards: DataFrame, seed: int) -> DataFrame:
    """(key, ids) in an order drawn from the seed, fetched through the offset indexes.

    The order is a hash of shard, record and seed: rows are range-partitioned by it, and each
    task reads single records at their offsets, in that order.
    """
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _files(row["idx"])
                with files.open_input_stream(path) as f:
                    table = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                yield pa.record_batch({
                    "bin": pa.array([row["bin"]] * len(table), pa.string()),
                    "offset": pa.array(table[:, 0]), "length": pa.array(table[:, 1])})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened, keys, ids = {}, [], []
            for row in batch.to_pylist():
                files, path = _files(row["bin"])
                f = opened.get(path) or opened.setdefault(path, files.open_input_file(path))
                f.seek(row["offset"])
                key, found = _payload(f.read(row["length"] + 16), row["offset"])
                keys.append(key)
                ids.append(found.astype(np.int64))
            for f in opened.values():
                f.close()
            yield pa.record_batch({"key": pa.array(keys, pa.int64()),
                                   "ids": pa.array(ids, pa.list_(pa.int64()))})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64(F.col("bin"), F.col("offset"), F.lit(seed))
    listed = shards.select("bin", "idx").mapInArrow(entries, "bin string, offset long, length long")
    return (listed.repartitionByRange(n, order).sortWithinPartitions(order)
            .mapInArrow(fetch, "key long, ids array<long>"))
