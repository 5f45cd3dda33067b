"""Token ids in length-delimited binary records, with a separate offset index.

A file starts with ``MAGIC`` and one byte, the bytes of an id (2 or 4). Each record is framed as

    length     8 bytes, little endian
    checksum   4 bytes, masked CRC-32 of the length's bytes
    payload    1 byte 1 for a null document id, else 0; 8 bytes document id; the ids
    checksum   4 bytes, masked CRC-32 of the payload

and has an entry of fixed size in the file's index: offset, payload length, document id, null flag,
number of ids. A reader that wants records in any order, such as a shuffled epoch, needs the index and
then one ranged read per record. The mask rotates the checksum and adds a constant, so that a record
that itself holds framed records doesn't confuse a reader.

Documents are dealt by ranges of ascending id. Each task sorts its range and writes one file under a
name of its own; the manifest that counts is written when all have finished, so tasks may be lost and
run again. A null text is the empty one and gives just the end id; null document ids come first. Rows
that repeat an id are dealt to as many files as they need, ordered by the first 64 characters of their text, then its
length, then its hash. Further columns are not written; without documents there is no file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.llm.common import fresh_folder, host_threads, output_name, stage, store, text_of

MAGIC = b"TOKENREC"
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
HEAD = struct.Struct("<?q")
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("null_id", "u1"), ("n_ids", "<u4")])
MASK = 0xA282EAD8
#: Different pieces whose ids a task remembers.
REMEMBERED = 300_000
MANIFEST = "part int, path string, records long, ids long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole record; raises if a length or checksum is wrong."""
    if len(data) < 16:
        raise ValueError("a record is cut off")
    length, payload = data[:8], data[12:-4]
    if CHECK.unpack(data[8:12])[0] != masked(length) or LENGTH.unpack(length)[0] != len(payload):
        raise ValueError("a record's length is damaged")
    if CHECK.unpack(data[-4:])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def payload_of(document: int | None, ids: np.ndarray) -> bytes:
    return HEAD.pack(document is None, document or 0) + ids.tobytes()


# How the public word tokenizer normalizes and splits, and the part of it that PIECE restates.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of printable ASCII, Latin-1 letters and common white space: normalizing them is lower-casing, and PIECE splits like SPLIT.
PLAIN = re.compile(r"[\x20-\x7E\t\n\r\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[!-/:-@\[-`{-~]+")
MARK = "<|"  # may begin a special token, which is looked for before anything else


def _byte_characters() -> list[str]:
    """The visible character that a byte-level tokenizer has for each byte: itself, or one from 256 on."""
    seen = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    others = [c for c in range(256) if c not in seen]
    return [chr(c) if c in seen else chr(256 + others.index(c)) for c in range(256)]


BYTES = str.maketrans(dict(enumerate(_byte_characters())))


class WordEncoder:
    """Encodes texts piece by piece and remembers the ids of pieces that come again.

    For tokenizers that drop white space and never join what stands on both sides of it: the ids of a
    text are then those of its pieces between spaces, tabs and line ends. With the public word tokenizer,
    plain texts are split here, and only the pieces not seen yet go through the tokenizer's model; all
    other texts, and all texts of other tokenizers, are cut at white space, and what is new takes the
    tokenizer's whole way. When the memory is full, pieces that only one text had are forgotten.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = tokenizer, remembered
        parts = json.loads(tokenizer.to_str())
        splitter = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = (
            parts["normalizer"] == NORMALIZER
            and [p.get("type") for p in splitter] == ["Split", "ByteLevel"]
            and splitter[0]["pattern"] == {"Regex": SPLIT}
            and not splitter[1]["add_prefix_space"]
            and not splitter[1]["use_regex"]
            and all(t["content"].startswith(MARK) for t in parts["added_tokens"])
        )
        self.model = tokenizer.model
        self.number: dict[str, int] = {}
        self.again = np.zeros(remembered, dtype=bool)
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.start = np.zeros(remembered + 1, dtype=np.int64)  # of each piece; the next one's start is its end

    def encode(self, text: str) -> np.ndarray:
        plain = self.known and PLAIN.fullmatch(text) is not None and MARK not in text
        if plain:
            pieces = PIECE.findall(text.lower())
        else:
            pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        step = self.remembered // 2
        parts = [self._some(pieces[at : at + step], plain) for at in range(0, len(pieces), step)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def _some(self, pieces: list[str], plain: bool) -> np.ndarray:
        new = list(set(pieces).difference(self.number))
        if len(self.number) + len(new) > self.remembered:
            self._forget()
            new = list(set(pieces).difference(self.number))
        known = len(self.number)
        if new:
            self._learn(new, plain)
        which = np.array(list(map(self.number.__getitem__, pieces)), dtype=np.int64)
        self.again[which[which < known]] = True
        start = self.start[which]
        size = self.start[which + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]

    def _learn(self, pieces: list[str], plain: bool) -> None:
        if plain:
            found = [[token.id for token in self.model.tokenize(_visible(piece))] for piece in pieces]
        else:
            found = [encoding.ids for encoding in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._add(pieces, [id_ for ids in found for id_ in ids], np.array([len(ids) for ids in found]))

    def _add(self, pieces: list[str], ids: list[int] | np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self.number), int(self.start[len(self.number)])
        end = at + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat[:at], np.empty(2 * end, dtype=np.uint32)))
        self.flat[at:end] = ids
        self.start[n + 1 : n + 1 + len(pieces)] = at + np.cumsum(sizes)
        self.number.update(zip(pieces, range(n, n + len(pieces))))

    def _forget(self) -> None:
        kept = np.flatnonzero(self.again)[: self.remembered // 2]
        pieces, start = list(self.number), self.start
        ids = [self.flat[start[k] : start[k + 1]] for k in kept]
        sizes = start[kept + 1] - start[kept]
        self.number = {}
        self.again[:] = False
        self._add([pieces[k] for k in kept], np.concatenate([np.empty(0, dtype=np.uint32), *ids]), sizes)


def _visible(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)


@once
def encoder(path: str) -> WordEncoder:
    host_threads()
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_file(path))


def write_records(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    *,
    end_id: int,
    id_bytes: int = 2,
    files: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode and write all documents in ascending id order; gives the staged manifest, a row per file.

    ``tokenizer`` is a tokenizers file that drops white space; each document gets ``end_id`` appended.
    An id that doesn't fit into ``id_bytes`` raises.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "records")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.dtype(f"<u{id_bytes}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, limit = encoder(tokenizer), np.iinfo(kind).max
        out, name, entries, offset = None, "", [], len(MAGIC) + 1
        system, path = store(folder)
        for batch in batches:
            ids_column, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                if out is None:
                    system.create_dir(path, recursive=True)
                    name = output_name("ids")
                    out = system.open_output_stream(f"{path}/{name}.rec", compression=None)
                    out.write(MAGIC + bytes([id_bytes]))
                document = ids_column[i].as_py()
                ids = np.append(coder.encode(texts[i].as_py()), np.uint32(end_id))
                if ids.max() > limit:
                    raise ValueError(f"id {ids.max()} needs more than {id_bytes} bytes")
                record = frame(payload_of(document, ids.astype(kind)))
                out.write(record)
                entries.append((offset, len(record) - 16, document or 0, document is None, len(ids)))
                offset += len(record)
        if out is not None:
            out.close()
            index = np.array(entries, dtype=ENTRY)
            with system.open_output_stream(f"{path}/{name}.idx", compression=None) as stream:
                stream.write(index.tobytes())
            part = TaskContext.get().partitionId()
            rows = [[part], [f"{folder}/{name}"], [len(index)], [int(index["n_ids"].sum())], [offset]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *map(pa.array, rows[1:])], names=["part", "path", "records", "ids", "bytes"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    # The last column tells equal rows apart, which may be many, so that a range can end between them.
    order = [F.col("doc_id"), F.substring("text", 1, 64), F.length("text"), F.xxhash64("text"), F.col("row")]
    ordered = kept.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    return stage(ordered.drop("row").mapInArrow(write, MANIFEST), "records-manifest")


def _index(path: str) -> np.ndarray:
    system, local = store(f"{path}.idx")
    with system.open_input_stream(local, compression=None) as stream:
        return np.frombuffer(stream.read(), dtype=ENTRY)


def _ids(payload: bytes, id_bytes: int) -> tuple[int | None, np.ndarray]:
    null_id, document = HEAD.unpack_from(payload)
    return None if null_id else document, np.frombuffer(payload, dtype=f"<u{id_bytes}", offset=HEAD.size)


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids in all files before; a row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record from the files: document id, the ids before it, its number of ids, their CRC-32.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, whatever the file's width.
    Frames, checksums and the index are verified on the way.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                index, rows = _index(uri), []
                system, path = store(f"{uri}.rec")
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    head = stream.read(len(MAGIC) + 1)
                    if head[:-1] != MAGIC:
                        raise ValueError(f"{uri} isn't a record file")
                    for entry in index:
                        document, ids = _ids(unframe(stream.read(int(entry["length"]) + 16)), head[-1])
                        if len(ids) != entry["n_ids"] or (document or 0) != entry["doc_id"]:
                            raise ValueError(f"the index of {uri} doesn't fit")
                        rows.append((document, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    if stream.read(1):
                        raise ValueError(f"the index of {uri} is too short")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    spread = file_starts(manifest).repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def record_index(manifest: DataFrame) -> DataFrame:
    """One row per record: its file, offset, length and document id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                index = _index(uri)
                columns = [
                    pa.array([uri] * len(index), pa.string()),
                    pa.array(index["offset"].astype(np.int64)),
                    pa.array(index["length"].astype(np.int64)),
                    pa.array(index["doc_id"].astype(np.int64), mask=index["null_id"].astype(bool)),
                    pa.array(index["n_ids"].astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "offset", "length", "doc_id", "n_ids"])

    return manifest.select("path").mapInArrow(read, "path string, offset long, length long, doc_id long, n_ids long")


def read_shuffled(manifest: DataFrame, seed: int, parts: int) -> DataFrame:
    """Whole records, ``doc_id`` and ``ids``, in a random order that depends on the seed alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                system, path = store(f"{uri}.rec")
                with system.open_input_file(path) as stream:
                    id_bytes = stream.read_at(1, len(MAGIC))[0]
                    found.append(_ids(unframe(stream.read_at(length + 16, offset)), id_bytes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype(np.int64) for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "ids"],
            )

    key = F.md5(F.concat_ws("|", F.lit(seed), "path", "offset"))
    shuffled = record_index(manifest).withColumn("_key", key).repartition(parts, "_key").sortWithinPartitions("_key")
    return shuffled.mapInArrow(read, "doc_id long, ids array<long>")
