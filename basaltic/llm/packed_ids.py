"""Token ids in fixed-width bit packing: a file format, its writer and reader, and the distributed build of a store.

A store is a folder of shard files and a manifest. Shards in the manifest's order hold the documents by ascending doc_id.

    shard   := magic "BPKD", u8 version, u8 bits, u16 zero, u32 ids in a block, u64 ids, u64 documents,
               blocks, u64 offset of each block, i64 doc_id (lowest value: null), u64 start, u64 ids of each document,
               u64 place of the block offsets, magic
    block   := its ids, each in `bits` bits, lowest bit first, filled up to whole bytes

All numbers are little-endian. `bits` is the least that the vocabulary's ids fit in. Ids a to b are found from the blocks
a // size to (b - 1) // size alone, and a block is unpacked by numpy in one go.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.llm.common import KEPT_CHARS, map_arrow, partitions_of, shared_dir, texts_of, tool
from basaltic.llm.splitting import PAIRS, SURELY_CUT, splitter, sure_cuts

MAGIC, VERSION, HEAD = b"BPKD", 1, struct.Struct("<4sBBHIQQ")
#: Ids in a block (a multiple of 8, so blocks fill whole bytes), distinct parts in each of a worker's two memories, ids read at once,
#: parts in a line for the library, bytes of a part that is long, parts asked for or put in place at once, bytes of text encoded at once.
BLOCK, MEMO, AT_ONCE, LINE, LONG, SOME, GROUP = 4096, 250_000, 1 << 20, 64, 4096, 1 << 16, 8_000_000
NULL_ID = -(1 << 63)


def width(vocabulary: int) -> int:
    """Bits for ids below the vocabulary's size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.zeros((count, 32), "u1")
    spread[:, :bits] = np.unpackbits(np.frombuffer(data, "u1"), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Writes one shard as a stream; holds one block and the document table."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.place, self.ids = HEAD.size, 0
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.waiting = 0
        sink.write(HEAD.pack(MAGIC, VERSION, bits, 0, block, 0, 0))  # the true counts stand in the tail

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, self.ids, len(ids)))
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * self.block:
            self._flush(self.waiting - self.waiting % self.block)

    def _flush(self, count: int) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        packed = pack(every[:count], self.bits)
        step = self.block * self.bits // 8
        self.offsets += range(self.place, self.place + len(packed), step)
        self.sink.write(packed)
        self.place += len(packed)
        self.held, self.waiting = [every[count:]], len(every) - count

    def close(self) -> tuple[int, int]:
        """Ends the shard; (ids, documents)."""
        self._flush(self.waiting)
        table = np.array(self.docs, np.int64).reshape(-1, 3)
        tail = np.array(self.offsets, "<u8").tobytes() + b"".join(np.ascontiguousarray(table[:, k]).astype("<i8").tobytes() for k in range(3))
        self.sink.write(tail + struct.pack("<QQQ4s", self.ids, len(self.docs), self.place, MAGIC))
        return self.ids, len(self.docs)


class Shard:
    """Random access to one shard through an open, seekable file."""

    def __init__(self, source):
        self.source = source
        magic, version, self.bits, _, self.block, _, _ = HEAD.unpack(source.read_at(HEAD.size, 0))
        size = source.size()
        self.ids, self.n_docs, at, end = struct.unpack("<QQQ4s", source.read_at(28, size - 28))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a whole shard of this format")
        tail = np.frombuffer(source.read_at(size - 28 - at, at), "<i8")
        blocks = -(-self.ids // self.block)
        self.offsets = [*tail[:blocks].tolist(), at]
        self.doc_ids, self.starts, self.counts = tail[blocks:].reshape(3, self.n_docs)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids first to last, without the last."""
        if last <= first:
            return np.zeros(0, "<u4")
        lo, hi = first // self.block, (last - 1) // self.block
        data = self.source.read_at(self.offsets[hi + 1] - self.offsets[lo], self.offsets[lo])
        count = min(self.ids, (hi + 1) * self.block) - lo * self.block
        return unpack(data, count, self.bits)[first - lo * self.block : last - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k] + self.counts[k]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start within the shard, ids) of every document, reading many at once."""
        k = 0
        while k < self.n_docs:
            first = int(self.starts[k])
            to = max(k + 1, int(np.searchsorted(self.starts, first + AT_ONCE)))
            ids = self.read(first, int(self.starts[to - 1] + self.counts[to - 1]))
            for i in range(k, to):
                at = int(self.starts[i]) - first
                doc = int(self.doc_ids[i])
                yield None if doc == NULL_ID else doc, int(self.starts[i]), ids[at : at + int(self.counts[i])]
            k = to


class Encoder:
    """The tokenizers library, asked for distinct parts of many texts at a time, with the ids of parts remembered. Texts are cut where the
    pattern surely ends a match, so the library gives a part the same ids alone as in its text; by another pattern, at all of its
    matches. A text that holds a special string goes to the library whole."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern, self.sure = splitter(pattern), pattern == SURELY_CUT
        self.in_lines = self.sure and not any(" " in s or "\n" in s for s in self.special)
        self.bits = width(self.library.get_vocab_size(with_added_tokens=True))
        self.memo: dict[bytes, bytes] = {}  # parts met lately; a full one becomes the elder, from which those met again come back
        self.elder: dict[bytes, bytes] = {}
        self.bytes_in = np.zeros(1 << self.bits, np.int64)  # of each id; the vocabulary spells a byte with one letter
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes_in[i] = len(token)

    def _ask(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct parts. Most go to the library in lines, which it cuts before a space or a newline that something
        visible follows, as it would apart; the byte lengths of the ids then say which belong to which part. Long ones, for which the
        library takes much room, are cut at all matches first."""
        out: dict[bytes, bytes] = {}
        for p in parts:
            if len(p) > LONG and len(matches := self.pattern.findall(text := p.decode())) > 1 and "".join(matches) == text:
                matches = [m.encode() for m in matches]
                out[p] = b"".join(map(self._ask(list(dict.fromkeys(matches))).__getitem__, matches))
        if out:
            parts = [p for p in parts if p not in out]
        if self.in_lines:
            led = [p for p in parts if p[0] == 0x20 and len(p) > 1 and PAIRS[0x20 | p[1] << 8] & 2]
            bare = [p for p in parts if PAIRS[0x0A | p[0] << 8] & 8]  # these get a newline before them, which is one id
            spelled = led + [b"\n" + p for p in bare]
            lines = [b"".join(spelled[at : at + LINE]).decode() for at in range(0, len(spelled), LINE)]
            ids = np.array([i for e in self.library.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
            token_ends, ends = np.cumsum(self.bytes_in[ids]), np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
            after = np.searchsorted(token_ends, ends)
            if spelled and after[-1] == len(ids) - 1 and (token_ends[after] == ends).all():
                raw, cuts = ids.tobytes(), [0, *(4 * after + 4).tolist()]
                out.update((p, raw[a:b]) for p, a, b in zip(led, cuts, cuts[1:]))
                out.update((p, raw[a + 4 : b]) for p, a, b in zip(bare, cuts[len(led) :], cuts[len(led) + 1 :]))
        apart = [p for p in parts if p not in out]
        for p, e in zip(apart, self.library.encode_batch_fast([p.decode() for p in apart], add_special_tokens=False)):
            out[p] = np.array(e.ids, "<u4").tobytes()
        return out

    def _starts(self, texts: list[str], data: bytes, ends: np.ndarray) -> np.ndarray:
        if self.sure:
            return sure_cuts(data, ends)
        parts = [p for text in texts for p in self.pattern.findall(text)]
        if "".join(parts) != "".join(texts):  # there is text that the pattern doesn't match: nothing is cut
            return np.unique(ends[:-1][np.diff(ends) > 0])
        at = np.cumsum([0, *(len(p.encode()) for p in parts)])
        return np.unique(at[at < len(data)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Equal parts of all texts are looked up or learnt once."""
        whole = {k: text for k, text in enumerate(texts) if any(s in text for s in self.special)}
        cut = ["" if k in whole else text for k, text in enumerate(texts)] if whole else texts
        raw = [text.encode() for text in cut]
        data, ends = b"".join(raw), np.cumsum([0, *map(len, raw)])
        starts = self._starts(cut, data, ends)
        offsets = np.append(starts, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self._look_up(parts.dictionary.to_pylist())
        ids, counts = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        which, first = parts.indices.to_numpy(), np.cumsum(counts) - counts
        at = np.cumsum(np.append(0, counts[which]))  # where the ids of each part come to stand
        every = np.empty(at[-1], "<u4")
        for lo in range(0, len(which), SOME):
            some, to = which[lo : lo + SOME], at[lo : lo + SOME + 1]
            every[to[0] : to[-1]] = ids[np.repeat(first[some] - to[:-1], np.diff(to)) + np.arange(to[0], to[-1])]
        cuts = at[np.searchsorted(starts, ends)].tolist()
        out = [every[a:b] for a, b in zip(cuts, cuts[1:])]
        for k, e in zip(whole, self.library.encode_batch_fast(list(whole.values()), add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4")
        return out

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        found, elder = list(map(self.memo.get, parts)), self.elder
        missing = [p for p, i in zip(parts, found) if i is None]
        new = {p: elder[p] for p in missing if p in elder}
        unknown = [p for p in missing if p not in new]
        for at in range(0, len(unknown), SOME):
            new.update(self._ask(unknown[at : at + SOME]))
        kept = [p for p in missing if len(p) <= KEPT_CHARS]
        for at in range(0, len(kept), MEMO):
            some = kept[at : at + MEMO]
            if len(self.memo) + len(some) > MEMO:
                self.memo, self.elder = {}, self.memo
            self.memo.update((p, new[p]) for p in some)
        return [new[p] if i is None else i for p, i in zip(parts, found)]


def groups_of(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """doc_ids and texts of a batch's rows by groups of GROUP bytes of text, or of one longer text."""
    first, size = 0, 0
    for k, more in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if size and size + (more or 0) > GROUP:
            yield batch.column("doc_id").slice(first, k - first).to_pylist(), texts_of(batch.slice(first, k - first))
            first, size = k, 0
        size += more or 0
    if first < batch.num_rows:
        yield batch.column("doc_id").slice(first).to_pylist(), texts_of(batch.slice(first))


def build(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 0) -> list[tuple[int, str, int, int, int]]:
    """Encodes every whole text, appends end_id, and writes a store to the folder, a URI that all executors reach.

    Rows are dealt by ranges of doc_id and of the text's hash and sorted, then encoded and written as they stream by. Each task attempt writes
    files of its own name, and the manifest names those of the attempts that succeeded, so a lost executor leaves at most
    unused files. Returns the manifest's rows: (shard, file, first id's number in the store, ids, documents); it has one
    row for each shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink = name = writer = None
        coder = tool(Encoder, path, pattern)
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            if writer is None and batch.num_rows:
                part = TaskContext.get().partitionId()
                name = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}.bits"
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(name)
                writer = ShardWriter(sink, coder.bits)
            for ids, texts in groups_of(batch):
                for doc, got in zip(ids, coder.encode(texts)):
                    writer.add(doc, np.append(got, np.uint32(end_id)))
        if writer is not None:
            ids, count = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": part, "file": name, "ids": ids, "docs": count}], pa.schema([("shard", pa.int64()), ("file", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))

    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))  # by which rows of one id are dealt to several shards
    dealt = rows.repartitionByRange(partitions_of(rows), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    made = sorted(map_arrow(dealt, write, "shard long, file string, ids long, docs long").collect())
    manifest, start = [], 0
    for shard, name, ids, count in made:
        manifest.append((shard, name, start, ids, count))
        start += ids
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps([dict(zip(("shard", "file", "start", "ids", "docs"), m)) for m in manifest]).encode())
    return manifest


def read_back(spark: SparkSession, folder: str, manifest: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of a store, from its files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["file"]) as f:
                    held = [(doc, row["start"] + start, len(ids), zlib.crc32(ids.tobytes())) for doc, start, ids in Shard(f).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame([m[1:3] for m in manifest], "file string, start long")
    if manifest:
        shards = shards.repartition(len(manifest))
    return map_arrow(shards, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed(docs: DataFrame, path: str, pattern: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Builds a store in the shared folder and returns what its files say of each document.

    A null text counts as empty and has the end id alone. A null doc_id stands before all others; repeated ids keep their
    rows, by the hash of their text. Other columns are left out. An empty table makes a store without shards and no rows.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/basaltic/packed-{uuid.uuid4().hex}"
    if "://" not in folder and folder.startswith("file:/"):
        folder = "file://" + folder[5:]
    elif folder.startswith("/"):
        folder = "file://" + folder
    return read_back(spark, folder, build(docs, folder, path, pattern, end_id))
