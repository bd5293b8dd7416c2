"""Token ids in Huffman-coded files.

Texts are encoded with a public tokenizer and an end id is appended to each. Counts of all ids give one
canonical length-limited code for the table. Documents are dealt into ranges of their id, sorted, and
written in blocks that can be read by themselves: a block lists its documents, their numbers of ids and
a bit offset for every ``STEP`` ids, so a reader decodes all stretches of a block side by side from one
lookup table. What crosses the network is the coded form.

File: magic, then blocks. Block: header (bytes of each part, as 5 little-endian unsigned 64-bit
integers: documents, ids, checkpoints, bytes of code, checksum), doc_ids (int64), null flags (uint8),
ids per document (uint64), first byte of each document (uint64), checkpoints (uint64, bits from the
document's first byte), code.

A null text is an empty one and gives the end id alone. Null ids sort first. Rows that repeat an id are
documents of their own, ordered by their coded form. Other columns are ignored; an empty table gives no
files and no rows. A word's ids are found once and kept in a memory of bounded size; that changes
nothing in the result, as the tokenizer splits at blanks before all else.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfold.llm import huffman
from fleetfold.llm.common import stored, wide_enough
from fleetfold.llm.files import borders, filesystem, read_files, shard_count, shard_of, write_sharded

END_ID = 1
MAGIC = b"HUFTOK01"
HEADER = struct.Struct("<5Q")
BLOCK_IDS = 1 << 20
FILE_BYTES = 64 << 20
SHARD_ROWS = 20_000
CHUNKS, WORDS = 150_000, 400_000  # entries kept of chunks between blanks, and of words
DOCUMENTS = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids BINARY"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class WordEncoder:
    """ids of whole texts as little-endian bytes (``dtype``), from the tokenizers library.

    For tokenizers that drop blanks and look at each run of letters by itself. A chunk between blanks
    is encoded as it is; one that is Latin letters followed by ASCII punctuation is put together from its
    two parts, which such a tokenizer never joins. Other letters are left with what follows them, as
    composing or lower-casing may end them in a mark that belongs with punctuation (U+0130 is one).
    """

    _PARTS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:-;=?-@\\[-`{}~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._model = self._tokenizer.model
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        # What the model gets for a small Latin letter, where that is all the steps before it do: words of such
        # letters go to the model at once.
        letters = [chr(c) for c in range(0x180) if self._PARTS.fullmatch(chr(c)) and chr(c).islower()]
        before = self._tokenizer.pre_tokenizer
        self._mapped = {ord(c): "".join(piece for piece, _ in before.pre_tokenize_str(c)) if before else c for c in letters}
        self._direct = {c for c in letters if all(self._whole(w) == self._plain(w) for w in (c, f"x{c}y", f"the{c}", f"{c}the"))}

    def _whole(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.translate(self._mapped)
        return np.array([t.id for t in self._model.tokenize(mapped)], dtype=self.dtype).tobytes()

    def _plain(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = self._whole(word) if self._direct.issuperset(word) else self._plain(word)
            if len(self._words) < WORDS:
                self._words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        parts = self._PARTS.fullmatch(chunk)
        if parts is None:
            found = self._plain(chunk)
        else:
            letters, marks = parts.groups()
            found = self._word(letters.lower()) + (self._word(marks) if marks else b"")
        if len(self._chunks) < CHUNKS:
            self._chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        # Blanks to str.split, but none to the tokenizer.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._plain(text)
        known, get = self._chunk, self._chunks.get
        return b"".join([get(c) or known(c) for c in text.split()])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): ids of each text as bytes (see ``WordEncoder``), end id included."""
    end = np.asarray([end_id], dtype=encoder(path).dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            out = [own.encode(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wide_enough(texts).mapInArrow(run, "doc_id BIGINT, ids BINARY")


def id_counts(ids: DataFrame, dtype: str = "<u4") -> np.ndarray:
    """How often each id occurs in all documents: one row per id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype)
            more = np.bincount(flat, minlength=len(total))
            more[: len(total)] += total
            total = more
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(total[known], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id BIGINT, n BIGINT").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r[0] for r in rows), default=-1) + 1, dtype=np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


def _coded(ids: DataFrame, lengths: np.ndarray, dtype: str) -> DataFrame:
    """(doc_id, n, marks, code): each document coded from a byte border."""
    known = huffman.codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            for at in range(0, size, 256):
                part = batch.slice(at, 256)
                raw = part.column(1).to_pylist()
                counts = np.array([len(x) // np.dtype(dtype).itemsize for x in raw], dtype=np.int64)
                data, begin, marks = huffman.pack(np.frombuffer(b"".join(raw), dtype=dtype), counts, lengths, known)
                cuts = np.concatenate([[0], np.cumsum((counts + huffman.STEP - 1) // huffman.STEP)])
                marks = marks.astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(counts, pa.int64()),
                        pa.array([marks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        pa.array([data[a:b] for a, b in zip(begin[:-1], begin[1:])], pa.binary()),
                    ],
                    names=["doc_id", "n", "marks", "code"],
                )

    return ids.mapInArrow(run, "doc_id BIGINT, n BIGINT, marks BINARY, code BINARY")


def block(rows: list[tuple]) -> bytes:
    doc_ids = np.array([r[0] or 0 for r in rows], dtype="<i8").tobytes()
    nulls = bytes(r[0] is None for r in rows)
    counts = np.array([r[1] for r in rows], dtype="<u8").tobytes()
    first = np.cumsum([0] + [len(r[3]) for r in rows[:-1]]).astype("<u8").tobytes()
    marks, code = b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)
    body = doc_ids + nulls + counts + first + marks + code
    return HEADER.pack(len(rows), sum(r[1] for r in rows), len(marks) // 8, len(code), zlib.crc32(body)) + body


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, file_bytes: int = FILE_BYTES, shard_rows: int = SHARD_ROWS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode docs (doc_id, text) into files below a folder every executor reaches; returns the manifest."""
    ids = stored(encoded(docs, tokenizer), "ids")
    dtype = encoder(tokenizer).dtype
    lengths = huffman.code_lengths(id_counts(ids, dtype))
    _save_lengths(folder, lengths)
    shards = shard_count(ids.count(), shard_rows)
    edges = borders(ids, "doc_id", shards)
    rows = _coded(ids, lengths, dtype).withColumn("shard", shard_of(F.col("doc_id"), edges))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        shard, number, size, held, n = None, 0, 0, [], 0
        for batch in batches:
            for *row, s in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (s != shard or n >= block_ids):
                    piece = (MAGIC if size == 0 else b"") + block(held)
                    size += len(piece)
                    last = s != shard or size >= file_bytes
                    yield shard, number, piece, len(held), n, last
                    number, size = (0, 0) if s != shard else (number + 1, 0) if last else (number, size)
                    held, n = [], 0
                held.append(row)
                shard, n = s, n + row[1]
        if held:
            yield shard, number, (MAGIC if size == 0 else b"") + block(held), len(held), n, True

    return write_sharded(rows, folder, shards, ["doc_id", "code"], encode, ".huf")


def _save_lengths(folder: str, lengths: np.ndarray) -> None:
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/code_lengths") as out:
        out.write(zlib.compress(lengths.tobytes()))


def load_lengths(folder: str) -> np.ndarray:
    store, root = filesystem(folder)
    with store.open_input_stream(f"{root}/code_lengths") as stream:
        return np.frombuffer(zlib.decompress(stream.read()), dtype=np.uint8)


def read_block(stream: io.RawIOBase, ids: np.ndarray, bits: np.ndarray) -> tuple | None:
    """(doc_ids, counts, ids) of the next block, None at the end."""
    head = stream.read(HEADER.size)
    if not head:
        return None
    docs, total, marks, size, checksum = HEADER.unpack(head)
    body = stream.read(docs * 25 + marks * 8 + size)
    if zlib.crc32(body) != checksum:
        raise ValueError("damaged block")
    cut = iter(np.cumsum([0, docs * 8, docs, docs * 8, docs * 8, marks * 8, size]))
    a, parts = next(cut), []
    for b in cut:
        parts.append(body[a:b])
        a = b
    doc_ids = [None if null else int(i) for i, null in zip(np.frombuffer(parts[0], "<i8"), parts[1])]
    counts, first = np.frombuffer(parts[2], "<u8").astype(np.int64), np.frombuffer(parts[3], "<u8").astype(np.int64)
    segments = -(-counts // huffman.STEP)
    starts = np.frombuffer(parts[4], "<u8").astype(np.int64) + np.repeat(first * 8, segments)
    sizes = np.full(marks, huffman.STEP, dtype=np.int64)
    ends = np.cumsum(segments) - 1
    filled = counts > 0
    sizes[ends[filled]] = counts[filled] - (segments[filled] - 1) * huffman.STEP
    return doc_ids, counts, huffman.unpack(parts[5], starts, sizes, ids, bits)


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files in a manifest, from the files alone (``DOCUMENTS``; ids as uint32 bytes)."""
    lengths = load_lengths(folder)
    # One row per file: how many ids stand before it.
    before = F.sum("units").over(Window.orderBy("shard", "number")) - F.col("units")

    def decode(stream: io.RawIOBase, row: dict) -> Iterator[pa.RecordBatch]:
        ids, bits = _table(lengths.tobytes())
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        start = row["before"]
        while (found := read_block(stream, ids, bits)) is not None:
            doc_ids, counts, flat = found
            raw = memoryview(flat.astype("<u4").tobytes())
            ends = np.cumsum(counts)
            pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
            crcs = [zlib.crc32(p) for p in pieces]
            held = [bytes(p) for p in pieces] if with_ids else [None] * len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(crcs, pa.int64()), pa.array(held, pa.binary())], schema=_READ,
            )
            start += int(ends[-1])

    return read_files(manifest, folder, decode, DOCUMENTS, before=before)


@lru_cache(maxsize=1)
def _table(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    return huffman.table(np.frombuffer(lengths, dtype=np.uint8))
