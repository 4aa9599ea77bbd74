"""Token ids as Simple-8b words in files.

A 64-bit word holds a selector in its high 4 bits and up to 60 ids of one width in the others.
Selector 0 is an escape: the next word is one id of 60 bits or more.  Selector 1 is not used.  A block
is up to ``BLOCK`` ids; no word crosses a block, and the table of block offsets lets any range of blocks be decoded in
vectorised form.  The last word of a block may have unused slots.

A segment is one blob: magic, number of documents, ids, blocks and words; then the ids of the
documents (i64), their lengths (u32), the blocks' first words (u32) and the words (u64), all little-endian.
Segments are rows of Parquet files in ascending doc_id order, so that Spark's committer writes them.

Defined results: null text is empty text; every document ends with ``end_id``, so none is empty; rows
with equal doc_id stand side by side, by text hash; a null doc_id comes first; an empty
table gives no segment and an empty result; other columns are ignored.
A text of any length is encoded whole and lies in one segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialise, tune
from .tokens import encoder, with_end

MAGIC = b"S8B1"
BLOCK = 128
#: Fixed values of the Simple-8b format: ids in a word and bits of an id, by selector (0 is the escape here, 1 is unused).
COUNTS = np.array([1, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

SEGMENTS = "part int, seg int, n_ids long, segment binary"
DOCS = "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    bits = np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    large = np.flatnonzero(values >= np.uint64(1 << 53))  # these may be rounded up
    if len(large):
        bits[large] = [int(v).bit_length() for v in values[large].tolist()]
    return bits


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block). All blocks advance side by side, a word each step."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    # the selector of a word that would begin at each id: the one of most ids that all fit; what is behind a block's end fits
    blocks = -(-n // block)
    most = np.zeros((blocks, block + 64), np.uint8)
    most[:, :block] = np.concatenate([_widths(values), np.zeros(blocks * block - n, np.uint8)]).reshape(blocks, block)
    spans = [most]  # spans[k][:, i]: most bits among the 2**k values from i on
    for k in range(5):
        spans.append(np.maximum(spans[-1][:, : -(1 << k)], spans[-1][:, 1 << k :]))
    best = np.zeros((blocks, block), np.uint8)
    for s in range(15, 1, -1):
        count = int(COUNTS[s])
        k = count.bit_length() - 1
        off = count - (1 << k)
        best[np.maximum(spans[k][:, :block], spans[k][:, off : off + block]) <= BITS[s]] = s
    best = best.ravel()[:n]
    chosen = np.full(n, 255, np.uint8)
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    while len(at):
        selector = best[at]
        chosen[at] = selector
        at = at + COUNTS[selector]
        more = at < end
        at, end = at[more], end[more]
    first = np.flatnonzero(chosen != 255)
    selector = chosen[first].astype(np.int64)
    sizes = np.diff(np.append(first, n))
    slot = np.arange(n) - np.repeat(first, sizes)
    plain = np.repeat(selector > 0, sizes)
    shifted = np.where(plain, values << (np.repeat(BITS[selector], sizes) * slot).astype(np.uint64), np.uint64(0))
    words = np.add.reduceat(shifted, first) | (selector.astype(np.uint64) << np.uint64(60))
    escapes = np.flatnonzero(selector == 0)
    place = np.arange(len(words)) + np.searchsorted(escapes, np.arange(len(words)))  # words before each
    offsets = place[np.searchsorted(first, np.arange(0, n, block))].astype(np.uint32)
    if len(escapes):
        words = np.insert(words, escapes + 1, values[first[escapes]])
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of whole blocks; ``offsets`` are the first words of the blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    words = words.astype(np.uint64, copy=False)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():
        for i in np.flatnonzero(selector == 0).tolist():  # a raw word may look like an escape
            if not raw[i]:
                raw[i + 1] = True
    sizes = np.where(raw, 0, COUNTS[selector])
    starts = offsets.astype(np.int64)
    before = np.cumsum(sizes) - sizes
    in_block = before - np.repeat(before[starts], np.diff(np.append(starts, len(words))))
    size_of = np.full(len(starts), block, np.int64)
    size_of[-1] = n - block * (len(starts) - 1)
    left = np.repeat(size_of, np.diff(np.append(starts, len(words)))) - in_block
    sizes = np.minimum(sizes, np.maximum(left, 0))
    slot = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = BITS[selector]
    mask = (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)
    ids = (np.repeat(words, sizes) >> (np.repeat(bits, sizes) * slot).astype(np.uint64)) & np.repeat(mask, sizes)
    escaped = np.flatnonzero((selector == 0) & ~raw)
    if len(escaped):
        ids[(np.cumsum(sizes) - sizes)[escaped]] = words[escaped + 1]
    return ids


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    return b"".join([
        MAGIC, struct.pack("<IQII", len(doc_ids), len(ids), len(offsets), len(words)),
        doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    n_docs, n_ids, n_blocks, n_words = struct.unpack_from("<IQII", data, 4)
    at, out = 4 + struct.calcsize("<IQII"), []
    for kind, n in (("<i8", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("<u8", n_words)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out[0], out[1].astype(np.int64), unpack(out[3], out[2], n_ids)


def write_tokens(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Encode all texts and write them as segments in ascending doc_id order; the written table. Columns: ``SEGMENTS``.

    Texts are encoded where they lie; only ids are dealt to ranges, by doc_id and text, so many rows of one doc_id aren't one range.
    """
    tune(docs.sparkSession)

    def encode(batches):
        enc = encoder(tokenizer, pattern)
        for batch in batches:
            ids, counts = with_end(*enc.encode(batch.column(2)), end_id)
            size = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
            data, edge = ids.astype(f"<u{size}").tobytes(), (size * np.concatenate([[0], np.cumsum(counts)])).tolist()
            own = pa.array([data[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(own), size, np.int32)), own], ["doc_id", "h", "size", "ids"])

    encoded = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(encode, "doc_id long, h long, size int, ids binary")
    ordered = materialise(encoded, "encoded").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seg, batch in enumerate(batches):
            if not len(batch):
                continue
            texts, size = batch.column(3).to_pylist(), batch.column(2).to_numpy()
            if size.max() == 2:
                ids = np.frombuffer(b"".join(texts), "<u2")
            else:
                ids = np.concatenate([np.frombuffer(x, f"<u{k}").astype(np.uint32) for x, k in zip(texts, size.tolist())])
            counts = np.fromiter(map(len, texts), np.int64, len(texts)) // size
            keys = batch.column(0).fill_null(NULL_ID).to_numpy()
            blob = write_segment(keys, counts, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "seg", "n_ids", "segment"],
            )

    return materialise(ordered.select("doc_id", "h", "size", "ids").mapInArrow(run, SEGMENTS), "tokens")


#: Stands for a null doc_id in a segment.
NULL_ID = -(2**63)


def read_tokens(segments: DataFrame) -> DataFrame:
    """A row for each document of the files. Columns: doc_id, start, n_tokens, ids_crc32.

    The starts come from the segments' counts: sums within a partition, and of whole partitions.
    """
    tune(segments.sparkSession)

    def run(batches):
        for batch in batches:
            for part, seg, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, ids = read_segment(blob)
                data, edge = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc_ids), part, np.int32)), pa.array(np.full(len(doc_ids), seg, np.int32)), pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(edge[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "seg", "segment").mapInArrow(run, DOCS)
    counts = segments.select("part", "seg", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    within = counts.select("part", "seg", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")).alias("before"))
    starts = within.join(parts, "part").select("part", "seg", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(starts, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
