"""Payload columns in content-defined chunks.

A gear hash over the last 32 bytes rolls along the payload; a chunk ends where its high bits are zero, within bounds.
Chunks are named by digest.  Chunks that several documents hold are stored once, in a table
of chunks that is deduplicated by digest; the others stay with their document, so their bytes are never shuffled.  A Bloom filter of
fixed size tells the two apart when the payloads are cut: a false alarm only sends a chunk the shared way, as
does a filter that is too full for a very large corpus.

A document's stored form is its manifest (magic, payload length, and length and digest of each chunk in order) followed by its
compressed chunks, each once, in the order of first use: all that is stored for it.  Reading checks every chunk against its digest and the payload against its own.

Defined results: null text is empty text, whose payload is 64 zero bytes; equal texts have equal values; repeated rows
stay repeated; other columns are ignored; an empty table gives an empty result.
A text of any length is cut whole; a chunk has a largest size, a text has none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialise, tidy, tune

MAGIC = b"CDC1"
UNIT = 64
#: Least and most bytes of a chunk (but for a document's last), and high bits that are zero at a cut.
LEAST, MOST, ZERO_BITS = 512, 16384, 11
LEVEL = 3
#: Words of the Bloom filter (64 bits each) and bits set for a digest.
FILTER_WORDS, FILTER_HASHES = 1 << 17, 4

STORED = "doc_id long, n_bytes long, payload_sha256 string, manifest binary, own array<struct<digest:binary,blob:binary>>, shared array<binary>"
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, 256, np.uint32)


def payload(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(-len(data) % UNIT, 0 if data else UNIT))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last 32 bytes' gear values, each shifted by its age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k) if len(h) > k else h[:0]
        h = h.copy()
        h[k:] += older
    return h


def cut(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each payload, in order."""
    ends = np.flatnonzero(gear(np.frombuffer(b"".join(payloads), np.uint8)) >> np.uint32(32 - ZERO_BITS) == 0) + 1
    ends, out, base = ends.tolist(), [], 0
    for data in payloads:
        chunks, at, stop = [], 0, len(data)
        while at < stop:
            k = bisect_left(ends, base + at + LEAST)
            end = ends[k] - base if k < len(ends) else stop
            end = min(end, at + MOST, stop)
            chunks.append(data[at:end])
            at = end
        out.append(chunks)
        base += stop
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _batch(texts: pa.Array) -> tuple[list[bytes], list[list[bytes]]]:
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return raw, cut([payload(t) for t in raw])


def _bits(digests: list[bytes]) -> np.ndarray:
    """Filter bits of each digest, a row each."""
    words = np.frombuffer(b"".join(digests), "<u4").reshape(-1, 4)
    return words[:, :FILTER_HASHES].astype(np.int64) % (64 * FILTER_WORDS)


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A Bloom filter of the digests that more than one row holds; its size is fixed."""

    def digests(batches):
        for batch in batches:
            _, chunks = _batch(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([d for own in chunks for d in {digest(c) for c in own}], pa.binary())], ["digest"])

    def positions(batches):
        for batch in batches:
            if len(batch):
                bits = _bits(batch.column(0).to_pylist()).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    often = docs.select("text").mapInArrow(tidy(digests), "digest binary").groupBy("digest").count().where("count > 1").select("digest")
    found = often.mapInArrow(tidy(positions), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_WORDS rows at most
    words = np.zeros(FILTER_WORDS, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def _maybe_shared(words: np.ndarray, digests: list[bytes]) -> np.ndarray:
    bits = _bits(digests)
    return ((words[bits >> 6] >> (bits & 63)) & 1).all(1)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the payloads of all texts: (documents with their own chunks, shared chunks). Columns: ``STORED``; digest, blob."""
    tune(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))

    def documents(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            raw, cuts = _batch(batch.column(1))
            if not raw:
                continue
            names = [[digest(c) for c in own] for own in cuts]
            common = iter(_maybe_shared(words.value, [d for own in names for d in own]).tolist())
            columns: list[list] = [[], [], [], []]
            for text, chunks, own in zip(raw, cuts, names):
                mine, others = {}, {}
                for c, d in zip(chunks, own):
                    if next(common):
                        others[d] = None
                    elif d not in mine:
                        mine[d] = compress(c)
                manifest = MAGIC + struct.pack("<QI", sum(map(len, chunks)), len(chunks)) + b"".join(struct.pack("<I", len(c)) + d for c, d in zip(chunks, own))
                for column, value in zip(columns, (hashlib.sha256(payload(text)).hexdigest(), manifest, [{"digest": d, "blob": b} for d, b in mine.items()], list(others))):
                    column.append(value)
            kinds = (pa.string(), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("blob", pa.binary())])), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", "payload_sha256", "manifest", "own", "shared"])

    def chunks(batches):
        import zstandard

        compress, seen = zstandard.ZstdCompressor(level=LEVEL).compress, set()
        for batch in batches:
            _, cuts = _batch(batch.column(0))
            found = {digest(c): c for own in cuts for c in own}
            names = [d for d in found if d not in seen]
            if not names:
                continue
            names = [d for d, s in zip(names, _maybe_shared(words.value, names).tolist()) if s]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(names)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([compress(found[d]) for d in names], pa.binary())], ["digest", "blob"])

    kept = materialise(docs.select("doc_id", "text").mapInArrow(tidy(documents), STORED), "media", codec="none")
    once = docs.select("text").mapInArrow(tidy(chunks), "digest binary, blob binary").groupBy("digest").agg(F.first("blob").alias("blob"))
    return kept, materialise(once, "chunks", codec="none")


def rebuild(manifest: bytes, blobs: dict[bytes, bytes], decompress) -> tuple[bytes, bytes]:
    """(payload, stored form); every chunk is checked against its length and digest."""
    if manifest[:4] != MAGIC:
        raise ValueError("not a chunk manifest")
    total, n = struct.unpack_from("<QI", manifest, 4)
    at, parts, stored, known = 4 + struct.calcsize("<QI"), [], [manifest], set()
    for _ in range(n):
        (size,) = struct.unpack_from("<I", manifest, at)
        name = manifest[at + 4 : at + 20]
        at += 20
        chunk = decompress(blobs[name])
        if len(chunk) != size or digest(chunk) != name:
            raise ValueError("a stored chunk differs from its digest")
        parts.append(chunk)
        if name not in known:
            known.add(name)
            stored.append(blobs[name])
    data = b"".join(parts)
    if len(data) != total:
        raise ValueError("a payload differs from its manifest")
    return data, b"".join(stored)


def feature(data: bytes, n_chunks: int) -> str:
    """Chunks, entropy of the bytes in bits and share of bytes beyond ASCII."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return f"chunks={n_chunks};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};high={counts[128:].sum() / len(data):.4f}"


def load(kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rebuild every payload from the stored tables. Columns: ``MEDIA``."""
    tune(kept.sparkSession)

    def run(batches):
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for sha, manifest, own, parts in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                data, stored = rebuild(manifest, {x["digest"]: x["blob"] for x in [*own, *(parts or [])]}, decompress)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError("a payload differs from what was stored")
                n = struct.unpack_from("<QI", manifest, 4)[1]
                for column, value in zip(columns, (len(data), sha, zlib.crc32(data[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data, n))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    alone = kept.where("size(shared) = 0").select("doc_id", "n_bytes", "payload_sha256", "manifest", "own", F.lit(None).cast("array<struct<digest:binary,blob:binary>>").alias("parts")).mapInArrow(tidy(run), MEDIA)
    # a payload with shared chunks is rebuilt once, whatever the number of its copies; only its short result meets their rows
    partly = kept.where("size(shared) > 0")
    refs = materialise(partly.select("payload_sha256", F.explode("shared").alias("digest")).distinct(), "references")
    parts = refs.join(chunks, "digest").groupBy("payload_sha256").agg(F.collect_list(F.struct("digest", "blob")).alias("parts"))
    once = partly.groupBy("payload_sha256").agg(F.first(F.struct("manifest", "own")).alias("x"))
    none = F.lit(None).cast("long")
    read = once.join(parts, "payload_sha256").select(none.alias("doc_id"), none.alias("n_bytes"), "payload_sha256", "x.manifest", "x.own", "parts").mapInArrow(tidy(run), MEDIA)
    read = materialise(read.drop("doc_id", "n_bytes"), "read")  # a table, so that copies of one payload can be split among tasks
    return alone.unionByName(partly.select("doc_id", "n_bytes", "payload_sha256").join(read, "payload_sha256").select(*alone.columns))
