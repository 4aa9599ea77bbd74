"""Passages that repeat across documents, by a distributed sparse suffix array.

A *window* is ``length`` bytes of one text.  A byte goes if a window over it also starts in a document with a smaller doc_id.  Not every
suffix is moved.  Each window belongs to one *anchor*, the place among its grams of ``GRAM`` bytes whose hash is least, so equal windows
have equal anchors; the windows in a row that share an anchor are a *unit*.

1. Suffixes at anchors, one for each unit, are range-partitioned by sampled splitters over (leading token: the hash of the leading gram, then the
   hash of the unit's bytes, then doc_id), sorted in their bucket by multikey quicksort and compared with their neighbours.  Units equal
   to one of a smaller document are wholly repeated.  Of the others, one of each class of equal units, a quarter of the windows stays in question
   only if another unit with the same leading token also shares the bytes around it that all windows of the quarter hold.
2. The windows in question are suffixes of their own: range-partitioned by their leading bytes, sorted and compared on all of their bytes.

The sort order ends with doc_id, so a run of equal suffixes, however long, may be cut by a splitter; then the run's smallest doc_id
comes from the bucket before, by a table with one row for each bucket.  A run equals on 96 hashed bits in step 1, on all bytes in step 2.

Defined results: null text is empty; texts shorter than a window keep all; texts of any length are read whole, in chunks; rows without a doc_id keep
all and are compared with nothing; rows of one doc_id are not compared with each other, whatever their texts; repeated rows have the
same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialise, scratch, tidy, tune

GRAM = 16
CHUNK = 1 << 19
#: Records that a task gathers before it hands them out.
FLUSH = 1 << 20
#: Bytes of text whose units make a bucket, and windows of a bucket; most buckets at all.
BUCKET_BYTES, BUCKET_WINDOWS, MOST_BUCKETS = 16 << 20, 300_000, 200_000
#: Bytes of text that splitters are sampled from, in all and more for each bucket.
SAMPLE, SAMPLE_EACH = 4 << 20, 300

#: Windows of an anchor are told apart by so many ranges of their distance to it.
QUARTERS = 4
#: Hash of the leading gram, hash of the unit, a hash for each quarter (0: no window), document, first window, further windows, bytes from the first window to the anchor.
UNIT = np.dtype([("g", "<u4"), ("u", "<u8"), ("s", "<u2", (QUARTERS,)), ("d", "<u4"), ("o", "<u4"), ("n", "u1"), ("a", "u1")])
BLOB = "bucket int, docs binary, data binary"
SWEPT = "bucket int, doc_id long, h long, lo long, n int, least long, state int, first binary, last binary"
WHOLE, OPEN, PENDING, EDGE = 0, 1, 2, 3
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_FLIP = np.uint64(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    return h ^ (h >> np.uint64(29))


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, edges) of an Arrow column of strings or binaries without nulls."""
    column = column.cast(pa.binary()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8), edges - edges[0]


def _quarters(length: int) -> list[tuple[int, int]]:
    """(nearest, farthest) distances to the anchor of the windows of each quarter."""
    span = length - GRAM + 1
    wide = -(-span // QUARTERS)
    return [(t * wide, min((t + 1) * wide, span) - 1) for t in range(QUARTERS)]


def units(data: np.ndarray, edges: np.ndarray, length: int) -> np.ndarray:
    """The units of texts that lie one after the other; ``d`` is the text's number and ``o`` the first window's place in it."""
    out = []
    span = length - GRAM + 1  # grams of a window
    padded = np.concatenate([np.zeros(64, np.uint8), data, np.zeros(2 * length + 64, np.uint8)])
    valid = np.zeros(len(data) + 1, np.int8)
    long = np.diff(edges) >= length
    np.add.at(valid, edges[:-1][long], 1)
    np.add.at(valid, (edges[1:] - length + 1)[long], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    with np.errstate(over="ignore"):
        for begin in range(0, len(data), CHUNK):
            stop = min(begin + CHUNK, len(data))
            ok = valid[begin:stop]
            if not ok.any():
                continue
            # places count from 64 bytes before the chunk
            words = np.ndarray((stop - begin + 2 * length + 56,), "<u8", padded[begin:].data, 0, (1,)).astype(np.uint64)
            h = _mix(words[: -GRAM + 8] * _ODD[0] + words[8 : len(words) - GRAM + 16] * _ODD[2])[64:]
            place = np.uint64((1 << 21) - 1)
            least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - span + width], least[span - width :])
            anchor = (least[: stop - begin] & place).astype(np.int64)
            turn = np.empty(len(anchor) + 1, bool)
            turn[0] = turn[-1] = True
            turn[1:-1] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
            first = np.flatnonzero(turn[:-1] & ok)
            last = np.flatnonzero(turn[1:] & ok)
            at = anchor[first]
            n = last - first
            end = last + length
            u = n.astype(np.uint64) * _ODD[0] + (at - first).astype(np.uint64)
            for t in range(0, length + span - 1, 8):
                u = _mix(u ^ words[np.minimum(first + t, end - 8) + 64]) * _ODD[0]
            unit = np.zeros(len(first), UNIT)
            unit["g"], unit["u"] = (h[at] >> np.uint64(32)).astype(np.uint32), u
            for t, (near, far) in enumerate(_quarters(length)):
                # windows that start ``near`` to ``far`` bytes before the anchor all hold these bytes
                s, end = np.zeros(len(first), np.uint64), at - far + length
                for k in range(0, length - (far - near), 8):
                    s = _mix(s ^ words[np.minimum(at - near + k, end - 8) + 64]) * _ODD[0]
                some = (at - last <= far) & (at - first >= near)
                unit["s"][:, t] = np.where(some, (s >> np.uint64(48)) | np.uint64(1), 0)
            d = np.searchsorted(edges, first + begin, side="right") - 1
            unit["d"], unit["o"], unit["n"], unit["a"] = d, first + begin - edges[d], n, at - first
            out.append(unit)
    return np.concatenate(out) if out else np.zeros(0, UNIT)


def multikey_quicksort(words: list[np.ndarray], few: int = 4096) -> np.ndarray:
    """The order of rows by their words: three parts around a pivot word, the middle one goes on with the next word."""
    order = np.arange(len(words[0]))
    stack = [(0, len(order), 0)]
    while stack:
        low, high, level = stack.pop()
        size = high - low
        if size < 2 or level == len(words):
            continue
        part = order[low:high]
        if size <= few:
            order[low:high] = part[np.lexsort([w[part] for w in reversed(words[level:])])]
            continue
        word = words[level][part]
        pivot = np.sort(word[:: max(1, size // 31)])[15]
        less, more = word < pivot, word > pivot
        a, b = int(less.sum()), int(more.sum())
        order[low:high] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(low, low + a, level), (low + a, high - b, level + 1), (high - b, high, level)]
    return order


def _words(records: np.ndarray) -> list[np.ndarray]:
    """The sort words of records but for doc_id."""
    if "g" in records.dtype.names:
        return [records["g"].astype(np.uint64), records["u"].astype(np.uint64)]
    k = records["k"]
    width = k.shape[1]
    padded = np.zeros((len(k), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = k
    return list(np.ascontiguousarray(padded).view(">u8").astype(np.uint64).T)


def _ordered(doc_ids: np.ndarray) -> np.ndarray:
    return doc_ids.astype(np.int64).view(np.uint64) ^ _FLIP


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """Words as byte strings of the same order."""
    table = np.stack(words, axis=1).astype(">u8")
    return np.ascontiguousarray(table).view(f"S{8 * len(words)}").ravel()


class _Dealer:
    """Gathers records and hands them out by bucket, each blob with its own table of documents."""

    def __init__(self, splitters: np.ndarray):
        self.splitters = splitters
        self.heads = np.array([int.from_bytes(s.ljust(8, b"\0")[:8], "big") for s in splitters.tolist()], np.uint64)
        self.records, self.docs, self.size = [], [], 0

    def add(self, records: np.ndarray, doc_ids: np.ndarray, hashes: np.ndarray):
        """``records["d"]`` counts within the given documents."""
        records["d"] += sum(len(d) for d, _ in self.docs)
        self.records.append(records)
        self.docs.append((doc_ids, hashes))
        self.size += len(records)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self):
        if self.size:
            records, ids = np.concatenate(self.records), np.concatenate([d for d, _ in self.docs])
            table = np.stack([ids, np.concatenate([h for _, h in self.docs])], axis=1)
            words = _words(records)
            bucket = np.searchsorted(self.heads, words[0], side="right")
            close = np.flatnonzero(np.searchsorted(self.heads, words[0], side="left") != bucket)
            if len(close):
                bucket[close] = np.searchsorted(self.splitters, _keys([*(w[close] for w in words), _ordered(ids[records["d"][close]])]), side="right")
            order = np.argsort(bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                part = records[a:b].copy()
                used, part["d"] = np.unique(part["d"], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([table[used].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], ["bucket", "docs", "data"])
        self.records, self.docs, self.size = [], [], 0


def _sweep(kind: np.dtype, length: int):
    """Sort a bucket and judge each record by the smallest doc_id of its run."""

    def run(table: pa.Table) -> pa.Table:
        records, tables, base = [], [], 0
        for docs, data in zip(table.column("docs").to_pylist(), table.column("data").to_pylist()):
            own, part = np.frombuffer(docs, np.int64).reshape(-1, 2), np.frombuffer(data, kind).copy()
            part["d"] += base
            base += len(own)
            tables.append(own)
            records.append(part)
        docs, records = np.concatenate(tables), np.concatenate(records)
        words = _words(records)
        order = multikey_quicksort([*words, _ordered(docs[records["d"], 0])])
        records, words = records[order], [w[order] for w in words]
        ids, hashes = docs[records["d"]].T
        change = np.zeros(len(records), bool)
        change[0] = True
        for w in words:
            change[1:] |= w[1:] != w[:-1]
        start = np.flatnonzero(change)
        number = np.cumsum(change) - 1  # of the run
        least = ids[start][number]
        state = np.where(ids > least, WHOLE, -1)
        lo, more = records["o"].astype(np.int64), np.zeros(len(records), np.int64)
        if "g" in kind.names:
            more = records["n"].astype(np.int64)
            g = words[0]
            head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(g))))
            mine = state < 0
            several = (number[np.append(head[1:], len(g)) - 1] > number[head])[group] & mine
            rows = np.flatnonzero(several)
            nearest, farthest = np.full(len(g), 1 << 20), np.full(len(g), -1)
            for t, (near, far) in enumerate(_quarters(length)):
                # a quarter in question is shared with another run of the same leading token
                side = records["s"][:, t]
                rest = rows[side[rows] > 0]
                key = group[rest].astype(np.uint64) << np.uint64(16) | side[rest].astype(np.uint64)
                by = np.lexsort([number[rest], key])
                rest, key = rest[by], key[by]
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(rest) else np.zeros(0, int)
                size = np.diff(np.append(edge, len(rest)))
                shared = number[rest[edge]] != number[rest[edge + size - 1]]
                hit = rest[np.repeat(shared, size)]
                nearest[hit], farthest[hit] = np.minimum(nearest[hit], near), far
            # what lies at the bucket's ends may share its token with the next bucket
            ends = mine & ((group == 0) | (group == group[-1]))
            some = np.flatnonzero((farthest >= 0) & ~ends)
            state[ends], state[some] = OPEN, OPEN
            anchor, last = lo[some] + records["a"][some], lo[some] + more[some]
            lo[some] = np.maximum(lo[some], anchor - farthest[some])
            more[some] = np.minimum(last, anchor - nearest[some]) - lo[some]
        state[number == 0] = PENDING
        keys = _keys([w[[0, -1]] for w in words]).tolist()
        keep = np.flatnonzero(state >= 0)
        m = len(keep) + 1
        fill = lambda values, edge, of: pa.array(np.append(values[keep], edge), of)
        return pa.Table.from_arrays(
            [
                pa.array(np.full(m, table.column("bucket")[0].as_py(), np.int32)), fill(ids, 0, pa.int64()), fill(hashes, 0, pa.int64()), fill(lo, 0, pa.int64()),
                fill(more.astype(np.int32), 0, pa.int32()), fill(least, least[-1], pa.int64()), fill(state, EDGE, pa.int32()),
                pa.array([None] * (m - 1) + [keys[0]], pa.binary()), pa.array([None] * (m - 1) + [keys[1]], pa.binary()),
            ],
            [f.split()[0] for f in SWEPT.split(", ")],
        )

    return run


def _settled(swept: DataFrame) -> DataFrame:
    """The rows of all buckets with the states WHOLE and OPEN; runs that began in an earlier bucket get its smallest doc_id."""
    carry, key, least = [], None, None
    for r in swept.where(F.col("state") == EDGE).select("bucket", "first", "last", "least").orderBy("bucket").collect():  # a row for each bucket
        if r["first"] == key:
            carry.append((r["bucket"], least))
            least = least if r["last"] == key else r["least"]
        else:
            least = r["least"]
        key = r["last"]
    names = ["doc_id", "h", "lo", "n", "state"]
    before = F.broadcast(swept.sparkSession.createDataFrame(carry, "bucket int, carried long"))
    pending = swept.where(F.col("state") == PENDING).join(before, "bucket", "left")
    pending = pending.withColumn("state", F.when(F.col("doc_id") > F.coalesce("carried", "least"), WHOLE).otherwise(OPEN))
    return swept.where(F.col("state") < PENDING).select(*names).unionByName(pending.select(*names))


def _splitters(sample: DataFrame, buckets: int) -> np.ndarray:
    """buckets - 1 keys that cut the sampled ones evenly; a bounded sample (``SAMPLE``)."""
    keys = np.sort(np.array([k for r in sample.collect() for k in np.frombuffer(r["keys"], f"S{r['width']}").tolist()], "S"))
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets]) if len(keys) else keys


def _array_sort(rows: DataFrame, records, kind: np.dtype, length: int, buckets: int, share: float) -> DataFrame:
    """Columns ``SWEPT``: the suffixes that ``records`` makes of a batch of ``rows``, dealt to buckets, sorted and compared. Written."""

    def sampled(batches):
        for batch in batches:
            found, ids, _ = records(batch)
            if len(found):
                keys = _keys([*_words(found), _ordered(ids[found["d"]])])
                yield pa.RecordBatch.from_arrays([pa.array([keys.dtype.itemsize], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["width", "keys"])

    splitters = np.zeros(0, "S1")
    if buckets > 1:
        some = rows.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 20)) <= int(share * (1 << 20)))
        splitters = _splitters(some.mapInArrow(tidy(sampled), "width int, keys binary"), buckets)

    def deal(batches):
        dealer = _Dealer(splitters)
        for batch in batches:
            yield from dealer.add(*records(batch))
        yield from dealer.flush()

    dealt = rows.mapInArrow(tidy(deal), BLOB).repartition(buckets, "bucket")  # so many tasks that each has a bucket or two at any size
    return materialise(dealt.groupBy("bucket").applyInArrow(_sweep(kind, length), SWEPT), "swept")


def repeats(docs: DataFrame, length: int = 50, bucket_bytes: int = BUCKET_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, h (hash of the text) and ranges: unsorted places [lo, hi) of repeated windows and units."""
    if not 3 * GRAM <= length < 256:
        raise ValueError(f"a window has {3 * GRAM} to 255 bytes")
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", F.xxhash64("text").alias("h"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, total // bucket_bytes))

    def of_texts(batch):
        data, edges = _bytes(batch.column(2))
        return units(data, edges, length), batch.column(0).to_numpy(), batch.column(1).to_numpy()

    swept = _array_sort(rows, of_texts, UNIT, length, buckets, (SAMPLE + SAMPLE_EACH * buckets) / max(total, 1))
    settled = _settled(swept)
    open_ = settled.where(F.col("state") == OPEN).groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "n")).alias("units"))  # units of one text

    def cut(batches):
        for batch in batches:
            data, edges = _bytes(batch.column(2))
            listed = batch.column(3)
            places = listed.flatten()
            lo, n = (places.field(i).to_numpy().astype(np.int64) for i in range(2))
            of = np.repeat(np.arange(len(batch)), np.diff(listed.offsets.to_numpy()))
            start = (edges[of] + lo).tolist()
            raw = data.tobytes()
            pieces = [raw[s : s + k + length] for s, k in zip(start, n.tolist())]
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lo), pa.array(pieces, pa.binary())], ["doc_id", "h", "lo", "piece"])

    pieces = rows.join(open_, ["doc_id", "h"]).select("doc_id", "h", "text", "units").mapInArrow(tidy(cut), "doc_id long, h long, lo long, piece binary")
    pieces = materialise(pieces.distinct(), "pieces")  # repeated rows have the same ones
    windows = pieces.agg(F.sum(F.octet_length("piece") - length + 1)).first()[0] or 0
    kind = np.dtype([("k", "u1", (length,)), ("d", "<u4"), ("o", "<u4")])

    def of_pieces(batch):
        data, edges = _bytes(batch.column(3))
        n = np.diff(edges) - length + 1
        d = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(d), kind)
        if len(d):
            out["k"] = np.lib.stride_tricks.sliding_window_view(data, length)[edges[:-1][d] + within]
        out["d"], out["o"] = d, batch.column(2).to_numpy()[d] + within
        return out, batch.column(0).to_numpy(), batch.column(1).to_numpy()

    buckets = max(1, min(MOST_BUCKETS, windows // bucket_windows))
    found = _settled(_array_sort(pieces, of_pieces, kind, length, buckets, (SAMPLE + SAMPLE_EACH * buckets) / max(windows, 1) / 16))
    hits = settled.where(F.col("state") == WHOLE).unionByName(found.where(F.col("state") == WHOLE))
    return hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n") + length).alias("hi"))).alias("ranges"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)]


CLEANED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = 50, **sizes) -> DataFrame:
    """Each document without its repeated passages: doc_id, n_bytes, spans (removed runs, in bytes), kept (the bytes left). Columns: ``CLEANED``."""
    spark = docs.sparkSession
    tune(spark)
    with scratch(spark) as outer:
        ranges = materialise(repeats(docs, length, **sizes), "ranges", under=outer)

    def run(batches):
        for batch in batches:
            data, edges = _bytes(batch.column(1))
            raw, listed = data.tobytes(), batch.column(2)
            offsets, places = listed.offsets.to_numpy(), listed.flatten()
            first = int(offsets[0])
            lo, hi = (places.field(i).to_numpy() for i in range(2))
            starts, ends, sizes_, kept = [], [], [], []
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                s, e = int(offsets[i]) - first, int(offsets[i + 1]) - first
                if s == e:
                    sizes_.append(0)
                    kept.append(raw[a:b])
                    continue
                x, y = (v.tolist() for v in merged(lo[s:e], hi[s:e]))
                starts += x
                ends += y
                sizes_.append(len(x))
                kept.append(b"".join(raw[a + p : a + q] for p, q in zip([0, *y], [*x, b - a])))
            spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes_)]), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges)), spans, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).join(ranges, ["doc_id", "h"], "left")
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    return rows.select("doc_id", "text", F.coalesce("ranges", none).alias("ranges")).mapInArrow(tidy(run), CLEANED)
