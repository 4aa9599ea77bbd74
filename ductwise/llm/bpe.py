"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library is given the ranks of a ``.tiktoken`` file: ranks are turned into merges, the
pre-tokenizer is the file's pattern followed by the byte-to-character table.  ``encode_frame``
returns ids with byte and character offsets, ``decode_ids`` reverses the byte table.  A token may
end inside a character: its bytes are joined with its neighbours' before UTF-8 is decoded, and its
character offset is that of the character which holds its first byte.

Defined results: null text counts as empty (no ids); equal rows give equal rows; other columns of the
input are ignored, so clashing names do no harm; an empty table gives an empty table.
A text of any length is one row of a batch of at most 8 MB, larger only for
a single text, and is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import tidy, tune
from .tokens import BatchEncoder, byte_table, spread

FRAME = "doc_id long, ids array<int>, byte_start array<int>, char_start array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split_tokens long, offsets_crc32 long"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that are left when only merges below the token's own rank were made."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        low = min(joined)
        if low >= own:
            raise ValueError(f"token {token!r} cannot be built from lower ranks")
        i = joined.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers document with the merges that the ranks imply."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_table()
    name = lambda token: "".join(chars[b] for b in token)
    vocab = {name(t): r for t, r in ranks.items()}
    merges = [tuple(map(name, _last_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    tok.decoder = decoders.ByteLevel()
    return tok.to_str()


class Codec:
    """Encoder and decoder of one tokenizers document."""

    def __init__(self, document: str, pattern: str):
        from tokenizers import Tokenizer

        self.encoder = BatchEncoder(Tokenizer.from_str(document), pattern)
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = json.loads(document)["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in t)
        self.pool = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.size = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))
        self.start = np.cumsum(self.size) - self.size

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as uint8."""
        return spread(self.pool, self.start[ids], self.size[ids])

    def decode(self, ids) -> str:
        """Text of the ids; bytes of a cut character are replaced, as UTF-8 decoders do."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", errors="replace")

    def offsets(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, character that holds it) of every token."""
        sizes = self.size[ids]
        first = np.cumsum(sizes) - sizes
        heads = np.cumsum((data & 0xC0) != 0x80)
        return first, (heads[first] - 1) if len(first) else first


_codecs: dict[str, Codec] = {}


def codec(document: str, pattern: str) -> Codec:
    """This worker's codec for a tokenizers document."""
    key = hashlib.sha256(f"{pattern}\0{document}".encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(document, pattern)
    return _codecs[key]


def encode_frame(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """ids, byte and character offsets and decoded bytes of every text. Columns: ``FRAME``."""
    tune(docs.sparkSession)
    document = tokenizer_json(read_ranks(ranks_path), pattern)

    def run(batches):
        c = codec(document, pattern)
        for batch in batches:
            ids, counts = c.encoder.encode(batch.column(1))
            out = [[], [], [], []]
            for part in np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []:
                data = c.decode_bytes(part)
                first, char = c.offsets(part, data)
                for column, value in zip(out, (part, first, char, data.tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in out[:3]), pa.array(out[3], pa.binary())],
                ["doc_id", "ids", "byte_start", "char_start", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), FRAME)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids again and digest both. Columns: ``DIGEST``.

    n_split_tokens start inside a character; offsets_crc32 is of the tokens' first bytes, then of the characters that hold them, as
    little-endian unsigned 32-bit integers.
    """
    tune(docs.sparkSession)
    document = tokenizer_json(read_ranks(ranks_path), pattern)

    def run(batches):
        c = codec(document, pattern)
        decimal = [str(i).encode() for i in range(len(c.token_bytes))]
        for batch in batches:
            ids, counts = c.encoder.encode(batch.column(1))
            data = c.decode_bytes(ids)
            sizes = c.size[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            inside = np.concatenate([[0], np.cumsum((data[ends[:-1]] & 0xC0) == 0x80)]) if len(ids) else ends
            edge = np.concatenate([[0], np.cumsum(counts)])
            raw, listed = data.tobytes(), ids.tolist()
            heads = np.cumsum((data & 0xC0) != 0x80)
            ids_hash, text_hash, places = [], [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                ids_hash.append(hashlib.sha256(b" ".join([decimal[i] for i in listed[a:b]])).hexdigest())
                text_hash.append(hashlib.sha256(raw[ends[a] : ends[b]]).hexdigest())
                first = ends[a:b]
                chars = heads[first] - heads[first[:1]] if b > a else first
                places.append(zlib.crc32(np.concatenate([first - ends[a], chars]).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(np.diff(inside[edge]), pa.int64()), pa.array(places, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split_tokens", "offsets_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), DIGEST)
