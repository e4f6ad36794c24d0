"""Byte-level BPE by sentencepiece: the rank file becomes a sentencepiece model, pre-tokens are encoded by it.

The model is serialised straight from the ranks: every token's bytes are mapped to printable characters,
one a byte, scored by negative rank, with identity normalisation. Piece ids equal ranks; the unknown piece,
which sentencepiece demands, comes after them and never occurs, as all 256 bytes are pieces.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame

from wayfold.llm.common import slim
from wayfold.llm.token_cache import TokenCache

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Texts of about so many characters are handed back together.
BATCH_CHARS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The driver reads the file (under 2 MB); executors get its contents with the task."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE. Ranks have to be 0 to n-1, with every single byte among them."""
    import struct

    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be contiguous from 0 and hold all single bytes")
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank))
    unknown = len(by_rank)
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", -unknown) + _varint(3 << 3) + _varint(2))
    absent = _varint((1 << 64) - 1)  # -1: the model has no such piece
    trainer = _varint(3 << 3) + _varint(2) + _varint(4 << 3) + _varint(unknown + 1) + _varint(40 << 3) + _varint(unknown) + b"".join(_varint(k << 3) + absent for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_varint(k << 3) + _varint(0) for k in (3, 4, 5))
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class ByteBpe:
    """Encode and decode as the rank file's library does, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.pieces = sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        self.chars = dict(enumerate(byte_characters()))
        self.split = regex.compile(pattern).findall
        self.cache = TokenCache(self.encode_pre_token)

    def encode_pre_token(self, token: str) -> list[int]:
        raw = token.encode()
        whole = self.ranks.get(raw)  # a pre-token that is a piece is that piece, whether merges reach it or not
        return [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.chars))

    def encode(self, text: str) -> array:
        return self.cache.ids(self.split(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about `most` bytes of text at most (a longer text is a part alone)."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def round_trip(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids (little-endian unsigned 32-bit) and of the bytes they decode to.

    A null text counts as empty: no ids, digests of nothing. A null doc_id stays null; repeated rows are
    encoded each for itself; an empty table gives no rows; further columns are not looked at. One pass
    without a shuffle: a lost task is encoded again from its input."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path or public_tokenizers.path(RANK_FILE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(ranks.value)
        for batch in batches:
            for part in slices(batch):
                n, ids_sha, text_sha = [], [], []
                for text in part.column("text").to_pylist():
                    ids = coder.encode(text or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
