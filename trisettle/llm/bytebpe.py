"""Byte-level BPE by a sentencepiece model written straight from a rank file.

``serialized_model`` writes the model's protocol buffer by hand: one piece per vocabulary entry, its bytes mapped
to printable characters, its score the negative rank, so that sentencepiece merges the pair of lowest rank first
as byte-level BPE does. The normaliser is the identity. Pre-tokens are encoded one by one; decoding looks up the
bytes of each id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import small_batches

#: Bytes of pieces and ids, with what their objects take, that a Python worker remembers before it starts anew.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200
#: A space beside other white space: there a text cannot be cut before each space.
UNCUTTABLE = regex.compile(r"\s | \s")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialized_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: ModelProto{pieces=1, trainer_spec=2, normalizer_spec=3}.

    Piece ids are ranks; <unk> gets the id after the last.
    """
    chars = byte_characters()
    out = []
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in piece).encode()
        out.append(_field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(ranks)
    # model_type=BPE, vocab_size, treat_whitespace_as_suffix=false, unk_id; no bos, eos or pad
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes whole texts; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(self.ranks))
        self.chars = dict(enumerate(byte_characters()))
        self.pattern = regex.compile(pattern)
        self.bytes_of = {str(rank): piece for piece, rank in self.ranks.items()}
        self.known: dict[str, str] = {}
        self.held = 0

    def forget(self) -> None:
        """Drop what is remembered: workers outlive their tasks."""
        self.known.clear()
        self.held = 0

    def _learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of pieces: of each pre-token, the vocabulary entry that equals it or else its merges."""
        found: dict[str, list[str]] = {}
        wanted: dict[str, str] = {}
        for piece in pieces:
            tokens = self.pattern.findall(piece)
            found[piece] = tokens
            for token in tokens:
                if token not in wanted:
                    raw = token.encode()
                    wanted[token] = str(self.ranks[raw]) if raw in self.ranks else raw.decode("latin-1").translate(self.chars)
        merge = [t for t, w in wanted.items() if not w.isdecimal() or t.encode() not in self.ranks]
        for token, ids in zip(merge, self.model.encode([wanted[t] for t in merge], num_threads=1) if merge else [], strict=True):
            wanted[token] = " ".join(map(str, ids))
        for piece, tokens in found.items():
            ids = self.known[piece] = " ".join(map(wanted.__getitem__, tokens))
            self.held += ENTRY_BYTES + len(piece) + len(ids)

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        if not text:
            return ""
        if UNCUTTABLE.search(text):
            pieces = self.pattern.findall(text)
        else:  # each pre-token after a space starts with it, so the text can be cut there
            first, *rest = text.split(" ")
            pieces = ([first] if first else []) + [" " + x for x in rest]
        known = self.known
        try:
            return " ".join([known[x] for x in pieces])
        except KeyError:
            if self.held > CACHE_BYTES:
                self.forget()
            self._learn({x for x in pieces if x not in known})
        return " ".join([known[x] for x in pieces])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (decimal, joined by one space) of every text.

    A null or empty text has no ids; repeated rows are encoded each; texts of any length are taken whole; other
    columns are ignored. Needs no shuffle: every batch of rows is encoded where it is read.
    """
    default_path, default_pattern = default_files()
    path, pattern = path or default_path, pattern or default_pattern

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in source:
            ids = [own.encode(x.as_py() or "") for x in batch.column(1)]
            counts = [x.count(" ") + 1 if x else 0 for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string())], ["doc_id", "n_tokens", "ids"])

    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        batches, "doc_id long, n_tokens long, ids string")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """The input of ``encode``'s form with ``decoded``, the bytes of the ids; no ids decode to no bytes."""
    default_path, pattern = default_files()
    path = path or default_path

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in source:
            raw = [own.decode(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return df.select("doc_id", "n_tokens", "ids").mapInArrow(batches, "doc_id long, n_tokens long, ids string, decoded binary")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return df.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """What ``digests(decode(encode(df)))`` gives, in one visit of each batch: a task needs one Python worker, and
    neither ids nor decoded bytes travel."""
    default_path, default_pattern = default_files()
    path, pattern = path or default_path, pattern or default_pattern

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in source:
            counts, encoded, decoded = [], [], []
            for x in batch.column(1):
                ids = own.encode(x.as_py() or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                encoded.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
