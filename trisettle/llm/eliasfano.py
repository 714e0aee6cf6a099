"""Token ids on disk with Elias-Fano encoded document boundaries.

File format (Parquet, in the shared folder): one row per block of consecutive documents in ascending doc_id order.

    bucket, block   position: blocks sorted by (bucket, block) concatenate to the whole corpus
    ahead           ids of the bucket's blocks before this one; starts of buckets are a running sum over them
    first_id        the first doc_id; those of all documents less it, which never fall either, are coded like the ends:
    id_bits, id_low, id_high, id_samples
    n_docs, n_ids   documents and ids of the block
    width           bytes of an id: 2 if the vocabulary has at most 65,536 ids, else 4
    ids             the concatenated ids, little-endian
    low_bits        l = max(0, floor(log2(n_ids / n_docs)))
    low             the low l bits of every document's end offset, packed, least significant bit first
    high            unary upper parts: bit (end >> l) + i is set for the i-th document's end
    samples         uint32: of every SAMPLE-th set bit of ``high`` its position, where select starts

That is about 2 + l bits a document; ends fit in 32 bits as a block is closed at BLOCK_IDS ids or before (one
longer document has a block of its own, and its ends need l bits like any other).
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trisettle.llm.bytebpe import byte_characters
from trisettle.llm.common import shuffle_partitions, small_batches, written

BLOCK_IDS = 1 << 20
SAMPLE = 64
#: Bytes of words and ids, with what their objects take, that a Python worker remembers before it starts anew.
CACHE_BYTES = 112 << 20
ENTRY_BYTES = 170
#: Most buckets of a corpus; cuts between them, 8 bytes each, and their starts, 16 bytes each, are all that is broadcast.
MOST_BUCKETS = 100_000
SAMPLED = 30

#: Latin-1 bytes with letters lowered and newlines as spaces.
LOWER = bytes(0x20 if b == 0x0A else b + 32 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
#: Words of small letters as they are, and the place between a letter and the one full stop or comma that ends its word.
LATIN = re.compile("[a-zß-öø-ÿ]+")
WORD_END = re.compile("(?<=[a-zß-öø-ÿ])(?=[.,] )")

BLOCKS = "bucket int, block int, ahead long, first_id long, id_bits int, id_low binary, id_high binary, id_samples binary, n_docs int, n_ids long, width int, ids binary, low_bits int, low binary, high binary, samples binary"


def pack(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each value, packed."""
    if not bits or not len(values):
        return b""
    each = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of ``n`` values below or at ``bound``."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes, n: int):
        self.low_bits, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n

    @classmethod
    def encode(cls, values: np.ndarray, bound: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, int(bound // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        return cls(bits, pack(values, bits), np.packbits(flags, bitorder="little").tobytes(),
                   places[::SAMPLE].astype("<u4").tobytes(), n)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (here := word.bit_count()) <= left:
            left, byte = left - here, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        span = int.from_bytes(self.low[first >> 3: (first + self.low_bits + 7 >> 3)], "little") >> (first & 7)
        return place - i << self.low_bits | span & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        """Every value, one select after the other."""
        return np.fromiter(map(self.select, range(self.n)), np.uint64, self.n)


# The steps of the one kind of tokenizer that ``Words`` can cut.
STEPS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's words are those of ``Words``: lower case, runs of letters or of marks, single digits."""
    normal, pre = ((spec.get(k) or {}).get(part) or [{}] for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return bool([x.get("type") for x in normal] == STEPS and pre[0].get("pattern") == {"Regex": PATTERN} and spec["model"].get("end_of_word_suffix"))


class Words:
    """A tokenizer whose words end at white space: lower-cased words are encoded once and remembered. Texts that hold
    one of its special tokens are encoded as a whole, and so are all texts of any other kind of tokenizer."""

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width, self.kind = width, {2: "H", 4: "I"}[width]
        self.known: dict[str, bytes] = {}
        self.held = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec.get("added_tokens") or ()) or "(?!)")
        self.by_word = cuts_at_spaces(spec)
        if not self.by_word:
            return
        # the same model without normaliser and splitting, for words of small Latin letters that need neither
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.chars = {b: c for b, c in enumerate(byte_characters()) if b != 0x20}
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def forget(self) -> None:
        """Drop what is remembered: workers outlive their tasks."""
        self.known.clear()
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        plain = [x for x in new if LATIN.fullmatch(x)]
        if plain:
            text = " ".join(plain).encode().decode("latin-1").translate(self.chars)
            ids = np.array(self.plain.encode(text, add_special_tokens=False).ids, f"<u{self.width}")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(ends) == len(plain):  # each word ends with a token of its own
                raw = ids.tobytes()
                self.known.update(zip(plain, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))
                new = [x for x in new if x not in self.known]
        for word, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[word] = array(self.kind, found.ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text. Cutting at spaces and newlines, and between a letter and a full stop or comma
        at a word's end, changes nothing: the tokenizer drops white space and merges within runs of letters or of
        marks only. Nor does lowering Latin-1 letters, which it does itself."""
        if not self.by_word or self.special.search(text):
            return self._whole(text)
        try:
            plain = text.encode("latin-1").translate(LOWER).decode("latin-1") + " "
        except UnicodeEncodeError:
            plain = text.encode().lower().decode().replace("\n", " ") + " "
        words = WORD_END.sub(" ", plain).split(" ")
        if self.held > CACHE_BYTES:
            self.forget()
        if new := set(words).difference(self.known):
            self._learn(list(new))
            self.held += sum(ENTRY_BYTES + len(x) for x in new)
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def words(path: str, width: int) -> Words:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path, width)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(df: DataFrame, path: str, key: str, text: str, end_id: int, width: int, cuts: np.ndarray) -> DataFrame:
    """bucket (the number of cuts at or below the doc_id), doc_id and packed ids with the end id of every text."""
    end = np.array([end_id], f"<u{width}").tobytes()
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(path, width)
        for batch in source:
            ids = [own.encode(x.as_py() or "") + end for x in batch.column(1)]
            bucket = np.searchsorted(shared.value, batch.column(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), batch.column(0), pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])
        own.forget()

    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(batches, "bucket int, doc_id long, ids binary")


def quantiles(ids: DataFrame, rows_per_bucket: int) -> np.ndarray:
    """Cuts between buckets of doc_ids, from ``SAMPLED`` ids a bucket that a hash picks. They decide how even buckets
    are, not what is written."""
    n = ids.count()
    wanted = min(MOST_BUCKETS, max(1, -(-n // rows_per_bucket)))
    some = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLED * wanted / max(n, 1)) * (1 << 30)))
    found = np.sort(some.toArrow().column(0).to_numpy())
    return np.unique(found[np.arange(1, wanted) * len(found) // wanted]) if len(found) else found


def in_blocks(width: int):
    """Consecutive rows of a sorted partition to blocks; a partition is streamed, never held."""

    def close(bucket: int, block: int, ahead: int, docs: list[int], parts: list[bytes]) -> tuple:
        ends = np.cumsum([len(x) // width for x in parts])
        code = EliasFano.encode(ends, int(ends[-1]))
        doc = EliasFano.encode(np.array(docs, np.int64).view(np.uint64) - np.uint64(docs[0] % (1 << 64)), docs[-1] - docs[0])
        return bucket, block, ahead, docs[0], doc.low_bits, doc.low, doc.high, doc.samples, len(docs), int(ends[-1]), width, b"".join(parts), code.low_bits, code.low, code.high, code.samples

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("ahead", pa.int64()), ("first_id", pa.int64()), ("id_bits", pa.int32()), ("id_low", pa.binary()), ("id_high", pa.binary()), ("id_samples", pa.binary()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()),
                            ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
        as_batch = lambda row: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
        at, block, ahead, size, docs, parts = None, 0, 0, 0, [], []
        for batch in source:
            for bucket, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and (bucket != at or size + len(ids) // width > BLOCK_IDS):
                    yield as_batch(close(at, block, ahead, docs, parts))
                    block, ahead, size, docs, parts = block + 1, ahead + size, 0, [], []
                if bucket != at:
                    at, block, ahead = bucket, 0, 0
                docs.append(doc)
                parts.append(ids)
                size += len(ids) // width
        if docs:
            yield as_batch(close(at, block, ahead, docs, parts))

    return batches


def write(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1,
          rows_per_bucket: int = 4_000) -> DataFrame:
    """Encode every text, append ``end_id`` and write the blocks; returns the written table.

    A null or empty text has the end id only; a null doc_id sorts first and is kept as the least long; repeated
    doc_ids keep all their rows; an empty table gives no block; other columns are ignored. Documents are dealt by
    doc_id into buckets of about ``rows_per_bucket`` rows at quantiles of doc_id, and each bucket is written in
    ascending order, so no task holds more than a few blocks.
    """
    path = path or tokenizer_path()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    spark = df.sparkSession
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cuts = quantiles(df.select(doc.alias("doc_id")), rows_per_bucket)
    tokens = tokenize(df.select(doc.alias(key), text), path, key, text, end_id, width, cuts)
    dealt = tokens.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return written(dealt.mapInArrow(in_blocks(width), BLOCKS), "token-blocks")


def boundaries(blocks: DataFrame) -> DataFrame:
    """From the blocks: doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""
    sizes = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                n, kind = row["n_docs"], f"<u{row['width']}"
                ends = EliasFano(row["low_bits"], row["low"], row["high"], row["samples"], n).values().astype(np.int64)
                first = np.concatenate(([0], ends[:-1]))
                ids = np.frombuffer(row["ids"], kind).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(first, ends, strict=True)]
                docs = (EliasFano(row["id_bits"], row["id_low"], row["id_high"], row["id_samples"], n).values() + np.uint64(row["first_id"] % (1 << 64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(first + row["offset"] + row["ahead"]), pa.array(ends - first), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(offsets), "bucket").mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
