"""Problem 8: token ids of every text by a public byte-level tokenizer.

The vocabulary is serialised as a sentencepiece BPE model: each token's bytes
become printable characters, one for each byte, its score is its negative rank,
and the normaliser is the identity. A text is split by the tokenizer's pattern;
each pre-token that a task has not met is mapped to those characters and encoded
by the model, whose piece numbers are the ids. Decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leafmill.llm.corpus import settled

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Distinct pre-tokens a task remembers before it starts afresh.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece n is the token of rank n, in byte characters."""
    chars = byte_characters()
    normal, unknown = 1, 2
    pieces = [b""] * (len(ranks) + 1)
    for token, rank in ranks.items():
        piece = "".join(chars[b] for b in token).encode()
        pieces[rank] = _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    pieces[-1] = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks))
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Token ids of texts; one for each worker process and vocabulary."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.chars = byte_characters()
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        return _ASCII.findall(text) if text.isascii() else self.pattern.findall(text)

    def _learn(self, words: list[str]) -> None:
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in words]
        coded = self.model.encode(mapped, num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(coded), np.int32, int(lengths.sum()))])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        words = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        new = set(every).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = set(every)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        length = self.length[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[at] - ends + length, length)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def _unique_rows(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[tuple[list[int], list[str]]]:
    seen: set = set()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            keys, texts = [], []
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if (own := (k, hash(t))) not in seen:
                    seen.add(own)
                    keys.append(k)
                    texts.append(t or "")
            if keys:
                yield keys, texts


def _encoded(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for keys, texts in _unique_rows(batches):
            ids, counts = encoder.encode(texts)
            if counts_only:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts.astype(np.int32))], ["doc_id", "n_tokens"])
            else:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    return run


def _documents(documents: DataFrame) -> DataFrame:
    """Repeats of a document share a partition; sizes even out, as ids say nothing of length."""
    return settled(documents.select("doc_id", "text"), "doc_id").where("doc_id is not null").repartition("doc_id")


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids), one row for each document.

    Special tokens' spellings are ordinary text; a null or empty text has the
    empty list; rows without doc_id are left out; repeated rows count once.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    return _documents(documents).mapInArrow(_encoded(path, False), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, n_tokens): the lengths of ``token_ids``, which are not moved for it."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    return _documents(documents).mapInArrow(_encoded(path, True), "doc_id long, n_tokens int")
