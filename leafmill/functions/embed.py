"""Embedding texts: any model behind one interface, run in batches on the workers."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that go through the model at once, tokens of a text, and how far a norm may be from one.
BATCH = 8
MAX_TOKENS = 512
NORM_ERROR = 1e-5
TINY = 1e-12


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One vector of length one for each text."""


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of each text's token vectors, padding left out."""
    weight = mask[:, :, None].astype(np.float32)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), TINY)


def normalised(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), TINY)


def checked(vectors: np.ndarray, dimension: int) -> np.ndarray:
    """``vectors`` as float32, if they have the dimension and length one; ValueError otherwise."""
    out = np.asarray(vectors, dtype=np.float32)
    if out.ndim != 2 or out.shape[1] != dimension:
        raise ValueError(f"embeddings of shape {out.shape}, expected (n, {dimension})")
    wrong = np.abs(np.linalg.norm(out, axis=1) - 1) > NORM_ERROR
    if wrong.any():
        raise ValueError(f"{int(wrong.sum())} embeddings are not of length one")
    return out


def in_batches(embedder: Embedder, texts: list[str], batch: int = BATCH) -> np.ndarray:
    """Embeddings of ``texts`` in their order; batches are of similar length, so that little is padding."""
    out = np.zeros((len(texts), embedder.dimension), np.float32)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        out[part] = checked(embedder.embed([texts[i] for i in part]), embedder.dimension)
    return out


class OnnxModel:
    """A sentence model as ONNX with its tokenizer file; loaded when first used, once in a worker."""

    def __init__(self, model: str | Path, tokenizer: str | Path, dimension: int, query_prefix: str = "") -> None:
        self.paths, self.dimension, self.query_prefix = (str(model), str(tokenizer)), dimension, query_prefix
        self._session = self._tokenizer = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None, "_tokenizer": None}

    def _load(self) -> None:
        for path in self.paths:
            if not Path(path).is_file():
                raise FileNotFoundError(path)
        import onnxruntime
        import tokenizers

        self._session = onnxruntime.InferenceSession(self.paths[0], providers=["CPUExecutionProvider"])
        self._tokenizer = tokenizers.Tokenizer.from_file(self.paths[1])
        self._tokenizer.enable_truncation(MAX_TOKENS)
        self._tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            self._load()
        coded = self._tokenizer.encode_batch(texts)
        given = {
            "input_ids": np.array([c.ids for c in coded], np.int64),
            "attention_mask": np.array([c.attention_mask for c in coded], np.int64),
            "token_type_ids": np.array([c.type_ids for c in coded], np.int64),
        }
        outputs = [o.name for o in self._session.get_outputs()]
        wanted = "sentence_embedding" if "sentence_embedding" in outputs else outputs[0]
        known = {i.name for i in self._session.get_inputs()}
        vectors = self._session.run([wanted], {k: v for k, v in given.items() if k in known})[0]
        return normalised(mean_pooled(vectors, given["attention_mask"]) if vectors.ndim == 3 else vectors)

    def embed_query(self, text: str) -> np.ndarray:
        return checked(self.embed([self.query_prefix + text]), self.dimension)[0]


def embedded(text: Column, embedder: Embedder) -> Column:
    """The embedding of each text; null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts.notna().to_numpy()
            vectors = iter(in_batches(embedder, texts[given].tolist()))
            yield pd.Series([next(vectors).tolist() if g else None for g in given], dtype=object)

    return run(text)
