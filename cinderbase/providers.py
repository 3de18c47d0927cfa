"""Extension points: embedders and language models, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class SeededEmbedder:
    """A unit vector drawn from a generator seeded by the text's digest."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big")
            v = np.random.RandomState(seed).randn(self.dimensions).astype(np.float32)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class HashEmbedder:
    """A unit vector from two 32-bit hashes of the text's UTF-16 units and a shift register; constants and shifts are fixed values."""

    def __init__(self, dimensions: int = 128):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        mask = 0xFFFFFFFF
        states = np.zeros(len(texts), np.int64)
        for n, t in enumerate(texts):
            first, second = 0x811C9DC5, 0x01000193
            for unit in np.frombuffer(t.encode("utf-16-le"), np.uint16).tolist():
                first, second = ((first ^ unit) * 0x01000193) & mask, ((second ^ unit) * 0x811C9DC5) & mask
            states[n] = first ^ second
        columns = []
        for _ in range(self.dimensions):
            # shifts of 32-bit numbers; the one to the right keeps the sign
            states = (states ^ (states << 13)) & mask
            signed = np.where(states >= 1 << 31, states - (1 << 32), states)
            states = (states ^ (signed >> 17)) & mask
            states = (states ^ (states << 5)) & mask
            columns.append(states / mask * 2 - 1)
        v = np.stack(columns, axis=1) if len(texts) else np.zeros((0, self.dimensions))
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(length == 0, 1, length)).tolist()


class Retrying:
    """An embedder tried again a few times, with growing pauses."""

    def __init__(self, inner: Embedder, attempts: int = 3, pause: float = 0.25):
        self.inner, self.attempts, self.pause, self.dimensions = inner, attempts, pause, inner.dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        for k in range(self.attempts):
            try:
                return self.inner.embed_batch(texts)
            except Exception:
                if k == self.attempts - 1:
                    raise
                time.sleep(self.pause * 2**k)
        raise AssertionError


def embed(text: Column, embedder: Embedder) -> Column:
    """Embed a text column in Arrow batches; null texts give null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        vectors = dict(zip(known.index, embedder.embed_batch(known.tolist())))
        return pd.Series([vectors.get(i) for i in texts.index])

    return run(text)


def fixed_reply(items: list[dict]) -> Callable[[str], str]:
    """A model that always answers with the same items."""
    reply = json.dumps(items)
    return lambda _: reply
