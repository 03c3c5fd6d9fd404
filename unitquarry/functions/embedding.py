"""Embedding texts through a pluggable embedder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

BATCH, ATTEMPTS = 25, 4


class Embedder(Protocol):
    """``most_chars``, if an embedder has it, is the longest text that it takes; longer ones are embedded in pieces."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TransientError(Exception):
    """An error after which trying again may help."""


def transient(error: Exception) -> bool:
    """Whether trying again may help: errors that say so, broken connections, time-outs, and answers with a status of 429 or of the server's fault."""
    status = getattr(error, "status", None)
    return isinstance(error, (TransientError, ConnectionError, TimeoutError)) or (isinstance(status, int) and (status == 429 or 500 <= status < 600))


class HashingEmbedder:
    """Words hashed to signed places of a unit vector: deterministic, for tests and where no model is at hand."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[row, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


def with_retry(call: Callable[[list[str]], list], texts: list[str], *, attempts: int = ATTEMPTS, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """``call(texts)``, again after transient errors, each time after twice the wait."""
    for turn in range(attempts):
        try:
            return call(texts)
        except Exception as error:
            if turn == attempts - 1 or not transient(error):
                raise
            sleep(wait * 2**turn)
    return []


def pieces(texts: list[str], most: int | None) -> tuple[list[str], list[int]]:
    """``texts`` cut into pieces of at most ``most`` characters, and the text that each piece is of; empty texts are one piece."""
    cut = [[t[i : i + most] for i in range(0, max(1, len(t)), most)] if most else [t] for t in texts]
    return [p for c in cut for p in c], [n for n, c in enumerate(cut) for _ in c]


def embedded(chunks: DataFrame, embedder: Embedder, *, text: str = "content", batch: int = BATCH) -> DataFrame:
    """``chunks`` with ``embedding``: texts are sent in batches; a null text counts as empty.

    Of a text that is too long for the embedder, the mean of its pieces' vectors, weighted by their lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, owner = pieces([t or "" for t in pdf[text]], getattr(embedder, "most_chars", None))
            vectors = [v for at in range(0, len(parts), batch) for v in with_retry(embedder.embed, parts[at : at + batch])]
            if len(parts) > len(pdf):
                weight = np.array([max(1, len(p)) for p in parts], float)
                sums = np.zeros((len(pdf), len(vectors[0])))
                np.add.at(sums, owner, np.asarray(vectors) * weight[:, None])
                vectors = list(sums / np.bincount(owner, weight)[:, None])
            yield pdf.assign(embedding=vectors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "embedding")
    return chunks.drop("embedding").mapInPandas(run, f"{fields}, embedding array<float>")
