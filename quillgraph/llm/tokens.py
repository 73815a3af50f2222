"""Token counts by a public tokenizer, one pass over the texts."""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file used if no path is given; the folder is that of the installed vocabulary package.
DEFAULT_VOCABULARY = os.environ.get("QUILLGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The usual pre-split of byte-level BPE: contractions, letters, digits, other marks, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are handed over in pieces of at least this many characters, so that no call is too long.
CHUNK = 20_000
#: Places where the pre-split breaks whatever surrounds them: before white space that follows a sign, and between a
#: letter and a mark. The tokens on both sides are those of the whole text.
_BREAK = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")
HASHED = 1 << 12

_LOADED: dict[str, object] = {}


def encoding(path: str = DEFAULT_VOCABULARY):
    """The tokenizer of a ranks file, loaded once per process."""
    if path not in _LOADED:
        tiktoken = importlib.import_module("tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def encode(text: str, path: str = DEFAULT_VOCABULARY) -> list[int]:
    """Token ids of a whole text, those the tokenizer gives for it in one call; cut only where the pre-split must break."""
    enc = encoding(path)
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = m.start() if m else len(text)
        ids += enc.encode_ordinary(text[at:end])
        at = end
    return ids


def directions(dims: int, seed: int) -> np.ndarray:
    """Fixed random directions for hashed token counts, HASHED x dims."""
    return np.random.default_rng(seed).standard_normal((HASHED, dims))


def hilbert_key(x: np.ndarray, bits: int) -> int:
    """Place of a point with integer coordinates below 2**bits on the Hilbert curve (Skilling's transform)."""
    x = [int(v) for v in x]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def with_tokens(df: DataFrame, keys: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY, hilbert: bool = False, dims: int = 3, bits: int = 10, seed: int = 7) -> DataFrame:
    """keys, n_tokens and, if hilbert, hkey: the place on a Hilbert curve of the hashed token vector.

    A null or empty text has 0 tokens and hkey 0. Nothing else of df is kept.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens bigint" + (", hkey bigint" if hilbert else "")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        way = directions(dims, seed) if hilbert else None
        scale = (1 << bits) - 1
        for pdf in batches:
            n, h = [], []
            for t in pdf["_text"]:
                ids = encode(t, path) if isinstance(t, str) else []
                n.append(len(ids))
                if hilbert:
                    if not ids:
                        h.append(0)
                        continue
                    v = np.bincount(np.asarray(ids, dtype=np.int64) % HASHED, minlength=HASHED)
                    at = np.flatnonzero(v)
                    w = np.sqrt(v[at])
                    p = w @ way[at] / np.sqrt(w @ w)
                    # the coordinates of a projected unit vector are near standard normal
                    h.append(hilbert_key(np.clip((p / 6 + 0.5) * scale, 0, scale).astype(np.int64), bits))
            out = pdf.drop(columns="_text")
            out["n_tokens"] = np.asarray(n, dtype=np.int64)
            if hilbert:
                out["hkey"] = np.asarray(h, dtype=np.int64)
            yield out

    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(count, schema)
