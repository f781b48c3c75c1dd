"""Problem 7: the whole corpus as ids of a public byte-level BPE tokenizer.

The tokenizers library does the merging. White space decides where it may be given parts of a text instead of all
of it: the pre-tokenizer never joins a character that isn't white space with white space that follows it, so a text
falls into chunks of white space and the word behind it, and a chunk has the same ids wherever it stands. A worker
keeps the ids of the short chunks it has seen, and the library sees each of them once.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauseworks.llm.arrow import per_batch, texts

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# The Unicode characters with the property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
KEEP_CHUNKS, KEEP_LENGTH = 400_000, 48


class Encoder(dict):
    """Ids by chunk. Missing chunks are encoded; short ones are kept, at most ``KEEP_CHUNKS`` of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= KEEP_LENGTH:
            if len(self) >= KEEP_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, CHUNKS.findall(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, CHUNKS.findall(text))))


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_TOKENIZER) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others get the characters from U+0100 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def bytes_of_id(path: str = DEFAULT_TOKENIZER) -> dict[int, bytes]:
    table = byte_of_character()
    vocabulary = encoder(path).tokenizer.get_vocab(with_added_tokens=False)
    return {i: bytes(table[c] for c in token) for token, i in vocabulary.items() if all(c in table for c in token)}


def decode(ids: list[int] | np.ndarray | None, path: str = DEFAULT_TOKENIZER) -> str:
    """The text of ``ids``. Bytes are joined before they are read as UTF-8, so a character split over ids comes back
    whole; a part of a character without its rest gives U+FFFD."""
    known = bytes_of_id(path)
    return b"".join(known.get(int(i), b"") for i in ([] if ids is None else ids)).decode("utf-8", "replace")


def offsets(text: str, path: str = DEFAULT_TOKENIZER) -> list[tuple[int, int, int]]:
    """(id, first byte, end byte) of each token in the UTF-8 text."""
    known, at, out = bytes_of_id(path), 0, []
    for i in encoder(path).ids(text):
        out.append((i, at, at + len(known[i])))
        at += len(known[i])
    return out


def character_spans(text: str, path: str = DEFAULT_TOKENIZER) -> list[tuple[int, int, int]]:
    """(id, first character, end character) of each token; tokens that share a character both span it."""
    character = [k for k, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]
    return [(i, character[a], character[b - 1] + 1) for i, a, b in offsets(text, path)]


def _encode(path: str, key: str, text: str):
    enc = encoder(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, ends = array("i"), [0]
        for t in texts(batch.column(text)):
            values.extend(enc.ids(t))
            ends.append(len(values))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, ids) of every row of ``df``, without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a text are ordinary text. Rows that repeat
    a key stay, an empty table gives an empty table, and other columns of ``df`` aren't read.
    """
    kind = df.schema[key].dataType.simpleString()
    return per_batch(df.select(key, text), f"`{key}` {kind}, ids array<int>", _encode, path, key, text)


def _count(path: str, keys: tuple[str, ...], text: str, name: str):
    enc = encoder(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([enc.count(t) for t in texts(batch.column(text))], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), n], [*keys, name])

    return run


def count_tokens(df: DataFrame, keys: tuple[str, ...], text: str = "text", name: str = "n_tokens", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``keys`` and the number of ids of every row; 0 for null and empty texts."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return per_batch(df.select(*keys, text), f"{schema}, `{name}` bigint", _count, path, keys, text, name)


def _decode(path: str, key: str, ids: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = bytes_of_id(path)
        lists = batch.column(ids).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array([decode(x, path) for x in lists], pa.string()), pa.array([sum(len(known.get(i, b"")) for i in x or ()) for x in lists], pa.int64())], [key, "text", "n_bytes"])

    return run


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, text, n_bytes) of lists of ids: their text, and the bytes up to which their offsets run. A null list gives an
    empty text."""
    kind = df.schema[key].dataType.simpleString()
    return per_batch(df.select(key, ids), f"`{key}` {kind}, text string, n_bytes bigint", _decode, path, key, ids)
