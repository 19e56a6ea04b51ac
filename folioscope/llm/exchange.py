"""Word hashes and packed exchanges: many small entries travel as a few binary rows.

An entry is a hash owned by a document, perhaps with a position. A task takes its documents in chunks of bounded size and packs a
chunk's entries by bucket, each bucket holding a share of the hash space; a bucket's rows meet in one group, whose size is bounded
because the number of buckets follows the size of the input and because each chunk sends an entry that many of its documents share once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a chunk holds, short of a single longer text.
CHUNK_WORDS = 500_000
#: Bytes of text whose entries a bucket holds, about.
BUCKET_BYTES = 12_000_000
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "bucket int, hashes binary, positions binary, ids binary, counts binary, tags binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, LF, VT, FF and CR, as bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE)])
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, inverse)])


class ByteHashes(Powers):
    """64-bit hashes of the words of a text, from its bytes without an object for each: differences of a power series, as for windows."""

    #: Bytes of a text that are worked on at once, short of a longer word.
    BLOCK = 500_000
    VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
    SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
    _END = re.compile(rb"[\x20\x09-\x0D]")

    def of(self, raw: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(raw):
            end = self._END.search(raw, at + self.BLOCK) if at + self.BLOCK < len(raw) else None
            to = end.start() if end else len(raw)
            parts.append(self._block(np.frombuffer(raw, np.uint8, to - at, at)))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _block(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        self._grow(n)
        edge = np.empty(n + 2, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = self.SPACE[codes]
        bounds = np.flatnonzero(edge[1:] != edge[:-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.VALUES[codes] * self.powers[:n], out=sums[1:])
        begin, end = bounds[::2], bounds[1::2]
        return mixed((sums[end] - sums[begin]) * self.inverses[begin])


class Windows(Powers):
    """Hashes of all windows of so many words: differences of a power series modulo 2^64, its base odd and so invertible."""

    def of(self, h: np.ndarray, size: int) -> np.ndarray:
        n = len(h)
        if n < size:
            return np.zeros(0, np.uint64)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.powers[:n], out=sums[1:])
        return mixed((sums[size:] - sums[: n - size + 1]) * self.inverses[: n - size + 1])


def bucket_count(docs: DataFrame, text: str, least: int = 8) -> int:
    """Buckets for the input's size, by the bytes of its texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return max(least, -(-int(size) // BUCKET_BYTES))


def chunks(batches: Iterable[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """The rows again, in frames of about CHUNK_WORDS words by length."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in batches:
        lengths = frame[text].str.len().fillna(0).to_numpy()
        start = 0
        for i, n in enumerate(lengths):
            size += int(n) // 6 + 1
            if size >= CHUNK_WORDS:
                held.append(frame.iloc[start : i + 1])
                yield pd.concat(held, ignore_index=True)
                held, size, start = [], 0, i + 1
        if start < len(frame):
            held.append(frame.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def pack(hashes: np.ndarray, owner: np.ndarray, ids: np.ndarray, buckets: int, positions: np.ndarray | None = None, tags: np.ndarray | None = None, short: bool = True, bucket: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of SCHEMA for entries in the order of their owners, an index into ids (and tags); short: 32 bits of each hash, beside its bucket.

    Where bucket is given, it deals the entries, not their hashes.
    """
    bucket = (hashes % np.uint64(buckets) if bucket is None else bucket).astype(np.uint16 if buckets <= 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    sent = (hashes[order] >> np.uint64(32)).astype(np.uint32) if short else hashes[order]
    at = positions[order].astype(np.uint32) if positions is not None else None
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = owner[a:b]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        docs = own[first]
        counts = np.diff(np.r_[first, b - a]).astype(np.uint32)
        rows.append((int(bucket[a]), sent[a:b].tobytes(), b"" if at is None else _narrow(at[a:b]), ids[docs].tobytes(), counts.tobytes(), b"" if tags is None else tags[docs].tobytes()))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def _narrow(at: np.ndarray) -> bytes:
    return b"\2" + at.astype(np.uint16).tobytes() if at.max(initial=0) < 65536 else b"\4" + at.tobytes()


class Unpacked:
    """A bucket's entries: hashes, id (and tag) of each, positions."""

    def __init__(self, rows: pd.DataFrame, short: bool = True):
        join = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
        self.hashes = join("hashes", np.uint32 if short else np.uint64)
        counts = join("counts", np.uint32)
        self.ids = np.repeat(join("ids", np.int64), counts)
        self.tags = np.repeat(tags, counts) if len(tags := join("tags", np.int64)) else None
        parts = [np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1).astype(np.uint32) for x in rows["positions"] if x]
        self.positions = np.concatenate(parts) if parts else None


def runs(sorted_hashes: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length at the end."""
    n = len(sorted_hashes)
    return np.flatnonzero(np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1], True]) if n else np.zeros(1, np.int64)
