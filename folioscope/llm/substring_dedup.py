"""Substring dedup by fixed-block anchors: exact repeats of so many words across documents.

Each document is cut into non-overlapping reference blocks of half a window's words; a window of any text that repeats a window of
another document holds one of its blocks whole. All rolling windows of a block's size probe the blocks in one packed exchange; a
probe that meets a block of a smaller document is a hit. Around hits, and only there, the full windows' hashes meet in a second exchange
that knows the smallest document of each window: windows of larger documents are repeats, and adjacent ones join to maximal repeats.
A chunk of documents settles its own repeats and sends each window once, so groups of copies of any size stay small.

Defined results: null and empty texts have no words; documents with fewer words than a window keep all; rows with a null id are
returned untouched and nothing is compared with them; rows that repeat an id are no repeats of each other; ids are integers; an empty
table gives an empty result; texts of any length are read whole; other columns are not looked at, whatever their names. Words are
compared as they are, by 64-bit hashes of whole windows: exact but for two different windows of one hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_by_bytes, stash
from .exchange import SCHEMA, Unpacked, Windows, WordHashes, bucket_count, chunks, pack, runs, words_of

#: Hit positions travel in cells of so many words.
CELL = 16
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _flat(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, their tags and spots of rows that carry results."""
    join = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
    counts = join("counts", np.uint32)
    return np.repeat(join("ids", np.int64), counts), np.repeat(join("tags", np.int64), counts), join("positions", np.uint32)


def _dealt(own: np.ndarray, tag: np.ndarray, at: np.ndarray, slices: int, to: int | None = None) -> pd.DataFrame:
    """Results as few packed rows, by a slice of the documents or all to one bucket."""
    place = own % slices if to is None else np.full(len(own), to, np.int64)
    order = np.lexsort((tag, own, place))
    own, tag, at, place = own[order], tag[order], at[order].astype(np.uint32), place[order]
    rows = []
    edges = runs(place)
    for a, b in zip(edges[:-1], edges[1:]):
        first = np.flatnonzero(np.r_[True, (own[a + 1 : b] != own[a : b - 1]) | (tag[a + 1 : b] != tag[a : b - 1])]) + a
        counts = np.diff(np.r_[first, b]).astype(np.uint32)
        rows.append((int(place[a]), b"", at[a:b].tobytes(), own[first].tobytes(), counts.tobytes(), tag[first].tobytes()))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _joined(spread: int):
    """A group function that gives one row for each document of a slice: its spots, each so many words wide, as joined intervals."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        own, tag, at = _flat(rows)
        order = np.lexsort((at, tag, own))
        own, tag, at = own[order], tag[order], at[order].astype(np.int64)
        new = np.r_[True, (own[1:] != own[:-1]) | (tag[1:] != tag[:-1])] if len(own) else np.zeros(0, bool)
        start = np.flatnonzero(new | np.r_[True, at[1:] > at[:-1] + spread][: len(at)]) if len(own) else np.zeros(0, int)
        last = np.r_[start[1:], len(at)] - 1
        pairs = np.stack([at[start], at[last] + spread], 1).astype(np.uint32)
        first = np.flatnonzero(new[start]) if len(start) else start
        spots = [pairs[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(pairs)])]
        return pd.DataFrame({"doc_id": own[start][first], "tag": tag[start][first], "spots": spots})

    return merge


_MERGED = "doc_id long, tag long, spots binary"


def _hits(docs: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """(doc_id, tag, spots): of each document intervals of cells where a probe meets a block of another document."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, windows = WordHashes(), Windows()
        for frame in chunks(batches, "text"):
            ids = frame["doc_id"].to_numpy(np.int64)
            found = [windows.of(names.of(w), block) if len(w := words_of(t)) >= window else _NONE for t in frame["text"]]
            sizes = np.array([len(x) for x in found])
            if not sizes.sum():
                continue
            hashes, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
            at = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            order = np.argsort(hashes, kind="stable")
            edges = runs(hashes[order])
            length = np.diff(edges)
            sent = np.ones(len(hashes), bool)
            if (length > 1).any():
                several = np.repeat(length > 1, length)
                rows, part = order[several], runs(hashes[order[several]])
                own, run = ids[owner[rows]], np.repeat(np.arange(len(part) - 1), np.diff(part))
                # the smallest document with the block on its grid, and the largest with the words at all
                low = np.minimum.reduceat(np.where(at[rows] % block == 0, own, _HIGH), part[:-1])
                high = np.maximum.reduceat(own, part[:-1])
                hit = own > low[run]
                on_grid = (at[rows] % block == 0) & (own < high[run])
                keep = ~hit | (own == high[run]) & ~_seen(run, own)
                sent[rows] = keep
                marked = hit | on_grid
                if marked.any():
                    cell = owner[rows][marked].astype(np.int64) << 32 | (at[rows][marked] // CELL)
                    cell = np.unique(cell)
                    yield _dealt(ids[cell >> 32], np.zeros(len(cell), np.int64), cell & 0xFFFFFFFF, buckets, int(ids[0] % buckets))
            yield pack(hashes[sent], owner[sent], ids, buckets, at[sent])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["hashes"].str.len() == 0
        own, tag, at = _flat(rows[known])
        rows = rows[~known]
        if len(rows):
            got = Unpacked(rows)
            order = np.argsort(got.hashes, kind="stable")
            length = np.diff(runs(got.hashes[order]))
            several = order[np.repeat(length > 1, length)]
            if len(several):
                part = runs(got.hashes[several])
                who, spot = got.ids[several], got.positions[several]
                run = np.repeat(np.arange(len(part) - 1), np.diff(part))
                low = np.minimum.reduceat(np.where(spot % block == 0, who, _HIGH), part[:-1])
                high = np.maximum.reduceat(who, part[:-1])
                marked = (who > low[run]) | (spot % block == 0) & (who < high[run])
                own, at = np.r_[own, who[marked]], np.r_[at, spot[marked] // CELL]
                tag = np.zeros(len(own), np.int64)
        return _dealt(own, tag, at, buckets)

    met = docs.mapInPandas(send, SCHEMA).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, SCHEMA)
    return met.groupBy("bucket").applyInPandas(_joined(1), _MERGED)


_NONE = np.zeros(0, np.uint64)
_HIGH = np.iinfo(np.int64).max


def _seen(run: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether an earlier row of the same run has the same owner; rows of an owner are adjacent."""
    return np.r_[False, (run[1:] == run[:-1]) & (own[1:] == own[:-1])]


def _repeats(candidates: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """(doc_id, tag, spots): intervals of words in windows that a smaller document has too, of candidates (doc_id, text, cells)."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, windows = WordHashes(), Windows()
        for frame in chunks(batches, "text"):
            ids = frame["doc_id"].to_numpy(np.int64)
            tags = np.array([text_tag(t) for t in frame["text"]], np.int64)
            found, starts = [], []
            for t, cells in zip(frame["text"], frame["cells"]):
                h = windows.of(names.of(words_of(t)), window)
                cell = np.frombuffer(cells, np.uint32).astype(np.int64).reshape(-1, 2)
                # windows that hold a block that begins in a marked cell
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.clip(cell[:, 0] * CELL - (window - block), 0, len(h)), 1)
                np.add.at(edge, np.clip(cell[:, 1] * CELL, 0, len(h)), -1)
                start = np.flatnonzero(np.cumsum(edge)[: len(h)] > 0)
                found.append(h[start])
                starts.append(start)
            sizes = np.array([len(x) for x in found])
            if not sizes.sum():
                continue
            hashes, owner, at = np.concatenate(found), np.repeat(np.arange(len(found)), sizes), np.concatenate(starts).astype(np.uint32)
            order = np.argsort(hashes, kind="stable")
            part = runs(hashes[order])
            own = ids[owner[order]]
            low = np.repeat(np.minimum.reduceat(own, part[:-1]), np.diff(part))
            later = np.zeros(len(hashes), bool)
            later[order] = own > low
            if later.any():
                who = owner[later]
                yield _dealt(ids[who], tags[who], at[later], buckets, int(ids[0] % buckets))
            first = ~later
            yield pack(hashes[first], owner[first], ids, buckets, at[first], tags, short=False)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["hashes"].str.len() == 0
        own, tag, at = _flat(rows[known])
        rows = rows[~known]
        if len(rows):
            got = Unpacked(rows, short=False)
            order = np.argsort(got.hashes, kind="stable")
            part = runs(got.hashes[order])
            who = got.ids[order]
            later = order[who > np.repeat(np.minimum.reduceat(who, part[:-1]), np.diff(part))]
            own, tag, at = np.r_[own, got.ids[later]], np.r_[tag, got.tags[later]], np.r_[at, got.positions[later]]
        return _dealt(own, tag, at, buckets)

    met = candidates.mapInPandas(send, SCHEMA).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, SCHEMA)
    return met.groupBy("bucket").applyInPandas(_joined(window), _MERGED)


def text_tag(text: str | None) -> int:
    """Tells apart texts under one id."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, digests_only: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept is the rest of the words, joined by spaces, or with digests_only its SHA-256."""
    block = window // 2
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    real = rows.where("doc_id is not null")
    buckets = bucket_count(real, "text")
    cells = stash(_hits(real, block, window, buckets).select("doc_id", F.col("spots").alias("cells")), "cells")
    candidates = real.join(broadcast_by_bytes(cells, F.octet_length("cells") + 16), "doc_id").select("doc_id", "text", "cells")
    covered = stash(_repeats(candidates, block, window, buckets).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "spots")).alias("found")), "repeats")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for t, found in zip(frame["text"], frame["found"]):
                words, removed = words_of(t), 0
                if found is not None and (spots := [x["spots"] for x in found if x["tag"] == text_tag(t)]):
                    cover = np.frombuffer(b"".join(spots), np.uint32).astype(np.int64).reshape(-1, 2)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, cover[:, 0], 1)
                    np.add.at(edge, cover[:, 1], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                else:
                    kept = b" ".join(words)
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest() if digests_only else kept.decode("utf-8", "replace")))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept": [x[2] for x in out]})

    known = rows.join(broadcast_by_bytes(covered, F.aggregate("found", F.lit(16).cast("long"), lambda n, x: n + F.octet_length(x["spots"]) + 16)), "doc_id", "left").select("doc_id", "text", "found")
    return known.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")
