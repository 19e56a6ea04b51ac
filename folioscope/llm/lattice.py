"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

A text's segmentations have probabilities by the unigram model over its lattice of pieces; the vocabulary's scores are merge ranks, which
Zipf's rule turns into log probabilities (times ``alpha``). Adding Gumbel noise to all log probabilities and taking the k largest would
sample k of them without replacement; the perturbed A* search finds those without listing any: a node is a set of segmentations with a
common beginning, its bound the largest perturbed value in it, drawn top down given that of the set it was split from. Popping the
node with the largest bound yields the next segmentation, drawn step by step with the exact conditional probabilities of the lattice;
each step leaves a node of all other continuations there, whose bound is a Gumbel value cut off at the popped one. The (k+1)-th bound
is the threshold kappa of the inclusion scores 1 - exp(-exp(log p - kappa)).

Random numbers are a hash of the row's key, the node, the unit and the step, so a row's samples depend on nothing else. Units of a text
(between characters that no piece joins) have lattices of their own; those of a chunk's new units are built together.

Defined results: a null or empty text has one empty segmentation; fewer rows than k come where a text has fewer segmentations, then with
inclusion 1; characters outside the vocabulary become byte pieces; repeated rows with one id and text get the same samples; a
null id counts as an empty key; whole texts are used at any length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import mixed
from .pieces import DEFAULT_MODEL, Vocabulary, vocabulary

#: Characters that a chunk holds, short of a single longer text.
CHUNK_CHARS = 600_000
#: States of lattices that a worker keeps, about 130 bytes each.
KEPT_STATES = 1_600_000
#: Scores below are no merge ranks.
LEAST_SCORE = -1e6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP, _NODE = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def _times(n: int, by: np.uint64, plus: int = 0) -> np.uint64:
    return np.uint64((n * int(by) + plus) & 0xFFFFFFFFFFFFFFFF)


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Trie:
    """The vocabulary's pieces as a table of sorted (state, character) transitions."""

    def __init__(self, words: Vocabulary, alpha: float):
        low = min(s for s in words.scores.values() if s > LEAST_SCORE)
        # pieces without a rank, single characters and runs of spaces, get the lowest
        pieces = words.ids
        score = {p: max(words.scores[p], low) for p in pieces}
        norm = np.log(sum(1 / (10 - s) for s in score.values()))
        self.vocabulary, self.unknown = words, alpha * (-np.log(10 - low) - norm - 10)
        nodes, self.piece, self.weight = {"": 0}, [-1], [0.0]
        moves = {}
        for p, i in pieces.items():
            for n in range(1, len(p) + 1):
                if (head := p[:n]) not in nodes:
                    nodes[head] = len(nodes)
                    moves[nodes[head[:-1]] << 21 | ord(head[-1])] = nodes[head]
                    self.piece.append(-1)
                    self.weight.append(0.0)
            self.piece[nodes[p]], self.weight[nodes[p]] = i, alpha * (-np.log(10 - score[p]) - norm)
        self.keys = np.array(sorted(moves), np.int64)
        self.next = np.array([moves[k] for k in self.keys.tolist()], np.int64)
        self.piece, self.weight = np.array(self.piece), np.array(self.weight)
        self.byte_ids = np.array([words.byte_ids[b] for b in range(128)])


@lru_cache(maxsize=4)
def trie(path: str, alpha: float) -> Trie:
    return Trie(vocabulary(path), alpha)


class _Numbers(dict):
    """A unit's number; one that is asked for first gets the next, and is noted as new."""

    def __init__(self) -> None:
        self.next, self.new = 0, []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = self.next
        self.next += 1
        self.new.append(unit)
        return number


class Lattices:
    """The lattices of units that have been seen; a state is a character's place, or a unit's end.

    ``first[s]`` to ``first[s + 1]`` are a state's edges, likeliest first; ``upto`` sums their conditional probabilities. The lattices of
    units stay until there are too many states; then those of a chunk's new units only last for the chunk.
    """

    #: Arrays by unit, by state and by edge; each has room for more than is filled.
    UNITS, STATES, EDGES = ("begin", "last"), ("inner", "first"), ("start", "end", "piece", "share", "upto")

    def __init__(self, t: Trie, kept_states: int = KEPT_STATES):
        self.trie, self.kept_states = t, kept_states
        self.number = _Numbers()
        self.begin, self.last, self.first = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.inner = np.zeros(1024, bool)
        self.start, self.end, self.piece = (np.zeros(1024, np.int32) for _ in range(3))
        self.share, self.upto = np.zeros(1024), np.zeros(1024)
        self.base, self.passing = (0, 0, 0), []

    def number_of(self, parts: list[list[str]]) -> np.ndarray:
        """Numbers of the units of texts, one after the other; new ones are built."""
        number = self.number
        for u in self.passing:
            del number[u]
        number.next, number.new = self.base[0], []
        found = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        self.passing = []
        if number.new:
            filled = self._append(number.new, *self.base)
            if filled[1] <= self.kept_states:
                self.base = filled
            else:
                self.passing = number.new
        return found

    def _put(self, names: tuple[str, ...], at: int, *values: np.ndarray) -> None:
        for name, v in zip(names, values):
            held = getattr(self, name)
            if len(held) < at + len(v):
                more = np.zeros(max(2 * len(held), at + len(v)), held.dtype)
                more[:at] = held[:at]
                setattr(self, name, held := more)
            held[at : at + len(v)] = v

    def _append(self, new: list[str], u0: int, s0: int, e0: int) -> tuple[int, int, int]:
        t = self.trie
        sizes = np.array([len(u) for u in new], np.int64)
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
        last = begin + sizes
        states = int(sizes.sum() + len(sizes))
        inner = np.ones(states, bool)
        inner[last] = False
        char = np.full(states + 1, -1, np.int64)
        start = np.flatnonzero(inner)
        char[start] = codes
        left = np.repeat(last, sizes + 1) - np.arange(states)
        state, alone, depth, found = np.zeros(len(start), np.int64), np.zeros(states, bool), 0, []
        while len(start):
            key = state << 21 | np.maximum(char[start + depth], 0)
            at = np.searchsorted(t.keys, key)
            at[at == len(t.keys)] = 0
            good = t.keys[at] == key
            start, state = start[good], t.next[at[good]]
            full = t.piece[state] >= 0
            if depth == 0:
                alone[start[full]] = True
            depth += 1
            found.append((start[full], np.full(int(full.sum()), depth), t.piece[state[full]], t.weight[state[full]]))
        odd = np.flatnonzero(inner & ~alone)
        found.append((odd, np.ones(len(odd), np.int64), np.where(char[odd] < 128, t.byte_ids[np.minimum(char[odd], 127)], -2 - char[odd]), np.full(len(odd), t.unknown)))
        starts, over, piece, weight = (np.concatenate(x) for x in zip(*found))
        # from the units' ends backwards: the log sum of all segmentations from each state on
        order = np.argsort(left[starts] * states + starts)
        s, e, w = starts[order], (starts + over)[order], weight[order]
        heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        sizes_ = np.diff(np.r_[heads, len(s)])
        owner = np.repeat(np.arange(len(heads)), sizes_)
        levels = np.flatnonzero(np.r_[True, np.diff(left[s[heads]]) != 0, True])
        total = np.zeros(states)
        ends = np.r_[heads, len(s)]
        for a, b in zip(levels[:-1], levels[1:]):
            i, j = ends[a], ends[b]
            value = w[i:j] + total[e[i:j]]
            cuts = heads[a:b] - i
            top = np.maximum.reduceat(value, cuts)
            total[s[heads[a:b]]] = top + np.log(np.add.reduceat(np.exp(value - top[owner[i:j] - a]), cuts))
        share = np.exp(weight + total[starts + over] - total[starts])
        order = np.argsort(starts + 0.999 * (1 - np.minimum(share, 1.0)))
        starts, over, piece, share = starts[order], over[order], piece[order], share[order]
        first = np.searchsorted(starts, np.arange(states + 1))
        some = np.diff(first) > 0
        sums = np.cumsum(share)
        upto = sums - np.repeat(np.r_[0.0, sums][first[:-1][some]], np.diff(first)[some])
        upto[first[1:][some] - 1] = 2.0  # the last edge takes what rounding leaves
        self._put(self.UNITS, u0, begin + s0, last + s0)
        self._put(self.STATES, s0, inner, first[:-1] + e0)
        self._put(("first",), s0 + states, np.array([first[-1] + e0]))
        self._put(self.EDGES, e0, starts + s0, starts + over + s0, piece, share, upto)
        return u0 + len(new), s0 + states, e0 + len(starts)

    def pick(self, states: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state, by conditional probability."""
        edge = self.first[states]
        todo = np.flatnonzero(u >= self.upto[edge])
        while len(todo):
            edge[todo] += 1
            todo = todo[u[todo] >= self.upto[edge[todo]]]
        return edge

    def open(self, state: int) -> list[int]:
        """The state's edges."""
        return list(range(int(self.first[state]), int(self.first[state + 1])))


def _walk(lat: Lattices, states: np.ndarray, ends: np.ndarray, seeds: np.ndarray, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges drawn from each state to its end, concatenated in order, and how many each took."""
    who, at = np.flatnonzero(states < ends), states[states < ends]
    steps, counts = [], np.zeros(len(states), np.int64)
    while len(who):
        edge = lat.pick(at, uniform(seeds[who] + _times(step, _STEP)))
        steps.append((who, edge))
        counts[who] += 1
        at, step = lat.end[edge].astype(np.int64), step + 1
        on = at < ends[who]
        who, at = who[on], at[on]
    out, place = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
    for k, (w, e) in enumerate(steps):
        out[place[w] + k] = e
    return out, counts


class Sampler:
    """Samples of the texts of a chunk."""

    def __init__(self, path: str = DEFAULT_MODEL, alpha: float = 0.7, seed: int = 1, kept_states: int = KEPT_STATES):
        self.trie, self.seed = trie(path, alpha), seed
        self.vocabulary = self.trie.vocabulary
        self.lattices = Lattices(self.trie, kept_states)

    def sample(self, texts: list[str], keys: list[str], k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """(index, rank from 1, ids, log probability, perturbed value, inclusion) of each text's k samples."""
        lat, parts = self.lattices, list(map(self.vocabulary.fine_units, texts))
        sizes = np.array([len(p) for p in parts], np.int64)
        unit = lat.number_of(parts)
        place = np.r_[0, np.cumsum(sizes)]
        roots = np.array([xxhash.xxh3_64_intdigest(f"{self.seed}:{key}") for key in keys], np.uint64)
        within = np.arange(len(unit), dtype=np.int64) - np.repeat(place[:-1], sizes)
        seeds = mixed(np.repeat(roots, sizes) + within.astype(np.uint64) * _GOLDEN)
        edges, counts = _walk(lat, lat.begin[unit], lat.last[unit], seeds)
        offsets = np.r_[0, np.cumsum(counts)]
        spot = offsets[place]  # where each text's edges begin
        for i in range(len(texts)):
            path = edges[spot[i] : spot[i + 1]]
            yield from self._search(i, path, unit[place[i] : place[i + 1]], int(roots[i]), k)

    def _search(self, i: int, path: np.ndarray, unit: np.ndarray, root: int, k: int) -> Iterator[tuple]:
        """The perturbed A* search over one text; path is the first segmentation, drawn already."""
        lat, rank = self.lattices, 0
        bound = -np.log(-np.log(float(uniform(np.array([root], np.uint64) ^ _NODE)[0])))
        heap: list[tuple] = []
        found, node, first, barred = [], 0, 0, frozenset()
        while True:
            rank += 1
            share = lat.share[path]
            upto = np.cumsum(np.log(share))
            found.append((path, float(upto[-1]) if len(upto) else 0.0, bound))
            # a node of all other continuations at each step from the one where this path left its parent
            rest = 1.0 - share[first:]
            if barred:
                open_ = [e for e in lat.open(int(lat.start[path[first]])) if e not in barred and e != path[first]]
                rest[0] = lat.share[open_].sum() if open_ else 0.0
            some = np.flatnonzero(rest > 1e-13)
            if len(some):
                u = uniform(_times(node + 1, _NODE, root) + (some + first).astype(np.uint64) * _STEP)
                at = some + first
                mass = np.where(at > 0, upto[at - 1], 0.0) + np.log(rest[some])
                bounds = mass - np.log(np.exp(np.minimum(mass - bound, 700)) - np.log(u))
                need = k + 1 - rank
                best = np.argpartition(-bounds, need - 1)[:need] if len(bounds) > need else np.arange(len(bounds))
                for j in best.tolist():
                    heapq.heappush(heap, (-float(bounds[j]), len(found) - 1, int(at[j]), (barred if at[j] == first else frozenset()) | {int(path[at[j]])}))
            if rank == k or not heap:
                break
            top, parent, first, barred = heapq.heappop(heap)
            bound, node = -top, node + 1
            path = self._complete(found[parent][0], unit, first, barred, np.uint64(_times(node, _NODE, root)))
        kappa = -heap[0][0] if heap else -np.inf
        for r, (path, logp, value) in enumerate(found, 1):
            inclusion = 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(700.0, logp - kappa))))
            yield i, r, self.ids(path), logp, value, inclusion

    def _complete(self, parent: np.ndarray, unit: np.ndarray, first: int, barred: frozenset, seed: np.uint64) -> np.ndarray:
        """A path with the parent's beginning up to step first, then none of the barred edges, then anything."""
        lat = self.lattices
        state = int(lat.start[parent[first]])
        j = int(np.count_nonzero(~lat.inner[lat.end[parent[:first]]]))  # units that the beginning ends
        open_ = [e for e in lat.open(state) if e not in barred]
        share = np.cumsum(lat.share[open_])
        u = float(uniform(np.array([seed ^ np.uint64(first)], np.uint64))[0])
        edge = open_[min(int(np.searchsorted(share, u * share[-1], side="right")), len(open_) - 1)]
        states = np.r_[int(lat.end[edge]), lat.begin[unit[j + 1 :]]]
        seeds = mixed(seed + np.arange(j, len(unit)).astype(np.uint64) * _GOLDEN)
        tail, _ = _walk(lat, states, lat.last[unit[j:]], seeds, 1)
        return np.r_[parent[:first], edge, tail]

    def ids(self, path: np.ndarray) -> np.ndarray:
        """Piece ids; characters outside the vocabulary by their bytes."""
        got = self.lattices.piece[path]
        if (got >= 0).all():
            return got
        out: list[int] = []
        for p in got.tolist():
            out += [p] if p >= 0 else [self.vocabulary.byte_ids[b] for b in chr(-2 - p).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int64)


def segmentations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2, alpha: float = 0.7, seed: int = 1, path: str = DEFAULT_MODEL, kept_states: int = KEPT_STATES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, rank, ids, n_pieces, log_prob, perturbed, inclusion, ids_sha256, decoded) of k sampled segmentations of every row.

    ids is binary, two little-endian bytes a piece (the vocabulary has fewer than 65,536); decoded tells whether decoding gives the text back.
    kept_states and chunk_chars trade a worker's memory for time; they change no result.
    """

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(path, alpha, seed, kept_states)
        pieces, decode = sampler.vocabulary.texts, sampler.vocabulary.decode
        for frame in batches:
            sizes = frame["text"].str.len().fillna(0).to_numpy()
            part = (np.cumsum(sizes) // chunk_chars).astype(int)
            for p in np.unique(part):
                some = frame[part == p]
                texts = [t or "" for t in some["text"].where(some["text"].notna(), None)]
                names = [None if pd.isna(x) else int(x) for x in some["doc_id"]]
                rows, wanted = [], [(" " + t if t else t).encode("utf-8", "surrogatepass") for t in texts]
                for i, rank, ids, logp, value, inclusion in sampler.sample(texts, ["" if n is None else str(n) for n in names], k):
                    raw = ids.astype("<u2").tobytes()
                    rows.append((names[i], rank, raw, len(ids), logp, value, inclusion, hashlib.sha256(raw).hexdigest(), b"".join(map(pieces.__getitem__, listed := ids.tolist())) == wanted[i] or decode(listed) == texts[i]))
                out = pd.DataFrame(rows, columns=["doc_id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_sha256", "decoded"])
                yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, rank int, ids binary, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, decoded boolean"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(sampled, schema)
