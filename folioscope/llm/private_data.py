"""Personal data: base patterns and a character-level BiLSTM-CRF that adds what they miss.

Base spans come from fixed patterns, leftmost and not overlapping within a kind, over the whole text; what fails a pattern's check is
dropped. The network reads overlapping windows that cover the whole of every text; where windows overlap, their emissions are averaged,
those near a window's edge counting less, and the best tags of the whole text are found by Viterbi: where the network is so sure of
"no span" that the best path can't leave it (a bound by its own weights), the text is cut, and the stretches between are decoded. What it
finds is added if its digits or parts make sense for the kind and it overlaps no base span.

Training spans are made by a seeded generator of bounded size (``examples``), as text with labelled spans.

Defined results: null and empty texts have no spans; texts of any length are read whole, long ones piece by piece, with the same result;
repeated rows get the same spans; offsets count code points, ends exclusive; other columns are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import KINDS, Tagger, encode, train

#: Characters of a window, of a labelled example, and from one window's beginning to the next; windows that go through the network at once.
WINDOW, EXAMPLE, STRIDE, ROWS = 224, 96, 192, 1024
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs are taken whole: giving digits back never makes one of these match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"\s*@\s*|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+", re.I)
_DOT = re.compile(r"\s*\.\s*|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+", re.I)
_DATE = re.compile(r"(?:1[0-9]|2[01])[0-9]{2}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2(?:1[0-9]|2[01])[0-9]{2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def sensible(kind: str, found: str) -> bool:
    """Whether what the network tagged can be of its kind."""
    digits = digits_of(found)
    if kind == "email":
        parts = _AT.split(found)
        if len(parts) != 2 or not re.fullmatch(r"[\w.%+-]+", parts[0]):
            return False
        host = _DOT.split(parts[1])
        return len(host) > 1 and all(re.fullmatch(r"[\w-]+", h) for h in host) and bool(re.fullmatch(r"[^\W\d_]{2,12}", host[-1]))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\s?[\[({]?\s?(\.|dot)\s?[\])}]?\s?[0-9]+){3}", found, re.I)) and _octets(re.findall("[0-9]+", found))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./_-]", found)
    if not 8 <= len(digits) <= 15 or re.search(r"[^0-9 ()./+-]", found) or _DATE.fullmatch(found):
        return False
    return bool(re.search(r"[ ()./+-]", found)) and (found[0] in "+0(" or bool(re.fullmatch(r"[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}", found)))


# ---- labelled examples -------------------------------------------------------------------------------------------------------------

_SYLLABLES = ("an", "er", "th", "in", "re", "on", "es", "tion", "ed", "ti", "de", "la", "ver", "ung", "ment", "qu", "ou", "é", "ía", "co", "sch", "ar")


#: Words that look like parts of addresses which are spelled out.
_SHORT = ("at", "a", "to", "do", "dot", "that", "data", "add", "odd", "At", "et", "da")


def _word(rng: np.random.Generator) -> str:
    if rng.random() < 0.08:
        return _SHORT[rng.integers(0, len(_SHORT))]
    return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card_number(rng: np.random.Generator) -> str:
    head = _number(rng, 15)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _ascii(rng: np.random.Generator) -> str:
    return _word(rng).encode("ascii", "ignore").decode() or "user"


def _made(rng: np.random.Generator, kind: str) -> str:
    pick = lambda *x: x[rng.integers(0, len(x))]
    if kind == "email":
        user = _ascii(rng) + pick("", ".", "_", "-") + pick(str(rng.integers(0, 99)), _ascii(rng))
        host = [_ascii(rng) + pick("", "", "-x"), pick("com", "org", "de", "example", "net", "fr", "info")]
        if rng.random() < 0.2:
            host.insert(0, _ascii(rng))
        how = rng.random()
        if how < 0.35:
            return user + pick("@", "@", " @ ") + ".".join(host)
        if how < 0.6:  # spelled out, as words
            return user + pick(" at ", " AT ") + pick(" dot ", " DOT ").join(host)
        left, right = pick("[]", "()", "{}")
        blank, out = pick("", " "), pick("", " ")
        at, dot = pick(("at", "dot"), ("AT", "DOT"))
        return user + f"{out}{left}{blank}{at}{blank}{right}{out}" + pick(".", f"{out}{left}{blank}{dot}{blank}{right}{out}").join(host)
    if kind == "ip":
        return pick(".", ".", " . ", "[.]", "(.)", " dot ", ". ").join(str(n) for n in rng.integers(0, 256, 4))
    if kind == "card":
        n = _card_number(rng)
        return pick("", " ", "-", ".", "/", "_").join(n[i : i + 4] for i in range(0, 16, 4))
    area, rest, country = _number(rng, 3), _number(rng, 7), rng.integers(1, 99)
    return pick(
        f"+{country} {area} {rest}", f"+{country}-{area}-{rest[:3]}-{rest[3:]}", f"({area}) {rest[:3]}-{rest[3:]}", f"00{rng.integers(10, 99)} {area} {rest}", f"00{rng.integers(10, 99)}-{area}-{rest}", f"0{area}/{rest}",
        f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"{area} {rest[:3]} {rest[3:]}", f"0{area[:2]} {rest[:4]} {_number(rng, 4)}", f"0{area} {rest[:3]} {rest[3:]}", f"(0{area[:2]}) {rest}", f"+{country} (0) {area} {rest}", f"0{area}-{rest}",
    )


def _decoy(rng: np.random.Generator) -> str:
    pick = lambda *x: x[rng.integers(0, len(x))]
    year, month, day = rng.integers(1900, 2030), rng.integers(1, 13), rng.integers(1, 29)
    return pick(
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month}/{day}/{year}", f"{year}-{year + 5}", f"{rng.integers(0, 999)}.{_number(rng, 2)}", f"{rng.integers(1, 999)},{_number(rng, 3)},{_number(rng, 3)}.{_number(rng, 2)}",
        f"v{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}", _number(rng, int(rng.integers(1, 8))), f"{rng.integers(0, 24)}:{_number(rng, 2)}", rng.bytes(20).hex(), f"@{_word(rng)}", f"{_word(rng)}@", f"key = \"{rng.bytes(12).hex()}\"",
        f"#{_number(rng, 5)}", f"({rng.integers(1, 60)})", _number(rng, 25), f"978-{_number(rng, 1)}-{_number(rng, 2)}-{_number(rng, 6)}-{_number(rng, 1)}", f"{_word(rng)} at {_word(rng)}", f"{_word(rng)} dot {_word(rng)}", f"{_word(rng)} (at) {_word(rng)}", f"{_word(rng)}.{_word(rng)}",
        f"at {_word(rng)} {_word(rng)}", f"{_number(rng, 3)}-{_number(rng, 2)}", f"{_number(rng, 2)} {_number(rng, 2)} {_number(rng, 3)}",
    )


def examples(n: int = 4000, seed: int = 13) -> list[tuple[str, list[Span]]]:
    """n texts of EXAMPLE characters with their labelled spans; a third of them are words alone."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        text, spans, rare = "", [], (0.2, 0.2, 0.0)[k % 3]
        while len(text) < EXAMPLE:
            what = rng.random()
            if what < rare:
                kind = KINDS[rng.integers(0, len(KINDS))]
                made = _made(rng, kind)
                if len(text) + len(made) > EXAMPLE:
                    break
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += _decoy(rng) if what < rare * 2 else _word(rng).title() if what > 0.95 else _word(rng)
            text += (" ", " ", " ", " ", ", ", ".\n", "### ", "&&& ", ". ")[rng.integers(0, 9)]
        out.append((text[:EXAMPLE].ljust(EXAMPLE), spans))
    return out


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * KINDS.index(kind)
        y[a] -= 1
    return y


def fit(labelled: list[tuple[str, list[Span]]], **params) -> Tagger:
    """A tagger trained on texts of one length with labelled spans."""
    return train(np.stack([encode(t) for t, _ in labelled]), np.stack([tags_of(t, s) for t, s in labelled]), **params)


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return fit(examples())


# ---- reading texts -----------------------------------------------------------------------------------------------------------------

_EDGE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
_BLANK = int(encode("\n")[0])


def _pieces(texts: list[str], rows: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (index, first window, end window), of about so many windows; long texts come in several pieces."""
    group, size = [], 0
    for i, t in enumerate(texts):
        windows = -(-len(t) // STRIDE)
        for k in range(0, windows, rows):
            n = min(rows, windows - k)
            if size + n > rows and group:
                yield group
                group, size = [], 0
            group.append((i, k, k + n))
            size += n
    if group:
        yield group


def _live(texts: list[str], model: Tagger, group: list[tuple[int, int, int]], safe: tuple[float, float, float]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index, start, emissions) of the stretches of a group's pieces in which the best path may hold a span."""
    # two windows before a piece's first one give the whole emissions of the characters that its stretches reach back to
    heads = [max(0, k - 2) for _, k, _ in group]
    place = np.cumsum([0] + [end - h for (_, _, end), h in zip(group, heads)])
    x = np.full((WINDOW, place[-1]), _BLANK, np.int64)
    for (i, _, end), h, at in zip(group, heads, place):
        codes = encode(texts[i][h * STRIDE : (end - 1) * STRIDE + WINDOW])
        for w in range(end - h):
            part = codes[w * STRIDE : w * STRIDE + WINDOW]
            x[: len(part), at + w] = part
    e = model.emissions(x)
    margin, fixed, each = safe
    over_first = (e[:, 2::2] - e[:, 1::2]).max(1)
    sure = np.ascontiguousarray((e[:, 0] - e[:, 1:].max(1) > margin).T)
    over = WINDOW - STRIDE
    for (i, first, end), h, at in zip(group, heads, place):
        both = sure[at : at + end - h, :STRIDE].copy()
        both[1:, :over] &= sure[at : at + end - h - 1, STRIDE:]
        n = min(len(texts[i]), end * STRIDE) - h * STRIDE
        doubt = np.flatnonzero(~both[first - h :].ravel()[: n - (first - h) * STRIDE]) + (first - h) * STRIDE
        if not len(doubt):
            continue
        # how far back from each of these a span may begin; where windows overlap either may say
        row, off = doubt // STRIDE, doubt % STRIDE
        above = over_first[off, at + row]
        twice = (off < over) & (row > 0)
        above[twice] = np.maximum(above[twice], over_first[off[twice] + STRIDE, at + row[twice] - 1])
        back = doubt - np.minimum(np.ceil((fixed + np.maximum(above, 0)) / each).astype(np.int64), STRIDE)
        # in order of their last characters, stretches that touch are one
        low = np.minimum.accumulate(back[::-1])[::-1]
        cuts = np.flatnonzero(low[1:] > doubt[:-1] + 1)
        starts, stops = np.maximum(low[np.r_[0, cuts + 1]], 0), doubt[np.r_[cuts, len(doubt) - 1]] + 1
        for a, b in zip(starts.tolist(), stops.tolist()):
            spot = np.arange(a, b)
            row, off = spot // STRIDE, spot % STRIDE
            total, weight = e[off, :, at + row] * _EDGE[off][:, None], _EDGE[off].copy()
            twice = np.flatnonzero((off < over) & (row > 0))
            total[twice] += e[off[twice] + STRIDE, :, at + row[twice] - 1] * _EDGE[off[twice] + STRIDE][:, None]
            weight[twice] += _EDGE[off[twice] + STRIDE]
            yield i, h * STRIDE + a, total / weight[:, None]


def _tagged(texts: list[str], model: Tagger, rows: int = ROWS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index, start, tags) of stretches outside of which all tags are O."""
    safe = model.safe()
    held: list[tuple[int, int, np.ndarray]] = []

    def settle(some: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        joined: list[tuple[int, int, np.ndarray]] = []
        for i, a, e in some:
            if joined and joined[-1][0] == i and a <= (stop := joined[-1][1] + len(joined[-1][2])):
                joined[-1] = (i, joined[-1][1], np.concatenate([joined[-1][2], e[stop - a :]]))
            else:
                joined.append((i, a, e))
        tags = model.decode([e for _, _, e in joined], [a == 0 for _, a, _ in joined], [a + len(e) == len(texts[i]) for i, a, e in joined])
        return ((i, a, t) for (i, a, _), t in zip(joined, tags))

    for group in _pieces(texts, rows):
        # what is held may go on in the first piece of the group
        if held and held[-1][0] != group[0][0]:
            yield from settle(held)
            held = []
        held += _live(texts, model, group, safe)
        last = group[-1][0]
        done = [x for x in held if x[0] != last]
        yield from settle(done)
        held = [x for x in held if x[0] == last]
    yield from settle(held)


def find(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind, then start."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    for i, start, tags in _tagged(texts, model):
        for a in np.flatnonzero(tags % 2 == 1).tolist():
            b = a + 1
            while b < len(tags) and tags[b] == tags[a] + 1:
                b += 1
            kind, text = KINDS[(tags[a] - 1) // 2], texts[i][start + a : start + b]
            span = (kind, start + a, start + b)
            if sensible(kind, text) and not any(s[1] < span[2] and span[1] < s[2] for s in base[i]):
                added[i].append(span)
    order = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (order[s[0]], s[1]))) for b, a in zip(base, added)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def private_data(docs: DataFrame, model: Tagger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; the counts are of all spans."""
    model = model or default_tagger()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), 1000):
                some = frame.iloc[a : a + 1000]
                found = find([t or "" for t in some["text"].where(some["text"].notna(), None)], model)
                rows = [[sum(s[0] == k for s in every) for k in KINDS] + [hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)] for base, every in found]
                out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
                out.insert(0, "doc_id", some["doc_id"].astype("Int64").to_numpy() if some["doc_id"].isna().any() else some["doc_id"].to_numpy(np.int64))
                yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(read, schema)
