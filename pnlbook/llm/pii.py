"""Personal data by rules and a semi-Markov conditional random field.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers
(leftmost, non-overlapping for each kind). The model adds spans that the rules
do not have: credentials and account numbers (``secret``, ``account``). It scores
whole candidate spans (their shape, length, digits, changes of character class,
checks and neighbours) instead of single tokens, and a dynamic programme over
entities of at most ``MOST_TOKENS`` tokens chooses boundaries and types of a
passage together. A run of ASCII letters, digits, ``-`` and ``_`` can also be one
unit of a span, so a credential's length and number of separators have no bound.
A sequence's probability is exp(sum of its spans' scores) over the sum for all
ways to cut the passage. Features are array operations over a passage; spans that
score below the empty label are left out of the programme, which changes nothing.

Training needs no labelled text. It sees two kinds of passages: a bounded sample
from the corpus (``fit``; by hash of the text, so it does not depend on
partitions), where the rules label their four kinds and the patterns in
``SEEDS`` some credentials; and ``PLANTED`` made-up ones between words of the
corpus, with credentials of many forms (some with no word that announces them),
account numbers, and ordinary numbers, dates, links and checksums without a
span. What the seed patterns find is always among all spans, also where the model
misses it. The model then runs over every text, wherever there is a trigger: a
digit, an at sign or a word that announces a credential (``CUE``). Spans without
a digit or an at sign are proposed up to ``REACH`` characters after such a word.
Its weights are one fixed-size array.

Edge cases: null and empty texts have no spans; texts without triggers end
after a few searches; long runs of digits or spaces and long tables of numbers
cost linear time; null ids and repeated rows are treated like any row; where the
corpus has nothing to learn from (an empty table too) the made-up passages alone
train the model; an empty table gives no rows. Only ``doc_id`` and the text are
read. Offsets are in code points, the end exclusive.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_arrow, slices, text_of

KINDS = ("email", "ip", "card", "phone", "secret", "account")       # in the order of ties
MOST_TOKENS = 16
SAMPLE_DOCS = 16_000
TEXT_PASSAGES = 2
PASSAGE_CHARS = 2000
MOST_PASSAGES = 1500
PLANTED = 2000
EPOCHS = 6
SIZE = 1 << 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile("[0-9@]")
# words that announce a credential, and the fixed head of an access key
CUE = r"(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|AKIA)"
_CUE = re.compile(CUE)
TRIGGER = "[0-9@]|" + CUE
_TRIGGER = re.compile(TRIGGER)
_RUN = re.compile("[A-Za-z0-9_-]+")
_CUE_PARTS = ("passw", "secret", "token", "api_key", "apikey")
REACH = 40
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
# seed patterns for credentials; the first group is the credential
SEEDS = re.compile(r"""(?:password|passwd|secret|token|api_?key)\s?[=:]\s?["']?([A-Za-z0-9_-]{8,})|\b(AKIA[A-Z0-9]{16})\b""")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def is_card(s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def rule_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:                                  # a local part reaches back from its @
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            end = m.end()
        elif a < at:
            end = max(end, at)                      # no later local part reaches back over this @
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if is_card(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=order)


def order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


BLOCK = 1024            # span starts that are scored at once


def has_cue(text: str) -> bool:
    """Whether there may be a cue; plain searches are faster than the expression."""
    low = text.lower()
    return "AKIA" in text or any(c in low for c in _CUE_PARTS)


def passages(text: str, before: int = 40, after: int = 40) -> list[tuple[int, int]]:
    """Stretches of text around triggers, cut at white space where there is some."""
    out: list[list[int]] = []
    for m in (_TRIGGER if has_cue(text) else _MARK).finditer(text):
        if out and m.start() < out[-1][1]:
            continue                                # inside the last one, whose end is cut at white space
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
        while out[-1][1] < len(text) and not text[out[-1][1] - 1].isspace():
            out[-1][1] += 1
        while out[-1][0] > (out[-2][1] if len(out) > 1 else 0) and not text[out[-1][0]].isspace():
            out[-1][0] -= 1
    return [(a, b) for a, b in out]


N_FEATURES = 16
BIAS = 0                # the feature that every span has
_ODD = 0x9E3779B97F4A7C15
_TURN = 0x2545F4914F6CDD1D                              # odd, so it has an inverse modulo 2^64
_BACK = pow(_TURN, -1, 1 << 64)
_PARTS = ("digit", "upper", "lower", "wide", "hexa", "space", "dot", "dash", "slash", "paren", "at", "under")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _upto(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(x, most).astype(np.uint64)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """Small numbers as one: each takes eight bits (the last may be larger)."""
    out: np.ndarray | int = 0
    for k, x in enumerate(parts):
        out = out | (np.asarray(x).astype(np.uint64) << np.uint64(8 * k))
    return np.asarray(out, np.uint64)


class Passage:
    """The tokens of a stretch of text and the candidate spans over them.

    All counts of characters in a span are differences of running sums, so a span
    costs the same whatever its length.
    """

    def __init__(self, text: str, a: int, b: int):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        n = len(self.tokens)
        words = [text[x:y] for x, y in self.tokens]
        at = np.array(self.tokens, np.int64).reshape(n, 2) - a
        x, y = self.x, self.y = at[:, 0], at[:, 1]
        u = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
        digit, upper, lower = (u >= 48) & (u <= 57), (u >= 65) & (u <= 90), (u >= 97) & (u <= 122)
        wide = u >= 0xAA
        parts = (digit, upper, lower, wide, (upper & (u <= 70)) | (lower & (u <= 102)), u == 32, u == 46, u == 45, u == 47, (u == 40) | (u == 41), u == 64, u == 95)
        kind = digit + 2 * upper + 3 * lower + 4 * wide
        self.sums = {c: np.concatenate(([0], np.cumsum(v))) for c, v in zip(_PARTS, parts, strict=True)}
        self.turns = np.concatenate(([0], np.cumsum(kind[1:] != kind[:-1]), [0]))      # changes of character class before a place
        # sums of a card's check for digits at even and at odd places
        value = u[digit].astype(np.int64) - 48
        twice = 2 * value - 9 * (value > 4)
        even = np.arange(len(value)) % 2 == 0
        self.luhn = [np.concatenate(([0], np.cumsum(np.where(even == e, value, twice)))) for e in (True, False)]
        self.word = np.array([w[0].isalnum() for w in words], bool)
        first = self.first = u[x].astype(np.uint64) if n else np.zeros(0, np.uint64)
        self.end_ok = self.word | (first == 41)
        self.plain = self.word | (first == 43) | (first == 40)
        # a token can follow the one before it in a span: at most one space between
        self.joined = np.zeros(n + 1, bool)
        if n:
            follow = u[np.minimum(y[:-1], len(u) - 1)]
            self.joined[1:n] = (x[1:] <= y[:-1] + 1) & (follow != 13) & (follow != 10) & (follow != 9)
        stop = np.where(self.joined, n + 1, np.arange(n + 1))
        self.chain = np.minimum.accumulate(stop[::-1])[::-1][1:] if n else np.zeros(0, np.int64)       # where the tokens joined to one end
        self.near = np.zeros(n, bool)                   # starts of spans that need no digit or at sign
        for m in _CUE.finditer(text, a, b):
            low = m.start() if m[0] == "AKIA" else m.end()
            self.near[np.searchsorted(x, low - a):np.searchsorted(x, m.end() + REACH - a)] = True
        self.run = np.zeros(n + 1, np.int64)            # the end token of the run that starts at a token
        if n:
            runs = np.array([m.span() for m in _RUN.finditer(text, a, b)], np.int64).reshape(-1, 2) - a
            i, j = np.searchsorted(x, runs[:, 0]), np.searchsorted(y, runs[:, 1])
            good = (i < n) & (j < n)
            good[good] = (x[i[good]] == runs[good, 0]) & (y[j[good]] == runs[good, 1])
            self.run[i[good]] = j[good] + 1
        self.name = np.array([zlib.crc32(w.lower()[:12].encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        count = lambda c: self.sums[c][y] - self.sums[c][x]
        code = np.where(self.word, _mix(_upto(count("digit"), 5), _upto(count("upper"), 2), _upto(count("lower"), 2), _upto(y - x, 4), 1), first << np.uint64(40))
        gap = np.concatenate(([0], x[1:] > y[:-1])).astype(np.uint64) if n else code
        self.code = code * np.uint64(_ODD)
        placed = (self.code + gap * np.uint64(_TURN)) * _powers(_TURN, n)[:n]
        self.shapes = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)))
        self.back = _powers(_BACK, n)[:n]

    def spans(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, end token) of the spans that start at tokens low to high - 1: up to
        ``MOST_TOKENS`` tokens, or as many units, a whole run being one."""
        n = len(self.tokens)
        i = np.arange(low, min(high, n))
        if not len(i):
            return i, i
        j = i[:, None] + 1 + np.arange(MOST_TOKENS)
        fits = self.plain[i][:, None] & (j <= self.chain[i][:, None]) & self.end_ok[np.minimum(j, n) - 1]
        starts, ends = [np.broadcast_to(i[:, None], j.shape)[fits]], [j[fits]]
        end = self.run[i]
        live = end > 0
        inside = self.plain[i] & (end - i <= MOST_TOKENS) & self.end_ok[end - 1]
        starts.append(i[live & ~inside])
        ends.append(end[live & ~inside])
        live &= self.plain[i]
        for _ in range(MOST_TOKENS - 1):
            live = live & (end < n) & self.joined[np.minimum(end, n)]
            if not live.any():
                break
            end = np.where(live, np.where(self.run[end] > 0, self.run[end], end + 1), end)
            far = live & (end > i + MOST_TOKENS) & self.end_ok[end - 1]
            starts.append(i[far])
            ends.append(end[far])
        i, j = np.concatenate(starts), np.concatenate(ends)
        marks = self.sums["digit"] + self.sums["at"]
        keep = self.near[i] | (marks[self.y[j - 1]] > marks[self.x[i]])
        i, j = i[keep], j[keep]
        order = np.lexsort((j, i))
        return i[order], j[order]

    def candidates(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Spans (first token, end token) that start at tokens low to high - 1, and their features."""
        i, j = self.spans(low, high)
        m, n = len(i), len(self.tokens)
        if not m:
            return np.zeros((0, 2), np.int64), np.zeros((0, N_FEATURES), np.int64)
        a, b = self.x[i], self.y[j - 1]
        c = {k: v[b] - v[a] for k, v in self.sums.items()}
        size, digits = b - a, c["digit"]
        letters = c["upper"] + c["lower"] + c["wide"]
        other = size - digits - letters
        first_digit = self.sums["digit"][a]
        last = first_digit + digits
        total = np.where((last - 1) % 2 == 0, self.luhn[0][last] - self.luhn[0][first_digit], self.luhn[1][last] - self.luhn[1][first_digit])
        card = (digits >= 12) & (digits <= 19) & (digits + c["space"] + c["dash"] == size) & (total % 10 == 0)
        ip = (c["dot"] == 3) & (digits + 3 == size)
        for k in np.flatnonzero(ip):
            s = self.text[self.tokens[i[k]][0]:self.tokens[j[k] - 1][1]]
            ip[k] = bool(_IP.fullmatch(s)) and is_ip(s)
        pure = other == 0
        mixed = pure & (digits > 2) & (letters > 2)
        hexed = mixed & (c["hexa"] == letters)
        one_case = (c["upper"] == letters) | (c["lower"] == letters)
        turns = self.turns[b - 1] - self.turns[a]
        word, none = self.word, np.uint64(1 << 40)
        left = np.where(i > 0, self.name[np.maximum(i - 1, 0)], none)
        left2 = np.where(i > 1, self.name[np.maximum(i - 2, 0)] * np.uint64(3), none) + left
        before = np.where(i > 0, np.where(word[i - 1], np.uint64(1), self.first[i - 1] + np.uint64(2)), np.uint64(0))
        next_ = np.minimum(j, n - 1)
        after = np.where(j < n, np.where(word[next_], (self.x[next_] > b) + np.uint64(1), self.first[next_] + np.uint64(3)), np.uint64(0)).astype(np.uint64)
        start = np.where(word[i], np.uint64(0), self.first[i])
        shape = (self.shapes[j] - self.shapes[i + 1]) * self.back[i] + self.code[i]
        symbols = other - c["space"] - c["dot"] - c["dash"] - c["slash"] - c["paren"] - c["at"] - c["under"]
        values = [
            shape, _upto(size, 48) // np.uint64(4), _upto(digits, 20), _upto(letters, 20), _mix(card, ip, c["at"] > 0),
            _mix(mixed, hexed, one_case, _upto(size, 40) // np.uint64(8)), _mix(j - i == 1, start), _mix(c["space"] > 0, _upto(c["dot"], 9), c["paren"] > 0, c["dash"] > 0),
            left, left2, after, _mix(mixed, _upto(digits, 9), 0, 0, after) ^ (before * np.uint64(_TURN)),
            _mix(_upto(turns, 12), _upto(size, 40) // np.uint64(6), c["space"] > 0), _mix(self.near[i], _upto(size, 24) // np.uint64(4), c["space"] > 0, before),
            _mix(_upto(c["slash"], 3), _upto(symbols, 3), c["under"] > 0, digits > 0, letters > 0, one_case),
        ]
        out = np.empty((m, N_FEATURES), np.int64)
        for k, v in enumerate(values):
            h = (v + np.uint64((k + 1) * _BACK & (1 << 64) - 1)) * np.uint64(_ODD)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_TURN)
            out[:, k] = (h >> np.uint64(40)).astype(np.int64) % (SIZE - 1) + 1
        out[:, -1] = BIAS
        return np.stack((i, j), axis=1), out


class Model:
    """Weights (kinds x features); a token outside of all spans scores 0."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(KINDS), len(features)))
        for f in features.T:
            out += self.w[:, f]
        return out.T

    def best(self, p: Passage) -> list[tuple[int, int, str]]:
        """The most probable cut: (first token, end token, kind) of its spans.

        Values go forward from each token to the ends of the spans that start
        there; spans are scored a block of starts at a time.
        """
        n = len(p.tokens)
        value, back = [-np.inf] * (n + 1), [(-1, 0)] * (n + 1)
        value[0] = 0.0
        for low in range(0, n, BLOCK):
            segments, features = p.candidates(low, low + BLOCK)
            s = self.scores(features)
            top = s.max(axis=1) if len(s) else np.zeros(0)
            use = np.flatnonzero(top > 0)                # others are never better than no span
            first, end = segments[use].T.tolist() if len(use) else ([], [])
            kind, score = s[use].argmax(axis=1).tolist() if len(use) else [], top[use].tolist()
            k = 0
            for i in range(low, min(low + BLOCK, n)):
                if value[i] >= value[i + 1]:
                    value[i + 1], back[i + 1] = value[i], (-1, 0)
                while k < len(first) and first[k] == i:
                    j = end[k]
                    if value[i] + score[k] > value[j]:
                        value[j], back[j] = value[i] + score[k], (i, kind[k])
                    k += 1
        out, j = [], n
        while j:
            i, kind = back[j]
            if i >= 0:
                out.append((i, j, KINDS[kind]))
            j = i if i >= 0 else j - 1
        return out[::-1]

    def forward_backward(self, n: int, segments: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
        """(log partition, probability of each segment and kind) over n tokens, from scores ``s``."""
        if not len(s):
            return 0.0, s
        total = np.logaddexp.reduce(s, axis=1)
        f, b = np.zeros(n + 1), np.zeros(n + 1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(np.asarray(segments).tolist()):
            by_end[j].append(k)
            by_start[i].append(k)
        for j in range(1, n + 1):
            f[j] = np.logaddexp.reduce([f[j - 1], *(f[segments[k, 0]] + total[k] for k in by_end[j])])
        for i in range(n - 1, -1, -1):
            b[i] = np.logaddexp.reduce([b[i + 1], *(b[segments[k, 1]] + total[k] for k in by_start[i])])
        i, j = np.array(segments).T
        return float(f[n]), np.exp(s + (f[i] + b[j] - f[n])[:, None])


def seed_spans(text: str) -> list[Span]:
    return [("secret", *m.span(1 if m[1] else 2)) for m in SEEDS.finditer(text)] if has_cue(text) else []


def gold(text: str) -> list[Span]:
    """Training spans: the rules' and the seeds', without overlaps (the longer first)."""
    spans = rule_spans(text) + seed_spans(text)
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], order(s))):
        if all(s[2] <= o[1] or o[2] <= s[1] for o in out):
            out.append(s)
    return out


Example = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def examples(text: str, spans: list[Span] | None = None) -> list[Example]:
    """Passages of a text (of at most a block of tokens): token count, candidate
    spans, features, and the kind of those that are spans (-1 for the others)."""
    out, spans = [], gold(text) if spans is None else spans
    for a, b in passages(text):
        p = Passage(text, a, b)
        segments, features = p.candidates(0, BLOCK)
        at = {(p.tokens[i][0], p.tokens[j - 1][1]): k for k, (i, j) in enumerate(segments.tolist())}
        mine = [s for s in spans if s[1] < b and s[2] > a]
        if len(segments) and len(p.tokens) <= BLOCK and all((s[1], s[2]) in at for s in mine):
            y = np.full(len(segments), -1)
            for s in mine:
                y[at[s[1], s[2]]] = KINDS.index(s[0])
            out.append((len(p.tokens), segments, features, y))
    return out


_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LOWER = _UPPER.lower()
_CUES = ("password", "Password", "passwd", "pwd", "pass", "secret", "SECRET", "token", "TOKEN", "api_key", "apikey", "API key", "access key", "client_secret",
         "auth", "Authorization: Bearer", "Bearer", "credential", "private_key", "login", "key")
_LINKS = ("=", ": ", ":", " = ", ' = "', "='", " is ", " is: ", " ")


def _value(rng: random.Random) -> tuple[str, bool]:
    """A made-up credential, and whether it shows without a word before it."""
    some = lambda chars, low, high: "".join(rng.choices(chars, k=rng.randint(low, high)))
    full = _UPPER + _LOWER + _DIGITS
    make = rng.randrange(8)
    if make == 0:
        return some("0123456789abcdef", 20, 64), False      # alone it may be a checksum
    if make == 1:
        return some(full, 18, 48), True
    if make == 2:                                       # a short head and a long rest
        return some(_LOWER if rng.random() < 0.7 else _UPPER, 2, 6) + rng.choice("_-") + (some(_LOWER, 2, 5) + rng.choice("_-") if rng.random() < 0.3 else "") + some(full, 16, 44), True
    if make == 3:                                       # parts with points between
        return ".".join(some(full + "_-", 8, 44) + some(full, 2, 4) for _ in range(rng.randint(2, 3))), True
    if make == 4:
        return "/".join(some(full + ("+" if rng.random() < 0.3 else ""), 4, 20) + some(full, 1, 2) for _ in range(rng.randint(2, 4))), rng.random() < 0.3
    if make == 5:                                       # as people choose them
        return some(full, 3, 7) + rng.choice("!$%&*#^") + some(full, 1, 6), False
    if make == 6:
        return "-".join(some(_UPPER + _DIGITS, 5, 5) for _ in range(rng.randint(3, 5))), True
    return some(_LOWER + _UPPER, 8, 24), False


def _account(rng: random.Random) -> str:
    """A made-up bank account or personal number."""
    digits = lambda k: "".join(rng.choices(_DIGITS, k=k))
    if rng.random() < 0.4:
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    rest = digits(rng.randint(12, 24))
    if rng.random() < 0.3:
        rest = "".join(rng.choices(_UPPER, k=4)) + rest[4:]
    gap = " " if rng.random() < 0.6 else ""
    return "".join(rng.choices(_UPPER, k=2)) + digits(2) + gap + gap.join(rest[k:k + 4] for k in range(0, len(rest), 4))


def _ordinary(rng: random.Random) -> str:
    """Numbers and names that are no personal data."""
    n = lambda low, high: rng.randint(low, high)
    make = rng.randrange(15)
    word = "".join(rng.choices(_LOWER, k=n(3, 9)))
    return (f"{n(1800, 2100)}-{n(1, 12):02}-{n(1, 31):02}", f"{n(1, 31)}.{n(1, 12)}.{n(1900, 2030)}", f"{n(0, 23)}:{n(0, 59):02}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 99)}",
            f"{n(1, 999)},{n(0, 999):03}.{n(0, 99):02}", f"{n(0, 100)}%", f"{n(1, 99)}-{n(100, 200)}", f"No. {n(1, 10 ** n(2, 8))}",
            f"https://www.{word}.org/{word}/{n(1, 9999)}.html", f"{word}_{n(1, 99)}.txt", f"ISBN 978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}",
            f"{word.title()}{word.title()}{n(1, 9)}",
            "".join(rng.choices("0123456789abcdef", k=n(20, 64))), rng.choice((" ", " ", "  ", ", ", "; ", "\t")).join(str(n(0, 10 ** n(1, 5))) for _ in range(n(3, 24))),
            "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)))[make]


def planted(words: list[str], count: int = PLANTED) -> list[tuple[str, list[Span]]]:
    """Made-up training passages between words of the corpus: credentials of many forms, with and
    without a word that announces them, account numbers, and ordinary numbers without a span."""
    rng, out = random.Random(0), []
    words = words or ["the"]
    for _ in range(count):
        left, right = (" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(2))
        left += rng.choice((" ", " ", "\n")) if left else ""
        make = rng.random()
        kind, value, lead = None, _ordinary(rng), rng.choice(("", "", "on ", "see ", "pass ", "the key ", "a token of "))
        if make < 0.5:
            kind, (value, alone) = "secret", _value(rng)
            lead = "" if alone and rng.random() < 0.4 else rng.choice(_CUES) + rng.choice(_LINKS)
        elif make < 0.65:
            kind, value, lead = "account", _account(rng), rng.choice(("", "", "account ", "IBAN: ", "SSN "))
        text = left + lead + value
        spans = [(kind, len(text) - len(value), len(text))] if kind else []
        close = lead[-1:] if lead[-1:] in ('"', "'") else rng.choice(("", "", ".", ","))
        text += close + (" " + right if right else "")
        if not any(s[1] < t[2] and t[1] < s[2] for s in spans for t in rule_spans(text)):
            out.append((text, gold(text) if not spans else spans + [s for s in rule_spans(text)]))
    return out


def train(texts: list[str], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Conditional likelihood by adaptive gradient steps, one passage at a time, on the
    texts' passages and on ``PLANTED`` made-up ones between their words."""
    data = [e for t in texts for e in examples(t)]
    words = sorted({w for t in texts[:2000] for w in re.findall(r"[^\W\d_]+", t[:2000])})
    data += [e for t, spans in planted(words) for e in examples(t, spans)]
    model = Model(np.zeros((len(KINDS), SIZE)))
    model.w[:, BIAS] = -3.0
    w, speed = model.w.reshape(-1), np.full(model.w.size, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            n, segments, features, y = data[k]
            _, prob = model.forward_backward(n, segments, model.scores(features))
            grad = -prob
            spans = np.flatnonzero(y >= 0)
            grad[spans, y[spans]] += 1
            rows, kinds = np.nonzero(np.abs(grad) > 1e-4)
            if len(rows):
                cell = (kinds[:, None] * SIZE + features[rows]).ravel()
                cells, inverse = np.unique(cell, return_inverse=True)
                step = np.bincount(inverse, np.repeat(grad[rows, kinds], features.shape[1]))
                speed[cells] += step * step
                w[cells] += rate * step / np.sqrt(speed[cells]) - decay * w[cells]
    return model


def model_spans(text: str, model: Model) -> list[Span]:
    """The model's spans."""
    out: list[Span] = []
    for a, b in passages(text):
        p = Passage(text, a, b)
        out += [(kind, p.tokens[i][0], p.tokens[j - 1][1]) for i, j, kind in model.best(p)]
    return out


def found(text: str, model: Model | None) -> tuple[list[Span], list[Span]]:
    """(rule spans, all spans): added are the model's spans that meet no rule span,
    and the seeds' spans; of these two kinds, none that lies inside another span."""
    if not _MARK.search(text) and not has_cue(text):
        return [], []
    base = rule_spans(text)
    if model is None:
        return base, base
    added = [s for s in model_spans(text, model) if all(s[2] <= o[1] or o[2] <= s[1] for o in base)]
    seeds = [s for s in seed_spans(text) if not any(o[1] <= s[1] and s[2] <= o[2] for o in base + added)]
    added = [s for s in added if not any(o[1] <= s[1] and s[2] <= o[2] for o in seeds)]
    return base, sorted(base + added + seeds, key=order)


def _picked(text: str) -> list[str]:
    """At most ``TEXT_PASSAGES`` of a text's passages that are short enough, at even distances."""
    own = [(a, b) for a, b in passages(text) if b - a <= PASSAGE_CHARS]
    step = max(1, -(-len(own) // TEXT_PASSAGES))
    return [text[a:b] for a, b in own[::step]]


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Trains on the passages of about ``sample`` texts (all, if fewer), those in the first part of
    the hash range; equal texts count once. A text gives at most ``TEXT_PASSAGES`` passages of at most
    ``PASSAGE_CHARS`` characters, and ``MOST_PASSAGES`` of all are used; only passages are collected."""
    n = docs.count()
    df = docs.select(text_of(docs).alias("t")).select(F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h"), "t")
    if n > sample:
        df = df.where(F.col("h") < F.lit((1 << 63) * sample // n))

    def rows(it):
        for batch in it:
            for part in slices(batch, "t"):
                both = [(h, p) for h, t in zip(part.column("h").to_pylist(), part.column("t").to_pylist(), strict=True) for p in _picked(t)]
                yield {"h": [h for h, _ in both], "p": [p for _, p in both]}

    got = map_arrow(df, rows, "h long, p string").distinct().collect()
    return train([p for _, p in sorted((r["h"], r["p"]) for r in got)[:MOST_PASSAGES]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, base, spans): the rules' spans and all spans of every text."""
    weights = docs.sparkSession.sparkContext.broadcast(model.w.astype(np.float32))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(it):
        m = Model(weights.value.astype(np.float64))
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in it:
            for part in slices(batch, "text"):
                both = [found(t, m) for t in part.column("text").to_pylist()]
                yield {"doc_id": part.column("doc_id"), "text": part.column("text"),
                       "base": pa.array([as_rows(a) for a, _ in both], kind), "spans": pa.array([as_rows(b) for _, b in both], kind)}

    df = docs.select("doc_id", text_of(docs).alias("text"))
    return map_arrow(df, rows, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string, base {SPANS}, spans {SPANS}")


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(out: DataFrame) -> DataFrame:
    """Counts and a digest of the rules' spans, and all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(F.encode(listed("base"), "UTF-8"), 256).alias("base_sha256"),
                      listed("spans").alias("spans"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first stands for all."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=order):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span in the texts replaced by its kind in brackets;
    ``n_chars``, if there, follows the text, and all other columns stay."""
    weights = docs.sparkSession.sparkContext.broadcast(model.w.astype(np.float32))

    def rows(it):
        m = Model(weights.value.astype(np.float64))
        for batch in it:
            for part in slices(batch, "text"):
                old = part.column("text").to_pylist()
                new = [t if t is None else masked(t, found(t, m)[1]) for t in old]
                cols = {name: part.column(k) for k, name in enumerate(part.schema.names)}
                cols["text"] = pa.array(new, pa.string())
                if "n_chars" in cols:
                    size = [n if a == b else len(b) for a, b, n in zip(old, new, cols["n_chars"].to_pylist(), strict=True)]
                    cols["n_chars"] = pa.array(size, cols["n_chars"].type)
                yield cols

    return map_arrow(docs, rows, docs.schema)
