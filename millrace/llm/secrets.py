"""Secret scans with a linear-chain conditional random field (operator 5).

Pieces of text (between white space, quotes, brackets and signs such as ``=``)
are tagged begin, inside or outside of a secret.  A piece's evidence comes from
its own shape, its neighbours' shapes and words, the signs before it and the
kind of file it stands in.  The base rules know few kinds of secrets, so the
model isn't trained on their findings alone: windows of a bounded sample of
texts get synthetic secrets in many forms and contexts, with cue words and
without, or look-alikes (dates, versions, links, identifiers, cue words
followed by prose), and cues of real findings are masked.  Viterbi decoding
gives the best tag path of a whole text; stretches in which outside wins
whatever its neighbours are need no search.  Base findings are always kept; the
tagger adds spans of kind ``crf``.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import map_arrow
from ._text import Chunk, chunks

KINDS = ("assign", "access", "hex", "crf")
_RANK = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

B, I, O = 0, 1, 2
#: Bounds on the documents used to train, on the windows of each (at random places, and at findings), and on a window's bytes.
FIT_DOCS, FIT_WINDOWS, WINDOW_BYTES = 2000, 2, 1500
#: Words on either side of a window's middle.
REACH = 6
#: Secrets are rarer in texts than in the training windows: log odds against them.
RARITY = 1.0

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base rules' findings: leftmost, non-overlapping per kind, failing matches dropped."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]]))


# ---------------------------------------------------------------- shapes

_LENGTHS = np.array([2, 4, 8, 12, 16, 24, 40])
_CLASS = np.zeros(256, dtype=np.uint8)  # bit 0 digit, 1 upper, 2 lower, 3 other ASCII, 4 beyond ASCII
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 8
_CLASS[128:] = 16
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[list(b" \t\n\x0b\x0c\r\"'`=:,;|()[]{}<>")] = True
#: Shapes: 8 lengths x 4 shares of class changes x 4 shares of rare letter pairs, then x 3 shares each of digits, upper case and other ASCII x beyond ASCII.
N_COARSE = 8 * 4 * 4
N_SHAPES = N_COARSE * 3 * 3 * 3 * 2
#: File kinds: 3 shares of symbols x 3 shares of digits.
N_FILES = 9
#: Signs before a piece: none or text start, blank only, quote, assignment (with or without quote).
N_SIGNS = 4
N_WORDS = 4096
#: Sizes of the feature tables; the last row of each is for pieces beyond the text's ends.
_TABLES = {"own": N_SHAPES + 1, "coarse": N_COARSE + 1, "left": N_COARSE + 1, "right": N_COARSE + 1, "word": N_WORDS + 1, "word2": N_WORDS + 1, "sign": N_SIGNS + 1, "file": N_FILES + 1}


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])


def pair_table(chunk: Chunk) -> np.ndarray:
    """How often each two neighbouring ASCII letters (lower-cased) stand in the texts: 26 x 26."""
    low = chunk.lower().data.astype(np.int64) - 97
    both = (low[:-1] >= 0) & (low[:-1] < 26) & (low[1:] >= 0) & (low[1:] < 26)
    return np.bincount(low[:-1][both] * 26 + low[1:][both], minlength=676)


def features(chunk: Chunk, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Starts and ends of all pieces, each text's first piece, and the feature numbers of every piece."""
    starts, ends, first = chunk.words(_BREAKS)
    data, kind = chunk.data, _CLASS[chunk.data]
    low = chunk.lower()
    length = ends - starts

    def share(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        running = _running(flags)
        return running[hi] - running[lo]

    def level(n: np.ndarray) -> np.ndarray:
        return (n > 0).astype(np.int64) + (4 * n > length)

    solid = (kind & 7) > 0
    change = np.zeros(len(data), dtype=bool)
    pair = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        change[1:] = solid[1:] & solid[:-1] & (kind[1:] != kind[:-1])
        letters = (kind & 6) > 0
        at = np.flatnonzero(letters[1:] & letters[:-1]) + 1
        pair[at] = rare[low.data[at - 1].astype(np.int64) * 26 + low.data[at] - 97 * 27]
    inner = np.minimum(starts + 1, ends)
    turns, odd = share(change, inner, ends), share(pair, inner, ends)
    coarse = np.searchsorted(_LENGTHS, length, side="right").astype(np.int64)
    coarse = coarse * 4 + (turns > 0) + (turns > 1) + (5 * turns > length)
    coarse = coarse * 4 + (odd > 0) + (8 * odd > length) + (3 * odd > length)
    own = coarse
    for bit in (1, 2, 8):
        own = own * 3 + level(share((kind & bit) > 0, starts, ends))
    own = own * 2 + (share((kind & 16) > 0, starts, ends) > 0)

    before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    head = np.zeros(len(starts), dtype=bool)
    head[first[:-1][first[:-1] < first[1:]]] = True
    before[head] = np.repeat(chunk.offsets[:-1], np.diff(first))[head]
    assigned = share((data == 61) | (data == 58), before, starts) > 0
    marked = share((data == 34) | (data == 39) | (data == 96), before, starts) > 0
    sign = np.where(assigned, 3, np.where(marked, 2, np.where(starts > before, 1, 0)))
    word = (low.range_hash(starts, np.minimum(ends, starts + 32)) % np.uint64(N_WORDS)).astype(np.int64)
    symbols = _per_text(chunk, kind)
    return starts, ends, first, {
        "own": own,
        "coarse": coarse,
        "left": _shifted(coarse, first, 1, N_COARSE),
        "right": _shifted(coarse, first, -1, N_COARSE),
        "word": _shifted(word, first, 1, N_WORDS),
        "word2": _shifted(word, first, 2, N_WORDS),
        "sign": sign,
        "file": np.repeat(symbols, np.diff(first)),
    }


def _per_text(chunk: Chunk, kind: np.ndarray) -> np.ndarray:
    """How much of each text is symbols and how much is digits."""
    size = np.maximum(np.diff(chunk.offsets), 1)
    out = np.zeros(chunk.n, dtype=np.int64)
    for bit in (8, 1):
        running = np.concatenate([[0], np.cumsum(kind == bit, dtype=np.int64)])
        n = running[chunk.offsets[1:]] - running[chunk.offsets[:-1]]
        out = out * 3 + (20 * n > size) + (5 * n > size)
    return out


def _shifted(values: np.ndarray, first: np.ndarray, by: int, none: int) -> np.ndarray:
    """Neighbours' values inside the same text; ``none`` where there is none."""
    out = np.full(len(values), none, dtype=np.int64)
    if by > 0:
        out[by:] = values[:-by]
        for k in range(by):
            edge = first[:-1] + k
            out[edge[edge < first[1:]]] = none
    else:
        out[:by] = values[-by:]
        out[first[1:][first[:-1] < first[1:]] - 1] = none
    return out


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class Tagger:
    tables: dict[str, np.ndarray]  # feature -> rows of (begin, inside, outside) scores
    move: np.ndarray  # 3, 3: from, to
    rare: np.ndarray  # 676: letter pairs that ordinary words seldom hold

    def evidence(self, index: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.tables[k][index[k]] for k in self.tables)


def train(index: dict[str, np.ndarray], tags: np.ndarray, rare: np.ndarray, epochs: int = 16, batch: int = 512, ridge: float = 1e-4) -> Tagger:
    """Maximum conditional likelihood over windows (rows) of equal length, by Adam on forward-backward gradients of batches."""
    parts = {k: np.zeros((n, 3)) for k, n in _TABLES.items()} | {"move": np.zeros((3, 3))}
    n = len(tags)
    if not n:
        parts["own"][:, O] = 20.0
    mean = {k: np.zeros_like(v) for k, v in parts.items()}
    var = {k: np.zeros_like(v) for k, v in parts.items()}
    draw, step = np.random.default_rng(3), 0
    for epoch in range(epochs):
        order = draw.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            grads, step = _gradients(parts, {k: index[k][rows] for k in _TABLES}, tags[rows]), step + 1
            for k, g in grads.items():
                g = g + ridge * parts[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                parts[k] -= 0.1 * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)
    parts["own"][:, O] += RARITY
    return Tagger({k: parts[k] for k in _TABLES}, parts["move"], rare)


def _gradients(parts: dict[str, np.ndarray], index: dict[str, np.ndarray], tags: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood, by forward and backward sums."""
    n, length = tags.shape
    e = sum(parts[k][index[k]] for k in index)
    move = parts["move"]
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = e[:, 0]
    for t in range(1, length):
        ahead[:, t] = e[:, t] + _logsum(ahead[:, t - 1, :, None] + move[None], 1)
    for t in range(length - 2, -1, -1):
        back[:, t] = _logsum(move[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _logsum(ahead[:, -1], 1)
    p = np.exp(ahead + back - total[:, None, None])
    pair = np.exp(ahead[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
    gold = np.eye(3)[tags]
    gold_move = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    diff = ((p - gold) / n).reshape(-1, 3)
    grads = {"move": (pair.sum(axis=(0, 1)) - gold_move) / n}
    for k in index:
        flat = index[k].ravel()
        grads[k] = np.stack([np.bincount(flat, weights=diff[:, c], minlength=len(parts[k])) for c in range(3)], axis=1)
    return grads


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def viterbi(e: np.ndarray, move: np.ndarray, edge_before: bool, edge_after: bool) -> list[int]:
    """The best tags of a stretch; an edge means that an outside token adjoins there."""
    best = e[0] + (move[O] if edge_before else 0.0)
    back = []
    for row in e[1:]:
        options = best[:, None] + move
        back.append(options.argmax(axis=0))
        best = options.max(axis=0) + row
    if edge_after:
        best = best + move[:, O]
    tag = int(best.argmax())
    path = [tag]
    for pointers in reversed(back):
        tag = int(pointers[tag])
        path.append(tag)
    return path[::-1]


def decode(tagger: Tagger, e: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first token, last token + 1) of every tagged secret, from each text's best path.

    A token whose outside score leads by more than any neighbouring tags can
    make up is outside on the best path; only the stretches between such
    tokens are searched, which gives the same path.
    """
    move = tagger.move
    make_up = np.array([max(max(move[a, x] - move[a, O] for a in range(3)), 0) + max(max(move[x, b] - move[O, b] for b in range(3)), 0) for x in (B, I)])
    doubtful = ((e[:, :2] + make_up - e[:, 2:]) >= 0).any(axis=1)
    found = []
    at = np.flatnonzero(doubtful)
    if not len(at):
        return found
    owner = np.searchsorted(first, at, side="right") - 1
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0)) + 1
    for part in np.split(at, cut):
        lo, hi = int(part[0]), int(part[-1]) + 1
        doc = int(np.searchsorted(first, lo, side="right")) - 1
        path = viterbi(e[lo:hi], move, lo > first[doc], hi < first[doc + 1])
        open_at = None
        for k, tag in enumerate([*path, O]):
            if open_at is not None and tag != I:
                found.append((doc, lo + open_at, lo + k))
                open_at = None
            if tag != O and open_at is None:
                open_at = k
    return found


# ---------------------------------------------------------------- training windows

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT
#: Words that announce a secret, in the languages at hand.
_CUES = (
    "password passwd pwd pass passphrase passcode secret secret_key client_secret api_key api-key apikey access_key access_token auth_token auth authorization bearer credential credentials "
    "private_key signing_key encryption_key key token login pin passe passwort kennwort schlüssel clé contraseña clave secreto"
).split()
_SEPARATORS = (": ", ":", "=", " = ", " is ", " => ", " := ", " ", ' = "', ': "', '="', " '", ": '")


def _draw(rng: random.Random, letters: str, lo: int, hi: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(lo, hi)))


def synthetic_secret(rng: random.Random, cued: bool) -> str:
    """A made-up secret; short and plain kinds only where a cue announces it."""
    kind = rng.randrange(9 if cued else 7)
    if kind == 0:
        return _draw(rng, _ALNUM, 18, 48)
    if kind == 1:
        return _draw(rng, _ALNUM + "+/", 20, 64) + rng.choice(("", "=", "=="))
    if kind == 2:
        return _draw(rng, _LOWER, 2, 6) + rng.choice(("_", "-")) + rng.choice(("", "", _draw(rng, _LOWER, 3, 5) + "_")) + _draw(rng, _ALNUM, 16, 40)
    if kind == 3:
        return _draw(rng, rng.choice(("0123456789ABCDEF", "0123456789abcdef")), 24, 64)
    if kind == 4:
        return ".".join(("eyJ" + _draw(rng, _ALNUM, 12, 30), "eyJ" + _draw(rng, _ALNUM, 20, 60), _draw(rng, _ALNUM + "-_", 20, 43)))
    if kind == 5:
        return _draw(rng, _UPPER, 3, 5) + _draw(rng, _UPPER + _DIGIT, 14, 30)
    if kind == 6:
        return _draw(rng, _LOWER + _DIGIT, 20, 44)
    if kind == 7:
        core = list(_draw(rng, _LOWER, 4, 9) + _draw(rng, _DIGIT, 1, 4) + _draw(rng, "!@#$%&*?._-", 0, 2) + _draw(rng, _UPPER, 1, 3))
        rng.shuffle(core)
        return "".join(core)
    return "-".join(_draw(rng, _UPPER + _DIGIT, 4, 6) for _ in range(rng.randint(3, 5)))


def look_alike(rng: random.Random, words: list[str]) -> str:
    """Something that is no secret but long, mixed or announced like one."""
    n = rng.randrange
    plain = [w.strip(".,;:!?") or "text" for w in words] or ["text"]
    some = lambda k: [rng.choice(plain) for _ in range(k)]
    return (
        lambda: f"{n(1950, 2035)}-{n(1, 13):02}-{n(1, 29):02}T{n(24):02}:{n(60):02}:{n(60):02}Z",
        lambda: f"{n(1, 29)}/{n(1, 13)}/{n(1950, 2035)}",
        lambda: f"v{n(20)}.{n(40)}.{n(900)}",
        lambda: ".".join(str(n(256)) for _ in range(4)),
        lambda: f"https://{'-'.join(some(2))}.example.com/{'/'.join(some(n(1, 4)))}?{rng.choice(plain)}={n(10**6)}",
        lambda: f"{rng.choice(plain)}.{n(100)}@{rng.choice(plain)}{n(10)}.example.org",
        lambda: f"+{n(1, 99)} ({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}",
        lambda: f"${n(1, 10**6)}.{n(100):02}",
        lambda: _draw(rng, _DIGIT, 6, 20),
        lambda: "".join(w.capitalize() for w in some(n(2, 5))),
        lambda: "_".join(w.lower() for w in some(n(2, 5))),
        lambda: "-".join(w.lower() for w in some(n(2, 5))),
        lambda: "/" + "/".join(w.lower() for w in some(n(2, 5))) + rng.choice((".txt", ".py", "", ".json")),
        lambda: " ".join(w.upper() + rng.choice(("", "!!")) for w in some(n(2, 6))),
        lambda: f"{n(16**8):08x}-{n(16**4):04x}-4{n(16**3):03x}-a{n(16**3):03x}-{n(16**12):012x}",
        lambda: f"{n(16**7):07x}",
        lambda: f"978-{n(10)}-{n(10**4):04}-{n(10**4):04}-{n(10)}",
        lambda: f"{n(90)}.{n(10**6):06},{n(180)}.{n(10**6):06}",
        lambda: "".join(some(n(2, 5))).lower(),
        lambda: rng.choice(_CUES) + rng.choice(_SEPARATORS) + " ".join(some(n(1, 4))),
        lambda: rng.choice(("the ", "a ", "your ", "")) + rng.choice(_CUES) + " " + " ".join(some(n(1, 4))),
        lambda: rng.choice(plain) + rng.choice(_SEPARATORS) + " ".join(some(n(1, 3))),
        lambda: " | ".join(some(n(3, 7))),
        lambda: _draw(rng, "#*$%&|<>!?=-_.", 3, 30),
        lambda: f"{rng.choice(plain)}={n(10**5)}&{rng.choice(plain)}={rng.choice(plain)}",
    )[n(25)]()


def with_secret(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A phrase that holds a made-up secret, and where its parts stand."""
    if rng.random() < 0.1:
        head = rng.choice(("-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----")) + "\n"
        parts = [_draw(rng, _ALNUM + "+/", 64, 64) for _ in range(rng.randint(1, 4))]
        spans, text = [], head
        for p in parts:
            spans.append((len(text), len(text) + len(p)))
            text += p + "\n"
        return text.rstrip("\n"), spans
    if rng.random() < 0.3:
        value = synthetic_secret(rng, False)
        return value, [(0, len(value))]
    cue = rng.choice(_CUES)
    cue = rng.choice((cue, cue, cue.upper(), cue.capitalize(), rng.choice(("my_", "db_", "aws_", "APP_")) + cue))
    value, separator = synthetic_secret(rng, True), rng.choice(_SEPARATORS)
    text = cue + separator + value
    return text + (separator[-1] if separator[-1] in "\"'" else ""), [(len(text) - len(value), len(text))]


def training_windows(texts: list[str], seed: int = 11) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """The texts with something put in, and the places of secrets in each; every text gives three windows.

    One holds a made-up secret, one a look-alike, one is the text itself.
    Findings of the base rules are secrets; in the first two of a text's
    windows their cues are masked by another of the text's words, so that they
    have to be known by shape.
    """
    rng = random.Random(seed)
    out, places = [], []
    for text in texts:
        words = text.split()
        for put in (with_secret, look_alike, None):
            body, spans = _known(text)
            if put is not None:
                body, spans = _masked(rng, body, spans, words)
                added, inside = put(rng) if put is with_secret else (look_alike(rng, words), [])
                gaps = [m.start() for m in re.finditer(r"\s", body) if not any(a <= m.start() < b for a, b in spans)] or [len(body)]
                at = rng.choice(gaps)
                size = len(added) + 1
                spans = [(a, b) if b <= at else (a + size, b + size) for a, b in spans] + [(at + 1 + a, at + 1 + b) for a, b in inside]
                body = f"{body[:at]} {added}{body[at:]}"
            out.append(body)
            places.append(sorted(spans))
    return out, places


def _known(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text and the values that the base rules find in it."""
    spans: list[tuple[int, int]] = []
    for kind, a, b in base_spans(text):
        a = b - len(_ASSIGN.match(text, a)[2]) if kind == "assign" else a
        if all(b <= s or a >= e for s, e in spans):
            spans.append((a, b))
    return text, spans


def _masked(rng: random.Random, text: str, spans: list[tuple[int, int]], words: list[str]) -> tuple[str, list[tuple[int, int]]]:
    for m in reversed(list(_ASSIGN.finditer(text))):
        a, b = m.span(1)
        other = re.sub(r"\W", "", rng.choice(words)) or "text"
        text = text[:a] + other + text[b:]
        spans = [(s, e) if s < b else (s + len(other) - (b - a), e + len(other) - (b - a)) for s, e in spans]
    return text, spans


def tagger_from(texts: list[str]) -> Tagger:
    """A tagger from sampled windows of text; without any, everything is outside."""
    counts = sum((pair_table(c) for c in chunks(pa.array(texts, pa.string()))), np.zeros(676, dtype=np.int64))
    # A pair is rare if ordinary texts hold it less than a tenth as often as pairs on average.
    rare = counts * 6760 < counts.sum()
    bodies, places = training_windows(texts)
    width = 4 * REACH + 1
    rows: dict[str, list[np.ndarray]] = {k: [] for k in _TABLES}
    tags = []
    for chunk in chunks(pa.array(bodies, pa.string())):
        starts, ends, first, index = features(chunk, rare)
        for d in range(chunk.n):
            lo, hi = int(first[d]), int(first[d + 1])
            raw = chunk.text(d)
            tag = np.full(hi - lo, O)
            for a, b in places[chunk.first + d]:
                text = raw.decode("utf-8")
                a, b = (len(text[:x].encode()) + chunk.offsets[d] for x in (a, b))
                t, u = np.searchsorted(ends, a, side="right") - lo, np.searchsorted(starts, b) - lo
                tag[t] = I if t and tag[t - 1] != O and raw[: a - chunk.offsets[d]].endswith(b"\n") else B
                tag[t + 1 : u] = I
            middle = int(np.flatnonzero(tag != O)[0]) if (tag != O).any() else (hi - lo) // 2
            at = lo + max(0, min(middle - width // 2, hi - lo - width))
            own, short = slice(at, min(at + width, hi)), max(0, width - (hi - lo))
            for k in _TABLES:
                rows[k].append(np.pad(index[k][own], (0, short), constant_values=_TABLES[k] - 1))
            tags.append(np.pad(tag[own.start - lo : own.stop - lo], (0, short), constant_values=O))
    stack = lambda x: np.array(x, dtype=np.int64).reshape(-1, width)
    return train({k: stack(v) for k, v in rows.items()}, stack(tags), rare)


# ---------------------------------------------------------------- operators


def fit(docs: DataFrame, bound: int = FIT_DOCS) -> Tagger:
    """A tagger trained on windows of at most about ``bound`` documents.

    Documents are chosen by a hash of doc_id and text.  Each gives
    ``FIT_WINDOWS`` windows at random places and at most as many around base
    findings; equal windows count once, windows of more than ``WINDOW_BYTES`` bytes are
    left out.  Without documents everything is outside.
    """
    total = docs.count()
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text joins the draw, so that ids that are null or repeat don't share one.
    draw = F.pmod(F.xxhash64(F.lit("secrets"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    texts = texts.where(draw < min(1.0, bound / max(total, 1)))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            windows = []
            for text in batch.column(0).to_pylist():
                words = [m.span() for m in re.finditer(r"\S+", text)]
                rng = random.Random(text)
                at = [rng.randrange(len(words)) for _ in range(FIT_WINDOWS if words else 0)]
                found = base_spans(text)
                for _, a, _ in rng.sample(found, min(FIT_WINDOWS, len(found))):
                    at.append(min(bisect.bisect_left(words, (a + 1,)), len(words)) - 1)
                for k in at:
                    a, b = words[max(0, k - REACH)][0], words[min(len(words), k + REACH + 1) - 1][1]
                    if b - a <= WINDOW_BYTES:
                        windows.append(text[a:b])
            yield {"window": windows}

        return step

    drawn = map_arrow(texts.select("text"), make, "window string").distinct().toArrow()
    return tagger_from(sorted(drawn.column("window").to_pylist()))


def scan(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Secrets in every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, n_assign, n_access, n_hex,
    base_sha256 and spans.  ``spans`` lists kind:start:end by start, then kind,
    in code points with exclusive ends; ``base_sha256`` digests the part of the
    base kinds.  A tagged span that overlaps a base span is not repeated.
    Null and empty texts have no spans.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def make():
        np.seterr(over="ignore")
        model = held.value

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for chunk in chunks(batch.column(1)):
                starts, ends, first, index = features(chunk, model.rare)
                tagged: dict[int, list[tuple[int, int]]] = {}
                for d, t, u in decode(model, model.evidence(index), first):
                    tagged.setdefault(d, []).append((int(starts[t]), int(ends[u - 1])))
                counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
                digests, lists = [], []
                for d in range(chunk.n):
                    raw = chunk.text(d)
                    text = raw.decode("utf-8")
                    base = base_spans(text)
                    spans = list(base)
                    for a, b in tagged.get(d, ()):
                        a, b = (len(raw[: x - chunk.offsets[d]].decode("utf-8")) for x in (a, b))
                        if all(b <= s or a >= e for _, s, e in base):
                            spans.append(("crf", a, b))
                    spans.sort(key=lambda s: (s[1], _RANK[s[0]]))
                    for k in counts:
                        counts[k].append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(listing(base).encode()).hexdigest())
                    lists.append(listing(spans))
                yield {"doc_id": batch.column(0).slice(chunk.first, chunk.n), "base_sha256": digests, "spans": lists} | {f"n_{k}": v for k, v in counts.items()}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def listing(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
