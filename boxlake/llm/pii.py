"""Personal data by patterns and a character-level BiLSTM with CRF transitions.

Base spans come from fixed patterns. The model, in numpy, is trained on windows whose
spans are labelled by these patterns, from a bounded sample of documents
(`TRAINING_DOCS`, in hash order). It reads overlapping windows; the emissions of all windows
over a place are averaged, those near a window's middle counting more, and one Viterbi
pass over the joined region settles all of them together. Spans it is sure of that touch no
base span are added.

Every kind of span has a digit or an @ in it, so only windows around these characters can
hold one; texts without them, most of prose, cost a scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import bounded_sample, small_batches

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans. Runs are possessive, and addresses begin
# with a whole run of digits: a match from within a run would have begun earlier. So each
# pattern takes time linear in the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]  # kind, first character, end


# ------------------------------------------------------------------ base spans

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def byte_sized(part: str) -> bool:
    """Whether a run of digits of any length is at most 255; zeros in front don't count."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    """From each @ back over the characters that may precede it: the leftmost matches, in
    time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind as listed, then by start."""
    out: list[Span] = list(_emails(text))
    found = {
        "ip": (IP, lambda s: all(map(byte_sized, s.split(".")))),
        "card": (CARD, lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (PHONE, lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for kind, (pattern, good) in found.items():
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m[0])]
    return out


# ------------------------------------------------------------------ model

SYMBOLS = " .@-+_%()/:,\n"
CHARS = len(SYMBOLS) + 1 + 26 + 1 + 1 + 1  # and: digit, letters, capital, other letter, other
HIDDEN = 16
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STEP = 64, 32
MARGIN = 24  # characters read on either side of a digit or @
PIECE = 4096  # characters of a region settled at once, a multiple of STEP
OVERLAP = 256  # characters read beyond a piece
TRAINING_DOCS = 4_000
TRAINING_WINDOWS = 1_500
EPOCHS = 6
SURE = 0.95
MIN_LENGTH = 7

_TRIGGER = re.compile(r"[0-9@]")


def char_classes(text: str) -> np.ndarray:
    """A small number for each character: digits are one class, letters have their own in
    lower case, all capitals share one."""
    out = np.empty(len(text), dtype=np.int64)
    first_letter = len(SYMBOLS) + 1
    for i, c in enumerate(text):
        if "0" <= c <= "9":
            out[i] = len(SYMBOLS)
        elif "a" <= c <= "z":
            out[i] = first_letter + ord(c) - 97
        elif "A" <= c <= "Z":
            out[i] = first_letter + 26
        else:
            at = SYMBOLS.find(c)
            out[i] = at if at >= 0 else first_letter + (27 if c.isalpha() else 28)
    return out


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.RandomState(seed)
    p = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.2, (CHARS, 4 * HIDDEN))  # one-hot input: a row each
        p[f"h{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p[f"c{side}"] = np.zeros(4 * HIDDEN)
        p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0  # forget gates begin open
    p["o"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS))
    p["ob"] = np.zeros(TAGS)
    p["t"] = np.zeros((TAGS, TAGS))
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(p: dict, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (rows, steps, HIDDEN) over class numbers (rows, steps), and what the
    way back needs."""
    rows, steps = x.shape
    h, c = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
    out, kept = np.zeros((rows, steps, HIDDEN)), []
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    for t in order:
        a = p[f"x{side}"][x[:, t]] + h @ p[f"h{side}"] + p[f"c{side}"]
        i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        kept.append((t, i, f, o, g, before, h_before, tc))
    return out, kept


def _lstm_back(p: dict, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grad: dict) -> None:
    rows = len(x)
    dh, dc = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
    for t, i, f, o, g, before, h_before, tc in reversed(kept):
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        np.add.at(grad[f"x{side}"], x[:, t], da)
        grad[f"h{side}"] += h_before.T @ da
        grad[f"c{side}"] += da.sum(axis=0)
        dh, dc = da @ p[f"h{side}"].T, dc * f


def emissions(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    states, kept = zip(*(_lstm(p, side, x) for side in "fb"))
    joined = np.concatenate(states, axis=2)
    return joined @ p["o"] + p["ob"], (joined, kept)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of emissions (rows, steps, TAGS): log partition, tag marginals, and the expected
    transitions summed over rows and steps."""
    rows, steps, tags = e.shape
    ahead, behind = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = e[:, 0]
    for t in range(1, steps):
        ahead[:, t] = e[:, t] + _logsum(ahead[:, t - 1, :, None] + transitions, 1)
    for t in range(steps - 2, -1, -1):
        behind[:, t] = _logsum(transitions + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    z = _logsum(ahead[:, -1], 1)
    expected = np.zeros((tags, tags))
    for t in range(1, steps):
        pair = ahead[:, t - 1, :, None] + transitions + (e[:, t] + behind[:, t])[:, None, :] - z[:, None, None]
        expected += np.exp(pair).sum(axis=0)
    return z, np.exp(ahead + behind - z[:, None, None]), expected


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 50, rate: float = 0.01) -> dict:
    """Adam on the CRF's log loss of tag rows `y` over class rows `x`."""
    p = initial()
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    rng, step = np.random.RandomState(3), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            at = order[start : start + batch]
            bx, by = x[at], y[at]
            e, (joined, kept) = emissions(p, bx)
            _, share, expected = marginals(e, p["t"])
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            de = share / len(at)
            np.subtract.at(de, (np.arange(len(at))[:, None], np.arange(bx.shape[1])[None], by), 1 / len(at))
            grad["t"] = expected / len(at)
            np.subtract.at(grad["t"], (by[:, :-1], by[:, 1:]), 1 / len(at))
            flat = joined.reshape(-1, 2 * HIDDEN)
            grad["o"] = flat.T @ de.reshape(-1, TAGS)
            grad["ob"] = de.sum(axis=(0, 1))
            d_joined = de @ p["o"].T
            _lstm_back(p, "f", bx, kept[0], d_joined[:, :, :HIDDEN], grad)
            _lstm_back(p, "b", bx, kept[1], d_joined[:, :, HIDDEN:], grad)
            step += 1
            for k in p:
                g = np.clip(grad[k], -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


# ------------------------------------------------------------------ windows and decoding

def regions(text: str) -> list[tuple[int, int]]:
    """Joined surroundings of the characters that any span has to hold."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def pieces(a: int, b: int) -> list[tuple[int, int, int]]:
    """Start, end and own end of the parts of a region: a region longer than `PIECE` is read
    in parts that overlap, so that its memory is bounded. A span belongs to the part in whose
    own characters it begins, and ends with the characters read there at the latest."""
    out = [(at, min(b, at + PIECE + OVERLAP), min(b, at + PIECE)) for at in range(a, b, PIECE)]
    if len(out) > 1 and b - out[-1][0] <= OVERLAP:  # read whole by the part before
        out.pop()
        out[-1] = (out[-1][0], b, b)
    return out


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows over `n` characters."""
    return list(range(0, max(1, n - STEP), STEP))


def tags_of(spans: list[Span], start: int, end: int) -> np.ndarray:
    out = np.zeros(end - start, dtype=np.int64)
    for kind, a, b in spans:
        a, b = max(a, start), min(b, end)
        if a < b:
            k = 1 + 2 * KINDS.index(kind)
            out[a - start : b - start] = k + 1
            out[a - start] = k
    return out


def _rows(classes: np.ndarray, fill: int) -> np.ndarray:
    """Windows of one region, padded to full width."""
    starts = windows(len(classes))
    out = np.full((len(starts), WINDOW), fill, dtype=np.int64)
    for i, a in enumerate(starts):
        part = classes[a : a + WINDOW]
        out[i, : len(part)] = part
    return out


def viterbi(e: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    score, back = e[0], np.zeros(e.shape, dtype=np.int64)
    for t in range(1, len(e)):
        both = score[:, None] + transitions
        back[t] = both.argmax(axis=0)
        score = both.max(axis=0) + e[t]
    path = [int(score.argmax())]
    for t in range(len(e) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def model_spans(texts: list[str], p: dict | None) -> list[list[Span]]:
    """Spans the model is sure of, in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    if p is None:
        return out
    places = [(n, *piece) for n, text in enumerate(texts) for a, b in regions(text) for piece in pieces(a, b)]
    middle = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0
    for begin in range(0, len(places), 256):
        group = places[begin : begin + 256]
        rows = [_rows(char_classes(texts[n][a:b]), 0) for n, a, b, _ in group]
        e = np.concatenate([emissions(p, part)[0] for part in np.array_split(np.concatenate(rows), max(1, sum(map(len, rows)) // 512))])
        at = 0
        for (n, a, b, own_end), own in zip(group, rows):
            total, weight = np.zeros((b - a + 2 * WINDOW, TAGS)), np.zeros(b - a + 2 * WINDOW)
            for i, start in enumerate(windows(b - a)):
                total[start : start + WINDOW] += e[at + i] * middle[:, None]
                weight[start : start + WINDOW] += middle
            at += len(own)
            joined = (total / np.where(weight > 0, weight, 1)[:, None])[: b - a]
            path = viterbi(joined, p["t"])
            if not path.any():
                continue
            share = marginals(joined[None], p["t"])[1][0]
            sure = share[np.arange(len(path)), path]
            i = 0
            while i < len(path):
                if path[i]:
                    kind, j = (path[i] - 1) // 2, i + 1
                    while j < len(path) and path[j] == 2 + 2 * kind:
                        j += 1
                    piece = texts[n][a + i : a + j]
                    mine = a + i < own_end and not (out[n] and a + i < out[n][-1][2])
                    if mine and j - i >= MIN_LENGTH and sure[i:j].min() >= SURE and _TRIGGER.search(piece):
                        out[n].append((KINDS[kind], a + i, a + j))
                    i = j
                else:
                    i += 1
    return out


def joined_spans(spans: list[Span]) -> list[tuple[int, int]]:
    """The characters that spans cover, as ranges apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str, base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans and those of the model that touch none of them, in the order of kinds."""
    free, at, taken = [], 0, joined_spans(base)
    for s in sorted(added, key=lambda s: s[1]):
        while at < len(taken) and taken[at][1] <= s[1]:
            at += 1
        if at == len(taken) or taken[at][0] >= s[2]:
            free.append(s)
    return sorted([*base, *free], key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ Spark

def fit(docs: DataFrame) -> dict | None:
    """The model of a bounded sample of the documents with a digit or an @; None if the
    sample has no labelled span."""

    def label(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            xs, ys = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for a, b, _ in (piece for region in regions(text) for piece in pieces(*region)):
                    xs += _rows(char_classes(text[a:b]), 0).astype(np.int8).tolist()
                    ys += _rows(tags_of(spans, a, b), 0).astype(np.int8).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([bytes(r) for r in xs], pa.binary()), pa.array([bytes(r) for r in ys], pa.binary())], ["x", "y"]
            )

    chosen = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    chosen = bounded_sample(chosen, TRAINING_DOCS, chosen.count(), 9, "doc_id", F.xxhash64("text"))
    rows = chosen.select("text").mapInArrow(label, "x binary, y binary")
    picked = rows.orderBy(F.xxhash64("x", "y"), "x").limit(TRAINING_WINDOWS).collect()
    if not any(any(r.y) for r in picked):
        return None
    x = np.array([list(r.x) for r in picked], dtype=np.int64)
    return train(x, np.array([list(r.y) for r in picked], dtype=np.int64))


def find(docs: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans` for each row of `docs`
    (`doc_id, text`). The counts and the digest are of the base spans, `spans` has all.
    Null and empty texts have none; repeated rows come out alike. Texts and runs of digits
    of any length take time linear in them; the model settles long regions in `pieces`."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def search(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            added = model_spans(texts, shared.value)
            counts = [[sum(s[0] == kind for s in spans) for spans in base] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base]),
                    pa.array([listed(all_spans(t, b, m)) for t, b, m in zip(texts, base, added)]),
                ],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
