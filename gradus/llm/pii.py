"""Operator 3: personal data, by patterns and by a character-level bidirectional LSTM with CRF transitions.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern and check (digits, Luhn).  The method
adds what is written otherwise: addresses with spelled-out or bracketed signs, parted or defanged IP addresses, card
numbers in other groups, phone numbers without a plus or run together with what follows.  It is a bidirectional LSTM with
a CRF over the tags O, B and I of each kind, written and trained in numpy from labelled spans: ``TRAIN_WINDOWS`` windows
of the texts at most (chosen by hash over the whole table), labelled by the base, and ``DRAWN`` windows into which spans
made from templates (``draw``) are set, two of seven look-alikes that are none (``decoy``: dates, book and order numbers,
sections, versions, prices).  The checks of the kinds stay with the finder (``plausible``), so the network is taught the
shape of a number and the digits are checked afterwards.

Texts are read in overlapping windows on a fixed grid; of the windows that hold a character the one in whose middle it lies
decides its tag (Viterbi; posteriors by forward-backward), and spans are read off the joined tags, across windows.
A span of the method must hold a digit, an @ or a spelled-out sign (``MARK``), have a mean posterior of ``SURE``, pass
the check of its kind and overlap no base span; base spans always stay.  So windows are decoded on demand: those that
decide a mark, and then their neighbours as long as a tag reaches over the edge.  Every window that decides a character
of a span that holds a mark is among them, so the spans are those of decoding all windows; a test compares both.

Edge cases: a null text is empty; without labelled spans there is no model and only the base is returned; copies and
repeated rows get equal results; very long texts are read window by window; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents

#: The kinds in their order, and the patterns of the base.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

#: Spelled-out signs of addresses.
SIGN_AT = r"[\[({<]\s?at\s?[\])}>]"
SIGN_DOT = r"\bdot\b|[\[({<]\s?(?:dot|\.)\s?[\])}>]"
MARK = re.compile(rf"[0-9@]|{SIGN_AT}|{SIGN_DOT}", re.I)
AT = re.compile(rf"@|{SIGN_AT}|\bat\b", re.I)
DOT = re.compile(rf"\.|{SIGN_DOT}", re.I)

WINDOW, STRIDE = 64, 32
TRAIN_WINDOWS, DRAWN, TRAIN_STEPS = 1200, 4200, 1100
TURNS = (0, 1, 2, 3, 3, None, None)  # drawn windows: kinds, phone numbers (of most forms) twice, and look-alikes
SURE = 0.9
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind and place.

    An address is found from its @: its local part is the whole run of letters before it, as the pattern would have it,
    without trying every start of a long run.
    """
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, domain.end()))
                end = domain.end()
        at = text.find("@", max(at + 1, end))
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def symbols(text: str) -> np.ndarray:
    """Character codes for the network: ASCII as it is, other letters 1, all else 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where(points >= 0xC0, 1, 0)).astype(np.int64)


def decider(place: int) -> int:
    """The number on the grid of the window that decides the tag of a character."""
    return max(0, (place - (WINDOW - STRIDE) // 2) // STRIDE)


def plausible(kind: int, span: str) -> bool:
    """The check of a kind on a span of the method; all need a mark."""
    digits = [c for c in span if c in "0123456789"]
    if not MARK.search(span):
        return False
    if kind == 0:
        user = re.search(r"[^\s@]", span)
        return bool(user and (at := AT.search(span, user.end())) and DOT.search(span, at.end()))
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    return 9 <= len(digits) <= 15


class BiLstmCrf:
    """Tags characters; parameters in ``p``: embedding, two LSTMs, emission layer, transitions."""

    def __init__(self, seed: int, hidden: int = 20, embedding: int = 12, vocabulary: int = 128):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        self.hidden = hidden
        bias = np.zeros((2, 4 * hidden))
        bias[:, hidden : 2 * hidden] = 1.0  # remember at first
        self.p = {"embed": rng.normal(0, 0.3, (vocabulary, embedding)), "in": draw(2, embedding, 4 * hidden), "rec": draw(2, hidden, 4 * hidden), "bias": bias}
        self.p |= {"out": draw(2 * hidden, TAGS), "out_b": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS)), "begin": np.zeros(TAGS)}

    def cast(self, kind: type) -> None:
        self.p = {k: v.astype(kind) for k, v in self.p.items()}

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """Scores of the tags, (batch, time, tags).  Both directions run side by side, the backward one over the reversed window."""
        x, h = self.p["embed"][chars], self.hidden
        n, length, _ = x.shape
        ways = np.stack([x, x[:, ::-1]])
        drive = np.ascontiguousarray((ways @ self.p["in"][:, None] + self.p["bias"][:, None, None]).transpose(2, 0, 1, 3))
        half = np.repeat(np.array([0.5, 1.0], x.dtype), [3 * h, h])  # sigmoid(z) = (1 + tanh(z / 2)) / 2
        states, cells = np.zeros((length + 1, 2, n, h), x.dtype), np.zeros((length + 1, 2, n, h), x.dtype)
        gates, squashed = np.empty((length, 2, n, 4 * h), x.dtype), np.empty((length, 2, n, h), x.dtype)
        for t in range(length):
            gate = np.tanh((drive[t] + states[t] @ self.p["rec"]) * half, out=gates[t])
            gate[..., : 3 * h] = 0.5 + 0.5 * gate[..., : 3 * h]
            cells[t + 1] = gate[..., h : 2 * h] * cells[t] + gate[..., :h] * gate[..., 3 * h :]
            np.tanh(cells[t + 1], out=squashed[t])
            states[t + 1] = gate[..., 2 * h : 3 * h] * squashed[t]
        joined = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=2).transpose(1, 0, 2)
        return joined @ self.p["out"] + self.p["out_b"], (ways, joined, states, cells, gates, squashed) if keep else None

    def _messages(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of tags, expected counts of transitions, and log partition sums, with messages scaled at each step."""
        top, lead = e.max(axis=2, keepdims=True), (self.p["step"].max(), self.p["begin"].max())
        seen, step = np.exp(e - top), np.exp(self.p["step"] - lead[0])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(e.shape[:2], e.dtype)
        for t in range(e.shape[1]):
            came = alpha[:, t - 1] @ step if t else np.exp(self.p["begin"] - lead[1])
            alpha[:, t] = came * seen[:, t]
            scale[:, t] = alpha[:, t].sum(axis=1)
            alpha[:, t] /= scale[:, t, None]
        ahead = seen / scale[:, :, None]
        for t in range(e.shape[1] - 1, 0, -1):
            ahead[:, t] *= beta[:, t]
            beta[:, t - 1] = ahead[:, t] @ step.T
        pairs = step * (alpha[:, :-1].reshape(-1, TAGS).T @ ahead[:, 1:].reshape(-1, TAGS))
        return alpha * beta, pairs, np.log(scale).sum(axis=1) + top.sum(axis=(1, 2)) + lead[1] + (e.shape[1] - 1) * lead[0]

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        n, length = chars.shape
        h = self.hidden
        e, (ways, joined, states, cells, gates, squashed) = self.emissions(chars, keep=True)
        d_e, d_step, total = self._messages(e)
        rows, times = np.arange(n)[:, None], np.arange(length)[None, :]
        gold = e[rows, times, tags].sum(axis=1) + self.p["begin"][tags[:, 0]] + self.p["step"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_begin = d_e[:, 0].sum(axis=0) - np.bincount(tags[:, 0], minlength=TAGS)
        np.add.at(d_step, (tags[:, :-1], tags[:, 1:]), -1.0)
        d_e[rows, times, tags] -= 1.0
        d_e[np.abs(d_e) < 1e-9] = 0.0  # numbers too small for the format would slow down all that follows
        grads = {"begin": d_begin, "step": d_step, "out": np.tensordot(joined, d_e, ((0, 1), (0, 1))), "out_b": d_e.sum(axis=(0, 1))}
        d_joined = (d_e @ self.p["out"].T).transpose(1, 0, 2)
        d_states = np.stack([d_joined[:, :, :h], d_joined[::-1, :, h:]], axis=1)
        i, f, o, g = (gates[..., k * h : (k + 1) * h] for k in range(4))
        rec = self.p["rec"].transpose(0, 2, 1)
        d_gates, d_state, d_cell = np.empty_like(gates), np.zeros_like(states[0]), np.zeros_like(states[0])
        slope = np.concatenate([g * i * (1 - i), cells[:-1] * f * (1 - f), squashed * o * (1 - o), i * (1 - g**2)], axis=3)
        into = o * (1 - squashed**2)
        for t in range(length - 1, -1, -1):
            d_state = d_state + d_states[t]
            d_cell = d_cell + d_state * into[t]
            d_gates[t] = slope[t] * np.concatenate([d_cell, d_cell, d_state, d_cell], axis=2)
            d_state, d_cell = d_gates[t] @ rec, d_cell * f[t]
        flat = d_gates.transpose(1, 0, 2, 3).reshape(2, length * n, 4 * h)
        grads["rec"] = states[:-1].transpose(1, 3, 0, 2).reshape(2, h, length * n) @ flat
        grads["in"] = ways.transpose(0, 3, 2, 1).reshape(2, -1, length * n) @ flat
        grads["bias"] = flat.sum(axis=1)
        d_ways = (flat @ self.p["in"].transpose(0, 2, 1)).reshape(2, length, n, -1)
        each = (chars.T.reshape(-1) == np.arange(len(self.p["embed"]))[:, None]).astype(flat.dtype)
        grads["embed"] = each @ (d_ways[0] + d_ways[1, ::-1]).reshape(length * n, -1)
        return float((total - gold).mean()), {k: v / n for k, v in grads.items()}

    def train(self, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 1) -> list[float]:
        """Adam with clipped gradients and a rate that falls in the second half, over shuffled batches again and again; returns the losses."""
        rng, first, second, losses, order = np.random.default_rng(seed), {}, {}, [], np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(chars))
            own, order = order[:batch], order[batch:]
            loss, grads = self.gradients(chars[own], tags[own])
            losses.append(loss)
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first.get(k, 0.0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0.0) + 0.01 * g**2
                self.p[k] -= rate * min(1.0, 2.0 - 2.0 * step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of each window, and the posterior of each of its tags."""
        e, _ = self.emissions(chars)
        posterior, _, _ = self._messages(e)
        n, length, _ = e.shape
        back = np.zeros((n, length, TAGS), np.int64)
        score = e[:, 0] + self.p["begin"]
        for t in range(1, length):
            each = score[:, :, None] + self.p["step"]
            back[:, t] = each.argmax(axis=1)
            score = e[:, t] + each.max(axis=1)
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags, posterior[np.arange(n)[:, None], np.arange(length)[None, :], tags]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, start, end in reversed(spans):  # earlier kinds win where spans overlap
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def spans_from(tags: np.ndarray, sure: np.ndarray) -> list[tuple[Span, float]]:
    """Spans of one kind without a gap, with their mean posterior; a B within a span begins another."""
    out = []
    inside = np.flatnonzero(tags)
    if not len(inside):
        return out
    kind = (tags[inside] - 1) // 2
    new = np.append(True, (np.diff(inside) > 1) | (kind[1:] != kind[:-1]) | (tags[inside][1:] % 2 == 1))
    for rows in np.split(np.arange(len(inside)), np.flatnonzero(new)[1:]):
        start, end = int(inside[rows[0]]), int(inside[rows[-1]]) + 1
        out.append(((int(kind[rows[0]]), start, end), float(sure[start:end].mean())))
    return out


def decoded(model: BiLstmCrf, texts: list[str], every: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tags, posteriors) of each text: windows decoded on demand (or all of them), O where no window was."""
    padded: dict[int, np.ndarray] = {}
    wanted: set[tuple[int, int]] = set()
    for k, text in enumerate(texts):
        marks = range(len(text)) if every else [p for m in MARK.finditer(text) for p in (m.start(), m.end() - 1)]
        own = {decider(p) for p in marks}
        if own:
            padded[k] = np.concatenate([symbols(text), np.zeros(WINDOW, np.int64)])
            wanted |= {(k, w) for w in own}
    tags = {k: np.zeros(len(p), np.int8) for k, p in padded.items()}
    sure = {k: np.zeros(len(p), np.float32) for k, p in padded.items()}
    edge, done = (WINDOW - STRIDE) // 2, set(wanted)
    while wanted:
        places, wanted = sorted(wanted), set()
        for at in range(0, len(places), 512):
            some = places[at : at + 512]
            found, posterior = model.decode(np.stack([padded[k][w * STRIDE : w * STRIDE + WINDOW] for k, w in some]))
            for (k, w), own, p in zip(some, found, posterior):
                a, b = edge if w else 0, WINDOW - edge
                tags[k][w * STRIDE + a : w * STRIDE + b], sure[k][w * STRIDE + a : w * STRIDE + b] = own[a:b], p[a:b]
                if own[a] and w:
                    wanted.add((k, w - 1))
                if own[b - 1] and w * STRIDE + b < len(texts[k]):
                    wanted.add((k, w + 1))
        wanted -= done
        done |= wanted
    none = (np.zeros(0, np.int8), np.zeros(0, np.float32))
    return [(tags[k][: len(t)], sure[k][: len(t)]) if k in tags else none for k, t in enumerate(texts)]


def added_spans(model: BiLstmCrf, texts: list[str], base: list[list[Span]], every: bool = False) -> list[list[Span]]:
    """For each text the method's spans: plausible, sure, and apart from the base."""
    out: list[list[Span]] = [[] for _ in texts]
    for k, (tags, sure) in enumerate(decoded(model, texts, every)):
        if not len(tags):
            continue
        taken = tags_of(len(texts[k]), base[k]) > 0
        for (kind, start, end), mean in spans_from(tags, sure):
            if mean >= SURE and not taken[start:end].any() and plausible(kind, texts[k][start:end]):
                out[k].append((kind, start, end))
    return out


def draw(kind: int, rng: np.random.Generator) -> str:
    """A span of a kind from templates: as the base finds it, or in one of the forms that it misses."""
    one = lambda *of: of[rng.integers(len(of))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    if kind == 0:
        at = one("@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", "<at>", " at ", " AT ")
        dot = one(" dot ", " DOT ") if at in (" at ", " AT ") else one(".", " . ", "(dot)", " (dot) ", "[dot]", " [dot] ", "{dot}", "[.]", " dot ")
        user = word() + one("", digits(rng.integers(1, 4)), one(".", "_", "-", dot) + word())
        return user + at + dot.join([word() + one("", "", digits(1)), *([word()] if rng.random() < 0.3 else []), one("com", "org", "net", "de", "fr", "es", "example", "info")])
    if kind == 1:
        dot = one(".", " . ", " dot ", "[.]", "(.)", ". ", "[dot]", " .", "(dot)")
        return dot.join(str(n) for n in rng.integers(0, 256, 4))
    if kind == 2:
        own = [int(c) for c in digits(15)]
        own.append(next(d for d in range(10) if luhn("".join(map(str, [*own, d])))))
        shown = "".join(map(str, own))
        return one("", " ", "-", ".", "/", "_", ":", "  ", " - ", " . ").join(shown[k : k + 4] for k in range(0, 16, 4))
    gap = one(" ", "-", ".", "/", " - ")
    lead = one("+", "00", "0", "", "", "+", "tel:")
    if lead in ("+", "00"):
        lead += one("1", "33", "34", "44", "49") + one(" ", ".", "-", "/")
    area = one("{}", "({})", "({})", "{}").format(digits(3))
    if lead in ("0", "tel:") and rng.random() < 0.3:
        return lead + area + one(" ", "-", "/") + digits(rng.integers(6, 9))
    return lead + one(area + one(" ", gap) + digits(3) + gap + digits(4), area + one(" ", gap) + digits(3) + gap + digits(4), gap.join([digits(3), digits(2), digits(2), digits(2)]), gap.join([digits(3), digits(4), digits(4)]))


def decoy(rng: np.random.Generator) -> str:
    """A look-alike that is no personal data, with the words that tell it apart."""
    one = lambda *of: of[rng.integers(len(of))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    upto = lambda n: str(rng.integers(0, n))
    two = lambda n: f"{rng.integers(1, n):02d}"
    year = f"{one(19, 20)}{digits(2)}"
    gap = one("-", ".", "/", ". ")
    date = gap.join(one([year, two(13), two(32)], [two(32), two(13), year]))
    time = f"{two(24)}:{two(60)}" + one("", f":{two(60)}")
    name = one("order", "ref", "no.", "ticket", "invoice", "id", "#", "item", "case", "account", "code", word())
    parts = one(".", " . ", ". ", " .").join(upto(one(10, 30)) for _ in range(rng.integers(3, 6)))
    number = one(digits(rng.integers(5, 13)), f"{digits(rng.integers(4, 7))}-{digits(rng.integers(2, 6))}", f"{digits(4)} {digits(4)}")
    return one(
        one(date, f"{date} {time}", f"{date}T{time}Z", f"{date} {time} {name} {number}", f"{date} {name} {number}"),
        one("", "isbn ", "ISBN: ") + one("978", "979") + one("-", " ").join(["", digits(1), digits(4), digits(4), digits(1)]),
        one("", "isbn ") + one("978", "979") + digits(10),
        f"{name} {number}",
        digits(rng.integers(5, 13)),
        f"{one('section', 'chapter', 'article', 'clause', 'figure', 'part', 'see', 'step', 'table', '§')} {parts}",
        f"{one('version', 'release', 'v', 'build', 'update')} {parts}",
        f"{upto(1000)}{one(',', '.', ' ')}{digits(3)}{one('.', ',')}{digits(2)} {one('EUR', 'USD', 'euros', 'kg', 'km')}",
        f"{one('pages', 'pp.', 'from', 'lines')} {digits(rng.integers(2, 5))}{one('-', ' - ', ' to ')}{digits(rng.integers(2, 5))}",
        f"{digits(2)}.{digits(rng.integers(3, 6))}, {digits(2)}.{digits(rng.integers(3, 6))}",
        f"{one('volume', 'vol.', 'journal', word())} {digits(rng.integers(1, 3))}{one(' ', ', ', '')}({digits(rng.integers(1, 3))}){one(':', ', pp.', ',')} {digits(rng.integers(2, 4))}-{digits(rng.integers(2, 4))}",
        f"@{word()}{one(' ', '. ', ', ', ': ')}{word()}",
        f"at {time}{one('. ', ' dot ', ', ')}{word()}",
    )


def set_in(part: str, tags: np.ndarray, kind: int | None, span: str, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window with a span (of no kind: a decoy) set in between two words; at times another span stands right behind it."""
    gaps = [m.start() for m in re.finditer(r"\s", part) if not tags[m.start()]] or [0]
    at = int(gaps[rng.integers(len(gaps))])
    lead = " " if at else ""
    own = np.concatenate([np.zeros(len(lead), np.int64), tags_of(len(span), [] if kind is None else [(kind, 0, len(span))])])
    if rng.random() < 0.25:
        other = int(rng.integers(1, 4))
        more = draw(other, rng)
        span, own = f"{span} {more}", np.concatenate([own, [0], tags_of(len(more), [(other, 0, len(more))])])
    after = part[at:] if at else " " + part
    return part[:at] + lead + span + after, np.concatenate([tags[:at], own, np.zeros(len(after) - len(part) + at, np.int64), tags[at:]])


def taught(text: str) -> tuple[list[Span], np.ndarray]:
    """What a text teaches: spans, and the characters that nothing is learned from (matches that the base drops).

    Card numbers that fail the check of their digits are taught as such, since the finder checks them.
    """
    spans, unclear = base_spans(text), np.zeros(len(text), bool)
    known = {(k, a) for k, a, _ in spans}
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if (kind, m.start()) not in known:
                digits = sum(c in "0123456789" for c in m.group())
                if kind == 2 and digits < 13:
                    continue
                if kind == 2 and digits <= 19:
                    spans.append((2, *m.span()))
                else:
                    unclear[m.start() : m.end()] = True
    return sorted(spans), unclear


def labelled_windows(docs: DataFrame, text_col: str = "text", most: int = TRAIN_WINDOWS) -> DataFrame:
    """(number, sort, part, tags): at most ``most`` windows, a third each with finds, with marks but none, and without marks.

    Windows are numbered by a hash of what they hold, and the smallest numbers of each sort are taken.
    """
    each = most // 3

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py()
                spans, unclear = taught(text)
                tags = tags_of(len(text), spans)
                marked = {decider(m.start()) for m in MARK.finditer(text)}
                for w in sorted(marked | {hash_of(text) % (len(text) // STRIDE + 1)}):
                    place = slice(w * STRIDE, w * STRIDE + WINDOW)
                    part, own = text[place], tags[place].tolist()
                    if part and not unclear[place].any():
                        rows.append((hash_of(part), 0 if any(own) else 1 if MARK.search(part) else 2, part, own))
            rows = [r for sort in range(3) for r in sorted(r for r in rows if r[1] == sort)[:each]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["number", "sort", "part", "tags"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    windows = texts.mapInArrow(cut, "number long, sort int, part string, tags array<int>").dropDuplicates(["number"])
    sorts = [windows.where(F.col("sort") == sort).orderBy("number", "part").limit(each) for sort in range(3)]
    return sorts[0].unionByName(sorts[1]).unionByName(sorts[2])


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 2


def taught_model(windows: list[tuple[str, np.ndarray]], drawn: int = DRAWN, steps: int = TRAIN_STEPS, seed: int = 7) -> BiLstmCrf:
    """A model trained on labelled windows and on drawn ones, whose sorts take turns (``TURNS``)."""
    rng, real = np.random.default_rng(seed), len(windows)
    windows = list(windows)
    for k in range(drawn):
        part, own = windows[rng.integers(real)]
        kind = TURNS[k % len(TURNS)]
        part, own = set_in(part, own, kind, decoy(rng) if kind is None else draw(kind, rng), rng)
        shift = int(rng.integers(0, max(1, len(part) - WINDOW + 1)))
        windows.append((part[shift : shift + WINDOW], own[shift : shift + WINDOW]))
    chars, tags = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for k, (part, own) in enumerate(windows):
        chars[k, : len(part)], tags[k, : len(own)] = symbols(part), own
    model = BiLstmCrf(seed)
    model.cast(np.float32)
    model.train(chars, tags, steps)
    model.cast(np.float64)  # so that posteriors do not depend on how windows are batched
    return model


def fit(docs: DataFrame, text_col: str = "text", most: int = TRAIN_WINDOWS, drawn: int = DRAWN, steps: int = TRAIN_STEPS, seed: int = 7) -> BiLstmCrf | None:
    """Train in one task from a bounded number of windows; None if no window holds a span."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["number"], r["part"], r["tags"]) for batch in batches for r in batch.to_pylist())
        if any(any(tags) for _, _, tags in rows):
            model = taught_model([(part, np.array(tags, np.int64)) for _, part, tags in rows], drawn, steps, seed)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    trained = labelled_windows(docs, text_col, most).coalesce(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(trained[0]["model"]) if trained else None


def find(docs: DataFrame, model: BiLstmCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, all spans, and how many the method added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            base = [base_spans(t) for t in texts]
            more = added_spans(shared.value, texts, base) if shared.value else [[] for _ in texts]
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(render(own).encode()).hexdigest() for own in base], pa.string())
            spans = pa.array([render(own + extra) for own, extra in zip(base, more)], pa.string())
            added = pa.array([len(extra) for extra in more], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, fit(docs))
