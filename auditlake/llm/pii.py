"""Personal data: exact rules, and a character-level BiLSTM-CRF that adds to them.

Whole texts are searched.  A span of any kind has to hold a digit or an ``@`` to
be accepted, so the network reads the stretches around these characters, with
two windows of context on either side, wherever they are in a text.  A stretch
is cut into overlapping windows; their emissions are averaged where windows
overlap and one Viterbi pass over the whole stretch decides.  The network is
trained in numpy from labelled spans that a seeded generator writes; its weights
are kept beside this module, which writes them when it is run.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, arrow_rows, texts

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never begins inside a run of digits, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_STRETCH = re.compile(r"[0-9@](?:.{0,11}[0-9@])*", re.S)
WINDOW, STRIDE = 64, 32
#: Context that the network reads on either side of a digit or ``@``.
MARGIN = 2 * WINDOW

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    """Every part is at most 255, whatever zeros lead it."""
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the exact rules, ordered by kind and start; failing matches are dropped."""
    found: list[Span] = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            begin = at
            while begin > free and text[begin - 1] in _LOCAL:
                begin -= 1
            domain = _DOMAIN.match(text, at + 1) if begin < at else None
            if domain:
                found.append((0, begin, domain.end()))
                free = domain.end()
            at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if _octets(m[0]):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and ``@``, disjoint and in order."""
    out: list[list[int]] = []
    for m in _STRETCH.finditer(text):
        begin, end = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def codes(text: str) -> list[int]:
    """Printable ASCII by itself, white space as a space, letters and all the rest as one class each."""
    return [o - 31 if 32 <= (o := ord(c)) < 127 else 1 if c.isspace() else 96 if c.isalpha() else 97 for c in text]


N_CODES, N_TAGS, EMBED, HIDDEN = 98, 9, 16, 20  # code 0 is padding; tags: 0 none, 1 + 2k begins kind k, 2 + 2k goes on


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name; emissions of padded code matrices, and Viterbi over them."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        p = {"embed": r.normal(0, 0.3, (N_CODES, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, N_TAGS)), "out_b": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS)), "start": np.zeros(N_TAGS), "end": np.zeros(N_TAGS)}
        for side in "fb":
            p[f"w{side}"] = r.normal(0, 1 / np.sqrt(EMBED + HIDDEN), (EMBED + HIDDEN, 4 * HIDDEN))
            p[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        return Network(p)

    def lstm(self, x: np.ndarray, side: str, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states over time (time, batch, hidden); padded steps carry the state on."""
        steps, batch, _ = x.shape
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out = np.zeros((steps, batch, HIDDEN))
        w, bias = self.p[f"w{side}"], self.p[f"c{side}"]
        inputs = x @ w[:EMBED] + bias
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ w[EMBED:]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            h_new = o * tanh_c
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out

    def emissions(self, coded: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """(time, batch, tags) of (batch, time) codes."""
        x = self.p["embed"][coded.T]
        mask = (coded.T > 0).astype(float)
        kf, kb = ([], []) if tape is not None else (None, None)
        hidden = np.concatenate([self.lstm(x, "f", mask, kf), self.lstm(x, "b", mask, kb)], axis=2)
        if tape is not None:
            tape.update(x=x, mask=mask, hidden=hidden, f=kf, b=kb)
        return hidden @ self.p["out"] + self.p["out_b"]

    def viterbi(self, emitted: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) of (time, batch, tags) emissions."""
        steps, batch, _ = emitted.shape
        score = self.p["start"] + emitted[0]
        back = np.zeros((steps, batch, N_TAGS), np.int8)
        for t in range(1, steps):
            total = score[:, :, None] + self.p["trans"]
            back[t] = total.argmax(1)
            live = (t < lengths)[:, None]
            score = np.where(live, total.max(1) + emitted[t], score)
        at = (score + self.p["end"]).argmax(1)
        tags = np.zeros((batch, steps), np.int8)
        every = np.arange(batch)
        for t in range(steps - 1, -1, -1):
            live = t < lengths
            tags[live, t] = at[live]
            step = back[t][every, at]
            at = np.where(live & (t > 0), step, at)
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def loss_and_gradient(net: Network, coded: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of full windows and its gradient, by forward-backward and back-propagation."""
    p, tape = net.p, {}
    emitted = net.emissions(coded, tape)
    steps, batch, _ = emitted.shape
    gold = tags.T
    forward, backward = np.zeros_like(emitted), np.zeros_like(emitted)
    forward[0] = p["start"] + emitted[0]
    for t in range(1, steps):
        forward[t] = _log_sum(forward[t - 1][:, :, None] + p["trans"], 1) + emitted[t]
    backward[-1] = p["end"]
    for t in range(steps - 2, -1, -1):
        backward[t] = _log_sum(p["trans"] + (emitted[t + 1] + backward[t + 1])[:, None, :], 2)
    log_z = _log_sum(forward[-1] + p["end"], 1)
    every = np.arange(batch)
    score = p["start"][gold[0]] + p["end"][gold[-1]] + emitted[0][every, gold[0]]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    marginal = np.exp(forward + backward - log_z[None, :, None])
    d_emit = marginal.copy()
    d_emit[np.arange(steps)[:, None], every, gold] -= 1
    grad["start"] = marginal[0].sum(0) - np.bincount(gold[0], minlength=N_TAGS)
    grad["end"] = marginal[-1].sum(0) - np.bincount(gold[-1], minlength=N_TAGS)
    for t in range(1, steps):
        score = score + p["trans"][gold[t - 1], gold[t]] + emitted[t][every, gold[t]]
        pair = np.exp(forward[t - 1][:, :, None] + p["trans"] + (emitted[t] + backward[t] - log_z[:, None])[:, None, :])
        grad["trans"] += pair.sum(0)
        np.add.at(grad["trans"], (gold[t - 1], gold[t]), -1)
    grad["out"] = np.tensordot(tape["hidden"], d_emit, ((0, 1), (0, 1)))
    grad["out_b"] = d_emit.sum((0, 1))
    d_hidden = d_emit @ p["out"].T
    d_x = np.zeros_like(tape["x"])
    for side, part in (("f", d_hidden[:, :, :HIDDEN]), ("b", d_hidden[:, :, HIDDEN:])):
        w = p[f"w{side}"]
        dh, dc = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        for t, h, c, i, f, o, g, tanh_c, m in reversed(tape[side]):
            dh_all = dh + part[t]
            d_new, dh_skip = dh_all * m, dh_all * (1 - m)
            dc_new = dc * m + d_new * o * (1 - tanh_c**2)
            dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), d_new * tanh_c * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
            grad[f"w{side}"][:EMBED] += tape["x"][t].T @ dz
            grad[f"w{side}"][EMBED:] += h.T @ dz
            grad[f"c{side}"] += dz.sum(0)
            d_x[t] += dz @ w[:EMBED].T
            dh, dc = dh_skip + dz @ w[EMBED:].T, dc_new * f + dc * (1 - m)
    np.add.at(grad["embed"], coded.T, d_x)
    return float((log_z - score).mean()), {k: v / batch for k, v in grad.items()}


class SpanWriter:
    """Writes windows of made-up prose with personal data (labelled) and look-alikes (not labelled)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def number(self, n: int) -> str:
        return "".join(str(int(d)) for d in self.r.integers(0, 10, n))

    def word(self) -> str:
        word = "".join(self.pick(["th", "er", "on", "an", "re", "in", "ción", "ung", "eaux", "os", "ent", "ich", "la", "de", "mi", "é", "ß"]) for _ in range(int(self.r.integers(1, 4))))
        return self.pick([word, word, word, word.capitalize(), word.upper()]) + self.pick(["", "", "", ",", ".", "!", "%%%"])

    def name(self) -> str:
        return "".join(chr(97 + int(c)) for c in self.r.integers(0, 26, int(self.r.integers(2, 9))))

    def personal(self) -> tuple[int, str]:
        kind = int(self.r.integers(4))
        if kind == 0:
            local = self.name() + self.pick(["", ".", "_", "-"]) + self.pick(["", self.number(2), self.name()])
            return 0, f"{local.strip('._-')}@{self.name()}{self.pick(['', self.number(1)])}.{self.pick(['example.com', 'example.org', 'com', 'net', 'de', 'co.uk'])}"
        if kind == 1:
            return 1, ".".join(str(int(n)) for n in self.r.integers(1, 256, 4))
        if kind == 2:
            digits = self.number(int(self.pick([15, 12, 14, 16])))
            digits = next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
            gap = self.pick(["", "", " ", "-"])
            return 2, gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        a, b, c = self.number(3), self.number(3), self.number(4)
        return 3, self.pick([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{self.number(2)} {a} {b}{c}", f"+{self.number(2)}-{a}-{b}-{c}"])

    def lookalike(self) -> str:
        hexes = "".join(self.pick(list("0123456789abcdef")) for _ in range(int(self.r.integers(12, 40))))
        key = "".join(self.pick(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) for _ in range(16))
        return self.pick([hexes, f'"{hexes}"', f"password={hexes[:18]}", "AKIA" + key, self.number(int(self.r.integers(1, 9))), "CC BY-NC 4.0.", f"{self.number(1)}.{self.number(2)}", f"20{self.number(2)}-0{self.number(1)}-1{self.number(1)}", f"1{self.number(1)}:{self.number(2)}", f"@{self.name()}", f"${self.number(3)}.{self.number(2)}", f"#{self.number(4)}", f"({self.number(4)})", f"{self.number(3)} {self.number(2)}"])

    def window(self) -> tuple[str, list[int]]:
        """A window's text and tags, cut at a random place so that spans may be cut too."""
        text, tags = "", []
        while len(text) < WINDOW + 40:
            draw = self.r.random()
            if draw < 0.2:
                kind, piece = self.personal()
                text += piece
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            else:
                piece = self.lookalike() if draw < 0.36 else self.word()
                text += piece
                tags += [0] * len(piece)
            gap = self.pick([" ", " ", " ", "\n", ", "])
            text += gap
            tags += [0] * len(gap)
        at = int(self.r.integers(0, 40))
        return text[at : at + WINDOW], tags[at : at + WINDOW]


@lru_cache(maxsize=2)
def trained(seed: int = 11, steps: int = 300, batch: int = 32) -> Network:
    """The network after ``steps`` Adam steps on generated windows; the same for the same arguments."""
    net, writer = Network.fresh(seed), SpanWriter(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        windows = [writer.window() for _ in range(batch)]
        _, grad = loss_and_gradient(net, np.array([codes(t) for t, _ in windows]), np.array([g for _, g in windows]))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = net.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


#: Written by ``python -m auditlake.llm.pii``: what ``trained()`` gives, as 32-bit numbers.
WEIGHTS = Path(__file__).with_name("span_weights.npz")


@lru_cache(maxsize=1)
def shipped() -> Network:
    """The trained network from its file, so that a session need not train it again."""
    with np.load(WEIGHTS) as found:
        return Network({name: found[name].astype(float) for name in found.files})


def tag_texts(net: Network, parts: list[str], most: int = 1024) -> list[np.ndarray]:
    """Tags of each stretch: windows' emissions averaged where they overlap, then one Viterbi pass a stretch."""
    windows: list[tuple[int, int]] = []
    for i, part in enumerate(parts):
        starts = range(0, max(1, len(part) - WINDOW + STRIDE), STRIDE)
        windows += [(i, s) for s in starts]
    coded = [np.array(codes(part)) for part in parts]
    sums = [np.zeros((len(c), N_TAGS)) for c in coded]
    weight = [np.zeros((len(c), 1)) for c in coded]
    # A window's ends know less of what is around them than its middle.
    trust = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)
    for at in range(0, len(windows), most):
        some = windows[at : at + most]
        block = np.zeros((len(some), WINDOW), np.int64)
        for row, (i, s) in zip(block, some, strict=True):
            row[: len(coded[i][s : s + WINDOW])] = coded[i][s : s + WINDOW]
        emitted = net.emissions(block)
        for column, (i, s) in enumerate(some):
            n = len(coded[i][s : s + WINDOW])
            sums[i][s : s + n] += trust[:n] * emitted[:n, column]
            weight[i][s : s + n] += trust[:n]
    averaged = [s / w for s, w in zip(sums, weight, strict=True)]
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    at = 0
    while at < len(order):
        # Stretches of about one length are decoded together, within a bounded number of cells.
        longest = len(parts[order[at]]) * 5 // 4 + 8
        group = [order[at]]
        while at + len(group) < len(order) and len(parts[order[at + len(group)]]) <= longest and (len(group) + 1) * longest <= 1 << 17:
            group.append(order[at + len(group)])
        lengths = np.array([len(parts[i]) for i in group])
        block = np.zeros((lengths.max(), len(group), N_TAGS))
        for column, i in enumerate(group):
            block[: lengths[column], column] = averaged[i]
        for i, n, tags in zip(group, lengths, net.viterbi(block, lengths), strict=True):
            out[i] = tags[:n]
        at += len(group)
    return out


def _plausible(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return "@" in text[1:-1] and "." in text and not any(c.isspace() for c in text)
    if kind == 1:
        return bool(_IP.fullmatch(text)) and _octets(text)
    if kind == 2:
        return 13 <= len(digits) <= 19 and not any(c.isalpha() for c in text) and luhn(digits)
    return 7 <= len(digits) <= 15 and len(digits) < len(text) <= 24 and not any(c.isalpha() for c in text)


def added_spans(text: str, begin: int, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Plausible spans of the tags of one stretch that touch no exact span."""
    found, at = [], 0
    marked = np.flatnonzero(tags)
    if not len(marked):
        return found
    while at < len(tags):
        tag = int(tags[at])
        if not tag:
            at += 1
            continue
        kind, end = (tag - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        a, b = begin + at, begin + end
        while b > a and text[b - 1] in " \n,.;:!?":
            b -= 1
        while a < b and text[a] in " \n,.;:!?":
            a += 1
        if b > a and _plausible(kind, text[a:b]) and all(b <= s or e <= a for _, s, e in base):
            found.append((kind, a, b))
        at = end
    return found


def find_spans(texts_: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """For each text its exact spans, and all spans, both ordered by kind and start."""
    based = [base_spans(t) for t in texts_]
    where = [(i, b, e) for i, t in enumerate(texts_) for b, e in stretches(t)]
    tagged = tag_texts(net, [texts_[i][b:e] for i, b, e in where])
    every = [list(b) for b in based]
    for (i, begin, _), tags in zip(where, tagged, strict=True):
        every[i] += added_spans(texts_[i], begin, tags, based[i])
    return [(b, sorted(e)) for b, e in zip(based, every, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Counts of exact spans by kind, their digest, and all spans of every whole text.

    Spans are code-point ranges.  The counts and base_sha256 are of the exact
    rules; ``spans`` has these and what the network adds.  Null text counts as
    empty (no spans); repeated rows get one result each; null ids are kept.
    """
    model = net or shipped()

    def run(batch: pa.RecordBatch) -> dict:
        found = find_spans(batch.column("text").to_pylist(), model)
        out: dict = {"doc_id": batch.column("doc_id")}
        for k, kind in enumerate(KINDS):
            out[f"n_{kind}"] = [sum(s[0] == k for s in base) for base, _ in found]
        out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
        out["spans"] = [written(every) for _, every in found]
        return out

    return arrow_map(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are masked as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text``, all columns kept.

    Null texts stay null, empty ones empty; each of repeated rows is masked; an
    empty table stays empty.  Long texts are taken in slices of bounded bytes.
    """
    model = net or shipped()

    def run(part: pa.RecordBatch, found: list[str | None]) -> pa.RecordBatch:
        spans = find_spans([t or "" for t in found], model)
        made = [None if t is None else masked(t, every) for t, (_, every) in zip(found, spans, strict=True)]
        return part.set_column(at := part.schema.get_field_index("text"), part.schema.field(at), pa.array(made, part.schema.field(at).type))

    return arrow_rows(docs, run)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{name: value.astype(np.float32) for name, value in trained().p.items()})
