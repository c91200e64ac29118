"""A character-level bidirectional LSTM with CRF transitions, in numpy, trained from labelled spans."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from agoraspark.session import shared_dir

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
VOCABULARY, EMBED, HIDDEN = 97, 12, 24
WINDOW = 64
Span = tuple[str, int, int]


def encoded(text: str) -> np.ndarray:
    """0 for what is not printable ASCII, else the place in it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code >= 32) & (code < 127), code - 31, 0).astype(np.int64)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Writer:
    """Writes personal data in many styles, and other text that looks like it."""

    SYLLABLES = ("an", "er", "th", "in", "on", "es", "re", "qu", "ou", "ción", "ment", "ü", "é", "ble", "st", "he", "ge", "lla", "sch", "to", "ri", "a", "o", "ed", "ing", "or")

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.pick = self.rng.choice

    def digits(self, k: int) -> str:
        return f"{self.rng.randrange(10**k):0{k}d}"

    def word(self) -> str:
        word = "".join(self.rng.choices(self.SYLLABLES, k=self.rng.randint(1, 4)))
        return word.capitalize() if self.rng.random() < 0.15 else word.upper() if self.rng.random() < 0.06 else word

    def name(self, most: int = 8) -> str:
        if self.rng.random() < 0.3:
            return "".join(self.rng.choices([x for x in self.SYLLABLES if x.isascii()], k=self.rng.randint(1, max(1, most // 3))))
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz", k=self.rng.randint(1, most)))

    def email(self, plain: bool) -> str:
        local = self.pick([self.name(), self.name() + "." + self.name(), self.name() + self.digits(2), self.name() + "_" + self.name(), self.name() + "." + self.digits(2), self.name(14), self.name(14), self.name() + "-" + self.name() + "+" + self.name(4), self.name(40)])
        local = local.capitalize() if self.rng.random() < 0.1 else local
        host = [self.pick([self.name(), self.name(14), self.name() + "-" + self.name(), self.name() + self.digits(1), "mail" + self.digits(1) + "." + self.name()]), self.pick(["com", "com", "org", "net", "edu", "gov", "de", "fr", "es", "it", "io", "eu", "co.uk", self.name(3)])]
        at = self.pick([" (at) ", "(at)", " [at] ", "[at]", " @ ", " {at} ", " at ", " AT "])
        dot = " dot " if at == " at " else " DOT " if at == " AT " else self.pick([".", " dot ", "(dot)", " (dot) ", "[dot]"])
        return local + "@" + ".".join(host) if plain else local + at + dot.join(host)

    def ip(self, plain: bool) -> str:
        return ("." if plain else self.pick([" . ", "[.]", "(.)", ". "])).join(str(self.rng.randrange(256)) for _ in range(4))

    def card(self, plain: bool) -> str:
        first = self.digits(15)
        number = first + next(d for d in "0123456789" if luhn(first + d))
        sep = self.pick(["", "", " ", "-"] if plain else [".", "/", "_", "  ", " - "])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self, plain: bool) -> str:
        styles = ["+{a} ({b}) {c}-{d}", "+{a} {b} {c} {d}", "+{a}-{b}-{c}-{d}"] if plain else ["({b}) {c}-{d}", "{b}-{c}-{d}", "{b}.{c}.{d}", "00{a} {b} {c} {d}", "00{a} ({b}) {c}-{d}"]
        national = ["0{b}/{c}{d}", "0{b} {c}{d}", "0{p} {p} {p} {p} {p}", "0{p}.{p}.{p}.{p}.{p}", "(0{b}) {d} {d}", "(0{p}) {d}{c}", "0{p}-{d}{c}", "{b} {c} {b}", "9{p} {b} {p} {p}"]
        style = self.pick(styles if plain or self.rng.random() < 0.5 else national)
        while "{p}" in style:
            style = style.replace("{p}", self.digits(1 if style.startswith("0{p}") and "/" not in style and style.count("{p}") == 5 else 2), 1)
        return style.format(a=self.digits(self.pick([1, 2])), b=self.digits(3), c=self.digits(3), d=self.digits(4))

    def entity(self, kind: str, plain: bool) -> str:
        return getattr(self, kind)(plain)

    def other(self) -> str:
        """What is no personal data, but has digits, dots, or words like at and dot."""
        d, name = self.digits, self.name
        return self.pick([
            d(4), d(1) + "." + d(1), "v" + d(1) + "." + d(2) + "." + d(1), d(2) + "/" + d(2) + "/" + d(4), d(4) + "-" + d(2) + "-" + d(2), "@" + name(), d(3) + " " + name(), d(2) + ":" + d(2),
            "".join(self.rng.choices("0123456789abcdef", k=20)), d(6), d(8), d(10), d(11), d(20), d(24), "sk-" + name() + d(6), name() + " at " + name(), "at " + d(2), "dot " + name(),
            "978-" + d(1) + "-" + d(3) + "-" + d(5) + "-" + d(1), d(1) + "-" + d(3) + "-" + d(5) + "-" + d(1), "979-" + d(2) + "-" + d(4) + "-" + d(3) + "-" + d(1), d(4) + "-" + d(2) + "-" + d(2) + " " + d(2) + ":" + d(2) + ":" + d(2),
            "DE" + d(2) + " " + " ".join(d(4) for _ in range(4)) + " " + d(2), "FR" + d(2) + d(10) + d(10), d(2) + " " + name() + " " + d(4), d(2) + "." + d(2) + "." + d(4) + " " + d(2) + ":" + d(2), d(1) + "," + d(3) + "," + d(3), name(14) + " at " + name() + " " + d(1),
            "(" + d(4) + ")", d(2) + "." + d(2) + "." + d(4), d(3) + "." + d(3), d(3) + "-" + d(2), d(4) + "." + d(4), "$" + d(3) + "." + d(2), d(5) + "-" + d(4), name() + "[" + d(1) + "]", d(1) + ". " + name(), d(2) + " . " + d(2),
        ])


def labelled_examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts of WINDOW characters with the spans of personal data in them, as patterns find it and as they don't, amid
    other numbers. Cards pass Luhn; whether a number does can't be told from its characters' look, so numbers of the same
    shape that fail are left to the check after the tagger."""
    w = Writer(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 32:
            draw = w.rng.random()
            kind = w.pick(("email", "email", "phone", *KINDS)) if draw < 0.26 else None
            piece = w.entity(kind, w.rng.random() < 0.4) if kind else w.other() if draw < 0.48 else w.word()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + w.pick([" "] * 9 + [", ", ".\n", "### ", "; ", "!! ", "%%% ", "\n"])
        cut = w.rng.randint(0, len(text) - WINDOW)
        text = text[cut : cut + WINDOW]
        moved = [(k, max(0, a - cut), min(WINDOW, b - cut)) for k, a, b in spans if b > cut and a < cut + WINDOW]
        out.append((text, moved))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _structure() -> np.ndarray:
    """Added to the transitions when decoding: inside a kind one comes only from its beginning or inside."""
    out = np.zeros((TAGS, TAGS))
    for inside in range(2, TAGS, 2):
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


class Tagger:
    """p: the parameters. Sequences are arrays of character numbers, batch by time."""

    def __init__(self, seed: int = 3, dtype: type = np.float64) -> None:
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.15, shape)
        self.p = {"E": small(VOCABULARY, EMBED), "O": small(2 * HIDDEN, TAGS), "o": np.zeros(TAGS), "A": small(TAGS, TAGS), "S": np.zeros(TAGS)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {"X" + d: small(EMBED, 4 * HIDDEN), "H" + d: small(HIDDEN, 4 * HIDDEN), "c" + d: bias}
        self.p = {k: w.astype(dtype) for k, w in self.p.items()}

    def _both(self, name: str) -> np.ndarray:
        return np.stack([self.p[name + "f"], self.p[name + "b"]])

    def _run(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Hidden states of both directions, time by batch; and what the way back needs. Both run in one loop, the second
        over the reversed sequence."""
        batch, times = x.shape
        read = np.stack([x, x[:, ::-1]])
        drive = self.p["E"][read].reshape(2, -1, EMBED) @ self._both("X") + self._both("c")[:, None]
        drive = np.ascontiguousarray(drive.reshape(2, batch, times, -1).transpose(2, 0, 1, 3))
        h = c = np.zeros((2, batch, HIDDEN), drive.dtype)
        kept = np.empty((7, times, 2, batch, HIDDEN), drive.dtype)
        back = self._both("H")
        for t in range(times):
            z = drive[t] + h @ back
            gates = _sigmoid(z[..., : 3 * HIDDEN])
            i, f, o, g = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :], np.tanh(z[..., 3 * HIDDEN :])
            kept[:6, t] = h, c, i, f, o, g
            c = f * c + i * g
            kept[6, t] = tc = np.tanh(c)
            h = o * tc
        out = kept[4] * kept[6]
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2), (read, kept)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._run(x)[0] @ self.p["O"] + self.p["o"]

    def loss_and_slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The mean negative log-likelihood of tags y, and its slopes by parameter."""
        hidden, (read, kept) = self._run(x)
        e = hidden @ self.p["O"] + self.p["o"]
        (times, batch, _), rows = e.shape, np.arange(x.shape[0])
        # Forward and backward sums, scaled to one at each step.
        most = e.max(axis=2, keepdims=True)
        ex, step = np.exp(e - most), np.exp(self.p["A"])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((times, batch, 1), e.dtype)
        for t in range(times):
            now = (alpha[t - 1] @ step if t else np.exp(self.p["S"])) * ex[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            alpha[t] = now / scale[t]
        for t in range(times - 2, -1, -1):
            beta[t] = (beta[t + 1] * ex[t + 1] / scale[t + 1]) @ step.T
        z = (np.log(scale) + most).sum(axis=(0, 2))
        gold = self.p["S"][y[:, 0]] + e[np.arange(times)[:, None], rows[None, :], y.T].sum(axis=0) + self.p["A"][y[:, :-1], y[:, 1:]].sum(axis=1)
        slope = {}
        de = alpha * beta
        slope["S"] = de[0].sum(axis=0) - np.bincount(y[:, 0], minlength=TAGS)
        ahead = (ex * beta / scale)[1:].reshape(-1, TAGS)
        met = np.bincount(y[:, :-1].ravel() * TAGS + y[:, 1:].ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        slope["A"] = step * (alpha[:-1].reshape(-1, TAGS).T @ ahead) - met
        de[np.arange(times)[:, None], rows[None, :], y.T] -= 1
        slope["O"], slope["o"] = hidden.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1))
        dhidden = de @ self.p["O"].T
        down = np.stack([dhidden[:, :, :HIDDEN], dhidden[::-1, :, HIDDEN:]], axis=1)
        dh = dc = np.zeros((2, batch, HIDDEN), e.dtype)
        dz = np.empty((times, 2, batch, 4 * HIDDEN), e.dtype)
        back = self._both("H").transpose(0, 2, 1)
        for t in range(times - 1, -1, -1):
            _, c, i, f, o, g, tc = kept[:, t]
            dh = dh + down[t]
            dc = dc + dh * o * (1 - tc**2)
            for k, part in enumerate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2))):
                dz[t, ..., k * HIDDEN : (k + 1) * HIDDEN] = part
            dh, dc = dz[t] @ back, dc * f
        flat = np.ascontiguousarray(dz.transpose(1, 2, 0, 3)).reshape(2, -1, 4 * HIDDEN)
        met = read.reshape(2, -1)
        before = kept[0].transpose(1, 2, 0, 3).reshape(2, -1, HIDDEN)
        slope["E"] = np.zeros_like(self.p["E"])
        for n, d in enumerate("fb"):
            slope["H" + d], slope["c" + d] = before[n].T @ flat[n], flat[n].sum(axis=0)
            # Summed by character first: what it drives is linear in it.
            by_char = np.zeros((VOCABULARY, met.shape[1]), e.dtype)
            by_char[met[n], np.arange(met.shape[1])] = 1
            by_char = by_char @ flat[n]
            slope["X" + d] = self.p["E"].T @ by_char
            slope["E"] += by_char @ self.p["X" + d].T
        return float((z - gold).mean()), {k: (v / batch).astype(e.dtype) for k, v in slope.items()}

    def fit(self, examples: list[tuple[str, list[Span]]], steps: int, batch: int = 64, rate: float | None = None, seed: int = 4) -> Tagger:
        """Adam over random batches, its rate falling to a twentieth; the more steps, the lower it begins."""
        rate = rate or min(0.03, 26 / steps)
        rng = np.random.default_rng(seed)
        x = np.stack([encoded(t) for t, _ in examples])
        y = np.zeros_like(x)
        for row, (_, spans) in enumerate(examples):
            for kind, a, b in spans:
                y[row, a:b] = 2 * KINDS.index(kind) + 2
                y[row, a] -= 1
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for n in range(1, steps + 1):
            chosen = rng.integers(0, len(x), batch)
            _, slope = self.loss_and_slopes(x[chosen], y[chosen])
            norm = float(np.sqrt(sum((s**2).sum() for s in slope.values())))
            now = rate * (1 - 0.95 * n / steps)
            for k, s in slope.items():
                s = s * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * s
                v[k] = 0.99 * v[k] + 0.01 * s**2
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags, batch by time."""
        return self.best_tags(self.emissions(x))

    def best_tags(self, e: np.ndarray) -> np.ndarray:
        """The best tags, batch by time, for emissions time by batch."""
        first = np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0), 0, -1e4)
        best, kept, steps = e[0] + self.p["S"] + first, np.empty((len(e), e.shape[1], TAGS), np.int8), self.p["A"] + _structure()
        for t in range(1, len(e)):
            every = best[:, :, None] + steps[None]
            kept[t] = every.argmax(axis=1)
            best = every.max(axis=1) + e[t]
        tags = np.empty((e.shape[1], len(e)), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[:, t - 1] = kept[t][np.arange(len(tags)), tags[:, t]]
        return tags


@lru_cache(maxsize=2)
def trained(examples: int = 9000, steps: int = 1300, seed: int = 1) -> Tagger:
    """The tagger, trained once a process, always to the same weights."""
    return Tagger(dtype=np.float32).fit(labelled_examples(examples, seed), steps)


def stored(spark: SparkSession) -> Tagger:
    """The tagger of the shared folder, which is trained and put there if this code has not done so before, or not to the end."""
    path = f"{shared_dir(spark)}/tagger-{hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]}"
    tagger, found = Tagger(dtype=np.float32), {}
    try:
        found = {r["name"]: bytes(r["weights"]) for r in spark.read.parquet(path).collect()}
    except AnalysisException:
        pass
    if {k: len(w) for k, w in found.items()} == {k: 4 * w.size for k, w in tagger.p.items()}:
        tagger.p = {k: np.frombuffer(found[k], "<f4").reshape(w.shape) for k, w in tagger.p.items()}
        return tagger
    tagger = trained()
    rows = [(name, bytearray(w.astype("<f4").tobytes())) for name, w in tagger.p.items()]
    spark.createDataFrame(rows, "name string, weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return tagger
