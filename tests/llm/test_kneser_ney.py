"""Operator 5's ratios beside a Kneser-Ney model written plainly over dictionaries of strings."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from agoraspark.llm import toxicity

D, N = toxicity.DISCOUNT, toxicity.ORDER


class Plain:
    """Counts of strings by class; probabilities by interpolated Kneser-Ney, the lower orders from both classes together."""

    def __init__(self, toxic, ordinary):
        self.counts = [Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1)) for texts in (ordinary, toxic)]
        kinds, self.follows = set(self.counts[0]) | set(self.counts[1]), {}
        for order in range(N - 1, 0, -1):
            before = defaultdict(set)
            for s in kinds:
                before[s[1:]].add(s[0])
            self.follows[order] = {s: len(x) for s, x in before.items()}
            kinds = set(self.follows[order])

    @staticmethod
    def smooth(counts, s, lower):
        own = [n for k, n in counts.items() if n and k[:-1] == s[:-1]]
        if not own:
            return lower
        return max(counts.get(s, 0) - D, 0) / sum(own) + D * len(own) / sum(own) * lower

    def lower(self, s):
        return self.smooth(self.follows[len(s)], s, self.lower(s[1:]) if len(s) > 1 else 1 / 256)

    def shared(self, s):
        return self.smooth(self.counts[0] + self.counts[1], s, self.lower(s[1:]))

    def ratio(self, s):
        toxic, ordinary = (self.smooth(self.counts[k], s, self.shared(s)) for k in (1, 0))
        return math.log(toxic) - math.log(ordinary)


def texts(seed):
    rnd = random.Random(seed)
    say = lambda words: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12)))
    return [say(["vile", "ugly", "the", "a", "fool", "of"]) for _ in range(12)], [say(["nice", "ugly", "the", "a", "day", "of", "off"]) for _ in range(15)] + ["abc", "", "x"]


def table(toxic, ordinary):
    code = lambda s: int.from_bytes(s.encode(), "big")
    plain = Plain(toxic, ordinary)
    names = sorted(set(plain.counts[0]) | set(plain.counts[1]), key=code)
    codes = np.array([code(s) for s in names], np.uint32)
    t, p = (np.array([plain.counts[k][s] for s in names], float) for k in (1, 0))
    return plain, names, codes, toxicity.ratios(codes, t, p)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ratios_are_those_of_a_plain_model(seed):
    plain, names, _, got = table(*texts(seed))
    assert len(names) > 80
    for s, r in zip(names, got.tolist(), strict=True):
        assert r == pytest.approx(plain.ratio(s), abs=1e-9), s


def test_probabilities_sum_to_one():
    """Over all bytes that may follow a context, seen or not, in either class and in every lower order."""
    plain, names, _, _ = table(*texts(4))
    for context in {s[:-1] for s in names[::5]} | {"zzz", "the"}:
        following = [context + chr(b) for b in range(256)]
        assert sum(plain.shared(s) for s in following) == pytest.approx(1, abs=1e-9)
        for k in (0, 1):
            assert sum(plain.smooth(plain.counts[k], s, plain.shared(s)) for s in following) == pytest.approx(1, abs=1e-9)
        for order in (1, 2, 3):
            assert sum(plain.lower(s[-order:]) for s in following) == pytest.approx(1, abs=1e-9)
    # The operator's own lower orders, over the bytes that it has met and the rest that it leaves to the uniform one.
    plain, names, codes, _ = table(*texts(5))
    for s, p in zip(names, toxicity.shared_backoff(codes, N).tolist(), strict=True):
        assert p == pytest.approx(plain.lower(s[1:]), abs=1e-12)


def test_a_text_is_scored_by_its_mean_ratio():
    toxic, ordinary = texts(6)
    plain, names, codes, ratios = table(toxic, ordinary)
    model, known = toxicity.lookup_table(codes, ratios), set(names)
    rows = ["the ugly fool of a day", "THE UGLY\tFOOL", "a", "", "unheard of words", toxic[0] + ordinary[0]]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    ends = np.cumsum([0, *[len(r) for r in rows]])
    got = toxicity.measured(data, ends, model)
    for row, m in zip(rows, got, strict=True):
        low = row.lower().replace("\t", " ")
        want = sum(plain.ratio(low[i : i + N]) for i in range(len(low) - N + 1) if low[i : i + N] in known) / max(1, len(row))
        assert m[0] == pytest.approx(want, abs=1e-6) and m[4] == pytest.approx(math.log(max(1, len(row))))
