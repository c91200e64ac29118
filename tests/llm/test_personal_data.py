"""Operator 3 on personal data by a second writer, who shares nothing with the one that writes the training texts."""

from __future__ import annotations

import collections
import random

import pytest

from agoraspark.llm import pii, tagger

FIRST = "anna peter.miller jsmith maria_lopez k.o.brien bob1984 info sales-team abcdefghij the.quick.brown.fox x".split()
HOSTS = "example acme-tools wanadoo mycompany university gmail t-online data9".split()


class Other:
    def __init__(self, seed):
        self.rnd = random.Random(seed)

    def d(self, k):
        return "".join(self.rnd.choice("0123456789") for _ in range(k))

    def email(self):
        r = self.rnd
        who = r.choice([*FIRST, "l" * r.randint(9, 60), "long.local.part.of.many.words." + r.choice(FIRST)])
        host, top = r.choice(HOSTS), r.choice(["com", "org", "co.uk", "edu", "de"])
        return r.choice([
            f"{who} at {host} dot {top.replace('.', ' dot ')}", f"{who} (at) {host}.{top}", f"{who}[at]{host}.{top}", f"{who} AT {host} DOT {top.replace('.', ' DOT ')}",
            f"{who} @ {host}.{top}", f"{who}(at){host}(dot){top.replace('.', '(dot)')}",
        ])

    def phone(self):
        d, r = self.d, self.rnd
        return r.choice([
            f"0{d(3)}/{d(7)}", f"0{r.choice('12345679')} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{d(2)}) {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}",
            f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"9{d(2)} {d(3)} {d(3)}",
        ])

    def ip(self):
        return self.rnd.choice([" . ", "[.]", "(.)"]).join(str(self.rnd.randrange(256)) for _ in range(4))

    def card(self):
        while not tagger.luhn(n := self.rnd.choice("345") + self.d(15)):
            pass
        return self.rnd.choice([".", "/", "_", "  "]).join(n[i : i + 4] for i in range(0, 16, 4))

    def harmless(self):
        d, r = self.d, self.rnd
        book = "978" + d(9)
        check = -sum(int(x) * (1 + 2 * (i % 2)) for i, x in enumerate(book)) % 10
        return r.choice([
            f"ISBN {book[:3]}-{book[3]}-{book[4:7]}-{book[7:]}-{check}", f"{r.randint(1800, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
            f"vol. {d(3)}, pp. {d(3)}-{d(3)}", f"{r.randint(1, 12)}:{d(2)} at night", "look at this dot there", f"order {d(6)}", f"{d(2)}.{d(3)},{d(2)} EUR", f"section {d(1)}.{d(1)}.{d(1)}",
        ])


@pytest.fixture(scope="module")
def found(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] and 20 < len(r["text"]) < 3000][:300]
    w, rows = Other(5), []
    for doc in docs:
        out, spans = "", []
        for word in doc.split(" "):
            out, draw = out + word + " ", w.rnd.random()
            if draw < 0.02:
                kind = w.rnd.choice(tagger.KINDS)
                piece = getattr(w, kind)()
                spans.append((kind, len(out), len(out) + len(piece)))
                out += piece + w.rnd.choice([" ", ", ", ". ", "; "])
            elif draw < 0.04:
                out += w.harmless() + " "
        rows.append((out, spans))
    return rows, pii.find_all([t for t, _ in rows], tagger.trained())


@pytest.mark.parametrize("kind", tagger.KINDS)
def test_added_spans_of_another_writer(found, kind):
    right = wrong = missed = 0
    for (text, spans), (base, every) in zip(*found, strict=True):
        got = {s for s in set(every) - set(base) if s[0] == kind}
        want = {s for s in pii.apart([s for s in spans if pii.plausible(s[0], text[s[1] : s[2]])], base) if s[0] == kind}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right > 150 and right >= 0.9 * (right + wrong) and right >= 0.9 * (right + missed), (right, wrong, missed)


def test_long_local_parts_are_whole():
    model, whole = tagger.trained(), collections.Counter()
    for n in (1, 20, 38, 50, 60, 200):
        for at in (" (at) ", "[at]", " @ "):
            text = f"write to {'q' * n}{at}example.com today"
            (base, every), end = pii.find_all([text], model)[0], text.index(" today")
            whole[("email", 9, end) in every] += 1
            assert all(a == 9 for k, a, b in every if k == "email" and b == end)
    assert whole[True] >= 16


def test_regions_end_at_white_space():
    text = "one " + "x" * 100 + "1" + "y" * 70 + " two three " + "z" * 60 + " 2"
    assert pii.regions(text) == [(4, 175), (186, len(text))]
    assert pii.regions("a " * 40 + "3" + " b" * 40) == [(40, 121)]
    assert pii.regions("") == [] and pii.regions("5") == [(0, 1)] and pii.regions("w" * 10_000) == []


def test_numbers_are_whole_and_no_books():
    assert pii.whole("phone", "978-0-306-40615-7", 0, 15) is None and pii.whole("phone", "x 12 3", 2, 4) == 2
    assert pii.whole("ip", "1.2.3.4.5", 0, 7) is None and pii.whole("email", "a,b.c@d.e", 4, 9) == 2
    assert pii.book("978-0-306-40615-7", "9780306406157") and not pii.book("978-0-306-40615-8", "9780306406158") and pii.book("0-306-40615-2", "0306406152")
    assert not pii.plausible("phone", "978-0-306-40615-7") and pii.plausible("phone", "555-123-4567")
    assert not pii.plausible("email", "look at this dot there") and pii.plausible("email", "abcdefghij at example dot com")


def test_a_broken_store_is_written_anew(spark):
    """A folder that an interrupted write has left is neither used nor kept."""
    import hashlib
    from pathlib import Path

    from agoraspark.session import shared_dir

    path = Path(f"{shared_dir(spark)}/tagger-{hashlib.sha256(Path(tagger.__file__).read_bytes()).hexdigest()[:16]}")
    tagger.stored(spark)
    for f in path.glob("*"):
        f.unlink()
    for f in path.glob(".*"):
        f.unlink()
    tagger.stored(spark)
    assert spark.read.parquet(str(path)).count() == len(tagger.Tagger().p)
    spark.createDataFrame([("E", bytearray(b"1234"))], "name string, weights binary").write.mode("overwrite").parquet(str(path))
    assert {k: v.shape for k, v in tagger.stored(spark).p.items()} == {k: v.shape for k, v in tagger.Tagger().p.items()}
