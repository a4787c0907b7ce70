"""Base spans of personal data against the plain patterns, on random and on hostile texts."""

import random
import re
import time

import pytest

from feedforge.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in p.finditer(text) if valid(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


@pytest.mark.parametrize("alphabet", ["01259.", "0123456789 -", "ab.@-%é", "+0123456789().- ", "012.@+-() aB_%é\n"])
def test_equal_to_the_plain_patterns(alphabet):
    draw = random.Random(alphabet)
    hits = 0
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60)))
        assert pii.base_spans(text) == plain(text), text
        hits += len(plain(text))
    assert hits > 20


def test_valid_cards_in_lists():
    draw = random.Random(2)
    for _ in range(300):
        body = "".join(draw.choice("0123456789") for _ in range(draw.randint(13, 18)))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        spaced = "".join(c + draw.choice(["", "", " ", "-"]) for c in card[:-1]) + card[-1]
        text = f"x {spaced}{draw.choice(['', ',', ' y', ' 7', '.1.2.3'])} {card}"
        assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    "text", ["7" * 300_000, "0" * 200_000 + ".1.2.3", "1." * 100_000, "+1(" + "(" * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "a@" * 100_000]
)
def test_long_runs_are_linear(text):
    begin = time.process_time()
    spans = pii.base_spans(text)
    assert time.process_time() - begin < 5
    assert all(b > a for _, a, b in spans)


def test_parts_with_many_zeros_in_spark(spark):
    texts = ["0" * 5000 + "1.2.3.4", "9" * 5000 + ".1.1.1", "1.2.3." + "5" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_ip for r in pii.personal_data(df).collect()}
    assert got == {0: 1, 1: 0, 2: 0}
