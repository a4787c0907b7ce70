"""Personal data in whole texts (operator 9): fixed patterns, and spans that a conditional random field adds.

The field labels words by their shapes (:mod:`feedforge.llm.crf`). It adds a span where the patterns found none: a run of
words with one kind's labels that holds valid data of that kind, such as the cards of a list that the pattern takes for
one long number. Words that can only be O, which is nearly all, are not decoded: their margin proves it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.crf import KINDS, LABELS, PLAIN, Field, features, labelled_sentences, shape, train
from feedforge.llm.exchange import record_batch
from feedforge.llm.words import Chunk, chunks

# The patterns of the four kinds, apart from an address's part before the sign, which is found backwards.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does and takes whole runs; saying so keeps the search linear in long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PHONE_WITHOUT_SIGN = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_phone(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each sign is looked at once, so a long word costs no more than its length."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            free = found.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _valid_part(kind: str, text: str, begin: int, end: int) -> Iterator[Span]:
    """Valid data of a kind within a labelled run."""
    run = text[begin:end]
    if kind == "email":
        found = [(a, b) for a, b in _emails(run)]
    else:
        pattern, valid = {"ip": (_IP, _is_ip), "card": (_CARD, _is_card), "phone": (_PHONE, _is_phone)}[kind]
        found = [m.span() for m in pattern.finditer(run) if valid(m[0])]
        if kind == "phone" and not found:
            found = [m.span() for m in _PHONE_WITHOUT_SIGN.finditer(run)]
    for a, b in found:
        yield kind, begin + a, begin + b


def found_in(chunk: Chunk, field: Field) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """(row, text, base spans, all spans) of each document that holds a digit or a sign of an address."""
    data = chunk.data
    marked = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    if not len(marked):
        return
    begin, end, first = chunk.bounds()
    words = np.unique(np.searchsorted(begin, marked, side="right") - 1)
    owner = np.searchsorted(first, words, side="right") - 1
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    # The words beside marked ones see their shapes; all others see plain shapes only, for which one check decides.
    plain = features(PLAIN[None], PLAIN[None], PLAIN[None]) @ field.emit
    at_edge = [features(PLAIN[None], a[None], b[None]) @ field.emit for a in (PLAIN, 0 * PLAIN) for b in (PLAIN, 0 * PLAIN)]
    if min(_margin(p)[0] for p in [plain, *at_edge]) <= field.forced:
        look = np.arange(len(begin))
    else:
        look = np.unique(np.concatenate([words - 1, words, words + 1]))
        look = look[(look >= 0) & (look < len(begin))]
    labels = _decoded(chunk, field, begin, end, first, look)
    for d in np.unique(owner):
        text = data[chunk.offsets[d] : chunk.offsets[d + 1]].tobytes().decode()
        base = base_spans(text)
        taken = np.zeros(0, np.int64) if not base else np.array([(s[1], s[2]) for s in base], np.int64)
        spans = list(base)
        start = letters[chunk.offsets[d]]
        for kind, a, b in _runs(labels, look, int(first[d]), int(first[d + 1])):
            for span in _valid_part(kind, text, int(letters[begin[a]] - start), int(letters[end[b]] - start)):
                if not len(taken) or not ((taken[:, 0] < span[2]) & (taken[:, 1] > span[1])).any():
                    spans.append(span)
        yield int(d), text, base, sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _margin(scores: np.ndarray) -> np.ndarray:
    return scores[:, 0] - scores[:, 1:].max(1)


def _decoded(chunk: Chunk, field: Field, begin, end, first, look: np.ndarray) -> np.ndarray:
    """Labels of the words ``look``; words that are surely O split them into segments, decoded by length in batches."""
    raw = chunk.data
    known: dict[int, np.ndarray] = {}
    starts = set(first[:-1][np.diff(first) > 0].tolist())

    def of(word: int) -> np.ndarray:
        if word not in known:
            known[word] = shape(raw[begin[word] : end[word]].tobytes().decode())
        return known[word]

    zero = 0 * PLAIN
    if not len(look):
        return np.zeros(0, np.int64)
    own = np.stack([of(w) for w in look.tolist()])
    before = np.stack([zero if w in starts else of(w - 1) for w in look.tolist()])
    after = np.stack([zero if w + 1 in starts or w + 1 == len(begin) else of(w + 1) for w in look.tolist()])
    scores = features(own, before, after) @ field.emit
    open_ = np.flatnonzero(_margin(scores) <= field.forced)
    labels = np.zeros(len(look), np.int64)
    if not len(open_):
        return labels
    new = np.ones(len(open_), bool)
    new[1:] = np.diff(look[open_]) > 1
    new |= np.isin(look[open_], first[:-1])
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(open_)))
    for size in np.unique(np.ceil(np.log2(lengths)).astype(int)):
        some = np.flatnonzero(np.ceil(np.log2(lengths)).astype(int) == size)
        padded = np.zeros((len(some), 1 << size, len(LABELS)))
        places = np.arange(1 << size)
        inside = places[None] < lengths[some][:, None]
        at = open_[np.minimum(heads[some][:, None] + places, len(open_) - 1)]
        padded[inside] = scores[at[inside]]
        labels[at[inside]] = field.viterbi(padded, lengths[some])[inside]
    return labels


def _runs(labels: np.ndarray, look: np.ndarray, low: int, high: int) -> Iterator[tuple[str, int, int]]:
    """(kind, first word, last word) of each labelled run among the words from ``low`` to before ``high``."""
    kind, begin, last = None, 0, -2
    for place in range(int(np.searchsorted(look, low)), int(np.searchsorted(look, high))):
        word, label = int(look[place]), LABELS[labels[place]]
        goes_on = label[0] == "I" and label[2:] == kind and word == last + 1
        if kind and not goes_on:
            yield kind, begin, last
            kind = None
        if label != "O" and not goes_on:
            kind, begin = label[2:], word
        last = word
    if kind:
        yield kind, begin, last


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Spans per row of ``docs`` (doc_id, text).

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 of the base spans, spans (all, as
    kind:start:end by start in code points). A null text counts as empty. Rows stay as they are, repeated or without an id;
    other columns are ignored; an empty table gives no rows. The field is trained from the small labelled table unless given.
    """
    field = field or train(labelled_sentences(docs.sparkSession))
    counts = [f"n_{k}" for k in KINDS]
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for chunk in chunks(batches):
            n = len(chunk)
            number = np.zeros((n, len(KINDS)), np.int64)
            digests, joined = [nothing] * n, [""] * n
            for d, _, base, spans in found_in(chunk, field):
                for kind, _, _ in base:
                    number[d, KINDS.index(kind)] += 1
                digests[d], joined[d] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)
            yield record_batch(schema, [chunk.column("doc_id"), *number.T, digests, joined])

    types = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, types)


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; n_chars, if there, follows."""
    field = field or train(labelled_sentences(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            texts = chunk.column("text").to_pylist()
            for d, text, _, spans in found_in(chunk, field):
                out, free = [], 0
                for kind, a, b in spans:
                    if b > free:
                        out += [text[free : max(a, free)], f"<{kind.upper()}>"]
                        free = b
                texts[d] = "".join([*out, text[free:]])
            rows = chunk.batch.slice(chunk.first, len(chunk))
            at = rows.schema.get_field_index("text")
            yield rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out
