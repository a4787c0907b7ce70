"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from math import log10
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from feedforge.llm import (
    decontamination,
    language_model,
    licenses,
    packing,
    pii,
    quality,
    repeats,
    similarity,
    token_files,
    warc,
)
from feedforge.llm import queries as registered
from feedforge.llm.crf import labelled_sentences, train
from feedforge.llm.words import rolling

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block long, row long, rank string"
ODD = [None, "", " \n\t", "A", "a b c d e f g h " * 3, "One two.\n\nOne two.", "ü é \U0001f600 x", "w " * 30000, "<|endoftext|> x  y"]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(4, 60))] for _ in range(8)]
    out = list(ODD)
    for _ in range(n):
        base = list(draw.choice(passages))
        for _ in range(draw.choice([0, 0, 1, 2, 8])):
            base.insert(draw.randrange(len(base) + 1), draw.choice(vocabulary))
        out.append(" ".join(base))
    return out


def table(spark, rows):
    """Documents with null ids and columns whose names clash with those of intermediate tables."""
    made = [(i, t, "en" if i is None or i % 2 else None, "a", len(t or ""), 1, 2, "x") for i, t in rows]
    return spark.createDataFrame(made, COLUMNS)


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts(1)))
    return [*found, (len(found), found[-1][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def test_rolling_fingerprints_tell_windows_apart():
    tokens = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for width in (1, 3, 5, 8, 20):
        seen = {}
        for i, h in enumerate(rolling(tokens, width)):
            assert seen.setdefault(h, tuple(tokens[i : i + width])) == tuple(tokens[i : i + width])
        assert len(set(seen.values())) == len(seen)


def test_quality_counts(docs, rows):
    got = {r.doc_id: r for r in quality.scores(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        own = words(text)
        places = {}
        for at in range(len(own) - 7):
            places.setdefault(tuple(own[at : at + 8]), []).append(at)
        covered = {j for v in places.values() if len(v) > 1 for at in v for j in range(at, at + 8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(own), sum(map(len, own)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(own) < 20 or 100 * len(covered) > 30 * len(own))
        assert not (r.kept and r.base_failed)


def test_quality_thresholds_follow_the_source(spark):
    clean = [(i, " ".join(f"{'#' if j % 2 and i < 300 else ''}w{i}x{j}" for j in range(30)), "en", "ab"[i >= 300]) for i in range(600)]
    junk = (600, " ".join(f"#w{j}" for j in range(30)), "en", "b")
    df = spark.createDataFrame([*clean, junk], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.scores(df).collect()}
    assert not kept[600] and all(kept[i] for i in range(600))


@pytest.mark.parametrize("frequent", [1, 32])
def test_similar_texts(spark, rows, frequent):
    some = [*rows, (3, "another row of id three"), (None, rows[20][1])]
    sets = []
    for _, text in some:
        own = words(lower(text))
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    parent = list(range(len(some)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in combinations(range(len(some)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(some):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = Counter((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(some))
    assert Counter(map(tuple, similarity.similar_texts(table(spark, some), frequent=frequent).collect())) == want


def test_one_of_each_group_with_repeated_and_null_ids(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    some = [(7, one), (7, one), (7, two), (3, f"{two} more"), (None, three), (None, three), (9, four), (None, four)]
    some += [(None, None), (5, ""), (5, "")]
    left = similarity.one_of_each_group(table(spark, some))
    assert left.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    want = [(7, one), (3, f"{two} more"), (None, three), (9, four), (None, None), (5, ""), (5, "")]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)


def test_repeats(spark, rows):
    some = [*rows, (None, rows[20][1])]
    seen, want = set(), []
    for doc, text in sorted(some, key=lambda r: (r[0] is not None, r[0])):
        own, gone = words(text), set()
        for at in range(len(own) - 19):
            window = tuple(own[at : at + 20])
            if window in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        want.append((doc, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert Counter(map(tuple, repeats.removal_digests(table(spark, some)).collect())) == Counter(want)


def encoded(name, text):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, 1]


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), block_bytes=2000)
    got = {r.doc_id: r for r in token_files.token_digests(token_files.read_token_files(spark, path)).collect()}
    start = 0
    for i, text in rows:
        ids = encoded("word_bpe_49k.json", text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_packing(docs, rows):
    made = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=64, open_windows=3, shortest_cut=4).collect()
    ids = {i: encoded("byte_bpe_50k.json", text) for i, text in rows}
    at, sequences = dict.fromkeys(ids, 0), {}
    for p in sorted(made, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.ids == ids[p.doc_id][p.start : p.start + p.length]
        at[p.doc_id] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert sum(at.values()) >= 0.93 * 64 * len(sequences)


def test_language_model(docs, rows):
    got = {r.doc_id: r for r in language_model.scores(docs).collect()}
    tokens = {i: [*words(lower(text)), None] for i, text in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0


def test_language_model_beats_unigrams_on_held_out_texts(spark, sf_dir):
    found = [r for r in language_model.scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_contamination(spark):
    item = "the train leaves Rome at 9 and covers 300 km in 4 hours so how fast does the train go on average today"
    other = item.replace("9", "7").replace("300", "120").replace("4", "2")
    wrong = item.replace("300 km in 4", "9 km in 5")
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b")], "item_id long, text string")
    some = [(0, f"x y z {item} tail"), (1, f"q {other} r"), (2, "the train leaves now"), (3, None), (None, item), (5, wrong)]
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.contaminated(table(spark, some), benchmark).collect()}
    assert got[0, 1] and got[None, 1] and got[1, 1] is False
    assert {d for d, _ in got} <= {0, 1, None, 5}
    left = decontamination.clean_documents(table(spark, some), benchmark)
    assert left.columns == [c.split()[0] for c in COLUMNS.split(", ")] and {2, 3} <= {r.doc_id for r in left.collect()}


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_contamination_adds_up_over_slots_of_other_length(spark):
    own = [f"w{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(36)]
    own[12], own[24] = "Anna", "Bertha"
    longer = " ".join(own).replace("Anna", "Clara Maria").replace("Bertha", "Dora Luise")
    speed = "a car drove 5 km along the old road and then 12 km along the new road until it stopped"
    dropped = " ".join(x for i, x in enumerate(own) if i not in (10, 20, 30))
    inserted = " ".join(x + " also" * (i % 12 == 11) for i, x in enumerate(own))
    benchmark = items(spark, [" ".join(own), speed])
    some = [(0, longer), (1, speed.replace("5 km", "7km").replace("12 km", "9km")), (2, dropped), (3, inserted), (4, " ".join(own[::-1]))]
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_matched, r.exact) for r in decontamination.contaminated(table(spark, some), benchmark).collect()}
    assert got == {(0, 0): (36, 36, False), (1, 1): (20, 20, False), (2, 0): (36, 28, True), (3, 0): (36, 36, True)}


def test_contamination_drops_only_windows_of_inconsistent_slots(spark):
    own = [f"w{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(36)]
    own[3], own[30] = "5", "5"
    changed = [*own[:30], "9", *own[31:]]
    both = [*own[:3], "7", *own[4:30], "9", *own[31:]]
    some = [(0, " ".join(changed)), (1, " ".join(both)), (2, " ".join(own).replace("5", "7"))]
    found = decontamination.contaminated(table(spark, some), items(spark, [" ".join(own)])).collect()
    got = {r.doc_id: (r.n_matched, r.exact) for r in found}
    assert got == {0: (30, True), 1: (30, False), 2: (36, False)}


def test_contamination_against_brute_force(spark):
    draw = random.Random(7)
    vocabulary = [f"w{chr(97 + i)}" for i in range(12)]
    made = [[draw.choice(vocabulary) for _ in range(draw.randint(3, 40))] for _ in range(12)]
    some = []
    for n in range(60):
        text = list(draw.choice(made))
        for _ in range(draw.choice([0, 1, 2, 4])):
            at = draw.randrange(len(text))
            text[at : at + draw.choice([0, 1])] = [draw.choice(vocabulary)] * draw.choice([0, 1, 2])
            text = text or ["wa"]
        some.append((n, " ".join([draw.choice(vocabulary) for _ in range(draw.randint(0, 9))] + text)))

    def covered(item, doc):
        width, near = min(8, len(item)), max(8, len(item) // 2)
        pairs = {
            (i + k, j + k)
            for i in range(len(item) - width + 1)
            for j in range(len(doc) - width + 1)
            if item[i : i + width] == doc[j : j + width]
            for k in range(width)
        }
        best = {}
        for i, j in sorted(pairs):
            best[i, j] = 1 + max((n for (x, y), n in best.items() if x < i and y < j and abs((j - y) - (i - x)) <= near), default=0)
        return max(best.values(), default=0)

    want = {}
    for doc, text in some:
        for i, item in enumerate(made):
            n = covered(item, text.split())
            if n and (2 * n >= len(item) or n >= 25):
                want[doc, i] = n
    found = decontamination.contaminated(table(spark, some), items(spark, [" ".join(x) for x in made])).collect()
    assert {(r.doc_id, r.item_id): r.n_matched for r in found} == want and all(r.exact for r in found)


def test_contamination_finds_copies_without_literal_words(spark):
    made = ["Compute 12 + 30 - 5 * 7 / 2 + 11 - 4 + 9", "17 + 40", "Paris, Rome, Oslo, Bern, Wien, Lima, Kiew, Riga, Prag", "Anna Bell"]
    some = [(i, f"and so by Mary {text} Smith km") for i, text in enumerate(made)]
    some.append((9, "and so by Mary compute 13 + 31 - 6 * 8 / 3 + 12 - 5 + 10 or 17 - 41 or Anna Boll"))
    found = decontamination.contaminated(table(spark, some), items(spark, made)).collect()
    assert {(r.doc_id, r.item_id, r.n_matched == r.n_words, r.exact) for r in found} == {(i, i, True, True) for i in range(4)}


def test_personal_data(spark):
    field = train(labelled_sentences(spark))
    card = "4465758382889437"
    text = f"é mail.a@b.example.com or {card} {card}, call +1 (663) 555-6869 from 8.196.197.208 not 999.1.1.1 nor 1234"
    some = [(0, text), (1, None), (2, ""), (3, "a" * 50000 + "@"), (4, "plain words only")]
    got = {r.doc_id: r for r in pii.personal_data(table(spark, some), field).collect()}
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 0, 1)
    spans = [s.split(":") for s in got[0].spans.split(",")]
    assert [text[int(a) : int(b)] for kind, a, b in spans if kind == "card"] == [card, card]
    assert all(got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in (1, 2, 3, 4))
    hidden = {r.doc_id: r for r in pii.masked(table(spark, some), field).collect()}
    assert hidden[0].text.startswith("é <EMAIL> or <CARD> <CARD>, call <PHONE> from <IP> not") and hidden[1].text is None
    assert hidden[0].n_chars == len(hidden[0].text) and hidden[4].text == "plain words only"


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    some = [(0, f"Copyright (c) 2020 A\n{mit.upper()}"), (1, "text\nreleased under the MIT licence!\nmore"), (2, None), (3, "")]
    got = {(r.doc_id, r.license_id, r.scope, r.n_matches) for r in licenses.licensed(table(spark, some)).collect()}
    assert got == {(0, "MIT", "document", 1), (1, "MIT", "line", 1)}


def test_licenses_as_published(spark):
    isc = "\n".join(re.sub("that the above ", "that the above\n", x) for x in licenses.KNOWN[4][1].split("\n"))
    some = [(0, f"Copyright (c) 2004 J. Doe\n\n{isc}"), (1, f"Copyright (c) 2020 Foo, Inc. {licenses.KNOWN[0][1]}")]
    some += [(2, f"Copyright 2020 A\nCopyright 2021 B\n{licenses.KNOWN[0][1]}"), (3, "Copyright notices matter.")]
    whole = [("BSD-2-Clause", "2020"), ("BSD-3-Clause", "2021")]
    own = {name: text for name, text in licenses.PUBLISHED[1::-1]}
    some += [(10 + i, f"Copyright (c) {year}, A. B.\nAll rights reserved.\n\n{own[name]}") for i, (name, year) in enumerate(whole)]
    files = sorted((p.stem, p.read_text()) for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt"))
    some += [(20 + i, text) for i, (_, text) in enumerate(files)] + [(60 + i, " ".join(t.split())) for i, (_, t) in enumerate(files)]
    got = {(r.doc_id, r.license_id) for r in licenses.licensed(table(spark, some)).collect() if r.scope == "document"}
    want = {(0, "ISC"), (1, "MIT"), (2, "MIT"), *((10 + i, name) for i, (name, _) in enumerate(whole))}
    assert got == want | {(at + i, name) for at in (20, 60) for i, (name, _) in enumerate(files)}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {name for name, _ in files}


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/x", "<head><title> A\n b</title></head><p>x &amp; y</p><script>no</script><a href='q'>z</a>"), (2, None, None), (3, "u\r\nv", "a\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(df))
    names = ["page_id", *warc.FIELDS, "block"]
    want = Counter(tuple(r[n] for n in names) for r in records.collect())
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert Counter(tuple(r[n] for n in names) for r in back.collect()) == want
    text = {r.page_id: r.block for r in back.collect() if r.warc_type == "conversion"}
    assert text[1] == "x & y\nz" and text[2] == ""


def test_empty_tables(spark, tmp_path):
    none = table(spark, [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for made in (
        quality.scores(none),
        similarity.similar_texts(none),
        repeats.removal_digests(none),
        language_model.scores(none),
        packing.pack(none, path),
        decontamination.contaminated(none, benchmark),
        pii.personal_data(none),
        licenses.licensed(none),
    ):
        assert made.count() == 0
    token_files.write_token_files(none, str(tmp_path / "t"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.scores(docs).collect() if r.kept}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
        if name == "quality rules":
            assert {r.doc_id for r in left.collect()} == kept
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(ids)


def test_registered_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registered.QUERIES)
    assert numbers == list(range(1, 14)) and set(registered.SQL) <= set(registered.QUERIES)
