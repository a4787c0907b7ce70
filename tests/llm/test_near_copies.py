"""Many copies of one text, each with changes of its own: near enough by size, too far apart to link."""

import random
from collections import Counter
from itertools import combinations

from feedforge.llm import similarity


def test_the_last_join_proposes_few_of_many_near_copies(spark, monkeypatch):
    draw = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(220):
        text = list(base)
        for n, at in enumerate(draw.sample(range(8, 92, 6), 2)):
            text[at] = f"n{i}x{n}"
        rows.append((i, " ".join(text)))
    proposed, write = [], similarity.written

    def noted(df, name, *more):
        out = write(df, name, *more)
        if name == "proposed":
            proposed.append(out)
        return out

    monkeypatch.setattr(similarity, "written", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, similarity.similar_texts(docs, frequent=8).collect()))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text.split() for _, text in rows)]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert got == Counter((d, len(sets[d]), label[d]) for d, _ in rows)
    assert len(set(label)) > 5
    assert proposed[-1].count() < 5 * len(rows)
