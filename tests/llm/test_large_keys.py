"""Keys of many unlike members, as a passage in all texts makes them, against brute force."""

import random
from collections import Counter
from itertools import combinations

from feedforge.llm import similarity


def test_common_passages_and_near_copies(spark):
    draw = random.Random(3)
    passage = [f"common{i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"w{i}x{j}" for j in range(draw.randint(5, 60))]
        text = [*own, *passage] if i % 2 else [*passage, *own]
        rows.append((len(rows), " ".join(text)))
        for _ in range(draw.choice([0, 0, 1, 3])):
            text = list(text)
            at = draw.randrange(len(text))
            text[at : at + draw.choice([0, 1, 2])] = [f"n{len(rows)}"]
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text.split() for _, text in rows)]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    want = Counter((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, similarity.similar_texts(docs, frequent=8).collect())) == want
