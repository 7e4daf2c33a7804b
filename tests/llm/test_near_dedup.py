import random
import re

from tagloom.llm.graph import components
from tagloom.llm.near_dedup import near_duplicates


def shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}


def brute(rows, width):
    """Components by all pairs; rows with one id are one document."""
    sets = [(i, r[0], shingles(r[1], width)) for i, r in enumerate(rows)]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, s in sets:
        for j, b, t in sets[:i]:
            same = a is not None and a == b
            if same or (s and t and 100 * len(s & t) >= 80 * len(s | t) and (s == t or None not in (a, b))):
                root[top(i)] = top(j)
    least = {}
    for i, a, _ in sets:
        if a is not None:
            least[top(i)] = min(least.get(top(i), a), a)
    return sorted(((a, len(s), least.get(top(i)), a == least.get(top(i))) for i, a, s in sets), key=str)


def holds(spark, rows, width, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    assert sorted((tuple(r) for r in near_duplicates(df, width=width).collect()), key=str) == brute(rows, width)


def family(size, words, edits, seed, first=0):
    """Copies of one text with random changed words: similarities on both sides of the limit."""
    r = random.Random(seed)
    base = [f"b{seed}_{i}" for i in range(words)]
    rows = []
    for i in range(size):
        text = list(base)
        for _ in range(r.randrange(edits + 1)):
            text[r.randrange(words)] = f"x{r.randrange(10**6)}"
        rows.append((first + i, " ".join(text)))
    return rows


def test_odd_rows(odd, rows, none):
    got = sorted((tuple(r) for r in near_duplicates(odd, width=4).collect()), key=str)
    assert got == brute(rows, 4)
    assert near_duplicates(none).collect() == []


def test_families_around_the_limit(spark):
    r = random.Random(9)
    rows = family(120, 150, 9, 1) + family(60, 40, 4, 2, 1000) + family(40, 12, 2, 3, 2000) + family(300, 147, 14, 4, 3000)
    rows += [(5000 + i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 9)))) for i in range(150)]
    r.shuffle(rows)
    holds(spark, rows, 4)


def test_chains_keep_all_links(spark):
    words = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words[i * 5] = f"changed{i}"
        rows.append((i * 3 % 41 + 1, " ".join(words)))
    holds(spark, rows, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (100, 400), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 200, 300, 400)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
