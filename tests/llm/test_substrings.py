import math
import random
import time

import numpy as np
import pandas as pd
from conftest import PASSAGE
from pyspark.sql import functions as F

from tagloom.llm.common import settled
from tagloom.llm.shingles import shingle_codes, word_codes
from tagloom.llm.substrings import (
    ENOUGH, HASHES, _longest, _parts, _runs, compact_windows, compare_block, compare_groups, contexts, intervals_agree, overlap, passages,
    repeated_passages, sharing, verbatim, verified_pairs, window_keys, without_repeats,
)


def tree(values, width, a, b):
    if b - a + 1 < width:
        return []
    k = a + int(np.argmin(values[a : b + 1]))
    return [(a, k, b), *tree(values, width, a, k - 1), *tree(values, width, k + 1, b)]


def test_windows_are_the_wide_nodes_of_the_tree():
    r = np.random.default_rng(1)
    for trial in range(300):
        n, width = int(r.integers(1, 60)), int(r.integers(1, 12))
        values = r.integers(0, 15 if trial % 2 else 10**9, n).astype(np.uint64)
        got = sorted(zip(*compact_windows(values, width)))
        assert got == sorted(tree(values, width, 0, n - 1))


def test_overlap_needs_enough_hashes_on_one_interval():
    assert overlap([0, 1], [0, 10], [99, 99], 2, 46)
    assert not overlap([0, 0], [0, 10], [99, 99], 2, 46)
    assert not overlap([0, 1], [0, 60], [70, 120], 2, 46)


def spans(df):
    return {(r.doc_id, r.start_word, r.end_word, r.class_id, r.n_docs) for r in df.collect()}


def test_planted_passages(spark):
    r = random.Random(2)
    fill = lambda n: " ".join(f"f{r.randrange(10**9)}" for _ in range(n))
    one, two, short = fill(60), fill(55), fill(30)
    rows = [(i, f"{fill(30 + i)} {one} {fill(20)}") for i in range(30)]
    rows += [(100 + i, f"{fill(5)} {two} {fill(40)} {short}") for i in range(5)]
    rows += [(200, f"{two} {fill(9)} {one}"), (300, fill(300)), (301, fill(10) + " " + short + " " + fill(10))]
    edited = one.split()
    edited[30] = "edited"
    rows.append((400, f"{fill(12)} {' '.join(edited)}"))
    got = spans(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    want = {(i, 30 + i, 90 + i, 0, 32) for i in range(30)} | {(200, 64, 124, 0, 32), (400, 12, 72, 0, 32)}
    want |= {(100 + i, 5, 60, 100, 6) for i in range(5)} | {(200, 0, 55, 100, 6)}
    assert got == want


def test_odd_rows(odd, none):
    got = spans(repeated_passages(odd))
    assert {(10, 1, 71, 10, 2), (11, 4, 74, 10, 2)} <= got
    assert {g[0] for g in got} == {7, 8, 10, 11} and len(PASSAGE.split()) == 70
    assert repeated_passages(none).collect() == []
    left = {r.doc_id: r.text for r in without_repeats(odd, repeated_passages(odd)).collect()}
    assert left[11] == "other words come first  and last" and left[8].strip() == "" and set(left) == {8, 11}


def test_a_window_at_the_limit_is_rarely_missed():
    miss = sum(math.comb(HASHES, k) * 0.8**k * 0.2 ** (HASHES - k) for k in range(ENOUGH))
    assert miss < 0.002


def test_nodes_with_equal_low_bits_keep_their_passages(spark):
    text = F.concat(F.lit(PASSAGE + " end"), F.col("id").cast("string"))
    marks = spark.range(40000).groupBy(F.xxhash64(text).bitwiseAND(0xFFFFFF).alias("mark"))
    twins = marks.agg(F.collect_list("id").alias("ids")).filter("size(ids) > 1").first().ids[:2]
    docs = spark.createDataFrame([(i, f"{PASSAGE} end{i}") for i in twins], "doc_id long, text string")
    assert {(g[0], g[4]) for g in spans(repeated_passages(docs))} == {(i, 2) for i in twins}


def test_passages_of_shared_lines_equal_a_comparison_of_all_pairs(spark):
    r = random.Random(5)
    fill = lambda n: " ".join(f"f{r.randrange(10**9)}" for _ in range(n))
    lines = [fill(20) for _ in range(3)]
    made = " ".join(lines)
    rows = [(i, f"{fill(60)} {r.choice(lines)} {fill(60)}") for i in range(240)]
    rows += [(1000 + i, f"{fill(40 + i)} {made} {fill(30)}") for i in range(2)]
    got = spans(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    codes = {i: shingle_codes(word_codes(t), 5) for i, t in rows}
    linked = {(a, b) for a in codes for b in codes if a < b and passages(codes[a], codes[b], 46, 80)}
    assert linked == {(1000, 1001)}
    assert got == {(1000 + i, 40 + i, 100 + i, 1000, 2) for i in range(2)}


def test_edge_lines_that_occur_earlier_stay_in_the_passage():
    r = random.Random(7)
    fill = lambda n: [f"f{r.randrange(10**9)}" for _ in range(n)]
    codes = lambda words: shingle_codes(word_codes(" ".join(words)), 5)
    line, last, rest = fill(20), fill(20), fill(40)
    for passage in (line + rest, rest + last, line + rest + last, line + last + fill(20)):
        n = len(passage) - 4
        one = codes(fill(7) + line + fill(9) + last + fill(30) + passage + fill(5))
        two = codes(fill(11) + passage + fill(8))
        at = 7 + 20 + 9 + 20 + 30
        assert passages(one, two, 46, 80) == [(at, at + n, 11, 11 + n)]
        assert passages(two, one, 46, 80) == [(11, 11 + n, at, at + n)]
    # Neighbours that share their edge line keep it both.
    left, right = fill(50), fill(50)
    one = codes(left + line + fill(60) + line + right)
    two = codes(fill(3) + left + line + right)
    assert {(0, 66, 3, 69), (130, 196, 53, 119)} <= set(passages(one, two, 46, 80))


def shared_words(texts, n=50):
    """Words of each text inside a run of ``n`` words that another text holds too: plain strings, every run looked up."""
    seen = {}
    for i, text in texts.items():
        words = text.split()
        for a in range(len(words) - n + 1):
            seen.setdefault(" ".join(words[a : a + n]), []).append((i, a))
    inside = {i: set() for i in texts}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, a in places:
                inside[i].update(range(a, a + n))
    return inside


def recall(spark, texts):
    """Share of the words in shared runs that lie in reported passages."""
    rows = list(texts.items())
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    covered = {i: set() for i in texts}
    for r in found:
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    want = shared_words(texts)
    total = sum(map(len, want.values()))
    assert total
    return sum(len(want[i] & covered[i]) for i in texts) / total


def test_recall_on_planted_passages_of_common_lines(spark):
    """Verbatim passages of 50 to 90 words, half of them made of lines that many texts hold."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    lines = [" ".join(word() for _ in range(rng.randint(8, 20))) for _ in range(12)]
    texts = {i: [rng.choice(lines) if rng.random() < 0.3 else " ".join(word() for _ in range(12)) for _ in range(rng.randint(4, 14))] for i in range(80)}
    for p in range(40):
        size = rng.randint(50, 90)
        passage = " ".join(rng.sample(lines, 6)) if p % 2 else " ".join(word() for _ in range(size))
        passage = " ".join(passage.split()[:size])
        for i in rng.sample(sorted(texts), rng.randint(2, 4)):
            texts[i].insert(rng.randrange(len(texts[i]) + 1), passage)
    assert recall(spark, {i: " ".join(parts) for i, parts in texts.items()}) > 0.97


def test_recall_on_documents(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect() if r.text and len(r.text) < 20_000}
    assert recall(spark, texts) > 0.97


def test_exchanges_of_a_table_leave_the_disk(spark):
    """They stayed until the driver collected its garbage, and op7's filled the check's disk."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = manager.getAllFiles()
        return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_") and n.endswith(".data")}

    before, key = left(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    table = settled(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    assert table.count() == 1000 and spark.conf.get(key, None) == setting
    for _ in range(50):
        if not (left() - before):
            break
        time.sleep(0.2)
    kept = left() - before
    # The count above is no table and may keep its own, one row a task.
    assert len(kept) <= 1


def test_pairs_that_share_enough_hashes():
    rng = random.Random(8)
    keys = [np.unique([rng.randrange(40) * 8 + rng.randrange(6) - 160 for _ in range(rng.randrange(30))]).astype(np.int64) for _ in range(60)]
    got = sharing(keys, 2)
    for i, one in enumerate(keys):
        for j, two in enumerate(keys):
            if i != j:
                assert got[i, j] == (len({int(k) & 7 for k in set(one.tolist()) & set(two.tolist())}) >= 2)


def test_the_full_comparison_sees_contexts_of_bounded_size():
    """Whole texts went to the disks once per block of every open group."""
    rng = random.Random(9)
    line, words = [f"l{k}" for k in range(20)], [f"f{rng.randrange(10**9)}" for _ in range(3000)]
    codes = word_codes(" ".join([*line, *words[:1500], *line, *words[1500:], *line])).astype(np.uint32)
    shingles = shingle_codes(codes.astype(np.uint64), 5)
    keys, places = window_keys(shingles, 46, HASHES)
    got = list(contexts(codes, keys.tolist(), places.tolist(), 5, 46, HASHES))
    assert {n for n, *_ in got} == set(range(len(keys))) and (places < 0).any()
    for number, place, start, around in got:
        held = np.frombuffer(around, np.uint32)
        assert 46 <= len(held) <= 2 * 58 + 1 and start <= place < start + len(held)
        assert held.tolist() == shingles[start : start + len(held)].astype(np.uint32).tolist()
        assert places[number] in (-1, place)


def test_contexts_of_a_block_link_what_all_pairs_link():
    """Also where shingles repeat; pairs of a node, of a class or of a block stay out."""
    rng = random.Random(10)
    links = missed = 0
    for trial in range(60):
        alphabet = 12 if trial % 3 == 0 else 10**6
        base = [rng.randrange(alphabet) for _ in range(117)]
        around = []
        for _ in range(14):
            own = [c if rng.random() > rng.choice([0, 0.05, 0.1, 0.2, 0.5]) else rng.randrange(alphabet) for c in base]
            cut = rng.randrange(60)
            own[:cut] = [rng.randrange(alphabet) for _ in range(cut)]
            around.append(np.array(own[rng.randrange(8) :], np.uint32))
        nodes, blocks, labels = np.arange(14) % 12, np.arange(14) % 2, np.array([rng.randrange(9) for _ in range(14)])
        places, starts = np.full(14, 1080), np.full(14, 1000)
        for both in (False, True):
            got = compare_block(nodes, blocks, labels, places, starts, around, 46, 80, both)
            root = {x: x for x in labels.tolist()}

            def top(x):
                return x if root[x] == x else top(root[x])

            for a, b, p, q, r, t in got:
                i, j = ([k for k in range(14) if nodes[k] == n] for n in (a, b))
                assert any((p - 1000, q - 1000, r - 1000, t - 1000) in passages(around[x], around[y], 46, 80) for x in i for y in j)
                if p <= 1080 < q and r <= 1080 < t:
                    for x in i:
                        for y in j:
                            if (p - 1000, q - 1000, r - 1000, t - 1000) in passages(around[x], around[y], 46, 80):
                                root[top(int(labels[x]))] = top(int(labels[y]))
            for x in range(14):
                for y in range(x + 1, 14):
                    if nodes[x] != nodes[y] and (not both or blocks[x] != blocks[y]):
                        if any(a <= 80 < b and c <= 80 < d for a, b, c, d in passages(around[x], around[y], 46, 80)):
                            links += 1
                            missed += top(int(labels[x])) != top(int(labels[y]))
    assert links > 500 and not missed


def test_a_verbatim_row_needs_no_windows():
    """Every verified pair had its windows joined in Python, which took most of the time of a pair."""
    rng = random.Random(14)
    seen = {True: 0, False: 0}
    for trial in range(200):
        alphabet = 60 if trial % 3 == 0 else 10**9
        shared = [rng.randrange(alphabet) for _ in range(rng.randint(44, 130))]
        own = [c if rng.random() > rng.choice([0, 0.01, 0.03]) else rng.randrange(alphabet) for c in shared]
        fill = lambda: [rng.randrange(alphabet) for _ in range(rng.randrange(40))]
        one, two = (np.array(fill() + c + fill(), np.uint64) for c in (shared, own))
        found = passages(one, two, 46, 80)
        got = verbatim(one, two, found, 46)
        seen[got] += 1
        assert not got or intervals_agree(one, two, 46, HASHES, ENOUGH)
    assert min(seen.values()) > 20


def test_the_longest_copy_is_the_first_of_the_longest():
    rng = random.Random(15)
    for _ in range(300):
        one, two = (np.array([rng.randrange(2) if rng.random() < 0.05 else 0 for _ in range(rng.randint(1, 200))]) for _ in range(2))
        j = rng.randrange(len(two))
        options = sorted(rng.sample(range(len(one)), rng.randint(1, len(one))))

        def extent(i):
            n = 0
            while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n]:
                n += 1
            return n

        assert _longest(one, two, options, j) == max(options, key=extent)


def test_runs_of_groups_are_whole_across_batches():
    rows = [(k, i, n) for n, (k, i) in enumerate(sorted((k, i) for k in range(7) for i in range(2) for _ in range(k + i)))]
    for size in (1, 2, 3, 50):
        batches = [pd.DataFrame(rows[a : a + size], columns=["key", "i", "n"]) for a in range(0, len(rows), size)]
        got = [(set(zip(r["key"].tolist(), r["i"].tolist())), r["n"].tolist()) for r in _runs(iter([pd.DataFrame(columns=["key", "i", "n"]), *batches]), ["key", "i"])]
        assert all(len(names) == 1 for names, _ in got) and [n for _, ns in got for n in ns] == list(range(len(rows)))
        assert len(got) == len({r[:2] for r in rows})


def test_links_do_not_depend_on_the_order_of_rows(spark):
    """The members of a group were compared as an exchange brought them, so two runs of one table differed."""
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(90)]
    rows = []
    for i in range(60):
        own = [w if rng.random() > 0.03 else word() for w in base]
        rows.append((i, " ".join([word() for _ in range(rng.randrange(30))] + own[rng.randrange(30) : 60 + rng.randrange(30)] + [word() for _ in range(9)])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(spans(repeated_passages(table.repartition(1))))
    assert want and sorted(spans(repeated_passages(table.orderBy(F.desc("doc_id")).repartition(5)))) == want


def _word_codes(words):
    return word_codes(" ".join(words)).astype(np.uint32)


def test_pairs_verified_at_once_equal_pairs_verified_alone():
    r = random.Random(11)
    fill = lambda n: [f"f{r.randrange(10**9)}" for _ in range(n)]
    line, block, texts = fill(20), fill(90), [[], fill(3), fill(49)]
    for k in range(60):
        # Edited, moved, doubled and interleaved pieces, and lines that repeat in one text.
        piece = [w if r.random() > 0.004 * (k % 12) else f"e{r.randrange(10**9)}" for w in block]
        middle = [*line, *piece[:60], *(line if k % 3 else fill(8)), *piece[45:], *(piece if k % 5 == 0 else [])]
        texts.append(fill(r.randrange(40)) + middle + fill(r.randrange(30)) + (line + fill(2)) * (k % 4) + piece[r.randrange(40) :])
    words = [_word_codes(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and (a * 7 + b) % 3 == 0]
    codes = [shingle_codes(w.astype(np.uint64), 5) for w in words]
    want = set()
    for k, (a, b) in enumerate(pairs):
        found = passages(codes[a], codes[b], 46, 80)
        if found and (verbatim(codes[a], codes[b], found, 46) or intervals_agree(codes[a], codes[b], 46, HASHES, ENOUGH)):
            want |= {(k, *p) for p in found}
    got = [x for at in range(0, len(pairs), 70) for x in ((k + at, *p) for k, *p in verified_pairs(pairs[at : at + 70], words, 5, 46, 80, HASHES, ENOUGH))]
    assert len(want) > 1000 and len(got) == len(want) and set(got) == want


def _group(r, members, family):
    """Contexts that share a line of 16 shingles; of ``family`` members each also what is around it."""
    line = r.integers(0, 1 << 32, 16).astype(np.uint32)
    around = []
    for _ in range(0, members, family):
        made = r.integers(0, 1 << 32, 101).astype(np.uint32)
        for _ in range(family):
            own = np.concatenate([made[:50], line, made[50:]])
            own[r.integers(0, 117, 4)] = r.integers(0, 1 << 32, 4)
            around.append(own)
    return [around[i] for i in r.permutation(len(around))]


def test_groups_compared_at_once_link_the_same_pairs():
    r = np.random.default_rng(3)
    groups = [_group(r, int(n), int(f)) for n, f in zip(r.integers(2, 40, 30), r.integers(1, 5, 30))]
    columns = [
        (np.arange(len(g)) + 100 * k, np.arange(len(g)) % 2, np.arange(len(g)) // 3, np.full(len(g), 58), np.zeros(len(g), int), g, k % 4 == 0)
        for k, g in enumerate(groups)
    ]
    alone = [x for c in columns for x in compare_block(*c[:6], 46, 80, c[6])]
    joined = [np.concatenate([c[i] for c in columns]) for i in range(5)]
    sizes, across = np.array([len(g) for g in groups]), np.array([c[6] for c in columns])
    assert len(alone) > 100
    assert sorted(alone) == sorted(compare_groups(sizes, *joined, [c for g in groups for c in g], 46, 80, across))


def test_links_of_a_group_do_not_grow_with_its_square():
    # All share a passage beside the window's place, none around it: no link joins their classes there.
    r, m = np.random.default_rng(5), 300
    shared, key = r.integers(0, 1 << 32, 50), r.integers(0, 1 << 32)
    around = [np.concatenate([shared, r.integers(0, 1 << 32, 8), [key], r.integers(0, 1 << 32, 58)]).astype(np.uint32) for _ in range(m)]
    found = compare_block(np.arange(m), np.zeros(m, int), np.arange(m), np.full(m, 58), np.zeros(m, int), around, 46, 80, False)
    assert {x for f in found for x in f[:2]} == set(range(m)) and {f[2:] for f in found} == {(0, 50, 0, 50)}
    assert len(found) < 10 * m


def test_groups_of_a_line_fall_apart():
    r = np.random.default_rng(6)
    around = [np.unique(g) for g in _group(r, 900, 3)]
    row = np.repeat(np.arange(len(around)), [len(a) for a in around])
    element = np.unique(np.concatenate(around), return_inverse=True)[1]
    part = _parts(row, element, np.full(len(around), 41))
    rows = [np.flatnonzero(part == p) for p in np.unique(part[part >= 0])]
    assert len(rows) == 300 and {len(x) for x in rows} == {3}
    assert all(len(np.intersect1d(around[x[0]], around[y])) >= 41 for x in rows for y in x)
    assert (_parts(row, element, np.full(len(around), 118)) == -1).all()
