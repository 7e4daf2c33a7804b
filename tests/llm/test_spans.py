import hashlib
import math
import random
import re
import time

import brute
import pytest

from tagloom.llm import pii, secrets, spans
from tagloom.llm.queries import _digests


def holds(df, rows, rules, kinds):
    counts = {}
    for r in rows:
        base = brute.base(r[1], rules)
        want = (*[sum(b.startswith(k + ":") for b in base) for k in kinds], hashlib.sha256(",".join(base).encode()).hexdigest())
        counts.setdefault(r[0], []).append(want)
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((*[r[f"n_{k}"] for k in kinds], r.base_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in counts.items()}


def generated(alphabet, seed, n=300):
    r = random.Random(seed)
    return [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(0, 60)))) for i in range(n)]


PII_PARTS = ["a", "b.c", "@", ".", "d-e", "%", " ", "1", "23", "255", "256", "+", "-", "(", ")", "4111", "1111", "é", "😀", "\n", "_"]
SECRET_PARTS = [
    "password", "passwd", "Secret", "token", "TOKEN", "api_key", "apikey", "api-key", '"', "'", " ", ":", "=", "a", "Z9", "abcdef",
    "0123456789abcdef", "AKIA", "ABCDEFGH", "=/+", "\n", "é",
]


def test_personal_data_odd_rows(odd, rows):
    found = _digests(pii.find_personal_data(odd), "base", "found", pii.KINDS)
    holds(found, rows, brute.PII, pii.KINDS)


def test_personal_data_generated(spark):
    rows = generated(PII_PARTS, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    holds(_digests(pii.find_personal_data(df), "base", "found", pii.KINDS), rows, brute.PII, pii.KINDS)


def test_secrets_odd_rows(odd, rows):
    found, _ = secrets.secret_scan(odd)
    holds(_digests(found.withColumnRenamed("id", "doc_id"), "spans", "spans", secrets.KINDS), rows, brute.SECRETS, secrets.KINDS)


def test_secrets_generated(spark):
    rows = generated(SECRET_PARTS, 6)
    found, _ = secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    holds(_digests(found.withColumnRenamed("id", "doc_id"), "spans", "spans", secrets.KINDS), rows, brute.SECRETS, secrets.KINDS)


@pytest.mark.parametrize("text", ["a" * 20_000, "1." * 10_000, "a@b" + ".c" * 20_000, "1 " * 10_000, "token" * 4_000, "+1 " * 10_000])
def test_long_runs(spark, text):
    rows = [(1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    holds(_digests(df.select("doc_id", pii.find(df.text).alias("base")).withColumn("found", spans.nothing()), "base", "found", pii.KINDS), rows, brute.PII, pii.KINDS)
    holds(_digests(df.select("doc_id", secrets.find(df.text).alias("base")).withColumn("found", spans.nothing()), "base", "found", secrets.KINDS), rows, brute.SECRETS, secrets.KINDS)


def test_empty_tables(none):
    assert pii.find_personal_data(none).collect() == []
    found, fresh = secrets.secret_scan(none)
    assert found.collect() == [] and fresh.collect() == []


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([("p1", "token = abcdef1"), ("p2", "nothing")], "doc_id string, text string")
    _, first = secrets.secret_scan(old)
    assert first.count() == 2
    new = old.union(spark.createDataFrame([("p3", "token = abcdef1"), ("p4", "secret=zzzzzzz")], old.schema))
    found, second = secrets.secret_scan(new, first)
    assert [r.blob for r in second.collect()] == [hashlib.sha256(b"secret=zzzzzzz").hexdigest()]
    assert {r.id: len(r.spans) for r in found.collect()} == {"p1": 1, "p2": 0, "p3": 1, "p4": 1}
    # Other rules scan everything again.
    _, third = secrets.secret_scan(new, first, rules="2")
    assert third.count() == 3


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"filler{i} words about Zanzibar contact boss@corp.example.com today") for i in range(4)]
    rows += [(10 + i, f"filler{i} words about nothing today") for i in range(40)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = [s.value for s in found[0].found if s.kind == "term"]
    assert terms == ["-zanzibar", "-contact"]
    assert found[0].clean == "filler0 words about   [EMAIL] today"
    assert found[10].found == [] and found[10].clean is None


def brute_terms(rows, disclose=0.8, remove=0.99, support=3):
    """Spans of revealing terms by counting whole texts, one pair of entity and term at a time."""
    corpus, entities, words = [], {}, {}
    for i, text in rows:
        corpus.append({w.lower() for w in re.findall(r"[^\W_]+", text)})
        found = [x.split(":") for x in brute.base(text, brute.PII)]
        found = [(k, int(s), int(e)) for k, s, e in found]
        entities[i] = {f"{k}:{text[s:e].lower()}" for k, s, e in found}
        words[i] = [
            (m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)
            if not any(m.start() < e and m.end() > s for _, s, e in found)
        ]
    n, texts, out = len(rows), dict(rows), {}
    for i, _ in rows:
        told = {}
        for entity in entities[i]:
            with_e = [j for j in texts if entity in entities[j]]
            if len({texts[j] for j in with_e}) < support:
                continue
            ic = math.log2(n / len(with_e))
            for term in {w for _, _, w in words[i]}:
                both = [j for j in with_e if any(w == term for _, _, w in words[j])]
                if len({texts[j] for j in both}) < support or ic <= 0:
                    continue
                pmi = math.log2(len(both) * n / (sum(term in c for c in corpus) * len(with_e)))
                if pmi >= disclose * ic:
                    told[term] = told.get(term, False) or pmi >= remove * ic
        out[i] = [(s, e, ("-" if told[w] else "") + w) for s, e, w in words[i] if w in told]
    return out


def test_terms_equal_counting_by_hand(spark):
    rng = random.Random(9)
    names = ["boss@corp.example.com", "x@y.zé", "10.1.2.3", "+49 (30) 1234567"]
    rows = []
    for i in range(160):
        words = [rng.choice(["alpha", "Beta", "gamma", "Straße", "zeta_eta", "42"]) + rng.choice(["", "", str(rng.randrange(4))]) for _ in range(rng.randrange(12))]
        if rng.random() < 0.5:
            entity = rng.randrange(len(names))
            words += [names[entity], f"near{entity}"] + [f"mostly{entity}"] * (rng.random() < 0.9)
            words += rng.choice([[], ["also" + names[rng.randrange(2)]]])
        elif rng.random() < 0.1:
            words.append("mostly0")
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(3)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 50
    for r in got:
        assert [(s.start, s.end, s.value) for s in r.found if s.kind == "term"] == want[r.doc_id], r.doc_id


def test_a_text_of_many_addresses_takes_seconds(spark):
    text = " ".join(f"word{i} u{i}@h{i % 7}.example.com" for i in range(20_000))
    rows = spark.createDataFrame([(1, text), (2, "short a@b.cc")], "doc_id long, text string")
    start = time.perf_counter()
    found = {r.doc_id: r for r in pii.find_personal_data(rows).collect()}
    assert time.perf_counter() - start < 60
    assert len(found[1].base) == 20_000 and found[1].clean.count("[EMAIL]") == 20_000


def test_two_commits_give_the_findings_of_one(spark, documents):
    from tagloom.llm.queries import op8_secret_scan

    whole, _ = secrets.secret_scan(documents)
    want = {r.id: secrets_listed(r.spans) for r in whole.collect()}
    got = {r.doc_id: r.spans for r in op8_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    commits = [documents.filter("doc_id % 3 = 0"), documents.filter("doc_id % 3 < 2"), documents]
    found, ledger = secrets.scan_commits(commits)
    assert {r.id: secrets_listed(r.spans) for r in found.collect()} == want
    assert ledger.count() == documents.select("text").distinct().count()


def secrets_listed(found):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)
