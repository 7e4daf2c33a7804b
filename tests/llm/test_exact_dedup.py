import hashlib
import re

from tagloom.llm.exact_dedup import cut_points, exact_dedup, verified


def brute(rows):
    groups = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups.setdefault(norm, []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    out = []
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        keep = min(groups[norm])[3]
        out.append((r[0], keep, len(groups[norm]), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd, rows):
    assert sorted((tuple(r) for r in exact_dedup(odd).collect()), key=str) == brute(rows)


def test_empty_table(none):
    assert exact_dedup(none).collect() == []


def test_cuts_depend_on_content_only():
    data = hashlib.shake_256(b"x").digest(200_000)
    ends = cut_points(data, 1024, 12, 32768)
    assert ends[-1] == len(data) and all(b - a <= 32768 for a, b in zip([0, *ends], ends))
    moved = cut_points(b"some bytes before" + data, 1024, 12, 32768)
    assert len({e - 17 for e in moved} & set(ends)) > len(ends) - 5
    assert cut_points(b"a" * 100_000, 1024, 12, 32768)[:2] == [32768, 65536]


def test_a_key_with_two_contents_is_told_apart(spark):
    # Two texts whose only chunk has one key but different digests.
    table = spark.createDataFrame(
        [(1, 5, "s1", [7], [b"one"]), (2, 5, "s2", [7], [b"two"]), (3, 5, "s3", [8], [b"three"])],
        "doc_id long, n_chars long, text_sha256 string, keys array<long>, digests array<binary>",
    )
    found = {r.doc_id: [bytes(b) for b in r.check] for r in verified(table).collect()}
    assert found == {1: [b"one"], 2: [b"two"], 3: []}
