import random

import pytest

from lacuna.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        rest, unit = total - sum(fixed.values()), sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / unit > most * sizes[s] + 1e-9}
        if not over:
            return fixed | {s: rest * w[s] / unit for s in free}
        fixed |= {s: most * sizes[s] for s in over}
        free -= over
    return fixed


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, " ".join(["w"] * r.choice([0, 1, 5, 20, 20, 20, 90, 300])), r.choice(["b", "a", "ä", "hot", "hot", "hot", None]), "x") for i in range(600)]
    out += [(1000, None, "a", "x"), (1001, "", "only empty", "x"), (3, "w w w", "a", "same id"), (None, "w w", "b", "x"), (None, None, None, None), (2000, "w " * 5000, "hot", "x")]
    return out


def test_targets_and_tokens(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.copies(mixing.sizes(docs), bucket_rows=50).collect()
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    for r in found:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    expected = brute_targets(sizes)
    for r in found:
        assert r["target"] == pytest.approx(expected[r["source"]])
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(5, 0.02 * t), s


def test_tilt_meets_the_targets_exactly_in_expectation(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.copies(mixing.sizes(docs), repairs=0).collect()
    got, goal = {}, {}
    for r in found:
        got[r["source"]] = got.get(r["source"], 0) + r["rate"] * r["size"]
        goal[r["source"]] = r["target"]
    assert got == pytest.approx(goal, rel=1e-6)


def test_reruns_agree_and_partitions_do_not_matter(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    key = lambda df: sorted(map(repr, mixing.mix(df).select("doc_id", "size", "taken").collect()))
    assert key(docs) == key(docs.repartition(7))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
