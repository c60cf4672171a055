"""The pipeline against plain versions of its stages, each judged on its own input."""

import random

import corpus_pipeline
from lacuna.llm import quality

from .test_decontaminate import brute as brute_hits
from .test_mixing import brute_targets
from .test_secrets import base
from .test_simhash import brute_components, brute_print


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(25)) for k in range(5)]
    docs = [(i, prose(r.randint(30, 120)), r.choice(["en", "de"]), r.choice(["s1", "s2", "s3"])) for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "s1") for i in range(10)]
    docs += [(300 + i, f"{prose(40)} {items[i % 5][1]} {prose(20)}", "en", "s2") for i in range(8)]
    docs += [(400 + i, f"{prose(40)} token = abcdef0123456789abcdef012{i} {prose(10)}", "de", "s1") for i in range(6)]
    docs += [(500 + i, " ".join(f"{word()}%%%" for _ in range(50)), "en", "s1") for i in range(6)]
    docs += [(600, None, None, None), (601, "", "en", "s1"), (602, "few words", "en", "s3"), (3, docs[3][1], docs[3][2], docs[3][3])]
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = corpus()
    rows = [(i, t, lang, s, None if t is None else len(t), "extra") for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before, now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None, None
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, before, str(tmp_path))
        path = str(tmp_path / name)
        result.write.parquet(path)
        now = spark.read.parquet(path)
        old, new = before.collect(), now.collect()
        ids = sorted(x["doc_id"] for x in new)
        if name != "source_mix":
            assert now.columns == columns
        if name == "quality_rules":
            bad = {x["doc_id"] for x in old if (c := quality.statistics(x["text"]))[0] < 10 or 100 * c[4] > 20 * c[0]} | {500 + i for i in range(6)}
            assert ids == sorted(x["doc_id"] for x in old if x["doc_id"] not in bad)
        elif name == "near_duplicates":
            component = brute_components([brute_print(x["text"]) for x in old], [x["doc_id"] for x in old])
            assert ids == sorted({x["doc_id"] for x, c in zip(old, component, strict=True) if x["doc_id"] == c})
        elif name == "decontamination":
            assert ids == sorted(x[0] for x in brute_hits([(x["doc_id"], x["text"]) for x in old], items) if not x[5])
        elif name == "secret_scan":
            assert ids == sorted(x["doc_id"] for x in old)
            texts = {x["doc_id"]: x["text"] for x in old}
            for x in new:
                assert not base(x["text"]) and x["n_chars"] == len(x["text"])
                assert (x["text"] == texts[x["doc_id"]]) == (not base(texts[x["doc_id"]]))
        else:
            sizes = {}
            for x in old:
                sizes[x["source"]] = sizes.get(x["source"], 0) + len(x["text"].split())
            goal, source, taken = brute_targets(sizes), {x["doc_id"]: x["source"] for x in old}, {}
            for x in new:
                taken[source[x["doc_id"]]] = taken.get(source[x["doc_id"]], 0) + x["taken"]
            assert ids == sorted(x["doc_id"] for x in old)
            assert all(abs(taken[s] - goal[s]) <= max(5, 0.02 * goal[s]) for s in goal)
        before, kept = now, ids
    assert len(kept) > 120
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "taken").collect())) == sorted((x["doc_id"], x["taken"]) for x in new)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    r = random.Random(12)
    prose = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(80))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a, "x"), (1, b, "x"), (2, c, None), (5, d, "x"), (5, c, "x"), (None, e, "x"), (None, e, "x"), (None, a, "x"), (7, None, "x"), (8, "", "x"), (9, d, None), (5, d, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, a, "x"), (1, b, "x"), (2, c, None), (5, d, "x"), (None, e, "x"), (7, None, "x")], key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    r = random.Random(13)
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == 1
