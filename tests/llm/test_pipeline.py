import random

import corpus_pipeline


def test_pipeline_stages(spark, tmp_path):
    """Every stage against plain Python on documents with known copies, leaks and junk."""
    rng = random.Random(8)
    words = {"en": ["the", "and", "thing", "with", "other", "house"], "de": ["der", "und", "schön", "nicht", "straße", "haus"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("aeiou") * rng.randint(0, 3) for _ in range(n))
    item = text("en", 40)
    docs = [(i, text(lang, 60), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de"] * 40)]
    docs += [(100, "1234 %%", "en", "s0"), (101, None, "en", "s0"), (102, docs[3][1], "de", "s1"), (103, docs[4][1] + " extra", "en", "s2"), (104, item, "en", "s1")]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, at)
        assert k == 4 or out.columns == frame.columns
        out.write.parquet(f"{at}/{k}")
        frame = spark.read.parquet(f"{at}/{k}")
        kept.append({r.doc_id for r in frame.collect()})
    every = {d[0] for d in docs}
    assert kept[0] == every - {100, 101}
    assert kept[1] == kept[0] - {3}
    assert kept[2] == kept[1] - {103}
    assert kept[3] == kept[2] - {104}
    assert kept[4] <= kept[3]
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, at).collect())


def stages(spark, at, rows, schema="doc_id long, text string, lang string, source string, copy string, kept long, row0 long"):
    """The rows that each stage leaves."""
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    frame, left = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, at)
        assert k == 4 or out.columns == frame.columns
        out.write.parquet(f"{at}/{k}")
        frame = spark.read.parquet(f"{at}/{k}")
        left.append([(r.doc_id, r.text) for r in frame.collect()])
    return left


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, repeated and shared doc_ids, ties, and columns with the names that the stages use."""
    rng = random.Random(9)
    words = ["the", "and", "thing", "with", "other", "house", "stone", "river", "light", "paper"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice("aeiou") * rng.randint(0, 3) for _ in range(n))
    item, near, plain = text(40), text(60), [text(60) for _ in range(12)]
    rows = [(i, t, "en", "s0", "c", 1, 2) for i, t in enumerate(plain[:6])]
    rows += [(None, plain[6], "en", None, None, None, None), (None, plain[7], "en", None, "x", 1, 1), (None, plain[6], "en", "s1", "c", 1, 2)]
    rows += [(50, plain[8], "en", "s1", "c", 1, 2)] * 3 + [(50, plain[9], "en", "s1", "c", 1, 2)]
    rows += [(None, near, "en", "s1", "c", 1, 2), (None, near + " more", "en", "s1", "c", 1, 2), (60, near + " again", None, "s1", "c", 1, 2)]
    rows += [(None, item, "en", "s1", "c", 1, 2), (50, "so " + item, "en", "s1", "c", 1, 2), (None, None, "en", "s1", "c", 1, 2), (61, "", None, None, None, None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first, second, third, fourth, last = stages(spark, str(tmp_path), rows)
    key = lambda x: sorted(x, key=repr)
    assert key(first) == key((r[0], r[1]) for r in rows if r[1])
    assert key(second) == key({(r[0], r[1]) for r in rows if r[1]})
    assert len(third) == len(second) - 3 and sum(t.startswith(near) for _, t in third) == 1 and sum(item in t for _, t in third) == 1
    clean = [(r[0], r[1]) for r in rows if r[1] in plain]
    assert set(clean) <= set(third) and key(fourth) == key(x for x in third if item not in x[1])
    assert set(last) <= set(fourth) and {x for x in last if x[0] is None} and all(last.count(x) <= 3 for x in set(last))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stages(spark, str(tmp_path), []) == [[]] * 5
