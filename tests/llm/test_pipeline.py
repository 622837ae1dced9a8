"""The pipeline's stages on a small corpus, each against its rule."""

import random

import corpus_pipeline


def test_stages_run_and_decide(spark, folder):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    rows, marks = [], []
    for i in range(240):
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
        bad = i % 6 == 0
        if bad:
            w = [x + "###" for x in w]
        text = " ".join(w) + (" " + passage if i % 20 == 1 else "")
        rows.append((i, text, f"s{i % 3}", 7, "x", 0.5))
        marks.append((i, 0 if bad else 1, 0))
    rows += [(1000 + i, rows[i][1], "s1", 7, None, None) for i in (1, 2, 3)]
    rows += [(2000, None, None, None, None, None), (2001, "", "s0", 0, "", 1.0), (1, rows[1][1], "s1", 7, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, rest string, score double")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        kept.append(docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(kept[-1], before.schema)
    quality, near, cut, mixed, packed = kept
    assert {r.doc_id for r in quality} >= {i for i in range(240) if i % 6}
    assert not {r.doc_id for r in quality} & {i for i in range(240) if not i % 6}
    assert not {1001, 1002, 1003} & {r.doc_id for r in near}
    assert sum(r.doc_id == 1 for r in near) == 1
    assert len(cut) == len(near) and not any(passage in r.text for r in cut)
    assert all(r.n_chars == len(r.text) for r in cut)
    words = {r.doc_id: len(r.text.split()) for r in cut}
    assert abs(sum(words[r.doc_id] for r in mixed) - sum(words.values())) < 3 * 250
    assert sum(r.n_words for r in packed) == sum(words[r.doc_id] for r in mixed)
    assert corpus_pipeline.run(spark, folder).columns == docs.columns
    empty = spark.createDataFrame([], before.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    """Groups are told apart by id and text; of each the least id stays, null ids last."""
    rng = random.Random(4)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    near = lambda t: t + " one more word"
    rows = [(1, text[0]), (1, text[1]), (1, near(text[1])), (2, text[1]), (3, text[2]), (3, text[2]), (None, text[3]),
            (None, text[4]), (None, near(text[4])), (None, text[5]), (9, near(text[5])), (4, ""), (4, None), (5, None), (None, text[6]),
            (None, text[6])]
    docs = spark.createDataFrame([(i, t, k, "s") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, _rows int, source string")
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(5), "").collect()
    assert len(got) == 10 and len({(r.doc_id, r.text) for r in got}) == 10
    kept = {(r.doc_id, r.text) for r in got}
    assert kept >= {(1, text[0]), (3, text[2]), (None, text[3]), (9, near(text[5])), (4, ""), (4, None), (5, None), (None, text[6])}
    assert len(kept & {(1, text[1]), (1, near(text[1]))}) == 1 and (2, text[1]) not in kept
    assert len(kept & {(None, text[4]), (None, near(text[4]))}) == 1


def test_target_mix_of_equal_rows(spark):
    """Rows that equal each other share what they take together, rows of one size and id do not."""
    rows = [(None, "w " * 10, "a", k) for k in range(300)] + [(None, f"u{k} " * 10, "b", k) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _extra int")
    got = corpus_pipeline.target_mix(spark, docs, "").collect()
    assert all(r.text for r in got) and got[0].asDict().keys() == {"doc_id", "text", "source", "_extra"}
    # a weighs 5 of 7 in 3900 words, b 2
    assert abs(10 * sum(r.source == "a" for r in got) - 3900 * 5 / 7) <= 10
    assert abs(10 * sum(r.source == "b" for r in got) - 3900 * 2 / 7) <= 10
