"""Relational operators, skew helpers, layout and transforms on small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from libsight.functions import keys, ordered
from libsight.functions.substring import contains_join
from libsight.operators import context, layout, passages, refs, review, search, tags, transform
from libsight.sources import payloads, snapshots
from libsight.streaming import jobs, state


def test_skew_join_equals_join(spark):
    rng = random.Random(1)
    big = spark.createDataFrame([(0 if rng.random() < 0.5 else rng.randint(1, 9), i) for i in range(500)], "k int, v int")
    small = spark.createDataFrame([(k, k * 10) for k in range(8)], "k int, w int")
    for how in ("inner", "left"):
        got = ordered.skew_join(big, small, ["k"], how, hot_rows=50, splits=5)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, big.join(small, ["k"], how).collect()))


def test_running_total_in_buckets(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 5)) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    for how, descending in (("sum", False), ("sum", True), ("max", False)):
        order = [F.col("i").desc()] if descending else [F.col("i")]
        got = ordered.running_total(df, ["k"], order, F.floor(F.col("i") / 7), F.col("v"), "t", descending, how)
        for r in got.collect():
            past = [v for k, i, v in rows if k == r.k and (i >= r.i if descending else i <= r.i)]
            assert r.t == (sum(past) if how == "sum" else max(past))


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    patterns = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(20)]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string")
    p = spark.createDataFrame([(j, s) for j, s in enumerate(patterns)], "j int, p string")
    got = sorted((r.i, r.j) for r in contains_join(t, "t", p, "p").collect())
    assert got == sorted((i, j) for i, s in enumerate(texts) for j, q in enumerate(patterns) if q and q in s)


def _fold(log, ladder):
    cards = {}
    for card, day, _i, grade in log:
        if grade == "enrol":
            cards[card] = [day + 1, 0, 0, 0]
        elif grade == "forget":
            cards.pop(card, None)
        elif card in cards:
            c = cards[card]
            if grade == "bury":
                c[0] = day + 30
                continue
            c[3] += 1
            if grade == "again":
                c[:3] = [day + 1, 0, c[2] + 1]
            else:
                c[1] = min(len(ladder) - 1, c[1] + (2 if grade == "easy" else 1))
                c[0] = day + ladder[c[1]]
    return cards


def test_review_fold(spark):
    rng = random.Random(4)
    log, known = [], set()
    for i in range(400):
        card = rng.randint(1, 12)
        grade = "enrol" if card not in known else rng.choice(["again", "good", "good", "easy", "bury", "forget"])
        known = known | {card} if grade == "enrol" else known - {card} if grade == "forget" else known
        log.append((card, i // 3, i, grade))
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(c, base + dt.timedelta(days=d, seconds=i), i, g) for c, d, i, g in log],
                               "card_key int, ts timestamp, review_id int, grade string")
    got = {r.card_key: [(r.due - base.date()).days, r.step, r.lapses, r.reviews] for r in review.deck_state(df).collect()}
    assert got == _fold(log, review.LADDER)


def test_gaps_ignore_empty_keys(spark):
    r = spark.createDataFrame([(1, None, "深度学习", 1), (2, "10.1/A", "Title one two", 5), (3, "10.1/a", "Other name", 5)],
                              "citing_key int, doi string, title string, citations int")
    owned = spark.createDataFrame([(9, None, "中文")], "item_key int, doi string, title string")
    got = {(g.gap_key, g.hits) for g in refs.gaps(r, owned, 1).collect()}
    assert got == {("10.1/a", 2)}
    assert ("深度学习", 1) in {(g.gap_key, g.hits) for g in refs.gaps(r, owned, 1, unicode_titles=True).collect()}


def test_renamed_branch():
    assert tags.renamed_branch("#Method", "Way") == "#Way"
    assert tags.renamed_branch("#Method/Survey", " a/b ") == "#Method/ab"
    assert tags.renamed_branch("#Method", "Method") is None and tags.renamed_branch("#M", " / ") is None


def test_chunks_carry_their_tail(spark):
    pages = [("d", ["A" * 30 + "\n\n" + "B" * 30, "C" * 50])]
    df = spark.createDataFrame(pages, "item_key string, pages array<string>")
    got = [(r.n, r.page, r.text) for r in search.chunk_text(df, size=70, overlap=10).orderBy("n").collect()]
    assert got == [(0, 0, "A" * 30 + "\n\n" + "B" * 30), (1, 1, "B" * 8 + "\n\n" + "C" * 50)]


def test_index_build_numbers_the_metadata_first(spark):
    df = spark.createDataFrame([("a", "Title: a long enough title", ["x" * 40]), ("b", "Title: another title, b", [])],
                               "item_key string, meta string, pages array<string>")
    got = sorted((r.chunk_id, r.page) for r in search.build_chunks(df).collect())
    assert got == [("a:0", -1), ("a:1", 0)]  # b's only text is under the least chunk size
    assert search.build_chunks(df, indexed=df).count() == 0


def test_vector_search_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, i % 4, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, item_key bigint, vector array<double>").repartition(4)
    queries = [(q, [rng.gauss(0, 1) for _ in range(6)]) for q in range(3)]
    qdf = spark.createDataFrame(queries, "query_id bigint, qv array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = []
    for q, v in queries:
        used, picked = {}, []
        for c, item, u in sorted(rows, key=lambda r: -cos(v, r[2])):
            if used.get(item, 0) < 3 and len(picked) < 8:
                used[item] = used.get(item, 0) + 1
                picked.append((q, c))
        want += picked
    block, search.QUERY_BLOCK = search.QUERY_BLOCK, 2
    try:
        blocked = search.vector_search(chunks, qdf)
    finally:
        search.QUERY_BLOCK = block
    for got in (search.vector_search(chunks, qdf), blocked):
        assert sorted((r.query_id, r.chunk_id) for r in got.collect()) == sorted(want)


def test_history_keeps_the_newest(spark):
    turns = spark.createDataFrame([(1, i, "user", "x" * 38) for i in range(5)] + [(2, 0, "user", "y" * 400), (1, 5, "user", " ")],
                                  "conv_id int, turn int, role string, text string")
    kept = context.history(turns, budget=31).collect()
    assert sorted((r.conv_id, r.turn) for r in kept) == [(1, 2), (1, 3), (1, 4), (2, 0)]


def test_engine_chain(spark):
    def broken(texts):
        raise transform.EngineError("auth", "401")

    def halves(texts):
        return [t.upper() if "b" in t else "" for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "  "), (4, "ab")], "i int, text string")
    chain = [transform.Engine("one", broken), transform.Engine("two", halves),
             transform.Engine("paid", lambda t: ["no"] * len(t), fallback=False)]
    results = transform.translate_texts(transform.distinct_texts(df), chain, "one", "en")
    assert transform.incomplete(results).collect()[0].missing == 1
    assert {(r.engine, r.value) for r in transform.cache_rows(results, "en").collect()} == {("two", "AB")}
    got = {r.i: r.translated for r in transform.attach(df, results).collect()}
    assert got == {1: "AB", 2: None, 3: None, 4: "AB"}
    try:
        transform.translate_texts(transform.distinct_texts(df), chain[:1], "one", "en")
        raise AssertionError("nothing translated must raise")
    except transform.EngineError:
        pass


def test_a_dead_engine_is_not_asked_again(spark, folder):
    """A fatal cause stops the whole engine: one probe, or one wave, however many tasks there are."""
    import glob
    import uuid

    def counted(name, dies):
        def call(texts):
            open(f"{folder}/{name}-{uuid.uuid4().hex}", "w").close()
            if any(dies(t) for t in texts):
                raise transform.EngineError("auth", "401")
            return [t.upper() for t in texts]
        return call

    texts = transform.distinct_texts(spark.createDataFrame([(f"text {i:04d}",) for i in range(640)], "text string").repartition(16))
    probe = min((r.text_hash, r.text) for r in texts.collect())[1]
    chain = [transform.Engine("dead", counted("dead", lambda t: True)),
             transform.Engine("dying", counted("dying", lambda t: t != probe)), transform.Engine("fine", counted("fine", lambda t: False), 8)]
    results = transform.translate_texts(texts, chain, "dead", "en").collect()
    assert {r.text: r.value for r in results} == {f"text {i:04d}": f"TEXT {i:04d}" for i in range(640)}
    assert {r.text: r.engine for r in results}[probe] == "dying" and {r.engine for r in results} == {"dying", "fine"}
    assert len(glob.glob(f"{folder}/dead-*")) == 1
    # the probe, then at most one call for each task of the first wave
    assert 2 <= len(glob.glob(f"{folder}/dying-*")) <= 1 + 640 * 4 // 64
    try:
        transform.translate_texts(texts, chain[:1], "dead", "en", fallback=False)
        raise AssertionError("nothing translated must raise")
    except transform.EngineError:
        pass


def test_failure_kinds(spark):
    cases = [(402, "", "quota"), (400, '{"error":{"message":"maximum context length is 8k"}}', "context"),
             (404, '{"error":"model x not found"}', "model"), (401, "", "auth"), (403, "<html>", "auth"),
             (429, "slow down", "rate"), (404, "<html>nope", "address"), (503, "", "server"), (418, "tea", "rejected"), (0, "", "other")]
    df = spark.createDataFrame(cases, "status int, body string, want string")
    for r in df.withColumn("got", payloads.failure_kind("status", "body")).collect():
        assert r.got == r.want, r


def test_reply_parsers(spark):
    df = spark.createDataFrame([(1, "Sure:\n<<2>> two\nlines\n<<1>>one <<7>> x"), (2, "nothing")], "i int, answer string")
    got = {r.i: r.b for r in df.select("i", payloads.numbered_blocks("answer", 3).alias("b")).collect()}
    assert got == {1: ["one", "two\nlines", ""], 2: None}
    bad = spark.createDataFrame([("a", "no json"), ("b", "[broken"), ("c", '[{"claim": 3}]')], "item_key string, answer string")
    assert payloads.claims(bad).count() == 0


def test_snapshots(spark, folder):
    import os
    os.makedirs(f"{folder}/lib1")
    with open(f"{folder}/lib1/reading.json", "w") as f:
        f.write('{"K1": {"pages": {"0": {"t": 1.5, "a": 0}, "3": {"t": 2, "a": 0}}, "total": 3.5, "first": 1000, "last": 2000, "numPages": 9}}')
    reading = snapshots.load(spark, f"{folder}/lib1/reading.json", "reading")
    row = reading.collect()[0]
    assert (row.library_id, row.attachment_key, row.deciseconds, row.num_pages) == ("lib1", "K1", 35, 9)
    assert sorted((r.page, r.deciseconds) for r in snapshots.page_heat(reading).collect()) == [(0, 15), (3, 20)]


def _page(columns, heights=None):
    runs, n = [], 0
    for x0, texts in columns:
        for row, text in enumerate(texts):
            runs.append(("d", 0, 612.0, 792.0, n, text, 1.0, 0.0, float(x0), 700.0 - 12 * row, 200.0, 10.0))
            n += 1
    return runs


RUNS = ("doc_id string, page int, page_width double, page_height double, run_no int, str string, a double, b double, "
        "x double, y double, width double, height double")


def test_columns_do_not_weld(spark):
    left = [f"left column line number {i} goes on and" for i in range(25)]
    right = [f"right column line number {i} goes on and" for i in range(25)]
    df = spark.createDataFrame(_page([(60, left), (340, right)]), RUNS)
    rows = layout.baselines(layout.ingest_runs(df))
    assert len(layout.gutters(rows).collect()[0].gutters) == 1
    lines = layout.lines(rows).collect()
    assert len(lines) == 50 and {r.column for r in lines} == {0, 1}
    paras = layout.reading_order(layout.paragraphs(layout.lines(rows))).orderBy("position").collect()
    assert [p.text.split()[0] for p in paras] == ["left", "right"] and [p.lines for p in paras] == [25, 25]


def test_answers_go_back_in_parts_of_whole_calls():
    import pandas as pd
    frames = [pd.DataFrame({"text": range(600)}), pd.DataFrame({"text": range(5)})]
    assert [len(p) for p in transform._parts(iter(frames), 100)] == [200, 200, 200, 5]
    assert [len(p) for p in transform._parts(iter(frames), 1000)] == [600, 5]


def test_postings_are_dealt_out_by_their_pairs(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, i % 3, f"alpha beta w{i % 7}") for i in range(300)], "chunk_id int, item_key int, text string")
    queries = spark.createDataFrame([(i, f"alpha w{i}") for i in range(5)], "query_id int, query string")
    plain = sorted(map(tuple, search.evidence(queries, chunks).collect()))
    monkeypatch.setattr(search, "PAIRS_PER_TASK", 10)
    assert search._tasks(queries, chunks) == 150
    plan = search.lexical_scores(queries, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "150), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, search.evidence(queries, chunks).collect())) == plain and len(plain) > 5


def test_marker_alone_on_its_line_drops(spark):
    run = [("d", 0, 612.0, 792.0, n, text, 1.0, 0.0, x, y, 20.0, height) for n, (text, x, y, height) in enumerate(
        [("body", 60.0, 700.0, 10.0), ("of", 83.0, 700.0, 10.0), ("2", 103.2, 703.0, 6.0), ("*", 300.0, 700.0, 6.0), ("more", 60.0, 680.0, 10.0)])]
    runs = layout.ingest_runs(spark.createDataFrame(run, RUNS))
    found = layout.run_lines(runs).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.x, r.width, r.cells) for r in found] == [(1, "body of", 60.0, 63.2, 1), (2, "more", 60.0, 20.0, 1)]
    assert layout.lines(layout.baselines(runs)).orderBy("line_no").collect() == found


def test_runs_are_dealt_to_their_pages_before_they_are_gathered(spark):
    runs = layout.ingest_runs(spark.createDataFrame(_page([(60, ["one", "two"])]), RUNS))
    plan = layout.run_lines(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("ObjectHashAggregate") < plan.index("Exchange")


def test_rotated_and_blank_runs_drop(spark):
    rows = [("d", 0, 612.0, 792.0, i, s, 1.0, b, 10.0, 10.0, w, 0.0) for i, (s, b, w) in
            enumerate([("ok", 0.0, -5.0), ("tilt", 0.5, 5.0), (" ", 0.0, 5.0)])]
    got = layout.ingest_runs(spark.createDataFrame(rows, RUNS)).collect()
    assert [(r.str, r.x, r.width, r.height) for r in got] == [("ok", 5.0, 5.0, 10.0)]


def test_fragment_units_cap_at_three(spark):
    texts = ["this fragment is long enough to go on into the next and"] + ["and this one runs on"] * 4
    rows = [("d", 0, i + 1, "body", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, page int, position int, kind string, text string")
    units = layout.fragment_units(df).orderBy("position").collect()
    sizes = {}
    for u in units:
        sizes[u.unit_id] = sizes.get(u.unit_id, 0) + 1
    assert sorted(sizes.values()) == [1, 1, 3]


def test_alerts_after_a_baseline(spark, folder):
    schema = "watch_id string, finding_id string, seen_at timestamp"
    for i, ids in enumerate((["a", "b"], ["b", "c", "c"])):
        rows = [("w", f, dt.datetime(2024, 1, 1 + i)) for f in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        state.writer(stream, jobs.alert_batches(f"{folder}/out", f"{folder}/state"), f"{folder}/c").start().awaitTermination()
    assert [r.finding_id for r in spark.read.parquet(f"{folder}/out").collect()] == ["c"]


def test_contains_join_with_one_pattern_over_many_texts(spark):
    rows = [(i, f" the and of {i % 7} zq{i % 3}x the and of") for i in range(300)]
    texts = spark.createDataFrame(rows + rows[:5] + [(900, None), (901, "")], "i int, t string")
    patterns = spark.createDataFrame([(1, " the and of 3 zq1x"), (1, " the and of 3 zq1x"), (2, "nowhere at all")], "j int, p string")
    got = sorted((r.i, r.j) for r in contains_join(texts, "t", patterns, "p").collect())
    want = sorted((i, j) for i, t in rows + rows[:5] for j, p in ((1, " the and of 3 zq1x"),) * 2 if p in t)
    assert got == want


def test_skew_join_of_equal_rows_and_map_columns(spark):
    from libsight.functions.ordered import skew_join
    big = spark.createDataFrame([("a", {"x": 1})] * 40 + [("b", {"y": 2})] * 2, "k string, m map<string,int>")
    small = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    got = skew_join(big, small, ["k"], hot_rows=10, splits=4).groupBy("k", "v").count().collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 40), ("b", 2, 2)]


def test_every_prompt_of_a_kind_runs(spark):
    from libsight.operators import prompts
    contexts = spark.createDataFrame([("page", "p one"), ("page", None), ("abstract", "a"), ("unknown", "u")], "context_kind string, context string")
    custom = spark.createDataFrame([("tag-suggest", "abstract", "Tags: {context}")], "prompt_id string, context_kind string, body string")
    done = prompts.run_each(contexts, prompts.table(spark, custom), lambda texts: [t.upper() for t in texts], "m").collect()
    assert sorted((r.prompt_id, r.answer.split("\n")[-1], r.model) for r in done) == [
        ("page-figure", "P ONE", "m"), ("page-summary", "P ONE", "m"), ("tag-suggest", "TAGS: A", "m")]


def test_rank_payloads_are_read_once(spark):
    payload = ('{"data":{"officialRank":{"all":{"a":"1","b":"2"}},"customRank":{"rankInfo":[{"abbName":"b","uuid":"u","rank":"x"},'
               '{"abbName":"b","uuid":"v","rank":"y"},{"abbName":"c","uuid":"","rank":"z"}]}}}')
    df = payloads.rank_records(spark.createDataFrame([(1, payload), (2, "{"), (3, None)], "venue_key int, payload string"))
    assert [(r[0], dict(r[1])) for r in df.collect()] == [(1, {"a": "1", "b": "y"})]
    shown = df.select("venue_key", F.explode("record"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("from_json") == 1


def test_quotes_are_not_broadcast(spark):
    pages = spark.createDataFrame([(1, 0, "One line of words.")], "doc_id bigint, page int, text string")
    quotes = spark.createDataFrame([(1, 1, "line of words")], "doc_id bigint, page int, quote string")
    placed = passages.anchor(quotes, pages)
    assert "SortMergeJoin" in placed._jdf.queryExecution().executedPlan().toString()
    assert [(r["kind"], r["offset"]) for r in placed.collect()] == [("highlight", 4)]


def test_gutters_of_gathered_pages(spark):
    runs = spark.range(0, 640).select(
        (F.col("id") % 1).cast("int").alias("doc_id"), (F.col("id") % 2).cast("int").alias("page"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
        F.col("id").alias("run_no"), F.lit("w").alias("str"), (50 + F.floor(F.col("id") / 2) % 2 * 275).cast("double").alias("x"),
        (720 - F.floor(F.col("id") / 4) % 50 * 13).cast("double").alias("y"), F.lit(200.0).alias("width"), F.lit(10.0).alias("height"))
    got = layout.page_gutters(runs)
    assert sorted(got.collect()) == sorted(layout.gutters(layout.baselines(runs)).collect())
    assert all(len(r["gutters"]) == 1 for r in got.collect())
    assert layout.page_gutters(runs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_quoted_runs_are_found_on_the_gathered_page(spark):
    texts = ["Alpha", " b  c ", "\0x-Y", "", "Omega\n", "İz", None]
    keyed = spark.createDataFrame([(texts,)], "t array<string>").select(
        passages._run_keys(F.col("t")).alias("k"), F.transform("t", keys.quote_key).alias("want")).first()
    assert keyed["k"] == keyed["want"]
    runs = spark.createDataFrame([(1, 0, n, w, 10.0 * n, 100.0 - 20 * (n // 3), 9.0, 8.0) for n, w in enumerate(
        "one two three four five six".split())], "doc_id int, page int, run_no int, str string, x double, y double, width double, height double")
    quotes = spark.createDataFrame([(7, 1, 1, "three, four"), (8, 1, 1, "not there"), (9, 2, 1, "one two")],
                                   "quote_id int, doc_id int, page int, quote string")
    found = passages.quote_rectangles(quotes, runs)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["quote_id"], r["line_y"], r["x0"], r["x1"]) for r in found.collect()) == [(7, 80, 30.0, 39.0), (7, 100, 20.0, 29.0)]


def test_queries_over_texts_without_characters_equal_their_sql(spark, folder):
    import os

    import duckdb

    from libsight.plans import ORACLES, QUERIES

    source, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in os.listdir(source):
        if name != "documents.parquet":
            os.symlink(f"{source}/{name}", f"{folder}/{name}")
    con.execute(f"""COPY (SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'A page' || chr(12) || text ELSE text END AS text)
        FROM '{source}/documents.parquet') TO '{folder}/documents.parquet'""")
    for table in ("documents", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name in ("attachment_listing", "page_split", "quote_anchors", "annotation_sort_keys"):
        want = con.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        got = QUERIES[name](spark, folder).select(*columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())), name


def test_pages_landed_whole_give_the_lines_and_paragraphs_of_their_runs(spark):
    left = [f"left column line number {i} goes on and" for i in range(25)] + ["© 2020", "Figure 1. end"]
    right = [f"right column line number {i} goes on-" for i in range(25)]
    rows = _page([(60, left), (340, right)]) + [("d", 1, 612.0, 792.0, 0, " ", 1.0, 0.0, 9.0, 9.0, 5.0, 9.0), ("d", 2, 612.0, 792.0, 0, "tilt", 1.0, 0.9, 9.0, 9.0, 5.0, 9.0),
                                                ("d", 3, 612.0, 792.0, 0, "ﬁrst", 1.0, 0.0, 90.0, 700.0, -30.0, None)]
    runs = spark.createDataFrame(rows, RUNS)
    landed = runs.groupBy("doc_id", "page", "page_width", "page_height").agg(F.collect_list(F.struct(
        "run_no", "str", "a", "b", "x", "y", "width", "height")).alias("runs")).localCheckpoint()
    lines = layout.page_lines(landed)
    assert sorted(lines.collect()) == sorted(layout.run_lines(layout.ingest_runs(runs)).collect()) and lines.count() == 53
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    paras = layout.reading_order(layout.page_paragraphs(landed))
    assert sorted(paras.collect()) == sorted(layout.reading_order(layout.paragraphs(lines)).collect()) and paras.count() > 3
    assert paras._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1
    whole = layout.document_paragraphs(landed).select("page", "position", "text")
    assert sorted(whole.collect()) == sorted(layout.document_paragraphs(runs).select("page", "position", "text").collect())


def test_references_start_at_the_first_heading_however_many_documents_have_one(spark, monkeypatch):
    rows = [(d, p, n, "References" if d % 2 and (p, n) in ((1, 2), (3, 1)) else None if n == 3 else "text") for d in range(6) for p in range(40) for n in (1, 2, 3)]
    paras = spark.createDataFrame(rows, "doc_id int, page int, position int, text string")
    want = sorted((d, p, n, bool(d % 2) and (p, n) >= (1, 2)) for d, p, n, _ in rows)
    for most in (layout.HEADINGS, 0):
        monkeypatch.setattr(layout, "HEADINGS", most)
        got = layout.reference_section(paras)
        assert sorted((r.doc_id, r.page, r.position, r.in_references) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert ("BroadcastHashJoin" in plan and "hashpartitioning" not in plan) == (most > 0)


def test_texts_are_shuffled_once_to_their_units(spark):
    first = "this fragment is long enough to go on into the next and"
    texts = [first, "and this one runs on", "and so does this", "and this is one more", "The end.", first, "and ends."]
    rows = [("d", 30 + i // 2, i % 2 + 1, "body", t) for i, t in enumerate(texts)]
    paras = spark.createDataFrame(rows, "doc_id string, page int, position int, kind string, text string").localCheckpoint()
    found = layout.fragment_units(paras)
    got = sorted((r.page, r.position, r.unit_id, r.part, r.parts) for r in found.collect())
    assert [g[4] for g in got] == [3, 3, 3, 1, 1, 2, 2] and len({g[2] for g in got}) == 4
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n") if "Scan ExistingRDD" in line and "text" in line]
    assert len(moved) == 1
    units = sorted((tuple(f["text"] for f in r.fragments)) for r in layout.whole_units(found).collect())
    assert units == sorted([tuple(texts[:3]), (texts[3],), (texts[4],), tuple(texts[5:])])
    engine = transform.Engine("loud", lambda texts: [t.upper() for t in texts])
    texted = layout.whole_units(found).withColumn("text", F.array_join("fragments.text", " "))
    back = layout.back_to_fragments(transform.translate(texted, [engine], "loud", "en"))
    assert sorted((r.page, r.position, r.text) for r in back.collect()) == [(r[1], r[2], r[4]) for r in rows]
    assert "".join(r.translated for r in back.orderBy("page", "position").collect()).replace(" ", "") == "".join(texts).replace(" ", "").upper()
