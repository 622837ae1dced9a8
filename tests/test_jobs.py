"""Streaming jobs, the watch registry, paired texts and claim tables."""

import datetime as dt

from pyspark.sql import functions as F

from libsight.operators import claims, transform, watch
from libsight.sources import digests
from libsight.streaming import jobs, state


def _parts(spark, folder, schema, *parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_enrolment_takes_each_annotation_once(spark, folder):
    schema = "annotation_key bigint, item_key bigint, text string, comment string"
    long = "a passage that is long enough"
    stream = _parts(spark, folder, schema, [(1, 7, long, ""), (2, 7, "short", "")],
                    [(1, 7, long, ""), (3, 8, "", long), (3, 8, "", long)])
    run = jobs.enrol_batches(f"{folder}/out", f"{folder}/state", "2024-01-01")
    state.writer(stream, run, f"{folder}/c").start().awaitTermination()
    cards = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(c.card_key for c in cards) == [1, 3]
    assert {c.due for c in cards} == {dt.date(2024, 1, 2)}


def test_new_items_with_an_abstract_are_translated(spark, folder):
    schema = "item_key bigint, title string, abstract string"
    stream = _parts(spark, folder, schema, [(1, "one", "<p>ab</p>"), (2, "two", " ")])
    engine = transform.Engine("up", lambda texts: [t.upper() for t in texts])
    state.writer(stream, jobs.translate_batches(f"{folder}/out", [engine], "up", "en"),
                 f"{folder}/c").start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert [(r.item_key, r.title_translated, r.abstract_translated) for r in rows] == [(1, "ONE", "AB")]


def test_watch_registry(spark):
    watches = spark.createDataFrame([("w1", "citations", "old", 1, None)],
                                    "watch_id string, kind string, label string, item_key bigint, query string")
    items = spark.createDataFrame([(1, "A 2020", "t"), (2, "B 2021", "u" * 80)], "item_key bigint, citation string, title string")
    both = watch.add_item_watches(watches, items)
    assert sorted(r.watch_id for r in both.collect()) == ["w1", "w2"]
    queries = spark.createDataFrame([(" cranes ",), ("  ",)], "query string")
    three = watch.add_query_watches(both, queries)
    assert sorted(r.label for r in three.collect() if r.query) == ["cranes"]
    assert watch.remove_watches(three, three.where("watch_id = 'w1'")).count() == 2


def test_pairs_align_only_when_both_sides_split_alike(spark):
    df = spark.createDataFrame([("One here. Two here.", "Eins hier. Zwei hier."), ("One here. Two here.", "Alles in einem.")],
                               "text string, translated string")
    sizes = [len(r.p) for r in df.select(transform.align_pairs("text", "translated").alias("p")).collect()]
    assert sizes == [2, 1]


def test_claim_matrix_fills_missing_pairs(spark):
    cells = spark.createDataFrame([("c1", "p1", "supports", "a|b"), ("c1", "p2", "contradicts", ""), ("c2", "p1", "unclear", "")],
                                  "claim_id string, item_key string, verdict string, evidence string")
    wide = {r.claim_id: (r.p1, r.p2) for r in claims.matrix(cells, ["p1", "p2"]).collect()}
    assert wide == {"c1": ("✔ ab", "✘"), "c2": ("~", "·")}
    assert [(r.claim_id, r.item_key) for r in claims.conflicts(cells).collect()] == [("c1", "p2")]
    named = cells.select("claim_id", F.concat(F.lit("says |"), "claim_id").alias("claim")).distinct()
    lines = digests.claim_matrix(claims.matrix(cells, ["p1", "p2"]), named, ["p1", "p2"]).orderBy("sort").collect()
    assert [r.line for r in lines] == ["| Claim | p1 | p2 |", "| --- | --- | --- |", "| says c1 | ✔ ab | ✘ |", "| says c2 | ~ | · |"]


def test_first_run_without_findings_is_the_baseline(spark, folder):
    day = dt.datetime(2024, 1, 1)
    stream = _parts(spark, folder, "watch_id string, finding_id string, seen_at timestamp",
                    [("a", None, day), ("b", "p1", day)], [("a", "p2", day), ("b", "p1", day)],
                    [("a", "p2", day), ("b", "p3", day)])
    state.writer(stream, jobs.alert_batches(f"{folder}/out", f"{folder}/state"), f"{folder}/c").start().awaitTermination()
    got = sorted((r.watch_id, r.finding_id) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("a", "p2"), ("b", "p3")]
    found = spark.createDataFrame([("a", "p2", 2), ("b", "p1", 1)], "watch_id string, finding_id string, run_day int")
    runs = spark.createDataFrame([("a", 1), ("b", 1)], "watch_id string, run_day int")
    assert [r.finding_id for r in watch.replay(found, runs).collect()] == ["p2"]


def test_new_query_goes_on_from_old_state(spark, folder):
    schema = "annotation_key bigint, item_key bigint, text string, comment string"
    long = "a passage that is long enough"
    for n, rows in enumerate(([(1, 7, long, "")], [(1, 7, long, ""), (2, 7, long, "")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in{n}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in{n}")
        run = jobs.enrol_batches(f"{folder}/out", f"{folder}/state")
        state.writer(stream, run, f"{folder}/c{n}").start().awaitTermination()
    cards = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(c.card_key for c in cards) == [1, 2]


def test_translations_are_read_from_and_written_to_the_cache(spark, folder):
    asked = spark.sparkContext.accumulator(0)

    def shout(texts):
        asked.add(len(texts))
        return [t.upper() for t in texts]

    schema = "item_key bigint, title string, abstract string"
    stream = _parts(spark, folder, schema, [(1, "one", "ab")], [(2, "one", "cd")])
    fn = jobs.translate_batches(f"{folder}/out", [transform.Engine("up", shout)], "up", "en", cache=f"{folder}/cache")
    state.writer(stream, fn, f"{folder}/c").start().awaitTermination()
    rows = sorted((r.item_key, r.title_translated, r.abstract_translated) for r in spark.read.parquet(f"{folder}/out").collect())
    assert rows == [(1, "ONE", "AB"), (2, "ONE", "CD")]
    assert asked.value == 3


def test_surplus_replies_fail_their_batch(spark):
    texts = transform.distinct_texts(spark.createDataFrame([("a",), ("b",)], "text string"))
    more = transform.Engine("more", lambda t: [*t, "extra"], batch=2)
    plain = transform.Engine("plain", lambda t: [x * 2 for x in t], batch=2)
    got = {r.text: (r.value, r.engine) for r in transform.translate_texts(texts, [more, plain], "more", "en").collect()}
    assert got == {"a": ("aa", "plain"), "b": ("bb", "plain")}


def test_gap_ties_and_citing_titles(spark):
    from libsight.operators import refs
    rows = [(1, "10.1/x", "T", 5), (1, "10.1/x", "T", 3), (2, "10.1/x", "T", 9)]
    table = spark.createDataFrame(rows, "citing_key bigint, doi string, title string, citations int")
    owned = spark.createDataFrame([], "item_key bigint, doi string, title string")
    got = refs.gaps(table, owned, 1).first()
    assert (got.hits, got.citations) == (3, 3)
    once = refs.gaps(table, owned, 1, distinct_citing=True).first()
    assert (once.hits, once.citations) == (2, 3)
    cited = refs.cited_by(table.dropDuplicates(["citing_key"]), spark.createDataFrame([("10.1/x",)], "gap_key string"))
    items = spark.createDataFrame([(1, "A" * 80), (2, "B")], "item_key bigint, title string")
    assert refs.cited_by_titles(cited, items).first().cited_by == ["A" * 60, "B"]


def _arrive(spark, rows, schema, folder, streamed, mode="append"):
    """One more part of a stream, and what the query has put out after it."""
    from libsight.streaming import keyed
    keyed.use_state_store(spark)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = streamed(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    (out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode(mode)
     .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_keyed_alerts_forget_beyond_their_memory(spark, folder):
    """Baselines, an empty first run, ids forgotten and shown again, against a plain fold."""
    from libsight.streaming import keyed
    schema = "watch_id string, finding_id string, seen_at timestamp"
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    runs = [[("w", "a", at(1)), ("w", "b", at(2)), ("w", "c", at(0)), ("v", None, at(0))],
            [("w", "c", at(5)), ("w", "a", at(5)), ("w", "d", at(5)), ("v", "x", at(5)), ("v", "x", at(6))],
            [("w", "a", at(9)), ("w", "b", at(9)), ("v", "x", at(9)), ("u", "a", at(9))]]
    seen, ran, want = {}, set(), []
    for run in runs:
        for watch in sorted({r[0] for r in run}):
            known = seen.setdefault(watch, {})
            fresh = {}
            for w, f, t in run:
                if w == watch and f is not None and f not in known:
                    fresh[f] = max(t, fresh.get(f, t))
            want += [(watch, f) for f in fresh] if watch in ran else []
            ran.add(watch)
            both = sorted({**known, **fresh}.items(), key=lambda x: (-x[1].timestamp(), x[0]))
            seen[watch] = dict(both[:2])
    got = []
    for run in runs:
        got = _arrive(spark, run, schema, folder, lambda rows: keyed.alerts(rows, memory=2))
    assert sorted((r.watch_id, r.finding_id) for r in got) == sorted(want)
    assert ("w", "b") not in want[:1] and ("w", "c") in want


def test_keyed_enrolment_takes_an_annotation_once(spark, folder):
    from libsight.streaming import keyed
    schema = "annotation_key bigint, item_key bigint, text string, comment string"
    long = "x" * 30
    deck = spark.createDataFrame([(9,)], "card_key bigint")
    for rows in ([(1, 1, long, None), (1, 1, long, None), (2, 1, "short", None)],
                 [(1, 1, long, None), (3, 1, "", long), (9, 1, long, None)]):
        got = _arrive(spark, rows, schema, folder, lambda s: keyed.enrolled(s, deck, "2024-01-30"))
    assert sorted((r.card_key, str(r.due)) for r in got) == [(1, "2024-01-31"), (3, "2024-01-31")]


def test_a_reader_idle_for_long_is_forgotten(spark, folder):
    """The clock's state goes after the idle time; days close with the watermark, in one query."""
    from libsight.streaming import keyed
    schema = ("tick_id bigint, reader_id bigint, item_key bigint, attachment_key bigint, page int, focused boolean, "
              "num_pages int, ts timestamp")
    tick = lambda i, reader, day, sec: (i, reader, 1, 1, sec, True, 9, dt.datetime(2024, 1, day, 10, 0, sec))
    parts = ([tick(0, 1, 1, 0), tick(1, 1, 1, 10), tick(2, 1, 1, 15)], [tick(3, 2, 5, 0), tick(4, 2, 5, 4)],
             [tick(5, 1, 5, 8), tick(6, 2, 5, 9)], [tick(7, 3, 9, 0)])
    for rows in parts:
        got = _arrive(spark, rows, schema, folder, lambda s: keyed.days(keyed.credits(s, 20, idle_hours=1)))
    assert sorted((str(r.day), r.seconds, r.pages) for r in got) == [("2024-01-01", 15, 2), ("2024-01-05", 9, 2)]


def test_claim_lines_in_column_blocks(spark):
    """Any width of block gives the same lines; absent cells are filled, keys keep their own order."""
    cells = spark.createDataFrame([("c1", 10, "supports", "x|y"), ("c1", 2, "absent", ""), ("c2", 30, "contradicts", "")],
                                  "claim_id string, item_key int, verdict string, evidence string")
    named = spark.createDataFrame([("c1", "one | claim"), ("c2", "two"), ("c3", "three")], "claim_id string, claim string")
    papers = spark.createDataFrame([(2,), (10,), (30,), (10,)], "item_key int")
    want = None
    for columns in (1, 2, 500):
        got = sorted(tuple(r) for r in digests.claim_lines(claims.matrix_lines(cells, named, papers, columns), named).collect())
        assert want is None or got == want
        want = got
    marks = claims.MARKS
    assert want[0] == ("0", "| Claim | 2 | 10 | 30 |") and want[1] == ("1", "| --- | --- | --- | --- |")
    assert want[2][1].endswith(f"| {marks['absent']} | {marks['supports']} xy | {marks['absent']} |")
    assert want[4][1] == "| three | " + " | ".join([marks["absent"]] * 3) + " |"


def test_tick_logs_resume_where_they_stopped(spark, folder):
    """One log a batch; malformed lines drop; a backfill of the folder reads the same rows."""
    from libsight.sources import snapshots
    schema = snapshots.TICKS
    part = lambda n: spark.createDataFrame(
        [(n * 10 + i, 1, 1, 1, i, True, 9, dt.datetime(2024, 1, 1 + n, 10, 0, i, 123456)) for i in range(3)], schema)
    seen = []
    for stop in ((0, 1), (2,)):
        for n in stop:
            snapshots.land_ticks(part(n), f"{folder}/log")
        if 1 in stop:
            with open(f"{folder}/log/x-broken.json", "w") as f:
                f.write('{"tick_id": 7, "rea\n{"tick_id": 8}\n')
        stream = snapshots.ticks(spark, f"{folder}/log", streaming=True, form="json", files_per_batch=1)
        batches = []
        (stream.writeStream.foreachBatch(lambda df, i: batches.append([r.tick_id for r in df.orderBy("tick_id").collect()]))
         .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination())
        seen.append([b for b in batches if b])
    assert seen == [[[0, 1, 2], [10, 11, 12]], [[20, 21, 22]]]
    back = snapshots.ticks(spark, f"{folder}/log", form="json")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for n in range(3) for r in part(n).collect())


def test_every_claim_is_judged_however_many_papers(spark):
    from libsight.plans import ORACLES, QUERIES, ingest
    from libsight.plans.registry import Tables

    # four claims of a passage of 24 words or more
    found = ingest._claims(Tables(spark, "/root/testdata/sf0.001"))
    words = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    assert words.count() > 4
    assert found.count() == words.agg(F.sum(F.least(F.ceil(F.col("n") / 6), F.lit(4)))).first()[0]
    for name in ("claim_verdicts", "claim_conflicts", "claim_matrix"):
        assert "ELSE 5 END" not in ORACLES[name]
    judged = QUERIES["claim_verdicts"](spark, "/root/testdata/sf0.001")
    assert judged.where("claim_id like '%:3'").count() > 0
