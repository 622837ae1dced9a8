"""Large JSON files cut at their entries, and every kind of snapshot."""

import base64
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from libsight.sources import jsonmaps, snapshots

NASTY = ['a"b', "c\\", "\\\"", "},{", '","', "[{]}", "é💡", "", " {\"x\": 1} ", "\\\\\"}", "\n\t,"]


def _value(rng, deep=0):
    if deep > 3 or rng.random() < 0.4:
        return rng.choice([1, -2.5, None, True, rng.choice(NASTY) * rng.randint(1, 4)])
    if rng.random() < 0.5:
        return [_value(rng, deep + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(NASTY) + str(i): _value(rng, deep + 1) for i in range(rng.randint(0, 4))}


def _put(folder, library, kind, text):
    os.makedirs(f"{folder}/{library}", exist_ok=True)
    with open(f"{folder}/{library}/{kind}.json", "w") as f:
        f.write(text)


@pytest.mark.parametrize("separator,indent", [("}", None), (",", None), ("]", 2), (",", 1)])
def test_entries_equal_a_whole_parse(spark, folder, separator, indent):
    rng = random.Random(hash((separator, indent)) % 1000)
    want = {}
    for library in ("a", "b", "empty"):
        data = {} if library == "empty" else {f"{rng.choice(NASTY)}{i}": _value(rng) for i in range(150)}
        want[library] = data
        _put(folder, library, "x", json.dumps(data, indent=indent, ensure_ascii=rng.random() < 0.5) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for size in (50, 1 << 20):
            rows = jsonmaps.entries(spark, f"{folder}/*/x.json", separator=separator, size=size).collect()
            for library, data in want.items():
                mine = sorted((r.n, r.entry) for r in rows if r.file.split("/")[-2] == library)
                assert [n for n, _ in mine] == list(range(len(data)))
                assert json.loads("{" + ",".join(e for _, e in mine) + "}") == data
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_cut_off_loses_its_last_entry_only(spark, folder):
    _put(folder, "lib", "ranks", '{"v1": {"a": "1"}, "v2": {"b": "}"}, "v3": {"c": "2"')
    _put(folder, "blank", "ranks", "")
    got = snapshots.load(spark, f"{folder}/*/ranks.json", "ranks").collect()
    assert sorted((r.library_id, r.venue_key, r.record) for r in got) == [("lib", "v1", {"a": "1"}), ("lib", "v2", {"b": "}"})]
    with pytest.raises(ValueError):
        jsonmaps.entries(spark, folder, separator='"')


def test_one_large_file_is_read_by_many_tasks(spark, folder):
    chunks = [{"id": f"{i}:0", "itemID": i, "itemKey": f"K{i % 9}", "attachmentID": i, "title": 'T "q" }', "page": i % 5,
               "text": "word, {x} " * 20, "v": base64.b64encode(bytes([i % 256, 127, 128])).decode(), "s": 0.5} for i in range(4000)]
    _put(folder, "lib", "index", json.dumps({"version": 1, "dims": 3, "model": "m,{1}", "chunks": chunks}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = snapshots.load(spark, f"{folder}/lib/index.json", "index")
        tasks = jsonmaps._blocks(spark, f"{folder}/lib/index.json", "}", 1 << 14, False).rdd.getNumPartitions()
        rows = {r.chunk_id: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 8 and len(rows) == 4000
    r = rows["200:0"]
    assert (r.library_id, r.model, r.dims, r.item_key, r.page, r.codes, r.scale) == ("lib", "m,{1}", 3, "K2", 0, [-56, 127, -128], 0.5)
    assert {r.text for r in rows.values()} == {"word, {x} " * 20}


def test_every_kind(spark, folder):
    _put(folder, "lib", "rhythm", '{"2024-01-02":{"seconds":5,"pages":2,"annotations":1,"items":["A","B"]}}')
    _put(folder, "lib", "review", '{"C":{"key":"C","attachmentID":1,"itemID":2,"due":19000,"step":3,"lapses":0,"reviews":4,'
         '"lastGrade":"good","added":1}}')
    _put(folder, "lib", "references", '{"P":{"at":1000,"refs":[{"title":"T","doi":"10.1/x","year":2020,"authors":"A","citations":7},'
         '{"title":"U"}]},"Q":{"at":2000,"refs":[]}}')
    _put(folder, "lib", "citations", '{"P":{"openalex":"5"}}')
    _put(folder, "lib", "translation-cache", '{"deepl:de:h1":"eins, \\"zwei\\"","deepl:de:h2":"drei"}')

    def load(kind):
        return [tuple(r) for r in snapshots.load(spark, f"{folder}/lib/{kind}.json", kind).collect()]

    assert [(r[0], str(r[1]), *r[2:]) for r in load("rhythm")] == [("lib", "2024-01-02", 5, 2, 1, 2)]
    assert [(r[1], r[2], r[3], str(r[4]), *r[5:]) for r in load("review")] == [("C", 1, 2, "2022-01-08", 3, 0, 4, "good")]
    assert sorted((r[1], r[3], r[4], r[5], r[7]) for r in load("references")) == sorted([("P", "T", "10.1/x", 2020, 7), ("P", "U", None, None, None)], key=str)
    assert load("citations") == [("lib", "P", {"openalex": "5"})]
    assert sorted(load("translation-cache")) == [("lib", "deepl", "de", "h1", 'eins, "zwei"'), ("lib", "deepl", "de", "h2", "drei")]
    with pytest.raises(ValueError):
        snapshots.load(spark, folder, "other")


def test_saved_maps_read_back(spark, folder):
    rows = [(lib, f"{key}{i}", json.dumps({"a": text})) for lib in ("x", "y z") for i, (key, text) in enumerate(zip(NASTY, reversed(NASTY)))]
    df = spark.createDataFrame(rows + [("x", None, "{}"), ("x", "none", None)], "library_id string, k string, v string")
    jsonmaps.save(df.repartition(5), f"{folder}/out")
    got = snapshots.load(spark, f"{folder}/out/*/*", "ranks").collect()
    assert sorted((r.venue_key, r.record["a"]) for r in got if r.library_id == "x") == sorted((k, json.loads(v)["a"]) for lib, k, v in rows if lib == "x")
    assert len(got) == len(rows)
    for name in os.listdir(f"{folder}/out"):
        if name.startswith("library_id="):
            files = [f for f in os.listdir(f"{folder}/out/{name}") if f.startswith("part-")]
            assert len(files) == 1
            json.loads(open(f"{folder}/out/{name}/{files[0]}").read())
