"""Vector search over stored cells against the exact scan."""

import numpy as np
from pyspark.sql import functions as F

from libsight.operators import cells, search


def clustered(rng, n, centres=12, width=16):
    base = rng.normal(size=(centres, width))
    return [(i, i % 9, (base[i % centres] + 0.15 * rng.normal(size=width)).tolist()) for i in range(n)]


def key(df):
    return sorted((r["query_id"], r["position"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def test_cells_equal_the_exact_scan_and_skip_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 3000)
    rows += [(10_000 + i, i, v) for i, v in enumerate((
        [0.0] * 16, None, [], [1.0, 2.0], rows[5][2], rows[5][2], rows[5][2], [1e200] * 16))]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, item_key bigint, vector array<double>").repartition(5)
    queries = [(q, rows[q * 31][2]) for q in range(20)] + [(20, [1.0, 0.5]), (21, [0.0] * 16), (22, rng.normal(size=16).tolist())]
    asked = spark.createDataFrame(queries, "query_id bigint, qv array<double>").repartition(3)
    monkeypatch.setattr(cells, "BLOCK", 32)
    path = str(tmp_path)
    cells.build(chunks, path)
    for size in (1024, 7):  # one block of queries and several
        monkeypatch.setattr(search, "QUERY_BLOCK", size)
        # queries one by one in the scan, so that vectors of another length stay apart
        want = [r for q in queries for r in key(search.vector_search(
            chunks.where("size(vector) > 0"), spark.createDataFrame([q], "query_id bigint, qv array<double>")))] if size == 7 else None
        got = key(cells.search_cells(spark, path, asked))
        assert want is None or got == sorted(want)

    blocks = spark.read.parquet(f"{path}/blocks")
    centroids = np.array([r["vector"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    near = spark.createDataFrame(queries[:10], "query_id bigint, qv array<double>")
    found = cells.survivors(blocks.coalesce(1), centroids, near, 3, 3).agg(F.max("scanned"), F.count("*")).first()
    assert found[0] < 0.35 * 10 * blocks.count()  # most (query, block) pairs are never read
    assert found[1] < 0.05 * 10 * 3000             # and few rows need their exact vector


def test_bounds_hold_for_every_vector(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = clustered(rng, 400, centres=5)
    cells.build(spark.createDataFrame(rows, "chunk_id bigint, item_key bigint, vector array<double>"), str(tmp_path))
    blocks = spark.read.parquet(f"{tmp_path}/blocks").collect()
    centroids = np.array([r["vector"] for r in spark.read.parquet(f"{tmp_path}/centroids").orderBy("cell").collect()])
    queries = rng.normal(size=(30, 16))
    asked = cells._Asked(list(enumerate(queries)), centroids)
    assert sum(len(b["chunk_ids"]) for b in blocks) == 400
    for b in blocks:
        exact = search._cosines(np.array(b["exact"]), queries)
        assert (exact <= asked.bounds(b["cell"], b["radius"])[None, :]).all()
        coded = np.frombuffer(b["codes"], np.int8).reshape(len(exact), -1) * np.array(b["scales"])[:, None] + centroids[b["cell"]]
        off = np.abs(coded @ asked.unit.T - exact)
        assert (off <= np.array(b["errors"])[:, None]).all()


def test_cells_of_an_empty_table(spark, tmp_path):
    cells.build(spark.createDataFrame([], "chunk_id bigint, item_key bigint, vector array<double>"), str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, qv array<double>")
    assert cells.search_cells(spark, str(tmp_path), asked).count() == 0
