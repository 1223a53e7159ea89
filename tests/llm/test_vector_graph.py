import math

import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import queries, vector_graph
from eventlake.llm.components import components


def brute(rows, least):
    """n_links and component of each row by all pairs."""
    def usable(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and a[1] == b[1] and usable(*a[1:]) and usable(*b[1:]) and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(map(repr, out))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 300), (500, 100)] + [(1000, 1000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200, 500)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("PART_ROWS", 30)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 12))
    rows = [(i, i % 2, base[i].tolist()) for i in range(120)]
    for i in range(160):
        rows.append((200 + i, i % 2, (base[(i % 2) + 2 * rng.integers(0, 8)] + rng.normal(size=12) * rng.choice([0.02, 0.15, 0.3])).tolist()))
    rows += [(400 + i, 0, rows[0][2]) for i in range(5)] + [(0, 0, rows[0][2]), (500, 1, rows[0][2]), (501, None, rows[0][2]), (502, 0, None), (503, 0, []), (504, 0, [0.0] * 12)]
    rows += [(505, 0, [math.nan] * 12), (506, 0, [None, *rows[0][2][1:]]), (507, 0, rows[0][2][:5]), (None, 0, rows[2][2]), (508, 0, [x * 1e300 for x in rows[4][2]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = vector_graph.near_duplicate_vectors(df, "vec_id", "embedding", "label", 0.93).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got) == brute([r[:3] if r[0] != 508 else (508, 0, rows[4][2]) for r in rows], 0.93)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert vector_graph.near_duplicate_vectors(df.limit(0), "vec_id", "embedding", "label").count() == 0
    # A poor search is noticed, and the full comparison by blocks gives the same rows.
    monkeypatch.setattr(vector_graph, "EFFORTS", ())
    full = vector_graph.near_duplicate_vectors(df, "vec_id", "embedding", "label", 0.93).collect()
    assert sorted(map(tuple, full), key=repr) == sorted(map(tuple, got), key=repr)


def planted(n, labels, dim=64, seed=4):
    """Random vectors with groups of near copies of many sizes, and one dense group that holds a fifth of all rows."""
    rng = np.random.default_rng(seed)
    rows, vec_id = [], 0
    while len(rows) < n:
        centre, label = rng.normal(size=dim), int(rng.integers(labels))
        size = n // 5 if not rows else int(rng.choice([1, 1, 1, 2, 3, 10, 40]))
        for _ in range(size):
            rows.append((vec_id, label, (centre + rng.normal(size=dim) * rng.choice([0.05, 0.15, 0.22])).astype(np.float32).tolist()))
            vec_id += 1
    return rows


def true_links(rows, least=0.93):
    ids, labels, unit = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), vector_graph.unit_rows(np.array([r[2] for r in rows], float))
    out = {}
    for label in np.unique(labels):
        of = np.flatnonzero(labels == label)
        out |= dict(zip(ids[of].tolist(), ((unit[of] @ unit[of].T >= least).sum(axis=1) - 1).tolist()))
    return out


def test_recall_with_links_over_shards(spark, monkeypatch):
    """Several shards and blocks a label and a dense group: nearly all links are found, none falsely, and the figures are in the result."""
    for name, value in (("SHARD_ROWS", 256), ("PART_ROWS", 300)):
        monkeypatch.setattr(vector_graph, name, value)
    rows = planted(6000, 3)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(df, "vec_id", "embedding", "label", 0.93).collect()}
    want = true_links(rows)
    assert all(got[i].n_links <= n for i, n in want.items())
    recall = sum(got[i].n_links for i in want) / sum(want.values())
    asked = [i for i in want if i % 20 == 0]
    by_twenty = sum(got[i].n_links for i in asked) / sum(want[i] for i in asked)
    one = next(iter(got.values()))
    print(f"recall {recall:.5f}, of ids divisible by 20 {by_twenty:.5f}, audit {one.audit_found} of {one.audit_links}, links {sum(want.values())}")
    assert recall >= 0.99 and by_twenty >= 0.99 and one.audit_links > 1000 and one.audit_found >= 0.99 * one.audit_links


def test_a_poor_effort_is_not_returned(spark, monkeypatch):
    """A search that can find hardly anything fails the audit, and the next one runs."""
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 100)
    monkeypatch.setattr(vector_graph, "EFFORTS", (vector_graph.Effort(1, 1, 2, 1),))
    monkeypatch.setattr(vector_graph, "SLACK", -0.05)
    rows = planted(1500, 2, seed=8)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_graph.near_duplicate_vectors(df, "vec_id", "embedding", "label", 0.93).collect()}
    want = true_links(rows)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in queries.table(spark, folder, "embeddings").collect()]
    got = queries.op2_vectors(spark, folder).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(rows, 0.93)


def test_recall_of_rows_by_twenty(spark):
    """Every id divisible by 20 against all rows, over overlapping shards."""
    folder = "/root/testdata/sf0.1"
    rows = queries.table(spark, folder, "embeddings").toPandas()
    got = queries.op2_vectors(spark, folder).toPandas().set_index("vec_id").n_links
    true = found = 0
    for label, part in rows.groupby("label"):
        unit = vector_graph.unit_rows(np.stack(part.embedding).astype(float))
        asked = np.flatnonzero(part.vec_id.to_numpy() % 20 == 0)
        n = (unit[asked] @ unit.T >= 0.93).sum(axis=1) - 1
        true += n.sum()
        found += np.minimum(n, got.loc[part.vec_id.to_numpy()[asked]].to_numpy()).sum()
    assert found >= 0.9 * true
