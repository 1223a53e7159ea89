import random

import pytest
from pyspark.sql import functions as F

from eventlake.llm import decontaminate as dc
from eventlake.llm import queries


def distance(pattern, text):
    """Least edit distance of the pattern to a substring."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def changed(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "q", text[i] + "z"]) + text[i + 1 :]
    return text


def test_myers():
    rng = random.Random(7)
    for _ in range(400):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        want = distance(pattern, text)
        assert dc.myers(pattern, text, len(pattern))[0] == want
        k = rng.randrange(len(pattern))
        assert dc.myers(pattern, text, k)[0] == min(want, k + 1)


def test_search_against_brute():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(30)] + [(30, "one two one two"), (31, "!!"), (32, "one two one two")]
    normal = [(i, dc.normalize(t)) for i, t in items]
    block = dc.Block([x for x in normal if x[1]], 0.1)
    for _ in range(150):
        text = " ".join(word() for _ in range(rng.randrange(40)))
        for _ in range(rng.randrange(3)):
            text += " " + changed(rng, rng.choice(items)[1], rng.randrange(6)) + " " + word()
        flat = dc.normalize(text)
        want = {i: d for i, t in normal if t and flat and (d := distance(t, flat)) <= int(0.1 * len(t))}
        got = block.search(flat)
        assert {h[0]: h[1] for h in got} == want
        for i, d, a, b in got:
            assert distance(dict(normal)[i], flat[a:b]) == d and 0 <= a <= b <= len(flat)


@pytest.mark.parametrize("chars", [60, 1 << 20])
def test_rows(spark, chars):
    item = "The quick brown fox jumps over the lazy dog, again and again!"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (5, "Something else that is long enough to be cut in pieces")], "item_id long, text string")
    near = "x the quick brown fox jumped over the lazy dog -- again AND again y"
    rows = [(1, near), (1, near), (2, None), (3, ""), (None, item), (4, "word " * 50000 + item), (5, "the quick brown fox"), (6, "clean text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit("x")).withColumn("distance", F.lit(1))
    got = sorted((repr(r.doc_id), r.item_id, r.distance > 0) for r in dc.find_leaks(df, "doc_id", "text", items, "item_id", "text", 0.06, chars).collect())
    assert got == sorted((repr(d), i, d == 1) for d in (1, 1, None, 4) for i in (1, 4))
    kept = dc.drop_leaks(df, "text", items, "item_id", "text", 0.06, chars)
    assert kept.columns == df.columns and sorted(repr(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "6"]
    assert dc.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert dc.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert dc.drop_leaks(df, "text", items.limit(0), "item_id", "text").count() == len(rows)


def test_query(spark, sf_dir):
    items = [(r.item_id, dc.normalize(r.text)) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    texts = {r.doc_id: dc.normalize(r.text) for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op4_decontaminate(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items if x in t}
    assert exact and exact == {k for k, v in got.items() if v == 0}
    # Every text against some items in full, without pieces.
    some = [(i, t) for i, t in items if t][::12]
    near = {(d, i): n for d, text in texts.items() for i, t in some if (n := dc.myers(t, text, int(dc.RATE * len(t)))[0]) <= int(dc.RATE * len(t))}
    assert near == {k: v for k, v in got.items() if k[1] in dict(some)}
    blocks = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(queries.table(spark, sf_dir, "documents"), "doc_id", "text", queries.table(spark, sf_dir, "benchmark"), "item_id", "text", block_chars=9000).collect()}
    assert blocks == got
