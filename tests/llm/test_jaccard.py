import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import jaccard, queries


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width=3):
    w = words_of(text)
    return frozenset([tuple(w)] if 0 < len(w) < width else (tuple(w[i : i + width]) for i in range(len(w) - width + 1)))


def components_of(rows, width, percent):
    """Set -> some set that stands for its component."""
    sets = dict.fromkeys(s for _, t in rows if (s := shingles(t, width)))
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    where = {}
    for s in sets:
        seen = set()
        for x in s:
            for o in where.setdefault(x, []):
                if o not in seen:
                    seen.add(o)
                    if 100 * len(s & o) >= percent * len(s | o):
                        root[find(s)] = find(o)
            where[x].append(s)
    return {s: find(s) for s in sets}


def brute_kept(rows, width=5, percent=80):
    """Ids (None last) of the rows that stay, one of each component and all without words."""
    of = components_of(rows, width, percent)
    least, out = {}, []
    for d, t in rows:
        s = shingles(t, width)
        if not s:
            out.append(d)
        else:
            least.setdefault(of[s], []).append(d)
    return sorted(repr(d) for d in out + [min(ids, key=lambda d: (d is None, d or 0)) for ids in least.values()])


def brute(rows):
    """(id, size, component) of each row; only sets that share a shingle are compared."""
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t), []).append(d)
    keys = [s for s in sets if s and any(d is not None for d in sets[s])]
    root = {s: s for s in keys}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    where = {}
    for s in keys:
        seen = set()
        for x in s:
            for o in where.setdefault(x, []):
                if o not in seen:
                    seen.add(o)
                    if 100 * len(s & o) >= 90 * len(s | o):
                        root[find(s)] = find(o)
            where[x].append(s)
    least = {}
    for s in keys:
        r = find(s)
        least[r] = min([least.get(r, float("inf"))] + [d for d in sets[s] if d is not None])
    return sorted(repr((d, len(shingles(t)), d if not shingles(t) else least[find(shingles(t))] if shingles(t) in root else None)) for d, t in rows)


def family(rng, base, count, most):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randrange(most)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [w[i], "x"]])
        out.append(" ".join(w))
    return out


def texts():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    out = ["", " \t", "One", "one", "ONE two", "one Two", "é É", "é\xa0é x", "a\x0bb\x0cc", "A B C", "a b c d"]
    out += [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    passage = " ".join(word() for _ in range(60))
    for n in (12, 30, 80, 200):
        out += family(rng, " ".join(word() for _ in range(n)), 30, max(2, n // 12))
    out += [passage + " " + " ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    out += family(rng, " ".join(word() for _ in range(150)), 120, 14)
    return out


MEASURES = [jaccard.Measure(3, 90), jaccard.Measure(5, 80), jaccard.Measure(2, 95)]


@pytest.mark.parametrize("common", [1, 3, 16])
@pytest.mark.parametrize("measure", MEASURES)
def test_cells_hold_every_link(monkeypatch, measure, common):
    """Sets in flights, counted in buckets: every linked pair shares a cell, and sets without partner mostly have none."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    rng, buckets = np.random.default_rng(5), 7
    hashes = lambda n: np.unique(jaccard.mixed(rng.integers(0, 2**63, n).astype(np.uint64)))
    passages = [hashes(30) for _ in range(3)]
    sets = []
    for _ in range(120):
        a = hashes(int(rng.integers(1, 300)))
        if rng.integers(2):
            a = np.union1d(a, passages[int(rng.integers(3))])
        sets.append(a)
        for _ in range(int(rng.choice([0, 0, 1, 2, 9]))):
            most = len(a) * (100 - measure.percent) // 180 + 1
            sets.append(np.union1d(rng.permutation(a)[int(rng.integers(0, most + 1)) :], hashes(int(rng.integers(0, most + 1)))))
    order = rng.permutation(len(sets))
    flights = np.array_split(order, 9)
    entries, answers = [], {f: [] for f in range(9)}
    for f, own in enumerate(flights):
        packs, (owners, numbers) = jaccard.flight([sets[i] for i in own], buckets)
        answers[f].append((owners, numbers, np.full(len(owners), common + 1, np.uint8)))
        entries += [(w, f, np.frombuffer(r, np.uint32), np.frombuffer(o, np.uint16)) for w, r, o in packs]
    for bucket in range(buckets):
        mine = [e for e in entries if e[0] == bucket]
        of, rests, owners = np.repeat([e[1] for e in mine], [len(e[2]) for e in mine]), np.concatenate([e[2] for e in mine]), np.concatenate([e[3] for e in mine])
        at, counts = jaccard.shared(of, rests, owners)
        for f in range(9):
            here = of[at] == f
            answers[f].append((owners[at][here], np.uint64(bucket) + rests[at][here].astype(np.uint64) * np.uint64(buckets), counts[here]))
    cells = {i: set() for i in range(len(sets))}
    for f, own in enumerate(flights):
        owners, numbers, counts = (np.concatenate([x[k] for x in answers[f]]) for k in range(3))
        found, of = jaccard.chosen_cells(measure, np.array([len(sets[i]) for i in own]), owners.astype(np.int64), numbers, counts)
        for cell, i in zip(found.tolist(), of.tolist()):
            cells[int(own[i])].add(cell)
    links, alone = 0, []
    for i, x in enumerate(sets):
        linked = [j for j, y in enumerate(sets) if j != i and measure.linked(len(np.intersect1d(x, y)), len(x), len(y)) and len(np.setxor1d(x, y))]
        links += len(linked)
        assert all(cells[i] & cells[j] for j in linked)
        if not linked:
            alone.append(bool(cells[i]))
    assert links > 150 and np.mean(alone) < 0.6


@pytest.mark.parametrize("measure", MEASURES)
@pytest.mark.parametrize("leaf", [8, 10_000])
def test_region_is_exact(monkeypatch, leaf, measure):
    monkeypatch.setattr(jaccard, "LEAF_ROWS", leaf)
    rng = random.Random(2)
    hashes = jaccard.WordHashes()
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(90)) for _ in range(6)]
    rows = [t for b in base for t in family(rng, b, 60, 12)] + [base[0] + " " + x for x in base]
    sets = {jaccard.set_id(s)[0]: s for s in (jaccard.shingle_set(t, hashes, measure.words) for t in rows)}
    ids = np.array(sorted(sets))
    own, root = jaccard.join_region(ids, [sets[i] for i in ids.tolist()], measure)
    component = dict(zip(ids.tolist(), ids.tolist())) | dict(zip(own.tolist(), root.tolist()))
    want = {i: i for i in ids.tolist()}
    for a in ids.tolist():
        for b in ids.tolist():
            if a < b and measure.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                lo, hi = sorted((want[a], want[b]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    assert component == want


def test_known_components_are_kept():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [7, 8], [20, 21], [7, 8, 9])]
    own, root = jaccard.join_region(np.array([4, 3, 2, 1]), sets, jaccard.Measure(3, 90), np.array([5, -1, 5, -1]))
    assert dict(zip(own.tolist(), root.tolist())) == {4: 2}


def test_stars():
    cell, least, links = jaccard.stars(np.array([5, 9, 5, 5, 9, 7], np.uint64), np.array([3, 2, 1, 3, 2, 8]))
    assert cell.tolist() == [5, 7, 9] and least.tolist() == [1, 8, 2] and links.tolist() == [[3, 1]]


def test_linked_pivots_are_one_hub():
    sets = [np.arange(a, a + 100) for a in (0, 5, 10, 500)]
    found = jaccard.Pivots([7, 4, 9, 2], sets, [None, None, 3, None], jaccard.Measure(3, 90))
    assert found.hubs == [3, 3, 3, 2]
    assert found.place(np.arange(12, 112))[1] == 3 and found.place(np.arange(900, 1000))[1] is None


def test_blocks_of_a_region_that_does_not_shrink(spark, monkeypatch):
    """Every two documents of different hubs (or of none) meet in a block pair, and no pair is over the bound by more than its blocks' spread."""
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", 2000)
    monkeypatch.setattr(jaccard, "REGION_WEIGHT", 2)
    monkeypatch.setattr(jaccard, "BLOCKS", 1)
    monkeypatch.setattr(jaccard, "ROW_WEIGHT", 0)
    rows = [(7, i, 20, None if i % 3 == 0 else i % 3, [i]) for i in range(300)] + [(8, 1000 + i, 20, 5, [i]) for i in range(300)]
    df = spark.createDataFrame(rows, "region long, cid long, n long, hub long, shingles array<long>")
    groups = {}
    for r in jaccard._blocks(df).collect():
        groups.setdefault(r.region, set()).add(r.cid)
    assert not any(c >= 1000 for g in groups.values() for c in g)  # one hub: nothing left to find
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert all((a, b) in met for a in range(300) for b in range(a + 1, 300) if a % 3 == 0 or a % 3 != b % 3)
    assert max(map(len, groups.values())) * 20 <= 1.6 * 2000


def odd_rows():
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts())]
    return rows + [(2000, None), (None, rows[200][1]), (None, "only here without id at all"), (rows[300][0], rows[300][1]), (2001, rows[300][1].upper()), (2002, "long " * 30000), (2003, "x" * 100000)]


def test_against_brute(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    want = brute(rows)
    for region, block, held in ((jaccard.REGION_WEIGHT, jaccard.BLOCK_WEIGHT, jaccard.HELD), (8000, 8000, 2000), (2000, 700, 300)):
        monkeypatch.setattr(jaccard, "REGION_WEIGHT", region)
        monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", block)
        monkeypatch.setattr(jaccard, "HELD", held)
        got = jaccard.jaccard_groups(df, "doc_id", "text", jaccard.Measure(3, 90)).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
    assert jaccard.jaccard_groups(df.limit(0), "doc_id", "text").count() == 0


def test_keep_one_against_brute(spark, monkeypatch):
    """One row of each component: of repeated rows, of texts that share an id, and of rows without id."""
    t = texts()[200]
    rows = odd_rows() + [(None, "only here without id at all"), (None, None), (None, ""), (5000, "one text here under an id"), (5000, t), (4999, t + " more"), (5001, "five words are not many"), (5001, "five words are not many")]
    df = spark.createDataFrame([(d, x, i) for i, (d, x) in enumerate(rows)], "`doc.id` long, `the text` string, k1 int").withColumns({"k": F.lit("clash"), "n": F.lit(None).cast("int")})
    for region in (jaccard.REGION_WEIGHT, 3000):
        monkeypatch.setattr(jaccard, "REGION_WEIGHT", region)
        kept = jaccard.keep_one_of_each(df, "doc.id", "the text")
        assert kept.columns == df.columns
        got = kept.collect()
        assert sorted(repr(r["doc.id"]) for r in got) == brute_kept(rows)
        assert len({r.k1 for r in got}) == len(got) and all(tuple(r)[:2] == rows[r.k1] for r in got)
        assert len([r for r in got if r["doc.id"] == 5001]) == 1
    assert jaccard.keep_one_of_each(df.limit(0), "doc.id", "the text").count() == 0


def test_one_row_of_what_the_verdict_names(spark):
    """Repeated rows under one id, and a row of another's group whose id is the smallest of some other group."""
    t, u = "the first of two texts that have nothing to do with each other", "here stands quite another one with words of its own and no more"
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    keep = lambda rows: sorted(map(tuple, jaccard.keep_one_of_each(frame(rows), "id", "text").collect()), key=repr)
    assert keep([(1, t), (1, t), (2, t)]) == [(1, t)]
    assert keep([(0, u), (1, u), (1, t), (2, t)]) == [(0, u), (1, t)]
    assert keep([(None, t), (None, t), (None, u), (3, u)]) == [(3, u), (None, t)]
    with_map = frame([(1, t), (1, t)]).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert jaccard.keep_one_of_each(with_map, "id", "text").count() == 1


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op6_jaccard(spark, folder).collect()) == brute(rows)
