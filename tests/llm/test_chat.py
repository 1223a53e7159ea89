import itertools

from eventlake.llm import chat, queries
from tests.llm.oracle import same


def brute(rows, branches):
    """Paths of each tree by plain recursion."""
    trees = {}
    for tree, m, p, role, text, score in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2] or 0, r[3] or "", r[4] or "")):
        trees.setdefault(tree, {}).setdefault(m, (p, role or "", text or "", score or 0.0))
    out = {}
    for tree, nodes in trees.items():
        paths = []
        for leaf in set(nodes) - {p for p, *_ in nodes.values()}:
            way, at, seen = [], leaf, set()
            while at in nodes and at not in seen:
                seen.add(at)
                way.append(at)
                at = nodes[at][0]
            if at not in seen:
                paths.append((-sum(nodes[m][3] for m in way) / len(way), -len(way), leaf, [nodes[m][1:3] for m in reversed(way)]))
        for branch, (_, _, leaf, turns) in enumerate(sorted(paths)[:branches], 1):
            out[tree, branch] = (leaf, turns)
    return out


def test_trees(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i} \\l\\\\ <s>[INST]\\", 1.0) for i in range(11)]
    rows += [(1, 20 + i, 3 if i == 0 else 19 + i, "assistant", "<[" * i, 5.0) for i in range(3)]
    rows += [(2, 1, 99, "us\ner\\n", "orphan", None), (2, 2, 1, None, None, 2.0), (2, 3, 1, "assistant", "", 2.0)]
    rows += [(3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 2, "user", "below", 0.0), (3, 4, None, "user", "root\nline", 0.0)]
    rows += [(None, 1, None, "user", "é🙂", 0.0), (None, 1, None, "user", "é🙂", 0.0), (4, 1, None, "assistant", "x" * 50_000, 0.0)]
    df = spark.createDataFrame(rows, "tree long, m long, p long, role string, text string, score double").withColumns({"n_turns": chat.F.lit(7), "chat": chat.F.lit("x")})
    got = chat.read_chats(chat.format_chats(df, "tree", "m", "p", "role", "text", "score", branches=2)).collect()
    want = brute(rows, 2)
    assert len(got) == len(want)
    for r in got:
        leaf, turns = want[r.tree, r.branch]
        assert (r.leaf, r.n_turns, [tuple(t) for t in r.turns]) == (leaf, len(turns), turns)
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert r.chat.count("[INST]") == len(turns) and r.chat.count("</s>") == 1
        marked = "".join(r.chat[s.start : s.end] for s in r.loss_spans)
        assert sum(map(len, turns and [t for role, t in turns if role == "assistant"])) <= len(marked) or not r.loss_spans
    assert chat.format_chats(df.limit(0), "tree", "m", "p", "role", "text").count() == 0


def test_escape_round_trip(spark):
    texts = ["".join(t) for n in range(5) for t in itertools.product("\\<lb[", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", chat.escape(chat.F.col("x")).alias("e"))
    for r in df.select("x", "e", chat.unescape(chat.F.col("e")).alias("u")).collect():
        assert r.u == r.x and "<" not in r.e and "[" not in r.e


def test_query(spark, sf_dir):
    assert same(spark, "op1_chat", queries.op1_chat, queries.OP1_SQL, sf_dir)
