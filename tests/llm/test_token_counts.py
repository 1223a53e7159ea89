import random

import pyarrow as pa
import pytest

from eventlake.llm import queries, token_counts

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def naive(model, text):
    """Tokens, byte tokens and score of one pre-token by a table of its own."""
    text = token_counts.MARK + text
    best = [(0.0, 0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + model.pieces[text[s:end]], best[s][1] - 1, best[s][2]) for s in range(end) if text[s:end] in model.pieces]
        if text[end - 1] not in model.pieces:
            size = len(text[end - 1].encode())
            b = best[end - 1]
            options.append((b[0] + size * model.byte_cost, b[1] - size, b[2] + size))
        best[end] = max(options, key=lambda o: o[:2])
    return -best[-1][1], best[-1][2], best[-1][0]


def test_against_naive():
    model = token_counts.Unigram.from_file(PATH)
    rng = random.Random(4)
    words = ["", "a", "the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本", "🙂x", "ﬁ€"] + ["".join(rng.choice("abcdehinorstué.,") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    got = model.learn(words)
    for word in words:
        assert got[word][:2] == naive(model, word)[:2], word
        assert got[word][2] == pytest.approx(naive(model, word)[2])
    assert model.nodes < sum(len(w) + 1 for w in words)


def test_small_trie_shares_prefixes():
    model = token_counts.Unigram({"▁": -1.0, "▁a": -1.0, "a": -1.0, "b": -2.0, "ab": -2.5}, -10.0)
    assert model.learn(["ab", "aba", "abb"]) == {"ab": (2, 0, -3.0), "aba": (3, 0, -4.0), "abb": (3, 0, -5.0)}
    assert model.nodes == 1 + 3 + 2


def test_trie_lives_on_and_is_replanted(monkeypatch):
    model = token_counts.Unigram({"▁": -1.0, "▁a": -1.0, "a": -1.0, "b": -2.0, "ab": -2.5}, -10.0)
    first = model.learn(["ab", "abb"])
    nodes = model.nodes
    assert model.learn(["abba"]) == {"abba": (4, 0, -6.0)} and model.nodes == nodes + 1
    monkeypatch.setattr(token_counts, "TRIE_NODES", 2)
    assert model.learn(["ab", "abb"]) == first and model.nodes == nodes


def test_texts_against_split():
    """Words as str.split() gives them, and sums over them, whatever white space stands where."""
    model = token_counts.Unigram.from_file(PATH)
    rng = random.Random(9)
    texts = ["", " ", "a", " a ", "\x1c", "a\x1cb", "\u3000", "a\u3000b c", "\xa0", "é\x85è x", "x" * 200 + " y"] + ["".join(rng.choice("ab é\t\n\x1f\xa0日") for _ in range(rng.randrange(12))) for _ in range(2000)]
    for part in (texts, texts[3:9], [], [""], ["", ""]):
        got = list(zip(*(c.tolist() for c in model.count(pa.array(part, pa.string())))))
        for text, row in zip(part, got, strict=True):
            each = [naive(model, w) for w in text.split()]
            assert row[:3] == (len(each), sum(e[0] for e in each), sum(e[1] for e in each)), ascii(text)
            assert row[3] == pytest.approx(sum(e[2] for e in each))


def test_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 50)
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x" * 5000 + " y"), (4, "many words " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", token_counts.pa and queries.url_filter.F.lit("clash"))
    got = token_counts.count_tokens(df, "doc_id", "text", PATH).collect()
    model = token_counts.Unigram.from_file(PATH)
    want = [(d, len((t or "").split()), sum(naive(model, w)[0] for w in set((t or "").split()) for _ in range((t or "").split().count(w)) if len(w) < 99)) for d, t in rows if d != 3]
    assert sorted((repr(r.doc_id), r.n_pretokens, r.n_tokens) for r in got if r.doc_id != 3) == sorted((repr(d), n, t) for d, n, t in want)
    assert token_counts.count_tokens(df.limit(0), "doc_id", "text", PATH).count() == 0
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    known = {}
    for r in queries.op3_token_counts(spark, sf_dir).collect():
        words = texts[r.doc_id].split()
        for w in set(words) - set(known):
            known[w] = naive(model, w)
        assert (r.n_pretokens, r.n_tokens, r.n_byte_tokens) == (len(words), sum(known[w][0] for w in words), sum(known[w][1] for w in words))
