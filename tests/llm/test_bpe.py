import hashlib
import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from eventlake.llm import bpe, queries

PATH = "/opt/tokenizers/word_bpe_49k.json"
ODD = ["", " ", "a", "It's o'clock, WE'LL 'same", "don't x\x1cy\x1d z", "<|endoftext|>Hi<|startoftext|>", "é ΣΣ ΑΣ İi", "日本語 テスト 123 ½²", "a" * 3000, "🙂🙂!!??", "x<|endoftext|", "\x00\x01  wide"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_as_library(library):
    own = bpe.WordBpe(PATH)
    rng = random.Random(5)
    letters = "abcdeéèñüßÀÊ  \n\t'.,!0129stvmrell<|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts * 2:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_merge_is_leftmost_lowest_rank():
    def naive(symbols, pairs):
        while True:
            best = min(((pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs), default=None)
            if best is None:
                return symbols
            i = best[1]
            symbols = [*symbols[:i], pairs[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]

    rng = random.Random(1)
    for _ in range(300):
        pairs = {}
        for rank in range(12):
            pairs.setdefault((rng.randrange(6), rng.randrange(6)), (rank, rng.randrange(6)))
        word = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        assert bpe.merge_symbols(list(word), pairs) == naive(word, pairs)


def test_rows(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "word " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.bpe_digest(bpe.bpe_encode(df, "doc_id", "text", PATH), "doc_id").collect()
    assert len(got) == 5
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in got:
        text = {1: "a b", 4: "word " * 20000}.get(row.doc_id, "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert row.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    assert bpe.bpe_encode(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_every_code_point(library):
    """Alone, after a letter and inside a word; and pairs of marks, which normalization reorders and joins."""
    own = bpe.WordBpe(PATH)
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(c)]
    rng = random.Random(1)
    pairs = [rng.choice("aEο") + rng.choice(marks) + rng.choice(marks) for _ in range(20_000)]
    for text in [*points, *("a" + c for c in points), *("É" + c + "Bc" for c in points), *pairs]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query(spark, library, folder):
    """Every document against the library."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op7_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in got:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
