import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from eventlake.llm import queries
from eventlake.llm import token_files as tf
from eventlake.llm.rows import shared_folder

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.parametrize("n,bits,block", [(0, 4, 64), (1, 1, 64), (1000, 10, 64), (5000, 17, 1024)])
def test_wavelet_file(n, bits, block, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_BITS", block)
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.5, n) % (1 << bits)).astype("<u4")
    file = tf.WaveletFile(io.BytesIO(tf.pack(ids, [None, 7], [0, n], bits)))
    assert file.ids().tolist() == ids.tolist()
    docs, lengths = file.documents()
    assert (docs, lengths.tolist()) == ([None, 7], [0, n])
    for i in rng.integers(0, max(n, 1), min(n, 50)).tolist():
        assert file.access(i) == ids[i]
    for token in {0, 1, *ids[:20].tolist()}:
        places = np.flatnonzero(ids == token).tolist()
        assert file.count(token) == len(places)
        assert list(file.occurrences(token)) == places
        assert file.rank(token, n // 3) == sum(p < n // 3 for p in places)
    with pytest.raises(IndexError):
        file.access(n)


def test_chunks_same_as_library():
    library, own = Tokenizer.from_file(PATH), tf.ChunkEncoder(PATH)
    rng = random.Random(2)
    letters = "abcdeéß  \n\n\t\xa0\x1c\x85'.,!019tsré<|>"
    texts = ["", " ", "\n", "a  b", "a \n b", "x\n\n\ny", "end.\nStart", "<|endoftext|> a<|endoftext|>", "a" * 500, " tail \n ", "日本　語", "\r\n x"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["\t", " \t a", "a\t b", "A1 b2", " A1", "don't", "é's a's", "a\x7fb a\x00b", "x  ", "\n\n a", "a\u2003b", "ab" * 40 + "!", " ", ""]
    texts += ["".join(rng.choice("aZ é!1\t\n'") for _ in range(rng.randrange(14))) for _ in range(4000)]
    column = pa.array(texts, pa.string())
    for text, ids in zip(texts * 2, own.encode(column) + own.encode(column)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_write_and_read(spark, monkeypatch):
    monkeypatch.setattr(tf, "PARTITION_BYTES", 3000)
    rows = [(i * 3 % 101, " ".join(f"word{j % (i + 1)}" for j in range(i)), "x") for i in range(90)]
    rows += [(5, None, None), (None, "null id", "y"), (7, "twice", ""), (7, "twice", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = shared_folder(spark, "t")
    files = tf.write_token_files(df, "doc_id", "text", folder, PATH, 0)
    got = tf.read_token_files(files, folder).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    keyed = df.selectExpr("coalesce(doc_id, -1) AS d", "coalesce(text, '') AS t").selectExpr("d", "xxhash64(t) AS h", "t").collect()
    want = [(d, t) for d, _, t in sorted(map(tuple, keyed))]  # of one id by the text's hash
    start = 0
    assert len(got) == len(rows)
    for (doc, text), row in zip(want, got):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (-1 if row.doc_id is None else row.doc_id, row.start, row.n_tokens, bytes(row.ids_le)) == (doc, start, len(ids), ids.tobytes())
        start += len(ids)
    digest = tf.token_file_digest(spark, df, "doc_id", "text", PATH, 0)
    assert sorted(r.ids_crc32 for r in digest.collect()) == sorted(zlib.crc32(bytes(r.ids_le)) for r in got)
    assert tf.token_file_digest(spark, df.limit(0), "doc_id", "text", PATH, 0).count() == 0


def test_hot_id_is_split(spark, monkeypatch):
    """One id, one text: the rows still spread over partitions, and offsets run through."""
    monkeypatch.setattr(tf, "PARTITION_BYTES", 2000)
    monkeypatch.setattr(tf, "GROUP_PARTS", 2)
    df = spark.createDataFrame([(None if i % 2 else 7, "the same words again") for i in range(2000)], "doc_id long, text string").repartition(4)
    folder = shared_folder(spark, "t")
    files = tf.write_token_files(df, "doc_id", "text", folder, PATH, 0)
    shares = [r.n_docs for r in files.collect()]
    assert sum(shares) == 2000 and max(shares) < 500
    got = tf.read_token_files(files, folder).collect()
    assert sorted(r.start for r in got) == list(range(0, 2000 * got[0].n_tokens, got[0].n_tokens))
    assert max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id == 7)


def test_second_attempt_replaces_a_file(tmp_path):
    from pyarrow import fs

    system = fs.LocalFileSystem()
    for text in ("one", "two"):
        (tmp_path / "hidden").write_text(text)
        tf.put(system, str(tmp_path / "hidden"), str(tmp_path / "final"))
        assert (tmp_path / "final").read_text() == text and not (tmp_path / "hidden").exists()


def test_query(spark):
    """Every document of a folder against the library."""
    folder = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(PATH)
    start, want = 0, {}
    for r in sorted(queries.table(spark, folder, "documents").collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = queries.op8_token_files(spark, folder).collect()
    assert len(got) == len(want) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
