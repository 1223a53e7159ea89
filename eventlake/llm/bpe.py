"""BPE encoding and decoding with word ends (operator 7).

Each pre-token is a row of symbols.  A segment tree over the ranks of adjacent
pairs keeps the minimum at its root; ties go left, so the root is the leftmost
pair of lowest rank.  A merge changes two or three leaves, each in logarithmic time, and
the loop ends when the root holds no rank.

Normalization and pre-tokens follow the tokenizer file.  Where Python's Unicode tables might be of another version than the
tokenizers library's, they come from the library's own normalizer and pre-tokenizer; the merges are made here in any case.

Contract: a null text is encoded as "", which has no ids and decodes to "".
Every row of the input gives one row, repeated rows and repeated or null ids
included; other columns are not read, so their names cannot clash.  Texts of
any length are encoded whole: only white-space-free chunks of up to
``CACHED_CHARS`` are remembered, in a table of at most ``CACHED_CHUNKS``.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.rows import map_texts

CACHED_CHUNKS = 300_000
CACHED_CHARS = 64

#: The tokenizer file's own white space, and the byte alphabet of byte-level BPE.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # as a character class
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Characters that every Unicode version treats alike, none of them combining; chunks of these only are normalized and cut here, others by the library.
PLAIN = "\x00-\u024f\u0386-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: str.split() also cuts at these, which the tokenizer does not count as white space.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge_symbols(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges until no adjacent pair has a rank.  ``pairs``: (left, right) -> (rank, merged)."""
    n = len(symbols)
    if n < 2:
        return symbols
    leaves = 1 << (n - 1).bit_length()
    none = 1 << 60
    # A node holds rank * leaves + position: the minimum is the leftmost pair of the lowest rank.
    tree = [none] * (2 * leaves)
    get = pairs.get
    found = False
    for i in range(n - 1):
        hit = get((symbols[i], symbols[i + 1]))
        if hit is not None:
            tree[leaves + i] = hit[0] * leaves + i
            found = True
    if not found:
        return symbols
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        node = leaves + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a <= b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] != none:
        i = tree[1] % leaves
        j = after[i]
        symbols[i] = left = pairs[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            hit = get((left, symbols[k]))
            put(i, none if hit is None else hit[0] * leaves + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            hit = get((symbols[h], left))
            put(h, none if hit is None else hit[0] * leaves + h)
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder of a BPE file whose pre-tokens end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.checked = regex.compile(f"[{PLAIN}]*")
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in alphabet.items()}
        self.inner = {b: vocab[c] for b, c in alphabet.items()}
        self.last = {b: vocab[c + suffix] for b, c in alphabet.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.mark = os.path.commonprefix(list(self.added))
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.words = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings = np.array([""] * size, dtype=object)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = token
        self.cut = regex.compile(f"[^{SPACE}]+")
        self.chunks: dict[str, bytes] = {}
        self.known: dict[bytes, list[int]] = {}

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merge_symbols(symbols, self.pairs)

    def words_of(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without added tokens, as UTF-8."""
        if text.isascii():
            return [w.encode() for w in self.words.findall(text.lower())]
        if self.checked.fullmatch(text) is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in cut]
        text = unicodedata.normalize("NFC", text)
        # The tokenizer lowers one character at a time, so a final sigma is not a case of its own.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return [w.encode() for w in self.words.findall(text)]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        ids: list[int] = []
        for word in self.words_of(text):
            got = self.known.get(word)
            if got is None:
                got = self.word(word)
                if len(word) <= CACHED_CHARS:
                    if len(self.known) >= CACHED_CHUNKS:
                        self.known.clear()
                    self.known[word] = got
            ids += got
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk without white space, as little-endian 32-bit integers."""
        ids: list[int] = []
        at = 0
        for hit in self.split_added.finditer(text) if self.mark in text else ():
            ids += self.plain(text[at : hit.start()])
            ids.append(self.added[hit[0]])
            at = hit.end()
        ids += self.plain(text[at:])
        raw = np.array(ids, dtype="<i4").tobytes()
        if len(text) <= CACHED_CHARS:
            self.chunks[text] = raw
        return raw

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text.  No pre-token crosses white space, which the tokenizer drops."""
        odd = any(c in text for c in NOT_SPACE)
        parts = self.cut.findall(text) if odd else text.split()
        known = self.chunks
        if len(known) >= CACHED_CHUNKS:
            known.clear()
        try:
            raw = b"".join(map(known.__getitem__, parts))
        except KeyError:
            get, make = known.get, self.chunk
            raw = b"".join([get(p) or make(p) for p in parts])
        return np.frombuffer(raw, dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: the tokens' own strings, joined by one space."""
        return " ".join(self.strings[ids].tolist())


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec for each Python worker, kept between tasks."""
    return WordBpe(path)


def bpe_encode(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, decode: bool = True) -> DataFrame:
    """``id_col``, ids array<int> and, if asked for, the text decoded from those ids."""
    kind = dict(df.dtypes)[id_col]
    schema = f"k0 {kind}, ids array<int>" + ", decoded string" * decode

    def work():
        tokenizer = codec(tokenizer_path)

        def step(keys, texts):
            ids = [tokenizer.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, "<i4")
            out = [keys[0], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            if decode:
                out.append(pa.array([tokenizer.decode(i) for i in ids], pa.string()))
            return out

        return step

    return map_texts(df, [id_col], text_col, schema, work).withColumnRenamed("k0", id_col)


def bpe_digest(encoded: DataFrame, id_col: str, *more: str) -> DataFrame:
    """Counts and digests of encoded documents, computed by the JVM from the ids and texts; ``more``: columns to keep."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
