"""Token counts by a trie-shared unigram forward pass (operator 3).

A worker cuts texts at white space, inserts the pre-tokens it has not met in its trie, and computes for every new trie node
the best unigram segmentation of the prefix that ends there: once for each shared prefix, not once for each word.  The trie lives as long as the
worker and is planted anew at ``TRIE_NODES``.  The counts at terminal nodes are kept in a bounded table; a document's count is the sum over its pre-tokens.

The pieces and their order come from a public SentencePiece file.  That file's scores are merge
ranks, so the unigram log probabilities are Zipf-Mandelbrot's law over the ranks (``SHIFT``), a parameter and not a
trained model.  A character without a piece costs one byte token for each UTF-8 byte.
Of equally good segmentations the one with fewer tokens counts, then the one with the longer last piece.

Contract: a null text is "" and has no tokens.  Each row gives one row, repeated rows too; other columns are
not read.  Texts are whole; a pre-token of any length takes one path in the trie, and those over ``CACHED_CHARS`` are not remembered.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from eventlake.llm.rows import map_texts

SHIFT = 2.7
BYTE_PENALTY = 4.0
CACHED = 400_000
CACHED_CHARS = 64
TRIE_NODES = 500_000
#: Fixed value: SentencePiece's mark for the start of a word.
MARK = "▁"
ABSENT = object()


class Unigram:
    """Pieces with log probabilities, and counts of pre-tokens met so far."""

    def __init__(self, pieces: dict[str, float], byte_cost: float):
        self.pieces, self.byte_cost = pieces, byte_cost
        #: Every end of a piece -> the log probability, or None where it is no piece itself.
        self.ending: dict[str, float | None] = dict.fromkeys(p[i:] for p in pieces for i in range(len(p)))
        self.ending.update(pieces)
        self.known: dict[str, tuple[int, int, float]] = {}
        self._plant()

    def _plant(self) -> None:
        """An empty trie.  ``child``: (node, character) packed in one integer -> node; of each node: the score, tokens and byte tokens of its prefix."""
        self.child: dict[int, int] = {}
        self.scores, self.tokens, self.raw = [0.0], [0], [0]

    @property
    def nodes(self) -> int:
        return len(self.scores)

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        total = math.log(sum(1 / (r + SHIFT) for r in range(len(names))))
        pieces = {n: -math.log(r + SHIFT) - total for r, n in enumerate(names)}
        return cls(pieces, min(pieces.values()) - BYTE_PENALTY)

    def learn(self, words: list[str]) -> dict[str, tuple[int, int, float]]:
        """Tokens, byte tokens and score of each word."""
        if len(self.scores) > TRIE_NODES:
            self._plant()
        return {word: self._insert(word) for word in words}

    def _insert(self, word: str) -> tuple[int, int, float]:
        child, scores, tokens, raw, ending, byte_cost = self.child, self.scores, self.tokens, self.raw, self.ending, self.byte_cost
        text, node, way = MARK + word, 0, [0]
        for end, char in enumerate(text, 1):
            key = node << 21 | ord(char)
            node = child.get(key, 0)
            if not node:
                # Last pieces from short to long, as long as some piece ends so; of equals the longer one stays.
                best = count = odd = None
                start = end
                while start:
                    start -= 1
                    piece = ending.get(text[start:end], ABSENT)
                    if piece is None:
                        continue
                    if piece is ABSENT:
                        break
                    at = way[start]
                    score = scores[at] + piece
                    if best is None or score > best or (score == best and tokens[at] + 1 <= count):
                        best, count, odd = score, tokens[at] + 1, raw[at]
                if char not in self.pieces:
                    at, size = way[end - 1], len(char.encode("utf-8", "surrogatepass"))
                    score = scores[at] + size * byte_cost
                    if best is None or score > best or (score == best and tokens[at] + size < count):
                        best, count, odd = score, tokens[at] + size, raw[at] + size
                node = child[key] = len(scores)
                scores.append(best)
                tokens.append(count)
                raw.append(odd)
            way.append(node)
        return tokens[node], raw[node], scores[node]

    def _known(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Tokens, byte tokens and score of distinct words."""
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        new = self.learn(sorted(w for w in words if w not in known))
        known.update(new)
        found = list(map(known.__getitem__, words))
        for word in new:
            if len(word) > CACHED_CHARS:
                del known[word]
        return found

    def count(self, texts: pa.Array) -> list[np.ndarray]:
        """Pre-tokens, tokens, byte tokens and log probability of each text (no nulls).

        The words of all texts are found, and told apart, by arrays; texts with white space beyond ASCII are split by themselves.
        """
        texts = texts.cast(pa.binary())
        wide = pc.match_substring_regex(texts.cast(pa.string()), f"[{WIDE_SPACE}]")
        plain = pc.if_else(wide, pa.scalar(b""), texts) if pc.any(wide).as_py() else texts
        place = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[place[0] : place[-1]]
        words, own = words_of(data, place[:-1] - place[0])
        coded = words.dictionary_encode()
        code, of = coded.indices.to_numpy(), np.array(self._known([w.decode("utf-8") for w in coded.dictionary.to_pylist()]) or np.empty((0, 3)))
        ends = np.searchsorted(own, place - place[0])
        full = np.flatnonzero(np.diff(ends))
        out = [np.diff(ends), *(np.zeros(len(texts), kind) for kind in (np.int64, np.int64, np.float64))]
        for i in range(3):
            if len(full):
                out[i + 1][full] = np.add.reduceat(of[code, i], ends[:-1][full])
        for row in np.flatnonzero(wide.to_numpy(zero_copy_only=False)).tolist():
            parts = texts[row].as_py().decode("utf-8").split()
            distinct = list(dict.fromkeys(parts))
            value = dict(zip(distinct, self._known(distinct)))
            for i, total in enumerate((len(parts), *(sum(value[w][j] for w in parts) for j in range(3)))):
                out[i][row] = total
        return out


#: ASCII bytes, and characters beyond, that str.split() counts as white space.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])


def words_of(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of texts that stand one after the other in ``data``, and where each starts."""
    n = len(data)
    white = _WHITE[data]
    opening = np.zeros(n, bool)
    opening[begins[begins < n]] = True
    starts = np.flatnonzero(~white & (opening | np.append(True, white[:-1])[:n]))
    before = np.append(0, np.cumsum(~white))  # bytes of words before each place
    offsets = before[np.append(starts, n)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~white].tobytes())]), starts


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram.from_file(path)


def count_tokens(df: DataFrame, id_col: str, text_col: str, pieces_path: str) -> DataFrame:
    """id, n_pretokens, n_tokens, n_byte_tokens, log_prob."""
    kind = dict(df.dtypes)[id_col]

    def work():
        model = unigram(pieces_path)

        def step(keys, texts):
            return [keys[0], *map(pa.array, model.count(texts))]

        return step

    return map_texts(df, [id_col], text_col, f"k0 {kind}, n_pretokens long, n_tokens long, n_byte_tokens long, log_prob double", work, arrays=True).withColumnRenamed("k0", id_col)
