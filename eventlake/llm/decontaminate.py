"""Benchmark decontamination by pigeonhole edit matching (operator 4).

An item of m normalized characters may be changed by k = floor(``RATE`` * m) edits.  Cut into k + 1 pieces, at
least one piece of every match within k edits is unchanged, so exact hits of pieces (one Aho-Corasick pass over each
text) find all candidates.  A hit allows a window of the text; windows of an item are merged and
verified with Myers' bit-parallel distance, the item's bits in one integer.

Normalization: words (letters, digits and ``_`` of Unicode, lower-cased) joined and bounded by one space, so an item
of a few characters only matches whole words.

Benchmark items are a stated query set.  They are normalized by Spark into a table of blocks in the shared folder, of about ``BLOCK_CHARS``
characters each by hash; a worker reads a block's file and keeps its automaton.  No item passes through the driver or a closure, and a task holds one block,
however long the benchmark is.  Each block is met by all documents: one pass over their texts for one block, and where there are more, over
texts that were normalized once and written down.

Contract: items that are null or without words match nothing; repeated items are reported one by one.  A null text is "".  Each
row of the documents is searched whole, repeated rows too; other columns are not read by ``find_leaks`` and kept by ``drop_leaks``.
Of an item's matches in a text the one with the least distance is reported, of equal ones the one that ends first, from its shortest start.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventlake.llm.rows import map_texts, materialize, release, shared_folder, slices

RATE = 0.05
BLOCK_CHARS = 4 << 20
WORDS = re.compile(r"\w+")


def normalize(text: str | None) -> str:
    words = WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of the text, and that substring's first end; k + 1 if it is over k."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = (m, 0) if m <= k else (k + 1, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        # A match may start anywhere, so row 0 stays 0 and nothing is shifted in.
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, at = score, end
            if best == 0:
                break
    return best, at


class Block:
    """Some items' automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, text, int(rate * len(text))) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces_of(text, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """Item, distance, start and end in a normalized text, for each item that leaks."""
        if not text or self.empty:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, at in where:
                _, item, k = self.items[n]
                start = last + 1 - size - at - k
                own = windows.setdefault(n, [])
                if own and start <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], start)
                    own[-1][1] = max(own[-1][1], start + len(item) + 2 * k)
                else:
                    own.append([start, start + len(item) + 2 * k])
        out = []
        for n, own in sorted(windows.items()):
            key, item, k = self.items[n]
            best, end = k + 1, 0
            for a, b in own:
                a = max(a, 0)
                exact = text.find(item, a, b)
                got, at = (0, exact - a + len(item)) if exact >= 0 else myers(item, text[a:b], min(k, best))
                if got < best:
                    best, end = got, a + at
                if best == 0:
                    break
            if best <= k:
                back = myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1], best)[1]
                out.append((key, best, end - back, end))
        return out


class ItemBlocks:
    """The query set as a table of blocks: item, text (normalized), block; ``count`` blocks in ``folder``."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, block_chars: int):
        kind = dict(items.dtypes)[id_col]

        def work():
            def step(keys, texts):
                return [keys[0], pa.array([normalize(t) for t in texts], pa.string())]

            return step

        plain = materialize(map_texts(items, [id_col], text_col, f"item {kind}, text string", work).where("text <> ''"), "benchmark-items")
        chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
        self.count = -(-chars // block_chars)
        self.folder = shared_folder(items.sparkSession, "benchmark-blocks")
        if self.count:
            plain.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(self.count))).repartition(self.count, "block").write.partitionBy("block").parquet(self.folder)
        release(plain)


@functools.lru_cache(maxsize=4)
def _block(folder: str, block: int, rate: float) -> Block:
    """A worker's automaton of one block, read from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    tables = [pq.ParquetFile(system.open_input_file(f.path)).read() for f in found if f.path.endswith(".parquet")]
    rows = sorted(((r["item"], r["text"]) for t in tables for r in t.to_pylist()), key=repr)
    return Block(rows, rate)


def _prepared(df: DataFrame, text_col: str, blocks: ItemBlocks) -> tuple[DataFrame, bool]:
    """The rows, with ``text_col`` normalized and written down where several blocks will read it."""
    if blocks.count < 2:
        return df, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for few in slices(batch, text_col):
                yield few.set_column(at, text_col, pa.array([normalize(t) for t in few.column(at).to_pylist()], few.schema.field(at).type))

    return materialize(df.mapInArrow(run, df.schema), "normalized-texts"), True


def find_leaks(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and item that it holds: id, item, distance, start, end (of the normalized text)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = dict(df.dtypes)[id_col], dict(items.dtypes)[item_col]
    hit = f"array<struct<item:{kinds[1]},distance:int,start:long,end:long>>"
    arrow_hits = to_arrow_type(_parse_datatype_string(hit))
    blocks = ItemBlocks(items, item_col, item_text, block_chars)
    narrow = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts, ready = _prepared(narrow, "text", blocks)
    folder = blocks.folder

    def one(block: int) -> DataFrame:
        def work():
            found = _block(folder, block, rate)

            def step(keys, texts):
                hits = [[dict(zip(("item", "distance", "start", "end"), h)) for h in found.search(t if ready else normalize(t))] for t in texts]
                rows = [i for i, h in enumerate(hits) if h]
                return [keys[0].take(pa.array(rows, pa.int64())), pa.array([hits[i] for i in rows], arrow_hits)]

            return step

        return map_texts(texts, ["k"], "text", f"k0 {kinds[0]}, hits {hit}", work)

    if not blocks.count:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, distance int, start long, end long")
    whole = functools.reduce(DataFrame.unionByName, map(one, range(blocks.count))).select(F.col("k0").alias(id_col), F.inline("hits"))
    return whole.withColumnRenamed("item", item_col)


def drop_leaks(df: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text: str, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that hold no item, with all their columns.  Each block reads what the one before it kept."""
    blocks = ItemBlocks(items, item_col, item_text, block_chars)
    folder, several = blocks.folder, blocks.count > 1
    plain = "".join(df.columns) + "_plain"

    def normalized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, text_col):
                yield few.append_column(plain, pa.array([normalize(t) for t in few.column(text_col).to_pylist()], pa.string()))

    def without(kept: DataFrame, block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _block(folder, block, rate)
            for batch in batches:
                for few in slices(batch, plain if several else text_col):
                    texts = few.column(plain).to_pylist() if several else map(normalize, few.column(text_col).to_pylist())
                    yield few.filter(pa.array([not found.search(t) for t in texts], pa.bool_()))

        return kept.mapInArrow(run, kept.schema)

    if several:
        df = df.mapInArrow(normalized, StructType([*df.schema, StructField(plain, StringType())]))
    kept = functools.reduce(without, range(blocks.count), df)
    return kept.drop(plain) if several else kept
