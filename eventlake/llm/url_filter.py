"""URL filters by a Bloom filter cascade (operator 10), native DataFrame operations only.

Level 0 encodes the listed keys, level 1 those unlisted keys of the corpus that
level 0 lets through, level 2 the listed keys that level 1 lets through, and so on until no
key is wrongly let through.  A key's answer is the parity of the first level that rejects it, and since all
keys of the corpus took part, the answer is exact for each of them.  The
levels are bit arrays that travel as scalar subqueries, so probing is an expression: no join, no shuffle of the pages, in building as in judging.

Size: level 0 has 12 bits a listed key and later levels a few per cent of that.  Keys are dealt by hash into
chunks, each with a cascade of its own, so that no bit array passes ``max_bits`` however long the list is; an
expression holds the arrays of ``PASS_CHUNKS`` chunks, and a list with more of them is probed in several passes over the urls.

Contract: rows are kept as they are, repeated ones too.  Null urls and urls without ``://`` have host and path ""
and match no rule.  Null listed keys are ignored; an empty list or table needs no level.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.rows import materialize, release

BITS_PER_KEY = 12
HASHES = 6
MAX_BITS = 1 << 26
PASS_CHUNKS = 16


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered) and path (then up to ``?`` or ``#``)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    before = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(before), F.lit("")), F.coalesce(path, F.lit(""))


def positions(key: Column, bits: int, level: int) -> list[Column]:
    """The key's bit positions in a level, by double hashing seeded with the level."""
    a, b = F.xxhash64(F.lit(level), key), F.xxhash64(F.lit(-1 - level), key)
    step = F.shiftleft(b, 1).bitwiseOR(F.lit(1))
    return [F.pmod(a.bitwiseXOR(F.shiftleft(step, i)) if i else a, F.lit(bits)) for i in range(HASHES)]


def bit_array(keys: DataFrame, bits: int, level: int) -> DataFrame:
    """One row: the level's words (array<long>), built with map-side OR before the small gather."""
    words = (bits + 63) // 64
    set_bits = keys.select(F.explode(F.array(*positions(F.col("key"), bits, level))).alias("at"))
    some = set_bits.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    filled = some.unionByName(keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    joined = filled.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return joined.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.col("all.bits").alias("words"))


def passes(key: Column, words: Column, bits: int, level: int) -> Column:
    set_there = [F.bit_get(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in positions(key, bits, level)]
    return functools.reduce(operator.and_, set_there)


class Cascade:
    """Chunks of levels of (bits, one-row frame with the words)."""

    def __init__(self, chunks: list[list[tuple[int, DataFrame]]]) -> None:
        self.chunks = chunks

    def chunk(self, key: Column) -> Column:
        return chunk_of(key, len(self.chunks))

    def passes(self) -> list[range]:
        """The chunks of each pass over the keys to be judged."""
        return [range(a, min(a + PASS_CHUNKS, len(self.chunks))) for a in range(0, len(self.chunks), PASS_CHUNKS)]

    def contains(self, key: Column, chunks: range | None = None) -> Column:
        """Whether a key of the universe, of one of ``chunks``, is listed: a nested CASE over the levels."""
        answer = F.lit(False)
        for i in reversed(range(len(self.chunks)) if chunks is None else chunks):
            one, levels = F.lit(len(self.chunks[i]) % 2 == 1), self.chunks[i]
            for level in range(len(levels) - 1, -1, -1):
                bits, words = levels[level]
                one = F.when(passes(key, words.scalar(), bits, level), one).otherwise(F.lit(level % 2 == 1))
            answer = one if len(self.chunks) == 1 else F.when(self.chunk(key) == i, one).otherwise(answer)
        return answer


def chunk_of(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("chunk"), key), F.lit(chunks)).cast("int")


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> Cascade:
    """``universe`` and ``listed``: keys in a column ``key``, repeated or not.  Listed keys outside the universe take no part."""
    both = universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("here")))
    keys = materialize(both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).where("here").select("key", "listed"), "url-keys")
    count = keys.where("listed").count()
    if not count:
        release(keys)
        return Cascade([])
    # Chunks are filled by hash: an eighth of room covers their spread.
    chunks = max(1, -(-count * bits_per_key * 9 // (8 * max_bits)))
    wrong = materialize(keys.withColumn("chunk", chunk_of(F.col("key"), chunks)), "url-wrong")
    release(keys)
    cascade: list[list[tuple[int, DataFrame]]] = [[] for _ in range(chunks)]
    level = 0
    while True:
        # Keys of the other side that a level lets through are encoded by the next one; its own side stays in play.
        encoded = wrong.where(F.col("listed") == F.lit(level % 2 == 0))
        sizes = {r.chunk: r["count"] for r in encoded.groupBy("chunk").count().collect()}  # one row for each chunk
        if not sizes:
            release(wrong)
            return Cascade(cascade)
        kept = []
        for i, size in sorted(sizes.items()):
            bits = max(64, size * bits_per_key)
            words = materialize(bit_array(encoded.where(F.col("chunk") == i).select("key"), bits, level), "url-level")
            cascade[i].append((bits, words))
            kept.append(wrong.where((F.col("chunk") == i) & passes(F.col("key"), words.scalar(), bits, level)))
        before, wrong = wrong, materialize(functools.reduce(DataFrame.unionByName, kept), "url-wrong")
        release(before)
        level += 1


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict.  ``rules``: verdict, host, path; a rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    dotted = F.concat(F.lit("."), host)
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = F.endswith(dotted, F.lit("." + rule_host)) & F.startswith(path, F.lit(rule_path)) & (host != "")
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str, str]], listed: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """id, host, path, rule, verdict, listed.  ``listed``: hosts to block, in its first column; rules overrule the list."""
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    parsed = df.select(F.col(f"`{id_col}`"), host.alias("host"), path.alias("path"))
    keys = listed.select(F.col(f"`{listed.columns[0]}`").cast("string").alias("key")).where("key <> ''")
    cascade = build_cascade(parsed.select(F.col("host").alias("key")).where("key <> ''").distinct(), keys, bits_per_key, max_bits)
    if len(cascade.passes()) < 2:
        marked = parsed.withColumn("listed", (F.col("host") != "") & cascade.contains(F.col("host")))
    else:
        of = cascade.chunk(F.col("host"))
        parts = [parsed.where((of >= some.start) & (of < some.stop)).withColumn("listed", (F.col("host") != "") & cascade.contains(F.col("host"), some)) for some in cascade.passes()]
        marked = functools.reduce(DataFrame.unionByName, parts)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return marked.select(F.col(f"`{id_col}`"), "host", "path", name.alias("rule"), judged.alias("verdict"), "listed")
