"""Token ids in wavelet-matrix files (operator 8).

One file holds the ids of consecutive documents as bit planes, high bit first:
each plane is the current order's bit, after which the ids are stably parted into
zeros and ones.  Planes are cut into blocks that are compressed one by one; the
header keeps each block's place and the ones before it, so ``access``,
``count``, ``rank`` and ``select`` decompress only blocks they touch, and ``ids()``
undoes the partings to give the whole sequence.

Contract: documents are written in ascending id order (null ids first; rows with one id by
the hash of their text), a null text as "", and the end id closes every document, empty ones too.  Every row of the
input is one document of the files, repeated rows included.  An empty table gives no file and no rows.
A writer holds ``SHARD_TOKENS`` ids (or one longer document) at once and closes a file there,
whatever the size of its partition.  A file appears under its final name
only when it is complete, and a repeated task writes the same files again, as long as its input is read in the same
order again (files are; materialize a table whose rows may change their order).
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm.rows import materialize, shared_folder, slices

MAGIC = b"WVMTX001"
BLOCK_BITS = 1 << 18
RUN = 1 << 16
SHARD_TOKENS = 4 << 20
#: Text bytes that one range partition gets on average.
PARTITION_BYTES = 24 << 20
READ_TOKENS = 1 << 20
GROUP_PARTS = 4096
CACHED_CHUNKS = 700_000
CACHED_CHARS = 64
#: Chunks that the library gets at once.
JOINT = 500
#: The white space beyond ASCII that byte-level BPE's pattern counts as such.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# --- the file format -------------------------------------------------------------------------------------------------


def parted(current: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
    """Stably, the values without the bit and then those with it; by runs, whose places stay in the cache."""
    out, low, high = np.empty_like(current), 0, zeros
    for start in range(0, len(current), RUN):
        run, flag = current[start : start + RUN], ones[start : start + RUN]
        for some, with_bit in ((np.flatnonzero(~flag), False), (np.flatnonzero(flag), True)):
            at = high if with_bit else low
            out[at : at + len(some)] = run.take(some)
            low, high = (low, high + len(some)) if with_bit else (low + len(some), high)
    return out


def unparted(current: np.ndarray, ones: np.ndarray, zeros: int, bit: np.integer) -> np.ndarray:
    """The order before ``parted``, with the bit set where it was."""
    out, low, high = np.empty_like(current), 0, zeros
    for start in range(0, len(current), RUN):
        run, flag = out[start : start + RUN], ones[start : start + RUN]
        without, those = np.flatnonzero(~flag), np.flatnonzero(flag)
        run[without] = current[low : low + len(without)]
        run[those] = current[high : high + len(those)] | bit
        low, high = low + len(without), high + len(those)
    return out


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """A file's bytes: magic, header length, header (JSON), then the compressed parts."""
    compress = zstandard.ZstdCompressor(level=1).compress
    body, at = [], 0

    def add(raw: bytes) -> list[int]:
        nonlocal at
        part = compress(raw)
        body.append(part)
        at += len(part)
        return [at - len(part), len(part)]

    kind = np.uint16 if bits <= 16 else np.uint32
    current, planes = ids.astype(kind), []
    for level in range(bits - 1, -1, -1):
        ones = (current & kind(1 << level)) != 0
        blocks, before = [], 0
        for start in range(0, len(ones), BLOCK_BITS):
            block = ones[start : start + BLOCK_BITS]
            blocks.append([*add(np.packbits(block).tobytes()), before])
            before += int(np.count_nonzero(block))
        planes.append({"zeros": len(ones) - before, "blocks": blocks})
        current = parted(current, ones, len(ones) - before)
    null = [i for i, d in enumerate(doc_ids) if d is None]
    header = {
        "n": len(ids), "bits": bits, "block_bits": BLOCK_BITS, "planes": planes, "null_docs": null,
        "docs": add(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), "lengths": add(np.array(lengths, "<i8").tobytes()),
    }
    raw = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(raw)), raw, *body])


class WaveletFile:
    """Reads one file; ``source`` has seek and read.  Ranges are half-open."""

    def __init__(self, source):
        self.source = source
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<I", source.read(4))
        self.head = json.loads(source.read(size))
        self.base = len(MAGIC) + 4 + size
        self.n, self.bits, self.planes = self.head["n"], self.head["bits"], self.head["planes"]
        self.block = functools.lru_cache(maxsize=64)(self._block)

    def _part(self, place: list[int]) -> bytes:
        self.source.seek(self.base + place[0])
        return zstandard.ZstdDecompressor().decompress(self.source.read(place[1]))

    def _block(self, plane: int, k: int) -> np.ndarray:
        size = min(self.head["block_bits"], self.n - k * self.head["block_bits"])
        raw = self._part(self.planes[plane]["blocks"][k][:2])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size).view(bool)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids = np.frombuffer(self._part(self.head["docs"]), "<i8").tolist()
        for i in self.head["null_docs"]:
            ids[i] = None
        return ids, np.frombuffer(self._part(self.head["lengths"]), "<i8")

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, rest = divmod(i, self.head["block_bits"])
        blocks = self.planes[plane]["blocks"]
        if k == len(blocks):
            return self.n - self.planes[plane]["zeros"]
        return blocks[k][2] + (int(np.count_nonzero(self.block(plane, k)[:rest])) if rest else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = bool(self.block(plane, i // self.head["block_bits"])[i % self.head["block_bits"]])
            ones = self._ones(plane, i)
            i = self.planes[plane]["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self._ones(plane, start), self._ones(plane, end)
            if token >> (self.bits - 1 - plane) & 1:
                start, end = self.planes[plane]["zeros"] + a, self.planes[plane]["zeros"] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        if token >> self.bits:
            return 0
        start, end = self._range(token, 0, i)
        return end - start

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range."""
        return self.rank(token, self.n if end is None else end) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        start, end = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for plane in range(self.bits - 1, -1, -1):
            zeros = self.planes[plane]["zeros"]
            at = self._select_bit(plane, at - zeros, True) if token >> (self.bits - 1 - plane) & 1 else self._select_bit(plane, at, False)
        return at

    def _select_bit(self, plane: int, k: int, one: bool) -> int:
        blocks, size = self.planes[plane]["blocks"], self.head["block_bits"]
        before = lambda b: blocks[b][2] if one else b * size - blocks[b][2]
        low, high = 0, len(blocks) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid - 1)
        bits = self.block(plane, low)
        return low * size + int(np.flatnonzero(bits if one else ~bits)[k - before(low)])

    def occurrences(self, token: int) -> Iterator[int]:
        """Positions of a token, ascending."""
        for k in range(self.count(token)):
            yield self.select(token, k)

    def ids(self) -> np.ndarray:
        """The whole sequence: the bits of a place give its value, the partings are undone upwards."""
        bits = []
        for plane in range(self.bits):
            parts = [self._block(plane, k) for k in range(len(self.planes[plane]["blocks"]))]
            bits.append(np.packbits(np.concatenate(parts)) if parts else np.empty(0, np.uint8))
        current = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(bits[plane], count=self.n).view(bool)
            current = unparted(current, ones, self.planes[plane]["zeros"], current.dtype.type(1 << (self.bits - 1 - plane)))
        return current


# --- encoding --------------------------------------------------------------------------------------------------------


class ChunkEncoder:
    """Whole texts through the tokenizers library, each distinct chunk once.

    The pattern of byte-level BPE never joins characters across the cuts made here: a run of white space
    gives all but its last character as one piece, only a single space joins the word after it, and a run of
    ASCII letters at the start of a word, before another visible ASCII character, is a piece.  Cuts, the
    table of distinct chunks and the ids of all texts of a slice are made by arrays; only chunks not met before are texts of their own.
    """

    def __init__(self, path: str):
        # A worker is one of several on its machine: the library's own threads would only spin.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = "|".join([f"[{WIDE_SPACE}]", *(re.escape(t["content"]) for t in file["added_tokens"])])
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, bytes] = {}
        self.newline = self._ids("\n")

    def _ids(self, text: str) -> list[int]:
        """The library's ids, without the offsets that nothing here asks for."""
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, text: bytes) -> bytes:
        return np.array(self._ids(text.decode("utf-8")), "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encodes chunks joined by line ends, which are tokens of their own between words."""
        joint = [c for c in new if len(c) <= CACHED_CHARS and b"\n" not in c and not c.isspace()]
        for at in range(0, len(joint), JOINT):
            some = joint[at : at + JOINT]
            ids = np.array(self._ids(b"\n".join(some).decode("utf-8")), "<u4")
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids)) * 4
            raw, start = ids.tobytes(), 0
            if len(self.newline) == 1 and len(ends) == len(some):
                for chunk, end in zip(some, ends.tolist()):
                    self.known[chunk] = raw[start:end]
                    start = end + 4
        for chunk in new:
            if chunk not in self.known:
                self.known[chunk] = self._whole(chunk)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text (no nulls).  Texts with white space beyond ASCII or with added tokens go to the library whole."""
        texts = texts.cast(pa.binary())
        special = pc.match_substring_regex(texts.cast(pa.string()), self.special)
        out = self._plain(pc.if_else(special, pa.scalar(b""), texts) if pc.any(special).as_py() else texts)
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._whole(texts[i].as_py())
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) >= CACHED_CHUNKS:
            self.known.clear()
        place = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[place[0] : place[-1]]
        place = place - place[0]
        if not len(data):
            return [b""] * len(texts)
        starts = cuts(data, place[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).dictionary_encode()
        chunks, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.known
        raw = list(map(known.get, chunks))
        new = [c for c, r in zip(chunks, raw) if r is None]
        if new:
            self._learn(new)
            raw = [known[c] if r is None else r for c, r in zip(chunks, raw)]
        for chunk in new:
            if len(chunk) > CACHED_CHARS:
                del known[chunk]
        length = np.fromiter(map(len, raw), np.int32, len(raw)) // 4
        pool, first = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(length, dtype=np.int32) - length
        each = length[code]
        ends = np.cumsum(each, dtype=np.int32)
        ids = pool[np.repeat(first[code] - (ends - each), each) + np.arange(ends[-1], dtype=np.int32)]
        at = np.append(0, ends)[np.searchsorted(starts, place)].tolist()
        return [ids[i:j].tobytes() for i, j in zip(at, at[1:])]


#: Kinds of bytes: a space, other ASCII white space, letters, other visible ASCII; the rest is 0.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 8
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 4
_KIND[0x09:0x0E] = 2
_KIND[0x20] = 1


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the chunks of texts start that stand one after the other in ``data`` and begin at ``begins`` (empty ones, too)."""
    n = len(data)
    kind = _KIND[data]
    opening = np.zeros(n, bool)
    opening[begins[begins < n]] = True
    white, letter = (kind & 3) != 0, kind == 4
    after = lambda flag: np.append(False, flag[:-1]) & ~opening  # noqa: E731 - whether the byte before, of the same text, has the flag
    white_before = after(white)
    word = ~white & (opening | white_before)
    cut = opening | (white & ~white_before)
    last = np.flatnonzero(word & white_before) - 1  # the white space just before a word
    cut[last] = True
    cut[last[kind[last] == 2] + 1] = True
    # Letters that open a word and end at a visible character.
    ends = np.flatnonzero((kind == 8) & after(letter))
    if len(ends):
        runs = np.flatnonzero(letter & ~after(letter))
        cut[ends[word[runs[np.searchsorted(runs, ends) - 1]]]] = True
    return np.flatnonzero(cut)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


# --- operators -------------------------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(system, hidden: str, final: str) -> None:
    """Gives a complete file its name.  A file that an earlier attempt put there holds the same bytes and makes way, since not every system's rename replaces."""
    from pyarrow import fs

    if system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)
    system.move(hidden, final)


def write_token_files(df: DataFrame, id_col: str, text_col: str, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files below ``folder`` and returns their list: file, part, piece, n_docs, n_tokens."""
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # An id may be repeated without end: its rows are dealt by text, and equal rows by their place.
    keyed = texts.withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), "id", "h", "tie").sortWithinPartitions("id", "h", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer_path)
        bits = max(1, max(coder.size - 1, end_id).bit_length())
        system, root = _open(folder)
        end = np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        raw: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal piece, held
            name = f"tokens-{part:06d}-{piece:06d}.wvm"
            data = pack(np.frombuffer(b"".join(raw), "<u4"), docs, [len(r) // 4 for r in raw], bits)
            system.create_dir(root, recursive=True)
            hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as out:
                out.write(data)
            put(system, hidden, f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"file": name, "part": part, "piece": piece, "n_docs": len(docs), "n_tokens": held}], schema=listed)
            piece, held = piece + 1, 0
            docs.clear()
            raw.clear()
            return row

        for batch in batches:
            for few in slices(batch, "text"):
                for doc, ids in zip(few.column("id").to_pylist(), coder.encode(few.column("text"))):
                    ids += end
                    if docs and held + len(ids) // 4 > SHARD_TOKENS:
                        yield close()
                    docs.append(doc)
                    raw.append(ids)
                    held += len(ids) // 4
        if docs:
            yield close()

    listed = pa.schema([("file", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    return materialize(dealt.mapInArrow(write, "file string, part long, piece long, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_le (binary)."""
    # Offsets in two steps: within groups of parts, then over the groups' totals, which are few.
    grouped = files.withColumn("group", F.expr(f"part div {GROUP_PARTS}"))
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = grouped.groupBy("group").agg(F.sum("n_tokens").alias("n_tokens"))
    totals = totals.select(F.col("group"), earlier(Window.orderBy("group")).alias("base"))
    inside = earlier(Window.partitionBy("group").orderBy("part", "piece"))
    placed = grouped.withColumn("inside", inside).join(totals, "group").select("file", (F.col("base") + F.col("inside")).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_le", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    file = WaveletFile(source)
                    docs, lengths = file.documents()
                    ids = file.ids().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                first = 0
                while first < len(docs):
                    last = max(first + 1, int(np.searchsorted(ends, starts[first] + READ_TOKENS, "right")))
                    raw = [ids[a:b].tobytes() for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[first:last], pa.int64()), pa.array(starts[first:last] + row["before"]), pa.array(lengths[first:last]), pa.array(raw, pa.binary())], schema=schema)
                    first = last

    # One task for each file or so; the list is short and has no text.
    return placed.repartition(max(1, files.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_le binary")


def token_file_digest(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes a table's token files to the shared folder, reads them back and digests what they hold."""
    folder = shared_folder(spark, "tokens")
    files = write_token_files(df, id_col, text_col, folder, tokenizer_path, end_id)
    read = read_token_files(files, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
