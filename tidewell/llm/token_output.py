"""Operator 10, token-ID / binary output: texts are encoded, ids packed by Simple-8b into 64-bit words, and written in doc_id order.

File format (one row per document, in Parquet files that Spark commits, so a lost executor's file is written anew):
  part, seq      order of the document: file, and place in the file
  doc_id         the key
  n_tokens       ids, the end id included
  local_start    ids of the documents before it in the same file
  blocks         little-endian int32 word offsets, one per block of BLOCK ids: blocks decode independently
  words          little-endian 64-bit words; the top 4 bits select how many ids of what width the low 60 bits hold

Selectors 0-12 hold several ids; selector 13 is the escape: one id that no other width holds, up to 60 bits.
Defined cases: null text counts as empty (one end id); equal doc_ids are ordered by text; a null doc_id comes first; extra columns are ignored;
an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, chunks, frugal, shared_dir, span_hashes

BLOCK = 4096
END_ID = 0
#: (ids in a word, bits of each), by selector.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in LAYOUTS], np.int64)
PAD = 60
#: Pieces that can be encoded as lines of one text: letters or digits of any ASCII kind and marks, after one space at most.
PLAIN = re.compile(r"\x20?[!-~\u00a1-\u024f]+").fullmatch


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs consecutive documents: (words, words of each block, blocks of each document)."""
    lengths = np.asarray(lengths, np.int64)
    if len(ids) and int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    n_blocks = -(-lengths // BLOCK)
    sizes = np.full(int(n_blocks.sum()), BLOCK, np.int64)
    last = np.cumsum(n_blocks)[n_blocks > 0] - 1
    sizes[last] = (lengths - (n_blocks - 1) * BLOCK)[n_blocks > 0]
    # every block is followed by zeros, so a word can run over its end
    begin = np.cumsum(sizes + PAD) - (sizes + PAD)
    flat = np.zeros(int((sizes + PAD).sum()) + PAD, np.uint64)
    into = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    flat[into] = ids
    bits = np.frexp(flat.astype(np.float64))[1].astype(np.uint8)
    over = flat > np.uint64(1 << 52)  # floats round there
    bits[over] = [int(x).bit_length() for x in flat[over]]
    n = len(flat)
    most, done, choice = bits, 1, np.full(n, 13, np.uint8)
    for selector in range(12, -1, -1):
        count, width = LAYOUTS[selector]
        while done < count:  # most[i] = max(bits[i : i + done])
            step = min(done, count - done)
            wider = most.copy()
            np.maximum(most[: n - step], most[step:], out=wider[: n - step])
            most, done = wider, done + step
        choice[most <= width] = selector
    after = (np.arange(n) + COUNTS[choice]).tolist()
    at, n_words = [], np.zeros(len(sizes), np.int64)
    for b, (i, size) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
        end, had = i + size, len(at)
        while i < end:
            at.append(i)
            i = after[i]
        n_words[b] = len(at) - had
    at = np.array(at, np.int64)
    words, chosen = np.zeros(len(at), np.uint64), choice[at]
    for selector, (count, width) in enumerate(LAYOUTS):
        own = np.flatnonzero(chosen == selector)
        if len(own):
            value = np.full(len(own), selector << 60, np.uint64)
            for j in range(count):
                value |= flat[at[own] + j] << np.uint64(j * width)
            words[own] = value
    return words, n_words, n_blocks


def unpack(words: np.ndarray, n_words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks of n_words words that hold `lengths` ids."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, (count, width) in enumerate(LAYOUTS):
        own = np.flatnonzero(selector == s)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            out[(ends[own] - count)[:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
    starts = np.concatenate([[0], ends])[np.cumsum(n_words) - n_words].astype(np.int64) if len(n_words) else np.zeros(0, np.int64)
    keep = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return out[keep]


#: ASCII white space; letters and digits; marks that end a run of them (the bar stands inside special tokens).
_SPACE, _ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_ALNUM[33:127]
_MARK[ord("|")] = False


class Encoder:
    """Encodes whole texts by their pieces, each of which is encoded once and remembered.

    White space never ends a pre-token of a byte-level BPE that began with something else, so every run of white space starts a new
    pre-token; so does a mark that follows a letter or digit. Texts are cut at both, where they begin with an ASCII character, and equal
    pieces of a chunk are found by their hashes.
    """

    #: Pieces that are remembered: some 50 bytes each. Slots of the hash table that finds them.
    CACHE, SLOTS = 900_000, 1 << 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros(self.SLOTS, np.int32)  # a piece's number plus 1, by open addressing; at most half full
        self.hash, self.tag = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.begin, self.length, self.n = np.zeros(1024, np.int32), np.zeros(1024, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes and tags, -1 for those that aren't known."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        slot = (hashes % np.uint64(len(self.table))).astype(np.int64)
        while len(left):
            number = self.table[slot] - 1
            same = (self.hash[number] == hashes[left]) & (self.tag[number] == tags[left]) & (number >= 0)
            out[left[same]] = number[same]
            go = ~same & (number >= 0)
            left, slot = left[go], (slot[go] + 1) % len(self.table)
        return out

    def enter(self, hashes: np.ndarray, tags: np.ndarray, numbers: np.ndarray) -> None:
        """Notes new pieces, all different, in the table; their numbers are the last ones."""
        self.hash[numbers], self.tag[numbers] = hashes, tags
        if 2 * self.n > len(self.table):  # one text can hold more pieces than all before
            self.table = np.zeros(2 * len(self.table), np.int32)
            return self.enter(self.hash[: self.n].copy(), self.tag[: self.n].copy(), np.arange(self.n))
        slot = (hashes % np.uint64(len(self.table))).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.table[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.table[taken] = numbers[free[first]] + 1
            stay = np.ones(len(numbers), bool)
            stay[free[first]] = False
            numbers, slot = numbers[stay], (slot[stay] + 1) % len(self.table)

    def each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each), encoded one by one."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same by one text that holds the pieces as lines, or None if the line ends can't be told from the pieces' own ids.

        A line end between pieces of `PLAIN` form is a pre-token and an id of its own, so the ids between two of them are a piece's.
        """
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.line)
        if len(at) != len(pieces) - 1:
            return None
        return ids[ids != self.line], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces and numbers them from n on."""
        texts = [x.decode() for x in pieces]
        plain = np.fromiter((PLAIN(x) is not None for x in texts), bool, len(texts)) if self.line is not None else np.zeros(len(texts), bool)
        while self.n + len(texts) > len(self.begin):
            for name in ("begin", "length", "hash", "tag"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        for own, as_lines in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
            for at in range(0, len(own), 2000):
                where = own[at : at + 2000]
                part = [texts[i] for i in where.tolist()]
                joined, lengths = (self.lines(part) if as_lines else None) or self.each(part)
                while self.used + len(joined) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.begin[self.n + where] = self.used + np.cumsum(lengths) - lengths
                self.length[self.n + where] = lengths
                self.flat[self.used : self.used + len(joined)] = joined
                self.used += len(joined)
        self.n += len(texts)

    @staticmethod
    def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces: texts, cut before white space that follows something else, and before a mark that follows a letter or digit."""
        cut = np.zeros(len(data) + 1, bool)
        p1 = data[:-1]
        p2, p3 = (np.concatenate([np.zeros(k, np.uint8), p1])[: len(p1)] for k in (1, 2))
        # what may end a Unicode space stays with what follows
        odd = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & ((p2 == 0x80) | (p2 == 0x81) | (p2 == 0x9A) | (p2 == 0xA0)))
        solid = ((p1 > 0x20) & (p1 < 0x7F)) | ((p1 >= 0x80) & ~odd)
        cut[1:-1] = (_SPACE[data[1:]] & solid) | (_MARK[data[1:]] & _ALNUM[p1])
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        return starts, np.append(starts[1:], len(data))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts without end ids, ids of each text) of the UTF-8 bytes between offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if self.n > self.CACHE:
            self.clear()
        starts, ends = self.pieces(data, offsets)
        hashes, tags, raw = span_hashes(data, starts, ends), np.zeros(len(starts), np.uint64), data.tobytes()
        words = np.ndarray(len(data), np.uint64, raw + bytes(8), strides=(1,))
        with np.errstate(over="ignore"):
            for at in (starts, np.maximum(ends - 8, starts)):  # the first and last bytes, in case a hash should fail
                mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(ends - at, 8).astype(np.uint64)))
                tags = tags * np.uint64(0x9E3779B97F4A7C15) + (words[at] & mask)
        where = self.find(hashes, tags)
        new = np.flatnonzero(where < 0)
        if len(new):
            order = new[np.lexsort((tags[new], hashes[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (hashes[order][1:] != hashes[order][:-1]) | (tags[order][1:] != tags[order][:-1])
            one = order[other]
            number = self.n + np.arange(len(one))
            self.learn([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            self.enter(hashes[one], tags[one], number)
            where[order] = number[np.cumsum(other) - 1]
        lengths = self.length[where].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.begin[where] - bounds[:-1], lengths) + np.arange(bounds[-1])]
        return ids, np.diff(bounds[np.searchsorted(starts, offsets)])


def encoder(name: str) -> Encoder:
    """This worker's encoder; name: a file of public_tokenizers, or a path."""
    known: dict[str, Encoder] = KEPT.setdefault("encoders", {})
    if name not in known:
        import public_tokenizers

        known[name] = Encoder(name if os.path.isabs(name) else public_tokenizers.path(name))
    return known[name]


FILE_SCHEMA = "part int, seq long, doc_id long, n_tokens long, local_start long, blocks binary, words binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()), ("blocks", pa.binary()), ("words", pa.binary())])


def _slices(sizes: np.ndarray, limit: int):
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def encode_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """The rows of the files: documents in ascending doc_id order, range-partitioned, each with its packed ids."""

    def run(batches):
        part, seq, before, encode = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        for batch in batches:
            for a, data, offsets in chunks(batch.column("text")):
                b = a + len(offsets) - 1
                ids, n = encode(data, offsets)
                whole = np.full(len(ids) + len(n), end_id, np.uint64)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n = n + 1
                words, n_words, n_blocks = pack(whole, n)
                ends = np.cumsum(n_words)
                first = np.cumsum(n_blocks) - n_blocks
                at = (np.concatenate([[0], ends])[:-1]).astype(np.int64)
                base = at[first]
                inside = (at - np.repeat(base, n_blocks)).astype("<i4")
                raw, cut = words.astype("<u8").tobytes(), np.concatenate([base, [len(words)]])
                yield pa.record_batch(
                    [
                        pa.array(np.full(b - a, part, np.int32)), pa.array(np.arange(seq, seq + b - a)), batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(n), pa.array(before + np.cumsum(n) - n),
                        pa.array([inside[f : f + k].tobytes() for f, k in zip(first.tolist(), n_blocks.tolist(), strict=True)], pa.binary()), pa.array([raw[8 * x : 8 * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    schema=_ARROW,
                )
                seq, before = seq + b - a, before + int(n.sum())

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(frugal(run, ("encoders",)), FILE_SCHEMA)


def decode_files(files: DataFrame) -> DataFrame:
    """part, seq, doc_id, n_tokens, local_start, ids_crc32, from the packed words alone."""

    def run(batches):
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            blocks, words = batch.column("blocks").to_pylist(), batch.column("words").to_pylist()
            crc = np.zeros(len(n), np.int64)
            for a, b in _slices(np.array([len(x) for x in words], np.int64), 2 << 20):
                starts = [np.frombuffer(x, "<i4").astype(np.int64) for x in blocks[a:b]]
                flat = np.frombuffer(b"".join(words[a:b]), "<u8")
                n_words = np.concatenate([np.diff(np.append(s, len(w) // 8)) for s, w in zip(starts, words[a:b], strict=True)])
                sizes = np.concatenate([np.minimum(BLOCK, x - BLOCK * np.arange(len(s))) for s, x in zip(starts, n[a:b].tolist(), strict=True)])
                ids = unpack(flat, n_words, sizes).astype("<u4")
                ends = np.cumsum(n[a:b])
                raw = memoryview(ids).cast("B")
                crc[a:b] = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n[a:b].tolist(), strict=True)]
            yield pa.record_batch([batch.column(c) for c in ("part", "seq", "doc_id", "n_tokens", "local_start")] + [pa.array(crc)], names=["part", "seq", "doc_id", "n_tokens", "local_start", "ids_crc32"])

    return files.mapInArrow(frugal(run), "part int, seq long, doc_id long, n_tokens long, local_start long, ids_crc32 long")


def write_ids(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json") -> None:
    """Writes the files to path, a folder of any file system that Spark writes to."""
    encode_files(docs, tokenizer).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files. One row a file goes to the driver for the starts."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before, rows = 0, []
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect())):
        rows.append((part, before))
        before += n
    parts = F.broadcast(spark.createDataFrame(rows, "part int, part_start long"))  # a row for each file
    return decode_files(files).join(parts, "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """Writes the files (under the shared folder unless a path is given) and reads them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    return read_ids(spark, path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
