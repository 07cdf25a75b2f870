"""Packing by best-fit decreasing: full windows are cut first, a segment tree over remaining capacity places the rest."""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, END = 4096, 2
#: Pieces that one task packs; more pieces mean more tasks, not larger ones.
SHARD = 1 << 15
#: Bytes of text, and one text more, that a task encodes at once.
GROUP = 8_000_000
#: Code points of plain chunks lie below this, in two bytes at most.
_PLAIN = 0x250
_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASSES = (_LETTER, regex.compile(r"\p{L}")), (_DIGIT, regex.compile(r"\p{N}")), (_MARK, regex.compile(r"[^\s\p{L}\p{N}\p{C}]|\xad"))
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The characters by which byte-level tokenizers write bytes.
_BYTES = dict(zip(sorted(set(range(256)).difference(_VISIBLE)), range(256, 512)))


def _buffers(a: pa.Array, offset: type, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of an array that is no slice start, with the end, and what they hold."""
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, kind)
    at = np.frombuffer(a.buffers()[1], offset)[: len(a) + 1].astype(np.int64, copy=False)
    return at, np.frombuffer(a.buffers()[2] or b"", np.uint8)[: at[-1]].view(kind)


class Encoder:
    """The ids of whole texts, by the public tokenizer, with a bounded memory of pieces seen.

    White space ends a token in this vocabulary, so a text's ids are those of its chunks, one
    after another. Distinct chunks of plain Latin letters, digits and marks are lower-cased and cut
    into the tokenizer's own pieces, all at once over their bytes; the tokenizer's model encodes
    distinct pieces that are not remembered. Other chunks (other scripts, control characters,
    special-token strings) are pieces as they are, which the whole tokenizer encodes.
    """

    def __init__(self, path: str, chunks: int = 700_000, held: int = 1 << 26):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kind = np.dtype("<u2" if max(self.tok.get_vocab(with_added_tokens=True).values()) < 65536 else "<u4")
        self.lower, self.classes = np.zeros(_PLAIN, np.uint16), np.zeros(_PLAIN, np.uint8)
        for c in range(0x21, _PLAIN):
            low = self.tok.normalizer.normalize_str(chr(c))
            if len(low) == 1 and ord(low) < _PLAIN and (c < 0x80) == (ord(low) < 0x80):
                self.lower[c] = ord(low)
                self.classes[c] = next((k for k, found in _CLASSES if found.match(low)), 0)
        self.pieces: dict[bytes, bytes] = {}
        self.held, self.most = 0, (chunks, held)

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks (their bytes, where each starts, and the end): bytes in lower case, where pieces start, which bytes belong to other chunks."""
        n = len(data)
        d = np.concatenate((data, np.zeros(3, np.uint8)))
        code = d.astype(np.uint16)
        two = np.flatnonzero((d >= 0xC2) & (d <= 0xC9))
        code[two] = (d[two] & np.uint16(31)) << 6 | (d[two + 1] & 63)
        code[two + 1] = code[two]
        inner, wide = np.zeros(n + 3, bool), d >= 0x80
        inner[two + 1] = True
        wide[two] = wide[two + 1] = False
        code[wide | (code >= _PLAIN)] = 0
        kind = self.classes[code]
        strange = kind == 0
        strange[: n + 1] |= (d[: n + 1] == ord("<")) & (d[1 : n + 2] == ord("|"))
        sums = np.concatenate(([0], np.cumsum(strange[:n])))
        other = np.repeat(np.diff(sums[at]) > 0, np.diff(at))
        low = self.lower[code]
        text = np.where(low < 0x80, low, np.where(inner, low & 63 | 0x80, low >> 6 | 0xC0)).astype(np.uint8)[:n]
        text[other] = data[other]
        new = np.zeros(n + 4, bool)
        new[1 : n + 3] = kind[1:] != kind[:-1]
        new[: n + 3] |= (kind == _DIGIT) & ~inner
        new[:n][other] = False
        new[at] = True
        quote = np.flatnonzero(new[:n] & (text == ord("'")) & ~other)
        one, after = low[quote + 1], low[quote + 2]
        end = at[np.searchsorted(at, quote, "right")]
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where((one == ord("l")) & (after == ord("l")) | np.isin(one, list(b"rv")) & (after == ord("e")), 3, 0))
        short = (size > 0) & (quote + size <= end)
        quote, size = quote[short], size[short]
        new[quote + 1] = False
        new[quote + size] = True
        return text, np.flatnonzero(new[:n]), other

    def _learn(self, pieces: list[bytes], other: np.ndarray) -> None:
        if len(self.pieces) > self.most[0] or self.held > self.most[1]:
            self.pieces.clear()
            self.held = 0
        code, seen, tokenize = "HI"[self.kind.itemsize // 4], self.pieces, self.model.tokenize
        for i, p in enumerate(pieces):
            if p not in seen:
                if other[i]:
                    ids = self.tok.encode(p.decode(), add_special_tokens=False).ids
                else:
                    ids = [t.id for t in tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(_BYTES))]
                seen[p] = ids = array(code, ids).tobytes()
                self.held += len(p) + len(ids)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's start, with the end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "").cast(pa.string()))
        words = split.values.dictionary_encode()
        chunks = words.dictionary
        at, data = _buffers(chunks, np.int32, np.uint8)
        text, new, other = self._cut(data, at)
        starts = np.append(new, len(text))
        found = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(text)]).dictionary_encode()
        codes = found.indices.to_numpy()
        whole = np.zeros(len(found.dictionary), bool)
        whole[codes[other[new]]] = True
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(pieces, whole)
        known = pa.array([self.pieces[p] for p in pieces], pa.large_binary())
        cut = known.take(found.indices)
        ends, data = _buffers(cut, np.int64, np.uint8)
        known = pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends[np.searchsorted(new, at)]), pa.py_buffer(data)])
        ends, ids = _buffers(known.take(words.indices), np.int64, self.kind)
        return ids, ends[split.offsets.to_numpy()] // self.kind.itemsize

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, at = self.ids(pa.array(texts, pa.binary()))
        return [ids[a:b] for a, b in zip(at, at[1:])]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One a worker process, so that later tasks there know the words of earlier ones."""
    return Encoder(path)


def _cut(path: str, window: int, end: int):
    def run(batches):
        enc = _encoder(path)
        for b in batches:
            at, lengths = 0, pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            while at < b.num_rows:
                size, to = 0, at
                while to < b.num_rows and size < GROUP:
                    size += lengths[to]
                    to += 1
                part = b.slice(at, to - at)
                at = to
                ids, starts = enc.ids(part.column("text"))
                tokens = np.diff(starts) + 1
                ends = starts[1:] + np.arange(len(tokens))
                whole = np.empty(len(ids) + len(ends), "<u4")
                own = np.ones(len(whole), bool)
                own[ends] = False
                whole[own], whole[ends] = ids, end
                of = np.repeat(np.arange(len(tokens)), -(-tokens // window))
                start = (np.arange(len(of)) - np.searchsorted(of, of)) * window
                length = np.minimum(tokens[of] - start, window)
                first = ends[of] + 1 - tokens[of] + start
                crc = [zlib.crc32(whole[a:z]) for a, z in zip(first.tolist(), (first + length).tolist())]
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens[of]))]
                yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Bins:
    """Open windows by remaining capacity: a segment tree of counts finds the tightest that fits."""

    def __init__(self, window: int):
        self.window, self.base = window, 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _add(self, room: int, by: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity >= size that an open window has; -1: none."""
        i, count = size + self.base, self.count
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1

    def place(self, size: int) -> tuple[int, int]:
        """The window and the offset there of a piece of this size."""
        room = self.tightest(size)
        if room < 0:
            bin_, room = self.made, self.window
            self.made += 1
        else:
            bin_ = self.open[room].pop()
            self._add(room, -1)
        if room > size:
            self.open[room - size].append(bin_)
            self._add(room - size, 1)
        return bin_, self.window - room


def _pack(window: int, shards: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins = Bins(window)
        placed = [bins.place(n) for n in t.column("length").to_pylist()]
        shard = t.column("shard")[0].as_py()
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array([s * shards + shard for s, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of documents packed into sequences of at most `window` tokens.

    A document's ids, then `end`, are cut into full windows and one rest; best-fit decreasing
    places the pieces, shard by shard, a shard being a hash of a piece and its place in the
    staged table (so rows that repeat are dealt out), SHARD pieces on average whatever the
    table's size. Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. Null, empty and blank texts are one piece of `end` alone;
    very long texts give many full windows; repeated rows are packed like others; an empty
    table gives no piece; other columns are ignored.
    """
    pieces = common.stage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_cut(path, window, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    shards = max(1, -(-pieces.count() // SHARD))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = pieces.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, start, ids_crc32, monotonically_increasing_id()), {shards}) as int)"))
    return dealt.groupBy("shard").applyInArrow(_pack(window, shards), schema)


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
