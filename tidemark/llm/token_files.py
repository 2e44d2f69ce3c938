"""Token ids in patched frame-of-reference files: encoding with the tokenizers library, writing, and reading back.

Layout of a file, all integers little-endian:

    magic "PFOR", version u32, block size u32, number of ids u64, number of documents u64, number of blocks u64
    for each block: minimum u32, width u8, exceptions u16; bit planes of the ids less the minimum; exceptions
        (positions u16, then values u32)
    index: u64 start of each block in the file, then u64 the index's own start
    documents: ids i64, lengths u32 (with the end id), then u64 this table's own start
    magic "ROFP"

A block's width is the number of bits that a given share of its values needs; the values beyond it are the exceptions.
Files are written by tasks into the shared folder, under names of their own for each attempt; only those that the manifest
lists, which Spark writes once, count. Spark orders the documents: each range of ids is a task, and files hold their documents
in ascending order.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import string
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh_dir, small_batches

BLOCK_IDS = 1024
PERCENTILE = 0.9
#: Ids after which a task starts another file: what is held at once.
FILE_IDS = 1 << 22
#: Characters of a text by which documents of one id are dealt.
BEGINNING_CHARS = 64
#: Pieces of texts whose ids a worker remembers.
CACHE_PIECES = 500_000
#: New pieces that the library encodes as one text.
LEARN_WORDS = 200

def _bytes_in(those: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(those, np.uint8))


#: Punctuation after a letter that begins a match of its own. No apostrophe: contractions are matches too.
_MARKS = _bytes_in(b".,;:!?|")
_BREAKS, _LETTERS = _bytes_in(b" \n"), _bytes_in(string.ascii_letters.encode())

_HEAD = struct.Struct("<4sIIQQQ")
_BLOCK = struct.Struct("<IBH")


def _solid(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that surely isn't white space ends before each place of UTF-8 bytes (three bytes precede the first)."""
    last, second, third = raw[at - 1], raw[at - 2], raw[at - 3]
    ascii_ = (last > 32) & (last < 128)
    # two bytes from U+00C0 on; three from U+4000 on, and four: no white space there
    return ascii_ | ((last >= 128) & ((second >= 0xC3) | ((second >= 128) & (second < 192) & ((third >= 0xE4) | ((third >= 128) & (third < 192))))))


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Places between two matches of the byte-level pattern: before a space or line feed after what isn't white space, and
    between a Latin letter and punctuation."""
    at = np.flatnonzero(_BREAKS[raw[3:]]) + 3
    at = at[_solid(raw, at)]
    marks = np.flatnonzero(_MARKS[raw[3:]]) + 3
    last, second = raw[marks - 1], raw[marks - 2]
    letter = _LETTERS[last] | ((last >= 128) & (((second == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((second >= 0xC4) & (second <= 0xC8))))
    return np.concatenate([at, marks[letter]])


class PieceEncoder:
    """Ids of whole texts as unsigned 32-bit integers, from ids that the library gave for their pieces.

    A piece goes from one surely known place between two matches of the byte-level pattern to the next one. No match goes from a
    character that isn't white space on to white space, nor from a letter on to punctuation, and what a match takes depends on
    nothing before it, so a text's ids are those of its pieces. A batch's distinct pieces are looked up once. New pieces that
    begin with white space and don't end with any are encoded together, as one text, and their ids are told apart by the
    tokens' bytes; others on their own. With `special`, the library's own setting, strings of special tokens in a text get
    those tokens' ids, so texts that have any are encoded as a whole; without it they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.apart = [t.content for t in added if special or not t.special]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # each character of a byte-level token stands for a byte
            self.bytes[i] = len(token)
        with open(path, "rb") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self.tokenizer.normalizer is None
        self.forget()

    def forget(self) -> None:
        #: The place of each known piece; its ids lie in ids[starts[place] : starts[place] + sizes[place]].
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.known), len(pieces)
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + k > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.held : self.held + len(ids)] = ids
        self.starts[n : n + k] = self.held + np.cumsum(sizes) - sizes
        self.sizes[n : n + k] = sizes
        self.held += len(ids)
        self.known.update(zip(pieces, range(n, n + k), strict=True))

    def learn(self, new: list[bytes]) -> None:
        raw = np.frombuffer(b"\0\0\0" + b"".join(new), np.uint8)
        ends = 3 + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        together = _BREAKS[raw[np.r_[3, ends[:-1]]]] & _solid(raw, ends)
        alone = [new[k] for k in np.flatnonzero(~together).tolist()]
        if alone:
            got = self.whole([x.decode() for x in alone])
            self._keep(alone, np.frombuffer(b"".join(got), "<u4"), np.fromiter((len(x) // 4 for x in got), np.int64, len(got)))
        joined = [new[k] for k in np.flatnonzero(together).tolist()]
        for k in range(0, len(joined), LEARN_WORDS):
            part = joined[k : k + LEARN_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))) + 1
            self._keep(part, ids, np.diff(cuts, prepend=0))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Of an Arrow array of strings; null is the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_piece:
            return self.whole(texts.to_pylist())
        apart = {}
        for t in self.apart:
            for k in np.flatnonzero(pc.match_substring(texts, t).to_numpy(zero_copy_only=False)).tolist():
                apart[k] = texts[k].as_py()
        got = dict(zip(apart, self.whole(list(apart.values())), strict=True)) if apart else {}
        if apart:
            usual = np.ones(len(texts), bool)
            usual[list(apart)] = False
            texts = texts.filter(pa.array(usual))
        collects = gc.isenabled()
        gc.disable()  # many live strings and no cycles: the collector would walk them again and again
        try:
            found = self._by_pieces(texts)
        finally:
            if collects:
                gc.enable()
        if not apart:
            return found
        rest = iter(found)
        return [got[k] if k in got else next(rest) for k in range(len(usual))]

    def _by_pieces(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.forget()
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        first, last = int(bounds[0]), int(bounds[-1])
        if first == last:
            return [b""] * n
        data = b"\0\0\0" + texts.buffers()[2].slice(first, last - first).to_pybytes()
        bounds = bounds - first + 3
        # a text's start is a cut of its own; cuts that the text before seems to ask for there are the same
        marked = np.zeros(len(data) + 1, bool)
        marked[_cuts(np.frombuffer(data, np.uint8))] = True
        marked[bounds] = True
        edges = np.flatnonzero(marked)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.known]
        if new:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        sizes = self.sizes[place]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[place] - (upto - sizes), sizes) + np.arange(upto[-1])].astype("<u4", copy=False).tobytes()
        cuts = (4 * np.r_[0, upto][np.searchsorted(edges, bounds)]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str, special: bool = True) -> PieceEncoder:
    return PieceEncoder(path, special)


def pack(ids: np.ndarray, block: int = BLOCK_IDS, share: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ids, one after another, and each block's start in them."""
    parts: list[bytes] = [b""] * -(-len(ids) // block)
    full = len(ids) // block
    if full:
        _pack(ids[: full * block].reshape(full, block), share, parts, 0)
    if len(ids) > full * block:
        _pack(ids[full * block :].reshape(1, -1), share, parts, full)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return b"".join(parts), np.cumsum(sizes) - sizes


def _pack(rows: np.ndarray, share: float, parts: list[bytes], at: int) -> None:
    n = rows.shape[1]
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    rank = min(n - 1, int(share * n))
    typical = np.partition(rest, rank, axis=1)[:, rank]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    for w in np.unique(widths):
        mine = np.flatnonzero(widths == w)
        v = rest[mine]
        planes = np.empty((len(mine), w, -(-n // 8)), np.uint8)
        for b in range(w):
            planes[:, b] = np.packbits((v >> np.uint32(b)).astype(np.uint8) & 1, axis=1)
        beyond = v >> np.uint32(w) if w < 32 else np.zeros_like(v)
        row, pos = np.nonzero(beyond)
        cuts = np.searchsorted(row, np.arange(len(mine) + 1))
        high = v[row, pos].astype("<u4")
        pos = pos.astype("<u2")
        for k, r in enumerate(mine):
            a, b = cuts[k], cuts[k + 1]
            parts[at + r] = _BLOCK.pack(int(low[r]), int(w), int(b - a)) + planes[k].tobytes() + pos[a:b].tobytes() + high[a:b].tobytes()


def unpack(data: memoryview | bytes, starts: np.ndarray, n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids of the blocks that start in data at starts; all but the last block are full."""
    out = np.empty(n_ids, np.uint32)
    heads = [_BLOCK.unpack_from(data, s) for s in starts.tolist()]
    raw = np.frombuffer(data, np.uint8)
    by: dict[tuple[int, int], list[int]] = {}
    for k, (_, w, _) in enumerate(heads):
        by.setdefault((w, min(block, n_ids - k * block)), []).append(k)
    for (w, n), ks in by.items():
        per = -(-n // 8)
        v = np.zeros((len(ks), n), np.uint32)
        if w:
            begin = starts[ks] + _BLOCK.size
            planes = raw[begin[:, None] + np.arange(w * per)].reshape(len(ks), w, per)
            for b in range(w):
                v |= np.unpackbits(planes[:, b], axis=1, count=n).astype(np.uint32) << np.uint32(b)
        for row, k in enumerate(ks):
            low, _, more = heads[k]
            if more:
                at = int(starts[k]) + _BLOCK.size + w * per
                pos = np.frombuffer(data, "<u2", more, at)
                v[row, pos] = np.frombuffer(data, "<u4", more, at + 2 * more)
            out[k * block : k * block + n] = v[row] + np.uint32(low)
    return out


def file_bytes(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    blocks, starts = pack(ids, block)
    head = _HEAD.pack(b"PFOR", 1, block, len(ids), len(doc_ids), len(starts))
    index_at = len(head) + len(blocks)
    index = (starts + len(head)).astype("<u8").tobytes() + struct.pack("<Q", index_at)
    docs = doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + struct.pack("<Q", index_at + len(index))
    return head + blocks + index + docs + b"ROFP"


class TokenFile:
    """A file's bytes with access by document and by position: only the blocks needed are unpacked."""

    def __init__(self, data: bytes):
        magic, _, self.block, self.n_ids, self.n_docs, n_blocks = _HEAD.unpack_from(data)
        if magic != b"PFOR" or data[-4:] != b"ROFP":
            raise ValueError("not a whole token file")
        self.data = data
        docs_at = struct.unpack_from("<Q", data, len(data) - 12)[0]
        index_at = struct.unpack_from("<Q", data, docs_at - 8)[0]
        self.starts = np.frombuffer(data, "<u8", n_blocks, index_at).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, docs_at)
        self.lengths = np.frombuffer(data, "<u4", self.n_docs, docs_at + 8 * self.n_docs).astype(np.int64)
        self.doc_starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, -(-stop // self.block)
        n = min(last * self.block, self.n_ids) - first * self.block
        got = unpack(self.data, self.starts[first:last], n, self.block) if n > 0 else np.zeros(0, np.uint32)
        return got[start - first * self.block : stop - first * self.block]


def open_fs(uri: str) -> tuple[pfs.FileSystem, str]:
    """Arrow's file system for a path or URI; Hadoop's names of S3 mean Arrow's."""
    scheme, sign, rest = uri.partition("://")
    if sign and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return pfs.FileSystem.from_uri(uri if sign or uri.startswith("file:") else f"file://{uri}")


def write_files(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest, one row for each file.

    The manifest has path, n_ids, n_docs, first_doc, range (ranges of ids ascend) and seq (order of a range's files). A null text is the
    empty text: the end id alone. Rows without a doc_id come first, with the id -2^63 in the file. Rows that share an id
    are ordered by their text. An empty table writes no file. A very long text makes a file of its own, longer than file_ids.
    Strings of special tokens in a text become these tokens, as the library does by itself.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the beginnings of texts cut up what shares an id, or has none, without holding whole texts for the ranges
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, BEGINNING_CHARS)).sortWithinPartitions("doc_id", "text")
    schema = "path string, n_ids long, n_docs long, first_doc long, range int, seq int"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out_dir)
        fs.create_dir(root, recursive=True)
        encoder = piece_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        ids: list[int] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, seq
            raw = b"".join(held)
            lengths = np.fromiter((len(x) // 4 for x in held), np.int64, len(held))
            path = f"{root}/{uuid.uuid4().hex}.pfor"
            with fs.open_output_stream(path) as f:
                f.write(file_bytes(np.frombuffer(raw, "<u4"), np.array(ids, np.int64), lengths))
            row = pa.RecordBatch.from_pylist(
                [{"path": path, "n_ids": len(raw) // 4, "n_docs": len(held), "first_doc": ids[0], "range": TaskContext.get().partitionId(), "seq": seq}],
                pa.schema([("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("range", pa.int32()), ("seq", pa.int32())]),
            )
            held.clear(), ids.clear()
            size, seq = 0, seq + 1
            return row

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode_column(batch.column(1)), strict=True):
                held.append(got + end)
                ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= file_ids:
                    yield flush()
        if held:
            yield flush()

    return checkpoint(ordered.mapInArrow(write, schema))


def read_documents(spark: SparkSession, manifest: DataFrame, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files that manifest lists; ids as little-endian u32."""
    # one row for each file: a window over them is as small as the list of files
    before = Window.orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).select("path", "before")
    n = max(1, manifest.count())
    placed = placed.repartition(min(n, 4 * spark.sparkContext.defaultParallelism if n < 4096 else n // 64), "path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(out_dir)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    found = TokenFile(f.read())
                for a in range(0, found.n_docs, 2000):
                    lengths, starts = found.lengths[a : a + 2000], found.doc_starts[a : a + 2000]
                    raw = found.ids(int(starts[0]), int(starts[-1] + lengths[-1])).astype("<u4").tobytes()
                    base = int(starts[0])
                    cuts = [(4 * (int(s) - base), 4 * (int(s) - base + int(n))) for s, n in zip(starts, lengths, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.doc_ids[a : a + 2000]), pa.array(starts + before), pa.array(lengths), pa.array([raw[x:y] for x, y in cuts], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    got = placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def stored(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read again.

    A null text is the empty text; repeated rows repeat; an empty table gives an empty one; other columns are left out.
    """
    spark = docs.sparkSession
    out_dir = fresh_dir(spark, "tokens")
    manifest = write_files(docs, tokenizer_path, out_dir, end_id)
    return read_documents(spark, manifest, out_dir).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
