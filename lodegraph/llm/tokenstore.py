"""Operator 7, token ids in a compressed file format.

Texts are tokenised once into a scratch table. Global counts give a canonical Huffman code of at most
16 bits, or more where over 65,536 ids are in use (package-merge, so the lengths are optimal under that limit). Documents in ascending id order
are packed into blocks of whole documents; a block holds its ids, token counts, the bit stream and the
bit offset of every 256th token, so it is decoded by itself, all stretches between offsets at once,
with one table look-up a token. A store is a folder: ``header`` has the code lengths, ``blocks`` the
blocks, written by Spark's own committer, so any file system and lost executors are covered.

Defined cases: a null or empty text has the end id only; documents of equal id stay neighbours in some
order; null ids come first; an empty table gives an empty store; further columns are ignored. A
document is one block at most, so a block is bounded by the larger of the block size and a document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import arrow_map, discard, materialize, scratch_root, text_slices
from .pieces import _spread

LIMIT = 16
BLOCK_TOKENS, CHECKPOINT = 1 << 17, 256
#: Tokens of a file, and files at most: beyond, files grow with the corpus (a file is written as a stream of blocks).
PART_TOKENS, MOST_PARTS = 1 << 23, 20_000
#: Words and other pieces that each Python worker keeps with their ids, and the longest of them.
CACHE_WORDS, CACHE_BYTES = 250_000, 48
#: Bytes of text that are split at once.
CHARS_AT_ONCE = 4_000_000
#: New words that go to the library at once.
WORDS_AT_ONCE = 4096
#: ASCII characters that are neither letters, digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of Latin-1 letters.
_LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Lengths (0: unused) of an optimal prefix code of at most ``limit`` bits; by default 16, or one more
    than codes of one length need where more than 65,536 ids are in use."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if limit is None:
        limit = LIMIT if len(used) <= 1 << LIMIT else (len(used) - 1).bit_length() + 1
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    is_leaf, weights = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, weights])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < len(leaves))
        both = both[order]
        weights = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(is_leaf):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    out[used] = depth
    return out


def width(lengths: np.ndarray) -> int:
    """Bits that a code of these lengths is looked up by; 25 at most, as a look-up reads four bytes."""
    return max(LIMIT, int(lengths.max(initial=0)))


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), left-aligned in ``width(lengths)`` bits."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = np.int64(1) << (width(lengths) - lengths[used].astype(np.int64))
    codes = np.zeros(len(lengths), np.uint32)
    codes[used] = (np.cumsum(size) - size).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for all that the next ``width(lengths)`` bits may be."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = 1 << (width(lengths) - lengths[used].astype(np.int64))
    pad = (1 << width(lengths)) - int(size.sum())
    symbol, length = np.repeat(used, size), np.repeat(lengths[used], size)
    return np.pad(symbol, (0, pad)).astype(np.uint32), np.pad(length, (0, pad), constant_values=1).astype(np.int64)


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every CHECKPOINT-th token).

    Codes are moved to their place in a 64-bit word; those of one word are joined by or."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begin = ends - n
    code = codes[ids].astype(np.uint64) << np.uint64(64 - width(lengths))  # left-aligned
    word, place = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(code >> place, first)
    over = np.flatnonzero((begin & 63) + n > 64)  # at most one a word
    out[word[over] + 1] |= code[over] << (np.uint64(64) - place[over])
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], begin[::CHECKPOINT].astype(np.uint64)


def decode_block(payload: bytes, offsets: np.ndarray, n_tokens: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    symbol, length = table
    bits = len(symbol).bit_length() - 1
    b = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    wide = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    shift, mask = 32 - bits, np.uint32((1 << bits) - 1)
    at = offsets.astype(np.int64)
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    last = n_tokens - CHECKPOINT * (len(at) - 1)
    for k in range(CHECKPOINT):
        if k == last:  # the last stretch is shorter
            at = at[:-1]
        if not len(at):
            break
        w = (wide[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
        out[: len(at), k] = symbol[w]
        at = at + length[w]
    return out.reshape(-1)[:n_tokens]


def _plain(t: str) -> str | None:
    """A Latin-1 text in lower case, as the vocabulary folds case itself and letter by letter; None for
    others, and where something that is white space to Arrow but not to the vocabulary or a special
    token may stand."""
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t or "<|" in t else t.lower()


def _head_and_marks(chunks: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Each chunk of Latin-1 letters and ASCII punctuation after them in two, others whole and an empty
    string. The two are apart to the vocabulary, whatever it normalises: letters of Latin-1 stay letters."""
    heads = pc.utf8_rtrim(chunks, characters=_MARKS)
    apart = pc.match_substring_regex(heads, _LETTERS)
    size, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (heads, chunks))
    n = np.where(apart.to_numpy(zero_copy_only=False), whole - size, 0)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset :][: len(chunks)].astype(np.int64)
    marks = data[_spread(start + size, n)]
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pc.if_else(apart, heads, chunks), pa.StringArray.from_buffers(len(chunks), pa.py_buffer(offsets), pa.py_buffer(marks))


class Encoder:
    """Ids of whole texts by the library, chunk by chunk, for vocabularies that mark word ends (others
    encode whole texts). The pieces of the last slices of text are remembered with their ids in Arrow
    and numpy arrays, the least recent leave first, so memory is bounded. Letters and the punctuation
    after them are apart to the vocabulary and encoded apart; new words of Latin-1 letters go to the
    library many at once, joined by spaces, and their ids are told apart by the word ends."""

    _shared: dict[str, Encoder] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """This Python worker's encoder for a vocabulary file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.last = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known, self.flat, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @classmethod
    def forget(cls) -> None:
        """Give back what this worker remembers, for stages that do not encode."""
        cls._shared.clear()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        tail = np.array([end], np.uint32).tobytes()
        if not len(self.last):
            return [np.array(e.ids, np.uint32).tobytes() + tail for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [_plain(t) for t in texts]
        odd = [t for t, p in zip(texts, plain) if p is None]
        # white space never stands in a token
        easy = self._encode_chunks(pc.utf8_split_whitespace(pa.array([p for p in plain if p is not None], pa.string())))
        hard = self._encode_chunks(pc.split_pattern_regex(pa.array(odd, pa.string()), "[ \\t\\n\\r]+"))
        return [next(hard if p is None else easy) + tail for p in plain]

    def _encode_chunks(self, texts: pa.ListArray) -> Iterator[bytes]:
        """The ids of texts given as lists of chunks: looked up once a distinct piece and dealt out."""
        chunks = texts.flatten().dictionary_encode()
        pieces = pa.concat_arrays(_head_and_marks(chunks.dictionary)).dictionary_encode()
        flat, first, size = self._look_up(pieces.dictionary)
        both = pieces.indices.to_numpy().reshape(2, -1).T
        held, n = flat[_spread(first[both.ravel()], size[both.ravel()])], size[both].sum(axis=1)
        at = chunks.indices.to_numpy()
        out = held[_spread((np.cumsum(n) - n)[at], n[at])]
        stops = np.concatenate([[0], np.cumsum(n[at])])[texts.offsets.to_numpy()].tolist()
        return (out[lo:hi].tobytes() for lo, hi in zip(stops, stops[1:]))

    def _look_up(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many) of distinct pieces, which are the latest to be known then."""
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()[~new]
        fresh, first_new, size_new = self._learn(pieces.filter(pa.array(new)))
        first, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        first[~new], size[~new] = (np.cumsum(self.size) - self.size)[at], self.size[at]
        first[new], size[new] = first_new + len(self.flat), size_new
        flat = np.concatenate([self.flat, fresh])
        rest = np.ones(len(self.known), bool)
        rest[at] = False
        short = np.flatnonzero(pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= CACHE_BYTES)[:CACHE_WORDS]
        rest = np.flatnonzero(rest)[: CACHE_WORDS - len(short)]
        begin = np.concatenate([first[short], (np.cumsum(self.size) - self.size)[rest]])
        self.known = pa.concat_arrays([pieces.take(pa.array(short)), self.known.take(pa.array(rest))])
        self.size = np.concatenate([size[short], self.size[rest]])
        self.flat = flat[_spread(begin, self.size)]
        return flat, first, size

    def _learn(self, fresh: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many) by the library."""
        letters = pc.match_substring_regex(fresh, _LETTERS)
        words, others = fresh.filter(letters), fresh.filter(pc.invert(letters)).to_pylist()
        ids, ends = [], [np.zeros(1, np.int64)]
        for lo in range(0, len(words), WORDS_AT_ONCE):
            some = words.slice(lo, WORDS_AT_ONCE).to_pylist()
            ids.append(np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32))
            ends.append(ends[-1][-1] + np.flatnonzero(self.last[ids[-1]]) + 1)
            if len(ends[-1]) != len(some):
                raise ValueError("the vocabulary does not end words where white space does")
        several = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        n = np.empty(len(fresh), np.int64)
        at = letters.to_numpy(zero_copy_only=False)
        n[at], n[~at] = np.diff(np.concatenate(ends)), np.fromiter(map(len, several), np.int64, len(several))
        order = np.argsort(~at, kind="stable")
        first = np.empty(len(fresh), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([np.zeros(0, np.uint32), *ids, *several]), first, n


def tokenise(docs: DataFrame, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, ids)``: 32-bit ids of the whole text and the end id, zstd-compressed."""

    def run(batch: pa.RecordBatch):
        encoder = Encoder.shared(vocabulary)
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in text_slices(batch, 1, CHARS_AT_ONCE):
            ids = encoder.encode([x or "" for x in part.column(1).to_pylist()], end)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(_halves(x)) for x in ids], pa.binary())], names=["id", "ids"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids binary")


def _halves(x: bytes) -> bytes:
    """Ids with their low halves first and their high halves after, which compress apart."""
    a = np.frombuffer(x, np.uint16).reshape(-1, 2)
    return a.T.tobytes()


def _whole(x: bytes) -> np.ndarray:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint16).reshape(2, -1)
    return a[0].astype(np.uint32) | (a[1].astype(np.uint32) << 16)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus; the result is as long as the vocabulary."""

    def run(batches):
        Encoder.forget()
        total = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = np.bincount(_whole(x))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max([0, *rows["id"].to_pylist()]) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


_BLOCK = "part int, block int, before long, n_tokens long, doc_ids array<long>, sizes binary, offsets binary, payload binary"


def write_store(tokens: DataFrame, path: str) -> None:
    """Write the token table ``(id, ids)`` as a store at ``path``."""
    counts = count_ids(tokens)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark = tokens.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/header")

    def run(batches):
        Encoder.forget()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, size = [], [], 0

        def flush():
            flat = np.concatenate(docs)
            payload, offsets = encode_block(flat, lengths, codes)
            row = [part], [block], [before], [len(flat)], [ids], [np.array([*map(len, docs)], np.uint32).tobytes()], [offsets.astype(np.uint64).tobytes()], [payload]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = _whole(x)
                if docs and size + len(doc) > BLOCK_TOKENS:
                    yield flush()
                    block, before, ids, docs, size = block + 1, before + size, [], [], 0
                ids.append(i)
                docs.append(doc)
                size += len(doc)
        if docs:
            yield flush()

    n = max(1, min(MOST_PARTS, -(-int(counts.sum()) // PART_TOKENS)))
    ordered = tokens.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids`` of each document of a store; ``ids`` as little-endian 32-bit integers."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/header").first()[0], np.uint8)
    table = decode_table(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            flat = decode_block(row["payload"], np.frombuffer(row["offsets"], np.uint64), row["n_tokens"], table)
            sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
            ends = np.cumsum(sizes)
            ids = [flat[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, sizes)]
            cols = [pa.array([row["part"]] * len(ids), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "id", "start", "n_tokens", "ids"])

    rows = arrow_map(blocks, run, "part int, id long, start long, n_tokens long, ids binary")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as files
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(base) if base.count() <= 100_000 else base, "part").select("id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def store_documents(docs: DataFrame, vocabulary: str, path: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenise ``docs`` (integer ids) and write them as a store; returns its path."""
    tokens = materialize(tokenise(docs.withColumn(id_col, F.col(id_col).cast("long")), vocabulary, end, id_col, text_col), "tokens")
    path = path or f"{scratch_root(docs.sparkSession)}/tables/store-{uuid.uuid4().hex}"
    write_store(tokens, path)
    discard(tokens)
    return path


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of what ``read_store`` gives."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        crc = pa.array([zlib.crc32(x) for x in batch.column(3).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), crc], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return arrow_map(stored, run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
