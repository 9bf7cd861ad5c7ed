"""Token-id output: documents as compressed id arrays in shards with an offset index.

A shard is one byte string: a JSON header line (format, ids, bytes per id, SHA-256 of the dictionary),
then for each document its id, whether that id is null, the number of token ids and the place of its
frame, then the frames.  Each frame is one document's id array, compressed on its own with a zstandard
dictionary trained on serialised id arrays and shared by all shards, so a short document is read alone by
its offset.  Shards are the rows of a Parquet table (commit, retries and storage are Spark's), with the
dictionary in a table beside them; ``read_document`` and ``export_shards`` work on single shards.

The dictionary comes from at most ``sample_docs`` documents of at most ``SAMPLE_CHARS`` characters each (a
documented bound; rows are drawn by id and text, so neither repeated ids nor huge texts swell it).  Every text
is encoded whole.  Memory of a worker is bounded by bytes: of the cache of known pieces, of the block of text
encoded at a time, of a shard, and (``common.prepare``) of an Arrow batch; only a single text can be larger.  Order: ascending id, null ids first, equal ids by text.

Defined cases: null text is the empty text, which holds only the end id; equal ids and repeated rows each
get a place of their own; an empty table gives no shard and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import mixed, powers

#: Texts whose cuts are worked out on bytes: no two white-space characters together, and no characters but ASCII and Latin letters.
_S = r"\s\u180e\u200b\u2060\ufeff"
OTHER = re.compile(f"[{_S}][{_S}]|[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
EDGE = re.compile(f"[{_S}]")
#: A cut is safe at a lone space between two other characters.
LONE = re.compile(f"(?<=[^{_S}]) (?=[^{_S}])")
#: Bytes of known pieces and their ids that a worker keeps (a piece costs about 150 bytes more), and its longest piece.
CACHE, LONGEST = 8 << 20, 40
#: Bytes of text encoded at a time, ids of a shard, and characters of a text from which the dictionary may learn.
BLOCK, SHARD_IDS, SAMPLE_CHARS = 2 << 20, 1 << 18, 1 << 16
MAGIC = "token-shard/1"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _alphabet() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = _alphabet()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Whole texts to id arrays, by way of their distinct pieces.

    The tokenizer's pattern never joins characters across the cuts made here: before a lone space, at a line
    end, after a run of letters, and before one (unless a space or an apostrophe stands before it).  So a
    text's ids are those of its pieces.  Pieces of a block are told apart by two 64-bit hashes, worked out in
    numpy; only distinct pieces reach the tokenizer.  A text that holds the string of an added token (such as
    an end-of-text mark, which the library makes one id) goes to the tokenizer whole.  A piece of letters is one word of the pattern and goes
    to the tokenizer's model directly; the others are encoded as texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.dtype = np.dtype("<u2") if self.tool.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        added = sorted((t.content for t in self.tool.get_added_tokens_decoder().values() if t.content), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        kind = json.loads(self.tool.to_str())["pre_tokenizer"] or {}
        self.by_bytes = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and self.tool.normalizer is None

    def raw(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def pieces(self, raw: bytes, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> list[bytes]:
        """Ids (as bytes) of distinct pieces; word: whether a piece is a run of letters."""
        keys = [raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
        found = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            flags, code = word[missing].tolist(), self.code
            words = [i for i, w in zip(missing, flags, strict=True) if w]
            if words:
                spelled = b"\n".join([keys[i] for i in words]).decode("latin-1").translate(ALPHABET).split(ALPHABET[10])
                for i, tokens in zip(words, map(self.model.tokenize, spelled), strict=True):
                    found[i] = array.array(code, [t.id for t in tokens]).tobytes()
            for i, w in zip(missing, flags, strict=True):
                if not w:
                    found[i] = self.raw(keys[i].decode())
            for i in missing:
                if self.held >= CACHE:
                    break
                if len(keys[i]) <= LONGEST:
                    self.known[keys[i]] = found[i]
                    self.held += len(keys[i]) + len(found[i])
        return found

    def block(self, parts: list[bytes]) -> list[bytes]:
        """Ids of texts whose cuts can be worked out on bytes."""
        raw = b"\n".join(parts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        letter = _LETTER[data]
        before, last = np.zeros_like(letter), np.full_like(data, 10)
        before[1:], last[1:] = letter[:-1], data[:-1]
        cut = data == 32
        cut |= data == 10
        cut |= last == 10
        cut |= before & ~letter
        cut |= letter & ~before & (last != 32) & (last != 39)
        start = np.flatnonzero(cut)
        del before, last, cut
        end = np.append(start[1:], len(data))
        one, two = piece_hashes(data, start, end)
        _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[first[inverse]]).any():  # two pieces of one hash
            return [self.raw(p.decode()) for p in parts]
        head = start[first]
        ids = self.pieces(raw, head, end[first], letter[np.minimum(head + (data[head] == 32), len(data) - 1)])
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1  # the line ends between texts are not theirs
        n = lens[inverse]
        n[np.searchsorted(start, ends)] = 0
        upto = np.cumsum(n)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat((np.cumsum(lens) - lens)[inverse] - (upto - n), n)
        out = flat[at]
        cut = upto[np.searchsorted(start, ends)]
        return [out[x:y].tobytes() for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        ids: list[int] = []
        parts: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_bytes or (self.added and self.added.search(t)):
                out[i] = self.raw(t)
            elif EDGE.match(t[0]) or EDGE.match(t[-1]) or OTHER.search(t):
                out[i] = b"".join([self.raw(" " + p if k else p) for k, p in enumerate(LONE.split(t))])
            else:
                ids.append(i)
                parts.append(t.encode())
                size += len(parts[-1]) + 1
                if size > BLOCK:
                    for k, b in zip(ids, self.block(parts), strict=True):
                        out[k] = b
                    ids, parts, size = [], [], 0
        if parts:
            for k, b in zip(ids, self.block(parts), strict=True):
                out[k] = b
        return out


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, span: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece (pieces follow each other without a gap); a span of bytes at a time."""
    one, two = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + span, side="right")))
        part = data[start[a] : end[b - 1]].astype(np.uint64)
        up, down = powers(len(part))
        x, y = start[a:b] - start[a], end[a:b] - start[a]
        n = (y - x).astype(np.uint64)
        part += np.uint64(1)
        h = np.add.reduceat(part * up[: len(part)], x) * down[x]
        one[a:b] = mixed(h + n)
        part *= part * part + np.uint64(0x9E3779B1)
        h = np.add.reduceat(part * up[: len(part)], x) * down[x]
        two[a:b] = mixed(h ^ n)
        a = b
    return one, two


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def together(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Batches joined up to about BLOCK bytes of text: more words are then equal."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in ascending doc_id over the partitions (null first) and within them, equal ids by a hash of the text, then the text.

    Rows equal in both are told apart by their place in the input, so that an id of very many rows is cut over
    partitions; such rows give the same ids, and their order is not seen in a result.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.col("__hash"), F.col("__place")]
    marked = docs.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    return marked.repartitionByRange(*keys).sortWithinPartitions(keys[0], "__hash", F.col("text").asc_nulls_first(), "__place").drop("__hash", "__place")


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_docs: int = 1500, size: int = 65536, seed: int = 3) -> bytes:
    """zstandard dictionary from the id arrays of about sample_docs documents; empty if they are too few."""
    n = docs.count()
    if not n:
        return b""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1_000_003))
    drawn = docs.filter((draw < F.lit(round(min(1.0, 2 * sample_docs / n) * 1_000_003))) & (F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS))
    texts = sorted(r[0] or "" for r in drawn.orderBy(draw, "doc_id").limit(sample_docs).select("text").collect())
    tool = encoder(path)
    end = np.array([end_id], tool.dtype).tobytes()
    arrays = [b + end for b in tool.encode(texts)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, arrays)) // 8)), arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(raw: bytes):
    d = zstandard.ZstdCompressionDict(raw) if raw else None
    how = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=3, write_dict_id=False, **how), zstandard.ZstdDecompressor(**how)


INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("at", "<u8"), ("bytes", "<u4")])


def build_shard(items: list[tuple[int | None, bytes, int]], id_bytes: int, digest: str) -> bytes:
    """Shard of (doc_id, frame, number of ids)."""
    index = np.zeros(len(items), INDEX)
    at = 0
    for i, (doc, frame, n) in enumerate(items):
        index[i] = (doc or 0, doc is None, n, at, len(frame))
        at += len(frame)
    head = json.dumps({"format": MAGIC, "documents": len(items), "id_bytes": id_bytes, "dictionary": digest}).encode() + b"\n"
    return head + index.tobytes() + b"".join(f for _, f, _ in items)


def open_shard(shard: bytes) -> tuple[dict, np.ndarray, int]:
    """Header, index and where the frames begin."""
    end = shard.index(b"\n") + 1
    head = json.loads(shard[:end])
    if head.get("format") != MAGIC:
        raise ValueError("not a token shard")
    index = np.frombuffer(shard, INDEX, head["documents"], end)
    return head, index, end + index.nbytes


def read_document(shard: bytes, i: int, dictionary: bytes) -> np.ndarray:
    """Ids of the i-th document of a shard; only its own frame is read."""
    head, index, base = open_shard(shard)
    if head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the shard was written with another dictionary")
    x = index[i]
    data = _codec(dictionary)[1].decompress(shard[base + int(x["at"]) : base + int(x["at"]) + int(x["bytes"])])
    return np.frombuffer(data, f"<u{head['id_bytes']}")


def export_shards(shards: DataFrame, folder: str) -> int:
    """Write the shards of a table as files into a folder of this machine; for small outputs and inspection."""
    import pathlib

    n = 0
    for r in shards.orderBy("part", "shard").toLocalIterator():
        (pathlib.Path(folder) / f"{r.part:06d}-{r.shard:06d}.tok").write_bytes(r.content)
        n += 1
    return n


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS, **how) -> tuple[DataFrame, bytes]:
    """Encode docs (doc_id, text) and write shards: (table part, shard, first, ids, content; dictionary)."""
    common.prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, path, end_id, **how)
    digest = hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, pack = encoder(path), _codec(raw)[0]
        end = np.array([end_id], tool.dtype).tobytes()
        part, shard, first, held, items = TaskContext.get().partitionId(), 0, 0, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.int64()), "ids": pa.array([held], pa.int64()), "content": pa.array([build_shard(items, tool.dtype.itemsize, digest)], pa.binary())})

        for batch in together(batches, 1):
            for doc, b in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist()), strict=True):
                b += end
                n = len(b) // tool.dtype.itemsize
                if items and held + n > shard_ids:
                    yield out()
                    shard, first, held, items = shard + 1, first + held, 0, []
                items.append((doc, pack.compress(b), n))
                held += n
        if items:
            yield out()

    shards = in_order(docs).mapInArrow(run, "part int, shard int, first long, ids long, content binary")
    return common.written(shards, "token-shards", "none"), raw


def read_tokens(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    common.prepare(shards.sparkSession)
    digest = hashlib.sha256(dictionary).hexdigest()
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("ids")).collect())  # one number for each partition of the writer
    before, at = {}, 0
    for part, n in totals:
        before[part] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(dictionary)[1]
        for batch in batches:
            for part, first, shard in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                head, index, base = open_shard(shard)
                if head["dictionary"] != digest:
                    raise ValueError("the shard was written with another dictionary")
                crcs = []
                for x in index:
                    at = base + int(x["at"])
                    ids = np.frombuffer(unpack.decompress(shard[at : at + int(x["bytes"])]), f"<u{head['id_bytes']}")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = index["ids"].astype(np.int64)
                starts = before[part] + first + np.cumsum(n) - n
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(index["doc_id"], mask=index["null"].astype(bool)), "start": pa.array(starts), "n_tokens": pa.array(n), "ids_crc32": pa.array(crcs, pa.int64())})

    return shards.select("part", "first", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, dictionary = write_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path())
    return read_tokens(shards, dictionary)
