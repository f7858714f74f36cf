"""Token ids as wavelet-matrix shards.

Documents are encoded in ascending order of their ids and packed into shards. A shard is one compressed file: the
bit-planes of a wavelet matrix over its ids, cut into blocks that are compressed one by one, with a rank directory.
From the file alone an id can be read at any place, counted in any range and found by its k-th occurrence, touching a
block for each plane; documents are found by the lengths kept beside.

File: magic, header length (u32), JSON header, then the sections the header names. Plane b (from the highest bit)
has the b-th bits of the ids in the order in which the planes above have stably sorted them, zeros first.

Texts are cut where a run of white space begins and where letters or digits end, which no pre-token of a byte-level
tokenizer spans; equal pieces are encoded once by the tokenizers library and kept, so the cost follows the different
pieces. A shard numbers the ids it has, and its planes are those of the numbers.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

MAGIC, BLOCK_BITS = b"QWM1", 1 << 18

#: Unicode's White_Space, what \s means to the tokenizer.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER, _WORD, _SPACE = range(3)
#: Bytes of texts that are cut into pieces at once.
BYTES = 1 << 22

_kinds, _told = np.full(0x110000, _OTHER, np.uint8), np.zeros(0x1100, bool)


def kinds(codes: np.ndarray) -> np.ndarray:
    """Of each code point whether it is white space, a letter or digit, or something else; told block by block of 256 when first met."""
    for block in np.flatnonzero((np.bincount(codes >> 8, minlength=len(_told)) > 0) & ~_told).tolist():
        _kinds[256 * block : 256 * block + 256] = [_SPACE if c in WHITE_SPACE else _WORD if chr(c).isalnum() else _OTHER for c in range(256 * block, 256 * block + 256)]
        _told[block] = True
    return _kinds[codes]


#: The kinds of single bytes; those of longer characters are told by their code points.
_OF_BYTE = bytes(_SPACE if c in WHITE_SPACE else _WORD if c < 0x80 and chr(c).isalnum() else _OTHER for c in range(256))


def piece_starts(data: bytes) -> np.ndarray:
    """For each byte of a UTF-8 text whether a piece begins at it: white space that follows other characters, others that follow letters or digits.

    All bytes of a character have its kind.
    """
    kind = np.frombuffer(bytearray(data.translate(_OF_BYTE)), np.uint8)
    if not data.isascii():
        raw = np.frombuffer(data, np.uint8)
        wide = np.flatnonzero(raw >= 0xC0)
        lead = raw[wide].astype(np.int64)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | raw[wide[more] + k] & 0x3F
        own = kinds(code)
        for k in range(4):
            more = size > k
            kind[wide[more] + k] = own[more]
    starts = np.ones(len(kind), bool)
    starts[1:] = ((kind[1:] == _SPACE) & (kind[:-1] != _SPACE)) | ((kind[1:] == _OTHER) & (kind[:-1] == _WORD))
    return starts


class Encoder:
    """Encodes texts with a tokenizers file; pieces' ids are kept until ``limit`` of them are held."""

    def __init__(self, path: str, limit: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # in bytes, as a byte-level token has a character for each
        self.sizes[list(vocabulary.values())] = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Some hundred pieces make one call's words; their ids are told apart by the pieces' bytes."""
        groups = [new[lo : lo + 256] for lo in range(0, len(new), 256)]
        for lo in range(0, len(groups), 80):
            part = groups[lo : lo + 80]
            words = [[p.decode() for p in pieces] for pieces in part]
            for pieces, e in zip(part, self.tokenizer.encode_batch_fast(words, is_pretokenized=True, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
                reached = np.cumsum(self.sizes[np.minimum(ids, len(self.sizes) - 1)])
                cuts = np.searchsorted(reached, ends)
                if len(reached) and cuts[-1] == len(ids) - 1 and np.array_equal(reached[cuts], ends):
                    data, cuts = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
                    self.known.update(zip(pieces, (data[a:b] for a, b in zip(cuts, cuts[1:]))))
                else:  # not a byte-level tokenizer
                    self.known.update(zip(pieces, self._plain([p.decode() for p in pieces])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without special tokens added.

        A text that spells out a token of the tokenizer's own list, which can span pieces, is encoded as it is.
        """
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        out = [b""] * len(texts)
        for i, ids in zip(odd, self._plain([texts[i] for i in odd])):
            out[i] = ids
        plain = [(i, t.encode()) for i, t in enumerate(texts) if t]
        if odd:
            plain = [(i, t) for i, t in plain if i not in set(odd)]
        while plain:
            ends = list(accumulate(len(t) for _, t in plain))
            n = max(1, bisect_right(ends, BYTES))
            for (i, _), ids in zip(plain[:n], self._encoded(b"".join(t for _, t in plain[:n]), np.array(ends[:n]))):
                out[i] = ids
            plain = plain[n:]
        return out

    def _encoded(self, data: bytes, ends: np.ndarray) -> list[bytes]:
        """As encode(), for texts that are not empty, joined as UTF-8; ends: where each ends."""
        begins = piece_starts(data)
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        different, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        found = list(map(self.known.get, different))
        if missing := [p for p, ids in zip(different, found) if ids is None]:
            self._learn(missing)
            found = [self.known[p] if ids is None else ids for p, ids in zip(different, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts, taken = np.cumsum(sizes) - sizes, sizes[which]
        upto = np.cumsum(taken)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(firsts[which] - upto + taken, taken) + np.arange(int(upto[-1]))].tobytes()
        cuts = [0, *(4 * upto[np.searchsorted(starts, ends) - 1]).tolist()]
        if len(self.known) > self.limit:  # what came first is mostly what comes often
            self.known = dict(islice(self.known.items(), self.limit // 2))
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, pieces: int) -> Encoder:
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = Encoder(path, pieces)
    return _encoders[path, pieces]


def _planes(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    now, then = ids, np.empty_like(ids)
    for b in range(bits - 1, -1, -1):
        plane = (now & now.dtype.type(1 << b)) != 0
        yield plane
        zeros = len(now) - int(np.count_nonzero(plane))
        np.compress(~plane, now, out=then[:zeros])
        np.compress(plane, now, out=then[zeros:])
        now, then = then, now if now is not ids else np.empty_like(ids)


def build_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ids of all its documents in order, the documents' ids and numbers of ids."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1).compress
    ids = np.asarray(ids)
    there = np.zeros(int(ids.max(initial=0)) + 1, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there)
    bits = max(1, (len(alphabet) - 1).bit_length())
    ids = (np.cumsum(there) - 1)[ids].astype(np.uint16 if bits <= 16 else np.uint32)
    body, planes, at = [], [], 0

    def put(data: bytes) -> int:
        nonlocal at
        body.append(data)
        at += len(data)
        return len(data)

    for plane in _planes(ids, bits):
        ranks, sizes = [0], []
        start = at
        for lo in range(0, len(plane), BLOCK_BITS):
            part = plane[lo : lo + BLOCK_BITS]
            ranks.append(ranks[-1] + int(np.count_nonzero(part)))
            sizes.append(put(zip_(np.packbits(part).tobytes())))
        planes.append({"at": start, "sizes": sizes, "ranks": ranks})
    null = [i for i, d in enumerate(doc_ids) if d is None]
    names = zip_(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    counts = zip_(np.array(lengths, "<i8").tobytes())
    docs = {"n": len(doc_ids), "null": null, "ids_at": at, "ids_size": put(names), "lengths_at": at, "lengths_size": put(counts)}
    letters = {"at": at, "size": put(zip_(alphabet.astype("<u4").tobytes()))}
    header = zip_(json.dumps({"n": len(ids), "bits": bits, "planes": planes, "docs": docs, "alphabet": letters}).encode())
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


class Shard:
    """A shard read from its file's bytes."""

    def __init__(self, data: bytes, blocks_held: int = 64):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self._unzip = zstandard.ZstdDecompressor().decompress
        size = struct.unpack("<I", data[4:8])[0]
        header = json.loads(self._unzip(data[8 : 8 + size]))
        self._data, self._body = memoryview(data), 8 + size
        self.n, self.bits, self._docs = header["n"], header["bits"], header["docs"]
        self._planes = [{**p, "offsets": np.concatenate([[0], np.cumsum(p["sizes"])]).astype(int)} for p in header["planes"]]
        self._zeros = [self.n - p["ranks"][-1] for p in header["planes"]]
        self.alphabet = np.frombuffer(self._section(header["alphabet"]["at"], header["alphabet"]["size"]), "<u4")
        self._held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._blocks_held = blocks_held

    def _section(self, at: int, size: int) -> bytes:
        return self._unzip(bytes(self._data[self._body + at : self._body + at + size]))

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._section(self._docs["ids_at"], self._docs["ids_size"]), "<i8").tolist()
        for i in self._docs["null"]:
            ids[i] = None
        return ids

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._section(self._docs["lengths_at"], self._docs["lengths_size"]), "<i8")

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits, and the ones before each of its bytes."""
        key = plane, block
        if key not in self._held:
            if len(self._held) >= self._blocks_held:
                self._held.pop(next(iter(self._held)))
            p = self._planes[plane]
            packed = np.frombuffer(self._section(p["at"] + p["offsets"][block], p["sizes"][block]), np.uint8)
            self._held[key] = packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        return self._held[key]

    def _bit(self, plane: int, i: int) -> int:
        packed, _ = self._block(plane, i // BLOCK_BITS)
        i %= BLOCK_BITS
        return int(packed[i // 8]) >> (7 - i % 8) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, inside = divmod(i, BLOCK_BITS)
        p = self._planes[plane]
        if not inside:
            return p["ranks"][block]
        packed, before = self._block(plane, block)
        tail = int(packed[inside // 8]) >> (8 - inside % 8) if inside % 8 else 0
        return p["ranks"][block] + int(before[inside // 8]) + tail.bit_count()

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for b in range(self.bits):
            bit, ones = self._bit(b, i), self._ones(b, i)
            value = value << 1 | bit
            i = self._zeros[b] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _number(self, value: int) -> int | None:
        """The shard's number of an id, if it has that."""
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else None

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for b in range(self.bits):
            one_lo, one_hi = self._ones(b, lo), self._ones(b, hi)
            if value >> (self.bits - 1 - b) & 1:
                lo, hi = self._zeros[b] + one_lo, self._zeros[b] + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs at the places from lo to before hi."""
        number = self._number(value)
        if number is None:
            return 0
        lo, hi = self._range(number, lo, self.n if hi is None else hi)
        return hi - lo

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        p = self._planes[plane]
        before = p["ranks"] if bit else [min(i * BLOCK_BITS, self.n) - r for i, r in enumerate(p["ranks"])]
        block = min(bisect_right(before, k) - 1, len(p["sizes"]) - 1)
        packed, _ = self._block(plane, block)
        bits = np.unpackbits(packed)[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - before[block]])

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id."""
        number = self._number(value)
        if number is None:
            raise IndexError(k)
        lo, hi = self._range(number, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for b in range(self.bits - 1, -1, -1):
            bit = number >> (self.bits - 1 - b) & 1
            i = self._select_bit(b, bit, i - self._zeros[b] if bit else i)
        return i

    def occurrences(self, value: int) -> Iterator[int]:
        for k in range(self.count(value)):
            yield self.select(value, k)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest bit up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for b in range(self.bits - 1, -1, -1):
            p = self._planes[b]
            packed = b"".join(self._section(p["at"] + o, s) for o, s in zip(p["offsets"], p["sizes"]))
            plane = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            then = np.empty_like(now)
            zeros = self._zeros[b]
            then[np.flatnonzero(~plane)] = now[:zeros]
            then[np.flatnonzero(plane)] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - b))
            now = then
        return self.alphabet[now]


_SHARDS = "part INT, seq INT, before BIGINT, n_docs BIGINT, n_tokens BIGINT, file BINARY"


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, pieces: int = 600_000) -> None:
    """Encodes each text, appends ``end_id``, and writes shards of about ``shard_tokens`` ids under ``path``.

    The shards are rows of a Parquet table, so that any store Spark writes to can hold them: part and seq order them,
    before counts the ids of the part's earlier shards, file is the shard's file. Documents are in ascending order of
    their ids (nulls first; of equal ids by text), never split over shards. A null text is empty. pieces: how many pieces'
    ids a Python worker keeps; they are the same from the tokenizer again, so it tells memory from time only.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path, pieces).encode, TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        held: list[bytes] = []
        names: list[int | None] = []
        size = before = seq = 0

        def done() -> pa.RecordBatch:
            nonlocal held, names, size, before, seq
            ids = np.frombuffer(b"".join(held), "<u4")
            data = build_shard(ids, names, [len(h) // 4 for h in held])
            row = [[part], [seq], [before], [len(names)], [len(ids)], [data]]
            held, names, size, before, seq = [], [], 0, before + len(ids), seq + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "seq", "before", "n_docs", "n_tokens", "file"])

        for b in batches:
            for lo in range(0, b.num_rows, 2_048):
                part_ = b.slice(lo, 2_048)
                for name, ids in zip(part_.column(0).to_pylist(), encode(part_.column(1).to_pylist())):
                    names.append(name)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard_tokens:
                        yield done()
        if names:
            yield done()

    ordered = base.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, _SHARDS).write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(_SHARDS).parquet(path)


def read_documents(spark, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of all documents, decoded from the shards' files.

    start counts the ids of all documents before, over all shards. What the driver collects for it is one number for
    each part, of which there are as many as shuffle partitions when the shards were written.
    """
    shards = read_shards(spark, path)
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part] = total
        total += sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column(2)[i].as_py())
                ids, lengths = shard.decode(), shard.lengths()
                ends = np.cumsum(lengths)
                first = starts[b.column(0)[i].as_py()] + b.column(1)[i].as_py()
                pieces = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array(shard.doc_ids(), pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.tolist() for p in pieces], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + ", ids ARRAY<BIGINT>" * with_ids
    return shards.select("part", "before", "file").mapInArrow(run, schema)


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **how) -> DataFrame:
    """The documents' places, sizes and checksums, read back from shards written to the shared folder."""
    path = fresh_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer_path, end_id, **how)
    return read_documents(docs.sparkSession, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
