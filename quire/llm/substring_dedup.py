"""Removal of long repeated substrings, by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere in the corpus. Finding these strings:

1. *Segments.* Each window of ``length`` bytes is named by the least hash of its ``gram``-byte pieces. Consecutive
   windows of one name are a segment; equal windows have equal names, so they meet in segments of one name. There
   is about one segment for ``length / 2`` bytes, and only (name, content hash) travels for it.
2. *Names met once* end here: their windows are unique. Segments with equal contents are wholly repeated.
3. *What is left* (segments of one name with different contents: edges of repeated passages, edits) is named again,
   by *cores*. The least gram's place in a window, in steps of 64 bytes, and the ``length - 63`` bytes that all windows
   of that step share name up to 64 consecutive windows; equal windows have equal cores. Cores met once end here.
4. Windows of one core differ in what is around it only, 63 bytes at most. So a core counts as a code of three symbols,
   and the strings around it are compared by core: the different ones of some cores make a block; its suffixes are sorted,
   and on the Burrows-Wheeler transform the intervals of all strings are expanded backwards, breadth first: strings of
   length 0, 1, 2, ... set the common prefixes of that value at their intervals' ends. The expansion stops at the
   length of a window: places not set by then are where neighbours share it, and their suffixes start repeated windows.
5. Cores with more than ``group_bytes`` of different strings are named by steps of 16, 4 and 1 bytes before, with what
   then is common added to the core; in steps of one byte nothing is left to compare. So no group lands in one task.

The windows found join back to the documents by id and text hash, and give the removed runs. What is written on the
way goes to the shared folder and is deleted once the removed runs are known.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, text_key

#: Windows hashed at once, windows of a segment at most, bytes of a block of contents.
CHUNK, LONGEST, BLOCK_BYTES = 1 << 19, 1_024, 1 << 20
#: Windows that share a core at most, split by split; symbols that stand for a core, and their number system.
STEPS, CODE, BASE = (64, 16, 4, 1), 3, 128

_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(21).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE2 = np.random.default_rng(22).integers(0, 2**64, 256, dtype=np.uint64)
_ODD2 = np.random.default_rng(23).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _joined(left: np.ndarray, right: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    h = left[:n] * factor
    h += right[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h


def gram_hashes(data: np.ndarray, size: int, table: np.ndarray = _TABLE, odd: np.ndarray = _ODD) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` bytes, by doubling."""
    powers = [table[data]]
    span = 1
    while span * 2 <= size:
        h = powers[-1]
        n = len(data) - 2 * span + 1
        powers.append(_joined(h, h[span:], n, odd[len(powers)]))
        span *= 2
    out, done = powers[-1], span
    for k in range(len(powers) - 2, -1, -1):
        if size - done >= 1 << k:
            n = len(data) - done - (1 << k) + 1
            out = _joined(out, powers[k][done:], n, odd[20 + k])
            done += 1 << k
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    now, span = h, 1
    while span * 2 <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    return np.minimum(now[: len(h) - width + 1], now[width - span :]) if span < width else now


def segments(data: bytes, length: int, gram: int) -> list[tuple[int, int, int, bool]]:
    """(start, windows, name, whether the name occurs twice in it) of a text's segments."""
    out = []
    whole, width = np.frombuffer(data, np.uint8), length - gram + 1
    for lo in range(0, len(whole) - length + 1, CHUNK):
        part = whole[lo : lo + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        least = sliding_min(h, width)
        cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            name = least[a]
            twice = int(np.count_nonzero(h[a : b + width - 1] == name)) > 1
            out += [(lo + x, min(b, x + LONGEST) - x, int(name), twice) for x in range(a, b, LONGEST)]
    return out


def cores(contents: list[bytes], names: list[int], length: int, gram: int, step: int) -> list[list]:
    """[content, start, windows, core hash, second core hash, bytes before the core, bytes around it, repeated] of runs of windows.

    All windows of a content have its name as their least gram. It first stands in a window at some place; consecutive
    windows for which that place divided by ``step`` is the same number have a core of ``length - step + 1`` bytes in
    common. Runs that follow each other and are equal are one, repeated.
    """
    size, blob = length - step + 1, b"".join(contents)
    data, sizes = np.frombuffer(blob, np.uint8), np.array([len(c) for c in contents])
    bases = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    windows = sizes - length + 1
    which = np.repeat(np.arange(len(contents)), windows)
    starts = np.arange(len(which)) + (bases - np.concatenate([[0], np.cumsum(windows)])[:-1])[which]
    h = gram_hashes(data, gram)
    places = np.flatnonzero(h == np.repeat(np.array(names, np.int64).view(np.uint64), sizes)[: len(h)])
    place = places[np.searchsorted(places, starts)]
    back = (place - starts) // step * step
    core = place - back
    first = np.concatenate([[0], np.flatnonzero((which[1:] != which[:-1]) | (core[1:] != core[:-1]) | (back[1:] != back[:-1])) + 1])
    counts = np.diff(first, append=len(starts))
    one, two = ((gram_hashes(data, size, *t)[core[first]] ^ (back[first].astype(np.uint64) * t[1][50])).view(np.int64).tolist() for t in ((_TABLE, _ODD), (_TABLE2, _ODD2)))
    out: list[list] = []
    for i, a, n, c, x, y in zip(which[first].tolist(), starts[first].tolist(), counts.tolist(), core[first].tolist(), one, two):
        around = blob[a:c] + blob[c + size : a + n - 1 + length]
        if out and out[-1][0] == i and out[-1][3:7] == [x, y, c - a, around]:
            out[-1][2] += n
            out[-1][7] = True
        else:
            out.append([i, a - int(bases[i]), n, x, y, c - a, around, False])
    return out


def finer_cores(one: int, two: int, before: int, around: bytes, step: int, then: int) -> list[list]:
    """As of cores(), for the windows of a core of ``step`` when cut by ``then``: [start, windows, .., bytes around it]."""
    import xxhash

    out = []
    at = 0
    windows = len(around) - step + 2
    while at < windows:
        n = min(windows, before - (before - at) // then * then + 1) - at  # windows that begin as many steps before the core
        left = (before - at) // then * then
        right = step - then - left
        rest = around[at : before - left] + around[before + right : at + n + step - 2]
        h = xxhash.xxh3_128_intdigest(struct.pack("<qqq", one, two, left) + around[before - left : before + right])
        out.append([at, n, _signed(h >> 64), _signed(h & (2**64 - 1)), before - left - at, rest])
        at += n
    return out


def repeated_windows(contents: list[bytes], length: int, marks: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """For each content, which of its windows of ``length`` symbols start in two places of the contents.

    marks: for each content a place and a number; the number's code counts as ``CODE`` symbols before that place.
    """
    if marks is not None:
        contents = [c[:m] + bytes(CODE) + c[m:] for c, (m, _) in zip(contents, marks)]
    sizes = np.array([len(c) for c in contents])
    bases = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(bases[-1])
    text = np.zeros(n, np.int64)  # 0 ends each content
    inside = np.ones(n, bool)
    inside[bases[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(contents), np.uint8)
    text[inside] += 1
    if marks is not None:
        at, number = np.array([m for m, _ in marks]), np.array([k for _, k in marks])
        for k in range(CODE):
            text[bases[:-1] + at + k] = 257 + number // BASE**k % BASE
    order = _suffix_order(text, length + 1)
    tied = _long_prefixes(text, order, length)
    starts = np.zeros(n, bool)
    starts[order[tied[:-1] | tied[1:]]] = True
    return [starts[b : b + max(0, s - length + 1)] for b, s in zip(bases[:-1].tolist(), sizes.tolist())]


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least, by doubling."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key[: n - k if k < n else 0] |= text[k:] << np.int64(9 * (6 - k))
    span = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if span >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        if span < n:
            key[: n - span] += rank[span:] + 1
        span *= 2


def _long_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where suffixes that are neighbours in the order share ``length`` symbols: place i stands between i - 1 and i."""
    n = len(text)
    symbols, code = np.unique(text, return_inverse=True)
    bits = max(1, int(len(symbols) - 1).bit_length())
    now = code[order - 1]  # the transform: the symbol before each suffix
    firsts = np.concatenate([[0], np.cumsum(np.bincount(now, minlength=1 << bits))])[:-1]
    ones, zeros = [], []
    place, codes = np.zeros(1 << bits, np.int64), np.arange(1 << bits)
    for b in range(bits - 1, -1, -1):
        plane = (now >> b) & 1
        ones.append(np.concatenate([[0], np.cumsum(plane)]).astype(np.int32))
        zeros.append(n - int(ones[-1][-1]))
        is_one = plane.astype(bool)
        now = np.concatenate([now[~is_one], now[is_one]])
        before = ones[-1][place]
        place = np.where((codes >> b) & 1, zeros[-1] + before, place - before)
    shift = firsts - place
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):  # strings of length 0, 1, ... length - 1
        symbol = np.zeros(len(lo), np.int64)
        for rank, zero in zip(ones, zeros):
            one_lo, one_hi = rank[lo], rank[hi]
            zero_lo, zero_hi = lo - one_lo, hi - one_hi
            has_zero, has_one = zero_hi > zero_lo, one_hi > one_lo
            symbol = np.concatenate([symbol[has_zero] << 1, (symbol[has_one] << 1) | 1])
            lo = np.concatenate([zero_lo[has_zero], zero + one_lo[has_one]])
            hi = np.concatenate([zero_hi[has_zero], zero + one_hi[has_one]])
        lo, hi = lo + shift[symbol], hi + shift[symbol]
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi] = False
        if not len(lo):
            break
    return unset


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def removed_runs(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows, which are given as ranges (first start, start after the last)."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        end = b - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 32, group_bytes: int = 1 << 18) -> DataFrame:
    """``(id, n_bytes, n_removed, spans ARRAY<STRUCT<start, end>>, kept BINARY)`` for each row.

    Texts count as UTF-8 bytes, a null text as empty. A byte is removed if a string of ``length`` bytes that covers
    it also starts anywhere else, in this text or another; all are judged on the input. spans are the maximal removed
    runs, kept the other bytes. Repeated rows are documents of their own, and so remove each other's long strings.
    Ids may be null; extra columns are ignored; an empty table gives no rows.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    spark = docs.sparkSession
    root, written = fresh_path(spark, "substrings"), []
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("t"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        written.append(name)
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows: list[tuple] = []
            at = []
            for i, text in enumerate(b.column(1)):
                data = _bytes(text.as_py())
                for s, n, name, twice in segments(data, length, gram):
                    h = xxhash.xxh3_128_intdigest(data[s : s + n - 1 + length])
                    rows.append((s, n, _signed(name), _signed(h >> 64), _signed(h & (2**64 - 1)), twice))
                    at.append(i)
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(2).take(took), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "t", "s", "n", "name", "ca", "cb", "twice"])

    found = stored(base.mapInArrow(cut, f"id {kind}, t BIGINT, s BIGINT, n BIGINT, name BIGINT, ca BIGINT, cb BIGINT, twice BOOLEAN"), "segments")
    again = stored(found.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice")).where("times > 1 or twice").select("name"), "names")
    open_ = stored(found.join(again, "name", "left_semi"), "open")
    contents = stored(open_.groupBy("name", "ca", "cb").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"), F.min(F.struct("id", "t", "s", "n")).alias("at")), "contents")
    equal = stored(contents.where("times > 1").select("name", "ca", "cb"), "equal")
    ranges = [open_.join(equal, ["name", "ca", "cb"], "left_semi").select("id", "t", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))]

    groups = contents.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("twice")).where("kinds > 1 or twice").select("name")
    wanted = contents.join(groups, "name").select("name", (F.col("times") == 1).alias("single"), "at.*")
    by_doc = stored(wanted.groupBy("id", "t").agg(F.collect_list(F.struct("name", "single", "s", "n")).alias("wanted")), "wanted")
    holders = base.alias("d").join(by_doc.hint("merge").alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.t") == F.col("w.t"))).select("d.id", "d.t", "d.text", "w.wanted")

    fields = [("name", pa.int64()), ("second", pa.int64()), ("before", pa.int64()), ("around", pa.binary()), ("s", pa.int64()), ("n", pa.int64()), ("single", pa.bool_()), ("whole", pa.bool_())]
    part_schema = f"name BIGINT, second BIGINT, before BIGINT, around BINARY, s BIGINT, n BIGINT, single BOOLEAN, whole BOOLEAN, id {kind}, t BIGINT"

    def made(rows: list[tuple], at: list[int], b: pa.RecordBatch) -> pa.RecordBatch:
        columns, took = list(zip(*rows)) or [()] * len(fields), pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, (_, k) in zip(columns, fields)), b.column(0).take(took), b.column(1).take(took)], names=[*(f for f, _ in fields), "id", "t"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            size = 0

            def done() -> pa.RecordBatch:
                rows, at = [], []
                for i, s, n, one, two, before, around, twice in cores([h[3] for h in held], [h[1]["name"] for h in held], length, gram, steps[0]):
                    k, r, first, _ = held[i]
                    rows.append((one, two, before, around, first + s, n, r["single"] and not twice, r["single"] and twice))
                    at.append(k)
                return made(rows, at, b)

            for i in range(b.num_rows):
                data = _bytes(b.column(2)[i].as_py())
                for r in b.column(3)[i].as_py():
                    held.append((i, r, r["s"], data[r["s"] : r["s"] + r["n"] - 1 + length]))
                    size += len(held[-1][3])
                    if size >= BLOCK_BYTES:
                        yield done()
                        held, size = [], 0
            if held:
                yield done()

    def finer(step: int, then: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, at = [], []
                for i, (one, two, before, around, start, single) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 8)))):
                    for s, n, x, y, left, rest in finer_cores(one, two, before, around, step, then):
                        rows.append((x, y, left, rest, start + s, n, single, False))
                        at.append(i)
                yield made(rows, at, b)

        return run

    def expand(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size, last, number = 0, None, 0

            def done() -> Iterator[pa.RecordBatch]:
                rows = []
                for (*_, s, single, id_, t, _), flags in zip(held, repeated_windows([h[1] for h in held], step - 1 + CODE, [(h[0], h[-1]) for h in held])):
                    if single:
                        rows += [(id_, t, s + a, s + b) for a, b in _runs(flags)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [id_type, pa.int64(), pa.int64(), pa.int64()])], names=["id", "t", "a", "b"])

            for b in batches:
                id_type = b.schema.field("id").type
                for one, two, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if (one, two) != last:
                        number += 1
                        if size >= BLOCK_BYTES or number == BASE**CODE:
                            yield from done()
                            held, size, number = [], 0, 0
                    last = one, two
                    held.append((*row, number))
                    size += len(row[1]) + CODE + 1
            if held:
                yield from done()

        return run

    core, group = ["name", "second"], ["name", "second", "before", "around"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes are much work here, so they are not put together
    steps = [s for s in STEPS if s == 1 or 2 * s + gram <= length]
    cut_parts = holders.mapInArrow(fetch, part_schema)
    for step, then in zip(steps, [*steps[1:], None]):
        parts = stored(cut_parts, f"cores-{step}")
        ranges.append(parts.where("whole").select("id", "t", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b")))
        met = parts.groupBy(*core).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*core)
        parts = stored(parts.join(met, core, "left_semi"), f"met-{step}")
        seen = stored(parts.groupBy(*group).agg(F.count(F.lit(1)).alias("times"), (F.min("single") & (F.count(F.lit(1)) == 1)).alias("single"), F.first(F.struct("id", "t", "s")).alias("at")), f"seen-{step}")
        ranges.append(parts.where("single").join(seen.where("times > 1"), group, "left_semi").select("id", "t", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b")))
        if then is None:
            break  # a core of this step is the window
        kinds = (seen.groupBy(*core).agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("around") + (CODE + 1)).alias("size"))
                 .where("kinds > 1").select(*core, (F.col("size") > group_bytes).alias("large")))
        left = stored(seen.join(kinds, core).select(*core, "before", "around", "large", "single", "at.*"), f"left-{step}")
        blocks = left.where("not large").repartition(tasks, *core).sortWithinPartitions(*core, "id", "t", "s").select(*core, "before", "around", "s", "single", "id", "t")
        ranges.append(blocks.mapInArrow(expand(step), f"id {kind}, t BIGINT, a BIGINT, b BIGINT"))
        large = left.where("large").select("id", "t", *core, "before", "around", "s", "single")
        if not large.limit(1).count():
            break
        cut_parts = large.mapInArrow(finer(step, then), part_schema)

    covered = stored(reduce(DataFrame.unionByName, ranges).groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    for name in written[:-1]:
        discard(spark, f"{root}/{name}")
    rows = base.alias("d").join(covered.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.t") == F.col("c.t")), "left").select("d.id", "d.text", "c.ranges")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, windows_ in zip(b.column(1), b.column(2)):
                data = _bytes(text.as_py())
                runs = removed_runs([(w["a"], w["b"]) for w in windows_.as_py() or ()], length)
                at, parts = 0, []
                for a, e in runs:
                    parts.append(data[at:a])
                    at = e
                parts.append(data[at:])
                sizes.append(len(data))
                kept.append(b"".join(parts))
                gone.append(len(data) - len(kept[-1]))
                spans.append([{"start": a, "end": e} for a, e in runs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(keep, f"{id_col} {kind}, n_bytes BIGINT, n_removed BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, kept BINARY")
