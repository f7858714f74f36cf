"""SimHash near-duplicates by tiled exact comparison.

A text's words give shingles, their hashes a fingerprint of 64 to 256 bits. Equal fingerprints collapse into one
row each, so exact copies, however many, are one node. The distinct fingerprints are dealt into *tiles*, and only
tile pairs that can hold a link are compared, in numpy blocks, by exclusive-or and bit count. Pairs of tiles are
skipped by population counts, and by sizes where a least similarity is asked for:

* For a small radius a tile has the fingerprints whose 16-bit quarters have the same population counts (bytes or half
  bytes, if there are so many fingerprints that the fullest tile would not fit a chunk). Fingerprints within the radius lie
  in tiles whose counts differ by the radius at most in sum, which are a fixed number of tiles.
* With a least similarity ``s`` of the shingle sets, a tile has the rows whose sets agree in two of their least hashes. Sets
  that similar agree in a pair of these with probability ``s * s`` at least, and rows are dealt by so many pairs that one
  pair of sets in ten thousand at ``s`` is missed, and fewer above. So work grows with the rows, not with their square.

A row goes to its own tile as a base row, and to the other tiles that it has to meet as a probe. Base rows and probes of
a large tile are cut into chunks, as many as its rows were counted to need, and a task compares two of these, so it holds
some ten thousand rows whatever the corpus. Inside a task, what population counts of the bytes exclude is skipped
too, and links are reduced to a spanning forest at once, so that a group of many near copies gives no more links
than it has rows. Links are joined into components by large-star / small-star rounds over DataFrames with
checkpoints; neither links nor components nor fingerprints pass through the driver.

With a least similarity the fingerprints only tell what may be similar. Their components are *clusters*; inside each
the sets of distinct shingles are compared themselves, and only pairs with that Jaccard similarity link. A cluster's
rows meet its first row; those that are not similar to it meet the whole cluster, chunk by chunk.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_key

#: Base rows that a tile's chunk aims at, and the sides of a numpy block.
CHUNK_ROWS, STRIP, BLOCK = 16_384, 64, 2_048
#: Rows and shingles that a chunk of a cluster aims at.
CLUSTER_ROWS, CLUSTER_SHINGLES = 1_024, 262_144


def _counted(hashes: np.ndarray, counts: np.ndarray) -> None:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    counts += bits.sum(axis=0, dtype=np.int64)


def _cut(text: str | None, width: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words joined by single spaces, and where each shingle starts and ends in them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return joined, [0] * bool(words), [len(joined)] * bool(words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return joined, starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist()


def distinct_shingles(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """(n, 2) XXH3-128 hashes of a text's different shingles, by the first word, which names a shingle."""
    import xxhash

    joined, first, last = _cut(text, width)
    digest = xxhash.xxh3_128_digest
    parts = [np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(first[lo : lo + 65_536], last[lo : lo + 65_536])]), "<u8") for lo in range(0, len(first), 65_536)]
    hashes = np.concatenate(parts).reshape(-1, 2) if parts else np.zeros((0, 2), np.uint64)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 further bits of each hash (the finisher of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _order(k: int) -> np.uint64:
    """A number that makes the k-th order of hashes."""
    return np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)


def set_fingerprint(text: str | None, width: int, seed: int = 42, words64: int = 4, bands: int = 0) -> tuple[int, ...]:
    """The SimHash of a text's different shingles in up to four 64-bit words, their number, a hash of the set, and a hash of each band.

    A band is the least hashes of the set in two orders.
    """
    import xxhash

    hashes = distinct_shingles(text, width, seed)
    counts, total = np.zeros(64 * words64, np.int64), len(hashes)
    for lo in range(0, total, 65_536):
        part = hashes[lo : lo + 65_536]
        _counted(np.ascontiguousarray(np.hstack([part, _mixed(part)])[:, :words64]), counts)
    least = [int(_mixed(hashes[:, 0] ^ _order(k)).min()) if total else 0 for k in range(2 * bands)]
    pairs = [xxhash.xxh3_64_intdigest(struct.pack("<QQQ", k, *least[2 * k : 2 * k + 2])) for k in range(bands)]
    return (*np.packbits(counts * 2 > total, bitorder="little").view("<u8").tolist(), total, xxhash.xxh3_64_intdigest(np.ascontiguousarray(hashes[:, 0]).tobytes()), *pairs)


def fingerprint(text: str | None, width: int = 3, seed: int = 42, words64: int = 1) -> tuple[int, ...]:
    """The SimHash of a text as 64-bit words, and the number of its shingles last.

    White space is ASCII, A-Z are lower-cased. A bit is set if over half of the shingles' hashes have it: XXH64 for
    one word, XXH3-128 for two. Fewer words than ``width`` are one shingle; without words all is zero.
    """
    import xxhash

    joined, first, last = _cut(text, width)
    if not first:
        return (0,) * (words64 + 1)
    digest = xxhash.xxh64_intdigest if words64 == 1 else xxhash.xxh3_128_digest
    counts, total = np.zeros(64 * words64, np.int64), len(first)
    for lo in range(0, total, 65_536):
        part = [digest(joined[a:b], seed) for a, b in zip(first[lo : lo + 65_536], last[lo : lo + 65_536])]
        _counted(np.array(part, dtype="<u8") if words64 == 1 else np.frombuffer(b"".join(part), "<u8").reshape(-1, 2), counts)
    return (*np.packbits(counts * 2 > total, bitorder="little").view("<u8").tolist(), total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, words64: int = 1) -> DataFrame:
    """``(id, f0[, f1], size)`` for each row; fingerprint words as signed 64-bit integers, size the number of shingles."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [f"f{k}" for k in range(words64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([fingerprint(t.as_py(), width, seed, words64) for t in b.column(1)], dtype=np.uint64).reshape(-1, words64 + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(words64 + 1))], names=["id", *names, "size"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, {', '.join(f'{n} BIGINT' for n in names)}, size BIGINT")


def _row_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text_key(text))


def set_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, words64: int, bands: int) -> DataFrame:
    """``(id, r, f0.., size, node, bands)`` for each row: r names the row, node the set of its different shingles."""
    base = docs.select(F.col(id_col).alias("id"), _row_key(F.col(id_col), F.col(text_col)).alias("r"), F.col(text_col).alias("text"))
    names = [*[f"f{k}" for k in range(words64)], "size", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([set_fingerprint(t.as_py(), width, seed, words64, bands) for t in b.column(2)], dtype=np.uint64).reshape(-1, words64 + 2 + bands).view(np.int64)
            held = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(rows[:, words64 + 2 :]).reshape(-1)), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(rows[:, k]) for k in range(words64 + 2)), held], names=["id", "r", *names, "bands"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, r BIGINT, {', '.join(f'{n} BIGINT' for n in names)}, bands ARRAY<BIGINT>")


#: By the number of parts of a fingerprint: the bits of a count in a tile's name, and the share of evenly spread fingerprints in the fullest tile.
PARTS = {4: (5, 0.197**4), 8: (4, 0.274**8), 16: (3, 0.375**16)}


def _tile(fp: Column, parts: int) -> Column:
    """The population counts of a fingerprint's parts as one number."""
    bits, _ = PARTS[parts]
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for k in range(parts)]
    return reduce(lambda x, y: x + y, [F.shiftleft(c, bits * k) for k, c in enumerate(counts)])


def _later_offsets(radius: int, parts: int = 4) -> list[tuple[int, ...]]:
    """Differences of counts whose absolute values add up to 1..radius, one of each opposite pair."""
    found = set()
    for places in itertools.combinations_with_replacement(range(parts), radius):
        for signs in itertools.product((-1, 0, 1), repeat=radius):
            d = [0] * parts
            for at, sign in zip(places, signs):
                d[at] += sign
            found.add(tuple(d))
    return sorted(d for d in found if d > (0,) * parts)


def _byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1)).astype(np.int16)


class _Forest:
    """Union-find over rows; labels are kept flat between strips so that most known pairs are dropped in numpy."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        new = root[a] != root[b]
        if not new.any():
            return
        pairs = np.unique(np.stack([root[a[new]], root[b[new]]], axis=1), axis=0, return_index=True)[1]
        for x, y in zip(a[new][pairs].tolist(), b[new][pairs].tolist()):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                self.links.append((x, y))
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root = flat
        self.root = root


def tile_links(rows: np.ndarray, base: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs that link the rows of a tile: a spanning forest of all pairs within ``radius`` bits.

    rows: (n, words) fingerprints; base: which of them are base rows, the others are probes.
    Pairs of a base row with any other row are looked at, of two base rows once.
    """
    order = np.lexsort((*_byte_counts(rows).T[::-1], ~base))  # base rows first; like byte counts come together
    rows, base = rows[order], base[order]
    n_base, counts, forest = int(base.sum()), _byte_counts(rows), _Forest(len(rows))
    blocks = [(j, counts[j : j + BLOCK].min(axis=0), counts[j : j + BLOCK].max(axis=0)) for j in range(0, len(rows), BLOCK)]
    for i in range(0, n_base, STRIP):
        x = rows[i : min(i + STRIP, n_base)]
        linked = forest.root[i] if (forest.root[i : i + len(x)] == forest.root[i]).all() else -1
        lo, hi = counts[i : i + len(x)].min(axis=0), counts[i : i + len(x)].max(axis=0)
        for j, b_lo, b_hi in blocks:
            if j + BLOCK <= i or np.maximum(0, np.maximum(lo - b_hi, b_lo - hi)).sum() > radius:
                continue
            y, at = rows[j : j + BLOCK], None
            if linked >= 0 and i:  # of rows linked to all of the strip there is nothing to learn
                at = np.flatnonzero(forest.root[j : j + BLOCK] != linked)
                if not len(at):
                    continue
                y = y[at]
            far = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            far = far.astype(np.uint16) if rows.shape[1] > 3 else far
            for k in range(1, rows.shape[1]):
                far += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            a, b = np.nonzero(far <= radius)
            b = b if at is None else at[b]
            later = b + j > a + i
            if later.any():
                forest.add(a[later] + i, b[later] + j)
    return order[np.array(forest.links, np.int64).reshape(-1, 2)]


#: What names a task: a tile, whether base rows meet probes, and the two chunks compared.
_TASK = ["tile", "side", "i", "j"]


def _by_task(rows: DataFrame, cols: list[str], link) -> DataFrame:
    """``(a, b)`` node pairs from ``(tile, side, i, j, base, node, ..)`` rows, task by task; cols begin with node.

    link: gives index pairs from a task's base marks and its columns; columns of arrays are lists of arrays.
    """

    def column(values: pa.Array):
        if not pa.types.is_list(values.type):
            return values.to_numpy(zero_copy_only=False)
        out = np.empty(len(values), object)
        flat, ends = values.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(values).to_numpy())
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            out[k] = flat[a:b]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[tuple] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            base, node, *more = (np.concatenate(x) for x in zip(*held))
            pairs = link(base, node, *more)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            values = [column(b.column(k)) for k in range(4, b.num_columns)]
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(key[lo]) != current:
                    yield from done()
                    held = []
                current = tuple(key[lo])
                held.append(tuple(v[lo:hi] for v in values))
        if held:
            yield from done()

    dealt = rows.repartition(*_TASK).sortWithinPartitions(*_TASK)
    return dealt.select(*_TASK, "base", *cols).mapInArrow(run, "a BIGINT, b BIGINT")


def _tiled(rows: DataFrame, words64: int, radius: int) -> DataFrame:
    """``(a, b)`` node pairs from ``(tile, side, i, j, base, node, f0..)`` rows, task by task."""
    return _by_task(rows, ["node", *[f"f{k}" for k in range(words64)]], lambda base, node, *fps: tile_links(np.stack(fps, axis=1).view(np.uint64), base, radius))


def _in_chunks(base: DataFrame, probe: DataFrame | None, cols: list[str]) -> DataFrame:
    """The rows of each task. base and probe have the columns n and p: the chunks of base rows and probes in their tile.

    A tile with one of each is one task. Otherwise chunks i <= j of base rows meet (side 0), and each chunk of base rows
    meets each chunk of probes (side 1).
    """
    dealt = lambda df, n: df.withColumn("k", F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    base = dealt(base, "n")
    one = (F.col("n") == 1) & (F.col("p") == 1)
    upto = lambda last: F.sequence(F.lit(0), last.cast("int"))
    rows = lambda df, side, i, j, is_base: df.select("tile", F.lit(side).alias("side"), i.alias("i"), j.alias("j"), F.lit(is_base).alias("base"), *cols)
    k = F.col("k")
    parts = [
        rows(base, 0, k, F.explode(F.sequence(k, (F.col("n") - 1).cast("int"))), True),
        rows(base.where("k > 0"), 0, F.explode(upto(k - 1)), k, False),
    ]
    if probe is not None:
        probe = dealt(probe, "p")
        parts += [
            rows(base.where(~one), 1, k, F.explode(upto(F.col("p") - 1)), True),
            rows(probe.where(~one), 1, F.explode(upto(F.col("n") - 1)), k, False),
            rows(probe.where(one), 0, k, k, False),
        ]
    return reduce(DataFrame.unionByName, parts)


def links_by_counts(nodes: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """``(a, b)`` links that span all pairs of nodes ``(node, f0)`` within ``radius`` bits, tiled by their parts' population counts."""
    if parts is None:
        n = nodes.count()
        parts = next((p for p, (_, share) in PARTS.items() if n * share <= CHUNK_ROWS), max(PARTS))
    bits, _ = PARTS[parts]
    # Names are sums, so tiles whose counts differ have names that differ by a number; what is no tile's name falls out.
    offsets = [sum(x << bits * k if x >= 0 else -(-x << bits * k) for k, x in enumerate(d)) for d in _later_offsets(radius, parts)]
    base = nodes.select("node", "f0", _tile(F.col("f0"), parts).alias("tile"))
    probe = base.select("node", "f0", F.explode(F.transform(F.array(*map(F.lit, offsets)), lambda d: F.col("tile") + d.cast("long"))).alias("tile"))
    sizes = base.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("n"))
    probe = checkpointed(probe.join(sizes, "tile"))  # where there is a tile to meet
    met = probe.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("p"))
    sizes = checkpointed(sizes.join(met, "tile", "left").select("tile", "n", F.coalesce("p", F.lit(1)).alias("p")))
    return _tiled(_in_chunks(base.join(sizes, "tile"), probe.drop("n").join(sizes, "tile"), ["node", "f0"]), 1, radius)


def band_count(similarity: float, missed: float = 1e-4) -> int:
    """How many bands of two least hashes leave the share ``missed`` of pairs with this similarity without a common one."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(missed) / math.log(1 - similarity**2)))


def links_by_bands(nodes: DataFrame, words64: int, radius: int) -> DataFrame:
    """``(a, b)`` links that span the pairs of nodes ``(node, f0.., bands)`` within ``radius`` bits that have a band in common."""
    cols = ["node", *[f"f{k}" for k in range(words64)]]
    dealt = nodes.select(*cols, F.explode("bands").alias("tile"))
    sizes = checkpointed(dealt.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tile", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("n")))
    return _tiled(_in_chunks(dealt.join(sizes, "tile"), None, cols), words64, radius)


def links_by_size(nodes: DataFrame, words64: int, radius: int, similarity: float) -> DataFrame:
    """``(a, b)`` links that span all pairs of nodes ``(node, f0.., size)`` within ``radius`` bits whose sizes allow the similarity."""
    cols = ["node", *[f"f{k}" for k in range(words64)]]
    base = nodes.select(*cols, F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / -math.log(similarity)).cast("int").alias("tile"))
    sizes = checkpointed(base.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("n")))
    before = sizes.select((F.col("tile") + 1).alias("tile"), F.col("n").alias("p"))
    sizes = sizes.join(before, "tile", "left").select("tile", "n", F.coalesce("p", F.lit(1)).alias("p"))
    probe = base.withColumn("tile", F.col("tile") + 1)
    return _tiled(_in_chunks(base.join(sizes, "tile"), probe.join(sizes, "tile"), cols), words64, radius)


def similar_pairs(sets: list[np.ndarray], base: np.ndarray, similarity: float) -> np.ndarray:
    """Index pairs that link the rows of a cluster's task: a spanning forest of all pairs with the Jaccard similarity.

    sets: each row's different shingles; base: which rows are base rows. Base rows meet all rows, probes not each other.
    """
    order = np.argsort(~base, kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark, forest = np.zeros(len(names), bool), _Forest(len(sets))
    for i in range(min(int(base.sum()), len(sets) - 1)):
        mark[ids[starts[i] : starts[i + 1]]] = True
        shared = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        mark[ids[starts[i] : starts[i + 1]]] = False
        found = np.flatnonzero(_similar(shared, sizes[i], sizes[i + 1 :], similarity)) + i + 1
        if len(found):
            forest.add(np.full(len(found), i), found)
    return order[np.array(forest.links, np.int64).reshape(-1, 2)]


def _similar(shared, a, b, similarity: float):
    return shared * (1 + similarity) + 1e-9 >= (a + b) * similarity


def similar_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, similarity: float, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """``(a, b)`` links that span all pairs of nodes of one cluster whose sets of shingles have the Jaccard similarity.

    nodes: ``(node, r)``, the name of one row that has the node's shingles; clusters: ``(node, root)`` without the roots.
    """
    in_cluster = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    wanted = nodes.select("node", "r").join(in_cluster, "node").select("node", "r", "root")
    rows = docs.select(_row_key(F.col(id_col), F.col(text_col)).alias("r"), F.col(text_col).alias("text")).join(wanted, "r").select("node", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [distinct_shingles(t.as_py(), width, seed)[:, 0].view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "root", "hs"])

    # Repeated rows have a name in common; one of them is enough.
    sets = checkpointed(rows.mapInArrow(run, "node BIGINT, root BIGINT, hs ARRAY<BIGINT>").dropDuplicates(["node"]))
    first = sets.where("node = root").select("root", F.col("hs").alias("first"))
    shared = F.size(F.array_intersect("hs", "first"))
    near = checkpointed(sets.join(first, "root").select("node", "root", "hs", _similar(shared, F.size("hs"), F.size("first"), similarity).alias("near")))
    # What is not like the first row meets the whole cluster.
    held = near.groupBy("root").agg(*[F.greatest(F.ceil(F.count_if(c) / CLUSTER_ROWS), F.ceil(F.sum(F.when(c, F.size("hs")).otherwise(0)) / CLUSTER_SHINGLES), F.lit(1)).alias(n)
                                      for n, c in (("n", ~F.col("near")), ("p", F.col("near")))], F.count_if(~F.col("near")).alias("left")).where("left > 0").drop("left")
    open_ = near.join(held, "root").withColumnRenamed("root", "tile")
    tasks = _in_chunks(open_.where("NOT near"), open_.where("near"), ["node", "hs"])
    more = _by_task(tasks, ["node", "hs"], lambda base, node, hs: similar_pairs(hs, base, similarity))
    return near.where("near AND node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: each node of the edges ``(a, b)`` with the least node of its component, which has no row itself.

    Alternates large-star and small-star until the edges are stars around their least nodes.
    """
    current = checkpointed(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    while True:  # each round but the last lowers a label
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        then = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        same = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        changed = same(then) != same(current)
        current = then
        if not changed:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, seed: int = 42,
                    words64: int = 1, similarity: float | None = None) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row.

    Rows link if their fingerprints differ in ``radius`` bits at most. With a similarity, fingerprints are those of the
    different shingles, and rows within the radius link if the Jaccard similarity of these is at least as high; the
    radius should be wide enough for it. component_id is the least id reachable. Null texts and texts without words
    have fingerprint zero and link like any other. Repeated rows stay, each with its component. A null id is never a
    component's id unless the component has no other. Extra columns are ignored; an empty table gives no rows.
    """
    names = [f"f{k}" for k in range(words64)]
    if similarity is not None:
        fps = checkpointed(set_fingerprints(docs, id_col, text_col, width, seed, words64, band_count(similarity)))
        nodes = checkpointed(fps.groupBy("node", *names, "size").agg(F.min("id").alias("least"), F.min("r").alias("r"), F.first("bands").alias("bands")))
        # The similarity of fewer shingles than these to another set is lower, or one.
        clusters = components(links_by_bands(nodes.where(F.col("size") >= math.ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else F.lit(False)), words64, radius))
        found = similar_links(docs, nodes, clusters, similarity, id_col, text_col, width, seed)
    else:
        fps = checkpointed(fingerprints(docs, id_col, text_col, width, seed, words64))
        key = ["f0"] if words64 == 1 else [*names, "size"]
        node = F.col("f0") if key == ["f0"] else F.xxhash64(*key)
        fps = fps.withColumn("node", node)
        nodes = checkpointed(fps.groupBy(*key).agg(F.min("id").alias("least")).withColumn("node", node))
        found = links_by_counts(nodes, radius) if key == ["f0"] else links_by_size(nodes, words64, radius, 0.01)
    stars = components(found)
    linked = nodes.select("node", "least").join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = linked.select("node", "root").join(roots, "root").select("node", "component_id")
    shown = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in reversed(names)])
    return fps.join(by_node, "node").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id is its component's least; all columns stay. Rows that share an id stay together."""
    classes = near_duplicates(docs, id_col=id_col, **how).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = classes.select(F.col(id_col).alias("_keep_id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep_id"]), "left_semi")
