"""SimHash near-duplicates by tiled exact comparison.

``near_duplicates`` links fingerprints; ``similar`` links texts by the similarity of their shingles, see there. In both, a pair is
compared by numpy exclusive-or and bit counts, tile by tile.

Rows with equal fingerprints are one class from the start. Two of the distinct fingerprints that differ in at most
``radius`` bits agree wholly in one of ``radius + 1`` bit ranges, so each is dealt to one block for each range. In a
block, fingerprints are sorted by population count and cut into tiles; a pair of tiles is compared by numpy
exclusive-or and bit counts unless their population counts differ by more than the radius, which proves that no pair of them
is linked. A block gives a spanning forest of its links, not its pairs. Blocks of more than ``BLOCK`` fingerprints are dealt
out as pairs of sub-blocks over many tasks. All comparisons are exact: no link is lost at any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planeweave.llm.common import bounded, cut_lineage, free_name, join_by, split_by, utf8_column
from planeweave.llm.components import components

SEED = 42
#: Fingerprints compared with each other in one task at most; beyond, pairs of sub-blocks of half that size.
BLOCK = 4096
TILE = 256
#: Texts whose shingles are counted together.
GROUP = 128
#: Minima in a band, and bands, by which texts of a similarity of 0.8 meet: all but three in a million of them in one band at least.
ROWS, BANDS = 4, 24
#: Bits in which the fingerprints of texts of that similarity may differ: 10 on average; of the shortest texts, 12, and more than 28 for one in a million.
NEAR = 28
#: Shingles of the texts compared with each other in one task, about; of a longer text, all.
SHINGLES = 1 << 21
#: Members of a set that are looked up in a tile at once.
MEMBERS = 4096
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is x20 and x09 to x0D
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes: bit b is set if it is set in over half of them; none give zero."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(hashes), np.uint64)
    if not len(full):
        return out
    h = np.concatenate([hashes[i] for i in full])
    begin = np.concatenate([[0], np.cumsum(sizes[full])])
    # byte lanes hold sums of up to 255 rows
    runs = [np.arange(a, b, 255) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    of_doc = np.concatenate([[0], np.cumsum([len(r) for r in runs])])[:-1]
    starts = np.concatenate(runs)
    counts = np.empty((len(full), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        counts[:, :, k] = np.add.reduceat(lanes.astype(np.int64), of_doc, axis=0)
    bits = counts.reshape(-1, 64) * 2 > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long with the same bits."""
    out = pa.schema([(id_col, pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            texts = utf8_column(batch, text_col)
            found = [fingerprints_of([shingle_hashes(t, width) for t in texts[i : i + GROUP]]) for i in range(0, len(texts), GROUP)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], schema=out)

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} long, fp long")


class _Forest:
    """Roots of a block's rows; links are taken in tile by tile."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        if not pairs.shape[1]:
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for x, y in pairs.T.tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        moved = np.arange(len(self.root))
        for x in list(parent):
            moved[x] = find(x)
        self.root = moved[self.root]


def tiled_links(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (two arrays) of the links among ``fps`` (uint64). side: only rows of different sides are compared."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int16)
    side = None if side is None else side[order]
    forest = _Forest(len(fps))
    for i in range(0, len(fps), TILE):
        a = fps[i : i + TILE]
        top = counts[min(i + TILE, len(fps)) - 1]
        for j in range(i, len(fps), TILE):
            if counts[j] - top > radius:
                break  # this tile's counts, and those of all after it, are too large
            b = fps[j : j + TILE]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if side is not None:
                near &= side[i : i + TILE][:, None] != side[j : j + TILE][None, :]
            x, y = np.nonzero(near)
            if len(x):
                forest.link(x + i, y + j)
    moved = np.flatnonzero(forest.root != np.arange(len(fps)))
    return fps[moved], fps[forest.root[moved]]


def _block_links(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, fp) come sorted by block; a block is compared when its last row is there."""
    rest: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(rows[0])) + 1
        found = []
        for a, b in zip([0, *cuts], [*cuts, rows.shape[1]], strict=True):
            if b - a > 1:
                side = rows[1, a:b]
                found.append(tiled_links(rows[2, a:b].view(np.uint64), radius, None if side[0] == side[-1] == -1 else side))
        if found:
            yield pa.record_batch({k: pa.array(np.concatenate([f[i] for f in found]).view(np.int64)) for i, k in enumerate("ab")})

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if not rows.shape[1]:
            continue
        if rest and rest[0][0, 0] == rows[0, -1]:
            rest.append(rows)  # the block goes on
            continue
        rows = np.concatenate([*rest, rows], axis=1)
        last = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1 if rows[0, 0] != rows[0, -1] else 0
        if last:
            yield from links(np.ascontiguousarray(rows[:, :last]))
        rest = [np.ascontiguousarray(rows[:, last:])]
    if rest:
        yield from links(np.ascontiguousarray(np.concatenate(rest, axis=1)))


def dealt(rows: DataFrame, by: list[str], parts: Column, key: Column) -> DataFrame:
    """``rows`` with ``block`` and ``side``: those alike in ``by`` meet in one block, or, if ``parts`` is over 1, each two of them in a
    block of a pair of parts, where only rows of different sides are to be compared."""
    sub = F.pmod(F.xxhash64(key), parts)
    none = F.lit(-1).cast("long")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.struct(F.least(sub, o).alias("lo"), F.greatest(sub, o).alias("hi"), F.when(o == sub, none).otherwise(sub).alias("side")))
    whole = F.array(F.struct(none.alias("lo"), none.alias("hi"), none.alias("side")))
    rows = rows.withColumn("_pair", F.explode(F.when(parts > 1, pair).otherwise(whole)))
    return rows.withColumns({"block": F.xxhash64(*by, "_pair.lo", "_pair.hi"), "side": F.col("_pair.side")}).drop("_pair")


def links(classes: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp`` that connect all that lie within ``radius`` bits, directly or by others."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    ranges = [(int(lo), (1 << int(hi - lo)) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    parts = F.array(*(F.struct(F.lit(k).alias("part"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask)).alias("bits")) for k, (lo, mask) in enumerate(ranges)))
    rows = classes.select("fp", F.explode(parts).alias("p")).select("fp", "p.part", "p.bits")
    large = rows.groupBy("part", "bits").agg(F.count("*").alias("n")).where(F.col("n") > block)
    rows = rows.join(large, ["part", "bits"], "left")
    # a large block is compared as pairs of sub-blocks: each row goes to the pairs that its sub-block is in
    rows = dealt(rows, ["part", "bits"], F.coalesce(F.ceil(F.col("n") / F.lit(block // 2)), F.lit(1)).cast("long"), F.col("fp"))
    rows = rows.select("block", "side", "fp")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _block_links(it, radius), "a long, b long")


def _with_component(docs: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``docs`` (with ``key``) and component_id, from classes (key, low, n) and what ``components`` found of their links."""
    linked = cut_lineage(classes.join(found.withColumnRenamed("node", key), key).select(key, "low", "root"))
    sizes = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_keys"))
    n = linked.count()
    of_linked = join_by(linked, sizes, "root", "n_keys", n, n).select(key, "component_id")
    of_class = cut_lineage(classes.join(of_linked, key, "left").select(key, "n", F.coalesce("component_id", "low").alias("component_id")))
    rows, keys = of_class.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return join_by(docs, of_class, key, "n", rows, keys)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``df``: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable).

    A null, empty or blank text has fingerprint zero and is linked like any other; a text of any length is read whole. A null id
    counts for no component_id. Repeated rows and equal texts share a class; a repeated id is returned as often as it comes. An
    empty table gives no rows; further columns, whatever their names, are left out.
    """
    docs = cut_lineage(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", width))
    classes = cut_lineage(docs.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    found = components(links(classes.select("fp"), radius, block))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _with_component(docs, classes, found, "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


# --- by similarity ------------------------------------------------------------------------------------------

_MULTIPLY = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(SEED + 1).integers(0, 1 << 63, ROWS * BANDS, np.int64).astype(np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def key_of(shingles: np.ndarray) -> int:
    """A number that tells sets of shingles apart: among 5e10 texts some seventy pairs of 1e21 share one by chance."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def bands_of(shingles: np.ndarray) -> list[int]:
    """A number for each band, alike with the probability of the sets' similarity to the power of ``ROWS``. No shingles, no bands."""
    if not len(shingles):
        return []
    least = np.empty(ROWS * BANDS, np.uint64)
    for i in range(0, ROWS * BANDS, ROWS):
        least[i : i + ROWS] = (shingles[None, :] * _MULTIPLY[i : i + ROWS, None] + _ADD[i : i + ROWS, None]).min(axis=1)
    return [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, ROWS * BANDS, ROWS)]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ordered sets have a Jaccard similarity of at least ``similarity``."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class _Tile:
    """Sets of a tile by their members, so that one set is held against all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        rows = np.repeat(np.arange(self.n), [len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.rows, values = rows[order], values[order]
        self.starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.values, self.ends = values[self.starts], np.append(self.starts[1:], len(values))

    def shared(self, one: np.ndarray) -> np.ndarray:
        """How many members each set has in common with ``one``, an ordered set."""
        out = np.zeros(self.n, np.int64)
        if not len(self.values):
            return out
        at = np.minimum(np.searchsorted(self.values, one), len(self.values) - 1)
        at = at[self.values[at] == one]
        for i in range(0, len(at), MEMBERS):  # a member is in each set once at most, so what is gathered is bounded
            begin, size = self.starts[at[i : i + MEMBERS]], (self.ends - self.starts)[at[i : i + MEMBERS]]
            place = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            out += np.bincount(self.rows[place], minlength=self.n)
        return out


def similar_links(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(i, j) for each text that is linked, directly or by others, to text j, one for all that are: those whose fingerprints lie
    within ``radius`` and whose sets are alike are."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int16)
    side = None if side is None else side[order]
    sizes, root = np.array([len(sets[i]) for i in order], np.int64), np.arange(len(fps))
    for i in range(0, len(fps), TILE):
        top = counts[min(i + TILE, len(fps)) - 1]
        for j in range(i, len(fps), TILE):
            if counts[j] - top > radius:
                break
            near = np.bitwise_count(fps[i : i + TILE, None] ^ fps[None, j : j + TILE]) <= radius
            if side is not None:
                near &= side[i : i + TILE, None] != side[None, j : j + TILE]
            a, b = sizes[i : i + TILE, None], sizes[None, j : j + TILE]
            near &= np.minimum(a, b) >= similarity * np.maximum(a, b)
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            apart = (x < y) & (root[x] != root[y])  # what is linked already needs no comparison
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            held = np.unique(y)
            tile = _Tile([sets[k] for k in order[held]])
            for one, begin in zip(*np.unique(x, return_index=True), strict=True):
                others = y[begin : np.searchsorted(x, one, side="right")]
                others = others[root[others] != root[one]]
                if not len(others):
                    continue
                both = tile.shared(sets[order[one]])[np.searchsorted(held, others)]
                for other in others[both >= similarity * (sizes[one] + sizes[others] - both) - 1e-9].tolist():
                    if root[one] != root[other]:
                        root[root == root[other]] = root[one]
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return list(zip(order[moved].tolist(), order[root[moved]].tolist(), strict=True))


def _similar_in_blocks(batches: Iterable[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, key, fp, shingles) come sorted by block; a block is compared when its last row is there."""
    block, held = None, []

    def links_of() -> pa.RecordBatch:
        sides = np.array([r[0] for r in held])
        found = similar_links(np.array([r[2] for r in held], np.int64).view(np.uint64), [r[3] for r in held], radius, similarity, None if sides[0] == sides[-1] == -1 else sides)
        return pa.record_batch({"a": pa.array([held[i][1] for i, _ in found], pa.int64()), "b": pa.array([held[j][1] for _, j in found], pa.int64())})

    for batch in batches:
        blocks, sides, keys, fps = (batch.column(i).to_pylist() for i in range(4))
        sets = batch.column(4)
        ends, values = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for i, b in enumerate(blocks):
            if b != block:
                if len(held) > 1:
                    yield links_of()
                block, held = b, []
            held.append((sides[i], keys[i], fps[i], values[ends[i] : ends[i + 1]].copy()))
    if len(held) > 1:
        yield links_of()


def _keyed(df: DataFrame, text_col: str, width: int, more: list[T.StructField], told) -> DataFrame:
    """``df`` with the columns ``more``, which ``told`` gives as lists for the sets of shingles of many texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            columns = told([shingle_set(t, width) for t in utf8_column(batch, text_col)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in more)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def _fps(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *(fingerprints_of(sets[i : i + GROUP]) for i in range(0, len(sets), GROUP))]).view(np.int64))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = NEAR, shingles: int = SHINGLES) -> DataFrame:
    """One row for each row of ``df``: id_col, key (a number, alike for texts of the same shingles), component_id.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or more; component_id is
    the smallest id reachable. At that similarity fingerprints differ in some ten bits, and 25 bit ranges would bring all texts
    together, so texts meet by the minima of their hashed shingles (``BANDS`` bands of ``ROWS``) instead. What meets, directly or by
    others, is one block, to which each different text sends its shingles once; there, pairs are compared tile by tile as
    fingerprints, and as sets if those lie within ``radius`` and the texts aren't linked yet. Blocks of more than ``shingles``
    shingles are dealt out as pairs of parts.

    A null, empty or blank text has no shingles and is like any other such text; a text under ``width`` words has one. Texts of any length are
    read whole. A null id counts for no component_id. Repeated rows share a class and are returned each; an empty table gives no rows;
    further columns, whatever their names, are left out.
    """
    bare = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key, fp, sizes = T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.LongType())
    bands = T.StructField("bands", T.ArrayType(T.LongType()))
    met = _keyed(bare, "text", width, [key, sizes, bands], lambda sets: [pa.array(map(key_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(bands_of, sets), pa.list_(pa.int64()))])
    docs = cut_lineage(met.select("id", "key", "size", "bands"))
    classes = cut_lineage(docs.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    total = classes.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    rows = classes.select("key", F.explode("bands").alias("band"))
    first = cut_lineage(rows.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1"))
    stars = join_by(rows, first, "band", "n", total).where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    grouped = cut_lineage(classes.join(components(stars).withColumnRenamed("node", "key"), "key").select("key", "low", "size", "root"))
    n = grouped.count()
    weights = grouped.groupBy("root").agg(F.count("*").alias("n"), F.ceil(2 * F.sum("size") / F.lit(shingles)).alias("parts"))
    parts = F.when(F.col("parts") > 2, F.col("parts")).otherwise(1).cast("long").alias("parts")
    wanted = cut_lineage(join_by(grouped, weights, "root", "n", n, n).select("key", "low", "root", parts))
    _, asked = split_by(bare, wanted.select("low"), n, F.col("id"))
    sets = _keyed(asked, "text", width, [key, fp, T.StructField("shingles", T.ArrayType(T.LongType()))], lambda sets: [pa.array(map(key_of, sets), pa.int64()), _fps(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))])
    # of repeated rows each partition sends one
    sets = sets.groupBy("id", "key").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    joined = sets.join(wanted.withColumnRenamed("low", "id"), ["id", "key"])
    blocks = dealt(joined, ["root"], F.col("parts"), F.col("key")).select("block", "side", "key", "fp", "shingles")
    found = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _similar_in_blocks(it, radius, similarity), "a long, b long")
    return _with_component(docs.select("id", "key"), classes.select("key", "low", "n"), components(found), "key").select(F.col("id").alias(id_col), "key", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of the rows of ``df`` whose texts are linked by ``similar``, directly or by others, the one with the smallest id, with its columns.

    Of rows with that id and text, one stays: repeated rows go. A row without an id stays. Null and empty texts are alike, so one of
    them stays. An empty table gives no rows; columns of any name are kept as they are. Only rows that may go are shuffled: see
    ``split_by``.
    """
    told = similar(df, id_col, text_col, width, similarity).select(F.col(id_col).alias("id"), "key", "component_id").where("id IS NOT NULL")
    found = told.groupBy("id", "key").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    odd = cut_lineage(found.where("component_id < id OR n > 1").select("id", "key", (F.col("component_id") < F.col("id")).alias("goes")))
    later = odd.where("goes").select("id", "key")
    kept, asked = split_by(df, odd.select("id"), odd.count(), F.col(f"`{id_col}`").cast("long"))
    name = free_name(df, "_key")
    keyed = _keyed(asked, text_col, width, [T.StructField(name, T.LongType())], lambda sets: [pa.array(map(key_of, sets), pa.int64())])
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    one = keyed.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(name).alias("key"), row, F.xxhash64(F.col(f"`{text_col}`")).alias("order"))
    one = one.groupBy("id", "key").agg(F.min_by("row", "order").alias("row")).join(later, ["id", "key"], "left_anti")
    return kept.unionByName(one.select("row.*"))
