"""The k most similar vectors of every vector by cosine (problem 4).

Block matrix join in two levels. Groups come from spherical k-means on a sample, as many as the square root of the cells; each group is a
block that one task holds, and is cut into cells of a constant size by k-means again. Each block is first joined with itself, which gives
every vector k neighbours and a lower bound; then each vector is sent, as int8, to the blocks of its nearest groups that may hold
something better. Inside a block a vector meets the rows of its nearest cells: the products of int8 tiles give similarities with a bound
of the quantisation error; pairs that survive are narrowed down with four more bits of the query and the float row, then recomputed in
float, and heaps merge the results. A vector is compared with
some thousand rows and some square root of all rows in centres, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialise

#: Index parameters: rows of a cell; rows of the k-means sample for each centre of a group and of a cell; cells that a vector searches in
#: its own block and in another; groups that a vector is sent to besides its own.
PER_CELL, GROUP_SAMPLE, CELL_SAMPLE, OWN_CELLS, OTHER_CELLS, GROUPS = 128, 256, 32, 8, 6, 7


def usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has dim finite numbers, not all of them zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))


def centres(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its first centre."""
    rng = np.random.default_rng(seed)
    mid = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 4096] @ mid.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.add.reduceat(sample[order], begins, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        mid[own[order][begins]] = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), mid[own[order][begins]])
    return mid


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, and the length of the rounding error, of each row of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale.astype(np.float32), np.linalg.norm(x - q * scale[:, None], axis=1).astype(np.float32)


def finer(x: np.ndarray, q: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four more bits of each value (rows of dim / 2 bytes, an odd last value alone), and the length of the error that is left."""
    more = np.rint((x / scale[:, None] - q) * 15).astype(np.int8)
    left = np.linalg.norm(x - refined(q, more, scale), axis=1).astype(np.float32)
    nibble = (more + 8).astype(np.uint8)
    nibble = np.pad(nibble, ((0, 0), (0, nibble.shape[1] % 2)))
    return nibble[:, ::2] << 4 | nibble[:, 1::2], left


def refined(q: np.ndarray, more: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (q + more / np.float32(15)) * scale[:, None]


def unpacked(nibble: np.ndarray, dim: int) -> np.ndarray:
    return np.stack((nibble >> 4, nibble & 15), axis=2).reshape(len(nibble), -1)[:, :dim].astype(np.int8) - 8


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), (len(sims), k))


def _nearest(x: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ mid.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def leaders(x: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k + 1 by name of those that are equal up to 20 bits: no query needs more of them.

    A great many equal vectors, which no bound tells apart, so meet each query as k + 1 rows.
    """
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = (np.rint(x * np.float32(1 << 20)).astype(np.int64).view(np.uint64) * odd).sum(axis=1)
    order = np.lexsort((names, hashed))
    begins = np.flatnonzero(np.diff(hashed[order].astype(np.int64), prepend=hashed[order[0]].astype(np.int64) - 1)) if len(x) else order
    rank = np.arange(len(x)) - np.repeat(begins, np.diff(np.append(begins, len(x))))
    lead = np.zeros(len(x), bool)
    lead[order[rank <= k]] = True
    return lead


class Block:
    """The rows of a block as int8, sorted into cells."""

    def __init__(self, x: np.ndarray):
        self.q, self.scale, self.error = quantise(x)
        cells = max(1, round(len(x) / PER_CELL))
        step = max(1, len(x) // (CELL_SAMPLE * cells))
        self.mid = centres(x[::step], cells) if cells > 1 else x[:1]
        own = _nearest(x, self.mid)
        order = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[order], prepend=-1))
        self.mid = self.mid[own[order][begins]]
        self.cells = np.split(order, begins[1:])
        # the angle around its centre that holds a cell
        near = np.einsum("ij,ij->i", x, self.mid[np.searchsorted(own[order][begins], own)])
        length = np.linalg.norm(self.mid, axis=1)
        self.mid = self.mid / np.maximum(length, 1e-12)[:, None]
        self.angle = np.array([np.arccos(np.clip(near[rows].min() / max(length[i], 1e-12), -1, 1)) for i, rows in enumerate(self.cells)])
        self.compared = 0

    def search(self, q: np.ndarray, scale: np.ndarray, error: np.ndarray, floor: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a row that may belong to the query's k best, by the error bounds of the int8 products.

        floor is the similarity that a row must exceed for each query; own says which row of the block a query is, or -1.
        """
        floor, values = floor.astype(np.float32).copy(), q.astype(np.float32)
        lows = np.full((len(q), k), -2, np.float32)
        far = (values * scale[:, None]) @ self.mid.T
        probes = min(OTHER_CELLS if own is None else OWN_CELLS, len(self.cells))
        order = np.take_along_axis(best := _best(far, probes), np.argsort(-np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
        hits_q, hits_row, hits_high = [], [], []
        for rank in range(probes):
            cell = order[:, rank]
            # no row of the cell can be nearer than this
            nearest = np.cos(np.maximum(0, np.arccos(np.clip(far[np.arange(len(q)), cell], -1, 1)) - self.angle[cell])) + error + 1e-6
            asking = np.flatnonzero(nearest >= floor)
            asking = asking[np.argsort(cell[asking], kind="stable")]
            begins = np.flatnonzero(np.diff(cell[asking], prepend=-1))
            for part in np.split(asking, begins[1:]) if len(asking) else ():
                rows = self.cells[cell[part[0]]]
                data = self.q[rows].astype(np.float32)
                for at in range(0, len(part), 4096):
                    mine = part[at : at + 4096]
                    self.compared += len(mine) * len(rows)
                    sims = (values[mine] @ data.T) * scale[mine, None] * self.scale[rows][None, :]  # the integer products are exact in float
                    if own is not None:
                        sims[own[mine][:, None] == rows[None, :]] = -9
                    slack = error[mine, None] + self.error[rows][None, :] + error[mine, None] * self.error[rows][None, :] + 1e-6
                    low = sims - slack
                    top = low if low.shape[1] <= k else -np.partition(-low, k - 1, axis=1)[:, :k]
                    lows[mine] = -np.partition(-np.concatenate((lows[mine], top), axis=1), k - 1, axis=1)[:, :k]
                    floor[mine] = np.maximum(floor[mine], lows[mine].min(axis=1))
                    high = sims + slack
                    i, j = np.nonzero((high >= floor[mine][:, None]) & (sims > -2))
                    hits_q.append(mine[i]), hits_row.append(rows[j]), hits_high.append(high[i, j])
        if not hits_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        one, row, high = np.concatenate(hits_q), np.concatenate(hits_row), np.concatenate(hits_high)
        keep = high >= floor[one]
        return one[keep], row[keep]


def _first(one: np.ndarray, sims: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Of pairs of a query and a row, those among the k best of the query, best first; equal similarities go by name."""
    order = np.lexsort((names, -sims, one))
    one = one[order]
    begins = np.flatnonzero(np.diff(one, prepend=-1))
    rank = np.arange(len(one)) - np.repeat(begins, np.diff(np.append(begins, len(one))))
    return order[rank < k]


def closer(y: np.ndarray, error: np.ndarray, floor: np.ndarray, x: np.ndarray, one: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Which surviving pairs survive the error of the finer query y alone: the rows x of a block are there in float."""
    sims = np.concatenate([np.einsum("ij,ij->i", y[one[i : i + 65536]], x[row[i : i + 65536]]) for i in range(0, len(one), 65536)]) if len(one) else np.zeros(0, np.float32)
    bar = floor.astype(np.float32).copy()
    best = _first(one, sims, row, k)
    enough = np.bincount(one[best], minlength=len(y)) >= k
    least = np.full(len(y), 2, np.float32)
    np.minimum.at(least, one[best], (sims - error[one] - 1e-6)[best])
    bar[enough] = np.maximum(bar, least)[enough]
    return np.flatnonzero(sims + error[one] + 1e-6 >= bar[one])


def _lists(values: pa.Array, owner: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))), pa.int32()), values)


def neighbours(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, groups: int = GROUPS) -> DataFrame:
    """key, neighbours: array<struct<key, similarity>> of up to k other rows, best first; equal similarities go by key.

    Rows with null, short, long, zero or non-finite vectors take no part; keys must be unique and not null; other columns are not read.
    Equal vectors are neighbours of each other with similarity 1. Fewer than k + 1 usable rows give shorter lists, none gives no rows.
    The sample and the centres of groups grow with the square root of the rows, and so do the rows of a block.
    """
    spark = df.sparkSession
    rows = usable(df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")), "v", dim)
    total = df.count()  # an upper bound from the file footers; it only sets the number of groups
    wanted = max(1, round((total / PER_CELL) ** 0.5))
    drawn = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(GROUP_SAMPLE * wanted).select("v").toArrow()  # so many rows a group
    if not drawn.num_rows:
        return spark.createDataFrame([], "id string, neighbours array<struct<id: string, similarity: float>>").withColumnRenamed("id", key)
    mid = spark.sparkContext.broadcast(centres(_unit(_matrix(drawn.column("v"), dim)), wanted))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _unit(_matrix(part.column("v"), dim))
                yield pa.RecordBatch.from_arrays([part.column("id"), _vectors(x), pa.array(_nearest(x, mid.value).astype(np.int32))], ["id", "v", "group"])

    placed = rows.mapInArrow(assign, "id string, v array<float>, group int")
    # one row a group; a group far above the others, as equal vectors make it, is several blocks
    counted = {r["group"]: r["n"] for r in placed.groupBy("group").agg(F.count("*").alias("n")).collect()}
    most = 4096 + 4 * total // len(mid.value)
    blocks = np.array([-(-counted.get(g, 0) // most) for g in range(len(mid.value))], np.int64)
    first = np.concatenate(([0], np.cumsum(blocks)))
    split = spark.sparkContext.broadcast((blocks, first))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, begin = split.value
        for b in batches:
            g = b.column("group").to_numpy()
            part = b.column("h").to_numpy().view(np.uint64) % np.maximum(counts[g], 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array((begin[g] + part.astype(np.int64)).astype(np.int32))], ["id", "v", "block"])

    placed = placed.withColumn("h", F.xxhash64("id")).mapInArrow(number, "id string, v array<float>, block int")

    def own(t: pa.Table) -> pa.Table:
        """Neighbours inside the block, and the other blocks to search."""
        ids, x = t.column("id").combine_chunks(), _matrix(t.column("v"), dim)
        counts, begin = split.value
        mine = t.column("block")[0].as_py()
        names = np.empty(len(x), np.int64)
        names[np.argsort(np.asarray(ids.to_pylist(), object), kind="stable")] = np.arange(len(x))
        lead = leaders(x, names, k)
        place = np.where(lead, np.cumsum(lead) - 1, -1)
        one, row = Block(x[lead]).search(*quantise(x), np.full(len(x), -2, np.float32), k, place)
        row = np.flatnonzero(lead)[row]
        sims = np.concatenate([np.einsum("ij,ij->i", x[one[i : i + 65536]], x[row[i : i + 65536]]) for i in range(0, len(one), 65536)]) if len(one) else np.zeros(0, np.float32)
        kept = _first(one, sims, names[row], k)
        one, row, sims = one[kept], row[kept], sims[kept]
        floor = np.full(len(x), 2, np.float32)
        np.minimum.at(floor, one, sims)
        floor[np.bincount(one, minlength=len(x)) < k] = -1
        search_block, search_owner = [], []
        for at in range(0, len(x), 4096):
            part, low = x[at : at + 4096], floor[at : at + 4096]
            far = part @ mid.value.T
            home = np.argmax(far, axis=1)
            near = _best(far, groups + 1)
            gap = 1e-9 + ((mid.value[home][:, None, :] - mid.value[near]) ** 2).sum(axis=2)
            margin = far[np.arange(len(part)), home][:, None] - np.take_along_axis(far, near, 1)
            # what lies on the other side of the plane between two centres is farther away than the plane
            may = ((near == home[:, None]) | (margin * margin / gap < 2 - 2 * low[:, None] + 1e-5)) & (low < 1 - 1e-6)[:, None]
            i, j = np.nonzero(may)
            g = near[i, j]
            times = counts[g]
            i, g = np.repeat(i, times), np.repeat(g, times)
            b = begin[g] + np.arange(len(g)) - np.repeat(np.cumsum(times) - times, times)
            keep = b != mine
            search_block.append(b[keep]), search_owner.append(at + i[keep])
        search_block, search_owner = np.concatenate(search_block), np.concatenate(search_owner)
        at = pa.array((mine << 32) + np.arange(len(x)), pa.int64())
        return pa.table({"n": at, "id": ids, "v": _vectors(x), "block": t.column("block"), "lead": pa.array(lead), "near": _lists(ids.take(pa.array(row)), one, len(x)), "sims": _lists(pa.array(sims.astype(np.float32)), one, len(x)), "search": _lists(pa.array(search_block.astype(np.int32)), search_owner, len(x))})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            q, scale, error = quantise(x)
            more, left = finer(x, q, scale)
            sims = b.column("sims").to_pylist()
            floor = np.array([min(s) if len(s) >= k else -1.0 for s in sims], np.float32)
            ask = np.concatenate((q.view(np.uint8), more, np.stack((scale, error, left, floor), axis=1).astype(np.float32).view(np.uint8)), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array([r.tobytes() for r in ask], pa.binary()), b.column("search")], ["n", "ask", "search"])

    home = materialise(placed.groupBy("block").applyInArrow(own, "n bigint, id string, v array<float>, block int, lead boolean, near array<string>, sims array<float>, search array<int>"), "home")
    # a block that many rows ask is held by several tasks, each with a part of the queries; one row a block comes here
    asks = home.select(F.explode("search").alias("block")).groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * most).collect()
    copies = {r["block"]: -(-r["n"] // (4 * most)) for r in asks}
    times = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in copies.items() for x in kv]), F.col("block")), F.lit(1)) if copies else F.lit(1)
    asked = home.filter(F.size("search") > 0).select("n", "v", "sims", "search").mapInArrow(packed, "n bigint, ask binary, search array<int>").select(F.explode("search").alias("block"), "n", "ask").select((F.shiftleft(F.col("block").cast("bigint"), 24) + F.pmod(F.xxhash64("n"), times)).alias("place"), "n", "ask")
    data = home.filter("lead").select("block", "id", "v", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")).select((F.shiftleft(F.col("block").cast("bigint"), 24) + F.col("copy")).alias("place"), "id", "v")
    both = data.unionByName(asked, allowMissingColumns=True)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a block come first, then its queries, batch by batch: the pairs that survive, with the row's vector."""
        here, held, block = None, [], None
        for b in batches:
            place = b.column("place").to_numpy()
            is_row = np.asarray(b.column("id").is_valid())
            change = np.flatnonzero((np.diff(place) != 0) | (is_row[1:] != is_row[:-1])) + 1
            for start, end in zip([0, *change], [*change, len(place)], strict=True):
                part = b.slice(start, end - start)
                if place[start] != here:
                    here, held, block = place[start], [], None
                if is_row[start]:
                    held.append(part.select(["id", "v"]))
                    continue
                if not held:
                    continue
                if block is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    x = _matrix(rows.column("v"), dim)
                    block = Block(x)
                raw = np.frombuffer(b"".join(part.column("ask").to_pylist()), np.uint8).reshape(len(part), -1)
                q, more, (scale, error, left, floor) = raw[:, :dim].view(np.int8), raw[:, dim:-16], np.ascontiguousarray(raw[:, -16:]).view(np.float32).T
                one, row = block.search(q, scale, error, floor, k)
                kept = closer(refined(q, unpacked(more, dim), scale), left, floor, x, one, row, k)
                one, row = one[kept], row[kept]
                for at in range(0, len(one), 20_000):
                    there = rows.take(pa.array(row[at : at + 20_000])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(part.column("n").to_numpy(zero_copy_only=False).astype(np.int64)[one[at : at + 20_000]]), there.column("id").combine_chunks(), there.column("v").combine_chunks()], ["n", "other", "w"])

    parts = max(2 * spark.sparkContext.defaultParallelism, 3 * int(blocks.sum()))
    survivors = both.repartition(parts, "place").sortWithinPartitions("place", F.col("id").isNull()).mapInArrow(tile, "n bigint, other string, w array<float>")
    extra = survivors.groupBy("n").agg(F.collect_list(F.struct("other", "w")).alias("extra"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float32())]))
        for b in batches:
            x = _matrix(b.column("v"), dim)
            more = b.column("extra")
            sizes = np.asarray(more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = more.flatten()
            exact = np.einsum("ij,ij->i", _matrix(flat.field("w"), dim), np.repeat(x, sizes, axis=0)) if len(flat) else np.zeros(0)
            others, ends, out = flat.field("other").to_pylist() if len(flat) else [], np.cumsum(sizes), []
            for i, (near, sims) in enumerate(zip(b.column("near").to_pylist(), b.column("sims").to_pylist(), strict=True)):
                heap = [(-s, n) for n, s in zip(near, sims, strict=True)]
                heap += [(-float(exact[j]), others[j]) for j in range(ends[i] - sizes[i], ends[i])]
                out.append([{"id": n, "similarity": -s} for s, n in heapq.nsmallest(k, heap)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "neighbours"])

    joined = home.select("n", "id", "v", "near", "sims").join(extra, "n", "left")
    return joined.mapInArrow(merge, "id string, neighbours array<struct<id: string, similarity: float>>").withColumnRenamed("id", key)


def neighbour_pairs(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5) -> DataFrame:
    """id_a, id_b, id_a < id_b: pairs of rows where one is among the k most similar of the other."""
    near = neighbours(df, key, vector, dim, k).select(F.col(key).alias("one"), F.explode("neighbours").alias("n"))
    return near.select(F.least("one", "n.id").alias("id_a"), F.greatest("one", "n.id").alias("id_b")).distinct()
