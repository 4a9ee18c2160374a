"""Nearest neighbours by largest inner product, with a forest of hash prefixes.

Each tree gives a vector a string of 64 bits, one for each of its random hyperplanes; the
tree is the sorted array of the strings. The vectors are cut into bands of nearly one norm,
each with a forest of its own. There they are scaled into the unit ball by the largest norm
of the band and lifted onto the sphere by one more component, so that the angle to a query
orders them by inner product.

A query first descends in every tree to its place in the array, next to which are the vectors
that share the longest prefixes with it, and scores those. The 20th best score so far bounds the angle of what is still to be found.
From the angle follows how far all trees must ascend together, until a vector at that angle
shares the prefix of one of them with probability FOUND at least, whatever the number of
vectors. As trees ascend one after the other within a level, the first ones can end a level
above the others. What the prefix covers is then scored, in all its cells. A band whose norms
are too small for the score is left out. The same is done for tables of any size.

The arrays are cut into cells at quantiles of a bounded sample. The vectors of each cell are
scored against blocks of the queries that look into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envtally.llm.storage import written

TREES = 24
BITS = 64
NEIGHBOURS = 20
#: Vectors of a band that the descents of all trees meet, per root of its vectors.
BUDGET = 8
#: Least probability that the ascent meets a vector as near as the last neighbour so far.
FOUND = 0.9
#: Bands of norms per doubling.
BANDS = 2
#: Least queries of a block, and queries per root of the vectors of a band.
BLOCK = 64
BLOCK_PER_ROOT = 2
#: Scores held at once in a cell, and rows handed on at once.
_SCORES = 1 << 21
_ROWS = 1 << 13
#: Least vectors of a cell, and vectors per root of all; MOST_CELLS bounds the cut points.
CELL = 4096
CELL_PER_ROOT = 16
MOST_CELLS = 4096
#: Pieces of a cell; a query in the first or last one looks into the next cell too.
PIECES = 4
#: Sampled vectors for each piece.
SAMPLED = 8
SEED = 7
#: Distinct vectors that a task holds before it hands them on.
_HELD = 1 << 16


def hyperplanes(dim: int) -> np.ndarray:
    """The normals of all trees, for vectors of ``dim`` components and the one that lifts them."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim + 1, TREES * BITS))


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Of rows that are not zero; squares neither overflow nor vanish."""
    largest = np.abs(vectors).max(axis=1)
    return largest * np.linalg.norm(vectors / largest[:, None], axis=1)


def hashes(vectors: np.ndarray, norm: float, query: bool, planes: np.ndarray) -> np.ndarray:
    """A row per vector and a column per tree. ``norm`` is the largest of the band."""
    if query:
        scaled = vectors / _norms(vectors)[:, None]
        lift = np.zeros(len(vectors))
    else:
        scaled = vectors / norm
        lift = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
    bits = np.column_stack([scaled, lift]) @ planes > 0
    packed = np.packbits(bits, axis=1).reshape(len(vectors), TREES, BITS // 8)
    return np.ascontiguousarray(packed).view(">u8").reshape(len(vectors), TREES).astype(np.uint64)


def _usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vec`` of the rows that take part; vec holds the components as doubles."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    takes_part = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Adding 0 turns -0.0 into 0.0, so that equal vectors have equal bytes.
            packed = [(np.array(v, np.float64) + 0.0).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "vec"])

    rows = embeddings.where(F.col("vec_id").isNotNull() & takes_part)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).mapInArrow(
        run, "vec_id long, vec binary"
    )


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``rep, ids, vec, dim`` of each distinct vec of ``rows (vec_id, vec)``.

    ids are the smallest vec_ids that have it, one more than the neighbours asked for, and
    rep is the smallest: no other id can be in a result. Each task keeps that many ids of a
    vector, so a vector that many rows share makes no large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, set[int]] = {}

        def out() -> pa.RecordBatch:
            ids = [sorted(x)[: NEIGHBOURS + 1] for x in found.values()]
            columns = [pa.array(list(found), pa.binary()), pa.array(ids, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["vec", "ids"])

        for batch in batches:
            for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = found.setdefault(vec, set())
                ids.add(vec_id)
                if len(ids) > 16 * NEIGHBOURS:
                    found[vec] = set(sorted(ids)[: NEIGHBOURS + 1])
            if len(found) > _HELD:
                yield out()
                found.clear()
        if found:
            yield out()

    partial = rows.mapInArrow(run, "vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, NEIGHBOURS + 1)
    return partial.groupBy("vec").agg(ids.alias("ids")).select(
        F.get("ids", F.lit(0)).alias("rep"), "ids", "vec", (F.length("vec") / 8).cast("int").alias("dim")
    )


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _with_norm(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = np.array([_norms(np.frombuffer(v, np.float64)[None])[0] for v in batch.column(2).to_pylist()])
            # Rounded, so that vectors scaled to norm 1 are in one band.
            bands = np.rint(BANDS * np.log2(np.minimum(norms, np.finfo(float).max))).astype(np.int32)
            columns = [*batch.columns, pa.array(norms, pa.float64()), pa.array(bands)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "norm", "band"])

    return points.mapInArrow(run, "rep long, ids array<long>, vec binary, dim int, norm double, band int")


def _cells(n: int) -> int:
    """Cells of a tree over ``n`` vectors."""
    return min(MOST_CELLS, max(1, int(n // max(CELL, CELL_PER_ROOT * n**0.5))))


def _cuts(points: DataFrame, sizes: list) -> dict[tuple[int, int], tuple]:
    """(dim, band) -> largest norm, number of vectors, for each tree the cuts between pieces.

    Cuts are (hash, rep): vectors of equal hashes can lie in different pieces. The driver gets
    the hashes, not the vectors, of about SAMPLED * PIECES * MOST_CELLS vectors of a band at
    most: 200 bytes each, whatever their length.
    """
    known = {(dim, band): (norm, min(1.0, SAMPLED * PIECES * _cells(n) / n)) for dim, band, n, norm in sizes if _cells(n) > 1}
    found: dict[tuple[int, int], list] = {}
    if known:
        shared = points.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = {}
            for part, dim in _parts(batches):
                bands, drawn = part.column(4).to_numpy(), part.column(5).to_numpy()
                for band in np.unique(bands).tolist():
                    if (dim, band) not in shared.value:
                        continue
                    norm, rate = shared.value[dim, band]
                    own = part.take(pa.array(np.flatnonzero((bands == band) & (drawn < int(rate * (1 << 30))))))
                    if not own.num_rows:
                        continue
                    if dim not in planes:
                        planes[dim] = hyperplanes(dim)
                    packed = [h.tobytes() for h in hashes(_vectors(own.column(2), dim), norm, False, planes[dim])]
                    columns = [own.column(3), own.column(4), own.column(0), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "band", "rep", "hashes"])

        drawn = F.pmod(F.xxhash64("rep", F.lit("cells")), F.lit(1 << 30)).alias("drawn")
        sample = points.select("rep", "ids", "vec", "dim", "band", drawn)
        for row in sample.mapInArrow(run, "dim int, band int, rep long, hashes binary").collect():
            found.setdefault((row["dim"], row["band"]), []).append((row["rep"], bytes(row["hashes"])))
    out = {}
    for dim, band, n, norm in sizes:
        cuts = None
        if sample := sorted(found.get((dim, band), [])):
            reps = np.array([rep for rep, _ in sample])
            own = np.frombuffer(b"".join(h for _, h in sample), np.uint64).reshape(-1, TREES)
            cells = _cells(n)
            at = np.arange(1, PIECES * cells) * len(sample) // (PIECES * cells)
            cuts = []
            for tree in range(TREES):
                order = np.lexsort((reps, own[:, tree]))
                cuts.append((own[order[at], tree], reps[order[at]]))
        out[dim, band] = (norm, n, cuts)
    return out


def _pieces(found: np.ndarray, reps: np.ndarray, cut: tuple | None) -> np.ndarray:
    """The piece of each (hash, rep): the number of cuts at or below it."""
    if cut is None:
        return np.zeros(len(found), np.int64)
    values, ties = cut
    low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(ties[low[i] : high[i]], reps[i], "right")
    return low


def _ranges(found: np.ndarray, asked: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes, the ranges that share the first ``level`` bits with those asked for."""
    rest = np.broadcast_to(np.asarray(BITS - level, np.uint64), asked.shape)
    mask = np.where(rest >= BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(rest, np.uint64(BITS - 1))) - np.uint64(1))
    return np.searchsorted(found, asked & ~mask, "left"), np.searchsorted(found, asked | mask, "right")


def _descent(found: np.ndarray, asked: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes, the range of ``most`` around the place of each asked for.

    Next to that place are those that share the longest prefixes with it, of any length.
    """
    place, half = np.searchsorted(found, asked, "left"), (most + 1) // 2
    return np.maximum(place - half, 0), np.minimum(place + half, len(found))


def ascent(cosine: np.ndarray) -> np.ndarray:
    """Levels, a column per tree, that meet a vector of that cosine or more with FOUND at least.

    All trees are at one level, but for the first ones, which can be one above. The root of
    the first tree meets every vector; then the others are left out (-1).
    """
    sharing = 1.0 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    least = 1.0 - (1.0 - FOUND) ** (1.0 / TREES)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(sharing)
        upper = np.where(logs < 0, np.floor(np.log(least) / np.minimum(logs, -1e-300)), BITS)
        upper = np.minimum(upper, BITS).astype(np.int64)
        missed, deeper = np.log1p(-(sharing**upper)), np.log1p(-(sharing ** (upper + 1)))
        above = np.ceil((np.log(1.0 - FOUND) - TREES * deeper) / (missed - deeper))
    above = np.where(upper == BITS, TREES, np.clip(np.nan_to_num(above, nan=TREES), 1, TREES))
    levels = upper[:, None] + (np.arange(TREES) >= above[:, None])
    root = upper == 0
    levels[root, 0], levels[root, 1:] = 0, -1
    return levels


def _looks(index: dict, dim: int, values: np.ndarray, reps: np.ndarray, least, planes) -> Iterator[tuple]:
    """``band, tree, at, cells, level, hash`` of what queries look into; at are their rows.

    Without ``least`` it is the descent, and level is less than 0: the negative number of
    vectors to meet in a cell. Else least is the score of the last neighbour so far.
    """
    found = hashes(values, 1.0, True, planes)
    norms = _norms(values)
    for (own, band), (norm, n, cuts) in index.items():
        if own != dim:
            continue
        if least is None:
            levels = np.full((len(reps), TREES), -int(np.ceil(BUDGET * n**0.5 / TREES)))
            asking = np.ones(levels.shape, bool)
        else:
            cosine = least / (norms * norm)
            levels = ascent(cosine)
            asking = (levels >= 0) & (cosine <= 1 + 1e-9)[:, None]
        for tree in range(TREES):
            at = np.flatnonzero(asking[:, tree])
            if not len(at):
                continue
            hash_, level = found[at, tree], levels[at, tree]
            if not cuts:
                yield band, tree, at, np.zeros(len(at), np.int64), level, hash_
                continue
            if least is None:
                piece = _pieces(hash_, reps[at], cuts[tree])
                first = np.maximum(piece - 1, 0) // PIECES
                last = np.minimum(piece + 1, len(cuts[tree][0])) // PIECES
            else:
                rest = np.minimum(BITS - level, BITS - 1).astype(np.uint64)
                mask = np.where(level == 0, ~np.uint64(0), (np.uint64(1) << rest) - np.uint64(1))
                # Vectors of equal hashes can lie on both sides of a cut.
                first = np.searchsorted(cuts[tree][0], hash_ & ~mask, "left") // PIECES
                last = np.searchsorted(cuts[tree][0], hash_ | mask, "right") // PIECES
            for start in range(0, len(at), 256):
                cut = slice(start, start + 256)
                counts = last[cut] - first[cut] + 1
                rows = np.repeat(np.arange(start, start + len(counts)), counts)
                cells = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows]
                yield band, tree, at[rows], cells, level[rows], hash_[rows]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows of each dimension, column 3."""
    for batch in batches:
        dims = batch.column(3).to_numpy()
        for dim in np.unique(dims).tolist():
            yield batch.filter(pa.array(dims == dim)), dim


def _blocks(points: DataFrame, index: dict, first: bool) -> dict[tuple, np.ndarray]:
    """(dim, band, tree) -> for each cell the number of blocks of queries that look into it."""
    shared = points.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, counts = {}, {}
        for part, dim in _parts(batches):
            if dim not in planes:
                planes[dim] = hyperplanes(dim)
            least = None if first else part.column(5).to_numpy()
            for band, tree, _, cells, _, _ in _looks(
                shared.value, dim, _vectors(part.column(2), dim), part.column(0).to_numpy(), least, planes[dim]
            ):
                for cell, n in zip(*(x.tolist() for x in np.unique(cells, return_counts=True))):
                    key = (dim, band, tree, cell)
                    counts[key] = counts.get(key, 0) + n
        if counts:
            columns = [pa.array(c, pa.int32()) for c in zip(*counts)]
            names = ["dim", "band", "tree", "cell", "n"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names)

    keys = ("dim", "band", "tree", "cell")
    asks = points.where(F.col("ask").isNotNull()).select("rep", "ids", "vec", "dim", "band", "ask")
    counted = asks.mapInArrow(run, "dim int, band int, tree int, cell int, n long").groupBy(*keys).agg(F.sum("n"))
    out: dict[tuple, np.ndarray] = {}
    for dim, band, tree, cell, n in counted.collect():
        _, size, cuts = index[dim, band]
        blocks = out.setdefault((dim, band, tree), np.zeros(len(cuts[0][0]) // PIECES + 1 if cuts else 1, np.int64))
        blocks[cell] = -(-n // max(BLOCK, int(BLOCK_PER_ROOT * size**0.5)))
    return out


_PLACED = {
    "dim": "int", "band": "int", "tree": "int", "cell": "long", "block": "long", "hash": "long", "rep": "long",
    "query": "boolean", "level": "long", "least": "double", "ids": "array<long>", "vec": "binary",
}


def _placed(points: DataFrame, index: dict, first: bool) -> DataFrame:
    """A row for each point and block of a cell it is in, for each query and cell it looks into.

    ``points`` has a column ask that is null for all but queries. Cells that no query looks
    into are left out.
    """
    shared = points.sparkSession.sparkContext.broadcast((index, _blocks(points, index, first)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        index, blocks = shared.value
        for part, dim in _parts(batches):
            if dim not in planes:
                planes[dim] = hyperplanes(dim)
            values, reps = _vectors(part.column(2), dim), part.column(0).to_numpy()

            def out(band, tree, at, cells, block, found, query, level, bound):
                for start in range(0, len(at), _ROWS):
                    cut = slice(start, start + _ROWS)
                    own = part.take(pa.array(at[cut]))
                    n = len(own)
                    # Signed, in the same order.
                    signed = (found[cut] ^ np.uint64(1 << 63)).view(np.int64)
                    columns = [
                        *(np.full(n, x, np.int32) for x in (dim, band, tree)), cells[cut].astype(np.int64),
                        block[cut].astype(np.int64), signed, own.column(0), np.full(n, query),
                        level[cut].astype(np.int64), bound[cut], own.column(1), own.column(2),
                    ]
                    columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                    yield pa.RecordBatch.from_arrays(columns, list(_PLACED))

            bands = part.column(4).to_numpy()
            for band in np.unique(bands).tolist():
                norm, _, cuts = index[dim, band]
                rows = np.flatnonzero(bands == band)
                trees = [t for t in range(TREES) if (dim, band, t) in blocks]
                found = hashes(values[rows], norm, False, planes[dim]) if trees else None
                for tree in trees:
                    cells = _pieces(found[:, tree], reps[rows], cuts[tree] if cuts else None) // PIECES
                    copies = blocks[dim, band, tree][cells]
                    at = np.repeat(np.arange(len(rows)), copies)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    none = np.zeros(len(at))
                    yield from out(band, tree, rows[at], cells[at], block, found[at, tree], False, none, none)
            asks = np.flatnonzero(part.column(5).is_valid().to_numpy(zero_copy_only=False))
            if not len(asks):
                continue
            least = None if first else part.column(5).take(pa.array(asks)).to_numpy()
            # Dealt to blocks by a mix of the bits of rep.
            mixed = (reps[asks].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for band, tree, at, cells, level, found in _looks(index, dim, values[asks], reps[asks], least, planes[dim]):
                block = mixed[at].astype(np.int64) % blocks[dim, band, tree][cells]
                bound = np.full(len(at), -np.inf) if first else least[at]
                yield from out(band, tree, asks[at], cells, block, found, True, level, bound)

    schema = ", ".join(f"{n} {kind}" for n, kind in _PLACED.items())
    return points.select("rep", "ids", "vec", "dim", "band", "ask").mapInArrow(run, schema)


_GROUP = ("dim", "band", "tree", "cell", "block")


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)


def _met(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a block: rows of its points by hash, rows of queries, the range of points that each meets."""
    query = table.column("query").to_numpy()
    hash_, level = _unsigned(table.column("hash")), table.column("level").to_numpy()
    items, asked = np.flatnonzero(~query), np.flatnonzero(query)
    items = items[np.argsort(hash_[items], kind="stable")]
    level = level[asked]
    descends = len(level) > 0 and level[0] < 0
    low, high = _descent(hash_[items], hash_[asked], -level) if descends else _ranges(hash_[items], hash_[asked], level)
    return items, asked, low, high


def _count(table: pa.Table) -> pa.Table:
    """For each query in a block, the number of points that it is scored against."""
    _, asked, low, high = _met(table)
    return pa.table({"rep": table.column("rep").take(pa.array(asked)), "scored": pa.array(high - low, pa.int64())})


def _score(table: pa.Table) -> pa.Table:
    """For each query in a block, the best vec_ids of the points that it meets.

    Those below the score of its last neighbour so far cannot be in the result.
    """
    table = table.combine_chunks()
    dim = table.column("dim")[0].as_py()
    reps = table.column("rep").to_numpy()
    vectors = _vectors(table.column("vec").combine_chunks(), dim)
    items, asked, low, high = _met(table)
    points, own_reps = vectors[items], reps[items]
    ids = table.column("ids").take(pa.array(items)).to_pylist()
    bounds = table.column("least").to_numpy()
    most = NEIGHBOURS + 1
    out_query, out_id, out_score = [], [], []
    # Queries of one range are scored together.
    order = np.lexsort((high, low))
    order = order[low[order] < high[order]]
    starts = np.flatnonzero((np.diff(low[order], prepend=-1) != 0) | (np.diff(high[order], prepend=-1) != 0))
    longest = float(_norms(points).max(initial=0.0))
    for group in np.split(order, starts[1:]) if len(order) else []:
        a, b = int(low[group[0]]), int(high[group[0]])
        step = max(1, _SCORES // (b - a))
        for start in range(0, len(group), step):
            rows = asked[group[start : start + step]]
            rough = vectors[rows] @ points[a:b].T
            if b - a > most:
                least = np.maximum(np.partition(rough, b - a - most, axis=1)[:, b - a - most], bounds[rows])
            else:
                least = bounds[rows]
            # Sums of products differ by their order of addition.
            least = least - max(1e-12, 1e-15 * dim) * _norms(vectors[rows]) * longest
            for row, scores, bound in zip(rows.tolist(), rough, least.tolist()):
                near = np.flatnonzero(scores >= bound)
                # One order of addition for each pair, wherever it is scored.
                exact = (points[a:b][near] * vectors[row]).sum(axis=1)
                near, exact = near[exact >= bounds[row]], exact[exact >= bounds[row]]
                best = np.lexsort((own_reps[a:b][near], -exact))[:most]
                pairs = sorted((-float(exact[i]), v) for i in best for v in ids[a + near[i]])[:most]
                out_query += [int(reps[row])] * len(pairs)
                out_score += [-s for s, _ in pairs]
                out_id += [v for _, v in pairs]
    return pa.table(
        {
            "rep": pa.array(out_query, pa.int64()),
            "vec_id": pa.array(out_id, pa.int64()),
            "score": pa.array(out_score, pa.float64()),
        }
    )


def _best(points: DataFrame, index: dict, first: bool) -> DataFrame:
    """``rep, vec_id, score`` of the best in each cell that a query looks into."""
    return _placed(points, index, first).groupBy(*_GROUP).applyInArrow(
        _score, "rep long, vec_id long, score double"
    )


def _scored(points: DataFrame, index: dict, first: bool) -> DataFrame:
    """``rep, scored``: vectors that a query is scored against in each cell it looks into."""
    return _placed(points, index, first).groupBy(*_GROUP).applyInArrow(_count, "rep long, scored long")


def _nearest(scored: DataFrame) -> DataFrame:
    """The best of ``rep, vec_id, score`` for each rep, one more than the neighbours."""
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return (
        scored.groupBy("rep", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= NEIGHBOURS + 1)
        .drop("place")
    )


def _asked(embeddings: DataFrame, every: int) -> tuple[DataFrame, DataFrame, dict]:
    """The distinct vectors; ``query_id, rep`` of the queries; the cells of all trees."""
    rows = _usable(embeddings)
    points = written(_with_norm(distinct_vectors(rows)))
    asked = written(
        rows.where(F.col("vec_id") % every == 0)
        .distinct()
        .join(points.select("vec", "rep"), "vec")
        .select(F.col("vec_id").alias("query_id"), "rep")
    )
    sizes = points.groupBy("dim", "band").agg(F.count(F.lit(1)), F.max("norm")).collect()
    return points, asked, _cuts(points, [tuple(r) for r in sizes])


def _looked(points: DataFrame, asked: DataFrame, index: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the descents find; the points with queries marked for the descent, and for the ascent."""
    askers = asked.select("rep").distinct()
    first = points.join(askers.withColumn("ask", F.lit(0.0)), "rep", "left")
    looked = written(_nearest(_best(first, index, True)))
    # A query's own row may be among the best, so the last of one more bounds its neighbours.
    least = F.when(F.count(F.lit(1)) > NEIGHBOURS, F.min("score")).otherwise(F.lit(float("-inf")))
    bounds = askers.join(looked.groupBy("rep").agg(least.alias("ask")), "rep", "left").select(
        "rep", F.coalesce("ask", F.lit(float("-inf"))).alias("ask")
    )
    return looked, first, written(points.join(bounds, "rep", "left"))


def scored_pairs(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """``query_id, scored``: the vectors that a search scores for each query, repeats counted.

    Descents and ascents count, and a vector as often as trees meet it. Queries of one vector
    share what is scored for it. An empty table gives no rows.
    """
    points, asked, index = _asked(embeddings, every)
    _, first, second = _looked(points, asked, index)
    both = _scored(first, index, True).unionByName(_scored(second, index, False))
    return asked.join(both.groupBy("rep").agg(F.sum("scored").alias("scored")), "rep").select("query_id", "scored")


def search(embeddings: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each row divisible by ``every``.

    ``embeddings`` has vec_id and embedding; other columns are not read. Candidates are all
    rows but the query's own; ties go to the smaller vec_id. Rows whose vec_id is null, or
    whose vector is null, empty, zero or holds a null or a non-finite component, take no
    part. Vectors of different lengths have no inner product and never meet. A query with
    fewer candidates has fewer rows; rows that repeat a vec_id and its vector count once. An
    empty table gives no rows.
    """
    if neighbours > NEIGHBOURS:
        raise ValueError(f"at most {NEIGHBOURS} neighbours")
    points, asked, index = _asked(embeddings, every)
    if not index:
        return asked.select(
            "query_id", F.lit(0).alias("rank"), F.col("rep").alias("vec_id"), F.lit(0.0).alias("score")
        ).limit(0)
    looked, _, second = _looked(points, asked, index)
    ascended = _best(second, index, False)
    found = _nearest(looked.unionByName(ascended))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(found, "rep")
        .where("vec_id != query_id")
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
