"""Least-cost distance and routes over an 8-connected grid, tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.session import discarded, removed, scratch, written

STEPS = [(i, j, math.hypot(i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
INF = math.inf
#: Cells of a square tile's side. A round's task holds about 150 bytes a cell of one tile.
TILE = 1024
#: A tile with a margin of one cell around: costs, distances and numbers of steps, row by row; and the least cost in it.
BLOCK = "tr int, tc int, least double, cost binary, d binary, hops binary"
#: What a round gives: blocks that changed, with the distance of the goal where they hold it, and for each neighbour the border
#: cells that got better, as places in its block, with the least that a path over one of them to the goal costs.
CHANGE = "tr int, tc int, cost binary, d binary, hops binary, goal double, at array<int>, far array<double>, steps array<int>, bound double"
NAMES = [c.split()[0] for c in CHANGE.split(", ")]

Shape = tuple[int, int]


def _shape(cells: DataFrame, tile: int) -> Shape:
    """Rows and columns of a tile: tile x tile cells, longer along one axis where the grid is narrower along the other, so that a ribbon is few tiles, too."""
    e = cells.agg(*[f(c) for c in ("row", "col") for f in (F.min, F.max)]).first()
    if e[0] is None:
        return tile, tile
    height, width = e[1] - e[0] + 1, e[3] - e[2] + 1
    cols = min(tile, width)
    rows = min(tile * tile // cols, height)
    return rows, min(max(cols, tile * tile // rows), width)


def _both(size: int | Shape) -> Shape:
    return size if isinstance(size, tuple) else (size, size)


def _laid_out(size: Shape, sources: list[tuple[int, int]]):
    """Cells (row, col, cost) of a tile and its margin -> its block, unless all of them lie in the margin. A cell that is missing has cost NaN."""
    (rows, cols), side = size, size[1] + 2

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not ((pdf["row"] // rows == key[0]) & (pdf["col"] // cols == key[1])).any():
            return pd.DataFrame(columns=["tr", "tc", "least", "cost", "d", "hops"])
        place = lambda row, col: (row - key[0] * rows + 1) * side + col - key[1] * cols + 1
        cost, d, hops = np.full((rows + 2) * side, np.nan), np.full((rows + 2) * side, INF), np.full((rows + 2) * side, 1 << 30, np.int32)
        cost[place(pdf["row"].to_numpy(), pdf["col"].to_numpy())] = pdf["cost"]
        for r, c in sources:
            if -1 <= r - key[0] * rows <= rows and -1 <= c - key[1] * cols <= cols and not np.isnan(cost[place(r, c)]):
                d[place(r, c)], hops[place(r, c)] = 0.0, 0
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "least": [np.nanmin(cost)], "cost": [cost.tobytes()], "d": [d.tobytes()], "hops": [hops.tobytes()]})

    return run


def _blocks(cells: DataFrame, sources: list[tuple[int, int]], size: int | Shape) -> DataFrame:
    rows, cols = _both(size)
    place = lambda i, j: F.struct(F.floor((F.col("row") + i) / rows).cast("int").alias("tr"), F.floor((F.col("col") + j) / cols).cast("int").alias("tc"))
    border = F.pmod("row", F.lit(rows)).isin(0, rows - 1) | F.pmod("col", F.lit(cols)).isin(0, cols - 1)
    near = F.when(border, F.array_distinct(F.array(*[place(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))).otherwise(F.array(place(0, 0)))
    spread = cells.select("row", "col", F.coalesce("cost", F.lit(INF)).cast("double").alias("cost"), F.explode(near).alias("k"))
    return spread.select("k.tr", "k.tc", "row", "col", "cost").groupBy("tr", "tc").applyInPandas(_laid_out((rows, cols), sources), BLOCK)


def _settle(d: np.ndarray, hops: np.ndarray, edges: np.ndarray, near: np.ndarray, todo: np.ndarray, width: float) -> None:
    """Spread d and hops from the places todo until no step betters a place, in order of distance, those within `width` of the nearest at once.

    Distances are compared first and numbers of steps second, so that predecessors never run in
    a circle, not even over cells without cost. Places bettered again wait again, so width changes
    the time only.
    """
    waits, last = np.zeros(len(d), bool), np.zeros(len(d), np.int32)
    waits[todo] = True
    while todo.size:
        x = d.take(todo)
        soon = x <= x.min() + width
        now, later = todo[soon], todo[~soon]
        waits[now] = False
        n, y = (now[:, None] + near).ravel(), (x[soon][:, None] + edges.take(now, 0)).ravel()
        there = d.take(n)
        better, tie = np.flatnonzero(y < there), np.flatnonzero(y == there)
        if tie.size:
            better = np.concatenate([better, tie[hops.take(now.take(tie >> 3)) + 1 < hops.take(n.take(tie))]])
        n, y, s = n.take(better), y.take(better), hops.take(now.take(better >> 3)) + 1
        order = np.lexsort((-s, -y))  # of several for one place the best comes last, and stays
        n = n.take(order)
        d[n], hops[n] = y.take(order), s.take(order)
        k = np.arange(n.size, dtype=np.int32)
        last[n] = k
        n = n[(last.take(n) == k) & ~waits.take(n)]
        waits[n] = True
        todo = np.concatenate([later, n])


def _relaxed(size: Shape, goal: tuple[int, int] | None, least: float):
    """Least costs within one tile, from the margin's cells that got better (in the first round, from the sources). least is the least cost of any cell."""
    (rows, cols), side = size, size[1] + 2
    pad = side + 1  # so that every place has eight neighbours
    near = np.array([i * side + j for i, j, _ in STEPS])
    margin = np.ones((rows + 2, side), bool)
    margin[1:-1, 1:-1] = False

    def ahead(key: tuple, k: np.ndarray) -> np.ndarray:
        """What is left from places to the goal at least: as many steps as on a plane of the least cost."""
        if goal is None:
            return np.zeros(len(k))
        r, c = np.abs(key[0] * rows + k // side - 1 - goal[0]), np.abs(key[1] * cols + k % side - 1 - goal[1])
        return least * (np.maximum(r, c) + (math.sqrt(2) - 1) * np.minimum(r, c))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, news = pdf[pdf["cost"].notna()].iloc[0], pdf[pdf["at"].notna()]
        cost = np.frombuffer(block["cost"])
        d, hops = np.pad(np.frombuffer(block["d"]), pad, constant_values=INF), np.pad(np.frombuffer(block["hops"], np.int32), pad, constant_values=1 << 30)
        passable = cost < INF
        leave, enter = np.pad(np.where(passable, cost, np.nan), pad, constant_values=np.nan), np.pad(np.where(passable & ~margin.ravel(), cost, np.nan), pad, constant_values=np.nan)
        edges = np.full((len(d), len(STEPS)), np.nan)
        for k, (o, (_, _, length)) in enumerate(zip(near, STEPS, strict=True)):
            edges[pad:-pad, k] = length * (leave[pad:-pad] + enter[pad + o : len(d) - pad + o]) / 2
        before, steps_before = (d.copy(), hops.copy()) if len(news) else (np.full(len(d), INF), np.full(len(d), 1 << 30, np.int32))
        for at, far, steps in zip(news["at"], news["far"], news["steps"], strict=True):
            at = np.asarray(at) + pad
            better = ~np.isnan(leave[at]) & ((far < d[at]) | (far == d[at]) & (steps < hops[at]))
            d[at[better]], hops[at[better]] = far[better], steps[better]
        changed = (d < before) | (d == before) & (hops < steps_before)
        _settle(d, hops, edges, near, np.flatnonzero(changed & ~np.isnan(leave)), float(np.median(cost[passable])) if passable.any() else 0.0)
        changed = ((d < before) | (d == before) & (hops < steps_before))[pad:-pad].reshape(margin.shape) & ~margin
        d, hops, passable = d[pad:-pad], hops[pad:-pad], passable.reshape(margin.shape)
        end = d[(goal[0] - key[0] * rows + 1) * side + goal[1] - key[1] * cols + 1] if goal is not None and (goal[0] // rows, goal[1] // cols) == key else None
        out = [(*key, block["cost"], d.tobytes(), hops.tobytes(), end, None, None, None, None)]
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                ours, theirs = (tuple(slice(None) if not x else slice(a, a + 1) for x, a in ((i, r), (j, c))) for r, c in (((1 if i < 0 else rows), (1 if j < 0 else cols)), ((0 if i < 0 else rows + 1), (0 if j < 0 else cols + 1))))
                if (i or j) and changed[ours].any() and passable[theirs].any():
                    strip = np.zeros(margin.shape, bool)
                    strip[ours] = changed[ours]
                    k = np.flatnonzero(strip)
                    out.append((key[0] + i, key[1] + j, None, None, None, None, (k - (i * rows * side + j * cols)).astype(np.int32), d[k], hops[k], (d[k] + ahead(key, k)).min()))
        return pd.DataFrame(out, columns=NAMES)

    return run


def _fields(cells: DataFrame, sources: list[tuple[int, int]], size: int | Shape, goal: tuple[int, int] | None = None) -> DataFrame:
    """BLOCK rows with final distances; with a goal, final as far as a least-cost path to it needs them.

    Each tile has its folders: its block, and what its neighbours told it since. A round reads those of
    its tiles alone and writes these tiles' blocks anew, with news for their neighbours. The driver
    knows which tiles there are and which folders are theirs, no cell. Of what waits at tiles' borders
    a round takes, with a goal, those tiles that can lie on the cheapest paths to it first; once it
    has been reached, tiles over which no path can cost less are left alone.
    """
    size, spark, base = _both(size), cells.sparkSession, scratch(cells.sparkSession)
    _blocks(cells, sources, size).write.partitionBy("tr", "tc").parquet(f"{base}/round=0")
    first = _read(spark, base, "tr int, tc int, least double", [f"{base}/round=0"]).collect()
    held = {(r["tr"], r["tc"]): [0] for r in first}
    least = min((r["least"] for r in first if r["least"] < INF), default=0.0)
    folders = lambda tiles: [f"{base}/round={n}/tr={t[0]}/tc={t[1]}" for t in tiles for n in held[t]]
    starts = {((r + i) // size[0], (c + j) // size[1]) for r, c in sources for i in (-1, 0, 1) for j in (-1, 0, 1)}
    waiting = {t: 0.0 for t in starts if t in held}
    turn, reached = 0, 0.0 if goal in sources else INF
    while waiting and (low := min(waiting.values())) <= reached * (1 + 1e-12):
        upto = INF if goal is None else min(reached * (1 + 1e-12), low + 2 * max(size) * least)
        active = [t for t, bound in waiting.items() if bound <= upto]
        turn, old = turn + 1, folders(active)
        todo = _read(spark, base, CHANGE, old)
        todo.groupBy("tr", "tc").applyInPandas(_relaxed(size, goal, least), CHANGE).write.partitionBy("tr", "tc").parquet(f"{base}/round={turn}")
        removed(spark, *old)
        for t in active:
            held[t] = [turn]
            del waiting[t]
        for r in _read(spark, base, "tr int, tc int, goal double, bound double", [f"{base}/round={turn}"]).collect():
            t = r["tr"], r["tc"]
            if r["bound"] is None:
                reached = min(reached, INF if r["goal"] is None else r["goal"])
            else:
                waiting[t] = min(waiting.get(t, INF), r["bound"])
                held[t] += [turn] if turn not in held[t] else []
    return _read(spark, base, BLOCK, folders(held)).where("d is not null") if held else spark.createDataFrame([], BLOCK)


def _read(spark: SparkSession, base: str, columns: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(columns).option("basePath", base).parquet(*folders).select(*[c.split()[0] for c in columns.split(", ")])


def _arrays(block: tuple, size: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(x, t).reshape(size[0] + 2, size[1] + 2) for x, t in zip(block, (np.float64, np.float64, np.int32), strict=True))


def _cells(size: Shape):
    """Blocks (tr, tc, cost, d) -> their cells."""
    rows, cols = size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tr, tc, *block in zip(b["tr"], b["tc"], b["cost"], b["d"], strict=True):
                cost, d = (np.frombuffer(x).reshape(rows + 2, cols + 2) for x in block)
                row, col = np.nonzero(~np.isnan(cost[1:-1, 1:-1]))
                yield pd.DataFrame({"row": row + tr * rows, "col": col + tc * cols, "cost": cost[row + 1, col + 1], "d": d[row + 1, col + 1]})

    return run


def cost_distance(cells: DataFrame, sources: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """cells(row, col, cost) -> (row, col, cost, d): least cost from the nearest source; infinite where none is reached.

    A step costs its length (1 or sqrt 2 cells) times the mean of both costs; infinite or NULL
    cost is impassable. A tile is one row, and one task's bounded work. Each round searches the
    tiles whose margin got better in the round before, from those cells alone, and sends what
    got better at their borders to the neighbours, until nothing does: about as many rounds as
    tiles are crossed. A cell is there once, or not at all.
    """
    size = _shape(cells, tile)
    return _fields(cells, sources, size).select("tr", "tc", "cost", "d").mapInPandas(_cells(size), "row int, col int, cost double, d double")


def least_cost(cells: DataFrame, start: tuple[int, int], end: tuple[int, int], tile: int = TILE) -> DataFrame:
    """(row, col, d) of end, as in cost_distance(); tiles that cannot lie on a cheapest path are not searched, and end's tile alone is spelled out."""
    size = _shape(cells, tile)
    at = (F.col("tr") == end[0] // size[0]) & (F.col("tc") == end[1] // size[1])
    found = _fields(cells, [start], size, end).where(at).select("tr", "tc", "cost", "d").mapInPandas(_cells(size), "row int, col int, cost double, d double")
    return found.where((F.col("row") == end[0]) & (F.col("col") == end[1])).select("row", "col", "d")


def _back(cost: np.ndarray, d: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """For each place of a block, flat, the neighbour that a least-cost path comes from; itself in the margin, at sources and where nothing comes.

    Of several it is the one with the fewest steps, then the least row and column; it has one step
    less than the cell itself, so a walk back always ends at a source.
    """
    own, side = cost[1:-1, 1:-1], cost.shape[1]
    best, steps = np.full(own.shape, INF), np.full(own.shape, 1 << 30, np.int32)
    place = np.arange(cost.size).reshape(cost.shape)
    back, came = place.copy(), place[1:-1, 1:-1].copy()
    for i, j, length in STEPS:
        there = slice(1 + i, cost.shape[0] - 1 + i), slice(1 + j, side - 1 + j)
        x, n = d[there] + length * (cost[there] + own) / 2, hops[there] + 1
        better = (x < best) | (x == best) & (n < steps)
        best, steps, came = np.where(better, x, best), np.where(better, n, steps), np.where(better, place[there], came)
    goes = (hops[1:-1, 1:-1] > 0) & np.isfinite(d[1:-1, 1:-1])
    back[1:-1, 1:-1] = np.where(goes, came, place[1:-1, 1:-1])
    return back.ravel()


def _walks(size: Shape, end: tuple[int, int]):
    """Blocks -> (row, col, to_row, to_col, steps) from each cell where a walk back can enter a tile, and from end, to where it leaves the tile
    (steps there included), or to its source."""
    (rows, cols), side = size, size[1] + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tr, tc, *block in zip(b["tr"], b["tc"], b["cost"], b["d"], b["hops"], strict=True):
                cost, d, hops = _arrays(block, size)
                to = _back(cost, d, hops)
                steps = (to != np.arange(to.size)).astype(np.int64)
                while not np.array_equal(to, ahead := to[to]):
                    steps, to = steps + steps[to], ahead
                outside = np.zeros(cost.shape, bool)
                outside[0], outside[-1], outside[:, 0], outside[:, -1] = (cost[s] < INF for s in (0, -1, np.s_[:, 0], np.s_[:, -1]))
                entry = np.zeros(cost.shape, bool)
                for i, j, _ in STEPS:
                    entry[1:-1, 1:-1] |= outside[1 + i : rows + 1 + i, 1 + j : cols + 1 + j]
                if (end[0] // rows, end[1] // cols) == (tr, tc):
                    entry[end[0] - tr * rows + 1, end[1] - tc * cols + 1] = True
                k = np.flatnonzero(entry & np.isfinite(d))
                at = {n: (v // side - 1 + tr * rows, v % side - 1 + tc * cols) for n, v in (("", k), ("to_", to[k]))}
                yield pd.DataFrame({f"{n}{c}": at[n][x] for n in at for x, c in enumerate(("row", "col"))} | {"steps": steps[k]})

    return run


def _spelled_out(size: Shape):
    """A tile's block and the walk's entries into it (with their distance in steps from the end) -> the cells of the walk, in steps from the end."""
    (rows, cols), side = size, size[1] + 2

    def run(key: tuple, blocks: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(entries):
            cost, d, hops = _arrays(blocks.iloc[0][["cost", "d", "hops"]], size)
            back = _back(cost, d, hops)
            for r, c, n in zip(entries["row"], entries["col"], entries["n"], strict=True):
                k = (r - key[0] * rows + 1) * side + c - key[1] * cols + 1
                while 0 < k // side <= rows and 0 < k % side <= cols:
                    out.append((k // side - 1 + key[0] * rows, k % side - 1 + key[1] * cols, n, d[k // side, k % side]))
                    if back[k] == k:
                        break
                    k, n = int(back[k]), n + 1
        return pd.DataFrame(out, columns=["row", "col", "n", "d"])

    return run


def route(cells: DataFrame, start: tuple[int, int], end: tuple[int, int], tile: int = TILE) -> DataFrame:
    """(seq, row, col, d): the cells of one least-cost path from start to end, in order, each a neighbour of the one before.

    Every cell has one predecessor. Tile by tile, each border cell is told where a walk back from
    it leaves the tile; doubling these pointers marks the border cells that the walk from the end
    meets, in rounds that grow with the logarithm of the number of tiles crossed; the tiles that
    it crosses spell out its cells. Tiles that cannot lie on a cheapest path are not searched.
    Empty if unreachable.
    """
    size = _shape(cells, tile)
    field = _fields(cells, [start], size, end)
    tr, tc = F.floor(F.col("row") / size[0]).cast("int"), F.floor(F.col("col") / size[1]).cast("int")
    leaps = written(field.mapInPandas(_walks(size, end), "row int, col int, to_row int, to_col int, steps long"))
    on = written(leaps.where((F.col("row") == end[0]) & (F.col("col") == end[1])).select("row", "col", F.lit(0).cast("long").alias("n")))
    known = on.count()
    while True:
        more = on.join(leaps.where("steps > 0"), ["row", "col"]).select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), (F.col("n") + F.col("steps")).alias("n"))
        grown = written(on.unionByName(more).distinct())
        before, known = known, grown.count()
        if known == before:
            break
        ahead = leaps.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("r2"), F.col("to_col").alias("c2"), F.col("steps").alias("s2"))
        old, leaps = leaps, written(leaps.join(ahead, ["to_row", "to_col"], "left").select("row", "col", F.coalesce("r2", "to_row").alias("to_row"), F.coalesce("c2", "to_col").alias("to_col"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps")))
        discarded(old, on)
        on = grown
    entries = on.select(tr.alias("tr"), tc.alias("tc"), "row", "col", "n")
    crossed = field.join(F.broadcast(entries.select("tr", "tc").distinct()), ["tr", "tc"], "left_semi")
    walk = crossed.groupBy("tr", "tc").cogroup(entries.groupBy("tr", "tc")).applyInPandas(_spelled_out(size), "row int, col int, n long, d double")
    walk = walk.groupBy("row", "col").agg(F.min("n").alias("n"), F.first("d").alias("d"))
    length = on.agg(F.max("n").alias("length"))
    return walk.crossJoin(F.broadcast(length)).select((F.col("length") - F.col("n")).alias("seq"), "row", "col", "d")
