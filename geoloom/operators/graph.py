"""Networks: components, routes within a bound, pruning, welding, map matching, line order and simplification."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.sources.tables import cut

# Fixed values of map matching, in metres: spacing of samples, spread of positions, search radius, cost of leaving roads.
STEP_M, SIGMA_M, BETA_M, RADIUS_M, OFF_M, SWITCH, MOST_CANDIDATES = 10.0, 8.0, 8.0, 40.0, 24.0, 4.0, 8


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the least node of its component.

    Each round a node takes the least root among its neighbours, then that root's own root, so a chain of n nodes takes
    about log n rounds. Lineages are cut, and nothing but whether a round changed anything goes to the driver."""
    ends = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = ends.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        stepped = roots.join(near, "node").select("node", F.least("root", "r").alias("r"), "root")
        jump = roots.select(F.col("node").alias("r"), F.col("root").alias("further"))
        new = cut(stepped.join(jump, "r", "left").select("node", F.least("r", F.coalesce("further", "r")).alias("root"), F.col("root").alias("old")))
        roots = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return roots


def routes_within(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, cost) of the cheapest route of at most `hops` edges (a, b, cost; both ways) from each source node.

    A frontier of improved nodes is joined with the edges each round, so a round costs what it improves."""
    both = cut(edges.select("a", "b", "cost").union(edges.select("b", "a", "cost")).groupBy("a", "b").agg(F.min("cost").alias("cost")))
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("total"))
    frontier = best
    for _ in range(hops):
        reached = frontier.join(both.withColumnRenamed("a", "node"), "node").groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("total") + F.col("cost")).alias("new"))
        frontier = cut(reached.join(best, ["source", "node"], "left").where("total is null or new < total").select("source", "node", F.col("new").alias("total")))
        if frontier.isEmpty():
            break
        best = cut(best.join(frontier.select("source", "node", F.lit(True).alias("better")), ["source", "node"], "left_anti").unionByName(frontier))
    return best.select("source", "node", F.col("total").alias("cost"))


def pruned(edges: DataFrame, stub: float) -> DataFrame:
    """Edges (id, a, b, length) without dangling ones shorter than stub, round by round until none is left."""
    left = cut(edges)
    while True:
        degree = left.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        loose = degree.where("degree = 1").select("node")
        gone = _touching(left.where(F.col("length") < stub), loose)
        if gone.isEmpty():
            return left
        left = cut(left.join(gone.select("id"), "id", "left_anti"))


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select("id", F.explode(F.array("a", "b")).alias("node"))
    return edges.join(ends.join(nodes, "node", "left_semi").select("id").distinct(), "id", "left_semi")


def welded(edges: DataFrame) -> DataFrame:
    """(id, route): lines (id, kind, a, b) end to end as one route where exactly two of a kind meet and no third does."""
    ends = edges.select("id", "kind", F.explode(F.array("a", "b")).alias("node"))
    two = ends.groupBy("kind", "node").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2 and a <> b")
    roots = components(two.select("a", "b"))
    return edges.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("route"))


def simplified(vertices: DataFrame, line: str, tolerance: float) -> DataFrame:
    """Vertices (line, seq, x, y) that Douglas and Peucker's rule keeps: ends, and the farthest of each stretch over tolerance.

    A line is simplified whole, in one task; of equally far points that nearest the stretch's middle is taken."""
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        p = pdf[["x", "y"]].to_numpy(float)
        kept, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
        kept[[0, -1]] = True
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, own = p[b] - p[a], p[a + 1 : b] - p[a]
            t = np.clip((own @ d) / (d @ d), 0, 1) if d @ d > 0 else np.zeros(len(own))
            far = ((own - t[:, None] * d) ** 2).sum(axis=1)
            if far.max() > tolerance**2:
                ties = np.flatnonzero(far == far.max()) + a + 1
                worst = int(ties[np.abs(ties - (a + b) / 2).argmin()])
                kept[worst] = True
                todo += [(a, worst), (worst, b)]
        return pdf[kept]

    columns = vertices.select(line, "seq", "x", "y")
    return columns.groupBy(line).applyInPandas(keep, columns.schema)


def plotting_order(ends: DataFrame, sheet: str) -> DataFrame:
    """Order in which a pen at (0, 0) draws the paths (id, x0, y0, x1, y1) of a sheet: always the nearest end next, reversed
    if that is the last. Sequential by nature, one sheet a task."""
    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        starts, stops = pdf[["x0", "y0"]].to_numpy(float), pdf[["x1", "y1"]].to_numpy(float)
        left, pen, out = np.ones(len(pdf), bool), np.zeros(2), []
        for place in range(len(pdf)):
            d = [np.where(left, ((e - pen) ** 2).sum(axis=1), np.inf) for e in (starts, stops)]
            back = int(d[1].min() < d[0].min())
            at = int(d[back].argmin())
            left[at], pen = False, (starts if back else stops)[at]
            out.append((pdf.at[at, sheet], pdf.at[at, "id"], place + 1, bool(back)))
        return pd.DataFrame(out, columns=[sheet, "id", "place", "reversed"])

    types = dict(ends.dtypes)
    return ends.groupBy(sheet).applyInPandas(order, f"{sheet} {types[sheet]}, id {types['id']}, place bigint, reversed boolean")


def roads_near(samples: DataFrame, segments: DataFrame, track: str, size: float = 500.0) -> DataFrame:
    """(track, edge) of the segments (edge, ax, ay, bx, by) that a way between neighbouring samples of a track may use: those by
    one of its samples, within as far as matched looks for ways on that track. Cells of samples meet those of segments."""
    from geoloom.operators.cells import cell, overlap_join

    order = Window.partitionBy(track).orderBy("seq")
    step = F.sqrt((F.col("x") - F.lag("x").over(order)) ** 2 + (F.col("y") - F.lag("y").over(order)) ** 2)
    reach = samples.select(track, step.alias("step")).groupBy(track).agg((3 * F.coalesce(F.max("step"), F.lit(0.0)) + 3 * RADIUS_M + 30).alias("reach"))
    places = samples.groupBy(track, cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    grown = [(F.col(c) + sign * F.col("reach")).alias(c) for c, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
    around = places.join(reach, track).select(F.col(track).alias("track"), *grown)
    roads = segments.select("edge", F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    return overlap_join(around, roads, size).select(F.col("a_track").alias(track), F.col("b_edge").alias("edge")).distinct()


def matched(samples: DataFrame, candidates: DataFrame, edges: DataFrame, track: str) -> DataFrame:
    """Per track and sample (seq) the road edge it was on (null: off the roads), by Viterbi over candidate positions.

    samples: track, seq, x, y in metres. candidates: track, seq, edge, t, distance (of nearest_segments). edges: track, edge, a,
    b, length of the roads near the track. A candidate costs by its distance, a move by how its way along the roads differs
    from a straight line, leaving or joining the roads a fixed price. A track is matched in one task, with its own roads."""
    def run(key: tuple, s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        roads = c[c.kind == 1]
        near = defaultdict(list)
        for q, e, t, d in c[c.kind == 0].sort_values(["seq", "distance", "edge"])[["seq", "edge", "t", "distance"]].itertuples(index=False, name=None):
            if len(near[q]) < MOST_CANDIDATES:
                near[q].append((int(e), t, d))
        ends = {int(e.edge): (int(e.a), int(e.b), float(e.length)) for e in roads.itertuples()}
        graph = defaultdict(list)
        for a, b, length in ends.values():
            graph[a].append((b, length))
            graph[b].append((a, length))
        s = s.sort_values("seq")
        states = [[x for x in near.get(q, ()) if x[0] in ends] for q in s.seq]
        places = s[["x", "y"]].to_numpy(float)
        off = -0.5 * (OFF_M / SIGMA_M) ** 2
        emit = [[-0.5 * (d / SIGMA_M) ** 2 for _, _, d in own] + [off] for own in states]
        steps = np.hypot(*np.diff(places, axis=0).T) if len(places) > 1 else np.zeros(0)
        reach = 3 * float(steps.max(initial=0)) + 2 * RADIUS_M + 30
        known: dict[int, dict[int, float]] = {}  # lengths from a node, once a track
        score, back = np.array(emit[0]), []
        for k in range(1, len(states)):
            straight = float(steps[k - 1])
            limit = 3 * straight + 2 * RADIUS_M + 30
            moves = np.full((len(score), len(emit[k])), -np.inf)
            moves[-1, :], moves[:, -1] = -SWITCH, -SWITCH
            moves[-1, -1] = 0
            for i, (e, t, _) in enumerate(states[k - 1]):
                p, q, own = ends[e]
                for n in (p, q):
                    if n not in known:
                        known[n] = _distances(graph, n, reach)
                to_p, to_q = known[p], known[q]
                for j, (f, u, _) in enumerate(states[k]):
                    a, b, length = ends[f]
                    to_a = min(t * own + to_p.get(a, math.inf), (1 - t) * own + to_q.get(a, math.inf))
                    to_b = min(t * own + to_p.get(b, math.inf), (1 - t) * own + to_q.get(b, math.inf))
                    d = min(to_a + u * length, to_b + (1 - u) * length)
                    if e == f:
                        d = min(d, abs(u - t) * length)
                    if d <= limit:
                        moves[i, j] = -abs(d - straight) / BETA_M
            total = score[:, None] + moves
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + np.array(emit[k])
        at, path = int(score.argmax()), []
        for k in reversed(range(len(states))):
            path.append(states[k][at][0] if at < len(states[k]) else None)
            at = int(back[k - 1][at]) if k else at
        return pd.DataFrame({track: key[0], "seq": s.seq.to_numpy(), "edge": pd.array(path[::-1], dtype="Int64")})

    told = candidates.select(track, F.lit(0).alias("kind"), "seq", "edge", "t", "distance", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("length"))
    roads = edges.select(track, F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("seq"), "edge", F.lit(0.0).alias("t"), F.lit(0.0).alias("distance"), "a", "b", "length")
    types = dict(samples.dtypes)
    own = samples.groupBy(track).cogroup(told.unionByName(roads).groupBy(track))
    return own.applyInPandas(run, f"{track} {types[track]}, seq bigint, edge bigint")


def _distances(graph: dict, node: int, limit: float) -> dict[int, float]:
    """Lengths along the roads from a node to those within limit."""
    best: dict[int, float] = {}
    heap = [(0.0, node)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > limit or n in best:
            continue
        best[n] = d
        for m, step in graph[n]:
            if m not in best:
                heapq.heappush(heap, (d + step, m))
    return best


def _by_others(lines: DataFrame, reach: float, spacing: float, angle_deg: float, ranked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples: id and number of samples of each line with a length; pairs: own, own_rank, own_len, the sample's k, and the id,
    rank and len of another line that it lies by, of no worse rank); not ranked: of a line of any rank, itself too."""
    from geoloom.operators.cells import points_in_boxes

    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    n = F.greatest(F.lit(1), F.ceil(length / spacing)).cast("bigint")
    sampled = lines.withColumns({"n": n, "len": length}).where("len > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))))
    on = lambda v: (F.col(f"a{v}") + (F.col(f"b{v}") - F.col(f"a{v}")) * F.col("k") / F.col("n")).alias(v)
    unit = lambda v: ((F.col(f"b{v}") - F.col(f"a{v}")) / F.col("len")).alias(f"u{v}")
    points = sampled.select(F.col("id").alias("own"), F.col("rank").alias("own_rank"), F.col("len").alias("own_len"), "k", "n", on("x"), on("y"), unit("x"), unit("y"))
    others = lines.withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by"), "len": length}).where("len > 0")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (F.col("len") * F.col("len"))))
    far2 = (F.col("x") - F.col("ax") - t * dx) ** 2 + (F.col("y") - F.col("ay") - t * dy) ** 2
    along = F.abs(F.col("ux") * dx + F.col("uy") * dy) / F.col("len") >= math.cos(math.radians(angle_deg))
    other = (F.col("id") != F.col("own")) & (F.col("rank") <= F.col("own_rank")) if ranked else F.lit(True)
    pairs = points_in_boxes(points, others, 2 * reach, reach).where(other & (far2 <= reach * reach) & along)
    return sampled.groupBy("id").agg(F.count("*").alias("samples")), pairs.select("own", "own_rank", "own_len", "k", "id", "rank", "len")


def shadowed_share(lines: DataFrame, reach: float, spacing: float, angle_deg: float = 28.0) -> DataFrame:
    """Per line (id, rank, ax, ay, bx, by; one segment) the share of its samples that lie by a line of a better (lower) rank.

    By: within reach of the other, which runs in nearly the same direction. Samples meet segments by grid cell. Lines on one
    place have the same neighbours, of which those of the best rank count for all, so each place is joined once."""
    ends = ["ax", "ay", "bx", "by"]
    # samples of a place meet lines of any rank here, and the place's own; a line tells by its rank which are better
    places = lines.groupBy(*ends).agg(F.min("id").alias("id"), F.min("rank").alias("rank"))
    total, pairs = _by_others(places, reach, spacing, angle_deg, ranked=False)
    best = pairs.groupBy("own", "k").agg(F.min("rank").alias("best")).groupBy("own", "best").agg(F.count("*").alias("n"))
    told = best.groupBy(F.col("own").alias("id")).agg(F.collect_list(F.struct("best", "n")).alias("beside"))
    known = places.drop("rank").join(total, "id").join(told, "id", "left").drop("id")
    hits = F.aggregate(F.filter("beside", lambda b: b["best"] < F.col("rank")), F.lit(0).cast("bigint"), lambda s, b: s + b["n"])
    return lines.join(known, ends).select("id", "samples", (F.coalesce(hits, F.lit(0)) / F.col("samples")).alias("shadowed"))


def culled(lines: DataFrame, reach: float, spacing: float, share: float = 0.7, angle_deg: float = 30.0) -> DataFrame:
    """(id, kept) of lines (id, rank, ax, ay, bx, by; one segment): a line goes if `share` of its samples lie by kept lines that
    come before it, those of a better rank, or longer, or of a lower id. Lines without length stay.

    Rounds in place of one line after another: a line goes once lines known to be kept shadow enough of it, and is kept once
    lines not known to be gone no longer do. Each round settles at least the first open line, in practice most of them."""
    total, pairs = _by_others(lines, reach, spacing, angle_deg)
    before = F.struct("rank", -F.col("len"), "id") < F.struct("own_rank", -F.col("own_len"), "own")
    links = cut(pairs.where(before).select("own", "k", F.col("id").alias("other")).distinct())
    needed = cut(links.select("own").distinct().join(total.withColumnRenamed("id", "own"), "own").withColumn("needed", F.col("samples") * share - 1e-9).select("own", "needed"))
    gone = needed.select(F.col("own").alias("id")).limit(0)
    while True:
        # links whose other line is open or kept, and whether it is kept; open lines are the owners of links
        open_ones = links.select(F.col("own").alias("other")).distinct().withColumn("open", F.lit(True))
        by_sample = links.join(open_ones, "other", "left").groupBy("own", "k").agg(F.bool_or(F.col("open").isNull()).alias("sure"))
        counts = by_sample.groupBy("own").agg(F.count("*").alias("most"), F.count_if("sure").alias("least")).join(needed, "own")
        settled = cut(counts.where("least >= needed or most < needed").select(F.col("own"), (F.col("least") >= F.col("needed")).alias("drop")))
        if settled.isEmpty():
            break
        dropped = settled.where("drop").select(F.col("own").alias("id"))
        gone = cut(gone.unionByName(dropped))
        links = cut(links.join(settled.select("own"), "own", "left_anti").join(dropped.withColumnRenamed("id", "other"), "other", "left_anti"))
        # an open line that has no link left is kept, which settles it
    return lines.join(gone.withColumn("gone", F.lit(True)), "id", "left").select("id", F.col("gone").isNull().alias("kept"))
