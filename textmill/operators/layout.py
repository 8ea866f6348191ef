"""Layout of pages: characters to words to lines, reading order by XY cuts, columns, ruled tables, rectangles.

Each operator takes the spans or edges of one page at a time, so a page is a group and its size bounds a task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.tables import by_page

#: Depth, least spans, least valley and width of a cut. Fixed values.
CUT_DEPTH, CUT_SPANS, VALLEY, GUTTER = 64, 5, 0.3, 15.0


def with_field(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema, T.StructField(name, T.IntegerType())])


def cluster_values(values: np.ndarray, tolerance: float) -> np.ndarray:
    """Numbers of 1-D clusters in rising order: a value joins the last cluster if it is within tolerance of its running mean."""
    order, out = np.argsort(values, kind="stable"), np.zeros(len(values), int)
    k, total, n = -1, 0.0, 0
    for i in order:
        if n and abs(values[i] - total / n) <= tolerance:
            total, n = total + values[i], n + 1
        else:
            k, total, n = k + 1, float(values[i]), 1
        out[i] = k
    return out


def words_of_line(chars: DataFrame, by: list[str], gap: float) -> DataFrame:
    """chars(x, w, ch, idx) with word numbers from 0: a gap larger than gap to the character before begins a word. A window, as each looks at its neighbour only."""
    w = Window.partitionBy(*by).orderBy("x", "idx")
    new = F.when(F.lag("x").over(w).isNull() | (F.col("x") - (F.lag("x").over(w) + F.lag("w").over(w)) > gap), 1).otherwise(0)
    return chars.withColumn("_new", new).withColumn("word", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def lines_of_page(spans: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """spans(seq, x, y) with line numbers from the top: a span joins a line if its y is within tolerance of the line's first span, which no window can tell."""
    schema = with_field(spans, "line")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "seq"], ascending=[False, True, True], kind="stable")
        line, head, out = -1, None, []
        for y in pdf["y"]:
            if head is None or abs(y - head) > tolerance:
                line, head = line + 1, y
            out.append(line)
        return pdf.assign(line=out)

    return spans.groupBy(*by).applyInPandas(run, schema)


def clustered(values: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """values with cluster numbers within each group (cluster_values)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(cluster=cluster_values(pdf[value].to_numpy(float), tolerance))

    return values.groupBy(*by).applyInPandas(run, with_field(values, "cluster"))


def _widest_gap(lo: np.ndarray, hi: np.ndarray, least: float) -> float | None:
    """Middle of the widest gap between the intervals, if it is at least least."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    gaps = lo[1:] - reach[:-1]
    k = int(gaps.argmax()) if len(gaps) else -1
    return float(reach[k] + gaps[k] / 2) if k >= 0 and gaps[k] >= least else None


def xy_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, gutter: float = GUTTER, depth: int = CUT_DEPTH) -> list[int]:
    """Reading order of boxes: cut at the widest gutter between columns, else at the widest gap between rows, and read the parts in turn."""

    def read(at: np.ndarray, left: int) -> list[int]:
        plain = at[np.lexsort((at, x[at], -y[at]))].tolist()
        if len(at) < CUT_SPANS or not left:
            return plain
        cut = _widest_gap(x[at], x[at] + w[at], gutter)
        if cut is not None:
            return read(at[x[at] + w[at] / 2 < cut], left - 1) + read(at[x[at] + w[at] / 2 >= cut], left - 1)
        cut = _widest_gap(y[at], y[at] + h[at], max(1e-9, VALLEY * float(np.median(h[at]))))
        if cut is not None:
            return read(at[y[at] + h[at] / 2 >= cut], left - 1) + read(at[y[at] + h[at] / 2 < cut], left - 1)
        return plain

    return read(np.arange(len(x)), depth)


def reading_order(spans: DataFrame, by: list[str], gutter: float = GUTTER) -> DataFrame:
    """spans(seq, x, y, w, h) with place, their reading order from 0 by XY cuts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable", ignore_index=True)
        place = np.empty(len(pdf), int)
        place[xy_cut(*(pdf[c].to_numpy(float) for c in "xywh"), gutter=gutter)] = np.arange(len(pdf))
        return pdf.assign(place=place)

    return spans.groupBy(*by).applyInPandas(run, with_field(spans, "place"))


def simple_order(spans: DataFrame, by: list[str], band: float = 5.0) -> DataFrame:
    """Spans from top to bottom in bands of band units, from left to right within one. Bands make the order total; a tolerance alone wouldn't."""
    w = Window.partitionBy(*by).orderBy(F.floor(F.col("y") / band).desc(), "x", "seq")
    return spans.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Share of rectangle a (x, y, w, h) that lies in b; 1 for a rectangle without area that b holds."""
    (x, y, w, h), (p, q, v, u) = a, b
    wide = F.least(x + w, p + v) - F.greatest(x, p)
    high = F.least(y + h, q + u) - F.greatest(y, q)
    area = w * h
    return F.when((wide < 0) | (high < 0), 0.0).when(area <= 0, 1.0).otherwise(wide * high / area)


def within(spans: DataFrame, rectangles: DataFrame, by: list[str], least: float = 0.5, keep: bool = True) -> DataFrame:
    """Spans of which at least share least lies in one of the page's rectangles(rx, ry, rw, rh), or (keep false) those of which none does."""
    a = [F.col(f"s.{c}") for c in "xywh"]
    b = [F.col(f"r.r{c}") for c in "xywh"]
    on = [F.col(f"s.{c}") == F.col(f"r.{c}") for c in by]
    return spans.alias("s").join(rectangles.alias("r"), [*on, overlap(a, b) >= least], "left_semi" if keep else "left_anti")


def grid_cells(edges: DataFrame, by: list[str], tolerance: float = 3.0) -> DataFrame:
    """Cells of ruled tables: edges(x0, y0, x1, y1) -> by, table, row, col, x0, y0, x1, y1.

    Horizontal and vertical edges that cross give points; four points of neighbouring lines whose sides are
    ruled give a cell; cells that share an edge are one table.
    """
    schema = [edges.schema[c] for c in by]

    def cells(pdf: pd.DataFrame) -> list[tuple]:
        flat = (pdf["y1"] - pdf["y0"]).abs() <= tolerance
        hs, vs = pdf[flat], pdf[~flat & ((pdf["x1"] - pdf["x0"]).abs() <= tolerance)]
        if hs.empty or vs.empty:
            return []
        hy, vx = cluster_values(hs["y0"].to_numpy(float), tolerance), cluster_values(vs["x0"].to_numpy(float), tolerance)
        ys = [float(hs["y0"].to_numpy()[hy == k].mean()) for k in range(hy.max() + 1)]
        xs = [float(vs["x0"].to_numpy()[vx == k].mean()) for k in range(vx.max() + 1)]

        def ruled(frame, group, k, a, b, lo, hi):
            rows = frame[group == k]
            return bool(((rows[[lo, hi]].min(axis=1) <= a + tolerance) & (rows[[lo, hi]].max(axis=1) >= b - tolerance)).any())

        found = []
        for r in range(len(ys) - 1):
            for c in range(len(xs) - 1):
                sides = ruled(hs, hy, r, xs[c], xs[c + 1], "x0", "x1") and ruled(hs, hy, r + 1, xs[c], xs[c + 1], "x0", "x1")
                if sides and ruled(vs, vx, c, ys[r], ys[r + 1], "y0", "y1") and ruled(vs, vx, c + 1, ys[r], ys[r + 1], "y0", "y1"):
                    found.append((r, c))
        table, tables, known = {}, 0, set(found)
        for cell in found:
            if cell in table:
                continue
            stack, tables = [cell], tables + 1
            while stack:
                r, c = stack.pop()
                if (r, c) in table or (r, c) not in known:
                    continue
                table[r, c] = tables - 1
                stack += [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
        return [(table[r, c], r, c, xs[c], ys[r], xs[c + 1], ys[r + 1]) for r, c in found]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in cells(pdf)], columns=[*by, "table", "row", "col", "x0", "y0", "x1", "y1"])

    out = T.StructType([*schema, *[T.StructField(c, T.IntegerType()) for c in ("table", "row", "col")], *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]])
    return edges.groupBy(*by).applyInPandas(run, out)


def running_lines(pages: DataFrame, doc: str, number: str, line: str, share: float = 0.5) -> DataFrame:
    """Band lines (already normalised) that stand on max(2, share of the pages) or more pages of a document of three pages and more."""
    count = pages.groupBy(doc).agg(F.countDistinct(number).alias("pages"))
    seen = pages.where(F.length(line) > 3).groupBy(doc, line).agg(F.countDistinct(number).alias("n"))
    return seen.join(count, doc).where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * F.lit(share)))))


def text_spans(pages: DataFrame, by: list[str], char_width: float = 6.0, leading: float = 12.0) -> DataFrame:
    """Spans of plain text: a span for each word, at its column and line; y falls from line to line."""
    d = pages.select(*by, F.posexplode(F.split("text", "\n")).alias("row", "_line"))
    d = d.select(*by, "row", "_line", F.posexplode(F.split("_line", " ")).alias("k", "word"))
    w = Window.partitionBy(*by, "row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("x", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0)) * char_width).where("word <> ''")
    return d.select(*by, (F.col("row") * 100000 + F.col("k")).cast("long").alias("seq"), F.col("word").alias("text"), F.col("x").cast("double"), (-F.col("row") * leading).cast("double").alias("y"), (F.length("word") * char_width).cast("double").alias("w"), F.lit(10.0).alias("h"))


def rect(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x": x, "y": y, "w": w, "h": h}


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two rectangles share more than an edge."""
    return (a["x"] < b["x"] + b["w"]) & (a["x"] + a["w"] > b["x"]) & (a["y"] < b["y"] + b["h"]) & (a["y"] + a["h"] > b["y"])


def union_of(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def intersection_of(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The rectangle that both hold; null where there is none."""
    x, y, both = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), intersects(a, b)
    w, h = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x, F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return rect(*[F.when(both, c) for c in (x, y, w, h)])


def area(a: dict[str, Column]) -> Column:
    return a["w"] * a["h"]


def center_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.hypot(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2, a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2)


#: How far outside a grid a point may lie to be of its first or last interval. Fixed value.
SNAP = 3.0


def interval_of(point: Column, bounds: list[float], snap: float = SNAP) -> Column:
    """The number of the interval that a point lies in: closed on the left, the last one on both sides; null if it lies further out than snap."""
    last = len(bounds) - 2
    inner = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds[1:-1]]), lambda b: b <= point)) if last else F.lit(0)
    near = (point >= bounds[0] - snap) & (point <= bounds[-1] + snap)
    return F.when(near, F.least(inner, F.lit(last)))


def nearest(value: Column, centers: Column) -> Column:
    """The number of the nearest center, the first of several, by distance in thousandths."""
    distance = F.transform(centers, lambda c: F.floor(F.abs(value - c) * 1000))
    return (F.array_position(distance, F.array_min(distance)) - 1).cast("int")


def columns_of_page(spans: DataFrame, by: list[str], gutter: float = GUTTER) -> DataFrame:
    """spans with column numbers from the left: a gutter is a strip of that width and more that no span of the page reaches into."""
    w = Window.partitionBy(*by).orderBy("x", "seq")
    reach = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("x") - reach >= gutter, 1).otherwise(0)
    return spans.withColumn("_new", new).withColumn("column", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def vertical_order(spans: DataFrame, by: list[str], band: float = 5.0) -> DataFrame:
    """Spans of vertical writing: columns of band units from right to left, from top to bottom within one."""
    w = Window.partitionBy(*by).orderBy(F.floor(F.col("x") / band).desc(), F.col("y").desc(), "seq")
    return spans.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def thread_order(spans: DataFrame, beads: DataFrame, by: list[str], band: float = 5.0) -> DataFrame:
    """Spans by the beads(bead, bx, by_, bw, bh) of an article that hold their centers, the first of several; those of none come last."""
    cx, cy = F.col("s.x") + F.col("s.w") / 2, F.col("s.y") + F.col("s.h") / 2
    held = [F.col(f"s.{c}") == F.col(f"b.{c}") for c in by] + [cx.between(F.col("b.bx"), F.col("b.bx") + F.col("b.bw")), cy.between(F.col("b.by_"), F.col("b.by_") + F.col("b.bh"))]
    d = spans.alias("s").join(beads.alias("b"), held, "left").select("s.*", "b.bead")
    d = d.groupBy(*spans.columns).agg(F.min("bead").alias("bead"))
    w = Window.partitionBy(*by).orderBy(F.col("bead").asc_nulls_last(), F.floor(F.col("y") / band).desc(), "x", "seq")
    return d.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def structure_order(spans: DataFrame, tree: DataFrame, by: list[str], mark: str) -> DataFrame:
    """Spans by the place that the structure tree(by, mark, rank) gives their mark; spans without one come last, by seq."""
    w = Window.partitionBy(*by).orderBy(F.col("rank").asc_nulls_last(), "seq")
    return spans.join(tree, [*by, mark], "left").withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def tiered_order(spans: DataFrame, by: list[str], band: float = 5.0) -> DataFrame:
    """spans(.., rank, rotation): where a page has ranks of a structure tree these decide, else bands from the top; rotated spans of a page follow the others, by rotation."""
    ranked = F.max(F.col("rank").isNotNull()).over(Window.partitionBy(*by))
    tier = F.when(ranked, 1).otherwise(3)
    w = Window.partitionBy(*by).orderBy(F.col("rotation") != 0, "rotation", F.when(ranked, F.coalesce("rank", F.lit((1 << 31) - 1))), F.floor(F.col("y") / band).desc(), "x", "seq")
    return spans.withColumns({"tier": tier, "place": (F.row_number().over(w) - 1).cast("int")})


def tree_order(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """nodes(tree, node, parent, seq) of trees -> tree, node, depth, place: depth first, children by seq. Deeper nodes than depth are left out.

    A tree is a page's or a document's and is walked at once: a recursive query would go over all trees together, and Spark ends one at a number of rows.
    """

    def walk(rows: list[dict]) -> list[dict]:
        below, out = defaultdict(list), []
        for n in sorted(rows, key=lambda n: (n["seq"], n["node"]), reverse=True):
            below[n["parent"]].append(n["node"])
        todo = [(n, 0) for n in below[None]]
        while todo:
            n, at = todo.pop()
            out.append({"node": n, "depth": at, "place": len(out)})
            if at < depth:
                todo += [(c, at + 1) for c in below[n]]
        return out

    return by_page(nodes, ["tree"], ["node", "parent", "seq"], walk, f"node:{nodes.schema['node'].dataType.simpleString()},depth:int,place:int")


def line_height(spans: DataFrame, by: list[str], em: float) -> DataFrame:
    """The upper median of the distances between baselines (those within 0.5 of the one before are it) from half an em to three; no row for a page of fewer than four spans or without such a distance."""
    d = spans.withColumns({"_n": F.count("*").over(Window.partitionBy(*by))}).where("_n >= 4").select(*by, "y").distinct()
    w = Window.partitionBy(*by).orderBy(F.col("y").desc())
    d = d.withColumn("gap", F.lag("y").over(w) - F.col("y")).where(F.col("gap").between(max(0.5, em * 0.5), em * 3))
    r = d.withColumns({"_rank": F.row_number().over(Window.partitionBy(*by).orderBy("gap")) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    return r.where(F.col("_rank") == F.floor(F.col("_n") / 2)).select(*by, F.col("gap").alias("line_height"))


def page_properties(spans: DataFrame, by: list[str], bin: float = 10.0) -> DataFrame:
    """Of each page: spans, upper median of their widths, population variance of y, and columns (runs of bins of x that spans begin in)."""
    r = spans.withColumns({"_rank": F.row_number().over(Window.partitionBy(*by).orderBy("w")) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    m = r.groupBy(*by).agg(F.count("*").alias("spans"), F.max(F.when(F.col("_rank") == F.floor(F.col("_n") / 2), F.col("w"))).alias("width"), F.var_pop("y").alias("y_variance"))
    bins = spans.select(*by, F.floor(F.col("x") / bin).alias("bin")).distinct()
    new = F.when(F.col("bin") - F.lag("bin").over(Window.partitionBy(*by).orderBy("bin")) == 1, 0).otherwise(1)
    return m.join(bins.withColumn("_new", new).groupBy(*by).agg(F.sum("_new").alias("columns")), by)


def spacing_deviation(gaps: DataFrame, by: list[str], gap: str) -> DataFrame:
    """Population standard deviation of word gaps; 0 where there is one."""
    return gaps.groupBy(*by).agg(F.coalesce(F.stddev_pop(gap), F.lit(0.0)).alias("deviation"))


def characters(spans: DataFrame, by: list[str]) -> DataFrame:
    """Characters of spans: by, seq, i, ch, x and w, each of an equal part of the span's width."""
    d = spans.select(*by, "seq", "x", "w", F.length("text").alias("_n"), F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    return d.select(*by, "seq", "i", "ch", (F.col("x") + F.col("w") / F.col("_n") * F.col("i")).alias("x"), (F.col("w") / F.col("_n")).alias("w"))


def assembled(spans: DataFrame, by: list[str], band: float = 5.0, gap: float = 2.5) -> DataFrame:
    """Lines of text from spans: by, line (from the top), text; spans of a band from the left, with a blank where they are more than gap apart."""
    d = spans.withColumn("line", F.floor(F.col("y") / band))
    w = Window.partitionBy(*by, "line").orderBy("x", "seq")
    far = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > gap
    d = d.withColumn("piece", F.when(far, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    g = d.groupBy(*by, "line").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "piece"))).alias("pieces"))  # one line's
    line = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("line").desc())) - 1
    return g.select(*by, line.cast("int").alias("line"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


def without_artifacts(lines: DataFrame, running: DataFrame, doc: str, band: str) -> DataFrame:
    """Lines whose normal form doesn't run over the pages of their document."""
    return lines.join(running.select(doc, band), [doc, band], "left_anti")


#: Of pages whose regions stand side by side: least spans, of a page and of each region; least lines and characters a line. Fixed values.
SIDE_SPANS, REGION_SPANS, REGION_LINES, REGION_DENSITY = 8, 8, 4, 12.0


def regions(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Region numbers of boxes: neighbours in a line less than a median height apart are of one region, and so are boxes above each other that share some width and are near."""
    em, right, middle, n = max(1.0, float(np.median(h))), x + w, y + h / 2, len(x)

    def neighbours(at: slice) -> np.ndarray:
        a = lambda v: v[at, None]
        line = np.abs(middle - a(middle)) < em / 2
        gap = np.maximum(x, a(x)) - np.minimum(right, a(right))
        near = np.minimum(np.abs(y - a(y) - a(h)), np.abs(a(y) - y - h)) < 1.5 * em
        return np.where(line, gap < em, (gap < -0.3 * em) & near)

    step = max(1, 4_000_000 // n)  # so that a part of the matrix has some million fields, whatever the page
    parts = [slice(k, min(n, k + step)) for k in range(0, n, step)]
    kept = neighbours(parts[0]) if len(parts) == 1 else None
    out = np.arange(n)
    while True:
        before = out
        least = np.concatenate([np.where(neighbours(p) if kept is None else kept, out, n).min(axis=1) for p in parts])
        out = np.minimum(out, least)
        out = out[out]
        if (out == before).all():
            return np.unique(out, return_inverse=True)[1]


def region_order(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, chars: np.ndarray) -> np.ndarray | None:
    """Order of boxes by region, a region after those above it and after those on its left; None unless two dense regions of half the boxes stand side by side."""
    if len(x) < SIDE_SPANS:
        return None
    em, of = max(1.0, float(np.median(h))), regions(x, y, w, h)
    n = of.max() + 1
    of_each = [of == k for k in range(n)]
    size = np.array([m.sum() for m in of_each])
    if 2 * (size < 4).sum() > n:
        return None
    x0, x1 = np.array([x[m].min() for m in of_each]), np.array([(x + w)[m].max() for m in of_each])
    low, top = np.array([y[m].min() for m in of_each]), np.array([(y + h)[m].max() for m in of_each])
    lines = np.array([1 + (np.diff(np.sort(y[m])) > 0.6 * em).sum() for m in of_each])
    large = (size >= REGION_SPANS) & (lines >= REGION_LINES) & (np.array([chars[m].sum() for m in of_each]) >= REGION_DENSITY * lines)
    apart = (x1[:, None] <= x0) | (x1 <= x0[:, None])
    height = np.minimum(top[:, None], top) - np.maximum(low[:, None], low)
    if not (apart & (height > 3 * em) & large[:, None] & large & (2 * (size[:, None] + size) >= len(x))).any():
        return None
    first = (~apart & (low[:, None] >= low) & (top[:, None] > top)) | ((x1[:, None] <= x0) & (height > em / 2))
    np.fill_diagonal(first, False)
    left, out = np.ones(n, bool), []
    while left.any():
        free = left & ~first[left].any(axis=0)
        free = np.flatnonzero(free if free.any() else left)
        k = free[np.lexsort((x0[free], -top[free]))[0]]
        left[k] = False
        at = np.flatnonzero(of_each[k])
        out.append(at[np.lexsort((at, x[at], -y[at]))])
    return np.concatenate(out)


def block_order(spans: DataFrame, by: list[str], band: float = 5.0) -> DataFrame:
    """spans(seq, x, y, w, h, text) with regions (whether the page is read by regions that stand side by side) and place; other pages are read in bands from the top."""
    schema = T.StructType([*spans.schema, T.StructField("regions", T.BooleanType()), T.StructField("place", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable", ignore_index=True)
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        order = region_order(x, y, w, h, pdf["text"].str.strip().str.len().to_numpy())
        found = order is not None
        place = np.empty(len(pdf), int)
        place[order if found else np.lexsort((np.arange(len(x)), x, -np.floor(y / band)))] = np.arange(len(pdf))
        return pdf.assign(regions=found, place=place)

    return spans.groupBy(*by).applyInPandas(run, schema)
