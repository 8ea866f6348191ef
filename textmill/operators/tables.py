"""Tables of pages: found by how spans stand, or taken from a tagged structure; tables and lines as Markdown.

A page, or a structure tree, is a group and its size bounds a task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances of columns and rows, merge distance of columns; least cells, columns and rows, most columns, least share of regular rows, most share of empty cells. Fixed values.
COLUMN, ROW, MERGE = 15.0, 2.8, 25.0
CELLS, COLUMNS, ROWS, MOST_COLUMNS, REGULAR, EMPTY = 4, 2, 3, 15, 0.3, 0.6
#: Glyphs that begin an item of a list. Fixed values.
BULLETS = "►•▪▸‣◦●■◆○□❍❖✓✔➢➤\x7f"
#: White space of RE2's \s, which is Java's without the vertical tab.
SPACE = r"[\t\n\f\r ]"
#: Ratios to the body's size from which a line is a heading of level 1, 2, 3, and 4 if it is bold; a body is at least 9 and at most 12 points. Fixed values.
HEADINGS, BOLD, SMALLEST, BODY = [1.8, 1.4, 1.2], 1.05, 9.0, 12.0


def by_page(df: DataFrame, by: list[str], fields: list[str], use: Callable[[list[dict]], list[dict]], out: str) -> DataFrame:
    """by and the rows of schema out that use makes of a page's rows. Pages are handed over in batches: most are too small for a call each."""
    pages = df.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    run = F.pandas_udf(lambda s: s.map(lambda rows: use(list(rows))), f"array<struct<{out}>>")
    return pages.select(*by, F.explode(run("_rows")).alias("_row")).select(*by, "_row.*")


def running_clusters(values: list[float], tolerance: float) -> list[list[int]]:
    """cluster_values as lists of places in values, for few values."""
    out, total = [], 0.0
    for i in sorted(range(len(values)), key=values.__getitem__):
        if out and abs(values[i] - total / len(out[-1])) <= tolerance:
            out[-1].append(i)
            total += values[i]
        else:
            out.append([i])
            total = values[i]
    return out


def merged_columns(lo: list[float], hi: list[float], tolerance: float = COLUMN, merge: float = MERGE) -> list[int]:
    """Column numbers of intervals by their centers; neighbouring columns are one if their centers are nearer than merge or their ranges meet."""
    center = [(a + b) / 2 for a, b in zip(lo, hi, strict=True)]
    out, at, middle, held, reach = [0] * len(lo), -1, 0.0, 0, 0.0
    for own in running_clusters(center, tolerance):
        m, far = sum(center[i] for i in own) / len(own), max(hi[i] for i in own)
        if at >= 0 and (m - middle < merge or min(lo[i] for i in own) <= reach):
            middle, held, reach = (middle * held + m * len(own)) / (held + len(own)), held + len(own), max(reach, far)
        else:
            at, middle, held, reach = at + 1, m, len(own), far
        for i in own:
            out[i] = at
    return out


_VALUE = re.compile(r"[0-9.,%+\-−$€£]*[0-9][0-9.,%+\-−$€£]*")


def _grid(spans: list[dict]) -> list[dict]:
    """Cells (row, col, text) of the table that a page's spans are, if they pass the tests of a table."""
    spans = sorted(spans, key=lambda s: (s["x"], s["seq"]))
    cols = merged_columns([s["x"] for s in spans], [s["x"] + s["w"] for s in spans])
    lines = running_clusters([-s["y"] for s in spans], ROW)
    row_of = {i: r for r, line in enumerate(lines) for i in line}
    found = defaultdict(list)
    for i, s in enumerate(spans):
        found[row_of[i], cols[i]].append(s["text"] or "")
    columns, rows = max(cols) + 1, len(lines)
    filled = Counter(Counter(r for r, _ in found).values())
    if len(found) < CELLS or not COLUMNS <= columns <= MOST_COLUMNS or rows < ROWS or max(filled.values()) < REGULAR * rows or len(found) < (1 - EMPTY) * rows * columns:
        return []
    texts = [" ".join(t).strip() for t in found.values()]
    values, single = sum(bool(_VALUE.fullmatch(t)) for t in texts), sum(len(t.split()) < 2 for t in texts)
    if columns >= 5 and values * 2 < len(texts) and single > 0.7 * len(texts):  # prose
        return []
    return [{"row": r, "col": c, "text": " ".join(t)} for (r, c), t in sorted(found.items())]


def spatial_tables(spans: DataFrame, by: list[str]) -> DataFrame:
    """spans(seq, x, y, w, text) of pages, or of columns of pages -> by, row, col, text: the filled cells of those that are tables."""
    return by_page(spans, by, ["seq", "x", "y", "w", "text"], _grid, "row:int,col:int,text:string")


def _tagged(nodes: list[dict]) -> list[dict]:
    below = defaultdict(list)
    for n in sorted(nodes, key=lambda n: (n["seq"], n["node"]), reverse=True):
        below[n["parent"]].append(n)
    cells, tables, rows = [], 0, 0
    # (node, its table, row and cell, whether it is within a THead), the next one to read last
    todo = [(n, None, None, None, False) for n in below[None]]
    while todo:
        n, table, row, cell, head = todo.pop()
        kind = n["kind"]
        if cell is None and table is None and kind == "Table":
            table, tables, rows = tables, tables + 1, 0
        elif cell is None and table is not None and row is None and kind == "TR":
            row, rows = [rows, 0], rows + 1
        elif cell is None and row is not None and kind in ("TH", "TD"):
            span = max(1, n["colspan"] or 1)
            cell = {"table": table, "row": row[0], "col": row[1], "header": head or kind == "TH", "colspan": span, "text": []}
            row[1] += span
            cells.append(cell)
        if cell is not None and n["text"] is not None:
            cell["text"].append(n["text"])
        todo += [(c, table, row, cell, head or kind == "THead") for c in below[n["node"]]]
    return [c | {"text": " ".join(c["text"])} for c in cells]


def tagged_tables(nodes: DataFrame) -> DataFrame:
    """nodes(tree, node, parent, seq, kind, text, colspan) -> tree, table, row, col, header, colspan, text.

    A table is numbered in reading order; what is below its first TR is of that row, below its first TH or TD of that
    cell: tables within cells are text of these. A cell is a header if it is a TH or within a THead. Children come by seq.
    """
    return by_page(nodes, ["tree"], ["node", "parent", "seq", "kind", "text", "colspan"], _tagged, "table:int,row:int,col:int,header:boolean,colspan:int,text:string")


def table_markdown(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells(row, col, colspan, header, text) -> by, markdown: rows as wide as the widest, and a rule after the header rows (the first row, if the first isn't one)."""
    text = F.trim(F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    piece = F.concat(F.lit(" "), text, F.lit(" "), F.repeat(F.lit("| "), F.col("colspan") - 1), F.lit("|"))
    r = cells.groupBy(*by, "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", piece.alias("p")))), lambda c: c["p"]), "").alias("p"),
        F.sum("colspan").alias("n"), F.bool_or("header").alias("header"),
    )
    t = r.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", "p", "n", "header"))).alias("rows"), F.max("n").alias("most"))
    body = F.array_position(F.transform("rows", lambda x: x["header"]), False)
    t = t.withColumn("head", F.when(F.col("rows")[0]["header"], F.when(body > 0, body - 1).otherwise(1)).otherwise(1))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("most").cast("int")), F.lit("\n"))
    line = lambda x, i: F.concat(F.lit("|"), x["p"], F.repeat(F.lit(" |"), (F.col("most") - x["n"]).cast("int")), F.lit("\n"), F.when(i + 1 == F.col("head"), rule).otherwise(""))
    return t.select(*by, F.array_join(F.transform("rows", line), "").alias("markdown"))


def body_size(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, body: the commonest size in half points of lines of nine points and more (the smaller of two), 12 at most and where there is none."""
    n = lines.groupBy(*by, F.when(F.col("size") >= SMALLEST, F.round(F.col("size") * 2) / 2).alias("_size")).agg(F.count("*").alias("_n"))
    best = F.min_by("_size", F.struct(F.col("_size").isNull().alias("a"), (-F.col("_n")).alias("b"), F.col("_size").alias("c")))
    return n.groupBy(*by).agg(F.least(F.coalesce(best, F.lit(BODY)), F.lit(BODY)).alias("body"))


def heading_level(text: Column, ratio: Column, bold: Column, printed: bool = True) -> Column:
    """Level of a heading by the ratio of its size to the body's, else by its section number (2.1.3 is level 3, at most 6); null for other lines.

    A heading has 2 to 200 characters, 20 words at most, no end of a sentence within, and isn't a stray ordinal suffix.
    Unless printed, sizes and weights alone decide: section numbers (and addresses that look like one) and suffixes mean nothing.
    """
    t = F.trim(text)
    fit = F.length(t).between(2, 200) & (F.size(F.split(t, (r"\s" if printed else SPACE) + "+", -1)) <= 20) & ~t.rlike(r"[.!?] +\p{Lu}")
    if printed:
        fit &= ~F.lower(t).isin("st", "nd", "rd", "th")
    by_size = F.when(ratio >= HEADINGS[0], 1).when(ratio >= HEADINGS[1], 2).when(ratio >= HEADINGS[2], 3).when(bold & (ratio >= BOLD), 4)
    if not printed:
        return F.when(fit, by_size)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)+)\s*(?=\p{L}.)", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    numbered = F.when((number != "") & (F.octet_length(t) - F.octet_length(number) <= 121), F.least(dots + 1, F.lit(6)))
    return F.coalesce(F.when(fit, by_size), numbered)


def lines_markdown(lines: DataFrame, by: list[str], printed: bool = True) -> DataFrame:
    """lines(line, text, size, bold) -> by, markdown: headings, items of lists, and paragraphs of the lines between; empty lines end a paragraph.

    Unless printed, headings are by size and weight alone, the marks of items are - and *, and white space is that of RE2.
    """
    d = lines.join(body_size(lines, by), by)
    t = F.trim("text")
    d = d.withColumn("level", heading_level(F.col("text"), F.col("size") / F.col("body"), F.col("bold"), printed))
    space, marks = (r"\s", BULLETS) if printed else (SPACE, "")
    bullet = F.regexp_extract(t, rf"(?s)^[{marks}\-*]{space}+(.*)$", 1)
    item = bullet != "" if printed else t.rlike(rf"(?s)^[\-*]{space}+.")
    kind = F.when(t == "", "blank").when(F.col("level").isNotNull(), "heading").when(item, "bullet").when(t.rlike(rf"^([0-9]{{1,3}}|[a-z])[.)]{space}"), "number").otherwise("text")
    d = d.withColumn("kind", kind)
    w = Window.partitionBy(*by).orderBy("line")
    same = (F.col("kind") == F.lag("kind").over(w)) & F.col("kind").isin("text", "bullet", "number")
    d = d.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("block", F.sum("_new").over(w)).where("kind <> 'blank'")
    piece = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), t)).when(F.col("kind") == "bullet", F.concat(F.lit("- "), bullet)).otherwise(t)
    b = d.select(*by, "block", "line", "kind", piece.alias("piece")).groupBy(*by, "block", "kind").agg(F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("p"))
    pieces = F.transform("p", lambda x: x["piece"])
    b = b.select(*by, "block", F.when(F.col("kind") == "text", F.array_join(pieces, " ")).otherwise(F.array_join(pieces, "\n")).alias("text"))
    m = b.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"))
    return m.select(*by, F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("markdown"))
