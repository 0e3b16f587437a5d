"""Words, boxes and lines on a page: clusters, columns, rules, anchors, label windows, titles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def box_clusters(boxes: DataFrame, page: str, box: str, gap: float) -> DataFrame:
    """page, box, cluster (its smallest box): boxes no further apart than `gap` hang together.

    Distances are between boxes, never to the hull of a cluster. A page's boxes
    are one group; memory grows with them, not with their pairs.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(box, ignore_index=True)
        x0, y0, x1, y1 = (d[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        label, left = np.full(len(d), -1), np.ones(len(d), bool)
        for i in range(len(d)):
            if not left[i]:
                continue
            left[i], todo = False, [i]
            while todo:
                j = todo.pop()
                label[j] = i
                dx = np.maximum(0, np.maximum(x0, x0[j]) - np.minimum(x1, x1[j]))
                dy = np.maximum(0, np.maximum(y0, y0[j]) - np.minimum(y1, y1[j]))
                near = np.flatnonzero(left & (np.sqrt(dx * dx + dy * dy) <= gap))
                left[near] = False
                todo += near.tolist()
        return pd.DataFrame({page: d[page], box: d[box], "cluster": d[box].to_numpy()[label]})

    f = boxes.schema
    schema = T.StructType([f[page], f[box], T.StructField("cluster", f[box].dataType)])
    return boxes.select(page, box, "x0", "y0", "x1", "y1").groupBy(page).applyInPandas(run, schema)


def column_clusters(words: DataFrame, group: str, x: str, gap: float) -> DataFrame:
    """group, cluster, min_x, modal_x, n: words whose x follow within `gap`; ties of the mode go to the smaller x.

    Words are counted by x before any ordering, so a window holds distinct places only.
    """
    by = W.partitionBy(group).orderBy(x)
    d = words.groupBy(group, x).agg(F.count(F.lit(1)).alias("_n"))
    d = d.withColumn("_new", F.coalesce((F.col(x) - F.lag(x).over(by) > gap).cast("int"), F.lit(1)))
    d = d.withColumn("cluster", F.sum("_new").over(by))
    mode = F.max_by(x, F.struct("_n", -F.col(x)))
    return d.groupBy(group, "cluster").agg(F.min(x).alias("min_x"), mode.alias("modal_x"), F.sum("_n").alias("n"))


def on_many_pages(rows: DataFrame, document: str, page: str, x: str, share: float = 0.5) -> DataFrame:
    """document, x, n_pages of the places that recur on at least `share` of a document's pages."""
    all_pages = rows.groupBy(document).agg(F.countDistinct(page).alias("_all"))
    d = rows.groupBy(document, x).agg(F.countDistinct(page).alias("n_pages"))
    return d.join(all_pages, document).filter(F.col("n_pages") >= share * F.col("_all")).drop("_all")


def last_label_window(labels: Column, width: int = 5) -> Column:
    """The last position (from 0) at which 1 to `width` follow one another; null if nowhere."""
    want = F.sequence(F.lit(1), F.lit(width))
    at = F.sequence(F.lit(0), F.greatest(F.size(labels) - width, F.lit(0)))
    return F.array_max(F.filter(at, lambda i: F.slice(labels, i + 1, F.lit(width)) == want))


def nearest_title(lines: DataFrame, document: str, pos: str, text: str, starts: Column, passes: Column, reach: int = 4) -> DataFrame:
    """document, pos, title for each start: the nearest of the lines up to `reach` before it that passes.

    The window holds `reach` rows, whatever the document's length.
    """
    by = W.partitionBy(document).orderBy(pos).rowsBetween(-reach, -1)
    d = lines.withColumn("title", F.last(F.when(passes, F.col(text)), ignorenulls=True).over(by))
    return d.filter(starts).select(document, pos, "title")


def under_code(lines: DataFrame, document: str, pos: str, code: Column, resets: Column, text: str) -> DataFrame:
    """document, code, body: lines joined under the most recent code; a line that resets ends it."""
    by = W.partitionBy(document).orderBy(pos)
    d = lines.withColumn("_code", code).withColumn("_cut", F.col("_code").isNotNull() | F.coalesce(resets, F.lit(False)))
    d = d.withColumn("_run", F.sum(F.col("_cut").cast("int")).over(by)).withColumn("code", F.first("_code").over(W.partitionBy(document, "_run").orderBy(pos)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), " ")
    return d.filter("code IS NOT NULL AND _code IS NULL").groupBy(document, "_run", "code").agg(body.alias("body")).drop("_run")


def demoted(files: DataFrame, folder: str, hint: str, most: int = 2) -> DataFrame:
    """Add bulk: whether a file without a hint lies in a folder with more than `most` such files."""
    n = F.count_if(F.col(hint).isNull()).over(W.partitionBy(folder))
    return files.withColumn("bulk", F.col(hint).isNull() & (n > most))


def characters(texts: DataFrame, text: str, low: str = "\ue000", high: str = "\uf8ff") -> DataFrame:
    """code (of the character), n, n_texts: private-use characters that nothing maps yet."""
    found = F.regexp_extract_all(text, F.lit(f"[{low}-{high}]"), F.lit(0))
    counts = lambda cs: F.transform(F.array_distinct(cs), lambda c: F.struct(c.alias("c"), F.size(F.filter(cs, lambda x: x == c)).alias("k")))
    each = texts.select(found.alias("_f")).select(F.explode(counts(F.col("_f"))).alias("_x"))
    return each.groupBy(F.ascii("_x.c").alias("code")).agg(F.sum("_x.k").alias("n"), F.count(F.lit(1)).alias("n_texts"))
