"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element of a page is a row of features: density, links and punctuation of its subtree, tokens of its attributes and its
ancestors', depth, and how it compares with its siblings. Boosted trees give each node a margin for or against main text. Decoding is
hierarchical: a node is kept only with its parent, and a subtree goes as a whole when what it would add is negative.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import lists, map_batches, map_rows
from loomtrace.llm.dom import Page
from loomtrace.llm.page_templates import MARK, template_page
from loomtrace.llm.registry import table


@dataclass(frozen=True)
class Training:
    """``pages`` template pages from seed ``first``; trees, their depth and step."""

    pages: int = 600
    first: int = 0
    trees: int = 30
    depth: int = 5
    step: float = 0.2


def training_rows(spark: SparkSession, t: Training = Training()) -> DataFrame:
    """``label`` and ``features`` of every node of the template pages: 1 where its subtree has main text."""
    import pyarrow as pa

    def make():
        def run(batches):
            for batch in batches:
                labels, rows = [], []
                for seed in batch.column(0).to_pylist():
                    page = Page(template_page(seed))
                    main = np.zeros(len(page.tag))
                    for node, _, _, raw in page.pieces:
                        main[node] = max(main[node], MARK in raw)
                    for i in range(len(main) - 1, 0, -1):
                        main[page.parent[i]] = max(main[page.parent[i]], main[i])
                    table_, chars = page.features()
                    labels.append(main[chars > 0])
                    rows.append(table_[chars > 0])
                rows = np.concatenate(rows)
                yield {"label": np.concatenate(labels), "x": lists(rows.astype(np.float64).ravel(), [rows.shape[1]] * len(rows), pa.float64())}
        return run

    seeds = spark.range(t.first, t.first + t.pages, numPartitions=4)
    return map_batches(seeds, "label double, x array<double>", make).select("label", array_to_vector("x").alias("features"))


def train(spark: SparkSession, t: Training = Training()) -> list[tuple]:
    """Trees as flat arrays (feature, threshold, left, right, value times weight); a leaf points to itself."""
    rows = training_rows(spark, t).cache()
    model = GBTClassifier(maxIter=t.trees, maxDepth=t.depth, stepSize=t.step, seed=7, checkpointInterval=-1).fit(rows)
    rows.unpersist()
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        feature, threshold, left, right, value = [], [], [], [], []

        def add(node) -> int:
            i = len(feature)
            feature.append(0)
            threshold.append(0.0)
            left.append(i)
            right.append(i)
            value.append(node.prediction() * weight)
            if node.subtreeDepth() > 0:
                feature[i], threshold[i] = node.split().featureIndex(), node.split().threshold()
                left[i], right[i] = add(node.leftChild()), add(node.rightChild())
            return i

        add(tree._call_java("rootNode"))
        out.append((np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), int(t.depth)))
    return out


def margins(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Log odds of main text for each row."""
    rows, out = np.arange(len(x)), np.zeros(len(x))
    for feature, threshold, left, right, value, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        out += value[at]
    return 2 * out


def decoded(page: Page, margin: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Kept nodes. A node's worth is its margin times its own text, half its margin times all text below, and what its good children add."""
    n = len(margin)
    margin = np.clip(margin, -4, 4)
    own = chars.copy()
    parent = page.parent
    for i in range(1, n):
        own[parent[i]] -= chars[i]
    worth = (own + 0.5 * chars) * margin
    worth[0] = own[0] * margin[0]
    for i in range(n - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    kept = worth > 0
    for i in range(1, n):
        kept[i] &= kept[parent[i]]
    return kept


def main_text(html: list[str | None], trees: list[tuple]) -> list[str]:
    """Main texts of a few pages; empty for missing or empty pages and pages without main text."""
    pages = [Page(h) for h in html]
    tables = [p.features() for p in pages]
    margin = margins(trees, np.concatenate([t for t, _ in tables]))
    out, at = [], 0
    for page, (x, chars) in zip(pages, tables, strict=True):
        out.append("\n\n".join(page.blocks(decoded(page, margin[at:at + len(x)], chars))))
        at += len(x)
    return out


def extract(pages: DataFrame, trees: list[tuple], chunk: int = 200) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from its whole html (columns ``page_id, url, html``).

    Blocks are in page order, joined by two line feeds; their references are decoded and white space is one space. Missing, empty and
    broken pages give what text they have. Repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = shared.value

        def step(batch):
            html, text = batch.column(2).to_pylist(), []
            for lo in range(0, len(html), chunk):
                text += main_text(html[lo:lo + chunk], model)
            return {"text": text, "n_chars": [len(t) for t in text]}
        return step

    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return map_rows(given, ["page_id", "url", "html"], "text string, n_chars bigint", make).drop("html")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by trees that are trained on template pages."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), train(spark))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
