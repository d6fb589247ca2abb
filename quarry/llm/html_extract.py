"""Main text of HTML pages, by a recurrent labeller of their blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.block_labeller import LEAST, PART, Labeller, features, trained
from quarry.llm.durable import as_id
from quarry.llm.html_blocks import blocks_of



def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Of each page the blocks of main text, joined by line feeds."""
    blocks = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * len(blocks[order[high]]) <= PART:
            high += 1
        part = order[low:high]
        long = len(blocks[part[0]]) > PART
        for k, z in zip(part, [model.long_scores(blocks[part[0]])] if long else model.scores([features(blocks[k]) for k in part]), strict=True):
            out[k] = "\n".join(b.text for b, s in zip(blocks[k], z, strict=True) if s > LEAST)
        low = high
    return out


def _extractor(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, texts = batch.column(2), []
            for low in range(0, len(pages), 256):
                texts += main_texts(pages.slice(low, 256).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of every row.

    The html is read whole; null or empty html, and pages without main text, give an empty text. Null and repeated ids and urls are kept as
    they are; other columns are ignored. Without a model one is trained on invented pages, once for a driver.
    """
    rows = pages.select(as_id(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extractor(model or trained()), "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
