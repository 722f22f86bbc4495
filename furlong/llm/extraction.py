"""Main text of web pages: blocks of a page, labelled by a recurrent network, joined in order.

A page that is null, empty or has no main text gives an empty text. The network
is trained once per run on the driver, on practice pages (see html_model), and
is of fixed size. Repeated rows give repeated results; a null id or url stays
null. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import map_batches
from furlong.llm.html_blocks import blocks
from furlong.llm.html_model import PAGES, Labeller, features, practice

PAGES_AT_ONCE = 250
RESULT = "page_id long, url string, text string, labels array<double>"


@functools.cache
def labeller() -> Labeller:
    pages, truth = [], []
    for seed in range(PAGES):
        page, main = practice(seed)
        found = blocks(page)
        if found and len(found) == len(main):
            pages.append((len(found), features(found)))
            truth.append(np.array(main, np.float32))
    model = Labeller()
    model.fit(pages, truth)
    return model


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and the probability of every block."""
    model = labeller()
    names = [part.split()[0] for part in RESULT.split(", ")]

    def step(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(low, PAGES_AT_ONCE)
                found = [blocks(page) for page in part.column(2).to_pylist()]
                labels = model.label(found)
                texts = ["\n".join(block.text for block, p in zip(page, own) if p >= 0.5) for page, own in zip(found, labels)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([own.tolist() for own in labels], pa.list_(pa.float64()))],
                    names,
                )

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), step, RESULT)
