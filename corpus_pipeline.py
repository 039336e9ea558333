"""Documents to packed training sequences in five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the classifier rejects go.
2. quality rules: documents that fail the base counts or diverge from every language reference go.
3. SimHash near-dedup: the document with the smallest id of each group stays.
4. substring dedup: passages of 20 words and more that occurred earlier go from the texts.
5. packing: what is left is packed into context windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelight.llm import stages
from tracelight.llm.common import Scratch, read_table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("quality_rules", stages.drop_poor),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.drop_repeats),
    ("packing", stages.pack),
]

# A trained classifier, connected components and tokenizer ids have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for ``documents`` of ``sf_dir``; a stage's table goes when the next one is written."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.table(stage(spark, docs, sf_dir))
        if last is not None:
            last.clear()
        last = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
