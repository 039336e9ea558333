"""The stages of ``corpus_pipeline``: each applies one operator to what its predecessor kept, and its decisions take effect.

All but the last return the columns of their input, whatever their names: columns that an operator does not read pass it
under names of their own, so none is taken for one of its results. Results are joined to nothing: operators carry the
columns. Null and empty texts, null and repeated ids and an empty table are input like any other; what becomes of them is
said at each operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import read_table


def _apart(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with all columns but ``used`` renamed, the names to carry, and the columns that give back those of ``docs``."""
    names = {c: c if c in used else f"x{i}_" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    back = [F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()]
    return plain, [n for n in names.values() if n != "doc_id"], back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not predict toxic."""
    from tracelight.llm.toxicity import fit, score

    plain, carry, back = _apart(docs, ("doc_id", "text"))
    model = fit(plain, read_table(spark, sf_dir, "labels"))
    return score(plain, model, carry=tuple(carry)).where("predicted = 0").select(*back)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have too few words and go."""
    from tracelight.llm.quality import judge

    plain, carry, back = _apart(docs, ("doc_id", "text", "lang"))
    return judge(plain, carry=tuple(carry)).where("kept").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row: the smallest id, null ids last.

    Stages read their input from files, so its rows come in one order each time.
    """
    from tracelight.llm.near_copies import first_of_similar

    return first_of_similar(docs, shingle=5, similarity=0.8, fixed=True)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; ``text`` without the passages that occurred earlier, ``n_chars`` of what is left."""
    from tracelight.llm.substring import remove_repeats

    plain, carry, back = _apart(docs, ("doc_id", "text"))
    out = remove_repeats(plain, carry=tuple(c for c in carry if c != "text")).withColumnRenamed("kept_text", "text")
    out = out.select(*back)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences, with their ids."""
    from tracelight.llm.packing import pack_documents

    return pack_documents(docs)
