"""A corpus from raw documents to packed sequences: five stages, each written and read again.

Stages take (spark, docs, sf_dir) and, but for the last, return the columns of `docs`,
extra ones included. Null and empty texts, null and repeated ids and repeated rows are
rows like others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm import decontamination, jaccard_join, packing, privacy, toxicity
from stagewise.llm.common import column, read
from stagewise.session import Workspace

def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key of their own, as ids may be null or repeated, and the name of the key.

    Written once: a number would not be the same in another scan that is cut otherwise.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    return Workspace(docs.sparkSession).stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not find toxic."""
    lexicon = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id; documents without words stay.

    Null ids come last; of rows with equal id and text the first of the table stays.
    """
    rows, key = _numbered(docs)
    groups = jaccard_join.near_copies(rows, id_col=key).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = ids.join(groups, "row").groupBy("component_id").agg(F.min(order).alias("o"))
    return _back(docs, rows.join(first.select(F.col("o.row").alias(key)), key, "left_semi"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none."""
    rows, key = _numbered(docs)
    found = decontamination.contained_items(rows, read(spark, sf_dir, "benchmark"), id_col=key)
    return _back(docs, rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms generalised; null texts come out empty.

    `n_chars` follows the text; other columns, whatever they are called, pass unchanged.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # by place, as names may clash with those of the operator
    plain = docs.select("doc_id", "text", *[column(c).alias(f"rest_{i}") for i, c in enumerate(rest)])
    found = privacy.find_personal_data(plain, extra=tuple(f"rest_{i}" for i in range(len(rest))))
    text = privacy.sanitised(found).alias("text")
    out = found.select("doc_id", text, *[F.col(f"rest_{i}") for i in range(len(rest))])
    out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    back = {c: F.col(f"rest_{i}").alias(c) for i, c in enumerate(rest)}
    return out.select([back[c] if c in back else F.col(c) for c in docs.columns])


def _back(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of `docs`, dots in their names included."""
    return rows.select([column(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", decontaminate),
    ("privacy", sanitise),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what one returns is written and read by the next."""
    space = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned weights, text spans and token ids are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None
