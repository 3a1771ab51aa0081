"""Corpus preparation: five stages from the documents table to packed sequences.

Each stage is a function (spark, docs, sf_dir) over all that its predecessor kept. The first four return the columns of documents.

Defined results: texts without a letter and texts of unclear language go first, so null and empty texts do; of each group of
near copies the document of the smallest id stays; rows are told apart by id and text: of a repeated id each text is a document
in its own group, and of one group that of the least hash stays; rows without an id stay only if no document with an id is like them; documents with any benchmark
passage go; an empty table gives no sequences; ids may be of any type; columns beyond those of documents are kept up to packing, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import decontaminate, jaccard, langid, packing, pii
from tracewise.llm.queries import PII_KEY, table, tokenizer_path
from tracewise.llm.storage import written


class Numbered:
    """A table whose columns go by number, so that none has the name of a column made on the way; ``back`` gives their own names again."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = {f"c{k}": c for k, c in enumerate(docs.columns)}
        self.at = {c: k for k, c in self.names.items()}
        self.rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in self.names.items()])
        self.text = self.at["text"]

    def back(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        return rows.select(*[F.col(prefix + k).alias(c) for k, c in self.names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with a clear margin."""
    own = Numbered(docs)
    return own.back(langid.identify(own.rows, langid.fit(docs), own.text).where("accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles with a similarity of 0.8 link."""
    own = Numbered(docs)
    doc_id = F.col(own.at["doc_id"])
    any_id = F.lit("0").cast(docs.schema["doc_id"].dataType)
    keyed = own.rows.withColumn("key", F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, any_id).alias("id"), F.xxhash64(own.text).alias("hash")))
    stay = jaccard.join_components(keyed, "key", own.text).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    first = F.min(F.struct(own.text, *[k for k in own.names if k != own.text])).alias("r")
    return own.back(keyed.join(stay, "key", "left_semi").groupBy("key").agg(first), "r.")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    own = Numbered(docs)
    found = decontaminate.find_contamination(own.rows, table(spark, sf_dir, "benchmark"), own.text)
    return own.back(found.where(F.size("hit_spans") == 0))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    own = Numbered(docs)
    out = pii.pseudonymize(own.rows, PII_KEY, own.text)
    if "n_chars" in own.at:
        out = out.withColumn(own.at["n_chars"], F.char_length(own.text).cast(docs.schema["n_chars"].dataType))
    return own.back(out)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: a row for each piece of a document."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}

#: Compression, permutation and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
