"""Driver queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm import chat, decontaminate, htmltext, jaccard, jpeg, langid, lm, media, negatives, packing, pii, quality, ranking, sql, windows
from tracewise.llm.storage import written
from tracewise.plans.iterate import ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the id as text modulo n is 2; a null id is in the training part."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == 2, F.lit(False))


#: For these queries only; a real key is a secret.
PII_KEY = "key of the test queries"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their pseudonymized text and the number of values replaced."""
    out = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", *[F.col(f"found.{k}").alias(f"n_{k}") for k in pii.KINDS])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rate(docs, quality.train(docs)).select("doc_id", "posterior", "score", "keep")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", _remainder(4).alias("held_out"))
    samples = langid.fit(docs.where("NOT held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), samples).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def _read_back(batches):
    """Digests of conversations, from their formatted text and loss mask alone."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            text = row["formatted"]
            turns = chat.parse_turns(text)
            loss = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in row["loss"])
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            digest = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
            out.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": digest[0], "loss_chars": len(loss), "loss_sha256": digest[1], "formatted_chars": len(text)})
        yield pa.RecordBatch.from_pylist(out, schema=_CHAT)


_CHAT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
NESTED = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree without forks: the parent of a turn is the turn before it. Turns are numbered over all conversations
    at once, so a conversation may span tasks."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = said.unionByName(spark.createDataFrame([(-7, 0, "user", NESTED), (-7, 1, "assistant", NESTED)], "conv_id long, turn long, role string, text string"))
    said = written(ranked(said.withColumn("order", F.struct("conv_id", "turn", "role", "text")), "order", "id").drop("order", "turn"), "turns")
    first = said.groupBy("conv_id").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    nodes = said.join(first, "id", "left").select("id", F.when(F.col("first").isNull(), F.col("id") - 1).alias("parent"), "role", "text")
    made = chat.format_trees(nodes, branches=1)
    made = made.join(said.select(F.col("id").alias("root"), "conv_id"), "root")
    return made.select("conv_id", "formatted", "loss").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file, where the box has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


_MEDIA = [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]


def _media_digest(image: jpeg.Decoder, raw: bytes) -> tuple:
    payload = jpeg.payload_of(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), jpeg.features(image)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    files = media.store_texts(docs).select("doc_id", "n_bytes", "media")
    return media.read_media(files, _MEDIA, _media_digest, keep=["doc_id", "n_bytes"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _remainder(7).alias("held_out"))
    model = lm.train(docs.where("NOT held_out"), order=3)
    out = lm.score(docs, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", lm.perplexity().alias("perplexity"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is changed where the id is divisible by 7; anchors are the rows whose id is divisible by 100."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, changed)


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_chat": op4_chat,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_jpeg": op7_jpeg,
    "op8_decontamination": op8_decontamination,
    "op9_html": op9_html,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_window_packing": op12_window_packing,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL = {"op5_jaccard_join": sql.OP5, "op8_decontamination": sql.OP8, "op11_hard_negatives": sql.OP11, "op13_ranked_search": sql.OP13}
