"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hard_negatives, mixing, near_dup, pii, prefix_trie, token_scan, toxicity, url_filter, vp_tree, warc, winnow
from . import oracle as _oracle
from .common import new_path, sha256_hex, table, written


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into flat files, then counts by scanning those for separators."""
    ranks = token_scan.vocabulary()
    folder = new_path(spark, "tokens")
    order = written(token_scan.write_token_files(table(spark, sf_dir, "documents"), folder, ranks), "token-order")
    found = token_scan.scan(token_scan.token_files(spark, folder), separator=len(ranks))
    return order.join(found.hint("merge"), ["file", "seq"]).select("doc_id", "n_tokens")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.detect(table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and items that leak into them."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.components(table(spark, sf_dir, "documents"), near_dup.Settings(words=4))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: a page whose id has a row in ``labels`` is bad if its quality is 0."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    outcomes = pages.join(labels, "page_id").select("url", "bad")
    return url_filter.filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        winnow.as_text(F.col("prints")).alias("fingerprint"),
        winnow.as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.score(documents, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    chats = chat_format.format_chat(conversations.unionByName(extra))
    whole = F.when(F.col("round_trip"), F.col("formatted")).otherwise(F.raise_error("a conversation doesn't come back from its text").cast("string"))
    chats = chats.withColumn("formatted", whole)
    # What the parser and the mask give back from the rendered text, not the source.
    masked = F.transform("loss_spans", lambda s: F.substr("formatted", s.start + 1, s.end - s.start))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = chats.select("conv_id", "turns", "formatted", digest.alias("said"), F.array_join(F.transform(masked, chat_format.unescape), "").alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(F.col("said")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, then reads every record back by the index."""
    records = warc.dedup_records(table(spark, sf_dir, "pages"))
    index = written(warc.write(records, new_path(spark, "warc")), "warc-index")
    back = warc.read(index.select("file", "offset", "length"), with_payload=False)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label).withColumn("anchor", F.col("vec_id") % 50 == 0))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation starts with up to five turns of the first one of its hundred."""
    conv = F.col("conv")
    return prefix_trie.report(table(spark, sf_dir, "conversations"), base=conv - conv % 100, lead=F.crc32(conv.cast("string")) % 6, most=5)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vp_tree.search(vp_tree.build(rows), asked, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # it imports this subpackage

    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": op1_token_counts,
        "op2_pii": op2_pii,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_url_filters": op5_url_filters,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_toxicity": op7_toxicity,
        "op8_mixing_sources": op8_mixing_sources,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_warc": op10_warc,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return _oracle.oracle_sql()
