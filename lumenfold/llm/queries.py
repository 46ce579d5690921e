"""Queries of the operators: name → function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import (
    conversations,
    credentials,
    exact_dedup,
    fertility,
    html_crf,
    merkle,
    mixing,
    packing,
    pii,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxicity_model(docs: DataFrame, folder: str):
    """Fitted on the labelled rows that aren't held out."""
    labels = table(docs.sparkSession, folder, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.fit(docs, labels)


@query
def op1_toxicity(spark, folder):
    """Score and prediction of every document."""
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, folder))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_simhash(spark, folder):
    """Fingerprint and component of every document."""
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_fertility(spark, folder):
    """Base counts, measures and verdict of every document."""
    return fertility.quality(table(spark, folder, "documents"))


@query
def op5_exact_dedup(spark, folder):
    """Group, decision and digest of every document."""
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _listed(spans: str):
    """kind:start:end of every span, joined by commas."""
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


@query
def op6_pii(spark, folder):
    """Counts, digest and spans of the personal data of every document."""
    found = pii.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in pii.KINDS),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )


@query
def op7_sharding(spark, folder):
    """Slot and shard of every document."""
    return sharding.place(table(spark, folder, "documents")).select("doc_id", "slot", "shard")


@query
def op8_token_counts(spark, folder):
    """Tokens of every document, counted from flat token files."""
    return token_counts.document_counts(table(spark, folder, "documents")).select("doc_id", "n_tokens")


@query
def op9_html_crf(spark, folder):
    """Main text of every page."""
    return html_crf.extract(table(spark, folder, "pages"))


@query
def op10_mixing(spark, folder):
    """What the mix takes of every document, and where its first copy stands in training."""
    out = mixing.plan(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "rank")


@query
def op10_mixing_order(spark, folder):
    """Training position and rank of every copy that the mix takes."""
    return mixing.schedule(table(spark, folder, "documents"))


@query
def op3_packing(spark, folder):
    """Every piece of every document and its place."""
    docs = table(spark, folder, "documents")
    return packing.pack(packing.pieces(docs, order=packing.file_order(docs)))


@query
def op11_secrets(spark, folder):
    """Counts, digest and spans of the secrets of every document."""
    found = credentials.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in credentials.KINDS),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )


@query
def op12_conversations(spark, folder):
    """Faults, least repair and its digest of every conversation."""
    return conversations.audit(table(spark, folder, "conversations"))


@query
def op13_merkle(spark, folder):
    """Leaf, proof and folded root of every document after tampering with a third of them."""
    found = merkle.manifest(table(spark, folder, "documents"), merkle.tampered())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
