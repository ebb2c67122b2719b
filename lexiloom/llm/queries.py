"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import iblt, language_id, media, packing, pieces, sharding, simhash, toxicity, warc
from lexiloom.llm._shared import fold_of, table
from lexiloom.llm.token_counts import token_counts


def _identified(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return language_id.identify(documents, language_id.fit(documents.where(fold_of() != 0)), keep=keep)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _identified(table(spark, sf_dir, "documents"), ("doc_id",))
    return found.select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def toxic_field(spark: SparkSession, sf_dir: str, documents: DataFrame) -> toxicity.Field:
    """A field learned from the labelled rows of ``documents`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold_of() != 0).select("doc_id", "toxic")
    return toxicity.fit(documents, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.score(documents, toxic_field(spark, sf_dir, documents))
    return found.select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprints": op3_fingerprints,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_pieces": op6_pieces,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_media": op9_media,
    "op10_sharding": op10_sharding,
}

def _owners() -> str:
    """The shard of each slot, in two hexadecimal digits."""
    return "".join(f"{i:02x}" for i in sharding.fill([f"shard-{i}" for i in range(sharding.SHARDS)]))


SQL: dict[str, str] = {
    "op10_sharding": f"""
        with slots as (select doc_id, cast(cast('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as ubigint) % {sharding.SLOTS} as bigint) as slot from documents),
        owners as (select '{_owners()}' as hex)
        select doc_id, slot, cast('0x' || substr(hex, slot * 2 + 1, 2) as int) as shard from slots, owners""",
    "op8_warc": """
        with hashed as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
        ), firsts as (
            select payload_digest, min(page_id) as first from hashed where payload_bytes >= 100 group by 1
        )
        select page_id, payload_bytes, h.payload_digest,
               case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
               case when first <> page_id then first end as refers_to
        from hashed h left join firsts f on h.payload_digest = f.payload_digest""",
}
