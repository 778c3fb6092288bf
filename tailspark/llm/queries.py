"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations


from . import cover_tree, exact_dedup, mixing, order_minhash, pieces, secrets, sharding, toxicity, warc
from .common import save, small_batches, table


def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))[1]


def op6_nbest_pieces(spark, sf_dir):
    with small_batches(spark):
        return save(pieces.digest_columns(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")), "pieces")


def op7_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_cover_tree(spark, sf_dir):
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark, sf_dir):
    with small_batches(spark):
        return save(pieces.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "n_pretokens"), "tokens")


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc, op3_exact_dedup, op4_order_minhash, op5_sharding, op6_nbest_pieces, op7_secrets, op8_cover_tree, op9_token_counts, op10_toxicity)}
ORACLES = {"op1_mixing": mixing.ORACLE, "op2_warc": warc.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op7_secrets": secrets.ORACLE, "op8_cover_tree": cover_tree.ORACLE}
