"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, chroma, infill, merkle, mincut, mixing, packing, quality, rollup, secrets, simhash, vector_packing, warc
from strandline.session import materialize, read_table, scratch_folder


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents with counts estimated from n_chars, revise them to the tokenizer's counts, count white-space
    words beside, delete copies of a text but the one with the smallest doc_id, and replay a batch, which changes nothing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha1("text").alias("digest"), mixing.word_count(F.col("text")).alias("n_words"), "text")
    counted = materialize(packing.token_counts(docs, "n_tokens"), "token-counts")
    store = rollup.TokenRollup(spark, f"{scratch_folder(spark, 'rollup')}/totals")
    guess = F.ceil(F.col("n_chars") / 4)
    store.commit("load", rollup.inserted(counted, "chars-4", guess))
    revision = rollup.revised(counted, "chars-4", guess, "n_tokens", packing.TOKENIZER)
    store.commit("count", revision)
    store.commit("words", rollup.inserted(counted, "words-1", "n_words"))
    firsts = materialize(counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND digest IS NOT NULL"), "first-copies")
    copies = counted.join(firsts, "digest").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    store.commit("drop-copies", rollup.deleted(copies, packing.TOKENIZER).unionByName(rollup.deleted(copies, "words-1", "n_words")))
    store.commit("count", revision)
    store.compact()
    return store.totals()


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark, 'warc')}/archives"
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each vector of embeddings is played as a melody, which the operator then hears."""
    return chroma.align_all(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.melody)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(secrets.joined(F.col("base")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(read_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.restored(infill.transform(read_table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row or so claims a text whose capitals were lowered."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    claimed = merkle.leaf_digest([text if c == "text" else F.col(c) for c in merkle.FIELDS])
    manifest = merkle.build(docs, carry={"claimed": claimed})
    found = merkle.proofs(manifest).withColumn("root", F.lit(manifest.root).cast("string")).withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_rollup": op1_token_rollup,
    "op2_warc": op2_warc,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_prefix_tree": op5_chat_prefix_tree,
    "op6_mixing": op6_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash": op8_simhash,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_mincut": op10_html_mincut,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_packing": op12_vector_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op5_chat_prefix_tree": chat.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
