"""The queries opN_<name> over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Query = Callable[[SparkSession, str], DataFrame]


#: Where the public tokenizers' vocabulary files are.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_lang_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    from .lang_ecoc import identify, learn

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_token_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    from .token_trie import token_counts

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "n_pretokens", "n_tokens")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    from .nn_descent import near_vectors

    return near_vectors(C.table(spark, sf_dir, "embeddings"), least=0.93)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of benchmark items."""
    from .decontam import contamination, is_contaminated

    d = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that 50-byte strings of earlier documents cover."""
    from .suffix_dedup import repeated_spans

    d = repeated_spans(C.table(spark, sf_dir, "documents"), window=50)
    return d.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is shown when sources are mixed by temperature."""
    from .mixing import mix, tokens_of

    d = mix(C.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens"), F.round("source_weight", 6).alias("source_weight"), "copies")


def op7_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of whole documents on two-word shingles."""
    from .minhash_tensor import near_duplicates

    return near_duplicates(C.table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that repeated runs cover: of three sentences, of one or two with over 15 words, or whole shorter documents.

    Passages of over 50 words that repeat inside other text keep such runs, whatever their first and
    last sentence run into; lines of a few words that many documents share stay.
    """
    from .span_dedup import repeated_sentences

    d = repeated_sentences(C.table(spark, sf_dir, "documents"), run=3, words=15, short=True)
    return d.select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    from .sharding import sharded

    d = sharded(C.table(spark, sf_dir, "documents"), shards=8, keep=("doc_id",))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, as read back from the formatted text and its loss mask."""
    from .chat_format import formatted, masked, read_back, text_parts

    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    c = formatted(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    c = c.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over all documents, scored by how many documents link a pair of their ids."""
    from .token_align import aligned

    return aligned(C.table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_line_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them hold, but for the last holder's."""
    from .line_index import LineIndex

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = LineIndex(spark, least=3, least_chars=20).insert(docs).kept(docs)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of documents, one in 97 of which has lost a letter."""
    from .spelling import variants

    return variants(C.table(spark, sf_dir, "documents"), least_chars=5, least=3, ratio=2, slip=97).select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_lang_ecoc": op1_lang_ecoc,
    "op2_token_trie": op2_token_trie,
    "op3_nn_descent": op3_nn_descent,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_minhash_tensor": op7_minhash_tensor,
    "op8_span_dedup": op8_span_dedup,
    "op9_sharding": op9_sharding,
    "op10_chat_format": op10_chat_format,
    "op11_token_align": op11_token_align,
    "op12_line_cuckoo": op12_line_cuckoo,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}
_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
gram AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM (SELECT *, least(len(w), 13) AS k FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
run AS (SELECT rid, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + k - 1], ' ')}})) AS x FROM doc, (SELECT DISTINCT k FROM gram) WHERE len(w) >= k),
hit AS (SELECT rid, run.k, x.i AS i, item_id FROM run JOIN gram ON gram.g = run.x.g AND gram.k = run.k),
hits AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, k, i FROM hit)) GROUP BY 1),
items AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
 coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)""",
    "op12_line_cuckoo": r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS did, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT rid, doc_id, did, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM doc),
keyed AS (SELECT *, translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
shared AS (SELECT k, max(did) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT did) >= 3),
judged AS (SELECT keyed.*, coalesce(did <> last, FALSE) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id""",
    "op10_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + len({_ESCAPED.format("role")}) + len({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
