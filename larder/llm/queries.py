"""The thin registered queries, each with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.llm import ann, bpe, chat, exact_dedup, langid, near_dedup, negatives, packing, piece, secrets, sharding, spelling, url_filter

#: Host and path rules of the URL filter (fixed values).
URL_RULES = [
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
]
PACK_TOKENIZER, BPE_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_filter.fit(url_filter.labelled_from_rules(pages, URL_RULES)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_read(spark, sf_dir, "documents"), shards=24)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_read(spark, sf_dir, "documents"), tokenizer_path(BPE_TOKENIZER))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def held_out(docs: DataFrame) -> Column:
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out(docs)))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "rejected")


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tools(chat.events_of_turns(_read(spark, sf_dir, "conversations")), chat.TURN_SCHEMAS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def misspelt(runs: DataFrame) -> Column:
    """The run, in one of 31 cases without the letter at h % length; h is the crc32 of ``<doc_id>:<run>``, a null id empty."""
    h = F.crc32(F.concat(F.coalesce(runs["doc_id"].cast("string"), F.lit("")), F.lit(":"), runs["run"]).cast("binary"))
    at = (h % F.length(runs["run"])).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr(runs["run"], F.lit(1), at), F.substr(runs["run"], at + 2))).otherwise(runs["run"])


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(_read(spark, sf_dir, "documents"))
    return spelling.variants(spelling.counted(runs.select(misspelt(runs).alias("word"))))


def op13_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.piece_digests(_read(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_hilbert_shards, op4_exact_dedup, op5_hnsw, op6_minhash, op7_bpe, op8_secrets, op9_langid, op10_tool_calls, op11_hard_negatives, op12_spelling, op13_piece, pipeline)}

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": """
        WITH u AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        ),
        positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
}
