"""The operators' queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.llm import bpe, curves, decontaminate, dedup, lm, ngram_join, phrases, pii, quality, secrets, toxicity, warc, whiten
from geocurate.llm.common import table
from geocurate.runtime import new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP3_SQL = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
), groups AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM hashed JOIN groups USING (text_sha256)
"""


@query("op3_exact_dedup", OP3_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one delivery against a new, empty index."""
    return dedup.dedup(table(spark, sf_dir, "documents"), dedup.DigestIndex.open(spark))


OP6_SQL = """
WITH hashed AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), holders AS (
    SELECT payload_digest, max(page_id) AS holder FROM hashed GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM hashed JOIN holders USING (payload_digest)
"""


@query("op6_warc_archive", OP6_SQL)
def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a new archive, and the archive's records read back."""
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.describe(warc.parse_records(warc.read_records(spark, path)))


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and positions of the secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    count = lambda k: F.size(of_kind(k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans"),
    )


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the vocabulary for many languages, and their bytes, as digests."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN).select("doc_id", "ids")
    told = ids.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    decoded = bpe.decode(told, vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def _held_out(modulus: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


@query("op9_quality_ranking")
def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a ranking learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality.train(docs, table(spark, sf_dir, "labels").filter(~_held_out(5, 0)))
    return quality.rate(docs, ranking).withColumn("held_out", _held_out(5, 0)).select(
        "doc_id", "held_out", "score", "predicted"
    )


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item or a part of one, with the place and the edits."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon and a model learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judge = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~_held_out(3, 1)))
    return toxicity.rate(docs, judge).withColumn("held_out", _held_out(3, 1)).select(
        "doc_id", "held_out", "score", "predicted"
    )


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of five-word shingles."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op4_pitman_yor_scores")
def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of six sevenths of them."""
    held_out = F.coalesce(_held_out(7, 2), F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.filter(~held_out))
    return lm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.trained).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


#: Key of the pseudonyms in the query; a user of the operator keeps one secret.
PII_KEY = "corpus"


@query("op5_pii_pseudonyms")
def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data, and how many of each kind were set."""
    safe = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return safe.select("doc_id", "text", *(F.col(f"personal.{kind}").alias(f"n_{kind}") for kind in pii.FORMS))


@query("op11_curve_neighbours")
def op11_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one, from all vectors."""
    found = curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector, learned from all distinct ones."""
    white, whitening, error = whiten.whiten(table(spark, sf_dir, "embeddings"), components=4)
    share = F.array(*[F.lit(float(v / whitening.trace)) for v in whitening.values]).cast("array<double>")
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(whitening.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


OP13_SQL = r"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), words AS (
    SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM pieces) GROUP BY lang, w1
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM words GROUP BY lang
), pairs AS (
    SELECT lang, w1, w2, count(*) AS f FROM (
        SELECT lang, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM pieces WHERE len(w) > 1) GROUP BY lang, w1, w2 HAVING count(*) >= 10
), triples AS (
    SELECT lang, w1, w2, w3, count(*) AS f FROM (
        SELECT lang, unnest(w[:-3]) AS w1, unnest(w[2:-2]) AS w2, unnest(w[3:]) AS w3 FROM pieces WHERE len(w) > 2)
    GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10
), longer AS (
    SELECT lang, w1, w2, max(f) AS f FROM (
        SELECT lang, w1, w2, f FROM triples UNION ALL SELECT lang, w2, w3, f FROM triples) GROUP BY lang, w1, w2
), scored AS (
    SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r,
        CAST(1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM pairs p JOIN words x ON p.lang = x.lang AND p.w1 = x.w1 JOIN words y ON p.lang = y.lang AND p.w2 = y.w1
        LEFT JOIN longer g ON p.lang = g.lang AND p.w1 = g.w1 AND p.w2 = g.w2
    WHERE g.f IS NULL OR 100 * g.f < 50 * p.f
    UNION ALL
    SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, CAST(least(s1, s2) AS BIGINT) FROM (
        SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2 FROM (
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, q.f AS r1, p.f AS l2, z.f AS r2
            FROM triples t JOIN words x ON t.lang = x.lang AND t.w1 = x.w1 JOIN words z ON t.lang = z.lang AND t.w3 = z.w1
                JOIN pairs p ON t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2
                JOIN pairs q ON t.lang = q.lang AND t.w2 = q.w1 AND t.w3 = q.w2))
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of every language."""
    return phrases.mine(table(spark, sf_dir, "documents"))
