"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontamination, exact_dedup, jaccard_join, language_id, license_scan, mixing, ranked_search, sharding, spelling, suffix_dedup, topk, toxicity,
)
from .common import documents

SHARDS = 16


def byte_bpe_codec() -> tuple:
    """Arguments of ``bpe.Codec`` for the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {bpe.SPECIAL: 50256}


def _remainder(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = language_id.fit(docs.filter(_remainder(3) != 1))
    found = language_id.identify(docs, net)
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_models(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple:
    """The language model of all ``docs`` and the classifier of the labelled ones that aren't held out."""
    model = toxicity.fit_characters(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_remainder(4) != 2)
    return model, toxicity.fit_classifier(docs, labels, model)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, *toxicity_models(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(documents(spark, sf_dir), byte_bpe_codec())


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest_all=True)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), digest=True)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf_dir))


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.summary(decontamination.find_items(documents(spark, sf_dir), _benchmark(spark, sf_dir)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), drop_one_in=199))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build(documents(spark, sf_dir)), _benchmark(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_language_id,
        op3_rendezvous_shards,
        op4_toxicity,
        op5_bpe_round_trip,
        op6_mix_sources,
        op7_exact_groups,
        op8_repeated_passages,
        op9_ngram_jaccard,
        op10_voronoi_top_k,
        op11_decontaminate,
        op12_spelling_variants,
        op13_ranked_search,
    )
}

ORACLES = {
    "op10_voronoi_top_k": r"""
        WITH v AS (SELECT row_number() OVER () AS uid, vec_id,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.uid, q.vec_id AS query_id, x.vec_id, list_dot_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
                   FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.uid <> x.uid),
             r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_rendezvous_shards": r"""
        WITH RECURSIVE byte AS (SELECT i::BIGINT AS i FROM range(256) t(i)),
             step AS (SELECT i, 0 AS n, i AS c FROM byte
                      UNION ALL
                      SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE n < 8),
             crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE n = 8),
             d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '~') AS key FROM documents),
             draw AS (SELECT doc_id, text, key, list_transform(range(17), lambda j:
                             {'u': ('0x' || substr(md5(key || ':' || j), 1, 13))::BIGINT, 'shard': j::INT}) AS u FROM d),
             s AS (SELECT doc_id, key, strlen(text)::BIGINT + 1 AS size, (list_max(u[1:16])).shard AS shard,
                          (list_max(u)).shard AS grown_shard,
                          xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, CASE WHEN text = '' THEN []
                              ELSE list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' ')[:-2],
                                                  lambda b: ('0x' || b)::BIGINT) END),
                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
                   FROM draw, crc),
             b AS (SELECT *, ('0x' || substr(md5(key || ':slot:' || text_crc32), 1, 8))::BIGINT % 256 AS bucket FROM s)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard
        FROM b""",
    "op6_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size,
                          ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
             a AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS lim FROM s),
             l AS (SELECT *, (sum(source_size) OVER ()
                              - coalesce(sum(cap) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY lim, source NULLS LAST
                                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM a),
             t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0
                          ELSE least(cap::DOUBLE, coalesce((min({'lim': lim, 'level': level}) FILTER (level <= lim) OVER ()).level, lim) * w) END AS target
                   FROM l),
             e AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS epochs,
                          target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM t),
             c AS (SELECT source, h, sum(size) AS words, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS through
                   FROM d GROUP BY source, h),
             y AS (SELECT c.source, h, epochs, n, rest - (through - words) AS left_, words / n AS each, through <= rest AS whole
                   FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source),
             x AS (SELECT source, h, CASE WHEN epochs >= 3 THEN 0 WHEN whole THEN n WHEN left_ < 0 THEN 0
                          ELSE floor(left_ / each) + CASE WHEN each < 2 * (left_ - floor(left_ / each) * each) THEN 1 ELSE 0 END END AS more FROM y),
             k AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS number FROM d)
        SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN number <= more THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
             JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.h = x.h""",
    "op7_exact_groups": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
                   FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (h)""",
    "op11_decontaminate": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             i AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             p AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS s
                   FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) g(j) WHERE len(w) > 0),
             d AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS s
                   FROM t, (SELECT DISTINCT k FROM p), unnest(range(1, len(w) - k + 2)) g(j)),
             h AS (SELECT r, j, k, item FROM d JOIN p USING (k, s)),
             n AS (SELECT r, count(DISTINCT x) AS n_hit FROM h, unnest(range(j, j + k)) u(x) GROUP BY r),
             m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM t LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE byte AS (SELECT i::BIGINT AS i FROM range(256) t(i)),
             step AS (SELECT i, 0 AS n, i AS c FROM byte
                      UNION ALL
                      SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE n < 8),
             crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE n = 8),
             r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id,
                          unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
                   FROM documents),
             o AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
             h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                              list_transform(string_split(regexp_replace(hex(encode(id || run)), '(..)', '\1 ', 'g'), ' ')[:-2],
                                             lambda b: ('0x' || b)::BIGINT)),
                          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS h FROM o, crc),
             d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
                   FROM h),
             w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
             x AS MATERIALIZED (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap FROM w, unnest(range(1, length(word) + 1)) g(i)),
             e AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
                   UNION SELECT x.word, gap FROM x JOIN w ON gap = w.word
                   UNION SELECT gap, x.word FROM x JOIN w ON gap = w.word),
             b AS (SELECT e.word, count(*) AS n_near, (min({'k': -w.n, 'w': near})).w AS near, max(w.n) AS near_n FROM e JOIN w ON near = w.word GROUP BY 1),
             f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
                                       CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
             c AS (SELECT word, word AS root FROM f WHERE form IS NULL
                   UNION ALL SELECT f.word, c.root FROM c JOIN f ON f.form = c.word)
        SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN c ON f.word = c.word""",
    "op13_ranked_search": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             i AS (SELECT row_number() OVER () AS q, item_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
             s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM t),
             qt AS (SELECT q, term, count(*) AS repeats FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY ALL),
             tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
             wt AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight
                    FROM tf, s GROUP BY term, n_docs),
             m AS (SELECT r, doc_id, 25 + (75 * len(w)::BIGINT * n_docs) // n_terms AS m FROM t, s),
             g AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS gain FROM tf JOIN wt USING (term) JOIN m USING (r)),
             z AS (SELECT q, r, sum(repeats * gain)::BIGINT AS score FROM qt JOIN g USING (term) GROUP BY ALL HAVING sum(repeats * gain) > 0),
             k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM z JOIN m USING (r))
        SELECT item_id, rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10""",
}
