"""The corpus operators bound to the harness tables, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import alignment, audit, html_text, language, line_dedup, media, mixing, near_dedup, packing, pii, quality, topk, warc
from tallyforge.llm.common import fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, c.k IS NOT NULL AS dropped FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


#: Fixed values of the mixing query: sources by domain, and weights in thousandths.
DOMAINS = {"hub": ["src0"], "web": ["src1", "src2", "src3", "src4", "src5", "src6", "src7"], "forum": ["src8", "src9", "src10", "src11", "src12"]}
OTHER_DOMAIN = "archive"
DOMAIN_WEIGHTS = {"hub": 150, "web": 400, "forum": 250, "archive": 200}
LANG_WEIGHTS = {"en": 450, "fr": 200, "de": 200, "es": 150}
MIX_SEED = "2024"


def domain_of_source():
    out = F.lit(OTHER_DOMAIN)
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(sources), name).otherwise(out)
    return out


def mixed(docs: DataFrame, epochs: int) -> DataFrame:
    return mixing.mix(
        docs,
        domain=domain_of_source(),
        tokens=F.expr("(length(text) + 3) div 4"),
        budget=F.expr("tokens * 3 div 4"),
        domain_weights=DOMAIN_WEIGHTS,
        lang_weights=LANG_WEIGHTS,
        epochs=epochs,
        seed=MIX_SEED,
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), epochs=2)
    return out.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("leaf_lang"), F.col("_source").alias("leaf_source"), F.col("_epoch").cast("long").alias("epoch"), F.col("_tokens").alias("tokens"), F.col("_take").alias("take_tokens"))


def _shared(of: str, parent: str, name: str) -> str:
    """One level of the tree in SQL: children of `of` (cap, weight, budget) with their share."""
    return f"""
  SELECT *, CASE WHEN NOT is_open THEN cap ELSE part + CASE WHEN place <= first_rest - sum(coalesce(part, 0)) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END END AS share
  FROM (SELECT *, CASE WHEN is_open THEN first_rest * weight // first_w END AS part,
               sum(CASE WHEN is_open THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY {name}) AS place
        FROM (SELECT *, max(CASE WHEN is_open THEN rest END) OVER (PARTITION BY {parent}) AS first_rest,
                     max(CASE WHEN is_open THEN w END) OVER (PARTITION BY {parent}) AS first_w
              FROM (SELECT *, cap * w > rest * weight AS is_open
                    FROM (SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                                 sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w
                          FROM {of}))))"""


def _sql_case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


OP3_SQL = f"""
WITH t AS (
  SELECT doc_id, CASE {" ".join(f"WHEN source IN ({', '.join(repr(x) for x in xs)}) THEN '{d}'" for d, xs in DOMAINS.items())} ELSE '{OTHER_DOMAIN}' END AS domain,
         coalesce(lang, '?') AS leaf_lang, coalesce(source, '?') AS leaf_source, (length(text) + 3) // 4 AS tokens
  FROM documents WHERE length(text) > 0
), leaves AS (
  SELECT domain, leaf_lang, leaf_source, CAST(sum(tokens) * 2 AS BIGINT) AS cap, 1 AS weight FROM t GROUP BY ALL
), langs AS (
  SELECT domain, leaf_lang, CAST(sum(cap) AS BIGINT) AS cap, {_sql_case("leaf_lang", LANG_WEIGHTS)} AS weight FROM leaves GROUP BY ALL
), domains AS (
  SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_sql_case("domain", DOMAIN_WEIGHTS)} AS weight,
         least((SELECT CAST(sum(tokens) AS BIGINT) * 3 // 4 FROM t), (SELECT CAST(sum(cap) AS BIGINT) FROM leaves)) AS budget FROM langs GROUP BY domain
), d AS ({_shared("domains", "1", "domain")}
), lang_in AS (SELECT langs.*, d.share AS budget FROM langs JOIN d USING (domain)
), g AS ({_shared("lang_in", "domain", "leaf_lang")}
), leaf_in AS (SELECT leaves.*, g.share AS budget FROM leaves JOIN g USING (domain, leaf_lang)
), s AS ({_shared("leaf_in", "domain, leaf_lang", "leaf_source")}
), ordered AS (
  SELECT t.*, epoch, share, sum(tokens) OVER (PARTITION BY domain, leaf_lang, leaf_source ORDER BY epoch, md5('{MIX_SEED}:' || epoch || ':' || doc_id)) - tokens AS before
  FROM t JOIN s USING (domain, leaf_lang, leaf_source) CROSS JOIN (SELECT unnest([1, 2]) AS epoch)
)
SELECT doc_id, domain, leaf_lang, leaf_source, CAST(epoch AS BIGINT) AS epoch, tokens, CAST(least(tokens, share - before) AS BIGINT) AS take_tokens
FROM ordered WHERE before < share
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(fold("doc_id") != 0))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return media.prefixed(media.digest(stored))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.learn(docs.where(fold("doc_id") != 0), labels.where(fold("doc_id") != 0).select("doc_id", F.col("quality").alias("label")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= quality.ACCEPT).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.counted("_base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    spans = [pii.written("_spans").alias("spans"), F.size("_spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(pii.written("_base").cast("binary"), 256).alias("base_sha256"), *spans)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write(pages.select("page_id", "url", "html"))
    found = archive.fetch(archive.lookup(pages.select("url")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= {warc.REVISIT_BYTES} AND page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= {warc.REVISIT_BYTES} AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p JOIN k USING (html)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), s(filter_order, step, bit, before) AS (VALUES {", ".join(map(repr, audit.steps(list(audit.FILTERS))))}
), f AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM f
"""


QUERIES = {f.__name__: f for f in (op1_packing, op2_language, op3_mixing, op4_line_dedup, op5_media, op6_quality, op7_topk, op8_pii, op9_near_dedup, op10_html, op11_warc, op12_alignment, op13_audit)}
ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op4_line_dedup": OP4_SQL, "op7_topk": OP7_SQL, "op11_warc": OP11_SQL, "op13_audit": OP13_SQL}
