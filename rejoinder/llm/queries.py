"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rejoinder.llm import block_naming, licenses, mixing, ngram_join, packing, periodic_runs, separators, site_quality, token_shards, toxicity, vector_codes, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.document_token_counts(spark, documents(spark, sf_dir), tokenizer())


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def _license_sql() -> str:
    """The same by trying every block of every text that holds enough of a template's words."""
    low = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    words = rf"list_filter(regexp_split_to_array({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    rows = [f"('{label}', {own!r}, {-(-4 * len(own) // 5)}, {span}, {must!r}::VARCHAR[], {bar!r}::VARCHAR[])" for label, own, span, must, bar in licenses.rules()]
    places = ", ".join(f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r}) AS p{k}" for k, p in enumerate(licenses.PHRASES))
    names = list(licenses.PHRASES.values())
    base = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{n}' END" for k, n in enumerate(names)) + "], lambda x: x IS NOT NULL))"
    every = "list_concat(" + ", ".join(f"p{k}" for k in range(len(names))) + ")"
    return f"""
WITH t(label, tw, need, span, must, bar) AS (VALUES {", ".join(rows)}),
d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} FROM d),
l AS MATERIALIZED (SELECT doc_id, w, list_distinct(w) AS dw FROM d),
c AS (SELECT doc_id, w, t.* FROM l JOIN t ON len(list_intersect(dw, tw)) >= need),
b AS (SELECT doc_id, label, tw, need, must, bar, w[i + 1 : i + span] AS block FROM (SELECT *, unnest(range(len(w))) AS i FROM c) WHERE list_contains(tw, w[i + 1])),
m AS (SELECT doc_id, label, max(s) AS met, max(s) FILTER (tells) AS c FROM
  (SELECT doc_id, label, need, tw, len(list_intersect(list_distinct(block), tw)) AS n, n / len(tw) AS s, list_has_all(block, must) AND NOT list_has_any(block, bar) AS tells FROM b) WHERE n >= need GROUP BY ALL),
a AS (SELECT doc_id, coalesce(list(label) FILTER (c IS NOT NULL), []) AS added, max(c) AS best, list_sort(list_distinct(list(label))) AS met_labels, max(met) AS met FROM m GROUP BY doc_id),
q AS (SELECT doc_id, n_words, {every} AS every, {base} AS base FROM p)
SELECT doc_id, n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(added, [])))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score,
  coalesce(array_to_string(met_labels, ','), '') AS met_labels, coalesce(met, 0.0)::DOUBLE AS met_score
FROM q LEFT JOIN a USING (doc_id)"""


ORACLE["op2_license_scan"] = _license_sql()


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(documents(spark, sf_dir))


@query
def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(docs, toxicity.learn(docs, labels))


@query
def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(documents(spark, sf_dir)).drop("row")


ORACLE["op5_block_naming"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


@query
def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sampled(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"), texts=False, shares=True)
    told = [F.round(f"{kind}_{k}", 6).alias(f"{kind}_{k}") for k in ("source", "lang", "topic") for kind in ("asked", "achieved")]
    return mixed.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__probability", 6).alias("probability"), F.col("__kept").alias("kept"), *told)


def _mixing_sql(documents: str = "documents", rounds: int = 60) -> str:
    """Bounded raking unrolled: a window for each margin and round."""
    steps, names = [f"r0 AS MATERIALIZED (SELECT *, {mixing.BUDGET} AS b, {mixing.BUDGET} * tokens AS weight FROM k)"], ("source", "lang", "topic")
    for i in range(3 * rounds):
        c = names[i % 3]
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight, held, free), CASE WHEN free > 0 THEN weight * greatest(b * whole * t_{c} - held, 0) / free WHEN held > 0 THEN weight * b * whole * t_{c} / held ELSE weight END AS weight
  FROM (SELECT *, sum(CASE WHEN weight >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {c}) AS held, sum(CASE WHEN weight >= tokens THEN 0 ELSE weight END) OVER (PARTITION BY {c}) AS free FROM r{i}))""")
    shares = "".join(
        f""", h_{c} AS (SELECT {c}, sum(tokens)::DOUBLE AS n, pow(sum(tokens)::DOUBLE, {p}) AS t FROM g GROUP BY {c}), a_{c} AS (SELECT {c}, n / ({mixing.BUDGET} * whole) AS cap, t / sum(t) OVER () AS t FROM h_{c}, total WHERE t > 0),
o_{c} AS (SELECT *, cap < t * (1 - coalesce(sum(cap) OVER (ORDER BY cap / t, {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(t) OVER (ORDER BY cap / t, {c} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM a_{c}),
s_{c} AS (SELECT h_{c}.{c}, coalesce(CASE WHEN held THEN cap ELSE o_{c}.t * (SELECT (1 - coalesce(sum(cap) FILTER (held), 0)) / sum(t) FILTER (NOT held) FROM o_{c}) END, 0) AS t_{c} FROM h_{c} LEFT JOIN o_{c} USING ({c}))"""
        for c, p in mixing.TEMPER.items()
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS x FROM {documents}),
w AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains(x, ' | ') THEN 'tables' WHEN length(x) < 400 THEN 'notes' WHEN length(x) > 6000 THEN 'long reads' ELSE 'articles' END AS topic,
  len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM d),
g AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM w GROUP BY ALL), total AS (SELECT sum(tokens) AS whole FROM g){shares},
k AS (SELECT g.*, t_source, t_lang, t_topic, whole FROM g JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic), total),
{", ".join(steps)},
p AS (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN least(1.0, weight / tokens) ELSE 1.0 END AS probability FROM r{3 * rounds}),
q AS (SELECT source, lang, topic, probability, {", ".join(f"round(coalesce(t_{c}.t, 0), 6) AS asked_{c}, round(coalesce(sum(e) OVER (PARTITION BY {c}) / nullif(sum(e) OVER (), 0), 0), 6) AS achieved_{c}" for c in names)}
  FROM (SELECT *, tokens * round(probability, 9) AS e FROM p) {" ".join(f"LEFT JOIN (SELECT {c}, t FROM a_{c}) t_{c} USING ({c})" for c in names)})
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(probability, 6) AS probability,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < round(probability, 9) AS kept, {", ".join(f"asked_{c}, achieved_{c}" for c in names)}
FROM w JOIN q USING (source, lang, topic)"""


ORACLE["op6_raked_mixture"] = _mixing_sql()


@query
def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = site_quality.judged(docs.select("doc_id", "text", "source", "lang"), site_quality.learn(docs, labels), F.col("source"), F.col("lang"), texts=False)
    return got.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), F.col("__logit").alias("evidence"), F.col("__host_rate").alias("host_rate"), F.col("__path_rate").alias("path_rate"), F.col("__posterior").alias("posterior"), (F.col("__posterior") >= site_quality.THRESHOLD).alias("kept"))


@query
def op8_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised_pieces(documents(spark, sf_dir), tokenizer())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "part_bins", "part_bound", "total_bins", "total_bound")


@query
def op9_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op10_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "range_no")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_tails(documents(spark, sf_dir))))


@query
def op12_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.write_shards(documents(spark, sf_dir), tokenizer())
    first = shards.select("folder").first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, n_ends long")
    return token_shards.read_documents(shards, first[0]).select("doc_id", F.col("place").alias("start"), "n_tokens", "ids_crc32", "n_ends")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded, book = vector_codes.vector_codes(spark, rows)
    return vector_codes.label_errors(coded).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.codebook_sha256(book)).alias("codebooks_sha256"))


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """The same by all distances of every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""n{k} AS MATERIALIZED (SELECT r, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
  (SELECT r, part, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN b{k} USING (part)) GROUP BY r, part, x)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM b{k} LEFT JOIN
  (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM n{k}) GROUP BY ALL) GROUP BY ALL) USING (part, entry))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, * FROM k),
x AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM o, range({parts}) AS p(part)),
b0 AS MATERIALIZED (SELECT part, r AS entry, x AS c FROM x WHERE r < {entries}),
{", ".join(steps)},
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS sha FROM b{rounds}),
e AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM o JOIN e USING (r), s"""


ORACLE["op13_vector_codes"] = _codes_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
