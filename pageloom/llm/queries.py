"""The named queries of this subpackage; ``QUERIES`` maps each to its job."""

from __future__ import annotations

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    bpe, cover_tree, fill_middle, html_text, licenses, lookup_kmeans, online_packing, packing, pii, quality,
    secrets, simhash, url_trust,
)
from pageloom.llm.common import LOWER, UPPER

QUERIES = {}
SQL: dict[str, str] = {}


def query(job):
    QUERIES[job.__name__] = job
    return job


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _spans(kinds: Sequence[str] | None = None) -> Column:
    spans = F.col("spans")
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def _span_digest(found: DataFrame, kinds: Sequence[str]) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(_spans(kinds), 256).alias("base_sha256"),
        _spans().alias("spans"),
    )


# The rules of the query.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def _url_trust_sql() -> str:
    letters = f"'{UPPER}', '{LOWER}'"

    def host(url: str) -> str:
        return f"translate(regexp_extract({url}, '://([^/?#]*)', 1), {letters})"

    def fits(rule: str) -> str:
        domain, slash, rest = rule.partition("/")
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}')"

    longest = sorted(URL_RULES, key=lambda r: -len(r[0]))
    rule, action = (
        "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in longest) + " END" for k in (0, 1)
    )

    def ranks(name: str, mass: str, start: str, end: str) -> str:
        return f"""{name}_shares AS (
      SELECT {start} AS a, {end} AS b, n / sum(n) OVER (PARTITION BY {start}) AS share FROM edges),
  {name}_seeds AS (SELECT host, {mass} AS mass FROM seeds WHERE {mass} > 0),
  {name}_ranks AS (SELECT 0 AS round, host, mass AS rank FROM {name}_seeds UNION ALL (
    WITH moved AS (SELECT b AS host, sum({url_trust.DAMPING}::DOUBLE * share * rank) AS got
        FROM {name}_ranks JOIN {name}_shares ON a = host WHERE round < {url_trust.ROUNDS} GROUP BY b),
      back AS (SELECT (m.mass - coalesce(g.got, 0)) / m.mass AS back, r.round
        FROM (SELECT sum(mass) AS mass FROM {name}_seeds) m, (SELECT sum(got) AS got FROM moved) g,
          (SELECT max(round) AS round FROM {name}_ranks) r WHERE r.round < {url_trust.ROUNDS})
    SELECT back.round + 1, coalesce(m.host, s.host), coalesce(got, 0) + back * coalesce(mass, 0)
    FROM back, moved m FULL JOIN {name}_seeds s ON m.host = s.host)),
  {name} AS (SELECT host, rank FROM {name}_ranks WHERE round = {url_trust.ROUNDS})"""

    reference = url_trust.REFERENCE.replace("'", "''")
    share = f"round(coalesce(b.rank, 0) / (coalesce(g.rank, 0) + coalesce(b.rank, 0) + {url_trust.DOUBT}), 9)"
    return f"""
WITH RECURSIVE named AS (SELECT page_id, coalesce({host("url")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  judged AS (SELECT *, {rule} AS rule, {action} AS action FROM named),
  seeds AS (SELECT host, sum((action = 'allow')::INT)::DOUBLE AS good, sum((action = 'block')::INT)::DOUBLE AS bad
    FROM judged WHERE host <> '' AND action IS NOT NULL GROUP BY host),
  links AS (SELECT url, unnest(regexp_extract_all(html, '{reference}', 1)) AS link FROM pages),
  edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT {host("url")} AS src,
      {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links)
    WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
  {ranks("trust", "good", "src", "dst")},
  {ranks("distrust", "bad", "dst", "src")}
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {share} >= {url_trust.THRESHOLD} THEN 'block'
    ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN trust g USING (host) LEFT JOIN distrust b USING (host)
"""


SQL["op1_url_trust"] = _url_trust_sql()


@query
def op1_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return url_trust.judge(_table(spark, folder, "pages"), URL_RULES).drop("distrust")


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(coded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _span_digest(secrets.scan(_table(spark, folder, "documents")), secrets.BASE_KINDS)


# What the query gives for pages with one article of headings and paragraphs, as the given ones are.
SQL["op6_main_text"] = r"""
WITH articles AS (SELECT page_id, url, string_split_regex(regexp_replace(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer|$)', 1), '<[^>]*$', ''),
    '</?(p|h1)>') AS parts FROM pages),
  texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda p:
    trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(p, '<br>', ' '), '<[^>]+>', '', 'g'),
      '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda t: t <> ''), chr(10) || chr(10)) AS text
    FROM articles)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(_table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.duplicates(_table(spark, folder, "documents"), shingle=3, distance=3)


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"))


SQL["op9_embedding_duplicates"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, cast(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding,
        lambda x: coalesce(isfinite(x), false)), false)
      AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.v, b.v) >= 0.95::DOUBLE),
  walk(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings
    UNION SELECT w.vec_id, l.b FROM walk w JOIN links l ON l.a = w.reached),
  least AS (SELECT vec_id, min(reached) AS component_id FROM walk GROUP BY vec_id),
  counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


@query
def op9_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.duplicates(_table(spark, folder, "embeddings"), least=0.95)


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return _span_digest(pii.scan(_table(spark, folder, "documents")), pii.BASE_KINDS)


def _lookup_kmeans_sql() -> str:
    k, rounds, size = lookup_kmeans.CLUSTERS, lookup_kmeans.ROUNDS, lookup_kmeans.DIMENSIONS

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT i, vec_id, v, c, distance FROM (SELECT i, vec_id, v, c, distance,
      row_number() OVER (PARTITION BY i ORDER BY distance, c) AS nth FROM (
        SELECT i, vec_id, v, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT
          AS distance FROM vectors, c{n})) WHERE nth = 1)"""

    def moved(n: int) -> str:
        return f"""s{n} AS (SELECT c, d, sum(v[d])::BIGINT AS s, count(*) AS n FROM a{n - 1}, range(1, {size + 1}) AS r(d)
      GROUP BY c, d),
  m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY d) AS x FROM s{n} GROUP BY c),
  c{n} AS MATERIALIZED (SELECT c, coalesce(m{n}.x, c{n - 1}.x) AS x FROM c{n - 1} LEFT JOIN m{n} USING (c))"""

    steps = ",\n  ".join(part for n in range(1, rounds + 1) for part in (moved(n), assigned(n)))
    return f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding,
      lambda x: floor({lookup_kmeans.SCALE}::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {size} AND NOT list_contains(list_transform(embedding,
      lambda x: coalesce(isfinite(x), false)), false)),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS x FROM (
      SELECT v, sha256('{lookup_kmeans.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM vectors
      ORDER BY h, v LIMIT {k})),
  {assigned(0)},
  {steps}
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


SQL["op11_lookup_kmeans"] = _lookup_kmeans_sql()


@query
def op11_lookup_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    found = lookup_kmeans.clusters(_table(spark, folder, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def _fill_middle_sql() -> str:
    p, s, m = fill_middle.MARKS
    draw = "('0x' || substr(h, {0}, 8))::BIGINT"
    return rf"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
  chosen AS (SELECT doc_id, text, units, len(units) AS n, {draw.format(1)} % (len(units) + 1) AS a,
    {draw.format(9)} % (len(units) + 1) AS b, CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}')
      OR contains(text, '{m}') OR {draw.format(17)} % 100 >= {fill_middle.RATE} THEN 'plain'
      WHEN {draw.format(25)} % 100 < {fill_middle.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
  parts AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS pre,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(units[greatest(a, b) + 1:], '') AS suf FROM chosen)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid
    ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


SQL["op12_fill_middle"] = _fill_middle_sql()


@query
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, folder, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


@query
def op13_online_packing(spark: SparkSession, folder: str) -> DataFrame:
    return online_packing.pack(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
