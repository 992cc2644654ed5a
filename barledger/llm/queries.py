"""Queries of this folder: thin digests over the operators, by name, with their SQL where there is one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barledger.llm import filter_audit, html_diff, langid, media, mixing, packing, periodic, rpforest, secrets, sharding, simhash, toxicity, urlglob
from barledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_diff.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_url_filter", sql=r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN (host LIKE 'www.%.edu' OR host LIKE '%.gov') AND starts_with(path, '/') THEN 'allow'
    WHEN contains(host, 'spam-farm.') OR contains(host, 'cheap-pills.') OR contains(path, '/cgi-bin/') OR path LIKE '%/wp-login.php'
      OR host || path LIKE '%.exe' OR host || path LIKE '%.zip' OR ((starts_with(host, 'ads.') OR contains(host, '.ads.')) AND starts_with(path, '/')) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlglob.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op7_embedding_near_dedup", sql="""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = e.vec_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_source_mixing", sql=r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    0.1::DOUBLE + 0.9::DOUBLE * length(regexp_replace(text, '\P{L}+', '', 'g')) / greatest(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 1) AS weight,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':0'), 1, 13)) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / coalesce(weight, 0.1::DOUBLE) AS sample_key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM k GROUP BY source
), l AS (
  SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS nth,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, nth) FROM l WHERE cap > level * w) * w, CAST(cap AS DOUBLE))) AS target FROM l
), p AS (
  SELECT k.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY sample_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM p
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_media_columns")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return media.features(media.media_column(docs).drop("text"))


def planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by the checksum of its id, with a periodic tail; other documents as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


# CRC-32 of the UTF-8 bytes of {0}: the table of all bytes by eight steps each, then one look a byte
CRC_TABLE = """t AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n)
)"""
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1])))"""


@query("op11_periodic_runs", sql=r"""
WITH """ + CRC_TABLE + r""", h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + CRC.format("CAST(doc_id AS VARCHAR)") + r""" AS h FROM documents, t
), g AS (
  SELECT doc_id, w, len(w) AS n, h // 10 AS g, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted FROM h
), a AS (
  SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g
), u AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END) AS word FROM a
), e AS (
  SELECT x.doc_id, y.i - x.i AS period, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), s AS (
  SELECT doc_id, period, min(i) AS start, count(*) + period AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS k FROM e)
  GROUP BY doc_id, period, k HAVING count(*) + period >= greatest(24, 3 * period)
), r AS (
  SELECT doc_id, start, length, min(period) AS period FROM s GROUP BY doc_id, start, length
), o AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
    first({'start': start, 'length': length, 'period': period} ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best
  FROM r GROUP BY doc_id
), c AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), planted_run)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    order = lambda x, y: F.coalesce(*[F.nullif(F.signum(d), F.lit(0.0)) for d in (-ahead(x, y), x["start"] - y["start"], x["period"] - y["period"])], F.lit(0.0)).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return top.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op12_sharding", sql=r"""
WITH """ + CRC_TABLE + r""", k AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size, """ + CRC.format("coalesce(text, '')") + r""" AS text_crc32,
    substr(md5(coalesce(text, '')), 1, 16) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
  FROM documents, t
), total AS (
  SELECT CAST(sum(size) AS HUGEINT) AS total FROM k
), p AS (
  SELECT depth, substr(key, 1, depth) AS prefix, CAST(sum(size) AS HUGEINT) AS size FROM k, (SELECT unnest(list_append(range(3, 32, 2), 32)) AS depth) GROUP BY ALL
), b AS (
  SELECT depth, sum(size) OVER (PARTITION BY depth ORDER BY prefix) AS upper, sum(size) OVER (PARTITION BY depth ORDER BY prefix) - size AS lower FROM p
), near AS (
  SELECT i, depth, CASE WHEN i * total - 24 * lower <= 24 * upper - i * total THEN lower ELSE upper END AS below,
    least(i * total - 24 * lower, 24 * upper - i * total) * 200 <= total AS fits
  FROM b, total, range(1, 24) r(i) WHERE 24 * lower < i * total AND i * total <= 24 * upper
), marks AS (
  SELECT i, first(below ORDER BY CASE WHEN fits THEN depth ELSE 99 END, -depth) AS below FROM near GROUP BY i
), places AS (
  SELECT *, sum(size) OVER (ORDER BY key) - size AS start FROM k
), shards AS (
  SELECT *, CAST((SELECT count(*) FROM marks WHERE below <= start) AS INTEGER) AS shard FROM places
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM shards
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_filter_audit", sql=r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
      regexp_matches(t, '[#$%&*|]'), copy][i]) AS fails
  FROM (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy FROM d) LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), hits AS (
  SELECT part, o, step, o[step] AS letter, n, good, toxic, list_contains(fails, o[step]) AS hit, len(list_intersect(fails, o[1:step - 1])) > 0 AS gone, len(fails) = 1 AS single
  FROM n, orders, range(1, 6) s(step)
), sums AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND single THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
