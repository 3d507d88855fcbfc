"""The queries of the text operators over the given tables, and their SQL.

Each maps a given table to the records that its operator takes (``doc_id`` → ``platform_id``,
``text`` → ``note``, ``source`` → ``provenance``; ``labels`` and ``benchmark`` → reviews), and
the operator's columns back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwake.llm import histories, infill, language, mixing, near, nearest, patterns, privacy, quality, repeats, sharding, shared, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def deployments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("platform_id"), F.col("text").alias("note"), F.col("source").alias("provenance")
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("event_id"), F.col("text").alias("note"))


def joined_sha256(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


@query(
    "op4_pareto_mix",
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0 * source_size AS room FROM s0),
s2 AS (
  SELECT *, room / w AS full_at, ROW_NUMBER() OVER f AS place,
    (SUM(source_size) OVER () - (SUM(room) OVER f - room)) / (SUM(w) OVER () - (SUM(w) OVER f - w)) AS level
  FROM s1 WINDOW f AS (ORDER BY room / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT source, source_size, least(CAST(room AS DOUBLE), w * (SELECT arg_min(level, place) FROM s2 WHERE full_at >= level)) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM s3),
s5 AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - whole * source_size) AS missing FROM s4),
z AS (
  SELECT d.source, size, COUNT(*) AS n, any_value(missing) AS missing FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
  WHERE missing > 0 AND size > 0 GROUP BY d.source, size),
c0 AS (
  SELECT source, size,
    (missing - coalesce(SUM(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(SUM(CAST(size AS DOUBLE) * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c
  FROM z),
c1 AS (SELECT source, arg_max(c, size) AS c, MAX(size) AS top FROM c0 WHERE c * size <= 1 GROUP BY source),
r0 AS (
  SELECT d.doc_id, d.source, d.size, s5.source_size, s5.target, s5.whole, s5.missing,
    (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || coalesce(d.source, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN d.size > coalesce(c1.top, 0) THEN 1.0::DOUBLE ELSE c1.c * d.size END AS p
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN c1 ON d.source IS NOT DISTINCT FROM c1.source),
r1 AS (SELECT *, CASE WHEN missing > 0 AND size > 0 THEN CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END END AS rank FROM r0),
r2 AS (SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS upto FROM r1 WHERE rank IS NOT NULL),
g AS (SELECT source, any_value(missing) - coalesce(MAX(upto) FILTER (upto <= missing), 0) AS remains FROM r2 GROUP BY source),
f0 AS (
  SELECT r2.source, rank, doc_id, size, any_value(remains) AS remains, COUNT(*) AS n FROM r2 JOIN g ON r2.source IS NOT DISTINCT FROM g.source
  WHERE upto > missing GROUP BY r2.source, rank, doc_id, size),
f AS (
  SELECT * FROM f0 WHERE size * n < 2 * remains
  QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY abs(remains - size * n), rank, doc_id, size) = 1)
SELECT r1.doc_id, r1.size, r1.source_size, r1.target,
  CAST(r1.size * (r1.whole + CASE WHEN r1.rank IS NULL THEN 0
    WHEN (SELECT MAX(upto) FROM r2 WHERE r2.doc_id IS NOT DISTINCT FROM r1.doc_id AND r2.source IS NOT DISTINCT FROM r1.source) <= r1.missing THEN 1
    WHEN f.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r1 LEFT JOIN f ON r1.source IS NOT DISTINCT FROM f.source AND r1.doc_id IS NOT DISTINCT FROM f.doc_id AND r1.rank = f.rank
""",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    d = mixing.mix(deployments(spark, sf))
    return d.select(F.col("platform_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query(
    "op7_wu_manber_decontamination",
    r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(10, len(w)) AS m FROM items WHERE len(w) > 0))),
wins AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM pats) WHERE len(w) >= m)),
hits AS (SELECT doc_id, m, i, item_id FROM wins JOIN pats USING (m, p)),
covered AS (SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    d = patterns.search(deployments(spark, sf), passages(spark, sf))
    return d.select(
        F.col("platform_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        joined_sha256("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_min_cost_resharding")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    # The old layout keeps each provenance in one shard, so its sizes are far from even.
    old = F.pmod(F.crc32(F.coalesce(F.col("provenance"), F.lit("")).cast("binary")), F.lit(16)).cast("int")
    d = sharding.plan(deployments(spark, sf), old=old, n_old=16, n_new=16)
    return d.select(
        F.col("platform_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def reviews(spark: SparkSession, sf: str, label: str, good: int) -> DataFrame:
    """A label as a review decision: ``good`` keeps the record, the other value rejects it."""
    return spark.read.parquet(f"{sf}/labels.parquet").where(F.col(label).isNotNull()).select(
        F.col("doc_id").alias("platform_id"), F.when(F.col(label) == good, "keep").otherwise("reject").alias("decision")
    )


def remainder(modulus: int) -> F.Column:
    return F.crc32(F.col("platform_id").cast("string").cast("binary")) % modulus


@query("op6_hashed_ngram_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    records = deployments(spark, sf)
    model = quality.fit(records, reviews(spark, sf, "quality", 1))
    return quality.score(records, model).withColumnRenamed("platform_id", "doc_id")


VOCABULARY = "byte_bpe_50k.json"


@query("op8_whole_token_counts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        definition = f.read()
    return tokens.count_tokens(deployments(spark, sf), definition).withColumnRenamed("platform_id", "doc_id")


@query("op10_compression_language")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    records = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("platform_id"), F.col("text").alias("note"), "lang")
    known = language.fit(records.where(remainder(4) != 2))
    d = language.classify(records.withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False))), known, keep=("held_out",))
    return d.select(F.col("platform_id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


@query(
    "op9_minhash_near_duplicates",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, MIN(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
""",
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(deployments(spark, sf), shingle=4).withColumnRenamed("platform_id", "doc_id")


@query(
    "op5_doubling_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, MIN(doc_id) AS first FROM v GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM v JOIN f USING (k) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM t ANTI JOIN c USING (doc_id, j) GROUP BY doc_id),
m AS (SELECT doc_id, COUNT(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
""",
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(deployments(spark, sf)).withColumnRenamed("platform_id", "doc_id")


def spelled(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in privacy.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(number: int):
    return lambda s: s["kind"] == number


@query("op1_weak_supervision_pii")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    d = privacy.private_spans(deployments(spark, sf))
    base = F.filter("spans", lambda s: s["strict"])
    return d.select(
        F.col("platform_id").alias("doc_id"),
        *[F.size(F.filter(base, of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(privacy.KINDS)],
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )


@query("op2_lexicon_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    records = deployments(spark, sf)
    lexicon = toxicity.fit(records, reviews(spark, sf, "toxic", 0).where(~held_out))
    d = toxicity.score(records.withColumn("held_out", held_out), lexicon, keep=("held_out",))
    return d.select(F.col("platform_id").alias("doc_id"), "held_out", "score", "predicted")


@query(
    "op12_fenwick_fill_in_middle",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    d = infill.fill_in_middle(deployments(spark, sf), seed=1)
    return d.select(
        F.col("platform_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(), 256).alias("restored_sha256"),
    )


@query(
    "op13_nra_exact_top_k",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    profiles = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("platform_id"), F.col("embedding").alias("profile"))
    d = nearest.most_similar(profiles, F.col("platform_id") % 50 == 0)
    return d.select("query_id", "rank", F.col("platform_id").alias("vec_id"), "score")


@query(
    "op11_depth_band_prefix_trie",
    """
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
      lambda r, x: list_reduce(list_prepend(xor(r, x), list_transform(range(8), lambda i: i)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM c)),
t AS (
  SELECT i.conv_id, pos, role, text FROM ids i JOIN c ON c.conv_id = i.conv_id - i.conv_id % 100 AND pos < h
  UNION ALL SELECT conv_id, pos, role, text FROM c JOIN ids USING (conv_id) WHERE pos >= h),
s AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS m, list(length(text) ORDER BY pos) AS u FROM t GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(m, []) AS m, coalesce(u, []) AS u FROM ids LEFT JOIN s USING (conv_id)),
path AS (
  SELECT conv_id, d, md5(array_to_string(m[1:d], '')) AS k, md5(array_to_string(m[1:d - 1], '')) AS pk, CASE WHEN d > 0 THEN u[d] ELSE 0 END AS units, d = len(m) AS ended
  FROM (SELECT *, unnest(range(len(m) + 1)) AS d FROM p)),
nodes AS (
  SELECT d, k, MIN(conv_id) AS conv_id, COUNT(*) AS n, MAX(units) AS units, MAX(pk) AS pk,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended) AS ends FROM path GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, COUNT(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, pk),
v AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
sub AS (
  SELECT path.d, path.k, SUM(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, SUM((v.n - 1) * v.units) AS saved
  FROM v JOIN path ON path.conv_id = v.conv_id AND path.d <= v.d GROUP BY path.d, path.k)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN sub USING (d, k) LEFT JOIN nodes up ON up.d = v.d - 1 AND up.k = v.pk
""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = shared.cut(histories.numbered(turns.withColumn("digest", F.md5(F.col("text").cast("binary"))), "conv_id", "turn", "role", "digest"))
    # A conversation begins with the first h turns of the first one of its hundred.
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h")
    ids = turns.select("conv_id").distinct().select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    opening = turns.where("conv_id % 100 = 0 AND pos < 5").select(F.col("conv_id").alias("base"), "pos", "role", "text")
    begun = ids.join(opening, "base").where("pos < h").select("conv_id", "pos", "role", "text")
    kept = turns.select("*", h).where("pos >= h").select("conv_id", "pos", "role", "text")
    names = ["platform_id", "reviewed_at", "decision", "note"]
    nodes, ends = histories.review_trie(begun.union(kept).toDF(*names), ids.select(F.col("conv_id").alias("platform_id")))
    ended = shared.listed_sha256(ends, histories.NODE, "platform_id", "ends_sha256")
    return nodes.join(ended, histories.NODE, "left").select(
        F.col("platform_id").alias("conv_id"), "depth", F.col("parent_platform_id").alias("parent_conv_id"), F.col("n_members").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
