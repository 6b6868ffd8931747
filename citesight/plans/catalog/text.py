"""Queries over documents: cleaning (C) and tokens (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesight.operators import clean as C
from citesight.plans.registry import register
from citesight.functions.columns import r6
from citesight.sources import fixtures as fx

D = fx.with_views("docs")


def _contains_sql(col: str, needles) -> str:
    uniq = list(dict.fromkeys(needles))
    return "(" + " OR ".join("contains({}, '{}')".format(col, n.replace("'", "''")) for n in uniq) + ")"


EXTRA_PHRASES = ["licen"]
PHRASES = C.BOILERPLATE_PHRASES + EXTRA_PHRASES

# cleaned text per level in SQL (lower -> boilerplate -> markers -> length bounds -> full stop)
_L1 = f"CASE WHEN {_contains_sql('lower(text)', PHRASES)} THEN NULL ELSE lower(text) END"


@register("c1_lowercase", "SELECT doc_id, md5(lower(text)) AS text_md5 FROM documents")
def c1(spark, sf):
    d = C.lowercase(fx.documents(spark, sf), "text")
    return d.select("doc_id", F.md5("text").alias("text_md5"))


@register("c2_null_boilerplate", f"""SELECT doc_id,
  {_contains_sql('text', C.BOILERPLATE_PHRASES)} AS default_hit,
  ({_L1}) IS NULL AS text_is_null FROM documents""")
def c2(spark, sf):
    d = fx.documents(spark, sf)
    d = d.withColumn("default_hit", C.contains_any("text", C.BOILERPLATE_PHRASES))
    d = C.null_boilerplate(C.lowercase(d, "text"), "text", PHRASES)
    return d.select("doc_id", "default_hit", F.col("text").isNull().alias("text_is_null"))


@register("c3_mark_foreign", D + f"""SELECT doc_id,
  CASE WHEN {_contains_sql('text', C.FOREIGN_MARKERS)} THEN 'unknown' ELSE language END AS language FROM docs""")
def c3(spark, sf):
    return C.mark_foreign(fx.documents(spark, sf), "text").select("doc_id", "language")


_C4 = D + """, t AS (SELECT doc_id, text FROM docs),
st AS (SELECT greatest(avg(length(text)) - 3 * stddev_samp(length(text)), 50.0) AS lo,
              avg(length(text)) + 3 * stddev_samp(length(text)) AS hi FROM t)
SELECT doc_id, NOT (length(text) < lo OR length(text) > hi) AS kept FROM t, st"""


@register("c4_length_outliers", _C4)
def c4(spark, sf):
    d = C.length_outliers(fx.documents(spark, sf), "text", min_len=50, upper=True)
    return d.select("doc_id", F.col("text").isNotNull().alias("kept"))


@register("c5_require_full_stop", "SELECT doc_id FROM documents WHERE ends_with(text, '.')")
def c5(spark, sf):
    return C.require_full_stop(fx.documents(spark, sf), "text").select("doc_id")


_C6 = D + f""", l1 AS (
  SELECT doc_id, {_L1} AS text,
         CASE WHEN {_contains_sql(_L1, C.FOREIGN_MARKERS)} THEN 'unknown' ELSE language END AS language
  FROM docs),
st AS (SELECT greatest(avg(length(text)) - 3 * stddev_samp(length(text)), 100.0) AS lo,
              avg(length(text)) + 3 * stddev_samp(length(text)) AS hi FROM l1),
l4 AS (SELECT doc_id, language,
              CASE WHEN length(text) < lo OR length(text) > hi THEN NULL ELSE text END AS text FROM l1, st)
"""


@register("c6_clean_text", _C6 + "SELECT doc_id, language, md5(text) AS text_md5 FROM l4 WHERE ends_with(text, '.')")
def c6(spark, sf):
    d = C.clean_text(fx.documents(spark, sf), [C.CleanSpec("text", level=5, min_len=100)], phrases=PHRASES)
    return d.select("doc_id", "language", F.md5("text").alias("text_md5"))


@register("c7_drop_report", _C6 + """, after AS (SELECT * FROM l4 WHERE ends_with(text, '.'))
SELECT c.column, b.rows_before, a.rows_after, b.rows_before - a.rows_after AS rows_removed,
       CASE c.column WHEN 'text' THEN b.text_before ELSE b.lang_before END AS values_before,
       CASE c.column WHEN 'text' THEN a.text_after ELSE a.lang_after END AS values_after,
       (CASE c.column WHEN 'text' THEN b.text_before ELSE b.lang_before END)
     - (CASE c.column WHEN 'text' THEN a.text_after ELSE a.lang_after END) AS values_removed
FROM (SELECT unnest(['text', 'language']) AS column) c,
     (SELECT count(*) AS rows_before, count(text) AS text_before, count(language) AS lang_before FROM docs) b,
     (SELECT count(*) AS rows_after, count(text) AS text_after, count(language) AS lang_after FROM after) a""")
def c7(spark, sf):
    before = fx.documents(spark, sf)
    after = C.clean_text(before, [C.CleanSpec("text", level=5, min_len=100)], phrases=PHRASES)
    return C.drop_report(before, after, ["text", "language"])


# ---------------------------------------------------------------- tokens (K)
from citesight.operators import tokens as K  # noqa: E402

_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_VOCAB = f"""WITH toks AS (SELECT doc_id, unnest({_SPLIT}) AS token, unnest(range(1, len({_SPLIT}) + 1)) AS pos FROM documents),
vc AS (SELECT token, count(*) AS count FROM toks GROUP BY token),
vocab AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) - 1 + 4 AS token_id FROM vc),
tid AS (SELECT t.doc_id, t.pos, coalesce(v.token_id, 3) AS token_id FROM toks t LEFT JOIN vocab v USING (token)),
dtok AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN [] ELSE
           list_concat([1], coalesce((SELECT list(token_id ORDER BY pos) FROM tid WHERE tid.doc_id = d.doc_id), []), [2]) END AS toks
         FROM documents d)
"""


def _vocab(spark, sf):
    # the whole vocabulary: no size cap, every word keeps its own id
    return K.build_vocab(fx.spread(spark, sf, "documents", "doc_id"), "text")


def _tokens(spark, sf, vocab):
    return K.tokenise(fx.table(spark, sf, "documents"), "doc_id", "text", vocab)  # it spreads the rows itself


@register("k1_build_vocab", _VOCAB + "SELECT token, count, token_id FROM vocab")
def k1(spark, sf):
    return _vocab(spark, sf)


@register("k2_tokenise", _VOCAB + """SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens,
  md5(array_to_string(toks, ',')) AS tokens_md5 FROM dtok""")
def k2(spark, sf):
    t = _tokens(spark, sf, _vocab(spark, sf))
    return t.select("doc_id", F.size("text_tokens").alias("n_tokens"),
                    F.md5(F.array_join(F.col("text_tokens").cast("array<string>"), ",")).alias("tokens_md5"))


@register("k3_assemble_text", """SELECT doc_id, md5('<s>' || text || '</s><s>' || source || '</s>') AS to_embed_md5
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def k3(spark, sf):
    d = K.assemble_text(fx.documents(spark, sf), ["text", "source"])
    return d.select("doc_id", F.md5("to_embed").alias("to_embed_md5"))


def _k4_sql(dim: int = 64, steps: int = K.POWER_STEPS, a: float = K.WORD_SMOOTHING) -> str:
    """Weighted hashed words per document, ``steps`` rounds of power iteration written out, the component taken out."""
    rounds = ""
    for t in range(steps):
        rounds += f""",
d{t} AS (SELECT v.doc_id, sum(v.x * u.x) AS dot FROM v JOIN u{t} u USING (dim) GROUP BY v.doc_id),
m{t} AS (SELECT v.dim, sum(v.x * d.dot) AS x FROM v JOIN d{t} d USING (doc_id) GROUP BY v.dim),
u{t + 1} AS MATERIALIZED (SELECT r.dim, coalesce(m.x, 0) / (SELECT sqrt(sum(x * x)) FROM m{t}) AS x
  FROM u{t} r LEFT JOIN m{t} m USING (dim))"""
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, unnest({_SPLIT.replace('text', "'<s>' || text || '</s>'")}) AS token
  FROM documents WHERE text IS NOT NULL),
vc AS (SELECT token, count(*) AS n FROM w GROUP BY token),
wt AS (SELECT token, {a} / ({a} + n / (SELECT sum(n) FROM vc)) AS weight,
  CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {dim} AS dim,
  CASE WHEN substr(md5(token), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM vc),
h AS (SELECT w.doc_id, wt.dim, sum(wt.sign * wt.weight) AS s FROM w JOIN wt USING (token) GROUP BY w.doc_id, wt.dim),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS norm FROM h GROUP BY doc_id),
v AS MATERIALIZED (SELECT h.doc_id, h.dim, h.s / n.norm AS x FROM h JOIN n USING (doc_id) WHERE n.norm > 1e-9),
u0 AS (SELECT range AS dim, 1 / sqrt({dim}) AS x FROM range(0, {dim})){rounds},
c AS (SELECT v.doc_id, sum(v.x * u.x) AS c FROM v JOIN u{steps} u USING (dim) GROUP BY v.doc_id)
SELECT d.doc_id, CAST(u.dim AS INTEGER) AS dim, round(CASE WHEN c.c IS NULL OR 1 - c.c * c.c <= 1e-9 THEN 0
  ELSE (coalesce(v.x, 0) - c.c * u.x) / sqrt(1 - c.c * c.c) END, 6) AS value
FROM documents d CROSS JOIN u{steps} u LEFT JOIN v ON v.doc_id = d.doc_id AND v.dim = u.dim
LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.text IS NOT NULL"""


def _embedding_rows(e):
    return e.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", "dim", r6("value").alias("value"))


@register("k4_embed_batch", _k4_sql())
def k4(spark, sf):
    # the encoder reads its input three times
    d = S.stage_table(K.assemble_text(fx.documents(spark, sf), ["text"]).select("doc_id", "to_embed"))
    return _embedding_rows(K.embed_batch(d, "to_embed", "embedding", dim=64))


@register("k4_embed_hashed", f"""WITH w AS (SELECT doc_id, unnest({_SPLIT.replace('text', "'<s>' || text || '</s>'")}) AS token
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS dim,
             CASE WHEN substr(md5(token), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM w),
v AS (SELECT doc_id, dim, sum(s) AS s FROM h GROUP BY doc_id, dim),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS nrm FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(r.dim AS INTEGER) AS dim, round(coalesce(v.s, 0) / greatest(coalesce(n.nrm, 0), 1e-9), 6) AS value
FROM documents d CROSS JOIN range(0, 64) r(dim) LEFT JOIN v ON v.doc_id = d.doc_id AND v.dim = r.dim
LEFT JOIN n ON n.doc_id = d.doc_id WHERE d.text IS NOT NULL""")
def k4_hashed(spark, sf):
    d = K.assemble_text(fx.documents(spark, sf), ["text"])
    return _embedding_rows(K.embed_hashed(d, "to_embed", "embedding", dim=64))


def token_vectors(spark, sf):
    """The token vector table of K5 and a token's row in it: ``embeddings`` row ``token_id % rows``."""
    e = fx.table(spark, sf, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    return (e.select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec")),
            lambda token: token % n.scalar())


@register("k5_mean_pool", _VOCAB + """, n AS (SELECT count(*) AS n FROM embeddings),
tk AS (SELECT doc_id, unnest(toks) AS token_id FROM dtok),
tv AS (SELECT tk.doc_id, e.embedding FROM tk, n JOIN embeddings e ON e.vec_id = tk.token_id % n.n WHERE tk.token_id <> 0),
dims AS (SELECT doc_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS dim FROM tv)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS value FROM dims GROUP BY doc_id, dim""")
def k5(spark, sf):
    v = _vocab(spark, sf)
    t = _tokens(spark, sf, v)
    vectors, slot = token_vectors(spark, sf)
    m = K.mean_pool(t, "doc_id", "text_tokens", vectors, dim=64, vocab=v, slot=slot)
    return m.select("doc_id", F.posexplode("mean_vec").alias("dim", "value")).select(
        "doc_id", "dim", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- streaming
from citesight.sources import io as S  # noqa: E402
from citesight.streaming import stream as ST  # noqa: E402


def stream_transform(d):
    d = d.withColumnRenamed("lang", "language")
    d = C.null_boilerplate(C.lowercase(d, "text"), "text", PHRASES)
    d = C.mark_foreign(d, "text")
    return d.select("doc_id", "language", F.col("text").isNull().alias("text_is_null"))


@register("stream_clean_documents", f"""SELECT doc_id,
  CASE WHEN {_contains_sql(_L1, C.FOREIGN_MARKERS)} THEN 'unknown' ELSE lang END AS language,
  ({_L1}) IS NULL AS text_is_null FROM documents""")
def stream_clean(spark, sf):
    schema = fx.table(spark, sf, "documents").schema
    src = ST.parquet_stream(spark, f"{sf}/documents.parquet", schema)  # a file, or a folder of files
    sink, ck = S.scratch_path(spark, "stream-sink"), S.scratch_path(spark, "stream-ckpt")
    ST.run_to_parquet(src, stream_transform, sink, ck)
    return spark.read.schema(stream_transform(src).schema).parquet(sink)
