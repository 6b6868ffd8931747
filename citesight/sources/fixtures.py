"""Derived test views over the driver tables (see FIXTURES.md).

Each view exists twice: as a DataFrame plan (used by the engine) and as a
DuckDB ``WITH`` clause (used by the SQL oracle). The two must agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from citesight.functions.columns import once, with_scalars

# Fixed values of the synthetic citation rule: order k cites order k - d for
# each d below when that order is strictly older. One key per offset: no pairs
# within a customer, no hot key.
CITATION_OFFSETS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
#: Keys of a block of works that is searched for citations at a time.
KEY_BLOCK = 2_048

#: Classes of the scored multi-class fixture.
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A driver table spread by its key before heavy per-row work.

    The test files hold one row group each, so a plain scan is one task;
    hash-partitioning by the key spreads the work and is the partitioning the
    later joins and groupings on that key want anyway.
    """
    from citesight.session import shuffle_partitions
    return table(spark, sf_dir, name).repartition(shuffle_partitions(spark), key)


def citations_by_work(orders: DataFrame) -> DataFrame:
    """(id, referenced_works, counts_by_year_years, counts_by_year_counts, _cited) of the synthetic citation graph
    of the orders table; null lists and 0 where there is nothing.

    A work's references and citers lie within the largest offset of its key, so works are dealt by blocks of keys,
    those near a block's ends to the neighbouring block too, and each offset is a range frame of one key: the
    edges are never exchanged. Rows of one key are all met, as by a join.
    """
    o = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    # every third work also cites the oldest one: a hub that holds far more than a fair share of edges
    hub = o.agg(F.min(F.struct("d", "id"))["id"].alias("hub"))
    days = with_scalars(o, hub).where(F.col("id") == F.col("hub")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    days = days.agg(F.collect_list(F.struct("d", "n")).alias("hub_days"))  # no more than the calendar has
    known = with_scalars(with_scalars(o, hub), days)
    cites_hub = (F.col("id") % 3 == 0) & ~(F.col("id") - F.col("hub")).isin(*CITATION_OFFSETS)
    older = F.filter("hub_days", lambda x: x["d"] < F.col("d"))
    n_hub = F.aggregate(older, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    hub_years = known.where(cites_hub).groupBy(F.year("d").alias("y")).agg(F.sum(n_hub).alias("n")).where("n > 0")
    hub_years = hub_years.agg(F.collect_list(F.struct("y", "n")).alias("hub_years"))  # no more than the calendar has

    inside, reach = F.pmod(F.col("id"), F.lit(KEY_BLOCK)), max(CITATION_OFFSETS)
    block = F.col("id") - inside
    copies = F.filter(F.array(block, F.when(inside < reach, block - KEY_BLOCK),
                              F.when(inside >= KEY_BLOCK - reach, block + KEY_BLOCK)), lambda b: b.isNotNull())
    near = o.where("id IS NOT NULL").select("id", "d", F.posexplode(copies).alias("_copy", "_block"))
    by_key = Window.partitionBy("_block").orderBy("id")

    def at(k):
        return F.collect_list("d").over(by_key.rangeBetween(k, k))
    met = near.select("id", "d", "_copy", "_block", *[at(-k).alias(f"_r{k}") for k in CITATION_OFFSETS],
                      *[at(k).alias(f"_c{k}") for k in CITATION_OFFSETS]).where("_copy = 0")
    refs = [F.array_repeat(F.col("id") - k, F.size(F.filter(f"_r{k}", lambda r: r < F.col("d")))) for k in CITATION_OFFSETS]
    years = [F.transform(F.filter(f"_c{k}", lambda c: c > F.col("d")), lambda c: F.year(c)) for k in CITATION_OFFSETS]
    met = with_scalars(with_scalars(met, hub), days)
    refs.append(F.when(cites_hub, F.array_repeat("hub", n_hub.cast("int"))).otherwise(F.array().cast("array<long>")))
    # a key's rows share a block: no exchange
    per = met.select("id", "_block", F.concat(*refs).alias("r"), F.concat(*years).alias("y")).groupBy("_block", "id").agg(
        F.array_sort(F.flatten(F.collect_list("r"))).alias("r"), F.array_sort(F.flatten(F.collect_list("y"))).alias("y"))
    per = with_scalars(with_scalars(per, hub), hub_years)
    more = F.when(F.col("id") == F.col("hub"), F.col("hub_years")).otherwise(F.array().cast("array<struct<y:int,n:bigint>>"))
    per = per.select("id", "r", "y", more.alias("more"))
    all_years = F.array_sort(F.array_union("y", F.transform("more", lambda x: x["y"])))
    series = F.transform(all_years, lambda y: F.struct(y.alias("y"), F.aggregate(
        F.filter("more", lambda x: x["y"] == y), F.size(F.filter("y", lambda v: v == y)).cast("long"),
        lambda a, x: a + x["n"]).alias("n")))
    per = per.select("id", "r", series.alias("s"))
    cited, cites = F.size("s") > 0, F.size("r") > 0
    return per.select("id", F.when(cites, F.col("r")).alias("referenced_works"),
                      F.when(cited, F.transform("s", lambda x: x["y"])).alias("counts_by_year_years"),
                      F.when(cited, F.transform("s", lambda x: x["n"])).alias("counts_by_year_counts"),
                      F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("_cited"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus table: one row per work (an order), see FIXTURES.md §3."""
    w = works_alone(spark, sf_dir).join(citations_by_work(table(spark, sf_dir, "orders")), "id", "left")
    return w.select("id", "publication_date", F.coalesce("_cited", F.lit(0)).cast("bigint").alias("cited_by_count"),
                    "referenced_works", "counts_by_year_years", "counts_by_year_counts", *WORK_COLS)


#: Columns of a work that do not come from citations.
WORK_COLS = ("topic_name", "subfield_name", "field_name", "type", "field_id", "is_license_safe", "vec_id", "doc_id", "score")


def works_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works without what citations tell: id, date and ``WORK_COLS``."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n_vec = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("_n_vec"))
    n_doc = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("_n_doc"))
    o = with_scalars(with_scalars(orders.join(customer, orders.o_custkey == customer.c_custkey), n_vec), n_doc)
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("publication_date"),
        F.col("o_orderpriority").alias("topic_name"),
        F.col("o_orderstatus").alias("subfield_name"),
        F.col("c_mktsegment").alias("field_name"),
        F.when(F.col("o_totalprice") > 250000, "article").otherwise("chapter").alias("type"),
        F.col("c_nationkey").alias("field_id"),
        (F.col("o_orderkey") % 4 != 0).alias("is_license_safe"),
        (F.col("o_orderkey") % F.col("_n_vec")).alias("vec_id"),
        (F.col("o_orderkey") % F.col("_n_doc")).alias("doc_id"),
        F.col("o_totalprice").alias("score"),
    )


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``keyed`` where the table has too few files for a task per core; else as it is read, not exchanged."""
    t = table(spark, sf_dir, name)
    return t if len(t.inputFiles()) >= spark.sparkContext.defaultParallelism else keyed(spark, sf_dir, name, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``lang`` exposed as ``language``."""
    return keyed(spark, sf_dir, "documents", "doc_id").withColumnRenamed("lang", "language")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    n = F.col("n_chars").cast("double")
    return j.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"),
                    (n / (n + F.lit(1000.0))).alias("prob"))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.year("o_orderdate").alias("w"),
                    F.col("o_orderdate").cast("date").alias("d"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
                    (p / (p + F.lit(200000.0))).alias("prob"))


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    # class c gathers the magnitudes of all entries whose index ends in c
    size = F.transform("embedding", lambda v: F.abs(v).cast("double"))

    def folded(m):
        return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.aggregate(
            F.filter(m, lambda v, i: i % CLASSES == c), F.lit(0.0), lambda a, v: a + v))

    def shares(s):
        return once(F.aggregate(s, F.lit(0.0), lambda a, v: a + v), lambda t: F.transform(s, lambda v: v / t))
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("y"),
                    once(once(size, folded), shares).alias("probs"))


def regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return j.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                    F.col("l_extendedprice").alias("y"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"),
                    # the seventh line of an order has no spread
                    F.when(F.col("l_linenumber") == 7, F.lit(0.0))
                    .otherwise(F.lit(100.0) + F.col("l_quantity") * 5).alias("sigma"))


# ---------------------------------------------------------------- SQL twins
_OFFSETS_SQL = ", ".join(str(x) for x in CITATION_OFFSETS)

VIEW_SQL = {
    "citations": f"""citations AS (
  SELECT a.id AS id, b.id AS ref, a.d AS citing_date
  FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders) a
  CROSS JOIN (SELECT unnest([{_OFFSETS_SQL}]) AS off) v
  JOIN (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders) b
    ON b.id = a.id - v.off
  WHERE b.d < a.d
  UNION ALL
  SELECT a.o_orderkey, h.id, CAST(a.o_orderdate AS DATE)
  FROM orders a, (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY 2, 1 LIMIT 1) h
  WHERE a.o_orderkey % 3 = 0 AND a.o_orderkey - h.id NOT IN ({_OFFSETS_SQL}) AND h.d < CAST(a.o_orderdate AS DATE))""",
    "works": """refs AS (SELECT id, list(ref ORDER BY ref) AS referenced_works FROM citations GROUP BY id),
cites AS (SELECT ref AS id, CAST(year(citing_date) AS INTEGER) AS y, count(*) AS n FROM citations GROUP BY 1, 2),
series AS (
  SELECT id, list(y ORDER BY y) AS counts_by_year_years, list(n ORDER BY y) AS counts_by_year_counts,
         sum(n) AS cited_by_count FROM cites GROUP BY id),
works AS (
  SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS publication_date,
         CAST(coalesce(s.cited_by_count, 0) AS BIGINT) AS cited_by_count,
         r.referenced_works, s.counts_by_year_years, s.counts_by_year_counts,
         o.o_orderpriority AS topic_name, o.o_orderstatus AS subfield_name,
         c.c_mktsegment AS field_name,
         CASE WHEN o.o_totalprice > 250000 THEN 'article' ELSE 'chapter' END AS type,
         c.c_nationkey AS field_id, (o.o_orderkey % 4 <> 0) AS is_license_safe,
         o.o_orderkey % (SELECT count(*) FROM embeddings) AS vec_id,
         o.o_orderkey % (SELECT count(*) FROM documents) AS doc_id,
         o.o_totalprice AS score
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN refs r ON r.id = o.o_orderkey
  LEFT JOIN series s ON s.id = o.o_orderkey)""",
    "docs": """docs AS (SELECT doc_id, text, lang AS language, source, n_chars FROM documents)""",
    "scored": """scored AS (
  SELECT l.doc_id AS id, l.quality AS y,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 1000.0) AS prob
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""",
    "scored_windows": """scored_windows AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS w, CAST(o_orderdate AS DATE) AS d,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         o_totalprice / (o_totalprice + 200000.0) AS prob FROM orders)""",
    "scored_multi": """scored_multi AS (
  SELECT id, y, list_transform(e, lambda v: v / t) AS probs FROM (SELECT id, y, e, list_sum(e) AS t FROM (
    SELECT id, y, list_transform(range(0, 10), lambda c: list_sum(list_filter(m, lambda v, i: (i - 1) % 10 = c))) AS e
    FROM (SELECT vec_id AS id, label AS y, list_transform(embedding, lambda v: CAST(abs(v) AS DOUBLE)) AS m
          FROM embeddings))))""",
    "regressed": """regressed AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS y,
         l_quantity * p_retailprice AS pred,
         CASE WHEN l_linenumber = 7 THEN 0.0 ELSE 100.0 + l_quantity * 5 END AS sigma
  FROM lineitem JOIN part ON p_partkey = l_partkey)""",
}

_DEPS = {"works": ["citations"]}


def with_views(*names: str) -> str:
    """``WITH`` prefix holding the named views (and what they need)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in order) + "\n"
