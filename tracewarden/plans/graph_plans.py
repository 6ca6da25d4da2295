"""Graphs, neighbourhoods, embeddings and sequences."""

from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.operators import graph
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY
from tracewarden.session import cut_lineage

CONTACTS = """contacts AS (SELECT event_id, us, bytes_in, src_ip AS src, CASE WHEN bytes_in % 3 = 0 THEN domain WHEN bytes_in % 7 = 0 THEN '10.0.0.' || (bytes_in % 90) ELSE dst_ip END AS dst FROM flows),
  ends AS (SELECT src AS id, 'host' AS type, us, 0 AS side FROM contacts UNION ALL SELECT dst, CASE WHEN regexp_matches(replace(dst, '.', ''), '^[0-9]+$') THEN 'host' ELSE 'domain' END, us, 1 FROM contacts),
  vertices AS (SELECT id, arg_min(type, (us, side)) AS type FROM ends GROUP BY 1)"""


def contacts(t):
    b = F.col("bytes_in")
    other = F.concat(F.lit("10.0.0."), (b % 90).cast("string"))
    return t.flows.select("event_id", "us", "bytes_in", "src_ip", F.when(b % 3 == 0, F.col("domain")).when(b % 7 == 0, other).otherwise(F.col("dst_ip")).alias("dst_ip"))


def ingested(t, df):
    return graph.ingest_edges(df, "src_ip", graph.destination_column(df), order="us", attributes=["event_id", "bytes_in"])


@query(
    "gr01_edge_ingest",
    f"""WITH {CONTACTS} SELECT v.id, type, coalesce(o, 0) AS out_edges, coalesce(i, 0) AS in_edges FROM vertices v LEFT JOIN (SELECT src AS id, count(*) AS o FROM contacts GROUP BY 1) a USING (id)
        LEFT JOIN (SELECT dst AS id, count(*) AS i FROM contacts GROUP BY 1) b USING (id)""",
    ("flows",),
)
def _(t):
    v, e = ingested(t, contacts(t))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return v.join(out, "id", "left").join(into, "id", "left").select("id", "type", zero("o").alias("out_edges"), zero("i").alias("in_edges"))


@query(
    "gr02_snapshot_update",
    f"""WITH {CONTACTS} SELECT type, count(*) AS vertices, (SELECT count(*) FROM contacts) AS edges FROM vertices GROUP BY 1""",
    ("flows",),
)
def _(t):
    df = contacts(t)
    half = F.col("us") < t.log.agg(F.min("us") + F.lit(15 * DAY)).scalar()
    v, e = graph.merge_snapshot(ingested(t, df.filter(half)), ingested(t, df.filter(~half)))
    return v.groupBy("type").agg(F.count(F.lit(1)).alias("vertices")).withColumn("edges", e.agg(F.count(F.lit(1))).scalar())


@query(
    "gr03_simple_undirected",
    "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, arg_max(w, (o, w)) AS weight FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity AS w, epoch_us(l_shipdate) AS o FROM lineitem) GROUP BY 1, 2",
)
def _(t):
    return graph.simple_undirected(supply(t), ["o", "weight"])


def supply(t):
    return t.read("lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_quantity").cast("double").alias("weight"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("o"),
    )


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', {}, '7')), 1, 7) AS BIGINT)"


_WALKS = f"""WITH RECURSIVE e AS (SELECT DISTINCT remote_addr AS src, split_part(request_uri, '?', 1) AS dst FROM log),
       both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
       n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i, count(*) OVER (PARTITION BY src) AS degree FROM both_ways),
       w AS (SELECT src AS start, walk, 0 AS step, src AS node, src AS path FROM (SELECT DISTINCT src FROM n), range(1, 4) r(walk)
         UNION ALL SELECT w.start, w.walk, w.step + 1, n.dst, w.path || ' ' || n.dst FROM w JOIN n ON n.src = w.node AND n.i = {_DRAW.format('w.start, w.walk, w.step + 1')} % n.degree WHERE w.step < 9)"""


@query(
    "gr04_random_walks",
    _WALKS + " SELECT start, CAST(walk AS INTEGER) AS walk, path FROM w WHERE step = 9",
    ("log",),
)
def _(t):
    return _walks(t, 3, 10)


def _links(t):
    return t.log.select(F.col("remote_addr").alias("src"), S.uri_path(F.col("request_uri")).alias("dst"))


def _walks(t, walks, length):
    return graph.random_walks(_links(t), walks=walks, length=length).select("start", "walk", F.array_join("path", " ").alias("path"))


@query("gr04_random_walks_full")
def _(t):
    """The size of the original; its first walks and steps are those of the smaller query, which SQL repeats."""
    return _walks(t, 10, 40)


@query(
    "gr04_co_occurrences",
    _WALKS + """, s AS (SELECT start, walk, unnest(p) AS src, unnest(range(1, 11)) AS i, p FROM (SELECT start, walk, string_split(path, ' ') AS p FROM w WHERE step = 9)),
       c AS (SELECT src, dst, count(*) AS n FROM (SELECT src, i, unnest(p) AS dst, unnest(range(1, 11)) AS j FROM s) WHERE i <> j AND abs(i - j) <= 5 GROUP BY 1, 2),
       m AS (SELECT src AS id, sum(n) AS total FROM c GROUP BY 1)
       SELECT src, dst, n, round(greatest(ln(n * (SELECT sum(n) FROM c) / (CAST(a.total AS DOUBLE) * b.total)), 0), 6) AS weight FROM c JOIN m a ON a.id = src JOIN m b ON b.id = dst""",
    ("log",),
)
def _(t):
    pairs = cut_lineage(graph.co_occurrences(graph.random_walks(_links(t), walks=3, length=10)))
    weights = graph.positive_information(pairs)
    return pairs.join(weights, ["src", "dst"], "left").select("src", "dst", "n", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))


@query("gr04_walk_embeddings")
def _(t):
    """64 numbers a vertex from 10 walks of length 40; tests hold the factors to a dense decomposition."""
    return graph.walk_embeddings(_links(t))


@query(
    "gr05_neighbour_means",
    """WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS times FROM lineitem GROUP BY 1, 2),
       pairs AS (SELECT * FROM e UNION ALL SELECT dst, src, times FROM e),
       v AS (SELECT id, unnest(vec) AS value, unnest(range(64)) AS pos FROM (SELECT 'p' || p_partkey AS id, CAST(embedding AS DOUBLE[]) AS vec FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))),
       h1 AS (SELECT src AS id, pos, sum(value * times) / sum(times) AS value FROM pairs JOIN v ON dst = id GROUP BY 1, 2),
       h2 AS (SELECT src AS id, pos, sum(value * times) / sum(times) AS value FROM pairs JOIN h1 ON dst = id GROUP BY 1, 2)
       SELECT id, CAST(pos AS INTEGER) AS pos, round(value / sqrt(sum(value * value) OVER (PARTITION BY id)), 6) AS value FROM h2""",
)
def _(t):
    known = t.read("embeddings")
    parts = t.read("part").select("p_partkey", (F.col("p_partkey") % known.agg(F.count(F.lit(1))).scalar()).alias("vec_id")).join(known, "vec_id")
    vectors = parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("embedding").alias("vector"))
    return graph.neighbour_means(graph.both_directions(supply(t).select("src", "dst")), vectors, places=6)


_HASH = "CAST('0x' || substr(md5(concat_ws('|', {}, '0')), 1, 7) AS BIGINT)"


@query(
    "gr06_neighbour_sampling",
    f"""SELECT src, dst, rank FROM (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY {_HASH.format('src, dst')}, dst) AS INTEGER) AS rank
          FROM (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)) WHERE rank <= 15""",
)
def _(t):
    return graph.sample_neighbours(supply(t), 15)


@query(
    "gr06_sample_tree",
    f"""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), both_ways AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e),
       one AS (SELECT src, dst FROM both_ways QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_HASH.format('src, dst')}, dst) <= 15),
       two AS (SELECT src, dst FROM both_ways QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_HASH.replace("'0'", "'1'").format('src, dst')}, dst) <= 10)
       SELECT src AS root, 1 AS hop, src || ' ' || dst AS path FROM one
       UNION ALL SELECT one.src, 2, one.src || ' ' || one.dst || ' ' || two.dst FROM one JOIN two ON two.src = one.dst""",
)
def _(t):
    found = graph.sample_tree(graph.both_directions(supply(t).select("src", "dst").distinct()))
    return found.select("root", "hop", F.array_join("path", " ").alias("path"))


@query(
    "gr07_edge_dropout",
    f"SELECT event_id, src_ip, dst_ip FROM flows WHERE {_HASH.format('event_id')} % 1000 >= 100",
    ("flows",),
)
def _(t):
    return graph.drop_edges(t.flows, 0.1, ["event_id"]).select("event_id", "src_ip", "dst_ip")


@query(
    "gr08_embedding_drift",
    """WITH c AS (SELECT vec_id % 2 AS side, unnest(CAST(embedding AS DOUBLE[])) AS value, unnest(range(64)) AS pos FROM embeddings),
       m AS (SELECT pos, avg(value) FILTER (WHERE side = 1) - avg(value) FILTER (WHERE side = 0) AS d FROM c GROUP BY 1)
       SELECT round(sqrt(sum(d * d)), 6) AS drift, sqrt(sum(d * d)) > 0.5 AS drifted FROM m""",
)
def _(t):
    e = t.read("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    out = graph.embedding_drift(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"))
    return out.select(F.round("drift", 6).alias("drift"), "drifted")


@query(
    "gr09_window_sequences",
    """SELECT ip, bucket, string_agg(n, ',' ORDER BY bucket) OVER (PARTITION BY ip ORDER BY bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS sequence FROM daily""",
    ("daily",),
)
def _(t):
    from tracewarden.operators import baseline

    seq = graph.sequences(baseline.requests_per_bucket(t.log, DAY), "ip", "bucket", "n", 24)
    return seq.select("ip", "bucket", F.array_join(F.col("sequence").cast("array<string>"), ",").alias("sequence"))
