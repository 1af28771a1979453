"""The operators of the library as queries over the driver's tables, with SQL for those that SQL can express.

The event graph stands in for dependence graphs: a graph a user, a node an event, an edge to the user's next event
within 12 hours (red between events of one type, else blue), blocks by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.scalars import abstract_label
from .operators import cluster, differences, features, graph, inconsistency, similarity, statistics, structure
from .plans.tables import materialise, table

FIRST, SECOND, GATE = 0.4, 0.45, 50


def _micros(c: str):
    """Microseconds of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), F.col("event_type").alias("label"), F.date_format("ts", "yyyy-MM-dd").alias("bb_id"), line.alias("line"), _micros("ts").alias("ord"))


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = e.withColumn("dst", F.lead("event_id").over(w)).withColumn("type2", F.lead("event_type").over(w)).withColumn("ts2", F.lead("ts").over(w))
    gap = _micros("ts2") - _micros("ts")
    same = F.col("event_type") == F.col("type2")
    return nxt.where(F.col("dst").isNotNull() & (gap <= 12 * 3600 * 1_000_000)).select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("src"), "dst", F.lit(0).alias("key"), F.when(same, "red").otherwise("blue").alias("color"), F.lit(None).cast("string").alias("lhead"), F.lit(None).cast("string").alias("ltail"))


_NODES = "SELECT user_id AS graph_id, event_id AS node_id, event_type AS label, strftime(ts, '%Y-%m-%d') AS bb_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS line, ts FROM events"
_EDGES = """SELECT user_id AS graph_id, event_id AS src, dst, CASE WHEN event_type = type2 THEN 'red' ELSE 'blue' END AS color FROM (
  SELECT *, lead(event_id) OVER w AS dst, lead(event_type) OVER w AS type2, lead(ts) OVER w AS ts2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x
  WHERE dst IS NOT NULL AND epoch_us(ts2) - epoch_us(ts) <= 43200000000"""
_GRAPH = f"n AS ({_NODES}), e AS ({_EDGES})"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# Features


@query("nn_counts", "SELECT user_id AS construct_id, event_type AS feature, count(*) AS value FROM events GROUP BY ALL")
def nn_counts(spark, d):
    return features.label_counts(event_nodes(spark, d).withColumnRenamed("graph_id", "construct_id"))


@query("metadata_features", f"WITH {_GRAPH} SELECT graph_id, 'metadata_num_nodes' AS feature, count(*) AS value FROM n GROUP BY 1 UNION ALL SELECT graph_id, 'metadata_num_edges', count(*) FROM e GROUP BY 1")
def metadata_features(spark, d):
    return features.size_features(event_nodes(spark, d), event_edges(spark, d), "graph_id")


@query("binary_features", "SELECT user_id AS construct_id, event_type AS feature, 1 AS value FROM events GROUP BY ALL")
def binary_features(spark, d):
    return features.binary(nn_counts(spark, d))


@query("construct_dedup", "SELECT doc_id AS location, sha1(text) AS hash, length(text) AS n_nodes FROM documents WHERE length(text) > 2 QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1")
def construct_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("location"), F.sha1(F.col("text").cast("binary")).alias("hash"), F.length("text").cast("long").alias("n_nodes"))
    return graph.eligible(docs)


@query("construct_hash", f"""WITH n AS ({_NODES}), s AS (SELECT graph_id, list_sort(list(DISTINCT bb_id)) AS b, list_sort(list(DISTINCT CAST(line AS VARCHAR))) AS l, list_sort(list(DISTINCT label)) AS t FROM n GROUP BY 1)
SELECT graph_id, sha1(concat('f', chr(30), array_to_string(b, chr(31)), chr(30), array_to_string(l, chr(31)), chr(30), array_to_string(t, chr(31)))) AS hash FROM s""")
def construct_hash(spark, d):
    return graph.construct_hash(event_nodes(spark, d).withColumn("file", F.lit("f")), ["graph_id"])


# Graphs


@query("edge_elimination", f"WITH e AS ({_EDGES}) SELECT graph_id, src, dst FROM e WHERE src <> dst AND color NOT IN ('blue', 'green')")
def edge_elimination(spark, d):
    return graph.eliminate_edges(event_edges(spark, d)).select("graph_id", "src", "dst")


def event_roots(spark, d):
    nodes = event_nodes(spark, d).withColumn("label", F.when(F.col("label") == "signup", F.concat(F.lit("%v"), F.col("node_id"), F.lit(" = alloca i32"))).otherwise(F.concat(F.lit("call void @"), "label")))
    return graph.roots(nodes, event_edges(spark, d))


@query("root_selection", f"WITH {_GRAPH} SELECT graph_id, node_id, 'LCL' AS kind, 'v' || node_id AS name FROM n WHERE label = 'signup' AND node_id IN (SELECT src FROM e)")
def root_selection(spark, d):
    return event_roots(spark, d)


def event_slices(spark, d):
    start = event_roots(spark, d).select("graph_id", F.col("node_id").alias("root"))
    return graph.forward_slices(event_nodes(spark, d), event_edges(spark, d), start)


_SLICES = f"""WITH RECURSIVE {_GRAPH}, roots AS (SELECT graph_id, node_id AS root FROM n WHERE label = 'signup' AND node_id IN (SELECT src FROM e)),
s AS (SELECT graph_id, root, root AS node_id FROM roots UNION SELECT s.graph_id, s.root, e.dst FROM s JOIN e ON e.graph_id = s.graph_id AND e.src = s.node_id)"""


@query("forward_slice", _SLICES + " SELECT graph_id, root, node_id FROM s")
def forward_slice(spark, d):
    return event_slices(spark, d)[0]


@query("slice_edges", _SLICES + " SELECT DISTINCT s.graph_id, s.root, e.src, e.dst FROM s JOIN e ON e.graph_id = s.graph_id AND e.src = s.node_id JOIN s t ON t.graph_id = s.graph_id AND t.root = s.root AND t.node_id = e.dst")
def slice_edges(spark, d):
    return event_slices(spark, d)[1]


@query("backward_slice", _SLICES + """, leaves AS (SELECT DISTINCT graph_id, root, node_id AS leaf FROM s WHERE node_id NOT IN (SELECT src FROM e)),
b AS (SELECT DISTINCT graph_id, leaf, leaf AS node_id FROM leaves UNION SELECT b.graph_id, b.leaf, e.src FROM b JOIN e ON e.graph_id = b.graph_id AND e.dst = b.node_id)
SELECT DISTINCT l.graph_id, l.root, b.node_id FROM leaves l JOIN b ON b.graph_id = l.graph_id AND b.leaf = l.leaf""")
def backward_slice(spark, d):
    start = event_roots(spark, d).select("graph_id", F.col("node_id").alias("root"))
    return graph.forward_backward_slices(event_nodes(spark, d), event_edges(spark, d), start)


@query("bb_quotient", f"WITH {_GRAPH} SELECT DISTINCT e.graph_id, a.bb_id AS src_bb, b.bb_id AS dst_bb FROM e JOIN n a ON a.node_id = e.src JOIN n b ON b.node_id = e.dst WHERE a.bb_id <> b.bb_id")
def bb_quotient(spark, d):
    return graph.quotient(event_nodes(spark, d), event_edges(spark, d), ["graph_id"])


@query("bb_chunks_1", f"WITH n AS ({_NODES}) SELECT graph_id, bb_id AS bbs, node_id FROM n")
def bb_chunks_1(spark, d):
    return graph.chunks(event_nodes(spark, d), event_edges(spark, d), ["graph_id"], 1)


@query("bb_chunks_2", f"""WITH {_GRAPH}, q AS (SELECT DISTINCT e.graph_id, a.bb_id AS s, b.bb_id AS t FROM e JOIN n a ON a.node_id = e.src JOIN n b ON b.node_id = e.dst WHERE a.bb_id <> b.bb_id)
SELECT q.graph_id, s || ',' || t AS bbs, node_id FROM q JOIN n ON n.graph_id = q.graph_id AND n.bb_id IN (s, t)""")
def bb_chunks_2(spark, d):
    return graph.chunks(event_nodes(spark, d), event_edges(spark, d), ["graph_id"], 2)


@query("control_lift", f"""WITH {_GRAPH}, m AS (SELECT graph_id, bb_id, arg_min(node_id, ts) AS f, arg_max(node_id, ts) AS l FROM n GROUP BY ALL),
c AS (SELECT DISTINCT e.graph_id, a.bb_id AS t, b.bb_id AS h FROM e JOIN n a ON a.node_id = e.src JOIN n b ON b.node_id = e.dst WHERE e.color = 'blue' AND a.bb_id <> b.bb_id)
SELECT c.graph_id, x.l AS src, y.f AS dst FROM c JOIN m x ON x.graph_id = c.graph_id AND x.bb_id = c.t JOIN m y ON y.graph_id = c.graph_id AND y.bb_id = c.h""")
def control_lift(spark, d):
    nodes, edges = event_nodes(spark, d), event_edges(spark, d)
    at = lambda end, name: nodes.select(F.col("node_id").alias(end), F.col("bb_id").alias(name))
    between = edges.drop("lhead", "ltail").join(at("src", "ltail"), "src").join(at("dst", "lhead"), "dst").where("ltail <> lhead")
    return graph.lift_control_flow(nodes, between)


@query("bb_first_last", f"WITH n AS ({_NODES}) SELECT graph_id, bb_id, arg_min(node_id, ts) AS first_node, arg_max(node_id, ts) AS last_node FROM n GROUP BY ALL")
def bb_first_last(spark, d):
    return graph.block_ends(event_nodes(spark, d))


@query("label_abstraction", r"""WITH t AS (SELECT conv_id, turn, role, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '[f] GLOB IN', ' '), '[f] IN ARG', ' '), ',', ' '), '(', ' '), ')', ' '), '[', ' '), ']', ' '), '{', ' '), '}', ' '), '"', ''), '=', ''), ' metadata ', ' ') AS x FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, role, [p FOR p IN regexp_split_to_array(x, '\s+') IF p <> ''] AS p FROM t)
SELECT conv_id, turn, role, array_to_string([CASE WHEN NOT contains(q, '%') AND contains(q, '@.str.') THEN '@.str' ELSE q END FOR q IN p IF
  CASE WHEN contains(q, '%') THEN contains(q, '%struct.') WHEN contains(q, '@.str.') THEN true
  ELSE q NOT IN ('align', 'subgraphs') AND NOT regexp_matches(q, '^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$', 'i') AND NOT starts_with(q, '0x')
    AND NOT contains(q, '!') AND NOT contains(q, '#') AND NOT contains(q, '...') AND NOT contains(q, '~') AND NOT contains(q, '$') END], ' ') AS label FROM w""")
def label_abstraction(spark, d):
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", abstract_label(F.col("text")).alias("label"))


_WL = f"""WITH {_GRAPH},
l1 AS (SELECT n.graph_id, n.node_id, md5(n.label || coalesce((SELECT '_' || string_agg(m.label, '_' ORDER BY m.label) FROM e JOIN n m ON m.node_id = e.dst WHERE e.src = n.node_id), '')) AS label FROM n),
l2 AS (SELECT n.graph_id, n.node_id, md5(n.label || coalesce((SELECT '_' || string_agg(m.label, '_' ORDER BY m.label) FROM e JOIN l1 m ON m.node_id = e.dst WHERE e.src = n.node_id), '')) AS label FROM l1 n),
w AS (SELECT graph_id, node_id, 0 AS round, label FROM n UNION ALL SELECT graph_id, node_id, 1, label FROM l1 UNION ALL SELECT graph_id, node_id, 2, label FROM l2)"""


@query("wl_labels", _WL + " SELECT graph_id, node_id, round, label FROM w")
def wl_labels(spark, d):
    return graph.wl_labels(event_nodes(spark, d), event_edges(spark, d), 2)


def _kernel_sql(h: int) -> str:
    return _WL + f""", c AS (SELECT graph_id, round, label, count(*)::DOUBLE AS n FROM w WHERE round <= {h} GROUP BY ALL), k AS (SELECT graph_id, sqrt(sum(n * n)) AS z FROM c GROUP BY 1)
SELECT a.graph_id AS a, b.graph_id AS b, round(sum(a.n * b.n) / (any_value(x.z) * any_value(y.z)), 9) AS kernel FROM c a JOIN c b ON a.round = b.round AND a.label = b.label AND a.graph_id < b.graph_id JOIN k x ON x.graph_id = a.graph_id JOIN k y ON y.graph_id = b.graph_id GROUP BY 1, 2"""


def _kernel(h):
    def run(spark, d):
        labels = graph.wl_labels(event_nodes(spark, d), event_edges(spark, d), h)
        return graph.wl_kernel(labels).withColumn("kernel", F.round("kernel", 9))

    return run


query("wl_kernel_h0", _kernel_sql(0))(_kernel(0))
query("wl_kernel_h1", _kernel_sql(1))(_kernel(1))


@query("degree_entropy", f"""WITH {_GRAPH}, g AS (SELECT n.graph_id, n.node_id, count(x.node_id) AS d FROM n LEFT JOIN (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) x ON x.node_id = n.node_id GROUP BY ALL),
b AS (SELECT graph_id, d, count(*)::DOUBLE AS k FROM g GROUP BY ALL), p AS (SELECT graph_id, k / sum(k) OVER (PARTITION BY graph_id) AS p FROM b) SELECT graph_id, round(sum(-p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY 1""")
def degree_entropy(spark, d):
    return graph.degree_entropy(event_edges(spark, d), event_nodes(spark, d)).withColumn("entropy", F.round("entropy", 6) + 0.0)


# Similarity and clusters


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_PAIRS = f"{_V}, p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {FIRST})"
_COMPONENTS = "u AS (SELECT a AS f, b AS g FROM {p} UNION SELECT b, a FROM {p}), r AS (SELECT id AS f, id AS g FROM {v} UNION SELECT r.f, u.g FROM r JOIN u ON u.f = r.g), c AS (SELECT f AS id, min(g) AS cluster FROM r GROUP BY f)"


@query("cosine_pairs", f"WITH {_PAIRS} SELECT a, b, round(sim, 4) AS sim FROM p")
def cosine_pairs(spark, d):
    return similarity.dense_pairs(vectors(spark, d), FIRST).withColumn("sim", F.round("sim", 4))


_COUNTS = "f AS (SELECT user_id AS id, event_type AS t, count(*)::DOUBLE AS n FROM events GROUP BY ALL)"


@query("sparse_cosine", f"WITH {_COUNTS}, z AS (SELECT id, sqrt(sum(n * n)) AS z FROM f GROUP BY 1) SELECT a.id AS a, b.id AS b, round(sum(a.n * b.n) / (any_value(x.z) * any_value(y.z)), 4) AS sim FROM f a JOIN f b ON a.t = b.t AND a.id < b.id JOIN z x ON x.id = a.id JOIN z y ON y.id = b.id GROUP BY 1, 2 HAVING sum(a.n * b.n) / (any_value(x.z) * any_value(y.z)) >= 0.99 - 1e-12")
def sparse_cosine(spark, d):
    return similarity.sparse_pairs(nn_counts(spark, d), 0.99).withColumn("sim", F.round("sim", 4))


@query("threshold_components", f"WITH RECURSIVE {_PAIRS}, {_COMPONENTS.format(p='p', v='v')} SELECT id, cluster FROM c")
def threshold_components(spark, d):
    v = vectors(spark, d)
    return cluster.threshold_clusters(v, similarity.dense_links(v, FIRST))


@query("dbscan_cosine", f"""WITH RECURSIVE {_PAIRS}, s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), core AS (SELECT a AS id FROM s GROUP BY 1 HAVING count(*) + 1 >= 4),
k AS (SELECT a, b FROM s WHERE a IN (FROM core) AND b IN (FROM core)), r AS (SELECT id AS f, id AS g FROM core UNION SELECT r.f, k.b FROM r JOIN k ON k.a = r.g), c AS (SELECT f AS id, min(g) AS cluster FROM r GROUP BY f),
o AS (SELECT s.a AS id, min(c.cluster) AS cluster FROM s JOIN c ON c.id = s.b WHERE s.a NOT IN (FROM core) GROUP BY 1)
SELECT v.id, coalesce(c.cluster, o.cluster, -1) AS cluster, c.id IS NOT NULL AS core FROM v LEFT JOIN c ON c.id = v.id LEFT JOIN o ON o.id = v.id""")
def dbscan_cosine(spark, d):
    v = vectors(spark, d)
    return cluster.dbscan(v, similarity.dense_pairs(v, FIRST), 4).fillna(-1, ["cluster"])


@query("dbscan_euclidean", f"""WITH RECURSIVE {_V}, p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE list_distance(a.v, b.v) <= 1.1), s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), core AS (SELECT a AS id FROM s GROUP BY 1 HAVING count(*) + 1 >= 2),
r AS (SELECT id AS f, id AS g FROM core UNION SELECT r.f, s.b FROM r JOIN s ON s.a = r.g), c AS (SELECT f AS id, min(g) AS cluster FROM r GROUP BY f)
SELECT v.id, coalesce(c.cluster, -1) AS cluster, c.id IS NOT NULL AS core FROM v LEFT JOIN c ON c.id = v.id""")
def dbscan_euclidean(spark, d):
    v = vectors(spark, d)
    return cluster.dbscan(v, similarity.dense_pairs(v, 1.1, metric="euclidean"), 2).fillna(-1, ["cluster"])


@query("cluster_sizes", f"WITH RECURSIVE {_PAIRS}, {_COMPONENTS.format(p='p', v='v')} SELECT cluster, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS members FROM c GROUP BY 1")
def cluster_sizes(spark, d):
    return cluster.members_by_size(threshold_components(spark, d)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


_TWO = f"""WITH RECURSIVE {_PAIRS}, {_COMPONENTS.format(p='p', v='v')}, gate AS (SELECT cluster FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND {GATE}), m AS (SELECT c.* FROM c WHERE cluster IN (FROM gate)),
p2 AS (SELECT a, b FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.cluster = y.cluster AND sim >= {SECOND}),
u2 AS (SELECT a AS f, b AS g FROM p2 UNION SELECT b, a FROM p2), r2 AS (SELECT id AS f, id AS g FROM m UNION SELECT r2.f, u2.g FROM r2 JOIN u2 ON u2.f = r2.g), two AS (SELECT m.cluster, s.sub, m.id FROM m JOIN (SELECT f AS id, min(g) AS sub FROM r2 GROUP BY f) s ON s.id = m.id)"""


@query("two_step_clusters", _TWO + " SELECT cluster, sub, id FROM two")
def two_step_clusters(spark, d):
    return cluster.two_step(vectors(spark, d), FIRST, SECOND, GATE)


def vector_features(spark, d):
    """Counts that explain clusters of vectors: the label, and the number of components above zero."""
    e = table(spark, d, "embeddings")
    above = F.size(F.filter("embedding", lambda x: x > 0))
    rows = e.select(F.col("vec_id").alias("id"), F.array(F.struct(F.concat(F.lit("label."), F.col("label").cast("string")).alias("feature"), F.lit(1).cast("long").alias("value")), F.struct(F.lit("icmp above").alias("feature"), above.cast("long").alias("value"))).alias("f"))
    return rows.select("id", F.explode("f").alias("x")).select("id", "x.feature", "x.value").where("value > 0")


_FEATURES = ", ft AS (SELECT vec_id AS id, 'label.' || label AS feature, 1::BIGINT AS value FROM embeddings UNION ALL SELECT vec_id, 'icmp above', len([x FOR x IN embedding IF x > 0])::BIGINT FROM embeddings WHERE len([x FOR x IN embedding IF x > 0]) > 0)"
_DIFFS = _FEATURES + ", size AS (SELECT cluster, count(*) AS n FROM two GROUP BY 1), df AS (SELECT t.cluster, ft.feature FROM two t JOIN ft ON ft.id = t.id JOIN size ON size.cluster = t.cluster GROUP BY 1, 2 HAVING count(*) < any_value(size.n) OR min(value) <> max(value))"


@query("differing_features", _TWO + _DIFFS + " SELECT cluster, feature FROM df")
def differing_features(spark, d):
    return differences.differing(two_step_clusters(spark, d).select("cluster", "id"), vector_features(spark, d), "id")


@query("ranked_inconsistencies", _TWO + ", z AS (SELECT cluster, sub, count(*) AS n FROM two GROUP BY ALL) SELECT cluster, count(*) AS n_subs, max(n) - min(n) AS score FROM z GROUP BY 1 HAVING count(*) >= 2")
def ranked_inconsistencies(spark, d):
    return differences.majority_rank(two_step_clusters(spark, d)).where("n_subs >= 2")


@query("inconsistency_documents", _TWO + _DIFFS + """, y AS (SELECT cluster FROM two GROUP BY 1 HAVING count(DISTINCT sub) >= 2), t AS (SELECT *, dense_rank() OVER (PARTITION BY cluster ORDER BY sub) AS k FROM two WHERE cluster IN (FROM y))
SELECT t.cluster, t.k::INTEGER AS sub_cluster_number, 'g' || t.id AS graph_path, replace(df.feature, '.', ';') AS node_name, coalesce(ft.value, 0)::INTEGER AS node_value FROM t JOIN df ON df.cluster = t.cluster LEFT JOIN ft ON ft.id = t.id AND ft.feature = df.feature""")
def inconsistency_documents(spark, d):
    """The assembled documents, a row a difference."""
    nested = materialise(two_step_clusters(spark, d), "nested")
    text = lambda c, v: F.concat(F.lit(v), F.col(c).cast("string"))
    constructs = nested.select("id", text("id", "g").alias("graph_path"), text("id", "f").alias("source_file_path"), F.array(F.lit(1)).alias("lines"), text("id", "fn").alias("function_name"), F.array(F.lit("b")).alias("bbs"), F.lit("v").alias("variable_name"))
    lines = nested.select("id", F.lit("none").alias("label"), F.expr("cast(array() as array<string>)").alias("lines"))
    docs = differences.assemble(nested, constructs, vector_features(spark, d), lines, {"construct_type": "afs", "firststep_threshold": FIRST}, "id")
    subs = docs.select("cluster", F.explode("subclusters").alias("s")).select("cluster", "s.sub_cluster_number", F.explode("s.constructs").alias("c"))
    return subs.select("cluster", "sub_cluster_number", "c.graph_path", F.explode("c.node_diffs").alias("n")).select("cluster", "sub_cluster_number", "graph_path", "n.node_name", "n.node_value")


@query("mean_vectors", "SELECT user_id AS construct_id, k::INTEGER AS dim, round(avg(x), 6) AS m FROM (SELECT user_id, unnest(range(0, 64)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM events JOIN embeddings ON vec_id = event_id) y GROUP BY 1, 2")
def mean_vectors(spark, d):
    nodes = event_nodes(spark, d).select(F.col("graph_id").alias("construct_id"), "node_id")
    means = features.mean_vectors(nodes, vectors(spark, d).withColumnRenamed("id", "node_id"))
    return means.select("construct_id", F.posexplode("vec").alias("dim", "m")).withColumn("m", F.round("m", 6))


def _places(nested):
    i = F.col("id")
    return nested.select("cluster", "sub", "id", F.concat(F.lit("f"), (i % 3).cast("string")).alias("file"), F.concat(F.lit("g"), (i % 5).cast("string")).alias("function"), F.concat(F.lit("v"), (i % 2).cast("string")).alias("variable"), F.array((i % 4).cast("string")).alias("bbs"))


@query("composite_rank", _TWO + """, pr AS (SELECT a.cluster, avg((a.id % 4 <> b.id % 4)::INT) AS m0, avg(CASE WHEN a.id % 2 = b.id % 2 THEN 1.0 ELSE 0.5 END) AS m1, avg((a.id % 5 <> b.id % 5)::INT) AS m2, avg((a.id % 3 <> b.id % 3)::INT) AS m3 FROM two a JOIN two b ON a.cluster = b.cluster AND a.id < b.id GROUP BY 1),
z AS (SELECT cluster, sub, count(*) AS n FROM two GROUP BY ALL), y AS (SELECT cluster, count(*) AS k, (max(n) - min(n)) / sum(n) AS m4 FROM z GROUP BY 1)
SELECT pr.cluster, round(1 - (m0 + m1 + m2 + m3 + m4 + (1 - k / (SELECT max(k) FROM y))) / 6, 6) AS score FROM pr JOIN y ON y.cluster = pr.cluster""")
def composite_rank(spark, d):
    return differences.composite_rank(_places(two_step_clusters(spark, d)), "id").withColumn("score", F.round("score", 6))


@query("construct_lines", f"WITH n AS ({_NODES}) SELECT graph_id, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM n GROUP BY 1")
def construct_lines(spark, d):
    return differences.construct_lines(event_nodes(spark, d), "graph_id").withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("label_lines", f"WITH n AS ({_NODES}) SELECT graph_id, label, array_to_string(list_sort(list(line)), ',') AS lines FROM n GROUP BY 1, 2")
def label_lines(spark, d):
    return differences.label_lines(event_nodes(spark, d), "graph_id").withColumn("lines", F.array_join("lines", ","))


# Inconsistency documents over conversations: a document a conversation, a sub-cluster a role, a construct a turn

_SETTINGS = {"construct_type": "afs", "dependency": "_ODD_"}


def conversation_documents(spark, d, files: int = 3):
    """Documents whose differences are the words of each turn, read as an instruction of some kind."""
    c = table(spark, d, "conversations").where("text IS NOT NULL AND conv_id IS NOT NULL")
    head = F.concat_ws(" ", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    kind = F.get(F.array(F.concat(F.lit("icmp "), head), F.concat(F.lit("store i8* null "), head), F.concat(F.lit("call void @x_Free "), head), F.concat(F.lit("trunc "), head)), (F.col("turn") % 4).cast("int"))
    n = F.length("text")
    diff = F.struct(kind.alias("node_name"), F.lit(1).alias("node_value"), F.array((n % 50).cast("string")).alias("lines"))
    none = F.expr("cast(array() as array<struct<node_name:string,node_value:int,lines:array<string>>>)")
    construct = F.struct(F.concat(F.lit("g"), F.col("turn").cast("string")).alias("graph_path"), F.concat(F.lit("file"), (n % files).cast("string")).alias("source_file_path"), F.array((n % 50).cast("int"), (n % 7).cast("int")).alias("lines"), F.concat(F.lit("fun"), (n % 2).cast("string")).alias("function_name"), F.array(F.lit("b")).alias("bbs"), F.lit("v").alias("variable_name"), F.when(n % 5 == 0, none).otherwise(F.array(diff)).alias("node_diffs"))
    subs = c.groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", construct.alias("c")))), lambda x: x["c"]).alias("constructs"))
    sub = F.struct(F.col("role").alias("r"), F.struct(F.lit(0).alias("sub_cluster_number"), F.size("constructs").alias("constructs_total"), "constructs").alias("s"))
    docs = subs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(sub)), lambda x: x["s"]).alias("subclusters"))
    return docs.select(F.col("conv_id").alias("_id"), F.col("conv_id").alias("ord"), *(F.lit(v).alias(k) for k, v in _SETTINGS.items()), (0.5 + (F.col("conv_id") % 10) / 20).alias("firststep_threshold"), "subclusters")


_T = r"""t AS (SELECT conv_id, role, turn, length(text) AS n, [w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> ''] AS w FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL),
k AS (SELECT *, ['icmp ', 'store i8* null ', 'call void @x_free ', 'trunc '][(turn % 4 + 1)::INT] || array_to_string(w, ' ') AS name, n % 5 <> 0 AS has FROM t),
ok AS (SELECT DISTINCT conv_id FROM t WHERE 0.5 + (conv_id % 10) / 20 >= 0.7)"""


def _name_query(kind, test):
    @query(f"q_{kind}", f"WITH {_T} SELECT DISTINCT k.conv_id AS _id FROM k JOIN ok USING (conv_id) WHERE {test}")
    def run(spark, d):
        return inconsistency.select(conversation_documents(spark, d), kind).select("_id")


_VERBS = "free|close|memset|clear|bzero|remove|unlock|end|clean|cleanse|assert"
_name_query("check", "has AND regexp_matches(name, '^icmp .*')")
_name_query("store", "has AND regexp_matches(name, '^store.* null .*')")
_name_query("call", f"has AND regexp_matches(name, 'call .*@.*?({_VERBS}).*')")
_name_query("type", "has AND regexp_matches(name, '^trunc .*')")
_name_query("order", "NOT has")
_name_query("all", "true")


@query("q_ids", "SELECT DISTINCT conv_id AS _id FROM conversations WHERE conv_id IN (1, 3, 5) AND text IS NOT NULL")
def q_ids(spark, d):
    return inconsistency.by_ids(conversation_documents(spark, d), [1, 3, 5]).select("_id")


_MARKS = f"""WITH {_T}, l AS (SELECT conv_id, unnest([n % 50, n % 7]) AS line FROM k), r AS (SELECT k.conv_id, count(DISTINCT role) AS subs, count(DISTINCT n % 3) AS files, count(DISTINCT n % 2) AS funs, count(*) AS c,
    array_to_string(list_sort(list('file' || (n % 3))), '|') || '/' || array_to_string(list_sort(list('fun' || (n % 2))), '|') AS key1 FROM k JOIN ok USING (conv_id) GROUP BY 1),
ll AS (SELECT conv_id, array_to_string(list_sort(list(line)), ',') AS key2 FROM l GROUP BY 1),
common AS (SELECT conv_id, line FROM (SELECT DISTINCT conv_id, turn, role, n, unnest([n % 50, n % 7]) AS line FROM k) x GROUP BY 1, 2 HAVING count(DISTINCT (turn, role, n)) = (SELECT count(*) FROM k WHERE k.conv_id = x.conv_id)),
q AS (SELECT DISTINCT conv_id FROM common)
SELECT r.conv_id AS _id, subs > 5 AS too_many_subs, files = 1 AND funs = 1 AND r.conv_id IN (FROM q) AS same_place, row_number() OVER (PARTITION BY key1, key2 ORDER BY r.conv_id) > 1 AS repeated FROM r JOIN ll USING (conv_id)"""


@query("q_filters", _MARKS)
def q_filters(spark, d):
    docs = inconsistency.select(conversation_documents(spark, d), "all")
    return inconsistency.mark(docs, "check").select("_id", "too_many_subs", "same_place", "repeated")


@query("q_kept", f"SELECT _id FROM ({_MARKS}) m WHERE NOT (too_many_subs OR same_place OR repeated)")
def q_kept(spark, d):
    return inconsistency.kept(inconsistency.mark(inconsistency.select(conversation_documents(spark, d), "all"), "all")).select("_id")


@query("gt_recall", f"""WITH {_T}, truth AS (SELECT conv_id AS id, 'file' || (n % 3) AS f, 'fun' || (n % 2) AS g, n % 7 AS line FROM k WHERE turn = 0),
x AS (SELECT conv_id, list(DISTINCT 'file' || (n % 3)) AS f, list(DISTINCT 'fun' || (n % 2)) AS g FROM k GROUP BY 1), l AS (SELECT conv_id, list(DISTINCT line) AS l FROM (SELECT conv_id, unnest([n % 50, n % 7]) AS line FROM k) y GROUP BY 1)
SELECT t.id, coalesce(string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id), '') AS found_by FROM truth t LEFT JOIN (x JOIN l USING (conv_id)) ON list_contains(x.f, t.f) AND list_contains(x.g, t.g) AND list_contains(l.l, t.line) GROUP BY 1""")
def gt_recall(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL AND conv_id IS NOT NULL AND turn = 0")
    n = F.length("text")
    none = F.expr("cast(array() as array<int>)")
    truth = c.select(F.col("conv_id").alias("id"), F.lit("check").alias("type"), F.lit("b").alias("benchmark"), none.alias("line_diffs"), F.array(F.concat(F.lit("file"), (n % 3).cast("string"))).alias("files"), F.array(F.concat(F.lit("fun"), (n % 2).cast("string"))).alias("functions"), F.array((n % 7).cast("int")).alias("lines_no_diff"))
    asked = inconsistency.demands(truth, "check", "b")
    found = inconsistency.found(conversation_documents(spark, d), asked)
    # the text once for each demand, not for each bug
    texts = found.select("demand", F.array_join(F.transform("found_by", lambda x: x.cast("string")), ",").alias("found_by"))
    return asked.join(texts, "demand", "left").select("id", F.coalesce("found_by", F.lit("")).alias("found_by"))


@query("report_page", f"WITH {_T} SELECT conv_id AS _id FROM ok ORDER BY 1 LIMIT 10 OFFSET 4")
def report_page(spark, d):
    return inconsistency.page(inconsistency.select(conversation_documents(spark, d), "all"), 5, 10).select("_id")


@query("source_excerpt", """WITH s AS (SELECT 'file' || doc_id AS file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x),
c AS (SELECT conv_id AS _id, role, turn, length(text) AS n FROM conversations WHERE text IS NOT NULL), o AS (SELECT _id, 'file' || (n % 1000) AS file, role, turn, [n % 50, n % 7] AS own, n FROM c),
w AS (SELECT DISTINCT _id, file, role, turn, n, own, unnest([own[1] - 1, own[1], own[1] + 1, own[2] - 1, own[2], own[2] + 1]) AS line FROM o)
SELECT _id, file, line::INTEGER AS line, CASE WHEN NOT list_contains(own, line) THEN 'margin' WHEN turn % 4 = 0 AND n % 5 <> 0 AND line = n % 50 THEN 'diff' ELSE 'code' END AS kind, count(*) AS times FROM w JOIN s USING (file, line) WHERE trim(text) <> '' GROUP BY ALL""")
def source_excerpt(spark, d):
    from .sources.readers import source_lines

    texts = table(spark, d, "documents").select(F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("file"), "text")
    return inconsistency.excerpts(conversation_documents(spark, d, 1000), source_lines(texts), "check").groupBy("_id", "file", "line", "kind").agg(F.count("*").alias("times"))


# Statistics


@query("size_distribution", "WITH s AS (SELECT user_id, event_type, count(*) AS n_nodes FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, min(n_nodes) AS least, quantile_cont(n_nodes, 0.25) AS q1, quantile_cont(n_nodes, 0.5) AS median, quantile_cont(n_nodes, 0.75) AS q3, max(n_nodes) AS most, round(avg(n_nodes), 6) AS mean FROM s GROUP BY 1")
def size_distribution(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n_nodes"))
    return statistics.size_distribution(s, ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("stage_times", "SELECT coalesce(event_type, 'total') AS metric, round(sum(round(value)) / 60, 4) AS minutes, round(sum(round(value)) / 3600, 6) AS hours FROM events GROUP BY ROLLUP (event_type)")
def stage_times(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("granularity"), F.round("value").alias("seconds"))
    return statistics.stage_times(t)


@query("top_clusters", f"WITH RECURSIVE {_PAIRS}, {_COMPONENTS.format(p='p', v='v')} SELECT cluster, count(*) AS n FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_clusters(spark, d):
    return statistics.biggest_clusters(threshold_components(spark, d))


@query("clusters_of_functions", f"""WITH RECURSIVE {_PAIRS}, {_COMPONENTS.format(p='p', v='v')}, k AS (SELECT DISTINCT nation.n_nationkey::VARCHAR AS function FROM nation), h AS (SELECT DISTINCT function, cluster FROM c JOIN k ON ends_with(c.id::VARCHAR, k.function))
SELECT function, cluster, count(*) AS n, CASE WHEN count(*) <= 3 THEN string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) END AS members FROM h JOIN c USING (cluster) GROUP BY 1, 2""")
def clusters_of_functions(spark, d):
    clusters = threshold_components(spark, d).select(F.col("id").cast("string").alias("location"), "cluster")
    functions = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("function")).distinct()
    found = statistics.clusters_of_functions(materialise(clusters, "clusters"), functions, most=3)
    return found.withColumn("members", F.array_join("members", ","))


@query("slice_similarity", f"WITH {_COUNTS}, z AS (SELECT id, sqrt(sum(n * n)) AS z FROM f GROUP BY 1), i AS (SELECT DISTINCT id, id // 20 AS grp FROM f) SELECT a.grp AS \"group\", a.id AS a, b.id AS b, round(coalesce((SELECT sum(x.n * y.n) FROM f x JOIN f y ON x.t = y.t WHERE x.id = a.id AND y.id = b.id), 0) / (p.z * q.z), 5) AS sim FROM i a JOIN i b ON a.grp = b.grp AND a.id < b.id JOIN z p ON p.id = a.id JOIN z q ON q.id = b.id")
def slice_similarity(spark, d):
    f = nn_counts(spark, d)
    slices = f.select("construct_id").distinct().withColumn("group", F.floor(F.col("construct_id") / 20).cast("long"))
    return statistics.slice_similarities(f, slices)


# Structure: nations that trade


def trade(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    mean = pairs.agg(F.avg("n").alias("mean"))  # one row
    strong = pairs.join(F.broadcast(mean)).where("s_nationkey <> c_nationkey AND n > mean").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return materialise(graph.undirected(strong), "trade")


_TRADE = """g0 AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT a, b FROM g0 WHERE a <> b AND n > (SELECT avg(n) FROM g0)),
e AS (SELECT a AS src, b AS dst FROM t UNION SELECT b, a FROM t)"""


@query("node2vec_transition", f"WITH {_TRADE}, x AS (SELECT f.src AS prev, f.dst AS cur, s.dst AS next, CASE WHEN s.dst = f.src THEN 4.0 WHEN EXISTS (SELECT 1 FROM e WHERE e.src = f.src AND e.dst = s.dst) THEN 1.0 ELSE 4.0 END AS w FROM e f JOIN e s ON s.src = f.dst) SELECT prev, cur, next, round(w / sum(w) OVER (PARTITION BY prev, cur), 6) AS prob FROM x")
def node2vec_transition(spark, d):
    return structure.transitions(trade(spark, d)).withColumn("prob", F.round("prob", 6))


_RINGS = f"""WITH RECURSIVE {_TRADE}, g AS (SELECT src AS v, count(*) AS d FROM e GROUP BY 1), r AS (SELECT v, v AS u, 0 AS layer FROM g UNION SELECT r.v, e.dst, r.layer + 1 FROM r JOIN e ON e.src = r.u WHERE r.layer < 2), m AS (SELECT v, u, min(layer) AS layer FROM r GROUP BY 1, 2)"""


@query("degree_rings", _RINGS + " SELECT m.v, m.layer, array_to_string(list_sort(list(g.d)), ',') AS degrees FROM m JOIN g ON g.v = m.u GROUP BY 1, 2")
def degree_rings(spark, d):
    return structure.rings(trade(spark, d), 2).withColumn("degrees", F.array_join(F.transform("degrees", lambda x: x.cast("string")), ","))


@query("layer_weights", _RINGS + """, s AS (SELECT m.v, m.layer, sum(g.d) AS s FROM m JOIN g ON g.v = m.u GROUP BY 1, 2), p AS (SELECT a.layer, a.v, b.v AS u, abs(a.s - b.s) / 10.0 AS x FROM s a JOIN s b ON a.layer = b.layer AND a.v <> b.v)
SELECT layer, v, u, round(exp(-x) / sum(exp(-x)) OVER (PARTITION BY layer, v), 6) AS weight FROM p""")
def layer_weights(spark, d):
    r = structure.rings(trade(spark, d), 2).select("v", "layer", F.aggregate("degrees", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    p = r.join(r.withColumnsRenamed({"v": "u", "s": "s2"}), "layer").where("v < u").select("layer", "v", "u", (F.abs(F.col("s") - F.col("s2")) / 10.0).alias("distance"))
    return structure.layer_weights(p).withColumn("weight", F.round("weight", 6))


@query("graph_size", f"WITH {_TRADE} SELECT count(DISTINCT src) AS n_vertices, count(*) // 2 AS n_edges, 0::BIGINT AS n_loops FROM e")
def graph_size(spark, d):
    return graph.graph_size(trade(spark, d))


# Without SQL: learnt, random or iterative to convergence


@query("g2v_embedding")
def g2v_embedding(spark, d):
    nodes, edges = (x.withColumnRenamed("graph_id", "construct_id") for x in (event_nodes(spark, d), event_edges(spark, d)))
    v = features.hashed_embedding(features.wl_features(nodes, edges, 2), 64)
    return v.select("construct_id", F.array_join(F.transform("vec", lambda x: F.format_number(x, 4)), ",").alias("vec"))


@query("node2vec_embedding")
def node2vec_embedding(spark, d):
    from pyspark.ml.functions import vector_to_array

    paths = structure.walks(trade(spark, d), 4, 8)
    return structure.node_embeddings(paths, 16).select("word", F.size(vector_to_array("vector")).alias("dims"))


@query("structural_distances")
def structural_distances(spark, d):
    e = trade(spark, d)
    # a pair counts if either of its vertices has chosen the other
    pairs = structure.candidates(e).select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).distinct()
    return structure.layer_distances(structure.rings(e, 2), pairs)


@query("compact_distances")
def compact_distances(spark, d):
    e = trade(spark, d)
    pairs = structure.candidates(e).select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).distinct()
    return structure.layer_distances(structure.compact(structure.rings(e, 2)), pairs)


@query("structural_walks")
def structural_walks(spark, d):
    weights = structure.layer_weights(structural_distances(spark, d))
    return structure.structural_walks(weights, 2, 6).select("walk", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("lda_topics")
def lda_topics(spark, d):
    return cluster.lda(nn_counts(spark, d), 5, rounds=3)


@query("affinity")
def affinity(spark, d):
    return cluster.affinity(vectors(spark, d), None, False)


@query("mean_shift")
def mean_shift(spark, d):
    return cluster.mean_shift(vectors(spark, d), 1.1)


# each graph is a set of chains, and a chain of s nodes has the eigenvalues 2 - 2 cos(pi k / s), k below s
_SPECTRA = """x AS (SELECT user_id AS g, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000) IS NOT TRUE AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT g, sum(cut::INTEGER) OVER (PARTITION BY g ORDER BY ts, event_id) AS chain FROM x), c AS (SELECT g, chain, count(*) AS s FROM y GROUP BY ALL HAVING count(*) > 1),
v AS (SELECT g, 2 - 2 * cos(pi() * k / s) AS x FROM (SELECT g, s, unnest(range(0, s)) AS k FROM c) z), o AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS i FROM v),
d AS (SELECT p.g AS a, q.g AS b, sum((p.x - q.x) ** 2) AS distance FROM o p JOIN o q ON p.i = q.i AND p.g < q.g GROUP BY 1, 2)"""


@query("spectrum_distance", f"WITH {_SPECTRA} SELECT a, b, round(distance, 6) AS distance FROM d")
def spectrum_distance(spark, d):
    # all pairs, as in the original
    return graph.spectrum_distance(event_edges(spark, d)).withColumn("distance", F.round("distance", 6))


@query("scaled_spectrum_distance", f"WITH {_SPECTRA}, m AS (SELECT * FROM d UNION ALL SELECT b, a, distance FROM d) SELECT a, b, round(coalesce(distance / nullif(max(distance) OVER (PARTITION BY b), 0), 0), 6) AS distance FROM m")
def scaled_spectrum_distance(spark, d):
    return graph.scaled_spectrum_distance(event_edges(spark, d)).withColumn("distance", F.round("distance", 6))
