"""Readers, writers and generators: tables written in each format and read back, and made-up data sets by their shapes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.strings import chunks
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import files, generators, sinks
from ..streaming import traces
from .registry import query, r


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS y FROM part")
def csv_features(t):
    """Numeric columns of a CSV as features, one text column as labels, the other left out."""
    path = scratch_path(t.spark, "part") + ".csv"
    t.part.select("p_partkey", "p_name", "p_size", "p_retailprice", "p_brand").write.csv(path, header=True)
    found = files.read_features(t.spark, path, label="p_brand", id_col="p_partkey")
    # p_partkey is the id and a number too, but no feature
    return found.select("id", F.col("f")[0].alias("size"), F.col("f")[1].alias("price"), "y")


@query("SELECT 'good' AS file, 'features' AS key, '2' AS value UNION ALL SELECT 'good', 'rows', CAST(count(*) AS VARCHAR) FROM part UNION ALL SELECT 'broken', 'fields', '0' UNION ALL SELECT 'missing', 'fields', '0'")
def csv_metadata(t):
    """Fields of metadata files: a good one, a broken one, none at all."""
    base = scratch_path(t.spark, "meta")
    facts = t.part.agg(F.count("*").alias("rows")).select(F.to_json(F.struct("rows", F.lit(2).alias("features"))).alias("line"), F.lit(0).alias("at"))
    sinks.write_text_file(facts, f"{base}/good.meta.json", "at")
    sinks.write_text_file(t.spark.sql("select '{broken' line, 0 at"), f"{base}/broken.meta.json", "at")
    rows = [("good", k, str(v)) for k, v in files.read_metadata(t.spark, f"{base}/good.meta.json").items()]
    rows += [(name, "fields", str(len(files.read_metadata(t.spark, f"{base}/{name}.meta.json")))) for name in ("broken", "missing")]
    return t.spark.createDataFrame(rows, "file string, key string, value string")


@query("SELECT vec_id AS sample_index, CAST(label + 1 AS BIGINT) AS cluster_label, label AS true_label FROM embeddings")
def label_csv(t):
    path = scratch_path(t.spark, "labels")
    sinks.write_labels(t.vectors.select("id", (F.col("y") + 1).alias("label")), path, t.vectors)
    return t.spark.read.csv(path, header=True, schema="sample_index bigint, cluster_label bigint, true_label int")


@query("SELECT s_suppkey AS \"sampleID\", 'N' || s_nationkey AS \"PAM50\", CAST(s_suppkey % 5 AS BIGINT) AS multiproto_subtype FROM supplier")
def stage_csv(t):
    """A stage's table sampleID, PAM50, multiproto_subtype."""
    path = scratch_path(t.spark, "stage")
    rows = t.supplier.select(F.col("s_suppkey").alias("sampleID"), F.expr("concat('N', s_nationkey)").alias("PAM50"), F.expr("s_suppkey % 5").alias("multiproto_subtype"))
    rows.write.csv(path, header=True)
    return t.spark.read.csv(path, header=True, schema="sampleID bigint, PAM50 string, multiproto_subtype bigint")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, CAST(NULL AS DOUBLE) AS bad FROM customer GROUP BY c_mktsegment")
def report_json(t):
    """A report as JSON lines; numbers that aren't finite become null."""
    path = scratch_path(t.spark, "report")
    report = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))
    sinks.write_report(report.withColumn("bad", F.expr("if(n % 2 = 0, double('nan'), double('inf'))")), path)
    return t.spark.read.json(path, schema="segment string, n bigint, mean double, bad double").select("segment", "n", r("mean").alias("mean"), "bad")


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings")
def embedding_dump(t):
    path = scratch_path(t.spark, "embedding")
    sinks.write_embedding(t.vectors, path)
    return t.spark.read.parquet(path).select("id", F.size("f").alias("n"), r(F.expr("aggregate(f, 0D, (s, x) -> s + x)")).alias("total"))


TRACE = "x AS (SELECT event_type AS caller, event_id % 7 = 0 AS is_retry, value AS cost_usd, event_id % 2 AS part FROM events)"


def _trace(t):
    return t.events.select(
        F.lit("call").alias("event"), F.col("event_type").alias("caller"), F.expr("event_id % 7 = 0").alias("is_retry"), F.col("value").alias("cost_usd"), F.expr("event_id % 2").alias("part")
    )


@query(f"WITH {TRACE} SELECT caller, count(*) AS calls, count(*) FILTER (is_retry) AS retries, round(sum(cost_usd), 4) AS cost FROM x GROUP BY caller")
def trace_log(t):
    """A trace appended in two goes, with a line that doesn't parse, read back."""
    path, rows = scratch_path(t.spark, "trace"), _trace(t)
    for part in (0, 1):
        sinks.append_trace(rows.filter(F.col("part") == part).drop("part"), path)
    t.spark.sql("select '{\"caller\": ' line").write.mode("append").text(path)
    found = files.read_trace(t.spark, path)
    return found.groupBy("caller").agg(F.count("*").alias("calls"), F.count_if("is_retry").alias("retries"), r(F.sum("cost_usd"), 4).alias("cost"))


@query(f"WITH {TRACE} SELECT caller, count(*) AS calls, count(*) FILTER (is_retry) AS retries, round(sum(cost_usd), 4) AS cost FROM x GROUP BY caller")
def trace_increments(t):
    """The same trace as a stream: each run reads only what was appended since the last."""
    path, out, rows = scratch_path(t.spark, "trace"), scratch_path(t.spark, "new-rows"), _trace(t)
    for part in (0, 1):
        sinks.append_trace(rows.filter(F.col("part") == part).drop("part"), path)
        traces.drain(traces.trace_stream(t.spark, path).select("caller", "is_retry", "cost_usd"), out, f"{out}-offsets")
    found = t.spark.read.parquet(out)
    return found.groupBy("caller").agg(F.count("*").alias("calls"), F.count_if("is_retry").alias("retries"), r(F.sum("cost_usd"), 4).alias("cost"))


@query("SELECT o_custkey AS key, max(o_orderkey) AS updated FROM orders GROUP BY o_custkey ORDER BY updated DESC, key DESC LIMIT 50")
def cache_upsert(t):
    """Two result tables merged by key: the newest row of each key, and of these the 50 newest."""
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("updated"))
    return sinks.upsert(rows.filter("updated % 2 = 0"), rows.filter("updated % 2 = 1"), "key", "updated", 50)


@query("SELECT vec_id, 'kept' AS name, vec_id * 2 AS inner_id, 2 AS fields FROM embeddings")
def heavy_stripping(t):
    """Payloads dropped before a session is stored, also inside structs."""
    rows = t.embeddings.select("vec_id", "embedding", F.col("vec_id").alias("y"), F.struct(F.lit("kept").alias("name"), F.col("embedding").alias("X"), F.expr("vec_id * 2").alias("inner_id")).alias("info"))
    kept = sinks.strip_heavy(rows)
    return kept.select("vec_id", "info.name", "info.inner_id", F.lit(len(kept.columns)).alias("fields"))


COUNTS = "m AS (SELECT n_name AS sample, c_mktsegment AS feature, CAST(count(*) AS DOUBLE) AS value, n_nationkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"


def _segments_by_nation(t, path: str) -> None:
    """Features in rows, samples in columns."""
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows.groupBy(F.col("c_mktsegment").alias("gene")).pivot("n_name").count().coalesce(1).write.csv(path, sep="\t", header=True)


@query(f"WITH {COUNTS} SELECT sample, feature, value, r_name AS site FROM m JOIN nation ON n_name = sample JOIN region ON r_regionkey = n_regionkey WHERE k % 3 <> 0")
def expression_files(t):
    """A matrix with features in rows, turned because its header holds the samples, and the phenotypes of some samples."""
    base = scratch_path(t.spark, "expression")
    _segments_by_nation(t, f"{base}/matrix")
    pheno = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")).filter("n_nationkey % 3 <> 0")
    pheno.select(F.col("n_name").alias("sampleID"), F.col("r_name").alias("site")).coalesce(1).write.csv(f"{base}/pheno", sep="\t", header=True)
    expr, found = files.read_expression(t.spark, f"{base}/matrix", f"{base}/pheno")
    return expr.filter("value is not null").join(F.broadcast(found), "sample").select("sample", "feature", "value", "site")


@query(f"WITH {COUNTS} SELECT sample, feature, value FROM m")
def genes_by_samples(t):
    path = scratch_path(t.spark, "genes")
    _segments_by_nation(t, path)
    return files.read_long_matrix(t.spark, path, features_in_rows=True).filter("value is not null")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS \"PATIENT_ID\", s_name AS \"CLAUDIN_SUBTYPE\" FROM supplier")
def clinical_table(t):
    """A table whose header follows four lines of comments."""
    path = scratch_path(t.spark, "clinical") + ".txt"
    head = t.spark.createDataFrame([(i - 5, s) for i, s in enumerate(["#Patient", "#Identifier", "#STRING", "#1", "PATIENT_ID\tCLAUDIN_SUBTYPE"])], "at bigint, line string")
    rows = t.supplier.select(F.col("s_suppkey").alias("at"), F.concat_ws("\t", F.col("s_suppkey"), "s_name").alias("line"))
    sinks.write_text_file(head.unionByName(rows), path, "at")
    return files.read_after_lines(t.spark, path, 4)


@query("SELECT s_name AS barcode, CAST(s_suppkey % 10 AS INTEGER) AS row, CAST(s_suppkey % 7 AS INTEGER) AS col, s_acctbal AS x, s_acctbal / 2 AS y, 'Layer' || (s_nationkey % 3 + 1) AS layer FROM supplier WHERE s_suppkey % 3 <> 0")
def spot_slice(t):
    """Positions without a header, and one barcode file for each layer, named by its file."""
    base = scratch_path(t.spark, "spots")
    rows = t.supplier.select("s_name", F.expr("cast(s_suppkey % 3 <> 0 as int)"), F.expr("s_suppkey % 10"), F.expr("s_suppkey % 7"), "s_acctbal", F.expr("s_acctbal / 2"))
    rows.write.csv(f"{base}/positions")
    for k in range(3):
        sinks.write_text_file(t.supplier.filter(f"s_nationkey % 3 = {k}").select(F.col("s_name").alias("line")), f"{base}/layers/Layer{k + 1}_barcodes.txt", "line")
    return files.read_spots(t.spark, f"{base}/positions", f"{base}/layers").drop("in_tissue")


@query(
    """WITH f AS (SELECT r_name || '.txt' AS source, repeat(r_name || ' ', 200) AS text FROM region WHERE r_regionkey <> 3)
    SELECT source, CAST(s // 600 AS INTEGER) AS chunk_no, substring(text, s + 1, 800) AS chunk FROM (SELECT *, CAST(unnest(range(0, length(text), 600)) AS INTEGER) AS s FROM f)"""
)
def new_documents(t):
    """Text files that the manifest doesn't name yet, in overlapping chunks."""
    base = scratch_path(t.spark, "library")
    names = [x.r_name for x in t.region.collect()]  # one file a region
    for name in names:
        sinks.write_text_file(t.region.filter(F.col("r_name") == name).select(F.expr("repeat(concat(r_name, ' '), 200)").alias("line")), f"{base}/{name}.txt", "line")
    known = t.region.filter("r_regionkey = 3").select(F.concat("r_name", F.lit(".txt")).alias("source"))
    # the writer ends a file by a line feed, which is no part of the text
    docs = files.read_new_documents(t.spark, base, known)
    whole = docs.groupBy("source").agg(F.max(F.struct("chunk_no", "chunk")).alias("last"), F.count("*").alias("n"))
    trimmed = F.when(F.col("chunk_no") == F.col("last.chunk_no"), F.regexp_replace("chunk", "\n$", "")).otherwise(F.regexp_replace("chunk", "\n$", ""))
    return docs.join(whole, "source").select("source", "chunk_no", trimmed.alias("chunk")).filter("chunk <> ''")


@query("SELECT r_name || '.tex' AS file, least(5, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey)) AS rows, CAST(1 AS BIGINT) AS tables FROM region")
def latex_files(t):
    """A LaTeX report for each region with the five suppliers of the largest balance, read back."""
    base = scratch_path(t.spark, "reports")
    by = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    for x in t.region.collect():  # one report a region
        rows = by.filter(F.col("n_regionkey") == x.r_regionkey).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5)
        ranking = rows.selectExpr("row_number() over (order by s_acctbal desc, s_suppkey) rank", "s_name algorithm", "s_acctbal / 10000 ari", "cast(null as double) nmi")
        tex = sinks.latex_report(ranking, x.r_name)
        lines = t.spark.createDataFrame(list(enumerate(tex.splitlines())), "at int, line string")
        sinks.write_text_file(lines, f"{base}/{x.r_name}.tex", "at")
    lines = t.spark.read.text(base).select(F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).alias("file"), "value")
    return lines.groupBy("file").agg(F.count_if(F.expr("value like '% & n/a \\\\\\\\\\\\\\\\%'")).alias("rows"), F.count_if(F.expr("value like '%begin{tabular}%'")).alias("tables"))


#: Data sets by name: classes, dimensions, and centres of classes where they are fixed.
SHAPES = {
    "blobs": (3, 2, [[-4, 0], [3, 3], [4, -4]]), "moons": (2, 2, [[0, 0.637], [1, -0.137]]), "s_curve": (3, 3, None), "smile": (3, 2, [[-1, 1], [1, 1], [0, -1.1]]),
    "wide_blobs": (5, 100, None), "two_views": (0, 20, None), "square": (5, 2, [[0.5, 0.5], [-0.5, 0.5], [0.5, -0.5], [-0.5, -0.5], [0, 0]]), "half_kernel": (4, 2, [[0, 3], [-1.2, 2.2], [1.2, 2.2], [0, 0.333]]),
    "rice": (3, 2, [[7, 2], [5.5, 2.8], [6.2, 2.3]]),
}


def _shape_sql(name: str) -> str:
    classes, d, _ = SHAPES[name]
    if not classes:
        return f"SELECT -1 AS y, CAST(480 AS BIGINT) AS n, {d} AS d, true AS placed"
    return f"SELECT CAST(i % {classes} AS INTEGER) AS y, count(*) AS n, {d} AS d, true AS placed FROM range(480) r(i) GROUP BY ALL"


def _shape(name: str):
    def data_set(t):
        centres = SHAPES[name][2]
        rows = generators.generate(t.spark, name, 480)
        placed = F.lit(True)
        if centres:
            want = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
            placed = V.distance("c", "want") < 0.5
            rows = rows.join(V.centroid_arrays(rows).withColumn("want", F.element_at(want, F.col("label").cast("int") + 1)).withColumn("placed", placed).select(F.col("label").alias("y"), "placed"), "y")
        else:
            rows = rows.withColumn("placed", placed)
        return rows.groupBy(F.coalesce("y", F.lit(-1)).alias("y")).agg(F.count("*").alias("n"), F.first(F.size("f")).alias("d"), F.first("placed").alias("placed"))

    data_set.__name__ = f"generate_{name}"
    data_set.__doc__ = f"Classes, sizes and places of the made-up data set {name}."
    return query(_shape_sql(name))(data_set)


for _name in SHAPES:
    _shape(_name)


@query("SELECT CAST(500 AS BIGINT) AS samples, CAST(40 AS BIGINT) AS genes, CAST(20000 AS BIGINT) AS cells, CAST(5 AS BIGINT) AS subtypes, CAST(3 AS BIGINT) AS sites, true AS subtypes_differ")
def generate_cohort(t):
    """An expression cohort with five subtypes and three sites: subtype means of the genes differ by more than chance."""
    long, pheno = generators.cohort(t.spark, 500, 40)
    means = long.join(F.broadcast(pheno), "sample").groupBy("feature", "subtype").agg(F.avg("value").alias("m")).groupBy("feature").agg(F.stddev_pop("m").alias("sd"))
    facts = long.agg(F.count_distinct("sample").alias("samples"), F.count_distinct("feature").alias("genes"), F.count("*").alias("cells"))
    return facts.crossJoin(pheno.agg(F.count_distinct("subtype").alias("subtypes"), F.count_distinct("site").alias("sites"))).crossJoin(means.agg((F.max("sd") > 0.5).alias("subtypes_differ")))
