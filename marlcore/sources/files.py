"""Readers: feature tables, matrices with phenotypes, spatial slices, documents, traces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_features(spark: SparkSession, path: str, label: str | None = "infer", id_col: str | None = None) -> DataFrame:
    """id, f, y from a CSV with a header: columns that are numbers throughout become features, gaps their mean.

    label='infer' takes the last column as labels if it has fewer distinct values than a fifth of the rows; a name takes that
    column; None takes none.  Labels are numbered in sorted order.  Other text columns are left out.
    """
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files are read here")
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
    names = raw.columns
    q = lambda c: f"`{c}`"
    bad = [F.sum(F.expr(f"if({q(c)} is not null and trim({q(c)}) <> '' and try_cast(trim({q(c)}) as double) is null, 1, 0)")).alias(f"b{i}") for i, c in enumerate(names)]
    facts = raw.agg(F.count("*").alias("n"), F.count_distinct(q(names[-1])).alias("last"), *bad).first()
    if label == "infer":
        label = names[-1] if len(names) > 1 and facts["last"] < facts["n"] / 5 else None
    numeric = [c for i, c in enumerate(names) if c not in (label, id_col) and not facts[f"b{i}"]]
    if not numeric:
        raise ValueError(f"{path} has no numeric column")
    rows = raw.withColumn("__id", F.expr(f"cast({q(id_col)} as bigint)") if id_col else F.monotonically_increasing_id())
    values = [F.expr(f"try_cast(nullif(trim({q(c)}), '') as double)").alias(f"v{i}") for i, c in enumerate(numeric)]
    table = rows.select(F.col("__id").alias("id"), *values, (F.col(q(label)) if label else F.lit(None).cast("string")).alias("__label"))
    means = table.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(numeric))])
    filled = F.array(*[F.coalesce(f"v{i}", f"m{i}", F.lit(0.0)) for i in range(len(numeric))])
    out = table.crossJoin(F.broadcast(means)).select("id", filled.alias("f"), "__label")
    if not label:
        return out.select("id", "f", F.lit(None).cast("int").alias("y"))
    order = Window.partitionBy(F.lit(0)).orderBy("__label")  # one row a class
    codes = out.select("__label").filter("__label is not null").distinct().withColumn("y", (F.row_number().over(order) - 1).cast("int"))
    return out.join(F.broadcast(codes), "__label", "left").select("id", "f", F.coalesce("y", F.lit(-1)).alias("y"))


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The fields of <file>.meta.json; {} if it is missing or broken."""
    try:
        row = spark.read.json(path, multiLine=True, mode="FAILFAST").first()
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "MALFORMED", "Malformed", "corrupt", "FAILED_READ_FILE")):
            return {}
        raise
    return {k: v for k, v in row.asDict(True).items() if k != "_corrupt_record"} if row else {}


def read_arrays(spark: SparkSession, path: str, labels_path: str | None = None) -> DataFrame:
    """id, f, y from .npy or .npz (features, labels) on the driver's disk."""
    data = np.load(path)
    x = data["features"] if hasattr(data, "files") else data
    y = np.load(labels_path) if labels_path else data["labels"] if hasattr(data, "files") and "labels" in data.files else None
    x = np.asarray(x, float).reshape(len(x), -1)
    return spark.createDataFrame([(i, row.tolist(), None if y is None else int(y[i])) for i, row in enumerate(x)], "id bigint, f array<double>, y int")


def read_long_matrix(spark: SparkSession, path: str, sep: str = "\t", features_in_rows: bool = False, text_columns: list[str] | None = None) -> DataFrame:
    """sample, feature, value from a wide text matrix whose first column names its rows."""
    raw = spark.read.csv(path, sep=sep, header=True)
    key, rest = raw.columns[0], [c for c in raw.columns[1:] if c not in (text_columns or [])]
    long = raw.unpivot([key], rest, "__other", "__v")
    value = F.expr("try_cast(__v as double)").alias("value")
    if features_in_rows:
        return long.select(F.col("__other").alias("sample"), F.col(key).alias("feature"), value)
    return long.select(F.col(key).alias("sample"), F.col("__other").alias("feature"), value)


def read_expression(spark: SparkSession, matrix: str, phenotypes: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Long expression and phenotypes(sample, ...) of the samples in both; a matrix with features in rows is turned."""
    pheno = spark.read.csv(phenotypes, sep=sep, header=True)
    pheno = pheno.withColumnRenamed(pheno.columns[0], "sample")
    expr = read_long_matrix(spark, matrix, sep)
    if expr.join(pheno.select("sample"), "sample", "left_semi").limit(1).count() == 0:
        expr = read_long_matrix(spark, matrix, sep, features_in_rows=True)
    both = expr.select("sample").distinct().join(pheno.select("sample"), "sample").distinct()
    return expr.join(both, "sample", "left_semi"), pheno.join(both, "sample", "left_semi")


def read_after_lines(spark: SparkSession, path: str, skip: int, sep: str = "\t") -> DataFrame:
    """A table in one file whose header follows `skip` lines, all columns as text.

    Lines are read in splits; only the first skip + 1 come to the driver.  They are left out of the table by their place: the
    file's first block is the first that its partition reads, and numbers of a partition's rows start at its own base.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    head = lines.filter("block = 0").select("line").limit(skip + 1).collect()
    if len(head) <= skip:
        return spark.createDataFrame([], "empty string")
    names = head[skip]["line"].split(sep)
    rows = lines.filter(f"(block <> 0 or (at & {(1 << 33) - 1}) > {skip}) and line <> ''")
    cells = rows.select(F.split("line", sep).alias("c"))
    return cells.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_spots(spark: SparkSession, positions: str, layers: str | None = None) -> DataFrame:
    """barcode, row, col, x, y, layer from a positions CSV without header and one barcode file for each layer."""
    schema = "barcode string, in_tissue int, row int, col int, x double, y double"
    spots = spark.read.csv(positions, schema=schema).filter("in_tissue = 1")
    if not layers:
        return spots.withColumn("layer", F.lit(None).cast("string"))
    named = spark.read.text(layers).select(F.trim("value").alias("barcode"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(_barcodes)?\.[^./]+$", 1).alias("layer"))
    return spots.join(named.groupBy("barcode").agg(F.max("layer").alias("layer")), "barcode", "left")


def read_new_documents(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """source, chunk_no, chunk of text files whose names the manifest known(source) doesn't have."""
    from ..functions.strings import chunks

    docs = spark.read.text(path, wholetext=True).select(F.url_decode(F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\+", "%2B")).alias("source"), F.col("value").alias("text"))
    if known is not None:
        docs = docs.join(known.select("source"), "source", "left_anti")
    return docs.select("source", F.explode(chunks("text")).alias("c")).select("source", "c.chunk_no", "c.chunk")


#: Schema of a call trace.
TRACE = T.StructType().add("timestamp", "timestamp").add("event", "string").add("model", "string").add("provider", "string").add("prompt_tokens", "long").add("completion_tokens", "long").add("latency_ms", "long").add("caller", "string").add("is_retry", "boolean").add("attempt", "integer").add("cost_usd", "double").add("error", "string")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines trace; lines that don't parse are left out."""
    schema = T.StructType(TRACE.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = spark.read.text(path).select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.filter("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")
