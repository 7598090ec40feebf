"""Writers: partitions, reports, traces, keyed caches, LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import LATEX, MARK


def write_labels(partition: DataFrame, path: str, truth: DataFrame | None = None) -> None:
    """CSV sample_index, cluster_label[, true_label], sorted by id across files."""
    out = partition.select(F.col("id").alias("sample_index"), F.col("label").alias("cluster_label"))
    if truth is not None:
        out = out.join(truth.select(F.col("id").alias("sample_index"), F.col("y").alias("true_label")), "sample_index", "left")
    out.orderBy("sample_index").write.mode("overwrite").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines in which numbers that aren't finite are null."""
    clean = [F.expr(f"if(isnan(`{c}`) or abs(`{c}`) = double('inf'), null, `{c}`)").alias(c) if k in ("double", "float") else F.col(c) for c, k in report.dtypes]
    report.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_embedding(vectors: DataFrame, path: str) -> None:
    vectors.select("id", "f").write.mode("overwrite").parquet(path)


def write_text_file(lines: DataFrame, path: str, order: str) -> None:
    """The column `line` in order, as one text file of that name: for small files with a header of their own."""
    spark, folder = lines.sparkSession, f"{path}.parts"
    lines.orderBy(order).select("line").coalesce(1).write.text(folder)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(Path(folder)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(Path(path).getParent())
    fs.rename(part, Path(path))
    fs.delete(Path(folder), True)


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, updated: str, most: int) -> DataFrame:
    """The newest row of each key of both tables, and of these the `most` newest (ties to the larger key)."""
    both = old.unionByName(new, allowMissingColumns=True)
    best = both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(updated)))).filter("__n = 1").drop("__n")
    return best.orderBy(F.desc(updated), F.desc(key)).limit(most)


def _escape(text: str) -> str:
    text = text.replace("\\", MARK)
    for a, b in LATEX:
        text = text.replace(a, b)
    return text.replace(MARK, r"\textbackslash{}")


def latex_report(ranking: DataFrame, title: str, top: int = 5) -> str:
    """A LaTeX document with a table of the best rows of ranking(rank, algorithm, ari, nmi)."""
    show = lambda v: "n/a" if v is None else f"{v:.3f}"
    rows = ranking.orderBy("rank").limit(top).collect()
    body = "\n".join(f"{r['rank']} & {_escape(r['algorithm'])} & {show(r['ari'])} & {show(r['nmi'])} \\\\" for r in rows)
    return f"\\documentclass{{article}}\n\\begin{{document}}\n\\section*{{{_escape(title)}}}\n\\begin{{tabular}}{{rlrr}}\nrank & algorithm & ARI & NMI \\\\\n{body}\n\\end{{tabular}}\n\\end{{document}}\n"


def strip_heavy(df: DataFrame, heavy: tuple[str, ...] = ("X", "y", "labels", "code", "f", "embedding")) -> DataFrame:
    """df without heavy fields, also inside structs."""
    from pyspark.sql import types as T

    def clean(c, kind):
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if f.name not in heavy]
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kept])) if kept else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in heavy])
