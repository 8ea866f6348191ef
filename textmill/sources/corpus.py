"""Corpus tables: rows with a root-relative path and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Directory names that a walk never enters. Fixed values.
DENIED = [".git", "node_modules", "target", ".venv", "venv", "dist", "build", "__pycache__"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_path_parts(df: DataFrame) -> DataFrame:
    """Adds name (last component), ext (after its last dot, else empty) and depth (components) of path."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"name": name, "ext": F.regexp_extract(name, r"\.([^.]+)$", 1), "depth": F.size(F.split("path", "/"))})


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path is source/lang/doc_id.txt."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("path", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: path is the url without scheme, query and fragment."""
    return table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://([^?#]*)", 1)).withColumnRenamed("html", "text")


def binary_corpus(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below root: path (relative), content, length, modificationTime. Hidden files are read, links aren't followed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    return reader.load(root).withColumn("path", F.expr(f"substring(path, instr(path, '{base}') + {len(base)})"))


def without_denied(df: DataFrame, denied: list[str] | None = None) -> DataFrame:
    """Rows whose path has no denied directory; the last component is a file and may have any name."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return df.where(~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in denied or DENIED])))


def entries(df: DataFrame) -> DataFrame:
    """Files and all directories above them: path, is_dir, depth; the root isn't listed."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = df.where(F.size(parts) > 1).select(F.explode(up).alias("path")).distinct().select("path", F.lit(True).alias("is_dir"))
    files = df.select("path").distinct().select("path", F.lit(False).alias("is_dir"))
    return files.union(dirs).withColumn("depth", F.size(F.split("path", "/")))


#: One record of the diagnostics log.
LOG_RECORD = T.StructType(
    [T.StructField("schema_version", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("ts", "level", "event", "instance_id")], T.StructField("pid", T.LongType()), T.StructField("version", T.StringType()), T.StructField("dropped_since_last", T.LongType()), T.StructField("context", T.BooleanType())]
)


def json_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records with the file they are from; lines that aren't records are left out."""
    df = spark.read.schema(LOG_RECORD.add("_bad", T.StringType())).option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.withColumn("file", F.input_file_name()).where("_bad IS NULL").drop("_bad")


def log_files(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Log files by name <prefix>-YYYY-MM-DD.NNNN.jsonl: path, dt, bytes. Other names are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    dt = F.try_to_date(F.regexp_extract(name, rf"^{prefix}-(\d{{4}}-\d{{2}}-\d{{2}})\.\d{{4}}\.jsonl$", 1), "yyyy-MM-dd")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", dt.alias("dt"), F.col("length").alias("bytes")).where("dt IS NOT NULL")


def synthetic_code(spark: SparkSession, n: int, sparse: str, dense: str, seed: int = 42) -> DataFrame:
    """n generated files: file_index, path, text, has_sparse, has_dense. Every max(1, n/10)th file has a sparse line, 20 evenly spaced ones four dense lines, every 250th a line of 16,384 characters."""
    f = spark.range(n).withColumnRenamed("id", "file_index")
    i, step = F.col("file_index"), max(1, n // 10)
    depth = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(4)).cast("int") + 1
    dirs = F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(F.lit("mod_"), F.pmod(F.xxhash64(F.lit(seed), i, k), F.lit(26)).cast("string")))
    f = f.withColumns({"path": F.concat(F.array_join(dirs, "/"), F.lit("/file_"), F.lpad(i.cast("string"), 6, "0"), F.lit(".rs")), "has_sparse": i % step == 0, "has_dense": (i % max(1, n // 20) == 0) & (i < 20 * max(1, n // 20))})
    lines = F.transform(F.sequence(F.lit(1), F.pmod(F.xxhash64(F.lit(seed + 1), i), F.lit(131)).cast("int") + 20), lambda k: F.concat(F.lit("let v"), k.cast("string"), F.lit(" = "), F.pmod(F.xxhash64(i, k), F.lit(1000)).cast("string"), F.lit(";")))
    extra = F.concat(
        F.array(F.concat(F.lit("// file "), i.cast("string")), F.lit("use std::fmt;")),
        F.when(F.col("has_sparse"), F.array(F.lit(f"// {sparse}"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("has_dense"), F.array_repeat(F.lit(f"// {dense}"), 4)).otherwise(F.array().cast("array<string>")),
        F.when(i % 250 == 249, F.array(F.repeat(F.lit("x"), F.lit(16384)))).otherwise(F.array().cast("array<string>")),
    )
    return f.withColumn("text", F.concat(F.array_join(F.concat(extra, lines), "\n"), F.lit("\n")))


def single_file(corpus: DataFrame, path: str) -> DataFrame:
    """The file of that path; no row if there is none."""
    return corpus.where(F.col("path") == path)


def scenarios(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of scenarios as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def register_lines(spark: SparkSession) -> None:
    """The table function text_lines(text) -> (line_no, line) for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="line_no bigint, line string", useArrow=True)
    class TextLines:
        def eval(self, text: str):
            if text:
                rows = text.split("\n")
                for k, x in enumerate(rows[:-1] if rows[-1] == "" else rows, 1):
                    yield k, x.removesuffix("\r")

    spark.udtf.register("text_lines", TextLines)
