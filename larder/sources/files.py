"""File and database sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.functions import text
from larder.sources import schemas

CSV_ROWS_PER_TASK = 10_000
CSV_ROWS_PER_FILE = 1_000_000
BAD_RECORD = "_record"
RECIPE_CSV_OPTIONS = {
    "header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD, "columnPruning": False,
    "pathGlobFilter": "*.csv", "recursiveFileLookup": True,
}
LEDGER = "path string, modified timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_recipe_json(spark: SparkSession, path: str, page: str | None = None) -> DataFrame:
    """Result pages; `page` names a column for the path of each page's file."""
    rows = spark.read.schema(schemas.RECIPE_PAGE).option("multiLine", True).json(path)
    return rows if page is None else rows.withColumn(page, F.col("_metadata.file_path"))


def read_recipe_csvs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All recipe CSV files below `path`: the key is the file name (or the folder's, `recipe_name=<key>`), columns go by position.

    Rows that do not parse are skipped and the load goes on; `recipe_csv_rejects` has them. All columns are parsed, so that
    a bad row is bad whichever columns a query needs.
    """
    return _recipe_csvs(spark, path).filter(F.col("line").isNull()).select("recipe_name", "attribute", "value")


def recipe_csv_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows that `read_recipe_csvs` skips: recipe, file and the line as it stands there."""
    return _recipe_csvs(spark, path).filter(F.col("line").isNotNull()).select("recipe_name", "file", "line")


def _recipe_csvs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    folder = F.regexp_extract("_metadata.file_path", r"recipe_name=([^/]+)/[^/]+$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_replace("_metadata.file_name", r"\.csv$", ""))
    # Spark wants a parsed column read as well, whatever a query asks for.
    line = F.when(F.col(BAD_RECORD).isNotNull(), F.coalesce(F.col(BAD_RECORD), F.col("attribute")))
    return (
        spark.read.schema(f"{schemas.RECIPE_CSV}, {BAD_RECORD} string").options(**RECIPE_CSV_OPTIONS).csv(path)
        .select(name.alias("recipe_name"), "attribute", "value", F.col("_metadata.file_path").alias("file"), line.alias("line"))
    )


def new_files(spark: SparkSession, path: str, ledger: str, extension: str = ".csv") -> DataFrame:
    """(path, modified) of the files below `path` that the ledger does not hold in their present state."""
    found = list_files(spark, path, extension).select("path", F.col("modificationTime").alias("modified"))
    if not exists(spark, ledger):
        return found
    return found.join(spark.read.schema(LEDGER).parquet(ledger), ["path", "modified"], "left_anti")


def load_new_csvs(spark: SparkSession, path: str, ledger: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, files) of the recipe CSV files that were not loaded before, or were changed since.

    Pass `files` to `mark_loaded` once the rows are stored; until then the same files are loaded again. The names of the new
    files come to the driver, as those of any files do that are read.
    """
    fresh = new_files(spark, path, ledger).collect()
    files = spark.createDataFrame([tuple(r) for r in fresh], LEDGER)
    if not fresh:
        rows = spark.createDataFrame([], schemas.RAW_RECIPES)
        return rows, spark.createDataFrame([], "recipe_name string, file string, line string"), files
    paths = [r.path for r in fresh]
    return read_recipe_csvs(spark, paths), recipe_csv_rejects(spark, paths), files


def mark_loaded(files: DataFrame, ledger: str) -> None:
    files.write.mode("append").parquet(ledger)


def write_recipe_csvs(rows: DataFrame, path: str) -> None:
    """One directory of CSV per recipe; a recipe written again replaces its own directory.

    Rows of a recipe go to one task and one file up to a fixed number of positions; a
    larger recipe continues in further tasks.
    """
    part = F.floor(F.col("position") / CSV_ROWS_PER_TASK)
    (
        rows.repartition("recipe_name", part)
        .sortWithinPartitions("recipe_name", "position")
        .select(
            "recipe_name", F.col("attribute").alias("Nutrient"),
            F.col("value").alias("Amount per Serving"), F.col("unit").alias("Unit"),
        )
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("recipe_name").option("header", True).csv(path)
    )


def read_recipe_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Read back what `write_recipe_csvs` wrote; the key is the directory."""
    return (
        spark.read.schema("Nutrient string, `Amount per Serving` string, Unit string, recipe_name string")
        .option("header", True).csv(path)
        .select(
            "recipe_name", F.col("Nutrient").alias("attribute"), F.col("Amount per Serving").alias("value"),
        )
    )


def write_packed_csvs(rows: DataFrame, path: str, rows_per_file: int = CSV_ROWS_PER_FILE) -> None:
    """Recipes in files of about `rows_per_file` rows, in order of their names, with an index of the files of each recipe.

    For very many recipes this replaces a directory each; `read_packed_recipes` opens only the files it needs. The index is
    in order of the names as well, in as many files as its size asks for.
    """
    parts = max(1, -(-rows.count() // rows_per_file))
    (
        rows.repartitionByRange(parts, "recipe_name", "position").sortWithinPartitions("recipe_name", "position")
        .select("recipe_name", F.col("attribute").alias("Nutrient"), F.col("value").alias("Amount per Serving"), F.col("unit").alias("Unit"))
        .write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/rows")
    )
    packed = _packed(rows.sparkSession, f"{path}/rows")
    index = packed.select("recipe_name", "_file").distinct().repartitionByRange("recipe_name", "_file")
    index.sortWithinPartitions("recipe_name").write.mode("overwrite").parquet(f"{path}/index")


def _packed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return (
        spark.read.schema("recipe_name string, Nutrient string, `Amount per Serving` string, Unit string")
        .option("header", True).option("escape", '"').csv(path)
        .select("recipe_name", F.col("Nutrient").alias("attribute"), F.col("Amount per Serving").alias("value"), F.col("Unit").alias("unit"),
                F.col("_metadata.file_path").alias("_file"))
    )


def read_packed_recipes(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Rows that `write_packed_csvs` wrote, of all or of some recipes; of some, only the files that hold them are opened."""
    if names is None:
        return _packed(spark, f"{path}/rows").drop("_file")
    index = spark.read.schema("recipe_name string, _file string").parquet(f"{path}/index")
    files = [r._file for r in index.filter(F.col("recipe_name").isin(names)).select("_file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "recipe_name string, attribute string, value string, unit string")
    return _packed(spark, files).filter(F.col("recipe_name").isin(names)).drop("_file")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """Relational table read in `parts` key ranges; filters and columns are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high,
                 numPartitions=parts, fetchsize=10_000, **options)
        .load()
    )


def append_rows(rows: DataFrame, path: str, *partition: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Table whose rows are laid out by a key.

    Members and logs bucketed alike by user name are aggregated and joined without a shuffle.
    """
    writer = rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def read_documents(spark: SparkSession, path: str, extension: str = ".md") -> DataFrame:
    """Text files as whole documents; empty ones are skipped.

    A file `<condition>/<name>.md` names its document; where a writer gives the files' names, folders do, as in
    `condition=<condition>/file_name=<name>/<any>.txt`.
    """
    file = F.col("_metadata.file_path")
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{extension}", recursiveFileLookup=True)
    folder = F.regexp_extract(file, r"condition=([^/]+)/file_name=([^/]+)/[^/]+$", 2)
    return rows.select(
        F.when(folder != "", F.regexp_extract(file, r"condition=([^/]+)/", 1)).otherwise(
            F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)).alias("condition"),
        F.when(folder != "", folder).otherwise(F.regexp_replace("_metadata.file_name", r"\.[^.]+$", "")).alias("file_name"),
        F.col("value").alias("text"),
    ).filter(F.col("text") != "")


def write_documents(rows: DataFrame, path: str, position: str) -> None:
    """Documents (condition, file_name, text), whose rows follow one another by `position`, as one text file each."""
    (
        rows.repartition("condition", "file_name").sortWithinPartitions("condition", "file_name", position)
        .select("condition", "file_name", "text").write.partitionBy("condition", "file_name").text(path)
    )


def list_files(spark: SparkSession, path: str, extension: str = ".pdf") -> DataFrame:
    """Files of one extension in any case; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", "modificationTime")
        .filter(F.lower("path").endswith(extension))
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Processed keys, one per line; a ledger that does not exist is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "slug string")
    return spark.read.text(path).select(text.strip(F.col("value")).alias("slug")).filter("slug != ''").distinct()


def append_ledger(keys: DataFrame, path: str) -> None:
    keys.select("slug").write.mode("append").text(path)


def write_sorted_ledger(keys: DataFrame, path: str) -> None:
    keys.select("slug").distinct().orderBy("slug").write.mode("overwrite").text(path)
