"""Reading and writing tables: declared schemas, optional inputs, JSON and CSV, partitioned output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tarn.functions.text import birth_date, full_name, localized, normalize_name
from tarn.operators.features import first_and_sums, with_position

SKATERS = "source_id string, team string, season int, source string, gp double, goals double, assists double, points double, shots double, pim double"
PERSONS = "canonical_id string, name string, birth_year int, position string, eligible string, first_id string, second_id string, third_id string, appearances int"
PARTICIPATION = "tournament string, year int, name string, name_normalized string, position string, birth_date string, birth_year int, club string"
#: Sources that are named but have no reader, and measures that are not computed: their tables are empty, with these schemas.
STUBS = {"shl": SKATERS, "nl": SKATERS, "goalie_features": "canonical_id string, season int, source string, gp double"}


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def stub(spark: SparkSession, name: str) -> DataFrame:
    return empty(spark, STUBS[name])


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_table(spark: SparkSession, path: str, schema: str | None = None, optional: bool = False) -> DataFrame:
    """A Parquet table. A missing one raises, or with optional gives an empty table of the declared schema, so that unions keep working."""
    if optional and not exists(spark, path):
        return empty(spark, schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def looks_like_csv(spark: SparkSession, path: str, least_bytes: int = 100) -> DataFrame:
    """Landed downloads with `valid`: large enough and not an HTML error page."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", ((F.col("length") >= least_bytes) & ~F.ltrim(F.substring(F.decode("content", "utf-8"), 1, 200)).startswith("<")).alias("valid"))


def season_summary(df: DataFrame, id_col: str, situation: str | None = None) -> DataFrame:
    """One row: rows, distinct ids, and the sorted situations."""
    extra = [F.array_join(F.sort_array(F.collect_set(situation)), ",").alias("situations")] if situation else []
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(id_col).alias("n_ids"), *extra)


def latest_partition(df: DataFrame, column: str = "season") -> DataFrame:
    """Rows of the highest partition; on a partitioned table only that one is read."""
    return df.where(F.col(column) == F.lit(df.agg(F.max(column)).first()[0]))


def flattened(df: DataFrame, prefix: str = "", schema: T.StructType | None = None) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(of, path, names):
        for f in of.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, [*path, f.name], [*names, f.name])
            else:
                ref = F.col(f"`{path[0]}`") if path else F.col(f"`{f.name}`")
                for part in [*path[1:], f.name] if path else []:
                    ref = ref.getField(part)
                yield ref.alias(".".join([*names, f.name]))

    return df.select(*walk(schema or df.schema, [], [prefix] if prefix else []))


def read_json(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None) -> DataFrame:
    """JSON documents, one a file; unreadable ones, and those without a required field, go."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = (reader.schema(schema) if schema else reader).json(path)
    if "_corrupt" in df.columns:
        df = df.where("_corrupt is null").drop("_corrupt")
    return df.na.drop(subset=required) if required else df


def json_field(column: str | Column, path: str, kind: str = "string") -> Column:
    """A value of a JSON text by path; null where it is missing or of another kind."""
    return F.get_json_object(column, path).try_cast(kind)


def landed_pages(df: DataFrame, key: str, page: str = "page", position: str = "position") -> DataFrame:
    """Rows of landed listing pages, each key once: where it came first."""
    at = F.struct(page, position)
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), at).alias("__row")).select(key, "__row.*")


def cache_key(url: Column, most: int = 100, kept: int = 80) -> Column:
    """A file name of a URL: as it is with signs replaced, or its start and a digest where it is long."""
    name = F.regexp_replace(url, r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, kept), F.lit("_"), F.substring(F.sha1(url.cast("binary")), 1, 10))).otherwise(name)


def person_meta(df: DataFrame, language: str = "cs") -> DataFrame:
    """Persons of nested landing records: id, name, name_normalized, birth_date, birth_year, birth_city, country, position."""
    name, born = full_name(localized("firstName", "default"), localized("lastName", "default")), birth_date("birthDate")
    return df.select(F.col("playerId").alias("id"), name.alias("name"), normalize_name(name).alias("name_normalized"), born["iso"].alias("birth_date"), born["year"].alias("birth_year"), localized("birthCity", language).alias("birth_city"), F.col("birthCountry").alias("country"), "position")


def listed_meta(df: DataFrame, positions: DataFrame, source: str = "liiga") -> DataFrame:
    """Persons of a scraped listing (source_id, name, team, role_code, date_of_birth) in person_meta's columns, with the team."""
    born = birth_date("date_of_birth")
    rows = with_position(df.withColumn("source", F.lit(source)), positions, "role_code")
    return rows.select(F.col("source_id").alias("id"), "name", normalize_name("name").alias("name_normalized"), born["iso"].alias("birth_date"), born["year"].alias("birth_year"), "position", "team")


def roster_meta(stats: DataFrame, positions: DataFrame, births: DataFrame | None = None, source: str = "extraliga") -> DataFrame:
    """Persons of a season's statistics (source_id, name, position, slug, team_id, gp, row): the first of each text in the source's order and all games, with
    the raw birth dates (source_id, birth_date) where there are any."""
    once = first_and_sums(stats.withColumnRenamed("position", "code"), ["source_id"], ["name", "code", "slug", "team_id"], ["gp"], "row")
    rows = with_position(once.withColumn("source", F.lit(source)), positions)
    born = birth_date("birth_date")
    dates = None if births is None else births.select("source_id", born["iso"].alias("birth_date"), born["year"].alias("birth_year"))
    rows = rows.withColumns({"birth_date": F.lit(None).cast("string"), "birth_year": F.lit(None).cast("int")}) if dates is None else rows.join(dates, "source_id", "left")
    return rows.select(F.col("source_id").alias("id"), "name", normalize_name("name").alias("name_normalized"), "birth_date", "birth_year", "position", "slug", "team_id", "gp")


def participation(squad: DataFrame, tournament: str, year: int) -> DataFrame:
    """A tournament's roster rows in PARTICIPATION's columns."""
    return squad.select(F.lit(tournament).alias("tournament"), F.lit(year).alias("year"), "name", "name_normalized", "position", "birth_date", "birth_year", "club")


def images_as_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, base64) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("base64"))


def split_goalies(df: DataFrame, role: str = "role_code", goalie: str = "MV") -> tuple[DataFrame, DataFrame]:
    """(skaters, goalies); a row without a role is a skater."""
    is_goalie = F.coalesce(F.col(role), F.lit("")) == goalie
    return df.where(~is_goalie), df.where(is_goalie)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """A one-column table of texts."""
    df.write.mode("overwrite").text(path)


def read_briefs(spark: SparkSession, path: str, first: list[str]) -> DataFrame:
    """(slug, text, bytes, place) of Markdown files: those named first in their order, then the others by name."""
    df = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("slug"), F.col("value").alias("text"))
    place = F.lit(len(first))
    for i, s in enumerate(first):
        place = F.when(F.col("slug") == s, i).otherwise(place)
    return df.withColumn("bytes", F.octet_length("text")).withColumn("place", place).orderBy("place", "slug")
