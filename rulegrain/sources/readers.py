"""Readers: declared schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain import schemas


_CORRUPT = "_corrupt_record"


def _text_keys(kind: T.DataType) -> T.DataType:
    """JSON objects have text keys, so maps are read with them and cast afterwards."""
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _text_keys(kind.valueType))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_text_keys(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text_keys(f.dataType)) for f in kind.fields])
    return kind


def read_records(spark: SparkSession, path: str, schema: T.StructType,
                 lines: bool = False) -> DataFrame:
    """Records from JSON: whole-array files, or one record per line (splittable).

    Lines that are no JSON give rows of nulls."""
    raw = (spark.read.schema(_text_keys(schema)).option("multiLine", not lines)
           .option("mode", "PERMISSIVE").json(path))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def parsed_records(texts: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """One JSON record a row -> its fields and `corrupt`, the text of a row that is none; blank rows go."""
    kind = T.StructType([*_text_keys(schema).fields, T.StructField(_CORRUPT, T.StringType())])
    made = (texts.filter(F.trim(F.translate(text, "\r\n\t", "   ")) != "")
            .select(F.from_json(text, kind, {"columnNameOfCorruptRecord": _CORRUPT}).alias("r")))
    return made.select(*[F.col("r")[f.name].cast(f.dataType).alias(f.name) for f in schema.fields],
                       F.col("r")[_CORRUPT].alias("corrupt"))


def read_checked(spark: SparkSession, path: str, schema: T.StructType,
                 indent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, broken): the records of a JSON file, and the texts (`corrupt`) that are no record.

    One record per line or, with `indent`, an array whose records stand `indent` blanks deep, as indenting writers
    leave it.  Such a file is cut where a record closes, which no text inside it can imitate, so both forms are split
    over tasks before they are parsed."""
    if indent is None:
        texts = spark.read.text(path)
    else:
        close = "\n" + " " * indent + "}"
        pieces = spark.read.option("lineSep", close + ",").text(path)
        body = F.regexp_replace("value", r"\A\s*\[(?=\s*(\{|\]|\z))", "")
        last = F.col("value").rlike(r"\n\]\s*\z") | F.trim("value").isin("[]", "")
        texts = pieces.select(F.when(last, F.regexp_replace(body, r"\]\s*\z", "")).otherwise(
            F.concat(body, F.lit(close))).alias("value"))
    parsed = parsed_records(texts, schema)
    return parsed.filter("corrupt IS NULL").drop("corrupt"), parsed.filter("corrupt IS NOT NULL").select("corrupt")


def read_roster_csv(spark: SparkSession, path: str,
                    schema: T.StructType = schemas.ROSTER_CSV) -> DataFrame:
    """A header CSV by column name; a byte-order mark before the first name is ignored."""
    raw = spark.read.option("header", True).option("inferSchema", False) \
        .option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("\ufeff"): c for c in raw.columns}
    return raw.select(*[F.col(f"`{names[f.name]}`").alias(f.name) if f.name in names
                        else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in schema.fields])


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_available(spark: SparkSession, paths: list[str]) -> str:
    """The first path of a priority list that exists."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError("none of the datasets exists: " + ", ".join(paths))


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog files named by language, `{section: {key: text}}` -> (lang, section, key, template)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([A-Za-z-]+)\.json$", 1).alias("lang"),
        F.from_json("value", "map<string,map<string,string>>").alias("sections"))
    sections = raw.select("lang", F.explode("sections").alias("section", "texts"))
    return sections.select("lang", "section", F.explode("texts").alias("key", "template"))
