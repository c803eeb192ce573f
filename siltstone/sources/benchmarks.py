"""Benchmark texts: from tables of records, or built-in signatures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.versions import Versions

# Characteristic phrases by benchmark, used where no table is given.
SIGNATURES = {
    "mmlu": [
        "the longest wavelength of light",
        "which of the following is not a characteristic",
        "a longest wavelength",
        "according to piaget",
        "the supreme court case",
        "which of the following statements about",
        "in the context of operant conditioning",
        "the primary function of",
        "which of the following best describes",
        "a search warrant is not required",
    ],
    "gsm8k": [
        "how many more apples",
        "janet's ducks lay 16 eggs per day",
        "a robe takes 2 bolts of blue fiber",
        "josh decides to try flipping a house",
        "every day, wendi feeds each of her chickens",
        "kylar went to the store to buy glasses",
        "toulouse has twice as many sheep as charleston",
        "carla is downloading a 200 GB file",
        "john drives for 3 hours at a speed of 60 mph",
        "elaine initially had 20 pokemon cards",
    ],
    "humaneval": [
        "def has_close_elements",
        "def separate_paren_groups",
        "def truncate_number",
        "def below_zero",
        "def mean_absolute_deviation",
        "def intersperse",
        "def parse_nested_parens",
        "def filter_by_substring",
        "def sum_product",
        "def rolling_max",
    ],
    "arc": [
        "which of these would help to prevent infections",
        "when a guitar string is plucked",
        "which of the following is a fossil fuel",
        "a student is studying the revolution of earth",
        "what tool is used to measure the volume of a liquid",
        "which property of air does a barometer measure",
        "which of the following is the best example of erosion",
        "a group of students is testing different materials",
    ],
    "hellaswag": [
        "a woman is outside with a bucket",
        "the man is sitting on a roof",
        "a lady walks to a drum set",
        "two women are sitting on a bed",
        "a man is standing in a kitchen",
    ],
}


def _joined(*parts: Column) -> Column:
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, " ")


def _joined_list(first: Column, rest: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(first), F.coalesce(rest, F.array().cast("array<string>"))), lambda p: p.isNotNull() & (p != "")), " ")


#: Record columns to text, by benchmark.
EXTRACTORS = {
    "mmlu": lambda: _joined_list(F.col("question"), F.col("choices")),
    "gsm8k": lambda: _joined(F.col("question")),
    "humaneval": lambda: _joined(F.col("prompt"), F.col("canonical_solution"), F.col("test")),
    "arc": lambda: _joined_list(F.col("question"), F.col("choices.text")),
    "hellaswag": lambda: _joined_list(F.col("ctx"), F.col("endings")),
}


def signatures(spark: SparkSession, names=tuple(SIGNATURES)) -> DataFrame:
    rows = [(name, i, text) for name in names for i, text in enumerate(SIGNATURES.get(name, []))]
    return spark.createDataFrame(rows, "benchmark string, item_index long, text string")


def items(records: DataFrame, name: str, order: str, limit: int = 200) -> DataFrame:
    """benchmark, item_index, text of the first ``limit`` records in ``order`` whose text
    isn't empty: a bounded sample of a benchmark, by its definition."""
    texts = records.select(F.col(order).alias("o"), EXTRACTORS[name]().alias("text")).where("text != ''").orderBy("o").limit(limit)
    return texts.select(F.lit(name).alias("benchmark"), (F.row_number().over(Window.orderBy("o")) - 1).cast("long").alias("item_index"), "text")


CACHE_FORMAT = 1


def read_records(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The records of ``folder``/name.parquet, or of name.jsonl or name.json with a record a
    line, with ``ord``, their order."""
    try:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException:
        try:
            rows = spark.read.json(f"{folder}/{name}.jsonl")
        except AnalysisException:
            rows = spark.read.json(f"{folder}/{name}.json")
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())


def cached_items(spark: SparkSession, cache: str, name: str, limit: int) -> DataFrame | None:
    """The items kept for a benchmark and limit; None if there are none of this format."""
    table = Versions(spark, f"{cache}/{name}")
    wanted = {"format": CACHE_FORMAT, "benchmark": name, "limit": limit}
    return table.read() if table.exists() and table.meta == wanted else None


def corpus(spark: SparkSession, folder: str | None, names=tuple(SIGNATURES), limit: int = 200, cache: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The items of all named benchmarks and where each came from: kept items under ``cache``,
    else records in ``folder`` (see :func:`read_records`), whose items are then kept, else
    the built-in signatures."""
    out, sources = signatures(spark, ()), {}
    for name in names:
        part = cached_items(spark, cache, name, limit) if folder and cache else None
        if part is not None:
            sources[name] = "cache"
        elif folder:
            try:
                part = items(read_records(spark, folder, name), name, "ord", limit)
                if cache:
                    Versions(spark, f"{cache}/{name}").replace(part, {"format": CACHE_FORMAT, "benchmark": name, "limit": limit})
                    part = cached_items(spark, cache, name, limit)
                sources[name] = "table"
            except Exception as e:  # a missing or unreadable table falls back, as the sources tell
                part, sources[name] = None, f"signatures ({type(e).__name__})"
        if part is None:
            part, sources[name] = signatures(spark, (name,)), sources.get(name, "signatures")
        out = out.unionByName(part)
    return out, sources


def provenance(items_: DataFrame, sources: dict[str, str]) -> DataFrame:
    """benchmark, source (table or signatures), samples, error (why a table wasn't read)."""
    rows = [(name, said.split(" ")[0], said[said.index("(") + 1 : -1] if "(" in said else None) for name, said in sources.items()]
    known = items_.sparkSession.createDataFrame(rows, "benchmark string, source string, error string")
    counts = items_.groupBy("benchmark").agg(F.count(F.lit(1)).alias("samples"))
    return known.join(counts, "benchmark", "left").select("benchmark", "source", F.coalesce("samples", F.lit(0)).alias("samples"), "error")


def cached_corpus(spark: SparkSession, folder: str | None, cache: str, names=tuple(SIGNATURES), limit: int = 200) -> DataFrame:
    """The corpus with its normalised texts and hashes, kept under ``cache`` for the same
    benchmarks, limit and texts; anything else makes another table."""
    from siltstone.functions.text import normalize_decon, text_hash

    items_, _ = corpus(spark, folder, names, limit)
    texts = items_.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("text"))), ""))).first()[0]  # at most limit items a benchmark
    path = f"{cache}/{'-'.join(names)}-{limit}-{texts}"
    items_.withColumn("norm", normalize_decon(F.col("text"))).withColumn("hash", text_hash(F.col("text"))).write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
