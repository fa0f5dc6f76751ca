"""Text search by written indexes: postings of stems with places, and trigrams for substrings.

An index is a folder of Parquet tables in hash buckets of the term, each sorted by term, so a search reads the buckets of its
terms alone, and of their files the row groups that hold them. A text is inverted in its task; frequent words are stemmed once a worker.
A frequent term's postings lie in several files of its bucket. Searches intersect postings by id; a phrase is decided by places, a
substring by the text of the ids that have all its trigrams.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.stemming import lexeme

from .textsearch import parsed

BUCKETS, FILES = 64, 4
FILE_TEXTS = 1_000_000  # a bucket has a file more for every so many texts
TASK_TEXTS = 100_000  # inverted in one task, where there are more than FILES files: their postings are sorted by partition there
CACHE_WORDS = 200_000  # whose terms a Python worker keeps
FLUSH_POSTINGS = 200_000
GRAM = 3


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _spread(rows: DataFrame, texts: int) -> DataFrame:
    return rows if texts <= FILES * FILE_TEXTS else rows.repartition(-(-texts // TASK_TEXTS))


def _write(rows: DataFrame, path: str, term: str, texts: int) -> None:
    """rows (term, id, ...) in buckets of the term, sorted, FILES files each or one for every FILE_TEXTS texts.

    A term has a posting a text at most, so a file's postings of a term don't grow with the table. Where there are more than
    FILES, so many partitions are asked for that one gets about two files.
    """
    files = max(FILES, -(-texts // FILE_TEXTS))
    by = ["bucket", F.pmod(F.xxhash64("id"), F.lit(files))]
    rows = rows.withColumn("bucket", _bucket(F.col(term)))
    placed = rows.repartition(*by) if files == FILES else rows.repartition(files * BUCKETS // 2, *by)
    placed.sortWithinPartitions("bucket", term, "id").write.partitionBy("bucket").parquet(path)


def _of(table: DataFrame, term: str, wanted: list[str]) -> DataFrame:
    """The rows of some terms: their buckets are read, and the terms are pushed into the scan."""
    spark = table.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "t string").select(_bucket(F.col("t"))).distinct().collect()]
    return table.filter(F.col("bucket").isin(buckets) & F.col(term).isin(wanted))


# Words --------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=CACHE_WORDS)
def _term(word: str) -> str:
    return lexeme(word)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, places of every text's words (id, words), text by text; collecting lists in an aggregate costs far more."""
    for batch in batches:
        terms, rows, places = [], [], []

        def out(batch: pa.RecordBatch, terms: list, rows: list, places: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["term", "id", "places"])

        for row in range(len(batch)):
            found: dict[str, list[int]] = defaultdict(list)
            for place, word in enumerate(batch.column(1)[row].as_py() or ()):
                if term := _term(word):
                    found[term].append(place)
            terms += found
            rows += [row] * len(found)
            places += found.values()
            if len(terms) > FLUSH_POSTINGS:
                yield out(batch, terms, rows, places)
                terms, rows, places = [], [], []
        yield out(batch, terms, rows, places)


def write_postings(rows: DataFrame, path: str) -> None:
    """Index rows (id, text): tables of postings (term, id, places) and of all ids. A null text has no words.

    Places number all words of a text, stop words too; stop words have no postings. Ids are unique.
    """
    kind, texts = dict(rows.dtypes)["id"], rows.count()
    words = _spread(rows, texts).select("id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    postings = words.mapInArrow(_inverted, f"term string, id {kind}, places array<int>")
    _write(postings, f"{path}/postings", "term", texts)
    rows.select("id").write.parquet(f"{path}/ids")


def search_postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """id of every text that meets the query: the rows that textsearch.matches finds, from the postings of its terms alone."""
    postings, out = spark.read.parquet(f"{path}/postings"), []
    for group in parsed(query):
        tests = [(minus, {k: w for k, w in enumerate(words) if w}) for minus, words in group]
        terms = sorted({w for _, wanted in tests for w in wanted.values()})
        found = _of(postings, "term", terms).groupBy("id").agg(*[F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"t{k}") for k, t in enumerate(terms)])
        at = {t: F.col(f"t{k}") for k, t in enumerate(terms)}
        holds = lambda wanted, at=at: F.coalesce(_stand(wanted, at), F.lit(False))
        if all(minus for minus, _ in tests):  # the ids that have none of it: those without any of its postings, and those whose postings don't meet it
            met = reduce(lambda a, b: a | b, [holds(w) for _, w in tests])
            out.append(spark.read.parquet(f"{path}/ids").select("id").join(found.filter(met).select("id"), "id", "left_anti"))
            continue
        out.append(found.filter(reduce(lambda a, b: a & b, [~holds(w) if minus else holds(w) for minus, w in tests])).select("id"))
    if not out:
        return spark.read.parquet(f"{path}/ids").select("id").limit(0)
    return out[0] if len(out) == 1 else reduce(DataFrame.union, out).distinct()


def _stand(wanted: dict[int, str], at: dict[str, Column]) -> Column:
    """Whether the terms stand at these distances from each other."""
    (first, term), *rest = sorted(wanted.items())
    if not rest:
        return at[term].isNotNull()
    near = lambda p: reduce(lambda a, b: a & b, [F.array_contains(at[w], p + (k - first)) for k, w in rest])
    return reduce(lambda a, b: a & b, [at[w].isNotNull() for w in wanted.values()]) & F.exists(at[term], near)


# Substrings ---------------------------------------------------------------------------------------------------------------


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.char_length(low) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1)), lambda k: F.substring(low, k, GRAM))))


def write_trigrams(rows: DataFrame, path: str) -> None:
    """Index rows (id, text): tables of trigrams (gram, id) of the lower-cased texts, and of the texts by id. Ids are unique."""
    texts = rows.count()
    _write(_spread(rows, texts).select(F.explode(_grams(F.col("text"))).alias("gram"), "id"), f"{path}/grams", "gram", texts)
    placed = rows.select("id", "text").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("id").write.partitionBy("bucket").parquet(f"{path}/texts")


def search_trigrams(spark: SparkSession, path: str, part: str) -> DataFrame:
    """id, text of every text that is ILIKE %part%; % and _ in it are wildcards, as there.

    The ids that have all trigrams of the part's literal pieces are verified by their texts. A part without a piece of
    three characters is looked for in all texts.
    """
    texts, like = spark.read.parquet(f"{path}/texts").drop("bucket"), f"%{part}%"
    pieces = re.split(r"[%_]|\\.", part.lower())
    grams = sorted({p[k : k + GRAM] for p in pieces for k in range(len(p) - GRAM + 1)})
    if not grams:
        return texts.filter(F.col("text").ilike(like))
    found = _of(spark.read.parquet(f"{path}/grams"), "gram", grams).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return texts.join(found.select("id"), "id", "left_semi").filter(F.col("text").ilike(like))
