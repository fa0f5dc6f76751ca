"""Line deduplication by pairwise alignment.

Documents that share rare lines are found by line hashes, aligned pair by pair with patience diff, and the aligned
common blocks are deleted from the later document of each pair (later: larger doc_id, null last, then text hash).

A rare line has LEAST_WORDS words or more and stands in two texts or more, but in no more than MOST_SHARE of all
distinct texts. Each text is paired with the earliest holder of each of its rare lines first, so a line in m texts gives
m - 1 pairs; copies of a text are settled before that, without pairs. A rare line that this leaves in a text is tried
with the line's other earlier holders, a few at first and about 64 times as many each round, until it is aligned
with one or none is left. An alignment takes at least one line that both texts have, so only a line that crosses others in
every earlier holder is compared with them all. Of a line that stands
several times in a text, the search ends with the first place that is aligned; places that no alignment so far has
taken stay. A block is deleted only if it holds a line of LEAST_WORDS words or more; other lines go with it where they
stand in the same aligned block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_counted, documents, fresh_path

LEAST_WORDS = 5
MOST_SHARE = 0.5
LEAST_TEXTS = 100  # a line in no more texts than this is rare in any corpus


def _key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.isNull().cast("int").alias("n"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"))


def _longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first number, in which the second rises too."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], both rising: lines single on both sides first, then the gaps between.

    In a gap without such lines, the common lines that stand there the fewest times are paired, first with first, second
    with second, so texts that have a line in common are never left without an alignment.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, x, j, y = work.pop()
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out.append((x, y))
        if i == x or j == y:
            continue
        times_a, times_b = Counter(a[i:x]), Counter(b[j:y])
        rarity = {h: max(n, times_b[h]) for h, n in times_a.items() if h in times_b}
        if not rarity:
            continue
        fewest = min(rarity.values())
        places: dict[int, list[int]] = {}
        for k, h in enumerate(b[j:y], j):
            if rarity.get(h) == fewest:
                places.setdefault(h, []).append(k)
        seen: Counter = Counter()
        pairs = []
        for k, h in enumerate(a[i:x], i):
            if rarity.get(h) == fewest:
                if seen[h] < len(places[h]):
                    pairs.append((k, places[h][seen[h]]))
                seen[h] += 1
        anchors = _longest_run(pairs)
        for (i0, j0), (i1, j1) in zip([(i - 1, j - 1), *anchors], [*anchors, (x, y)], strict=True):
            if anchors:
                work.append((i0 + 1, i1, j0 + 1, j1))
        out += anchors
    return sorted(out)


def common_blocks(a: list[int], b: list[int], long_b: list[bool]) -> list[tuple[int, int]]:
    """Stretches (from, to) of b that are aligned blocks of a and hold a long line."""
    blocks: list[list[int]] = []
    last = (-2, -2)
    for i, j in patience(a, b):
        if (i - 1, j - 1) == last:
            blocks[-1][1] = j
        else:
            blocks.append([j, j])
        last = (i, j)
    return [(s, e) for s, e in blocks if any(long_b[s : e + 1])]


def _align(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[{"s": s, "e": e} for s, e in common_blocks(a.tolist(), b.tolist(), long.tolist())] for a, b, long in zip(pdf["lines_a"], pdf["lines_b"], pdf["long_b"], strict=True)]
            gone = [sorted({h for x in blocks for h in b[x["s"] : x["e"] + 1].tolist()}) for blocks, b in zip(found, pdf["lines_b"], strict=True)]
            yield pd.DataFrame({"doc": pdf["doc"], "blocks": found, "gone": gone})

    return pairs.select("doc", "lines_a", "lines_b", "long_b").mapInPandas(run, "doc struct<n: int, i: long, h: long>, blocks array<struct<s: int, e: int>>, gone array<long>").filter(F.size("blocks") > 0)


def shared_blocks(docs: DataFrame, least_words: int = LEAST_WORDS, most_share: float = MOST_SHARE) -> DataFrame:
    """doc, blocks: of every later document the stretches of line numbers (from 0) to delete. docs: doc_id, text (not null)."""
    spark = docs.sparkSession
    lines = F.split("text", "\n", -1)
    path = fresh_path(spark, "lines")
    docs.select(
        _key(F.col("doc_id"), F.col("text")).alias("doc"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")) >= least_words).alias("long"),
    ).filter(F.exists("long", lambda x: x)).write.parquet(path)
    held = spark.read.parquet(path)
    firsts = cut(held.groupBy(F.col("doc.h").alias("text_hash")).agg(F.min("doc").alias("first")))  # cut, so that joins with it can split a hot text or line
    copies = held.select("doc", F.size("lines").alias("n")).join(firsts, F.col("doc.h") == F.col("text_hash")).filter("doc != first")
    whole = copies.groupBy("doc").agg(F.max("n").alias("n")).select("doc", F.array(F.struct(F.lit(0).alias("s"), (F.col("n") - 1).alias("e"))).alias("blocks"))
    texts = cut(held.join(firsts, (F.col("doc.h") == F.col("text_hash")) & (F.col("doc") == F.col("first")), "left_semi").dropDuplicates(["doc"]))
    n_texts = texts.count()
    marked = texts.select("doc", F.explode(F.array_distinct(F.filter(F.transform(F.arrays_zip("lines", "long"), lambda x: F.when(x["long"], x["lines"])), lambda x: x.isNotNull()))).alias("line"))
    rare = cut(marked.groupBy("line").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= max(LEAST_TEXTS, most_share * n_texts))).drop("n"))
    shared = cut(marked.join(rare, "line").filter("doc != first"))  # every holder but the first

    def align(pairs: DataFrame) -> DataFrame:
        sides = pairs.distinct().join(texts.select(F.col("doc").alias("first"), F.col("lines").alias("lines_a")), "first")
        return cut(_align(sides.join(texts.select("doc", F.col("lines").alias("lines_b"), F.col("long").alias("long_b")), "doc")))

    def without(still: DataFrame, done: DataFrame) -> tuple[DataFrame, int]:
        return cut_counted(still.join(done.select("doc", F.explode("gone").alias("line")), ["doc", "line"], "left_anti"), F.lit(True))

    rounds = [align(shared.select("first", "doc"))]
    still, n_still = without(shared.select("doc", "line"), rounds[0])
    chance = (F.pmod(F.xxhash64("line", "doc"), F.lit(1 << 40)) + 1) / (1 << 40)
    others = shared.join(cut(still.select("line").distinct()), "line", "left_semi").select(F.col("doc").alias("first"), "line", F.floor(-F.log2(chance) / 6).cast("int").alias("level"))
    others = cut(others)  # about one in 64 of a line's holders is of the next level
    for level in sorted((r["level"] for r in others.select("level").distinct().collect()), reverse=True):
        if not n_still:
            break
        rounds.append(align(still.join(others.filter(F.col("level") == level), "line").filter("first < doc").select("first", "doc")))
        still, n_still = without(still, rounds[-1])
    found = reduce(DataFrame.union, rounds).groupBy("doc").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    return found.union(whole)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, most_share: float = MOST_SHARE) -> DataFrame:
    """All rows and columns of docs, text without the deleted lines, with n_lines and n_deleted (replaced if there).

    A null text stays null (no lines); a text that is deleted as a whole becomes empty. Rows equal in doc_id and text
    are one document and get equal results. Lines are what "\\n" separates; lines that stay keep their order.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    blocks = shared_blocks(docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL"), least_words, most_share)
    row = F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row")  # so that no column's name meets one of these
    keyed = docs.select(row, _key(docs["doc_id"], docs["text"].cast("string")).alias("key"))
    both = keyed.join(blocks.withColumnRenamed("doc", "at"), F.col("key") == F.col("at"), "left")
    text = F.col("row")["text"].cast("string")
    lines = F.split(text, "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.exists("blocks", lambda b: (b["s"] <= i) & (i <= b["e"])))
    done = both.select("row", text.alias("text"), F.size(lines).alias("lines"), F.when(F.col("blocks").isNotNull(), stay).alias("left"))
    new = F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("lines"))
    extra = [n.alias("n_lines"), F.when(F.col("left").isNull(), 0).otherwise(n - F.size("left")).alias("n_deleted")]
    return done.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept], *extra)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_deleted", F.crc32(F.coalesce("text", F.lit(""))).alias("kept_crc32"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("kept_bytes"))
