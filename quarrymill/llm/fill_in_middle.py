"""Fill-in-middle rearrangement of whole texts by one regular expression a row.

A text's n units are counted by regexp_count. Two cut numbers a <= b then give a pattern of the row's own: the unit {a}
times, the unit {b - a} times, and the rest. Both counts are possessive, so the matcher walks the text once without going
back and without a stack that grows with n, and one replacement with the three groups in the form's order writes the
output. The way back needs the output and the form alone: a text that holds a marker is left plain, so every marker of a
rearranged output stands there once and the output falls into its parts at the markers.

Everything is a column expression: no shuffle, no Python, and no more memory than a row's text and its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SPACE = r"[\x20\x09-\x0D]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80  # the share of rearranged texts and, of these, of the order suffix first, in percent


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of the seed and the id (null: as an empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def cut_pattern(a: Column, b: Column) -> Column:
    """The pattern that captures the first a units, those up to b, and the rest of a text."""
    group = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"(?s)\A"), group(a), group(b - a), F.lit(r"(.*+)\z"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (code points, null for plain), output of every row of docs.

    A null text is an empty one; an empty text (n = 0) and one that holds a marker are plain. A text of spaces alone is
    one unit. Rows with equal ids have equal draws; rows with a null id share those of the empty id. An empty table gives
    no rows. Columns other than the two named ones are ignored, so clashing names do no harm.
    """
    if not (0 <= rate <= 100 and 0 <= spm_rate <= 100):
        raise ValueError("rates are percentages")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.select("doc_id", "text", F.call_function("regexp_count", "text", F.lit(UNIT)).cast("long").alias("n"), F.array(*draws(F.col("doc_id"), seed)).alias("h"))
    h = lambda k: F.get("h", F.lit(k))
    cuts = [F.pmod(h(k), F.col("n") + 1) for k in (0, 1)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h(2) % 100 >= rate), "plain").when(h(3) % 100 < spm_rate, "spm").otherwise("psm")
    drawn = counted.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    moved = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b")), order))
    done = drawn.select("doc_id", "n", "form", moved.alias("output")).withColumn("parts", F.when(F.col("form") != "plain", F.split("output", "<[PSM]>", -1)))
    chars = lambda psm, spm: F.char_length(F.when(F.col("form") == "psm", F.get("parts", F.lit(psm))).otherwise(F.get("parts", F.lit(spm)))).cast("long")
    return done.select("doc_id", "n", "form", chars(1, 2).alias("prefix_chars"), chars(3, 3).alias("middle_chars"), "output")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    done = fill_in_middle(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
