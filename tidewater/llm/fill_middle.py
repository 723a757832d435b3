r"""Fill-in-middle transformation by escaped marker injection.

A delimiter character is escaped in the text, so it occurs nowhere; a regular
expression then appends one after each unit (a line with its line feed, by
default); their number is that of the units; substring_index takes out the parts
that stand before, between and after the two ranks drawn; the parts are unescaped
and assembled around markers.  The draws are hashes of seed and id, so a document
gets the same form in every run and on any cluster.

Row-local, built of JVM functions: no shuffle, no Python, memory of a few copies
of one text.  A text is never cut: every unit is in one of the three parts.

Defined results: null text counts as the empty text; an empty text and one that
already holds a marker stay plain; a row without an id draws from the empty id;
rows that repeat an id draw alike; an empty table gives an empty result; extra
columns are not read; very long texts are transformed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, table

ESCAPE, DELIMITER = "\x1b", "\x1e"
LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle


def escape(text: Column) -> Column:
    """text without the delimiter: the escape character gets a 0 behind it, the delimiter becomes escape and 1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescape(text: Column) -> Column:
    """The inverse of escape(), for an escaped text without delimiters."""
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def inject(text: Column, unit: str) -> Column:
    """The escaped text with a delimiter after each unit; unit is matched in the escaped text, so it may not count characters."""
    return F.regexp_replace(escape(text), F.lit(unit), F.lit("$0" + DELIMITER))


def _ranked(marked: Column, count: Column) -> Column:
    """The first `count` units (the last -count ones and a delimiter, below 0), with delimiters between them."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count)


def _bare(part: Column) -> Column:
    return unescape(F.replace(part, F.lit(DELIMITER), F.lit("")))


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINES, markers: Sequence[str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    Of documents that can be transformed, `percent` in 100 are, and of these
    spm_percent in 100 have the suffix first.  unit is a Java regular expression for
    lines, words or the like, whose matches have to cover the text and aren't empty.
    """
    p, s, m = markers
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", digest.alias("h"), inject(F.col("text"), unit).alias("marked"))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    held = F.col("text") == ""
    for x in markers:
        held = held | F.contains("text", F.lit(x))
    form = F.when(held | (_draw(F.col("h"), 2) % 100 >= percent), "plain").when(_draw(F.col("h"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    a, b = (_draw(F.col("h"), k) % (F.col("n") + 1) for k in (0, 1))
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(a, b).cast("int").alias("first"), F.greatest(a, b).cast("int").alias("last"))
    head = rows.withColumn("head", _ranked(F.col("marked"), F.col("last")))
    split = F.col("form") != "plain"
    parts = head.select(
        "doc_id", "text", "n", "form",
        F.when(split, _bare(_ranked(F.col("head"), F.col("first")))).alias("prefix"),
        F.when(split, _bare(_ranked(F.col("head"), F.col("first") - F.col("last")))).alias("middle"),
        F.when(split, _bare(_ranked(F.col("marked"), (F.col("last") - F.col("n") - 1).cast("int")))).alias("suffix"),
    )
    before, after = F.concat(F.lit(p), F.col("prefix")), F.concat(F.lit(s), F.col("suffix"))
    end = F.concat(F.lit(m), F.col("middle"))
    output = F.when(F.col("form") == "psm", F.concat(before, after, end)).when(F.col("form") == "spm", F.concat(after, before, end)).otherwise(F.col("text"))
    return parts.select("*", output.alias("output"))


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that a transformed one was made of; no part holds a marker, so each stands once."""
    p, s, m = markers

    def between(after: str, until: str | None) -> Column:
        rest = F.call_function("substring_index", output, F.lit(after), F.lit(-1))
        return rest if until is None else F.call_function("substring_index", rest, F.lit(until), F.lit(1))

    middle = between(m, None)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us FROM d),
r AS (SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(us[1:least(a, b)], '') AS p, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(us[greatest(a, b) + 1:n], '') AS x FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || x END) AS restored_sha256
FROM f
"""
