"""Fill-in-the-middle transformation by one regular expression with counted quantifiers for every text.

A text of n units is cut by a pattern made for it: ``(unit{a})(unit{b-a})(rest)`` with possessive quantifiers, which
consume exactly so many units without a way back. One replacement with that pattern writes the rearranged text.
Everything is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its line feed, or a last line without one.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(key: Column, k: int) -> Column:
    """The k-th 8-digit group of a hex digest as an unsigned integer."""
    return F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, rate: int = 100, spm_share: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    ``n`` counts the units of the text. Four draws from the digest of ``seed:doc_id`` give two cuts from 0 to n, whether
    the text is transformed (``rate`` in 100) and in which order: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix,
    prefix, middle) for ``spm_share`` in 100. Empty texts, and texts that hold one of the three marks, stay as they are
    (``plain``, lengths null). Null texts count as empty. A row with a null id draws as if its id were an empty text.
    Rows are taken one by one: a row that comes again comes out again, and an empty table gives no rows. Other columns
    are ignored, whatever their names. ``unit`` must match every text of one character or more from its start to its end.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(unit)).cast("long").alias("n"), key.alias("key"))
    one, two = (F.pmod(_draw(F.col("key"), k), F.col("n") + 1) for k in (0, 1))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.pmod(_draw(F.col("key"), 2), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(_draw(F.col("key"), 3), F.lit(100)) < spm_share, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))
    group = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"(.*)\z"))
    spm, psm = F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"), F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, F.when(F.col("form") == "spm", spm).otherwise(psm)))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    place = lambda mark: F.instr("output", F.lit(mark)).cast("long")
    # the marks stand once each in an output that is not plain
    prefix = F.when(F.col("form") == "psm", place(SUFFIX) - place(PREFIX)).when(F.col("form") == "spm", place(MIDDLE) - place(PREFIX)) - len(PREFIX)
    middle = F.when(F.col("form") != "plain", F.length("output") - place(MIDDLE) + 1 - len(MIDDLE)).cast("long")
    return rows.select("doc_id", "n", "form", prefix.alias("prefix_chars"), middle.alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from an output and its form; null where either is null."""
    parts = lambda one, two: rf"(?s)\A{one}(.*?){two}(.*?){MIDDLE}(.*)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, parts(PREFIX, SUFFIX), "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, parts(SUFFIX, PREFIX), "$2$3$1"))
        .when(form == "plain", output)
    )
