"""Fill-in-the-middle examples with Spark expressions only, by escaped marker injection.

A text is cut into units (lines). A delimiter is escaped in the text and then put after every unit, so
counting it counts the units, and what stands before or after the k-th of them is a stretch of whole
units. Three stretches are taken so, unescaped and put between marks; the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a text, matched from left to right: a line with its end, or what stands after the last end.
LINES = r"[^\n]*\n|[^\n]+"
#: Delimiter and escape sign: two controls, which may occur in texts.
CUT, ESCAPE = "\x1d", "\x1b"


def inject(text: Column, unit: str = LINES) -> Column:
    """The text, escaped, with CUT after each unit and nowhere else."""
    for sign, code in ((ESCAPE, "e"), (CUT, "d")):
        text = F.replace(text, F.lit(sign), F.lit(ESCAPE + code))
    return F.regexp_replace(text, unit, f"$0{CUT}")


def extract(marked: Column) -> Column:
    """What stood in the text where the marked stretch was cut out."""
    text = F.replace(marked, F.lit(CUT), F.lit(""))
    for sign, code in ((CUT, "d"), (ESCAPE, "e")):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(sign))
    return text


def _part(marked: str, n: str) -> Column:
    """What stands before the n-th CUT of a column, or after the n-th from its end if n is below zero."""
    return F.expr(f"substring_index({marked}, '{CUT}', {n})")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, unit: str = LINES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars, output.

    Four numbers from the sha256 of seed and doc_id choose the two cuts, whether the text is turned into
    an infilling example at all (rate of 100), and whether the suffix stands first (spm, spm_rate of 100; else
    psm). Form is plain, and the output the text, where the draw says so, and if the text is empty or holds a
    mark. unit is a pattern of the units, which cover the text without gaps, one after another; its matches must
    be the same when controls in them are written as two characters, and must not rest on the borders of others.

    Null texts are empty, null ids draw as an empty id, rows of one id share their draws, repeated rows stay,
    an empty table gives no rows, and other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = rows.withColumns({"marked": inject(F.col("text"), unit), "digest": digest})
    rows = rows.select("doc_id", "text", "marked", (F.length("marked") - F.length(F.replace("marked", F.lit(CUT), F.lit("")))).cast("long").alias("n"), *draws)
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    rows = rows.withColumns({"head": _part("marked", "b"), "prefix": extract(_part("marked", "a")), "suffix": extract(_part("marked", "cast(b - n - 1 as int)"))})
    rows = rows.withColumn("middle", extract(_part("head", "a - b")))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    chars = [F.when(F.col("form") != "plain", F.length(c).cast("long")).alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select("doc_id", "n", "form", *chars, output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from. A plain text holds no marks unless it is plain for them."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(second: str) -> tuple[Column, Column]:
        """What stands between the first mark and the second, and after the second."""
        return F.substring_index(head, second, 1).substr(F.lit(len(PREFIX) + 1), F.length(head)), F.substring_index(head, second, -1)

    (prefix, suffix), (suffix_first, prefix_second) = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_second, middle, suffix_first))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infilling examples of all documents, with digests of the outputs and of the texts read back from them."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
    WITH units AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
               sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
        FROM documents
    ),
    drawn AS (SELECT *, len(u) AS n, [CAST('0x' || substring(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM units),
    cuts AS (
        SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
                    WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ),
    parts AS (
        SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
               coalesce(array_to_string(u[b + 1:n], ''), '') AS s
        FROM cuts
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
    FROM parts"""
