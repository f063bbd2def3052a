"""License scans: canonical texts, whole, looked up by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.llm.license_texts import known_texts

# Lines that name a holder or a year and not the terms (on lowered text), and spellings that
# licence matching treats as equal.
COPYRIGHT_LINE = (r"(?m)^[^a-z0-9\n(©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[<\[:]|by\b)|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4})"
                  r"|all rights reserved[^a-z0-9\n]*$)[^\n]*")
PUNCTUATION = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{a0}\x{a9}\x{ab}\x{bb}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2026}\x{feff}]+"
SPELLINGS = (
    (r"\b(sub)?licence(s|d|e|es)?\b", "{1}license{2}"),
    (r"\bsub licens", "sublicens"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\b(author|organ|real|recogn|util)is(e|ed|es|ing|ation)\b", "{1}iz{2}"),
    (r"\bfavour", "favor"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bwhile st\b|\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\bhttps\b", "http"),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words parted by single spaces, one spelling per word.

    Letters beyond ASCII stay, so a licence followed by other text in any script is another text.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE.replace("(?m)", "(?md)", 1), "")
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return out


def canonical_sql(text: str) -> str:
    """The same for DuckDB."""
    def quote(value):
        return "'" + value.replace("'", "''") + "'"

    out = f"regexp_replace(lower(coalesce({text}, '')), '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, {quote(COPYRIGHT_LINE)}, '', 'g')"
    out = f"trim(regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g'))"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def license_scan(df: DataFrame, key: str, text: str, licenses: DataFrame) -> DataFrame:
    """``doc_id, digest, license_id`` for every row: the licence whose text the row's whole text is, else null.

    ``licenses`` has ``license_id, text``; of several with one canonical text the smallest identifier
    counts.  Only keys and digests meet the licences; the join leaves its kind to Spark.  Texts
    without any word (null, empty, punctuation, bare copyright lines) have a digest and match nothing.
    Repeated rows and null keys are answered row by row.
    """
    known = (licenses.select(canonical(F.col("text")).alias("words"), "license_id").where("words <> ''")
             .groupBy(F.sha2("words", 256).alias("_digest")).agg(F.min("license_id").alias("license_id")))
    rows = df.select(F.col(key).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("digest"))
    return rows.join(known, F.col("digest") == F.col("_digest"), "left").select("doc_id", "digest", "license_id")


def license_scan_sql() -> str:
    known = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in known_texts())
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({canonical_sql('text')}) AS digest FROM (VALUES {known}) AS t(license_id, text)
    WHERE {canonical_sql('text')} <> '') GROUP BY digest),
rows AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents)
SELECT rows.doc_id, rows.digest, known.license_id FROM rows LEFT JOIN known USING (digest)"""
