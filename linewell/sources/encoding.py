"""Guessing and decoding text encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reader encoding for each guess, and the Python name of each codec.
AUTO_READER = {
    "ASCII7": "ISO-8859-1",
    "ASCII8": "ISO-8859-1",
    "UTF8": "UTF-8",
    "UTF16LE": "UTF-16LE",
    "UTF16BE": "UTF-16BE",
}
PYTHON_CODECS = {
    "ISO-8859-1": "latin-1",
    "UTF-8": "utf-8",
    "UTF-16LE": "utf-16-le",
    "UTF-16BE": "utf-16-be",
    "windows-1251": "cp1251",
    "windows-1252": "cp1252",
    "Big5": "big5",
    "GB18030": "gb18030",
    "Shift_JIS": "shift_jis",
    "KOI8-R": "koi8-r",
}
ALIASES = {"CP1251": "windows-1251", "CP1252": "windows-1252", "SHIFT-JIS": "Shift_JIS"}
READERS = {name.upper(): name for name in PYTHON_CODECS} | ALIASES

HIGH_BYTE = "[^\\x00-\\x7f]"


def decode_column(spark: SparkSession, raw: Column, encoding: str) -> Column:
    """Bytes to text; malformed bytes become U+FFFD, never an error.

    UTF-8 and ISO-8859-1 stay in the JVM; an Arrow UDF decodes the others, the same
    way in every session.
    """
    name = READERS.get(encoding.upper())
    if name is None:
        raise ValueError(f"unknown encoding {encoding!r}; known: {sorted(PYTHON_CODECS)}")
    if name == "UTF-8":
        return F.make_valid_utf8(raw.cast("string"))
    if name == "ISO-8859-1":
        return F.decode(raw, name)
    codec = PYTHON_CODECS[name]

    return F.pandas_udf(
        lambda values: values.map(lambda b: None if b is None else bytes(b).decode(codec, "replace")), "string")(raw)


# Lead and continuation bytes of multibyte sequences, read as ISO-8859-1 with the 7-bit
# bytes left out.  Two-byte forms start at C2 and three-byte ones at E0 A0 (no overlong
# forms); four-byte ones are taken from 0x800 up to 0x1FFFFF, as the lenient guess wants it.
_LENIENT = (
    r"\A(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}"
    r"|\xf0(?:[\x90-\xbf][\x80-\xbf]|[\x81-\x8f][\x80-\xbf]|\x80[\xa0-\xbf])[\x80-\xbf]"
    r"|[\xf1-\xf7][\x80-\xbf]{3})*+\z"
)


def _lenient(raw: Column) -> Column:
    high = F.regexp_replace(F.decode(raw, "ISO-8859-1"), F.lit(r"[\x00-\x7f]+"), F.lit(""))
    return F.rlike(high, F.lit(_LENIENT))


def detect_encoding(df: DataFrame, mode: str = "strict") -> DataFrame:
    """One guess per file of ``raw_lines``: (file, guess, reader_encoding).

    A byte order mark at byte 0 decides; else any malformed line means ASCII8,
    any multibyte sequence UTF8, neither ASCII7.  ``mode="strict"`` takes valid
    UTF-8 as Spark does; ``mode="ref"`` ignores 7-bit bytes inside a sequence
    and accepts four-byte forms of small and very large code points.
    """
    return encoding_facts(df, mode).select("file", "guess", "reader_encoding")


def encoding_facts(df: DataFrame, mode: str, *more: Column) -> DataFrame:
    """``detect_encoding`` with more aggregates over ``raw`` from the same pass."""
    raw = F.col("raw")
    if mode == "strict":
        valid = F.is_valid_utf8(raw.cast("string"))
    elif mode == "ref":
        valid = _lenient(raw)
    else:
        raise ValueError("mode must be 'strict' or 'ref'")
    # The first line of a file is the first row of its split at byte 0.  A number
    # rather than text, so that rows are hash-aggregated and never sorted.
    start = F.hex(F.substring(raw, 1, 2))
    head = F.when(start == "FFFE", 1).when(start == "FEFF", 2).otherwise(0)
    lines = df.select(
        "file", "raw", "_row", "_split", head.alias("_head"),
        (~valid).alias("_bad"),
        F.rlike(F.decode(raw, "ISO-8859-1"), F.lit(HIGH_BYTE)).alias("_high"),
    )
    first = F.when(F.col("_split") == 0, F.col("_row"))
    sums = lines.groupBy("file").agg(
        F.min_by("_head", first).alias("_head"),
        F.bool_or("_bad").alias("_bad"),
        F.bool_or("_high").alias("_high"),
        *more,
    )
    guess = (
        F.when(F.col("_head") == 1, "UTF16LE")
        .when(F.col("_head") == 2, "UTF16BE")
        .when(F.col("_bad"), "ASCII8")
        .when(F.col("_high"), "UTF8")
        .otherwise("ASCII7")
    )
    named = F.create_map(*[F.lit(x) for pair in AUTO_READER.items() for x in pair])
    return sums.withColumn("guess", guess).withColumn(
        "reader_encoding", named[F.col("guess")]
    )
