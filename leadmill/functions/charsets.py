"""Charsets of pages, told from their bytes.

Bytes are read as ISO-8859-1, so that each is one character, and run through an automaton of lead and trail ranges: what
is left after all well-formed characters are taken out, from left to right, is malformed. Expressions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession, functions as F

# Byte ranges of the charsets' characters.
_SJIS_ONE, _SJIS_PAIR = r"[\x00-\x7F\xA1-\xDF]++", r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]"
_EUC_ONE, _EUC_PAIR = r"[\x00-\x7F]++", r"\x8F[\xA1-\xFE]{2}|\x8E[\xA1-\xDF]|[\xA1-\xFE]{2}"
_SJIS_KANA, _EUC_KANA = r"\x82[\x9F-\xF1]|\x83[\x40-\x7E\x80-\x96]|\x81[\x41-\x5B]", r"\xA4[\xA1-\xF3]|\xA5[\xA1-\xF6]|\xA1[\xA2-\xBC]"
_SJIS_VENDOR = r"[\x87\xED\xEE\xFA-\xFC][\x40-\x7E\x80-\xFC]"
_ISO_2022 = r"\x1B\$[@B]|\x1B\([BIJ]"
#: Names under which pages know a charset.
NAMES = {
    "utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8"), "shift_jis": ("shift_jis", "shift-jis", "sjis", "x-sjis", "ms_kanji", "windows-31j", "cp932", "ms932"), "euc-jp": ("euc-jp", "euc_jp", "x-euc-jp", "eucjp", "x-euc"),
    "iso-2022-jp": ("iso-2022-jp", "csiso2022jp", "jis"), "iso-8859-1": ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii"), "windows-1252": ("windows-1252", "cp1252"),
}


def known_charset(name: Column) -> Column:
    """The charset's usual name; null if it isn't one that is read here."""
    low = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for usual, names in NAMES.items():
        out = F.when(low.isin(*names), usual).otherwise(out)
    return out


def _only(one: Column, wanted: str, *others: str) -> Column:
    """The characters of the wanted kind, where the text is cut into wanted and other ones from left to right."""
    return F.regexp_replace(one, "(" + wanted + ")|" + "|".join(others), "$1")


def well_formed(raw: Column, charset: str) -> Column:
    """Whether bytes are characters of the charset, by its lead and trail ranges."""
    one = F.decode(raw, "ISO-8859-1")
    if charset == "utf-8":
        return F.is_valid_utf8(raw.cast("string"))
    if charset == "shift_jis":
        return F.regexp_replace(one, f"{_SJIS_ONE}|{_SJIS_PAIR}", "") == ""
    if charset == "euc-jp":
        return F.regexp_replace(one, f"{_EUC_ONE}|{_EUC_PAIR}", "") == ""
    if charset == "iso-2022-jp":
        return ~F.rlike(one, F.lit(r"[\x80-\xFF]"))
    return F.lit(True)


def charset_of(raw: Column, header: Column | None = None) -> Column:
    """The header's charset if the bytes are well-formed in it; else ISO-2022-JP by its escapes, UTF-8, Shift_JIS or EUC-JP,
    whichever they are well-formed in; null for none. Bytes that are well-formed as both of the last are the one that they
    hold more kana and punctuation of: single-byte katakana make most EUC-JP texts well-formed Shift_JIS."""
    one = F.decode(raw, "ISO-8859-1")
    named = known_charset(header) if header is not None else F.lit(None).cast("string")
    held = F.lit(None).cast("string")
    for charset in NAMES:
        held = F.when((named == charset) & well_formed(raw, charset), charset).otherwise(held)
    sjis, euc = well_formed(raw, "shift_jis"), well_formed(raw, "euc-jp")
    more = F.length(_only(one, _EUC_KANA, _EUC_ONE, _EUC_PAIR)) >= F.length(_only(one, _SJIS_KANA, _SJIS_ONE, _SJIS_PAIR))
    return F.when(held.isNotNull(), held).when(F.rlike(one, F.lit(_ISO_2022)) & well_formed(raw, "iso-2022-jp"), "iso-2022-jp").when(well_formed(raw, "utf-8"), "utf-8").when(euc & (~sjis | more), "euc-jp").when(sjis, "shift_jis")


@contextmanager
def _java_charsets(spark: SparkSession) -> Iterator[None]:
    """Expressions that are made within read all of Java's charsets and replace what is malformed; the session's settings
    are as before afterwards."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    was = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in was.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _decoded(raw: Column, charset: Column) -> Column:
    vendor = _only(F.decode(raw, "ISO-8859-1"), _SJIS_VENDOR, _SJIS_ONE, _SJIS_PAIR) != ""
    java = {"euc-jp": "EUC-JP", "iso-2022-jp": "ISO-2022-JP", "iso-8859-1": "ISO-8859-1", "windows-1252": "windows-1252"}
    out = F.when((charset == "shift_jis") & vendor, F.decode(raw, "windows-31j")).when(charset == "shift_jis", F.decode(raw, "Shift_JIS"))
    for name, own in java.items():
        out = out.when(charset == name, F.decode(raw, own))
    return out.otherwise(F.decode(raw, "UTF-8"))


def with_html(df, raw: str, header: str | None, html: str, charset: str):
    """df with the page's text and the charset it was read in. A charset that the page itself names in its first 2,000
    characters is read after that, unless it is UTF-8 or the header's."""
    with _java_charsets(df.sparkSession):
        told = F.col(header) if header else F.lit(None).cast("string")
        first = df.withColumn(charset, charset_of(F.col(raw), told))
        first = first.withColumn(html, _decoded(F.col(raw), F.col(charset)))
        meta = known_charset(F.regexp_extract(F.left(F.col(html), F.lit(2000)), r"(?i)charset\s*=\s*[\"']?([\w\-]+)", 1))
        again = meta.isNotNull() & (meta != "utf-8") & ~meta.eqNullSafe(known_charset(told)) & ~meta.eqNullSafe(F.col(charset))
        out = first.withColumn("_meta", F.when(again, meta))
        out = out.withColumn(html, F.when(F.col("_meta").isNotNull(), _decoded(F.col(raw), F.col("_meta"))).otherwise(F.col(html)))
        return out.withColumn(charset, F.coalesce("_meta", charset, F.lit("utf-8"))).drop("_meta")


def encoded(df, text: str, charset: str, out: str):
    """df with the text's bytes in the charset that each row names."""
    with _java_charsets(df.sparkSession):
        name, value = known_charset(F.col(charset)), F.encode(F.col(text), "UTF-8")
        for usual, java in (("shift_jis", "Shift_JIS"), ("euc-jp", "EUC-JP"), ("iso-2022-jp", "ISO-2022-JP"), ("iso-8859-1", "ISO-8859-1"), ("windows-1252", "windows-1252")):
            value = F.when(name == usual, F.encode(F.col(text), java)).otherwise(value)
        return df.withColumn(out, value)
