"""Files as rows: listing, checks of type and content, and plain texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are accepted, those read as plain text, and the first bytes that a suffix must have.
SUPPORTED = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".txt", ".csv", ".tsv", ".xml", ".json", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif")
PLAIN = (".txt", ".csv", ".tsv", ".md", ".json", ".xml")
MAGIC = {
    ".pdf": ("255044462D",), ".docx": ("504B0304", "504B0506", "504B0708"), ".pptx": ("504B0304", "504B0506", "504B0708"), ".xlsx": ("504B0304", "504B0506", "504B0708"),
    ".png": ("89504E470D0A1A0A",), ".jpg": ("FFD8FF",), ".jpeg": ("FFD8FF",), ".gif": ("474946383761", "474946383961"), ".bmp": ("424D",), ".tiff": ("49492A00", "4D4D002A"),
}


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path's last part with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, size, modified, suffix) of the supported, non-empty files under a folder of any store Spark reads; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), suffix(F.col("path")).alias("suffix"))
    return listed.where((F.col("size") > 0) & F.col("suffix").isin(*SUPPORTED))


def magic_matches(content: Column, of: Column) -> Column:
    """Whether the content begins as its suffix demands; true for suffixes without a demand."""
    head = F.hex(F.substring(content, 1, 8))
    fits = F.lit(True)
    for name, heads in MAGIC.items():
        some = F.lit(False)
        for h in heads:
            some = some | F.startswith(head, F.lit(h))
        fits = F.when(of == name, some).otherwise(fits)
    return fits


def checked(files: DataFrame, max_chars: int = 50_000_000) -> DataFrame:
    """Rows (path, size, content_hash, route, text, error) of files (path, content).

    Plain files become text, invalid UTF-8 replaced; others are routed to a converter (``pdf`` or ``rich``). error
    says why a file is refused: unsupported, content (it doesn't look like its suffix), blank or too long.
    """
    of = suffix(F.col("path"))
    plain = of.isin(*PLAIN)
    text = F.when(plain, F.make_valid_utf8(F.col("content").cast("string")))
    route = F.when(plain, "plain").when(of == ".pdf", "pdf").otherwise("rich")
    rows = files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_hash"), of.alias("suffix"), route.alias("route"), text.alias("text"), magic_matches(F.col("content"), of).alias("fits"))
    error = F.when(~F.col("suffix").isin(*SUPPORTED), "unsupported").when(~F.col("fits"), "content").when((F.col("route") == "plain") & ~F.regexp_like("text", F.lit(r"\S")), "blank").when(F.length("text") > max_chars, "too long")
    return rows.withColumn("error", error).drop("suffix", "fits")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``checked`` over all files under a folder."""
    return checked(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content"))
