"""Queries over archives, which are packed from the given documents, some of them spoilt."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.plans.registry import query
from tessera.sources.archives import REQUIRED, checked_archives
from tessera.sources.tables import read_table

LIMIT = 2000
SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.epub' WHEN 2 THEN '.XLSX' ELSE '.txt' END"


@F.pandas_udf(BinaryType())
def _packed(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """Each text in an archive. Every fifth lacks the required member, every seventh its last bytes, every eleventh says a wrong size."""

    def one(key: int, text: str | None) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            if key % 5:
                z.writestr(REQUIRED, "<Types/>")
            z.writestr("body/", "")
            z.writestr("body/text.xml", text or "")
        content = out.getvalue()
        if key % 7 == 0:
            return content[:-3]
        if key % 11 == 0:
            at = content.rfind(b"PK\x01\x02") + 24
            return content[:at] + (2_000_000_000).to_bytes(4, "little") + content[at + 4 :]
        return content

    return pd.Series([one(k, t) for k, t in zip(ids, texts, strict=True)])


@query(
    f"WITH f AS (SELECT doc_id, concat('in/', doc_id, {SUFFIX}) AS path, doc_id % 4 = 3 OR doc_id % 7 = 0 AS none, doc_id % 4 = 3 AS plain, doc_id % 4 <> 1 AS office, "
    "CASE WHEN doc_id % 11 = 0 THEN 2000000000 ELSE strlen(coalesce(text, '')) END + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 8 END AS n FROM documents) "
    "SELECT path, CASE WHEN none THEN -1 ELSE 1 + CAST(doc_id % 5 <> 0 AS BIGINT) END AS n_members, CASE WHEN none THEN -1 ELSE CAST(n AS BIGINT) END AS inflated, "
    "CASE WHEN plain THEN NULL WHEN none THEN 'damaged' WHEN office AND doc_id % 5 = 0 THEN 'no content types' WHEN doc_id % 11 = 0 THEN 'dishonest' "
    f"WHEN n > {LIMIT} THEN 'too large' END AS error FROM f"
)
def archive_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, inflated size (-1 where there is none) and fault of every file."""
    docs = read_table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("in/"), F.col("doc_id"), F.expr(SUFFIX)).alias("path"), _packed("doc_id", "text").alias("content"))
    return checked_archives(files, LIMIT).fillna(-1, ["n_members", "inflated"])
