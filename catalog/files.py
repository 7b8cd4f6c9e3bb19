"""Queries over binary content and pictures derived from the page table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import q, sql
from catalog.registry import register
from docweir import messages as msg
from docweir.operators import files

_HEADS = ["FFD8FF", "89504E470D0A1A0A0000000D494844520000271000002710", "25504446", "524946460000000057454250",
          "5249464600000000414243444546", "504B0304", "D0CF11E0A1B11AE1", "", "7B5C727466"]


def contents(spark, d):
    """Page bytes behind one of several file heads; every seventeenth file is empty."""
    k = F.col("page_id")
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in _HEADS]), (k % 9).cast("int")))
    return i.table(spark, d, "pages").select(
        "page_id", F.when(k % 17 == 16, F.unhex(F.lit(""))).otherwise(F.concat(head, F.encode("html", "UTF-8"))).alias("content"))


_c = ("SELECT page_id, page_id % 9 AS k, page_id % 17 = 16 AS empty, CASE WHEN page_id % 17 = 16 THEN ''::BLOB ELSE unhex([" + ", ".join(q(h) for h in _HEADS)
      + "][page_id % 9 + 1]) || encode(html) END AS content, html FROM pages")
_mime = "CASE WHEN empty THEN '' ELSE ['image/jpeg', 'image/png', 'application/pdf', 'image/webp', '', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/msword', '', ''][k + 1] END"


@register("sniff_mime", sql(f"SELECT page_id, {_mime} AS mime FROM c", c=_c))
def _(spark, d):
    return contents(spark, d).select("page_id", F.coalesce(files.sniff_mime(F.col("content")), F.lit("")).alias("mime"))


@register("validate_uploads", sql(f"""
SELECT page_id, CASE WHEN empty THEN {q(msg.EMPTY_FILE)} WHEN octet_length(content) > 3000 THEN {q(msg.TOO_LARGE)} WHEN m = '' THEN {q(msg.UNKNOWN_FILE)}
  WHEN k IN (5, 6) THEN {q(msg.UNSUPPORTED_FILE)} || m WHEN k = 1 THEN 'Rasm o''lchami juda katta' ELSE sha256(content) END AS outcome FROM (SELECT *, {_mime} AS m FROM c)""", c=_c))
def _(spark, d):
    good, bad = files.validate_uploads(contents(spark, d), 3000)
    return good.select("page_id", F.col("sha256").alias("outcome")).unionByName(bad.select("page_id", F.col("reason").alias("outcome")))


@register("detect_format", sql("""
SELECT page_id, CASE WHEN empty THEN 'unknown' WHEN k = 6 THEN 'doc' WHEN k = 8 THEN 'rtf' WHEN k = 7 AND regexp_matches(lower(html), '^\\s*<(html|\\?xml)') THEN 'html' ELSE 'unknown' END AS format FROM c""", c=_c))
def _(spark, d):
    return files.detect_format(contents(spark, d)).select("page_id", "format")


@register("detect_page_format", sql("SELECT page_id, CASE WHEN regexp_matches(lower(h), '^\\s*<(html|\\?xml)') THEN 'html' ELSE 'unknown' END AS format FROM (SELECT page_id, replace(html, '<!DOCTYPE html>', '') AS h FROM pages)"))
def _(spark, d):
    p = i.table(spark, d, "pages").select("page_id", F.encode(F.replace("html", F.lit("<!DOCTYPE html>"), F.lit("")), "UTF-8").alias("content"))
    return files.detect_format(p).select("page_id", "format")


def archives(spark, d):
    """Each page zipped as a template: some with macros, some with escaping paths."""
    def pack(ids: pd.Series, html: pd.Series) -> pd.Series:
        import io
        import zipfile

        def zipped(base: bytes, members: dict[str, str]) -> bytes:
            buffer = io.BytesIO(base)
            with zipfile.ZipFile(buffer, "a", zipfile.ZIP_DEFLATED) as z:
                for name, text in members.items():
                    z.writestr(name, text)
            return buffer.getvalue()

        # The large member is the same in every archive, so it is packed once for a batch.
        zeros = zipped(b"", {"zeros.bin": "0" * 9_000_000}) if (ids % 7 == 0).any() else b""
        return pd.Series([zipped(zeros if k % 7 == 0 else b"", {
            "word/document.xml": text, **({"word/vbaProject.bin": "x"} if k % 3 == 0 else {}), **({"../evil.txt": "x"} if k % 5 == 0 else {})})
            for k, text in zip(ids, html)], dtype=object)

    return i.table(spark, d, "pages").select("page_id", F.pandas_udf(pack, "binary")(F.col("page_id"), F.col("html")).alias("content"))


@register("archive_safety", sql("""
SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 7 = 0 THEN 'suspicious compression ratio' END, CASE WHEN page_id % 5 = 0 THEN 'path traversal' END,
  CASE WHEN page_id % 3 = 0 THEN 'macro or active content' END], lambda x: x IS NOT NULL), '|') AS reasons FROM pages"""))
def _(spark, d):
    return files.archive_safety(archives(spark, d)).select("page_id", F.array_join("reasons", "|").alias("reasons"))


@register("archive_format", sql("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'docm' ELSE 'docx' END AS format FROM pages"))
def _(spark, d):
    return files.detect_format(archives(spark, d)).select("page_id", "format")


@register("image_quality")
def _(spark, d):
    """Page bytes read as grey pictures 64 pixels wide; the last row is filled with zeros."""
    raw = i.table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"))
    rows = F.greatest(F.ceil(F.length("b") / 64), F.lit(1)).cast("int")
    images = raw.select("page_id", rows.alias("height"), F.lit(64).alias("width"), F.lit(1).alias("channels"),
                        F.rpad(F.col("b"), rows * 64, F.lit(b"\x00")).alias("data"))
    from docweir.operators import gates
    return gates.quality_gate(files.image_quality(images)).select(
        "page_id", F.round("blur_score", 3).alias("blur_score"), F.round("brightness", 3).alias("brightness"), "moire_detected", "is_acceptable")
