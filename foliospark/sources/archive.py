"""Book archives: sniff, unpack, read the package document, profile, write back.

Archives are read with the ``binaryFile`` source, one row each; unpacking streams
entry by entry, so a task holds one archive and one entry at a time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.profile import COUNTED_TAGS, tag_count

ENTRY_SCHEMA = (
    "path string, ordinal int, name string, mtime timestamp, content binary, error string"
)
EPUB_TYPE = "application/epub+zip"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def sniff(content: Column) -> Column:
    """S1: 'pdf' or 'zip' by magic bytes, null for anything else. Names are not trusted."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(
        head.rlike("^504B(0304|0506|0708)"), "zip"
    )


def entries(archives: DataFrame) -> DataFrame:
    """The entries of each zip archive in their order. A file that is no zip gives
    no rows. An archive that cannot be unpacked as a whole gives one row with ``error``, last,
    and without ``name``; ``whole`` drops all its entries and ``checked`` reports it."""
    zipped = archives.filter(sniff(F.col("content")) == "zip").select("path", "content")

    def row(*values: object) -> pd.DataFrame:
        return pd.DataFrame([values], columns=["path", "ordinal", "name", "mtime", "content", "error"])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, blob in zip(pdf.path, pdf.content):
                i = 0
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        for i, info in enumerate(z.infolist()):
                            if not info.is_dir():
                                when = dt.datetime(*info.date_time)
                                yield row(path, i, info.filename, when, z.read(info), None)
                except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, ValueError, NotImplementedError) as e:
                    yield row(path, i, None, None, None, f"{type(e).__name__}: {e}")

    return zipped.mapInPandas(unpack, ENTRY_SCHEMA)


def whole(unpacked: DataFrame) -> DataFrame:
    """The entries of archives that could be unpacked to the end."""
    broken = unpacked.filter("error IS NOT NULL").select("path").distinct()
    return unpacked.join(broken, "path", "left_anti")


def checked(archives: DataFrame, unpacked: DataFrame) -> DataFrame:
    """One verdict per file: name, signature, whether all of it could be unpacked, and
    the declared type of the book."""
    broken = unpacked.filter("error IS NOT NULL").select("path", "error")
    declared = unpacked.filter("name = 'mimetype'").select(
        "path", X.trim_low(F.decode("content", "UTF-8")).alias("declared")
    )
    files = archives.select("path", sniff(F.col("content")).alias("kind"))
    joined = files.join(declared, "path", "left").join(broken, "path", "left")
    problem = (
        F.when(F.col("kind").isNull(), "not a PDF or EPUB file")
        .when(F.col("kind") == "pdf", None)
        .when(~F.lower("path").endswith(".epub"), "not an EPUB name")
        .when(F.col("error").isNotNull(), F.concat(F.lit("archive is damaged: "), "error"))
        .when(F.col("declared").isNull(), "mimetype is missing")
        .when(F.col("declared") != EPUB_TYPE, "mimetype is not valid")
    )
    return joined.withColumn("problem", problem).drop("error")


def decoded(unpacked: DataFrame) -> DataFrame:
    return unpacked.withColumn("text", F.decode("content", "UTF-8")).drop("content")


def package_paths(unpacked: DataFrame) -> DataFrame:
    """Path of the package document named by the container. XPath in Spark
    resolves no external entities."""
    container = decoded(unpacked.filter("name = 'META-INF/container.xml'"))
    found = F.expr("xpath_string(text, \"//*[local-name()='rootfile'][1]/@full-path\")")
    return container.select("path", found.alias("opf")).filter("opf <> ''")


def package_items(unpacked: DataFrame) -> DataFrame:
    """Manifest items by kind with their path in the archive, and the title."""
    opf = package_paths(unpacked)
    docs = decoded(unpacked).join(opf.withColumnRenamed("opf", "name"), ["path", "name"])
    item = "//*[local-name()='item']"
    parsed = docs.select(
        "path",
        F.trim(F.expr("xpath_string(text, \"(//*[local-name()='title'])[1]\")")).alias("title"),
        F.regexp_extract("name", "^(.*/)", 1).alias("base"),
        # one concatenated value per item keeps href and media type together
        F.arrays_zip(
            F.expr(f'xpath(text, "{item}/@href")').alias("href"),
            F.expr(f'xpath(text, "{item}/@media-type")').alias("media"),
        ).alias("items"),
    )
    rows = parsed.select("path", "title", "base", F.posexplode_outer("items").alias("place", "i"))
    media = F.col("i.media")
    kind = (
        F.when(media == "application/xhtml+xml", "xhtml")
        .when(media.startswith("image/"), "image")
        .when(media == "text/css", "css")
    )
    return rows.select(
        "path", "title", "place", kind.alias("kind"),
        X.normalize_path(F.concat("base", "i.href")).alias("name"),
    ).filter("kind IS NOT NULL")


def book_profile(unpacked: DataFrame) -> DataFrame:
    """One row per book: title, files and element counts of its content files."""
    items = package_items(unpacked)
    kinds = items.groupBy("path").agg(
        F.first("title").alias("title"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in ("xhtml", "image", "css")],
    )
    content = decoded(unpacked).join(
        items.filter("kind = 'xhtml'").select("path", "name"), ["path", "name"], "left_semi"
    )
    counts = content.groupBy("path").agg(
        *[F.sum(tag_count(F.col("text"), t).cast("bigint")).alias(f"{t}_count") for t in COUNTED_TAGS]
    )
    totals = unpacked.groupBy("path").agg(F.count(F.lit(1)).alias("total_files"))
    return totals.join(kinds, "path").join(counts, "path", "left")


def with_replacements(unpacked: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Entries with the rebuilt content of (path, name) where there is one."""
    new = rebuilt.select("path", "name", F.encode("content", "UTF-8").alias("_new"))
    joined = unpacked.join(new, ["path", "name"], "left")
    return joined.withColumn("content", F.coalesce("_new", "content")).drop("_new")


def write_archives(unpacked: DataFrame, folder: str) -> DataFrame:
    """K1: one archive per ``path`` in a folder every worker sees; entry order and times
    kept, ``mimetype`` stored uncompressed. Returns (path, output, entries). The output
    is named after the archive and a digest of its path, so that archives of one name in
    different folders do not meet. Damaged archives are not written.

    Entries arrive sorted, so an archive is written entry by entry and renamed into
    place when it is complete; a repeated task writes the same file again."""
    ordered = whole(unpacked).repartition("path").sortWithinPartitions("path", "ordinal")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        current, archive, target, count = None, None, "", 0

        def close() -> pd.DataFrame:
            archive.close()
            os.replace(f"{target}.tmp{os.getpid()}", target)
            return pd.DataFrame({"path": [current], "output": [target], "entries": [count]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.path != current:
                    if current is not None:
                        yield close()
                    current, count = r.path, 0
                    stem, ending = os.path.splitext(os.path.basename(r.path))
                    mark = hashlib.sha256(r.path.encode()).hexdigest()[:16]
                    target = os.path.join(folder, f"{stem}-{mark}{ending}")
                    archive = zipfile.ZipFile(f"{target}.tmp{os.getpid()}", "w")
                info = zipfile.ZipInfo(r.name, date_time=r.mtime.timetuple()[:6])
                stored = r.name == "mimetype"
                info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
                archive.writestr(info, r.content)
                count += 1
        if current is not None:
            yield close()

    return ordered.mapInPandas(write, "path string, output string, entries long")
