"""What the text operators share: written tables, ASCII lower case, packed rows, seeded uniform numbers."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import checkpoint_dir

#: Whitespace of the plain-word rule: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, grouped by application so that it can be removed as a whole."""
    return f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later reads see the same rows, lost executors cost
    nothing before this point, and the planner knows the table's size."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove every table this application staged; results that read them must have been written by then."""
    jvm, base = spark.sparkContext._jvm, f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` has a fast path for pure ASCII, where both agree."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *reserved: str) -> Column:
    """All columns of ``df`` in one struct, so that an operator's own columns cannot clash with them. Columns named like one
    of ``reserved`` (in any case) are left out: the operator's output column of that name replaces them."""
    taken = {name.lower() for name in reserved}
    return F.struct(*[quoted(c).alias(c) for c in df.columns if c.lower() not in taken])


def unit_md5(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) of 52 bits from the md5 of the parts joined by colons; null parts count as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
