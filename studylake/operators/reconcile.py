"""Comparing and repairing whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.session import materialize

#: Buckets that rows are dealt to before they are compared.
BUCKETS = 4096


def row_differences(left: DataFrame, right: DataFrame, integers: list[str] | None = None) -> DataFrame:
    """Rows the two sides do not hold equally often: `left_rows` and `right_rows` per distinct row.

    Order does not matter; `integers` are compared as whole numbers. Both directions come from one grouping,
    and equal rows fold before the shuffle.
    """
    columns = left.columns
    whole = set(integers or [])

    def side(df: DataFrame, in_left: int) -> DataFrame:
        cells = [F.col(name).cast("bigint").alias(name) if name in whole else F.col(name) for name in columns]
        return df.select(*cells, F.lit(in_left).alias("_l"), F.lit(1 - in_left).alias("_r"))

    return (
        side(left, 1).unionByName(side(right, 0)).groupBy(*columns)
        .agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
        .where("left_rows <> right_rows")
    )


def _compared(df: DataFrame, columns: list[str], whole: set[str]) -> DataFrame:
    return df.select(*[F.col(f"`{name}`").cast("bigint").alias(name) if name in whole else F.col(f"`{name}`") for name in columns])


def _fingerprints(df: DataFrame) -> tuple[Column, Column]:
    """Two independent hashes of a row; NULL and where a value stands count."""
    cells = [part for name in df.columns for part in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)


def bucket_digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`bucket, n, total, mixed`: rows dealt by their hash, and a digest of each bucket that doesn't depend on their order.

    The sum tells repeated rows apart, the exclusive or of a second hash is independent of it.
    """
    one, two = _fingerprints(df)
    dealt = df.select(F.pmod(one, F.lit(buckets)).alias("bucket"), one.cast("decimal(38,0)").alias("one"), two.alias("two"))
    return dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("total"), F.bit_xor("two").alias("mixed"))


def differing_buckets(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Buckets whose digests differ; never more than `buckets` rows. Only digests are exchanged, no rows."""
    sides = [bucket_digests(df, buckets).withColumn("side", F.lit(i)) for i, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1]).groupBy("bucket", "n", "total", "mixed").agg(F.count(F.lit(1)).alias("sides"))
    return both.where("sides < 2").select("bucket").distinct()


def row_differences_by_bucket(left: DataFrame, right: DataFrame, integers: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """As `row_differences`, for sides that are mostly equal: only rows of buckets that differ are exchanged and compared.

    Both sides are read once for the digests, and again only where some bucket differs. Unequal buckets have equal digests with
    a probability of about 2^-100.
    """
    columns = left.columns
    whole = set(integers or [])
    one, two = _compared(left, columns, whole), _compared(right, columns, whole)
    found = materialize(differing_buckets(one, two, buckets), "differing-buckets")

    def within(df: DataFrame) -> DataFrame:
        placed = df.withColumn("_bucket", F.pmod(_fingerprints(df)[0], F.lit(buckets)))
        return placed.join(F.broadcast(found), placed["_bucket"] == found["bucket"], "left_semi").select(*[f"`{name}`" for name in columns])

    if found.isEmpty():
        return row_differences(one.limit(0), two.limit(0))
    return row_differences(within(one), within(two))


def assert_same_rows(left: DataFrame, right: DataFrame, integers: list[str] | None = None) -> None:
    """Raise when the two sides differ in any row."""
    row = row_differences_by_bucket(left, right, integers).first()
    if row is not None:
        raise AssertionError(f"rows differ, e.g. {row.asDict()}")


def void_to_string(df: DataFrame) -> DataFrame:
    """Columns without any typed value become text, so that they can be stored."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
