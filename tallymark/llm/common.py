"""Table access, text columns and distributed ranks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a maximal run of characters that are not ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def space_words(text: Column) -> Column:
    """The words of ``text`` between runs of ASCII white space, in order."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z as far as ASCII words can tell.

    ``lower`` also folds other letters; the Kelvin sign alone would become an
    ASCII letter, so it is first replaced by another letter outside ASCII.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("Å")))


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; null ids never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def lowest_share(column: str, wanted: int, total: Column | int) -> Column:
    """Whether a row's hash is low enough for about four times ``wanted`` of ``total`` rows to pass.

    Put before a search for the ``wanted`` lowest hashes, it keeps what reaches
    the last task of the search as small as the sample, however large the table.
    """
    size = F.lit(total) if isinstance(total, int) else total
    return F.pmod(F.xxhash64(column), F.lit(1 << 40)) < F.lit(4.0 * wanted * (1 << 40)) / size


def gapless_index(rows: DataFrame, group: str, mix: Column, order: list[Column], out: str,
                  counts: dict[int, int]) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... within each ``group``, however large one group is.

    Rows of a group are dealt by the hash ``mix`` over cells, each meant to hold
    a quarter of an even partition; rows are numbered within their cell and
    start after the cells before it. ``counts`` has the rows of each group and
    must be of bounded size (shards, lengths). Rows equal in all of ``order``
    are interchangeable.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_cell = max(1, -(-sum(counts.values()) // (4 * parts)))
    wide = {g: -(-n // per_cell) for g, n in counts.items() if n > per_cell}
    n_cells = F.lit(1)
    if wide:
        listed = F.create_map(*[x for g, n in wide.items() for x in (F.lit(g), F.lit(n))])
        n_cells = F.coalesce(F.try_element_at(listed, F.col(group)), F.lit(1))
    dealt = rows.withColumn("_cell", F.pmod(mix, n_cells.cast("bigint")))
    number = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)).cast("bigint") - 1
    before = (dealt.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(
                  Window.partitionBy(group).orderBy("_cell")) - F.col("_n"))
              .drop("_n"))
    return (dealt.withColumn("_number", number).join(before, [group, "_cell"])
            .withColumn(out, F.col("_number") + F.col("_before"))
            .drop("_number", "_before", "_cell"))


HOT_PARTS = 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str, counted: str, total: int) -> DataFrame:
    """Left join of ``rows`` with the table ``groups``, one row per ``key``, however large a group is.

    ``counted`` names the rows of each group and is dropped. A group of more than
    one part in ``HOT_PARTS`` of all ``total`` rows is repeated under several
    numbers, over which its rows are dealt as they are read. There are fewer than
    ``HOT_PARTS`` such groups, so their list can be broadcast. ``groups`` is read
    twice and should be a written table.
    """
    cell = max(1, total // HOT_PARTS)
    cells = F.ceil(F.col(counted) / cell)
    hot = groups.where(F.col(counted) > cell).select(key, cells.alias("_cells"))
    dealt = (rows.join(F.broadcast(hot), key, "left")
             .withColumn("_cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_cells", F.lit(1)))))
    copies = groups.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1))).drop(counted)
    return dealt.join(copies.hint("shuffle_hash"), [key, "_cell"], "left").drop("_cell", "_cells")
