"""Pages of a filtered, searched and sorted table.

A table that is paged through is stored once in its order (``store_pages``): every row carries its number, and rows lie in one
folder per range of numbers. A page names the folders that hold it by arithmetic, whatever its depth. Under a filter the
matches per folder are counted first, and the page is read from the one or two folders in which it falls. Filters reach the file scan;
a word of a search is looked up among the trigrams of each folder before the folder is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.functions.missing import ascending, matches_any
from trapline.operators.order import with_row_id
from trapline.session import parts_for, settle

FOLDER_ROWS = 100_000  # rows per folder of a stored table
BLOCK_ROWS = 1_000  # rows per block of the search index; a folder holds whole blocks
_ROW, _FOLDER = "__row", "__folder"


def _column_test(name: str, wanted: object) -> Column:
    """Text is looked for inside the value, a pair is a closed range, a list is a choice of values.

    Case does not matter in text, and either bound of a range may be None.
    """
    column = F.col(name)
    if isinstance(wanted, str):
        return F.lower(column.cast("string")).contains(wanted.lower())
    if isinstance(wanted, tuple):
        low, high = wanted
        tests = [column >= low] if low is not None else []
        tests += [column <= high] if high is not None else []
        test = F.lit(True)
        for t in tests:
            test = test & t
        return test
    return matches_any(column, wanted)


def _block() -> Column:
    return F.floor((F.col(_ROW) - 1) / BLOCK_ROWS).alias("block")


def _row_text(columns: Sequence[str]) -> Column:
    """What a search looks through: all values of a row in lower case."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def _block_trigrams(rows: DataFrame, columns: Sequence[str], parts: int) -> DataFrame:
    """The strings of three letters in the words of each block's rows.

    A searched word holds no white space, so strings across words are never asked for. Rows of a block share most of their words, so
    distinct words are taken first and cut afterwards. Blocks are dealt over ``parts`` partitions once, which serves both steps.
    """
    texts = rows.select(_row_text(columns).alias("text"), _block()).repartition(parts, "block")
    words = texts.select(F.explode(F.split("text", " ")).alias("word"), "block")
    words = words.filter(F.length("word") >= 3).distinct()
    places = words.select("*", F.explode(F.sequence(F.lit(1), F.length("word") - 2)).alias("place"))
    return places.select(F.substring("word", F.col("place"), F.lit(3)).alias("trigram"), "block").distinct()


def filter_table(
    df: DataFrame, column_filters: Mapping[str, object] | None = None, search: str | None = None, searched: Sequence[str] | None = None
) -> DataFrame:
    """Apply per-column filters, and a search in which every word must occur somewhere in the row (in the columns ``searched``)."""
    for name, wanted in (column_filters or {}).items():
        df = df.filter(_column_test(name, wanted))
    row = _row_text(searched or df.columns)
    for word in (search or "").lower().split():
        df = df.filter(row.contains(word))
    return df


def table_page(
    df: DataFrame,
    key: str | Sequence[str],
    column_filters: Mapping[str, object] | None = None,
    search: str | None = None,
    order: Sequence[Column] = (),
    offset: int = 0,
    limit: int = 10,
) -> DataFrame:
    """One page of rows. ``key`` tells rows apart and breaks ties, so that pages never overlap.

    The rows that pass are numbered anew for every page; store a table that is paged through.
    """
    keys = [key] if isinstance(key, str) else list(key)
    shown, sort = filter_table(df, column_filters, search), [*order, *ascending(*keys)]
    numbered = with_row_id(shown, sort, _ROW)
    page = numbered.filter(F.col(_ROW).between(offset + 1, offset + limit))
    return page.orderBy(_ROW).drop(_ROW)


def store_pages(
    df: DataFrame, path: str, key: str | Sequence[str], order: Sequence[Column] = (), folder_rows: int = FOLDER_ROWS, mode: str = "error"
) -> None:
    """Store ``df`` in ``order``, ties by ``key``, for ``open_pages``.

    Rows go out as they were sorted, without another shuffle. Beside them lies a posting table: for every trigram of the rows' words, the
    blocks of ``BLOCK_ROWS`` rows that hold it.
    """
    if folder_rows % BLOCK_ROWS:
        raise ValueError(f"folder_rows must be a multiple of {BLOCK_ROWS}")
    keys = [key] if isinstance(key, str) else list(key)
    numbered = with_row_id(df, [*order, *ascending(*keys)], _ROW)
    numbered.withColumn(_FOLDER, F.floor((F.col(_ROW) - 1) / folder_rows)).write.mode(mode).partitionBy(_FOLDER).parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    grams = settle(_block_trigrams(stored, df.columns, parts_for(df, 4)))  # a row becomes many words
    grams.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block").write.mode(mode).parquet(f"{path}/trigrams")


@dataclass(frozen=True)
class PagedTable:
    """A table stored in its order. ``folder_rows`` is what it was stored with."""

    rows: DataFrame
    trigrams: DataFrame
    folder_rows: int = FOLDER_ROWS

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in (_ROW, _FOLDER)]

    def _blocks(self, search: str | None) -> DataFrame | None:
        """Blocks that hold every trigram of every word of three letters or more; None: no such word, so all of them."""
        wanted = sorted({w[i : i + 3] for w in (search or "").lower().split() for i in range(len(w) - 2)})
        if not wanted:
            return None
        found = self.trigrams.filter(F.col("trigram").isin(wanted)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        folder = F.floor(F.col("block") * BLOCK_ROWS / self.folder_rows).alias(_FOLDER)
        return found.filter(F.col("n") == len(wanted)).select(folder, "block")

    def matches(self, column_filters: Mapping[str, object] | None = None, search: str | None = None) -> DataFrame:
        """All rows that pass, with their number and folder. Only blocks with all trigrams of the search are tested for it."""
        blocks, rows = self._blocks(search), self.rows
        if blocks is not None:
            rows = rows.withColumn("block", _block()).join(blocks, [_FOLDER, "block"], "left_semi").drop("block")
        return filter_table(rows, column_filters, search, self.columns)

    def page(
        self, column_filters: Mapping[str, object] | None = None, search: str | None = None, offset: int = 0, limit: int = 10
    ) -> DataFrame:
        """One page, read from the folders it lies in."""
        first, last = offset + 1, offset + limit
        if not column_filters and not (search or "").split():
            folders = range((first - 1) // self.folder_rows, (last - 1) // self.folder_rows + 1)
            page = self.rows.filter(F.col(_FOLDER).isin(list(folders)) & F.col(_ROW).between(first, last))
            return page.orderBy(_ROW).select(*self.columns)
        passing = self.matches(column_filters, search)
        counts = passing.groupBy(_FOLDER).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy(_FOLDER))  # one row per folder
        ends = counts.select(_FOLDER, upto.alias("upto"), (upto - F.col("n")).alias("before"))
        # At most ``limit`` folders, as each of them holds a row of the page.
        held = ends.filter((F.col("upto") >= first) & (F.col("before") < last)).orderBy(_FOLDER).collect()
        if not held:
            return self.rows.select(*self.columns).limit(0)
        inside = filter_table(self.rows.filter(F.col(_FOLDER).isin([r[_FOLDER] for r in held])), column_filters, search, self.columns)
        numbered = with_row_id(inside, [F.col(_ROW)], "__place")
        page = numbered.filter(F.col("__place").between(first - held[0].before, last - held[0].before))
        return page.orderBy("__place").select(*self.columns)

    def at(self, positions: Sequence[int], name: str = "position") -> DataFrame:
        """The rows with the given numbers, from the folders they lie in."""
        wanted = sorted({int(p) for p in positions if int(p) > 0})
        folders = sorted({(p - 1) // self.folder_rows for p in wanted})
        rows = self.rows.filter(F.col(_FOLDER).isin(folders) & F.col(_ROW).isin(wanted))
        return rows.select(*self.columns, F.col(_ROW).alias(name))


def open_pages(spark: SparkSession, path: str, folder_rows: int = FOLDER_ROWS) -> PagedTable:
    """A table that ``store_pages`` wrote."""
    return PagedTable(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/trigrams"), folder_rows)
