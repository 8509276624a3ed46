"""Benchmark passages in documents, also with other numbers, names or units.

Numbers, names and units become typed placeholders. Documents and benchmark items are cut into windows of five canonical words,
and document windows are joined with item windows by their hash. Windows with placeholders are looked for by their plain
lower-case words too, so that a copy is found whatever its capitals and however many numbers it holds. Matches that continue
each other form a run: same document, item and distance between the places. In a run each value of the item must always stand
against the same value of the document; a window that holds a value which does not counts only if its plain words match. An
item is in a document if the windows that count are enough of all its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.session import settle

WINDOW = 5
MIN_COVERAGE = 0.6
MIN_LITERALS = 3  # words of a window that are no placeholders; windows with fewer would match anything
MAX_WINDOW_BYTES = 64 << 20  # a larger table of item windows is not broadcast
_ROW_BYTES = 96  # of a window, besides its words
NAME, NUMBER, UNIT, POINT = (chr(c) for c in range(0xE000, 0xE004))
UNITS = (
    "mm|cm|m|km|inch|inches|ft|feet|yd|yards|mi|mile|miles|meter|meters|metre|metres|g|kg|mg|lb|lbs|oz|pound|pounds|ton|tons|"
    "s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months|year|years|l|ml|liter|liters|"
    "litre|litres|percent|dollar|dollars|cent|cents|euro|euros|usd|eur|gbp|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v|a"
)
_WORD = rf"\p{{L}}\p{{N}}{NAME}-{POINT}"

# The steps of both forms, as (pattern, replacement), for Spark and for SQL engines with RE2 patterns alike. A capitalised word
# after a lower-case letter, comma or semicolon is a name; digits around a point or comma are one number.
MARK = ((r"([\p{Ll},;] )(\p{Lu}\p{Ll})", rf"\1{NAME}\2"), (r"(\p{N})[.,](\p{N})", rf"\1{POINT}\2"))
SLOTS = (
    (rf"{NAME}[{_WORD}]+", NAME),
    (rf"\p{{N}}[\p{{N}}{POINT}]*", NUMBER),
    (rf"({NUMBER}[^{_WORD}]*)\b(?:{UNITS})([^{_WORD}]|$)", rf"\1{UNIT}\2"),
)
SEPARATOR = rf"[^{_WORD}]+"


def _steps(text: Column, steps: tuple) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by.replace("\\", "$"))
    return text


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR), lambda t: t != "")


def marked(text: Column) -> Column:
    """Lower-case text with names and numbers marked; characters that serve as marks are dropped before."""
    plain = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT + POINT, "")
    return F.lower(_steps(plain, MARK))


def _words(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``values`` of ``marked``, its canonical ``words`` and its ``plain`` words, place by place."""
    values = _tokens(F.col("marked"))
    plain = F.transform(values, lambda v: F.translate(v, NAME, ""))
    return rows.withColumns({"words": _tokens(_steps(F.col("marked"), SLOTS)), "plain": plain})


def _hashes(window: int) -> Column:
    """Place from 1 and hash of every window of ``words``, and of the window of ``plain`` where it differs."""
    places = F.when(F.size("words") >= window, F.sequence(F.lit(1), F.size("words") - (window - 1)))
    canonical = F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice("words", i, window)).alias("hash")))

    def literal(i: Column) -> Column:
        own = F.slice("plain", i, window)
        return F.struct(i.alias("place"), F.when(F.slice("words", i, window) != own, F.xxhash64(own)).alias("hash"))

    differing = F.filter(F.transform(places, literal), lambda w: w["hash"].isNotNull())
    return F.when(F.col("words") == F.col("plain"), canonical).otherwise(F.concat(canonical, differing))


def _benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Hashes of the items' windows with the values of their words, and how many windows an item has.

    A window of plain words has no slots; one of placeholders for the most part is left to its plain words.
    """
    items = benchmark.filter(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item_id"), marked(F.col(text)).alias("marked")
    ).distinct()
    words = _words(items)
    found = words.select("item_id", "marked", "words", "plain", F.explode(_hashes(window)).alias("w"))
    cut = found.select(
        "item_id", F.col("w.place").alias("item_place"), F.col("w.hash").alias("hash"),
        F.slice("words", F.col("w.place"), window).alias("item_words"),
        F.slice("plain", F.col("w.place"), window).alias("item_plain"),
        F.slice(_tokens(F.col("marked")), F.col("w.place"), window).alias("item_values"),
    )
    canonical = F.col("hash") == F.xxhash64("item_words")
    slots = F.when(canonical, F.size(F.filter("item_words", lambda w: w.rlike(f"^[{NAME}-{UNIT}]")))).otherwise(0)
    sizes = cut.groupBy("item_id").agg(F.countDistinct("item_place").alias("item_windows"))
    usable = cut.withColumn("slots", slots).filter(F.col("slots") <= window - MIN_LITERALS)
    return usable.join(sizes, "item_id").select("item_id", "item_place", "hash", "slots", "item_values", "item_windows")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched_windows``, ``item_windows``, ``coverage`` of every item found in a document.

    Missing texts are empty and match nothing, nor do rows without id. Rows that share an id are one document. Items with fewer
    words than a window are not looked for; of items with hardly any words besides placeholders, only copies are
    found, as other numbers in their place cannot be told from other text. The table of item windows is measured: up to
    ``MAX_WINDOW_BYTES`` it is broadcast, beyond, the windows of both sides are shuffled by hash.
    """
    items = settle(_benchmark_windows(benchmark, item_id, text, window))
    words = F.aggregate("item_values", F.lit(0), lambda n, v: n + F.octet_length(v) + 16)
    size = items.agg(F.sum(words + _ROW_BYTES)).first()[0] or 0
    if size <= MAX_WINDOW_BYTES:
        items = F.broadcast(items)
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), marked(F.col(text)).alias("marked"))
    windows = _words(rows).select("doc_id", "marked", F.explode(_hashes(window)).alias("w"))
    met = windows.select("doc_id", "marked", F.col("w.place").alias("place"), F.col("w.hash").alias("hash")).join(items, "hash")
    values = F.when(F.col("slots") > 0, F.slice(_tokens(F.col("marked")), F.col("place"), window))
    matches = met.select(
        "doc_id", "item_id", "item_place", "item_windows", (F.col("place") - F.col("item_place")).alias("shift"), "slots",
        F.when(F.col("slots") > 0, F.arrays_zip(F.col("item_values").alias("item"), values.alias("doc"))).alias("pairs"),
    )
    run = ["doc_id", "item_id", "shift"]
    slots = matches.filter("slots > 0").select(*run, "item_place", F.explode("pairs").alias("p")).select(*run, "item_place", "p.item", "p.doc")
    clashes = slots.groupBy(*run, "item").agg((F.min("doc") != F.max("doc")).alias("clash")).filter("clash").drop("clash")
    against = slots.join(clashes, [*run, "item"]).select(*run, "item_place").distinct().withColumn("slotted", F.lit(True))
    plain = (F.col("slots") > 0).alias("slotted")
    kept = matches.select("*", plain).join(against, [*run, "item_place", "slotted"], "left_anti")
    found = kept.groupBy("doc_id", "item_id", "item_windows").agg(F.countDistinct("item_place").alias("matched_windows"))
    covered = F.round(F.col("matched_windows") / F.col("item_windows"), 6)
    return found.withColumn("coverage", covered).filter(F.col("coverage") >= min_coverage).select(
        "doc_id", "item_id", "matched_windows", "item_windows", "coverage"
    )


def _sql_form(text: str, steps: tuple) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def _sql_windows(table: str, key: str) -> str:
    marks = NAME + NUMBER + UNIT + POINT
    plain = f"translate(coalesce(text, ''), '{marks}', '')"
    words = f"list_filter(regexp_split_to_array({_sql_form('marked', SLOTS)}, '{SEPARATOR}'), lambda t: t <> '')"
    values = f"list_filter(regexp_split_to_array(marked, '{SEPARATOR}'), lambda t: t <> '')"
    cut = ", ".join(f"{long}[place : place + {WINDOW - 1}] as {short}" for long, short in (("words", "w"), ("vals", "v"), ("plain", "l")))
    return f"""(select {key}, place, {cut} from (
      select {key}, words, vals, list_transform(vals, lambda x: replace(x, '{NAME}', '')) as plain, unnest(range(1, len(words) - {WINDOW} + 2)) as place from (
        select {key}, {words} as words, {values} as vals from (
          select distinct {key}, lower({_sql_form(plain, MARK)}) as marked from {table} where {key} is not null))))"""


SQL = f"""
with d as {_sql_windows('documents', 'doc_id')},
i as (select *, len(list_filter(w, lambda x: regexp_matches(x, '^[{NAME}-{UNIT}]'))) as slots from {_sql_windows('benchmark', 'item_id')}),
n as (select item_id, count(distinct place) as item_windows from i group by item_id),
l as (select d.doc_id, i.item_id, i.place as item_place from d join i on d.l = i.l),
m as (select d.doc_id, i.item_id, i.place as item_place, d.place - i.place as shift, d.v as dv, i.v as iv, slots
  from d join i on d.w = i.w where slots <= {WINDOW - MIN_LITERALS}),
p as (select doc_id, item_id, shift, item_place, unnest(iv) as a, unnest(dv) as b from m where slots > 0),
c as (select doc_id, item_id, shift, a from p group by all having min(b) <> max(b)),
x as (select distinct p.doc_id, p.item_id, p.shift, p.item_place from p join c using (doc_id, item_id, shift, a)),
u as (select doc_id, item_id, item_place from l union all
  select doc_id, item_id, item_place from m anti join x using (doc_id, item_id, shift, item_place)),
f as (select doc_id, item_id, count(distinct item_place) as matched_windows from u group by doc_id, item_id)
select doc_id, item_id, matched_windows, item_windows, round(matched_windows / item_windows, 6) as coverage
from f join n using (item_id) where round(matched_windows / item_windows, 6) >= {MIN_COVERAGE}"""
