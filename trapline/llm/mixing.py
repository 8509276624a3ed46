"""Mixing sources to target weights.

The weight of a source is its share of the tokens to the power of an exponent between 0 (all sources alike) and 1 (as they are). The
exponent is bisected to the flattest mix that repeats no source more than a limit, or to the mix closest to the data that has a
target entropy. A source's quota of tokens is then read from its documents in blocks: documents belong to blocks by a hash and have
a fixed order inside; every epoch goes through the blocks in an order of its own, until the quota is used up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import settle

REPEAT_LIMIT = 4.0
SEED = "mix"
STEPS = 1 << 20  # the exponent is a multiple of 1 / STEPS
_AT_ONCE = 32  # exponents that one pass over the sources compares


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _first_true(sources: DataFrame, test, until: int = STEPS) -> int:
    """Smallest step at which ``test(exponent)``, an aggregate over ``sources``, holds; ``until`` if none does.

    ``test`` must go from false to true once. A pass compares several exponents, which is five halvings at a time.
    """
    low, high = 0, until
    while low < high:
        tried = sorted({low + (high - low) * i // _AT_ONCE for i in range(_AT_ONCE)})
        answers = sources.agg(*[test(k / STEPS).alias(f"at{i}") for i, k in enumerate(tried)]).first()
        passed = [k for k, yes in zip(tried, answers) if yes]
        failed = [k for k, yes in zip(tried, answers) if not yes]
        low, high = (max(failed) + 1 if failed else low), (min(passed) if passed else high)
    return low


def exponent_for(
    sources: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget: int | None = None
) -> float:
    """Exponent of the shares in ``sources(share)``, shares above 0 that add up to 1.

    With ``target_entropy`` (in nats): the largest exponent whose mix has at least that entropy, 0 if none has. Else the smallest whose
    epochs stay within ``repeat_limit``, 1 if none does. ``budget`` is in multiples of all tokens; without it, the
    source with most tokens is read exactly once.
    """
    share = F.col("share")
    if target_entropy is not None:

        def too_even(a: float) -> Column:
            power = F.pow(share, F.lit(a))
            entropy = F.log(F.sum(power)) - a * F.sum(power * F.log(share)) / F.sum(power)
            return entropy < target_entropy

        return max(0, _first_true(sources, too_even, STEPS + 1) - 1) / STEPS
    if repeat_limit is None:
        return 1.0

    def within(a: float) -> Column:
        if budget is None:
            return F.max(F.pow(share, F.lit(a - 1))) / F.min(F.pow(share, F.lit(a - 1))) <= repeat_limit
        return F.max(F.pow(share, F.lit(a - 1))) * budget / F.sum(F.pow(share, F.lit(a))) <= repeat_limit

    return _first_true(sources, within) / STEPS


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("?"))


def mix(
    docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget_tokens: int | None = None,
    keep: Sequence[str] = (), doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None, seed: str = SEED,
) -> DataFrame:
    """A row per document and epoch in which it is read: ``doc_id``, ``source``, ``epoch``, ``block``, ``n_tokens``, ``start_token``,
    ``quota``, ``mix_at``, and the columns of ``keep``.

    ``start_token`` counts the tokens of the source read before the document, over all epochs; ``mix_at`` is that as a share of the
    quota, and rows in its order are the mix: every stretch has the sources in proportion. Without ``budget_tokens`` the
    source with most tokens is read once and every other at least once, so that no document is left out.
    A missing source is a source of its own; a missing id sorts first. Documents without tokens cost nothing, and a source without
    any is read once. Rows with equal id are rows like others. ``tokens`` defaults to the words of ``text``.
    """
    size = word_count(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("n_tokens"),
        _key(F.col(source)).alias("__key"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("__hash"), *keep,
    )
    rows = rows if keep else settle(rows)
    sizes = settle(rows.groupBy("__key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    total, most, largest = sizes.agg(F.sum("tokens"), F.max("tokens"), F.max("n")).first()
    blocks = max(1, math.ceil(math.sqrt(largest or 1)))  # per source at most; as many documents in a block of the largest
    shares = sizes.filter("tokens > 0").select((F.col("tokens") / F.lit(total or 1)).alias("share"))
    multiple = None if budget_tokens is None else budget_tokens / (total or 1)
    a = exponent_for(shares, repeat_limit, target_entropy, multiple)
    if budget_tokens is None:
        epochs = F.pow(F.col("tokens") / F.lit(most or 1), F.lit(a - 1))
    else:
        norm = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
        epochs = F.pow(F.col("tokens") / F.lit(total or 1), F.lit(a - 1)) * (multiple / norm)
    quota = F.when(F.col("tokens") > 0, F.round(F.col("tokens") * epochs)).otherwise(0).cast("bigint")
    rounds = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest("tokens", F.lit(1))))
    plan = sizes.withColumn("quota", quota).withColumn("rounds", rounds.cast("int"))

    block = F.conv(F.substr("__hash", F.lit(1), F.lit(8)), 16, 10).cast("bigint") % blocks
    placed = rows.withColumn("block", block)
    inside = Window.partitionBy("__key", "block").orderBy("__hash", "doc_id", "n_tokens")
    before = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ordered = placed.withColumn("__before", F.coalesce(before, F.lit(0)))

    pieces = placed.groupBy("__key", "block").agg(F.sum("n_tokens").alias("__size")).join(plan, "__key")
    turns = pieces.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    turn = F.md5(F.concat_ws(":", F.lit(seed), "__key", "epoch", "block"))
    epoch = Window.partitionBy("__key", "epoch").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("__size").over(epoch), F.lit(0))
    starts = turns.select("__key", "block", "epoch", "quota", start.alias("__start"))

    read = ordered.join(starts, ["__key", "block"]).withColumn("start_token", F.col("__start") + F.col("__before"))
    read = read.filter(F.col("start_token") + F.col("n_tokens") <= F.col("quota"))
    return read.select(
        "doc_id", "source", "epoch", "block", "n_tokens", "start_token", "quota",
        (F.col("start_token") / F.greatest("quota", F.lit(1))).alias("mix_at"), *keep,
    )


SQL = f"""
with r as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n_tokens,
    coalesce('=' || source, '?') as k, md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
s as (select k, cast(sum(n_tokens) as bigint) as tokens, count(*) as n from r group by k),
m as (select max(tokens) as most, min(tokens) filter (tokens > 0) as least, sum(tokens) as total, cast(ceil(sqrt(max(n))) as bigint) as blocks from s),
a as (select min(step) / cast({STEPS} as double) as a from range({STEPS + 1}) t(step), m where step = {STEPS} or
    pow(least / cast(total as double), step / cast({STEPS} as double) - 1) / pow(most / cast(total as double), step / cast({STEPS} as double) - 1) <= {REPEAT_LIMIT}),
q as (select k, tokens, case when tokens > 0 then cast(round(tokens * pow(tokens / cast(most as double), a - 1)) as bigint) else 0 end as quota from s, m, a),
p as (select q.*, greatest(1, cast(ceil(quota / cast(greatest(tokens, 1) as double)) as bigint)) as rounds from q),
d as (select r.*, cast('0x' || substr(h, 1, 8) as bigint) % blocks as block from r, m),
o as (select *, coalesce(sum(n_tokens) over (partition by k, block order by h, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from d),
b as (select k, block, sum(n_tokens) as size from d group by k, block),
t as (select b.*, p.tokens, p.quota, unnest(range(p.rounds)) as epoch from b join p using (k)),
u as (select *, epoch * tokens + coalesce(sum(size) over (partition by k, epoch order by md5(concat_ws(':', '{SEED}', k, epoch, block)), block
    rows between unbounded preceding and 1 preceding), 0) as start from t)
select o.doc_id, o.source, cast(u.epoch as integer) as epoch, o.block, cast(o.n_tokens as bigint) as n_tokens,
  cast(u.start + o.before as bigint) as start_token, u.quota, cast(u.start + o.before as double) / greatest(u.quota, 1) as mix_at
from o join u on o.k = u.k and o.block = u.block where u.start + o.before + o.n_tokens <= u.quota"""
