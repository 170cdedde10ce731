"""Mixing sources to target weights, with DataFrame operations only.

What every source is to give is a number of words: its share of all words by weight, but
never more than a few times what it has. These targets are apportioned in equal blocks of
words by Sainte-Laguë's method, first to sources, then to the shards of each source, so
that a shard knows its integer quota alone. A shard lays its documents end to end in
seeded order, takes its whole line as often as the quota says, and of the rest of the
quota as many blocks of the line as fit, in seeded order.

Nothing here is sized by one source: a source's documents are dealt to shards of bounded
size by a hash, and ranks over all sources or shards are made of range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.sets import portable_hash
from bomloom.operators.order import numbered

from ._tables import written

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK = 1024
SHARD_WORDS = 1 << 20
_SPACE = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """How many runs of other than ASCII white space a text has; 0 for null. Each run becomes one letter, so no list of words is made."""
    marks = F.regexp_replace(text, f"[{_SPACE}]*[^{_SPACE}]+[{_SPACE}]*", "x")
    return F.when(text.rlike(f"[^{_SPACE}]"), F.char_length(marks)).otherwise(0).cast("long")


def apportioned(df: DataFrame, group: str, seats: str, votes: str, tie: str) -> DataFrame:
    """df with quota: the seats of each row by Sainte-Laguë among the rows of its group, which share as many seats as each names.

    A seat goes to the highest of the quotients votes / 1, / 3, / 5 and so on; of equal
    ones to the row that comes first by tie. Divisors above and below the one that would
    deal out all seats bound what each row gets, so of all quotients about two a row are
    compared.
    """
    whole = df.groupBy(group).agg(F.sum(votes).cast("double").alias("_all"), F.count("*").alias("_rows"))
    bound = lambda by: F.floor(F.coalesce(F.col(votes) * (F.col(seats) + by * F.col("_rows") / 2) / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(0.0)) + 0.5)
    # One less and one more than the bounds, against rounding.
    bounded = written(df.join(whole, group).withColumns({"_least": F.greatest(bound(-1) - 1, F.lit(0)), "_most": bound(1) + 1}).drop("_all", "_rows"))
    given = bounded.groupBy(group).agg(F.sum("_least").alias("_given"))
    open_ = bounded.where(f"{votes} > 0").select(group, tie, F.explode(F.sequence("_least", F.col("_most"))).alias("_k"), F.col(votes).alias("_v")).withColumn("_quotient", F.col("_v") / (2 * F.col("_k") + 1))
    ranked = written(numbered(open_, "_rank", F.col(group), F.desc("_quotient"), F.col(tie)))
    firsts = ranked.groupBy(group).agg(F.min("_rank").alias("_first"))
    left = bounded.select(group, seats).distinct().join(given, group).join(firsts, group).select(group, "_first", (F.col(seats) - F.col("_given")).alias("_left"))
    won = ranked.join(left, group).where(F.col("_rank") - F.col("_first") < F.col("_left")).groupBy(group, tie).agg(F.count("*").alias("_won"))
    return bounded.join(won, [group, tie], "left").withColumn("quota", F.col("_least") + F.coalesce("_won", F.lit(0))).drop("_least", "_most", "_won")


def with_targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sources (size, weight) with target: shares of all sizes by weight, none above repeats times its size; what that leaves is shared again.

    The share of one unit of weight rises with every source that meets its bound, so
    the bounded ones only become more; each round is one aggregate over sources.
    """
    most = F.col("size") * repeats
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, open_, bounded = total, weights, 0
    while open_:
        full = most * F.lit(open_) <= F.col("weight") * F.lit(float(rest))
        now = sources.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if now[0] == bounded:
            break
        bounded, rest, open_ = now[0], total - now[1], now[2]
    share = F.col("weight") * F.lit(float(rest)) / F.lit(open_ or 1)
    return sources.withColumn("target", F.least(most.cast("double"), share) if open_ else most.cast("double"))


def _sources(sized: DataFrame, weights: tuple[int, ...], repeats: int, block: int, shard_words: int) -> DataFrame:
    """none, name, s (place by code point, nulls last), size, target, goal (words to take), quota (blocks) and shards of each source."""
    found = numbered(sized.groupBy("none", "name").agg(F.sum("size").alias("size")), "s", F.col("none"), F.col("name"))
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("s") - 1) % len(weights)).cast("int"))
    found = with_targets(written(found.withColumn("weight", weight)), repeats).withColumns({"goal": F.round("target").cast("long"), "shards": F.greatest(F.ceil(F.col("size") / shard_words), F.lit(1))})
    all_ = found.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    return written(apportioned(found.withColumns({"_one": F.lit(1), "_blocks": F.lit((2 * all_ + block) // (2 * block))}), "_one", "_blocks", "target", "s").drop("_one", "_blocks", "weight"))


def _shards(dealt: DataFrame, sources: DataFrame, seed: int, repeats: int, block: int) -> DataFrame:
    """s, shard, passes (times that the whole line is taken) and extra (words that each of its blocks gives once more, from its begin)."""
    sizes = dealt.groupBy("s", "shard").agg(F.sum("size").alias("size"))
    rows = sizes.join(sources.select("s", "goal", F.col("quota").alias("blocks")), "s")
    tie = rows.withColumn("_tie", F.col("shard"))
    quotas = apportioned(tie, "s", "blocks", "size", "_tie").drop("_tie")
    # A quota of blocks, within what the shard can give; the words that are then missing for the goal, or too many, go to shards in turn.
    quotas = quotas.withColumn("words", F.least(F.col("quota") * block, F.col("size") * repeats))
    off = quotas.groupBy("s").agg((F.max("goal") - F.sum("words")).alias("off"))
    room = F.when(F.col("off") > 0, F.col("size") * repeats - F.col("words")).otherwise(F.col("words"))
    quotas = quotas.join(off, "s").withColumn("room", room)
    before = F.sum("room").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("room")
    change = F.signum("off").cast("long") * F.greatest(F.least(F.abs("off") - before, F.col("room")), F.lit(0))
    words = quotas.withColumn("words", F.col("words") + change)
    size = F.greatest("size", F.lit(1))
    lines = written(words.select("s", "shard", "size", F.floor(F.col("words") / size).alias("passes"), (F.col("words") % size).alias("rest")))
    blocks = lines.select("s", "shard", "rest", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / block))).alias("j"), (F.col("size") / block).cast("long").alias("whole"))
    drawn = portable_hash(F.concat_ws(":", F.lit(str(seed)), "s", "shard", "j"))
    # What is left of the line beyond its whole blocks comes last, so that all that come before are equal.
    place = F.row_number().over(Window.partitionBy("s", "shard").orderBy(F.col("j") == F.col("whole"), drawn, "j")) - 1
    extra = F.greatest(F.least(F.col("rest") - place * block, F.lit(block)), F.lit(0)).cast("int")
    given = blocks.select("s", "shard", "j", extra.alias("extra")).groupBy("s", "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "extra"))), lambda x: x["extra"]).alias("extra"))
    return lines.select("s", "shard", "passes").join(given, ["s", "shard"])


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 42, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """key, size, source_size, target, passes, spans: how often the mix takes each document whole, and which of its words once more.

    size counts words (a null text has none); spans are (begin, end) in words. Sources,
    by code point with null last, weigh weights in turn. Over a source, passes and spans
    sum to its target, rounded to a whole word; no word is taken more than repeats times.
    Everything depends on the rows and seed alone: rows of equal key and text are
    interchangeable, their order is by their hash. A source without words has the target
    0. Keys may be null, repeated and of any type; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = portable_hash(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), text))
    name = F.col(source).cast("string")
    sized = written(docs.select(F.col(key).alias("_key"), name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"), n_words(F.col("text")).alias("size"), hashed.alias("hash")))
    sources = _sources(sized, weights, repeats, block, shard_words)
    of = sources.select("none", "name", "s", F.col("size").alias("source_size"), "target", "shards")
    dealt = sized.join(of, ["none", "name"]).withColumn("shard", F.pmod("hash", "shards")).drop("none", "name", "shards")
    shards = _shards(dealt, sources, seed, repeats, block)
    in_line = Window.partitionBy("s", "shard").orderBy("hash", "_key", "size")
    lined = dealt.withColumn("begin", F.sum("size").over(in_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    whole = lined.join(shards, ["s", "shard"])
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    span = lambda j: F.struct((F.greatest(begin, j * block) - begin).alias("begin"), (F.least(end, j * block + F.get("extra", j.cast("int"))) - begin).alias("end"))
    spans = F.filter(F.transform(F.sequence(F.floor(begin / block), F.floor((end - 1) / block)), span), lambda x: x["begin"] < x["end"])
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return whole.select(F.col("_key").alias(key), "size", "source_size", "target", "passes", F.when(F.col("size") > 0, spans).otherwise(none).alias("spans"))


def taken_words(size: Column, passes: Column, spans: Column) -> Column:
    return size * passes + F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])


def mixed_texts(text: Column, passes: Column, spans: Column) -> Column:
    """What the mix takes of a text, as a list of texts: the whole one as often as it does, then the words of each span with the white space between them."""
    words = F.regexp_extract_all(text, F.lit(f"[{_SPACE}]*[^{_SPACE}]+"), F.lit(0))
    part = lambda x: F.regexp_replace(F.array_join(F.slice(words, (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")), ""), f"^[{_SPACE}]+", "")
    return F.concat(F.array_repeat(text, passes.cast("int")), F.transform(spans, part))


def op13_source_mixing(documents: DataFrame) -> DataFrame:
    """How many words the mix takes of each document; mix() says how, and how odd input counts."""
    mixed = mix(documents)
    return mixed.select("doc_id", "size", "source_size", "target", taken_words(F.col("size"), F.col("passes"), F.col("spans")).cast("long").alias("taken"))


_NUMBER = "('0x' || substr(md5({x}), 1, 15))::BIGINT"
#: The same rows in DuckDB; all quotients are listed here, and targets come of one pass over sources in the order in which they meet their bounds.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, {_NUMBER.format(x="'42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')")} AS h FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) AS s, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * sum(size)::BIGINT AS most FROM d GROUP BY source),
o AS (SELECT *, sum(size) OVER () AS total, coalesce(sum(most) OVER (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(weight) OVER (ORDER BY most / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unbounded FROM w),
l AS (SELECT (total - below)::DOUBLE AS rest, unbounded FROM o WHERE most * unbounded >= weight * (total - below) ORDER BY most / weight, s LIMIT 1),
g AS (SELECT o.*, least(most::DOUBLE, weight * rest / l.unbounded) AS target, round(least(most::DOUBLE, weight * rest / l.unbounded))::BIGINT AS goal, greatest(ceil(size / 1048576), 1)::BIGINT AS shards FROM o, l),
n AS (SELECT ((2 * sum(goal) + 1024) // 2048)::BIGINT AS seats FROM g),
q AS (SELECT s, count(*) AS quota FROM (SELECT s FROM g, n, range(seats) k(k) WHERE target > 0 QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, s) <= seats) GROUP BY 1),
x AS (SELECT d.*, s, g.size AS source_size, target, h % shards AS shard FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
z AS (SELECT s, shard, sum(size)::BIGINT AS size FROM x GROUP BY ALL),
y AS (SELECT s, shard, count(*) AS quota FROM (SELECT z.s, shard FROM z JOIN q ON q.s = z.s, range(quota) k(k) WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY z.s ORDER BY size / (2 * k + 1) DESC, shard) <= quota) GROUP BY ALL),
p AS (SELECT z.s, z.shard, z.size, goal, least(coalesce(quota, 0) * 1024, 3 * z.size) AS words FROM z JOIN g ON g.s = z.s LEFT JOIN y ON y.s = z.s AND y.shard = z.shard),
f AS (SELECT *, (goal - sum(words) OVER (PARTITION BY s))::BIGINT AS missing FROM p), e AS (SELECT *, CASE WHEN missing > 0 THEN 3 * size - words ELSE words END AS room FROM f),
v AS (SELECT s, shard, size, words + sign(missing)::BIGINT * greatest(least(abs(missing) - (sum(room) OVER (PARTITION BY s ORDER BY shard ROWS UNBOUNDED PRECEDING) - room)::BIGINT, room), 0) AS take FROM e),
b AS (SELECT s, shard, j, greatest(least(take % greatest(size, 1) - 1024 * (row_number() OVER (PARTITION BY s, shard ORDER BY j = size // 1024, {_NUMBER.format(x="'42:' || s || ':' || shard || ':' || j")}, j) - 1), 1024), 0) AS extra FROM v, range(size // 1024 + 1) k(j)),
i AS (SELECT *, (sum(size) OVER (PARTITION BY s, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS at FROM x)
SELECT i.doc_id, i.size::BIGINT AS size, i.source_size, i.target, (any_value(take // greatest(v.size, 1)) * i.size + coalesce(sum(least(i.at + i.size, 1024 * j + extra) - greatest(i.at, 1024 * j)) FILTER (j IS NOT NULL), 0))::BIGINT AS taken
FROM i JOIN v ON v.s = i.s AND v.shard = i.shard LEFT JOIN b ON b.s = i.s AND b.shard = i.shard AND extra > 0 AND 1024 * j < i.at + i.size AND 1024 * j + extra > i.at GROUP BY i.r, i.doc_id, i.size, i.source_size, i.target
"""
