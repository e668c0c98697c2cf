"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import keep, only

#: No source is repeated more often than this.
MAX_EPOCHS = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
SEED = 17
#: Parts of the seeded order whose sizes are summed before the one part that holds the cut is looked into.
PARTS = 1 << 12
_SPAN = 1 << 48


def words(text: str) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    plain = F.translate(F.col(text).cast("string"), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.split(F.trim(plain), " +")) * (F.trim(plain) != "").cast("int"), F.lit(0)).cast("long")


def seeded(id_col: str, seed: int) -> Column:
    """A number from 0 to 2**48 - 1 that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def water_fill(sources: DataFrame, cap: str = "cap", weight: str = "weight", total: str = "total") -> DataFrame:
    """`sources` plus `target`: shares of `total` by weight, none above its cap, the excess given to the others.

    Clamping and sharing anew until nothing exceeds its cap ends where every source has the lesser of its
    cap and level * weight, for one level. With the sources in order of cap / weight the level is the
    first one that, with all before it clamped, clamps no other; so one ordered pass over the sources
    replaces the rounds. A source without weight gets nothing; if all caps together are
    less than the total, every source gets its cap.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight))
    order = Window.orderBy(F.col("_ratio").asc_nulls_last(), "_name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    step = sources.withColumn("_ratio", ratio).withColumn("_name", F.monotonically_increasing_id())
    step = step.withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn("_weights", F.sum(weight).over(rest))
    level = F.when(F.col("_weights") > 0, (F.col(total) - F.col("_full")) / F.col("_weights"))
    step = step.withColumn("_level", level)
    # The level is that of the first source it does not clamp.
    level = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col(weight) <= 0, F.lit(0.0)).otherwise(
        F.least(F.col(cap).cast("double"), F.coalesce(level * F.col(weight), F.col(cap).cast("double"))))
    return step.withColumn("target", target.cast("double")).drop("_ratio", "_name", "_full", "_weights", "_level")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(text_col).alias("size"), seeded(id_col, seed).alias("_place"))


def shares(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: _s, source_size, target, _whole (whole repetitions), _last (documents up to this place come once more).

    `sized` has source, size and _place. The cut in a source's seeded order is found from sums over `PARTS` equal parts of
    it and then inside one part, so no source is sorted as a whole.
    """
    part = F.floor(F.col("_place") / F.lit(_SPAN // PARTS)).cast("int")
    sums = keep(sized.groupBy("source", part.alias("_part")).agg(F.sum("size").alias("_sum")), "part-sums")
    sources = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))

    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod(number, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    sources = sources.withColumn("cap", F.col("source_size") * max_epochs)
    sources = sources.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    targets = water_fill(sources).select("source", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("_whole", F.least(F.floor(rate), F.lit(max_epochs)).cast("int"))
    targets = keep(targets.withColumn("_more", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")

    # The part of the order where the words still wanted run out, then the last place in it that is taken.
    along = Window.partitionBy("source").orderBy("_part")
    parts = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(sums["source"], "_part", "_sum", "_more")
    parts = parts.withColumn("_before", F.sum("_sum").over(along) - F.col("_sum"))
    # One row a source; written, so that Spark knows its size and sends it to the documents where it is small.
    cut = keep(parts.where("_before <= _more and _before + _sum > _more").groupBy("source").agg(
        F.min("_part").alias("_part"), F.min_by("_before", "_part").alias("_before"), F.min_by("_more", "_part").alias("_more")), "cuts")
    inside = sized.withColumn("_part", part).alias("s").join(
        cut.alias("c"), F.expr("s.source <=> c.source and s._part = c._part")).select("s.source", "_place", "size", "_before", "_more", "c._part")
    inside = inside.groupBy("source", "_part", "_before", "_more", "_place").agg(F.sum("size").alias("size"))
    upto = F.col("_before") + F.sum("size").over(Window.partitionBy("source").orderBy("_place"))
    # A place is taken if that brings the sum nearer to the wanted words.
    inside = inside.withColumn("_upto", upto).where("2 * _upto - size <= 2 * _more")
    last = inside.groupBy("source").agg(F.max("_place").alias("_inside"))
    cut = cut.select(F.col("source").alias("_s"), "_part")
    lasts = cut.join(last, cut["_s"].eqNullSafe(last["source"]), "left").select(
        "_s", F.greatest(F.col("_part").cast("long") * F.lit(_SPAN // PARTS) - 1, F.coalesce("_inside", F.lit(-1))).alias("_last"))
    last = F.when(F.col("_last").isNotNull(), F.col("_last")).when(F.col("_more") > 0, F.lit(_SPAN)).otherwise(F.lit(-1))
    return targets.join(lasts, targets["source"].eqNullSafe(lasts["_s"]), "left").select(
        targets["source"].alias("_s"), "source_size", "target", "_whole", last.alias("_last"))


def _times(max_epochs: int) -> Column:
    return F.least(F.col("_whole") + (F.col("_place") <= F.col("_last")).cast("int"), F.lit(max_epochs))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, times, taken (words).

    Sources in order of code points, null last, weigh `weights` in turn; together they get as many words as
    there are, each at most `max_epochs` times its own. A source whose target is r times its size takes
    each document floor(r) times, and once more those that come first in a seeded order of ids, as many as bring
    the taken words nearest to the target.

    A null or empty text has size 0 and is repeated like the others of its source. Rows that share an id stand at
    the same place of the order, so all of them are taken once more or none. An empty table gives an
    empty result. Extra columns are ignored.
    """
    sized = keep(_rows(docs, id_col, text_col, source_col, seed), "sizes")
    full = keep(shares(sized, weights, max_epochs), "shares")
    out = sized.join(full, sized["source"].eqNullSafe(full["_s"]))
    times = _times(max_epochs)
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, each as often as `mix` takes it. Columns of `docs` that start with an underscore are dropped."""
    names = [c for c in docs.columns if not c.startswith("_")]
    with only("shares"):
        full = keep(shares(keep(_rows(docs, id_col, text_col, source_col, seed), "sizes"), weights, max_epochs), "shares")
    rows = docs.select(*names, seeded(id_col, seed).alias("_place"))
    rows = rows.join(full, rows[source_col].cast("string").eqNullSafe(full["_s"])).withColumn("_times", _times(max_epochs))
    return rows.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[rows[c] for c in names])


def sql(table: str = "documents", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The query's result in SQL: clamping in rounds (as many as sources), and the whole order of each source."""
    turn = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""
with recursive d as (
  select doc_id, source, cast(len([x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> '']) as bigint) as size,
    cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':{seed}'), 1, 12)) as bigint) as place
  from {table}),
s as (
  select source, source_size, {max_epochs} * source_size as cap, sum(source_size) over () as total,
    case (row_number() over (order by source nulls last) - 1) % {len(weights)} {turn} end as weight
  from (select source, cast(sum(size) as bigint) as source_size from d group by source) as g),
f as (
  select 0 as round, source, source_size, cap, weight, total, false as clamped from s
  union all
  select round + 1, source, source_size, cap, weight, total,
    clamped or weight * (total - sum(case when clamped then cap else 0 end) over ())
      > cap * sum(case when clamped then 0 else weight end) over ()
  from f where round < (select count(*) from s)),
t as (
  select source, source_size, cast(case when clamped then cap else weight * cast(total - sum(case when clamped then cap else 0 end) over () as double)
      / sum(case when clamped then 0 else weight end) over () end as double) as target
  from f where round = (select count(*) from s)),
r as (
  select source, source_size, target, case when source_size > 0 then least(floor(target / source_size), {max_epochs}) else 0 end as whole from t),
p as (
  select source, place, n, sum(n) over (partition by source order by place) as upto
  from (select source, place, sum(size) as n from d group by source, place) as q),
c as (
  select p.source, max(p.place) as place from p join r on p.source is not distinct from r.source
  where 2 * p.upto - p.n <= 2 * (r.target - r.whole * r.source_size) group by p.source)
select d.doc_id, d.size, r.source_size, r.target,
  cast(d.size * least({max_epochs}, r.whole + case when d.place <= c.place then 1 else 0 end) as bigint) as taken
from d join r on d.source is not distinct from r.source left join c on d.source is not distinct from c.source"""
