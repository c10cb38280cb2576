"""Mixing sources to target weights by pivotal dependent rounding, combined through a reduction tree.

Every document of a source expects the same number of copies, target / size of the source. The whole part
is certain; the fractions are rounded dependently: two fractional documents meet, mass in words moves at random from
one to the other, unbiased, until one of them has no copy or one more, and the other carries the rest on.
So the words of a source never change but for the last fraction left, which is one document's.

The tree: documents are dealt by hash to blocks of about ``fan_in``; each block is folded in one aggregate and
keeps at most one fractional document, which goes on to the next level. Levels are written to the shared
folder. Only DataFrame functions run; draws are hashes of the ids and the seed, so reruns agree.

Null texts and texts without words have size 0, expect the copies of their source like others, but take no
words. A source without words has target 0. Rows may share an id; a null source is a source of its own. Equal rows
are one unit with a multiplicity: as many of them as their expected copies add up to get one more, so targets
hold for them too. Very long texts are rows like others. Rows are told apart by id and 64 bits of hash. Sources
are ranked in unpartitioned windows of one row a source, so their number should stay in the millions. Ties between
sources go by code point. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialize

_WORD = r"[^\x20\x09-\x0D]+"
#: What tells rows apart.
_ROW = "struct<hash:bigint,id:bigint>"
#: Equal rows are written out so many at a time.
_RUN = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes(source, size) to one row per source: source, source_size and target.

    Sources by code point, null last, weigh ``weights`` in turn and share all words by weight; a target stops
    at ``most`` times the source's size, and the excess is shared again by weight until none is above.
    That is min(cap, rate * weight) with one rate for all, found from running sums in order of cap / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on, never per document.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sums = ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    # The first source whose cap is not reached when those before it are at theirs sets the rate.
    level, rate = F.col("left") / F.col("open"), F.col("cap") / F.col("weight")
    found = F.min(F.when(level <= rate, F.struct(rate.alias("cap"), (-F.col("left")).alias("order"), level.alias("rate")))).over(everything)["rate"]
    shared = F.least(F.col("cap").cast("double"), F.coalesce(found * F.col("weight"), F.col("cap").cast("double")))
    return sums.select("source", "source_size", shared.alias("target"))


def _draw(seed: int, *keys) -> Column:
    """A number from 0 up to 1 that depends on the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold() -> Column:
    """Round the fractions of a block: an array of (row, size, p, u1, u2) to (decided rows, the row still fractional)."""

    def step(acc, unit):
        a, b = acc["open"], unit
        mass = lambda p, s: p * s
        # Words that can still move from b to a, and from a to b.
        to_a = F.least(mass(1 - a["p"], a["size"]), mass(b["p"], b["size"]))
        to_b = F.least(mass(a["p"], a["size"]), mass(1 - b["p"], b["size"]))
        up = unit["u"] * (to_a + to_b) < to_b
        fill_a, drain_b = mass(1 - a["p"], a["size"]) <= mass(b["p"], b["size"]), mass(b["p"], b["size"]) <= mass(1 - a["p"], a["size"])
        drain_a, fill_b = mass(a["p"], a["size"]) <= mass(1 - b["p"], b["size"]), mass(1 - b["p"], b["size"]) <= mass(a["p"], a["size"])
        pa = F.when(up, F.when(fill_a, F.lit(1.0)).otherwise(a["p"] + to_a / a["size"])).otherwise(F.when(drain_a, F.lit(0.0)).otherwise(a["p"] - to_b / a["size"]))
        pb = F.when(up, F.when(drain_b, F.lit(0.0)).otherwise(b["p"] - to_a / b["size"])).otherwise(F.when(fill_b, F.lit(1.0)).otherwise(b["p"] + to_b / b["size"]))
        unit_of = lambda x, p: F.struct(x["row"].alias("row"), x["size"].alias("size"), p.alias("p"), x["u"].alias("u"))
        na, nb = unit_of(a, pa), unit_of(b, pb)
        whole_a = F.when(up, fill_a).otherwise(drain_a)
        moved = F.struct(F.concat(acc["done"], F.array(F.when(whole_a, na).otherwise(nb))).alias("done"), F.when(whole_a, nb).otherwise(na).alias("open"))
        return F.when(a["row"].isNull(), F.struct(acc["done"].alias("done"), unit.alias("open"))).otherwise(moved)

    kind = f"struct<row:{_ROW},size:double,p:double,u:double>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))
    return F.aggregate(F.array_sort(F.collect_list(F.struct("row", "size", "p", "u"))), start, step)


def round_copies(units: DataFrame, seed: int = 17, fan_in: int = 64) -> DataFrame:
    """units(source, row, size, p) with 0 < p < 1 to (row, extra): 0 or 1 more copy, so that each source keeps the sum of size * p."""
    level, done = 0, None
    units = units.where("size > 0 and p > 0 and p < 1").select("source", "row", F.col("size").cast("double").alias("size"), "p")
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while most:
        # A source with fewer rows fills fewer of the blocks; the last level has one block a source.
        most = -(-most // fan_in)
        dealt = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "row"), F.lit(most))).withColumn("u", _draw(seed + 1000 + level, "row"))
        folded = materialize(dealt.groupBy("source", "block").agg(_fold().alias("f")).select("source", "f.*"), "mixing")
        rounded = folded.select(F.inline("done")).select("row", F.col("p").cast("int").alias("extra"))
        rest = folded.select("source", "open.row", "open.size", "open.p", "open.u")
        whole = rest.where("p <= 0 or p >= 1").select("row", F.col("p").cast("int").alias("extra"))
        rest = rest.where("p > 0 and p < 1")
        if most == 1:
            last = rest.select("row", (_draw(seed - 1, "row") < F.col("p")).cast("int").alias("extra"))
            rounded = rounded.unionByName(last)
        parts = rounded.unionByName(whole)
        done = parts if done is None else done.unionByName(parts)
        if most == 1:
            break
        units, level = rest.drop("u"), level + 1
    return done if done is not None else units.select("row", F.lit(0).alias("extra"))


def row_of(mark: Column) -> Column:
    """Tells a row of columns doc_id and source apart, given a hash of its text."""
    return F.struct(F.xxhash64("doc_id", "source", mark).alias("hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, fan_in: int = 64) -> DataFrame:
    """Of each distinct row of docs(doc_id, text, source): row, doc_id, source, size, source_size, target, n (how often it occurs), whole and more.

    Each occurrence gets ``whole`` copies, and ``more`` of them one on top; never more than ``most``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), size.alias("size")), "sizes")
    targets = materialize(source_targets(sizes, weights, most), "targets").withColumnRenamed("source", "of")
    units = sizes.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("n"))
    known = units.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("row", row_of(F.col("mark"))).drop("mark")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = known.withColumn("whole", F.floor(expected)).withColumn("more", F.col("n") * (expected - F.col("whole")))
    known = materialize(known.withColumn("p", F.col("more") - F.floor("more")).withColumn("more", F.floor("more")), "units")
    rounded = known.join(round_copies(known.select("source", "row", "size", "p"), seed, fan_in), "row", "left")
    more = F.when(F.col("whole") < most, F.col("more") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0))
    return rounded.select("row", "doc_id", "source", "size", "source_size", "target", "n", F.least("whole", F.lit(most).cast("long")).alias("whole"), more.cast("long").alias("more"))


def copies_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to ``most``) for each row of docs(doc_id, text, source)."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN)))
    planned = plan_copies(docs, **options).withColumn("run", runs)
    planned = planned.withColumn("i", F.explode(F.sequence(F.col("run") * _RUN, F.least(F.col("n"), (F.col("run") + 1) * _RUN) - 1)))
    return planned.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("i") < F.col("more")).cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target and copies; all rows kept, also those of no copy.

    Columns of docs that bear one of these four names are replaced. Of rows equal in id, source and text those of the
    least hash of their other columns get the copies on top.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    planned = plan_copies(docs, **options).select(F.col("row").alias("_row_of_mix"), "size", "source_size", "target", "whole", "more")
    rest = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "source", "text")], F.lit(0))
    both = docs.withColumn("_row_of_mix", row_of(F.xxhash64("text"))).withColumn("_order_of_mix", rest)
    both = both.alias("d").join(planned.alias("p"), "_row_of_mix")
    at = F.row_number().over(Window.partitionBy("_row_of_mix").orderBy("_order_of_mix"))
    copies = F.col("p.whole") + (at <= F.col("p.more")).cast("long")
    return both.select(*[F.col(f"d.`{c}`") for c in docs.columns], "p.size", "p.source_size", "p.target", copies.alias("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies_of(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
