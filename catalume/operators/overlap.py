"""Two libraries of named member sets: overlaps, renames, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable


def jaccard_pairs(members: DataFrame, least: float = 0.5, same_names: bool = False) -> DataFrame:
    """(name_a, name_b, overlap) of sets of both libraries whose overlap is ``least`` or more, above zero.

    A set of n members that overlaps another by t shares t * n of them, so the two share one of
    their n - t * n + 1 rarest. Only these meet, in sets whose sizes allow the overlap; a
    member of nearly all sets is among the rarest of none but the smallest. What met is then
    counted in full. Equal members count once; null names and members are none.
    """
    m = durable(members.select("library", "name", "pid").where("name is not null and pid is not null").distinct())
    sizes = m.groupBy("library", "name").agg(F.count("*").alias("n"))
    rare = m.groupBy("pid").agg(F.count("*").alias("often"))
    by_rarity = Window.partitionBy("library", "name").orderBy("often", "pid")
    ranked = m.join(rare, "pid").withColumn("at", F.row_number().over(by_rarity)).join(sizes, ["library", "name"])
    heads = durable(ranked.where(F.col("at") <= F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9)) + 1).select("library", "name", "pid", "n"))

    def side(rows: DataFrame, library: str, c: str, *more: Column) -> DataFrame:
        return rows.where(F.col("library") == library).select(F.col("name").alias(f"name_{c}"), "pid", *more)

    met = side(heads, "A", "a", F.col("n").alias("na")).join(side(heads, "B", "b", F.col("n").alias("nb")), "pid")
    met = met.where((F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (F.lit(same_names) | (F.col("name_a") != F.col("name_b"))))
    shared = met.select("name_a", "name_b", "na", "nb").distinct().join(side(m, "A", "a"), "name_a").join(side(m, "B", "b"), ["name_b", "pid"])
    both = shared.groupBy("name_a", "name_b").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select("name_a", "name_b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("overlap")).where(F.col("overlap") >= least)


def drift(members: DataFrame) -> DataFrame:
    """Members of a name that only one of its two libraries has."""
    m = members.select("library", "name", "pid").distinct()
    in_both = m.groupBy("name").agg(F.count_distinct("library").alias("k")).where("k = 2").select("name")
    w = Window.partitionBy("name", "pid")
    return m.join(in_both, "name", "left_semi").withColumn("k", F.count("*").over(w)).where("k = 1").select("name", "pid", F.col("library").alias("only_in"))


def claims(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs by repeated mutual best choice; ties go to the smaller name.

    Each round settles every pair that is best for both of its names; pairs of settled
    names leave. Names that tie all with all (each best for each, and no others) settle in
    one round, in order of name on both sides, as single rounds would pair them. Pair
    tables are small (overlapping sets only); rounds end when none is left, and each
    settles a pair at least. Null names are no names.
    """
    left, out, rounds = durable(pairs.where("name_a is not null and name_b is not null").distinct()), None, 0
    best_a = Window.partitionBy("name_a").orderBy(F.desc("overlap"), "name_b")
    best_b = Window.partitionBy("name_b").orderBy(F.desc("overlap"), "name_a")
    tied_a, tied_b, block = Window.partitionBy("name_a", "overlap"), Window.partitionBy("name_b", "overlap"), Window.partitionBy("ta", "tb", "overlap")
    tied = lambda name, w: F.struct(F.count("*").over(w).alias("n"), F.min(name).over(w).alias("first"), F.bit_xor(F.xxhash64(name)).over(w).alias("names"))
    while not left.isEmpty():
        ranked = left.withColumn("ra", F.row_number().over(best_a)).withColumn("top_a", F.max("overlap").over(Window.partitionBy("name_a"))).withColumn("ta", tied("name_b", tied_a))
        ranked = ranked.withColumn("rb", F.row_number().over(best_b)).withColumn("top_b", F.max("overlap").over(Window.partitionBy("name_b"))).withColumn("tb", tied("name_a", tied_b))
        top = ranked.where("overlap = top_a and overlap = top_b").withColumn("whole", F.count("*").over(block) == F.col("ta.n") * F.col("tb.n"))
        top = top.withColumn("ka", F.dense_rank().over(block.orderBy("name_a"))).withColumn("kb", F.dense_rank().over(block.orderBy("name_b")))
        won = durable(top.where("ra = 1 and rb = 1 or whole and ka = kb").select("name_a", "name_b", "overlap"))
        out, rounds = won if out is None else out.union(won), rounds + 1
        if rounds % 20 == 0:
            out = durable(out)  # keeps the plan short
        left = durable(left.join(won.select("name_a"), "name_a", "left_anti").join(won.select("name_b"), "name_b", "left_anti").select("name_a", "name_b", "overlap"))
    return pairs.select("name_a", "name_b", "overlap").limit(0) if out is None else out


def reconcile(members: DataFrame, least: float = 0.5, doubtful: float = 0.8, false_matches: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``(kind, name, other, overlap, review)``: identical, drifted, rename, only_a, only_b."""
    m = members.select("library", "name", "pid").distinct()
    sets = m.groupBy("name").agg(F.max(F.col("library") == "A").alias("in_a"), F.max(F.col("library") == "B").alias("in_b"))
    drifted = drift(members).select("name").distinct().withColumn("drifted", F.lit(True))
    both = sets.where("in_a and in_b").join(drifted, "name", "left")
    same = both.select(F.when(F.col("drifted"), "drifted").otherwise("identical").alias("kind"), "name", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("overlap"))
    alone = sets.where("not (in_a and in_b)")
    pairs = jaccard_pairs(members, least)
    loose = F.lit(False)
    for a, b in false_matches:
        loose = loose | ((F.col("name_a") == a) & (F.col("name_b") == b))
    pairs = pairs.where(~loose)
    pairs = pairs.join(alone.select(F.col("name").alias("name_a"), F.lit(True).alias("la")), "name_a", "left").join(alone.select(F.col("name").alias("name_b"), F.lit(True).alias("lb")), "name_b", "left").where("la or lb")
    renames = claims(pairs.select("name_a", "name_b", "overlap"))
    named = renames.select(F.lit("rename").alias("kind"), F.col("name_a").alias("name"), F.col("name_b").alias("other"), "overlap")
    taken = renames.select(F.explode(F.array("name_a", "name_b")).alias("name"))
    rest = alone.join(taken, "name", "left_anti").select(F.when(F.col("in_a"), "only_a").otherwise("only_b").alias("kind"), "name", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("overlap"))
    return same.union(named).union(rest).withColumn("review", F.coalesce(F.col("overlap") < doubtful, F.lit(False)))


def union_members(members: DataFrame) -> DataFrame:
    """O7, SNK7: one row per name with its libraries and the union of its members, the first library's titles kept."""
    first = Window.partitionBy("name", "pid").orderBy("library")
    one = members.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    libraries = members.groupBy("name").agg(F.array_sort(F.collect_set("library")).alias("libraries"))
    return one.groupBy("name").agg(F.array_sort(F.collect_list("pid")).alias("members")).join(libraries, "name")
