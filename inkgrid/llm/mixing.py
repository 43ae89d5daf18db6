"""Mixing sources to target weights: whole copies first, then a Pareto order sample of fixed size. DataFrame functions only.

A source whose target is r times its size gives floor(r) whole copies of each document for certain. The rest is a
sample without replacement in which a document's inclusion probability p is the fraction that is left of r, so probabilities
differ from source to source. Each document draws u from a hash of its id, and its source's documents are ranked by
(u / (1 - u)) / (p / (1 - p)). The sample's size is fixed in words: it takes ranked documents as long as the words fit, then
passes over those that are too long for the gap (three times), and ends with one more where that comes nearer, so that a
long document leaves no large error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import WORD, forget, keep

#: Documents of one source that one task ranks at most, on average.
RUN = 4096
#: A stated value: 2 to the power 52, as many steps as a draw has.
STEPS = float(1 << 52)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: str) -> DataFrame:
    """(id, source, size, text_hash, further columns): size is the number of words, 0 for a null text."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("text_hash"), *more)


def repeats(sizes: DataFrame) -> DataFrame:
    """(id): the ids, null included, that more than one row has."""
    return keep(sizes.groupBy("id").count().where("count > 1").select("id"), "mix-repeats")


def named(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows: of word_counts(), with a name that each row has alone in its source: the id as text. Rows that share an id add a hash of their text and a
    number within equal rows, which can stand for each other."""
    if repeated.isEmpty():
        return rows.withColumn("name", _plain())
    again = repeated.select(F.col("id").alias("__id"), F.lit(True).alias("__again"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("__id")), "left").drop("__id")
    one = rows.where("__again is null").withColumn("name", _plain())
    more = rows.where("__again").withColumn("__n", F.row_number().over(Window.partitionBy("id", "source", "text_hash").orderBy("size")))
    more = more.withColumn("name", F.concat_ws("\x01", _plain(), F.col("text_hash").cast("string"), F.col("__n").cast("string"))).drop("__n")
    return one.unionByName(more).drop("__again")


def _plain() -> F.Column:
    return F.coalesce(F.col("id").cast("string"), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, n, source_size, target): a row for each source. Sources by code point, null last, weigh `weights` in turn and
    share the sum of all sizes; none gets over `most` times its size, and what is above is shared by weight among the others."""
    s = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("k", (F.row_number().over(order) - 1) % len(weights))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("k").cast("int") + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    # water level: in the order of cap / weight, sources are full as long as the level that the others reach is above that
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.col("before")) / F.col("rest_w"))
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    s = s.withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(all_)["level"])
    target = F.when(F.col("full") | F.col("water").isNull(), F.col("cap")).otherwise(F.col("water") * F.col("w"))
    return s.select("source", "n", "source_size", target.alias("target"))


def draw(name: str, seed: int) -> F.Column:
    """A number in (0, 1) from the name, the same in each run."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name))), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(STEPS)


def _later(passes: int) -> F.Column:
    """Whether one of the first passes took the row: it has words, fits into what was left before the pass, and ranks up to the pass's cut."""
    fits = [
        (F.col("size") <= F.col(f"left{k}")) & ((F.col("rank") < F.col(f"cut{k}.rank")) | ((F.col("rank") == F.col(f"cut{k}.rank")) & (F.col("name") <= F.col(f"cut{k}.name"))))
        for k in range(passes)
    ]
    found = F.lit(False)
    for f in fits:
        found = found | F.coalesce(f, F.lit(False))
    return (F.col("size") > 0) & found


def plan(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7, passes: int = 3) -> DataFrame:
    """sizes: of named(). A row for each source with all that decides on its documents: sure copies, p, and for each pass what was left before it
    (left) and the rank of the last document that it took (cut); and the one that ends the sample (best)."""
    sources = targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("sure", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio))
    sources = sources.withColumn("left0", F.col("target") - F.col("sure") * F.col("source_size"))
    known = keep(sources.coalesce(1), "mix-sources")  # small: its size is known then, and Spark decides on a broadcast
    for k in range(passes):
        rows = ranked(sizes, known, seed).where((F.col("p") > 0) & (F.col("size") > 0) & ~_later(k) & (F.col("size") <= F.col(f"left{k}")))
        rows = rows.select("source", "run", "name", "rank", "size", f"left{k}")
        runs = rows.groupBy("source", "run").agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = keep(runs.select("source", "run", before.alias("base")), f"mix-runs-{k}")
        own = F.sum("size").over(Window.partitionBy("source", "run").orderBy("rank", "name"))
        rows = rows.withColumn("own", own).join(base, rows["source"].eqNullSafe(base["source"]) & (rows["run"] == base["run"])).select(rows["source"], "rank", "name", "size", (F.col("base") + F.col("own")).alias("at"), f"left{k}")
        got = rows.where(F.col("at") <= F.col(f"left{k}")).groupBy("source").agg(F.sum("size").alias("got"), F.max(F.struct("rank", "name")).alias(f"cut{k}"))
        joined = known.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        joined = joined.withColumn(f"left{k + 1}", F.col(f"left{k}") - F.coalesce("got", F.lit(0))).drop("got")
        new = keep(joined.coalesce(1), f"mix-plan-{k}")
        forget(known, base)
        known = new
    # the shortest of the rest, if that comes nearer than the gap
    rest = ranked(sizes, known, seed).where((F.col("p") > 0) & (F.col("size") > 0) & ~_later(passes))
    best = rest.groupBy("source").agg(F.min(F.struct("size", "rank", "name")).alias("best"))
    joined = known.join(best.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = keep(joined.withColumn("best", F.when(F.col("best.size") < 2 * F.col(f"left{passes}"), F.col("best"))).coalesce(1), "mix-plan")
    forget(known)
    return out


def ranked(rows: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """rows: (name, source, size, ...), with the columns of their source, rank and run."""
    k = known.withColumnRenamed("source", "__source")
    u = draw("name", seed)
    out = rows.join(k, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rank = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # p is one number for a source, so equal steps of u cut its ranking into runs of equal length
    return out.withColumns({"rank": rank, "run": F.floor(u * F.ceil(F.col("n") / F.lit(float(RUN))))})


def copies(passes: int = 3) -> F.Column:
    """How often a ranked row is taken."""
    last = F.coalesce((F.col("rank") == F.col("best.rank")) & (F.col("name") == F.col("best.name")), F.lit(False))
    return (F.col("sure") + F.when((F.col("p") > 0) & (_later(passes) | last), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """(id, size, source_size, target, copies, taken), a row for each row of docs: how often the mix takes a document, and its
    words. Whole documents are taken, at most `most` times.

    Null texts and texts without words have size 0 and are never sampled; a null source is a source of its own. Rows that repeat an id, null
    ids too, are drawn each on its own.
    An empty table gives an empty result. Further columns are ignored. The table of sources (a row each) is ordered in one task.
    """
    sizes = keep(word_counts(docs, id_col, text_col, source_col), "mix-sizes")
    repeated = repeats(sizes)
    sizes = named(sizes, repeated) if repeated.isEmpty() else keep(named(sizes, repeated), "mix-named")
    rows = ranked(sizes, plan(sizes, weights, most, seed), seed).withColumn("copies", copies())
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as mix() takes it. The plan of each source is enough to decide on a row where it
    stands, so texts aren't moved unless ids repeat; then rows are written with their names. Nulls, repeated rows and empty tables as in mix()."""
    sizes = keep(word_counts(docs, id_col, text_col, source_col), "mix-sizes")
    row = word_counts(docs.withColumn("__row", F.struct(*docs.columns)), id_col, text_col, source_col, "__row")
    repeated = repeats(sizes)
    if repeated.isEmpty():
        sizes, row = named(sizes, repeated), named(row, repeated)
    else:
        row = keep(named(row, repeated), "mix-named")
        sizes = row.drop("__row")
    out = ranked(row, plan(sizes, weights, most, seed), seed).withColumn("__copies", copies()).where("__copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")
