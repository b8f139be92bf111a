"""Joins across a corpus: near-duplicate sets, shared parameters, duplicate strings, layers, closures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SHARED = 5
#: A side of a join is broadcast only if it was measured to have no more bytes than this.
BROADCAST_BYTES = 32 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the folder that ``spark.checkpoint.dir`` names; a folder of our own only in local mode without one.

    A written table rather than ``checkpoint()``, which computes its input twice.
    """
    context = df.sparkSession.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            found = "file://" + tempfile.mkdtemp(prefix="corposieve-")
        context.setCheckpointDir(found)
        folder = context._jsc.sc().getCheckpointDir()
    path = f"{folder.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if its rows are measured to have ``BROADCAST_BYTES`` at most."""
    width = F.octet_length(F.to_json(F.struct(*df.columns))) + 24
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def similar_pairs(items: DataFrame, percent: int = 85, key: str = "key", shingles: str | Column = "shingles", digest: str | Column = "digest") -> DataFrame:
    """Pairs of items whose shingle sets are alike: ``left_key, right_key, shared, kind``.

    ``exact``: equal digests; ``near``: ``100 * shared >= percent * union``; both share at least
    ``max(5, a tenth of the smaller set)``. Items with equal digests form a class: each is paired with the class's
    first (``exact``), and the first stands for them in near pairs. So no link between different items is lost, and
    no class is expanded into all pairs. ``items`` is read twice; where ``shingles`` is an expression, the second time
    it is worked out for those alone that may have a pair.

    Plan: sets that meet the bound share at least ``need``, so each lacks ``lack = n - need`` shingles of the other at
    most. Of each set its first ``2 * lack + 1`` shingles by hash, its head, are laid side by side: of the first shared ones
    as many as ``lack + 1`` of the smaller set are in both heads, and a set with fewer that another head has, too, goes. Of
    the others, only shingles that two classes or more have can match, so a set with fewer of these than ``need``
    goes before anything is joined. Of what is left, sets must share one of their rarest
    ``size - need + 1`` shingles (those that no other has come first, so that the rest of that prefix is short), at places
    that leave enough shingles behind them. Frequent shingles meet no one.
    """
    need = lambda n: F.ceil(n * percent / 100)
    lack = lambda n: n - need(n)
    head = lambda s: F.struct(F.size(s).alias("n"), F.slice(s, F.lit(1), F.least(F.size(s), 2 * lack(F.size(s)) + 1).cast("int")).alias("head"))
    digest = F.col(digest) if isinstance(digest, str) else digest
    heads = F.filter(F.transform(F.array(F.sort_array(F.array_distinct(shingles))), head), lambda x: x["n"] >= MIN_SHARED)  # an array, so that shingles are made once
    heads = checkpointed(items.select(F.col(key).alias("key"), digest.alias("digest"), F.xxhash64(digest).alias("d"), F.inline(heads)))
    firsts = heads.groupBy("digest").agg(F.min("key").alias("rep"))
    copies = checkpointed(heads.select("key", "digest", "d", "n").join(firsts, "digest").where("key != rep").select("key", "d", "rep", "n"))
    reps = heads.drop("digest").join(_few(copies.select("key", "d")), ["key", "d"], "left_anti")
    met = reps.select("key", F.explode("head").alias("g")).withColumn("df", F.count("*").over(Window.partitionBy("g"))).where("df > 1")
    met = met.groupBy("key").agg(F.count("*").alias("m")).join(reps.select("key", "d", "n"), "key")
    near = checkpointed(met.where(F.col("m") >= F.least(lack(need(F.col("n"))) + 1, need(F.col("n")))).select(F.col("key").alias("_key"), F.col("d").alias("_d")))
    own = items.join(_few(near), (F.col(key) == F.col("_key")) & (F.xxhash64(digest) == F.col("_d")), "left_semi")
    classes = checkpointed(own.select(F.col(key).alias("rep"), F.array_distinct(shingles).alias("s")))
    flat = classes.select("rep", F.size("s").alias("n"), F.explode("s").alias("g"))
    common = flat.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    kept = checkpointed(flat.join(common, "g"))
    need = need(F.col("n"))
    alive = kept.groupBy("rep", "n").agg(F.count("*").alias("m")).where(F.col("m") >= need).select("rep", "m")
    ranked = kept.join(alive, "rep").withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy("df", "g")))
    prefix = ranked.where(F.col("k") <= F.col("m") - need + 1).select("rep", "n", "g", (F.col("m") - F.col("k")).alias("left"))
    a, b = prefix.select(F.col("rep").alias("u"), F.col("n").alias("nu"), "g", F.col("left").alias("lu")), prefix.select(F.col("rep").alias("v"), F.col("n").alias("nv"), "g", F.col("left").alias("lv"))
    sized = (F.col("u") < F.col("v")) & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    # the rarest shingle that both have is the first of all they share: what follows it must do
    placed = (100 + percent) * (1 + F.least("lu", "lv")) >= percent * (F.col("nu") + F.col("nv"))
    first = a.join(b, "g").where(sized)
    pairs = first.groupBy("u", "v").agg(F.max(placed).alias("ok")).where("ok").select("u", "v")
    own = classes.join(alive.select("rep"), "rep", "left_semi")
    full = pairs.join(own.toDF("u", "su"), "u").join(own.toDF("v", "sv"), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - shared
    floor = F.greatest(F.lit(MIN_SHARED), F.ceil(F.least(F.size("su"), F.size("sv")) / 10))
    near = full.where((shared >= floor) & (100 * shared >= percent * union)).select("u", "v", shared.alias("shared"))
    other = near.select(F.col("u").alias("left_key"), F.col("v").alias("right_key"), "shared", F.lit("near").alias("kind"))
    return other.union(copies.select(F.col("rep").alias("left_key"), F.col("key").alias("right_key"), F.col("n").alias("shared"), F.lit("exact").alias("kind")))


def clone_groups(items: DataFrame, key: str, digest: Column) -> DataFrame:
    """``digest, first_key, members`` of values that two or more items share."""
    return items.groupBy(digest.alias("digest")).agg(F.min(key).alias("first_key"), F.count("*").alias("members")).where("members > 1")


def duplicate_values(df: DataFrame, value: str, order: list[str], least_chars: int, least: int) -> DataFrame:
    """Each occurrence but the first of values of ``least_chars`` characters found ``least`` times or more.

    Values are counted with map-side aggregation and joined back: one that a third of all rows hold stays a row a
    task in the count, and its join can be split, as a window over it could not.
    """
    rows = df.where(F.length(value) >= least_chars)
    place = F.struct(*order)
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("occurrences"), F.min(place).alias("_first")).where(F.col("occurrences") >= least)
    return rows.join(counts, F.col(value) == F.col("_v")).where(place != F.col("_first")).drop("_v", "_first")


def parameter_clumps(params: DataFrame, item: str, param: str, least_params: int = 3, least_items: int = 3) -> DataFrame:
    """Parameters that occur in one and the same set of items: ``n_items, params, anchor`` (the last item).

    Sets are compared by their size and two order-free digests of 64 bits and more, so that a parameter of a third of
    all items is pre-aggregated and never gathers its items in one task.
    """
    pairs = params.select(F.col(item).alias("i"), F.col(param).alias("p")).distinct()
    support = pairs.groupBy("p").agg(F.count("*").alias("n_items"), F.sum(F.xxhash64("i").cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(7), "i")).alias("d2"), F.max("i").alias("anchor"))
    same = support.where(F.col("n_items") >= least_items).groupBy("n_items", "d1", "d2", "anchor")
    return same.agg(F.array_sort(F.collect_list("p")).alias("params")).where(F.size("params") >= least_params).select("n_items", "params", "anchor")


def unreferenced(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Declared rows whose key nothing uses."""
    return declared.join(used.select(key).distinct(), key, "left_anti")


def edge_matches(rows: DataFrame, edges: list[tuple[str, str, list[str], list[str]]], source: str, targets: list[str], section: str | None = None) -> DataFrame:
    """Policy edges over rows: ``verdict`` is deny or not_allowed, ``edge`` the source glob.

    An edge is (source glob, deny or allow, target globs, sections). Edges are configuration: each becomes a literal
    predicate, so a row is judged in one pass without a nested-loop join.
    """
    from corposieve.functions.globs import matches_any

    denied, allowed, applies = [], [], []
    for glob, kind, wanted, sections in edges:
        here = matches_any(F.col(source), [glob])
        if section and sections:
            here = here & F.col(section).isin(*sections)
        hit = matches_any(F.col(targets[0]), wanted)
        for t in targets[1:]:
            hit = hit | F.coalesce(matches_any(F.col(t), wanted), F.lit(False))
        if kind == "deny":
            denied.append(F.when(here & hit, F.struct(F.lit("deny").alias("verdict"), F.lit(glob).alias("edge"))))
        else:
            applies.append(F.when(here, F.lit(glob)))
            allowed.append(here & hit)
    out = list(denied)
    if applies:
        any_, ok = F.concat_ws(", ", *applies), allowed[0]
        for a in allowed[1:]:
            ok = ok | a
        out.append(F.when((any_ != "") & ~ok, F.struct(F.lit("not_allowed").alias("verdict"), any_.alias("edge"))))
    found = F.filter(F.array(*out), lambda x: x.isNotNull())
    return rows.select("*", F.explode(found).alias("_e")).select(*rows.columns, "_e.verdict", "_e.edge")


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reachable from ``seeds`` (node) along ``edges`` (source, target), cycles included.

    Recursive SQL knows no UNION that would stop on cycles. Each round follows jumps of 1, 2, 4, ... edges, so that a
    chain takes a number of rounds that grows as the logarithm of its length; where the table of jumps would become
    several times that of edges, rounds go on edge by edge.
    """
    step = checkpointed(edges.select("source", "target").where("source != target").distinct())
    most = 4 * step.count() + 1000
    seen, jump, doubling = checkpointed(seeds.select("node").distinct()), step, True
    while True:
        reached = jump.join(seen, F.col("source") == F.col("node"), "left_semi").select(F.col("target").alias("node"))
        seen = checkpointed(seen.union(reached).distinct())
        ahead = step.join(seen, F.col("source") == F.col("node"), "left_semi").select(F.col("target").alias("node"))
        if ahead.join(seen, "node", "left_anti").isEmpty():
            return seen
        if doubling:
            twice = jump.toDF("source", "middle").join(jump.toDF("middle", "target"), "middle").select("source", "target").where("source != target").distinct()
            twice = checkpointed(twice)
            doubling = twice.count() <= most
            jump = twice if doubling else step


def test_only(roots_production: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that production roots don't reach over edges that need no test configuration."""
    production = closure(roots_production, edges.where("not requires_test"))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return nodes.join(production, "node", "left_anti")


def preceding(df: DataFrame, group: list[str], order: str, flag: Column, stop: Column, reach: int = 3) -> DataFrame:
    """``df`` with ``preceded``: among up to ``reach`` rows before, one has ``flag`` and none between has ``stop``."""
    w = Window.partitionBy(*group).orderBy(order)
    marked = df.withColumn("_flag", flag).withColumn("_stop", stop)
    hit, open_ = F.lit(False), F.lit(True)
    for k in range(1, reach + 1):
        f, s = F.coalesce(F.lag("_flag", k).over(w), F.lit(False)), F.coalesce(F.lag("_stop", k).over(w), F.lit(True))
        hit = hit | (open_ & ~s & f)
        open_ = open_ & ~s
    return marked.withColumn("preceded", hit).drop("_flag", "_stop")
