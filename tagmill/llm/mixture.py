"""Mix sources to target weights: exact block quotas dealt to output shards by a splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import BROADCAST_ROWS, ranked, running_sums, small, split_join, stash, words

#: Fixed values of the query's contract: the repeating weights, the mix's share of all sizes, and the most a source repeats.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Words of one output shard; shards are the next power of two, SHARDS at least.
SHARD_WORDS, SHARDS = 1 << 25, 16
#: Blocks of each shard, and for each source, at least, over all shards.
BLOCKS, SPREAD = 64, 4
#: Documents, or blocks, of one group that a task sums; sources of one group that a draw of the tree takes in turn.
GROUP, SOURCES = 512, 4096
#: Levels of the tree between two tables.
LEVELS = 4
#: Partitions of the mix, at most; each holds whole shards.
PARTITIONS = 8192


def keyed(rows: DataFrame) -> DataFrame:
    """rows with `k`, the source as a key that isn't null and sorts by code point, null last."""
    return rows.withColumn("k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, k, rank, target) from rows (source, source_size, n), one per source.

    Sources by code point, null last, take the weights in turn. What sources get beyond most * source_size goes to the
    others by weight until none is above: each round is one aggregate over the sources, whose sums of whole numbers
    give the others' level.
    """
    listed = stash(ranked(keyed(sizes), "k"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    listed = listed.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("w") * F.lit(level)
        sums = listed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if not sums[2] or sums[3] == capped:
            break
        capped, level = sums[3], ((sums[0] or 0) * share - (sums[1] or 0.0)) / sums[2]
    return listed.withColumn("target", F.least(F.col("cap"), F.col("w") * F.lit(level)) if sums[2] else F.col("cap")).drop("w", "cap")


def _let(name: str, value: str, body: str) -> str:
    """SQL of a body that names a value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL of the number of marked among `drawn` of `total` that the uniform number u picks, by the exact odds.

    Outcomes are taken from the likeliest upwards, then from it downwards, each step by the odds of its neighbour, as far as
    12 standard deviations and 40 more; what lies beyond is less than the last bit of a double.
    """

    def walk(steps: str, odds: str, goal: str, result: str) -> str:
        """s: the total weight of the steps, from the likeliest outcome's weight of 1; c: those whose running weight stays below the goal."""
        step = _let("w", f"t.w * {odds}", f"named_struct('w', w, 's', t.s + w, 'c', t.c + if(t.s + w < {goal}, 1L, 0L))")
        return f"aggregate({steps}, named_struct('w', 1D, 's', 0D, 'c', 0L), (t, k) -> {step}, t -> t.{result})"

    more = "((x.m - k + 1) * (x.d - k + 1) / (k * (x.n - x.m - x.d + k)))"  # odds of k over k - 1
    less = "((k + 1) * (x.n - x.m - x.d + k + 1) / ((x.m - k) * (x.d - k)))"  # odds of k over k + 1
    spread = "sqrt(greatest(0D, coalesce(x.d * try_divide(x.m, x.n) * (1 - try_divide(x.m, x.n)) * try_divide(x.n - x.d, x.n - 1), 0D)))"
    top = "greatest(greatest(0L, x.d + x.m - x.n), least(x.d, x.m, bigint(floor((x.d + 1D) * (x.m + 1D) / (x.n + 2D)))))"
    ends = f"named_struct('top', {top}, 'low', greatest(0L, x.d + x.m - x.n), 'high', least(x.d, x.m), 'reach', bigint(ceil(12 * {spread})) + 40)"
    ups = "if(least(e.high, e.top + e.reach) > e.top, sequence(e.top + 1, least(e.high, e.top + e.reach)), cast(array() as array<bigint>))"
    downs = "if(greatest(e.low, e.top - e.reach) < e.top, sequence(e.top - 1, greatest(e.low, e.top - e.reach)), cast(array() as array<bigint>))"
    chosen = f"""CASE WHEN g.goal <= 0 THEN e.top
        WHEN g.goal <= g.up THEN e.top + least(size(r.ups), {walk("r.ups", more, "g.goal", "c")} + 1)
        ELSE e.top - least(size(r.downs), {walk("r.downs", less, "(g.goal - g.up)", "c")} + 1) END"""
    goal = _let("v", f"named_struct('up', {walk('r.ups', more, '0D', 's')}, 'down', {walk('r.downs', less, '0D', 's')})", "named_struct('up', v.up, 'goal', (1 + v.up + v.down) * x.u - 1)")
    given = f"named_struct('n', bigint({total}), 'm', bigint({marked}), 'd', bigint({drawn}), 'u', {u})"
    return _let("x", given, _let("e", ends, _let("r", f"named_struct('ups', {ups}, 'downs', {downs})", _let("g", goal, chosen))))


def _left_shares(total: str, left: str, seed: int, level: int, name: str) -> Column:
    """Of each of a node's parts, what the left half gets: draw after draw from what is left of the node and of its left half."""
    u = f"((pmod(xxhash64({seed}, {level}, node, p.{name}), {1 << 52}L) + 0.5D) / {float(1 << 52)!r}D)"
    state = "named_struct('total', s.total - p.q, 'left', s.left - y, 'taken', concat(s.taken, array(y)))"
    step = _let("y", hypergeometric("s.total", "p.q", "s.left", u), state)
    start = f"named_struct('total', bigint({total}), 'left', bigint({left}), 'taken', cast(array() as array<bigint>))"
    return F.expr(f"aggregate(parts, {start}, (s, p) -> {step}, s -> s.taken)")


def _sides(names: tuple[str, ...], taken: Column) -> Column:
    """The two children of a node with their shares of the parts; parts of nothing are left out."""

    def side(right: bool) -> Column:
        share = F.zip_with("parts", taken, lambda p, t: F.struct(*[p[n].alias(n) for n in names], (p["q"] - t if right else t).alias("q")))
        return F.struct((F.col("node") * 2 + int(right)).alias("node"), F.filter(share, lambda p: p["q"] > 0).alias("parts"))

    return F.explode(F.array(side(False), side(True)))


def shard_quotas(targets: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """(source, shard, blocks): the blocks of each source that each shard gets; all shards have equally many, each source its quota.

    Each source has its first block; the rest are dealt by target, by rounding running totals of the sources in order.
    `blocks` grows so that there are at least SPREAD blocks to a source. From the root down, a node splits its blocks
    into two halves of equal size. The left half is drawn in two steps, first by groups of SOURCES sources, then within each group by
    source; each draw is hypergeometric from what is left, so a half is a multivariate-hypergeometric draw of the node and
    the two add up exactly. A row holds at most SOURCES sources of a node, or one number for each group.
    """
    q = targets.where("target > 0")
    q = q if "rank" in q.columns else ranked(keyed(q), "k")
    q = q.select("source", "k", F.floor(F.col("rank") / SOURCES).alias("c"), "rank", F.ceil("target").cast("long").alias("t"))
    count, total, first, last = q.agg(F.count(F.lit(1)), F.sum("t"), F.min("c"), F.max("c")).first()
    if not count:
        return q.selectExpr("source", "0 as shard", "t as blocks")
    blocks = max(blocks, -(-SPREAD * count // shards))
    n = shards * blocks
    upto = lambda c: F.expr(f"cast(floor(cast({c} as decimal(20,0)) * cast({n - count} as decimal(14,0)) / cast({total} as decimal(20,0))) as long)")
    q = running_sums(q.withColumn("g", F.floor(F.col("rank") / GROUP)), [], "g", ["rank"], "t").withColumn("upto", F.col("before") + F.col("t"))
    q = q.select("source", "k", "c", (1 + upto("upto") - upto("before")).alias("q"))

    group = F.array_sort(F.collect_list(F.struct("k", "source", "q"))).alias("parts")
    # Each level starts from a table, so no plan holds the sums above more than once.
    parts = stash(q.groupBy("c").agg(group).select(F.lit(0).cast("long").alias("node"), "c", "parts"), "tree")
    heads, sized = None, F.expr("struct(c, aggregate(parts, 0L, (s, p) -> s + p.q) AS q)")
    if first != last:
        heads = stash(parts.select(sized.alias("p")).agg(F.array_sort(F.collect_list("p")).alias("parts")).select(F.lit(0).cast("long").alias("node"), "parts"), "heads")
    width, level = shards, 0
    while width > 1:
        half = width // 2 * blocks
        if heads is None:  # the only group has all of a node's blocks, and half of them are left
            drawn = parts.withColumn("taken", _left_shares(f"{2 * half}", f"{half}", seed + 1, level, "k"))
        else:
            heads = heads.withColumn("taken", _left_shares(f"{2 * half}", f"{half}", seed, level, "c"))
            shares = heads.select("node", F.explode(F.arrays_zip(F.col("parts"), F.col("taken"))).alias("s")).select("node", F.col("s.parts.c").alias("c"), F.col("s.parts.q").alias("all"), F.col("s.taken").alias("left"))
            drawn = parts.join(shares, ["node", "c"]).withColumn("taken", _left_shares("all", "left", seed + 1, level, "k"))
        parts = drawn.select("c", _sides(("k", "source"), F.col("taken")).alias("s")).select("s.node", "c", "s.parts").where("size(parts) > 0")
        width, level = width // 2, level + 1
        if heads is not None and width > 1:
            heads = stash(heads.select(_sides(("c",), F.col("taken")).alias("s")).select("s.node", "s.parts"), "heads")
        if level % LEVELS == 0 or width == 1:
            parts = stash(parts, "tree")
    return parts.select("node", F.explode("parts").alias("p")).select(F.col("p.source").alias("source"), F.col("node").alias("shard"), F.col("p.q").alias("blocks"))


def block_shards(quotas: DataFrame, seed: int = 0) -> DataFrame:
    """(k, block, shard): a source's blocks in permuted order are handed to its shards in turn, as many as each one's quota."""
    quotas = keyed(quotas).select("k", "shard", "blocks")
    totals = quotas.groupBy("k").agg(F.sum("blocks").alias("quota"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / SOURCES)))
    within = F.explode(F.sequence(F.col("part") * SOURCES, F.least(F.col("quota"), (F.col("part") + 1) * SOURCES) - 1))
    blocks = totals.select("k", "quota", part.alias("part")).select("k", "quota", within.alias("block")).withColumn("h", F.xxhash64(F.lit(seed + 1), "k", "block"))
    blocks = blocks.withColumn("g", F.floor((F.col("h") / F.lit(float(1 << 64)) + 0.5) * F.ceil(F.col("quota") / GROUP))).withColumn("one", F.lit(1))
    turns = running_sums(blocks, ["k"], "g", ["h", "block"], "one").select("k", "block", F.col("before").alias("turn"))
    dealt = running_sums(quotas.withColumn("g", F.floor(F.col("shard") / GROUP)), ["k"], "g", ["shard"], "blocks")
    dealt = dealt.select("k", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("blocks") - 1)).alias("turn"))
    return turns.join(dealt, ["k", "turn"]).select("k", "block", F.col("shard").cast("int").alias("shard"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shard_words: int = SHARD_WORDS, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, placements (an array of shard, block, order).

    Each source's documents stand in a keyed random order, a line of source_size words that repeats. The mix takes the
    line's first `target` words, to the nearest whole document: every document floor(target / source_size) times, the
    first ones once more. The taken stretch is cut into the source's quota of equal blocks; the splitting tree says how many
    blocks each shard gets, and a keyed permutation which; a document goes where its middle lies, and is ordered
    within its shard by a further key.

    There are as many shards as the mix has shard_words, so a shard and its blocks stay of one size whatever the corpus. Positions
    in the line are sums over groups of about GROUP documents, dealt by ranges of the key, and over groups, so no source is
    summed by one task. Everything is keyed: reruns agree, whatever the partitioning.

    Null and empty texts have size 0, and are never taken (a copy of nothing has no words). Null sources are a source of
    their own, the last. Repeated rows stand side by side in the line. Other columns are ignored; an empty table gives no rows.
    """
    sized = stash(keyed(docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"))), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(totals, weights, share, most)
    wanted = targets.agg(F.sum("target")).first()[0] or 0
    shards = max(SHARDS, 1 << int(max(wanted, 1) / shard_words).bit_length())
    quotas = shard_quotas(targets, shards, blocks, seed)
    plan = stash(block_shards(quotas, seed), "blocks")
    known = targets.select("k", "source_size", "n", "target").join(keyed(quotas.groupBy("source").agg(F.sum("blocks").alias("quota"))).drop("source"), "k", "left")
    known = stash(known, "known")

    n_bytes, n_docs = targets.agg(F.coalesce(F.sum(40 + F.octet_length("k")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    line = sized.join(F.broadcast(known), "k") if n_bytes <= 16 * BROADCAST_ROWS else split_join(sized, known, ["k"], n_docs)
    line = line.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    line = line.withColumn("g", F.floor((F.col("key") / F.lit(float(1 << 64)) + 0.5) * F.ceil(F.col("n") / GROUP)))
    line = running_sums(line, ["k"], "g", ["key", "doc_id", "size"], "size")

    # Pass p of a document covers [p * source_size + before, ... + size); it is taken if its middle lies within the target.
    passes = range(int(most) + (most > int(most)))
    for p in passes:
        middle = p * F.col("source_size") + F.col("before") + F.col("size") / 2
        block = F.least(F.floor(middle / F.col("target") * F.col("quota")), F.col("quota") - 1)
        # What isn't taken has a block of its own that no shard has, so that it doesn't gather in one task.
        line = line.withColumn(f"block{p}", F.when((F.col("size") > 0) & (middle < F.col("target")), block).otherwise(-1 - F.pmod("key", F.lit(1 << 20))))
    plan_bytes = plan.agg(F.coalesce(F.sum(40 + F.octet_length("k")), F.lit(0))).first()[0]
    for p in passes:  # a row counts as 16 bytes
        line = line.join(small(plan.toDF("k", f"block{p}", f"shard{p}"), plan_bytes // 16), ["k", f"block{p}"], "left")

    place = [F.when(F.col(f"block{p}") >= 0, F.struct(F.col(f"shard{p}").alias("shard"), F.col(f"block{p}").alias("block"), F.xxhash64(F.lit(seed + 2), "doc_id", F.lit(p)).alias("order"))) for p in passes]
    taken = sum((F.when(F.col(f"block{p}") >= 0, F.col("size")).otherwise(0) for p in passes), F.lit(0)).cast("long")
    return line.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.filter(F.array(*place), lambda x: x.isNotNull()).alias("placements"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, as often as they are taken, with all their columns.

    Each shard is shuffled whole: it lies in one partition, its rows in the order of their keys. Rows that repeat a doc_id share
    its placements, of several shards for one key the first; rows without words are never taken; very long texts count whole and move
    whole; an empty table gives no rows.
    """
    taken = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias("id"), F.explode("placements").alias("p"))
    taken = taken.groupBy("id", F.col("p.order").alias("order")).agg(F.min("p.shard").alias("shard"))
    taken = stash(taken, "placements")
    shards = (taken.agg(F.max("shard")).first()[0] or 0) + 1
    joined = docs.select(F.struct("*").alias("row")).join(taken, F.col("row.doc_id").eqNullSafe(F.col("id"))).select("row", "shard", "order")
    width = min(shards, PARTITIONS)
    return joined.repartitionById(width, F.pmod("shard", F.lit(width)).cast("int")).sortWithinPartitions("shard", "order").select("row.*")
