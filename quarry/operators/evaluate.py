"""Relevance evaluation: candidate unions, null-aware metrics, breakdowns, bootstrap, reports, set precision and recall, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import fold

MODES = ("basic", "advanced", "hybrid")
KS = (5, 10, 15)
RELEVANT, PERFECT = 2, 3  # least grades
FAMILIES = ("hit", "strict_hit", "mrr", "strict_mrr", "ndcg")


def gain(grade: Column) -> Column:
    out = None
    for g, v in rules.GAINS.items():
        out = F.when(grade == g, F.lit(v)) if out is None else out.when(grade == g, F.lit(v))
    return out.otherwise(0.0)


def latest_labels(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    value = [c for c in log.columns if c not in keys and c != order]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*value), order).alias("v")).select(*keys, "v.*")


def judged(ranked: DataFrame, labels: DataFrame, keys=("qid", "id")) -> DataFrame:
    """Candidates with their grade; null where nobody judged."""
    return ranked.join(labels.select(*keys, "grade"), list(keys), "left")


def ideal(rows: DataFrame, k: int) -> DataFrame:
    """(qid, ideal): best possible discounted gain at k over all judged candidates of the query, whatever the mode."""
    return ideals(rows, (k,)).select("qid", F.col(f"ideal_{k}").alias("ideal"))


def ideals(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(qid, ideal_<k> ...) for several k in one pass."""
    pool = rows.where("grade is not null").groupBy("qid", "id").agg(F.max("grade").alias("grade"))
    w = Window.partitionBy("qid").orderBy(F.desc(gain(F.col("grade"))), "id")
    share = gain(F.col("grade")) / F.log2(F.col("n") + 1)
    return pool.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(ks)).groupBy("qid").agg(*[F.sum(F.when(F.col("n") <= k, share)).alias(f"ideal_{k}") for k in ks])


def metrics_at(rows: DataFrame, ks: tuple[int, ...] = KS, modes=MODES, queries: DataFrame | None = None) -> DataFrame:
    """(qid, mode) with hit_<k>, strict_hit_<k>, mrr_<k>, strict_mrr_<k>, ndcg_<k> for every k, excluded_null and ideal_zero, for every query and mode, also those without candidates.

    rows: qid, mode, id, rank (from 0), grade or null. Relevant is a grade of RELEVANT or more, perfect one of PERFECT. A metric is null where the unjudged rows could change it; excluded_null tells that some metric is null for that reason, ideal_zero that the first k's ideal gain is 0.
    """
    queries = rows.select("qid").distinct() if queries is None else queries.select("qid").distinct()
    frame = queries.select("qid", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    at = lambda cond: F.min(F.when(cond, F.col("rank")))
    share = gain(F.col("grade")) / F.log2(F.col("rank") + 2)
    stats = rows.where(F.col("rank") < max(ks)).groupBy("qid", "mode").agg(
        at(F.col("grade") >= RELEVANT).alias("rel"), at(F.col("grade") >= PERFECT).alias("perfect"), at(F.col("grade").isNull()).alias("open"), *[F.sum(F.when(F.col("rank") < k, share)).alias(f"dcg_{k}") for k in ks]
    )
    within = lambda name, k: F.coalesce(F.col(name) < k, F.lit(False))

    def hit(first: str, k: int) -> Column:
        return F.when(within(first, k), 1.0).when(within("open", k), None).otherwise(0.0)

    def mrr(first: str, k: int) -> Column:
        unsure = within("open", k) & (~within(first, k) | (F.col("open") < F.col(first)))
        return F.when(unsure, None).when(within(first, k), F.round(1.0 / (F.col(first) + 1), 6)).otherwise(0.0)

    def no_ideal(k: int) -> Column:
        return F.coalesce(F.col(f"ideal_{k}") <= 0, F.lit(True))

    out = frame.join(stats, ["qid", "mode"], "left").join(ideals(rows, ks), "qid", "left")
    columns = []
    for k in ks:
        ndcg = F.when(within("open", k) | no_ideal(k), None).otherwise(F.round(F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"ideal_{k}"), 6))
        columns += [hit("rel", k).alias(f"hit_{k}"), hit("perfect", k).alias(f"strict_hit_{k}"), mrr("rel", k).alias(f"mrr_{k}"), mrr("perfect", k).alias(f"strict_mrr_{k}"), ndcg.alias(f"ndcg_{k}")]
    return out.select("qid", "mode", *columns, within("open", max(ks)).alias("excluded_null"), (~within("open", ks[0]) & no_ideal(ks[0])).alias("ideal_zero"))


def metrics(rows: DataFrame, k: int, modes=MODES, queries: DataFrame | None = None) -> DataFrame:
    """(qid, mode, hit, strict_hit, mrr, strict_mrr, ndcg) at one k; see metrics_at()."""
    return metrics_at(rows, (k,), modes, queries).select("qid", "mode", *[F.col(f"{n}_{k}").alias(n) for n in FAMILIES])


def by_mode(per_query: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over defined values of metrics_at(): hit and mrr are 0 where none is defined, ndcg stays null; queries with a metric that unjudged rows hide, and with an ideal of 0."""
    mean = lambda n: F.round(F.avg(n) if n.startswith("ndcg") else F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n)
    return per_query.groupBy("mode").agg(
        F.count("*").alias("queries"), *[mean(f"{n}_{k}") for k in ks for n in FAMILIES], F.count_if("excluded_null").alias("queries_excluded_null"), F.count_if("ideal_zero").alias("queries_with_ideal_zero")
    )


def by_axis(per_query: DataFrame, tags: DataFrame, axes: dict[str, Column], ks: tuple[int, ...] = KS) -> DataFrame:
    """(axis, bucket, mode, hit_<k> ..., n, low_sample): hit rates of metrics_at() over defined values; n counts the defined ones at the first k, low_sample tells that they are fewer than it.

    axes: name -> array of a query's buckets; no array is the bucket `none`, a null in it `unknown`. One pass over the unpivoted tags.
    """
    bucket = lambda c: F.transform(F.coalesce(c, F.array(F.lit("none"))), lambda x: F.coalesce(x, F.lit("unknown")))
    long = tags.select("qid", F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), bucket(c).alias("buckets")) for n, c in axes.items()])).alias("a")).select("qid", "a.axis", F.explode("a.buckets").alias("bucket"))
    n = F.count(f"hit_{ks[0]}")
    return per_query.join(long, "qid").groupBy("axis", "bucket", "mode").agg(*[F.round(F.coalesce(F.avg(f"hit_{k}"), F.lit(0.0)), 6).alias(f"hit_{k}") for k in ks], n.alias("n"), (n < ks[0]).alias("low_sample"))


def candidate_union(rows: DataFrame, first: int = 8, required: int = 5, most: int = 15, modes=MODES) -> DataFrame:
    """(qid, id, pos, best_rank, best_mode, in_modes): of each query the first candidates by best rank, all that some mode ranks under `required`, and `most` in all, required ones before others."""
    number = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode"))
    best = rows.groupBy("qid", "id").agg(F.min(F.struct("rank", number.alias("m"))).alias("b"), F.array_sort(F.collect_set("mode")).alias("in_modes"))
    best = best.select("qid", "id", F.col("b.rank").alias("best_rank"), F.col("b.m").alias("m"), F.element_at(F.array(*[F.lit(m) for m in modes]), F.col("b.m").cast("int")).alias("best_mode"), "in_modes")
    by_rank = Window.partitionBy("qid").orderBy("best_rank", "m", "id")
    out = best.withColumn("pos", F.row_number().over(by_rank) - 1).withColumn("required", F.col("best_rank") < required)
    out = out.where((F.col("pos") < first) | F.col("required"))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("required"), "pos"))).where(F.col("n") <= most)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1).select("qid", "id", "pos", "best_rank", "best_mode", "in_modes")


def key_conflicts(rows: DataFrame) -> DataFrame:
    """(qid, id, keys) of ids that come with more than one key."""
    return rows.groupBy("qid", "id").agg(F.array_sort(F.collect_set("movie_key")).alias("keys")).where(F.size("keys") > 1)


def bootstrap(values: DataFrame, group: str, item: str, value: str, rounds: int = 1000, seed: str = "42") -> DataFrame:
    """(group, n, mean, half_width): half of the 95 % interval of the mean over resamples. A resample draws n items by hash, so any engine draws alike.

    Items are numbered within their group, draws join on the number; what is shuffled is rounds x n small rows, the grouped sums are combined before the shuffle.
    """
    w = Window.partitionBy(group).orderBy(item)
    numbered = values.where(F.col(value).isNotNull()).select(group, item, value).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    draws = numbered.select(group, "n", "i", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col("r").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.withColumn("pick", (hashed % F.col("n") + 1).cast("int")).select(group, "r", F.col("pick").alias("i"))
    means = drawn.join(numbered.select(group, "i", F.col(value).alias("x")), [group, "i"]).groupBy(group, "r").agg(F.avg("x").alias("m"))
    ends = means.groupBy(group).agg(((F.percentile("m", F.lit(0.975)) - F.percentile("m", F.lit(0.025))) / 2).alias("half_width"))
    base = numbered.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return base.join(ends, group).select(group, "n", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


def bootstrap_seeded(values: list[float], rng, rounds: int = 1000) -> float:
    """Half-width of one small series with a caller's random.Random, which goes on from series to series in the caller's order; for reports that must repeat a seeded stream. An empty series draws nothing and has 0, one value draws and has 0."""
    if rounds <= 0 or not values:
        return 0.0
    means = []
    for _ in range(rounds):
        total = 0.0
        for _ in values:
            total += rng.choice(values)
        means.append(total / len(values))
    means.sort()

    def quantile(q: float) -> float:
        x = q * (len(means) - 1)
        i = int(x)
        return means[i] + (means[min(i + 1, len(means) - 1)] - means[i]) * (x - i)

    return (quantile(0.975) - quantile(0.025)) / 2


def error_report(rows: DataFrame, k: int) -> DataFrame:
    """One row for each (qid, mode): the top k, hits, first relevant and first perfect rank from 1, unjudged rows."""
    item = F.struct((F.col("rank") + 1).alias("rank"), "id", "grade")
    out = rows.where(F.col("rank") < k).groupBy("qid", "mode").agg(
        F.array_sort(F.collect_list(item)).alias("top"), F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank") + 1)).alias("first_relevant_rank"), F.min(F.when(F.col("grade") >= PERFECT, F.col("rank") + 1)).alias("first_perfect_rank"), F.count_if(F.col("grade").isNull()).alias("null_grades")
    )
    return out


def miss_lists(per_query: DataFrame, modes=MODES) -> DataFrame:
    """(qid, missed_in, strict_missed_in, any_miss, all_miss, only_last_miss) of queries with a miss: the modes with hit = 0 and with strict_hit = 0; only_last: just the last mode has hit = 0 and all others have hit = 1, null isn't enough."""
    missed = lambda n: F.array_sort(F.collect_set(F.when(F.col(n) == 0, F.col("mode"))))
    out = per_query.groupBy("qid").agg(missed("hit").alias("m"), missed("strict_hit").alias("s"), F.collect_set(F.when(F.col("hit") == 1, F.col("mode"))).alias("h"))
    others = F.size(F.array_intersect("h", F.array(*[F.lit(x) for x in modes[:-1]]))) == len(modes) - 1
    return out.where((F.size("m") > 0) | (F.size("s") > 0)).select(
        "qid", F.array_join("m", ",").alias("missed_in"), F.array_join("s", ",").alias("strict_missed_in"), (F.size("m") > 0).alias("any_miss"), (F.size("m") == len(modes)).alias("all_miss"), (F.array_contains("m", modes[-1]) & others).alias("only_last_miss"))


def set_prf(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of each field; rows: p_<field> and g_<field> arrays. Precision and recall are 1 where nothing was to be counted."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").alias("p"), F.col(f"g_{f}").alias("g")) for f in fields])).alias("x")).select("x.*")
    n = long.groupBy("field").agg(F.sum(F.size(F.array_intersect("p", "g"))).alias("tp"), F.sum(F.size(F.array_except("p", "g"))).alias("fp"), F.sum(F.size(F.array_except("g", "p"))).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return n.withColumns({"precision": p, "recall": r}).select("field", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))), 6).alias("f1"))


def latency(rows: DataFrame, group: str, ms: str, small: int = 2000) -> DataFrame:
    """Median, nearest-rank 95th percentile (half to even), least and greatest of each group, exactly.

    An approximate quantile sketch brackets each rank (its error is a tenth of the bracket), values under the bracket are only counted, and the few inside are ranked; so no group is sorted or gathered whole.
    """
    v, wanted = F.col(ms), {"median": 0.5, "p95": 0.95}
    own = rows.where(v.isNotNull()).select(group, v.alias("v"))
    cuts = [q + d for q in wanted.values() for d in (-0.001, 0.001)]
    base = own.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", cuts, 10000).alias("cuts"))
    bounds = F.array(*[F.struct(F.lit(name).alias("what"), F.when(F.col("n") <= small, F.col("least")).otherwise(F.get("cuts", F.lit(2 * i))).alias("lo"), F.when(F.col("n") <= small, F.col("most")).otherwise(F.get("cuts", F.lit(2 * i + 1))).alias("hi")) for i, name in enumerate(wanted)])
    placed = own.join(base.select(group, "n", bounds.alias("bounds")), group).select(group, "n", "v", F.explode("bounds").alias("b")).select(group, "n", "v", "b.*")
    under = placed.groupBy(group, "what").agg(F.count_if(F.col("v") < F.col("lo")).alias("under"))
    inside = placed.where(F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("i", F.row_number().over(Window.partitionBy(group, "what").orderBy("v")) - 1).join(under, [group, "what"])
    at = F.col("i") + F.col("under")
    middle = (F.col("n") - 1) / 2
    picked = inside.groupBy(group).agg(
        F.avg(F.when((F.col("what") == "median") & ((at == F.floor(middle)) | (at == F.ceil(middle))), F.col("v"))).alias("median"), F.max(F.when((F.col("what") == "p95") & (at == F.bround(F.lit(0.95) * (F.col("n") - 1)).cast("long")), F.col("v"))).alias("p95")
    )
    return base.join(picked, group).select(group, "n", *[F.round(c, 6).alias(c) for c in ("median", "p95", "least", "most")])


def title_match(title: Column, expected: Column) -> Column:
    """True where the folded title holds one of the expected titles or is held by it; blank ones match nothing."""
    plain = lambda c: F.trim(F.regexp_replace(fold(c), r"[^a-z0-9\s]", ""))
    own = plain(title)
    return (own != "") & F.exists(F.filter(F.transform(expected, plain), lambda e: e != ""), lambda e: F.contains(own, e) | F.contains(e, own))


def smoke(rows: DataFrame, wanted: Column, may_miss: Column | None = None) -> DataFrame:
    """(mode, top1, top3, top10, miss, expected_miss, total): how high the wanted rows stand; a query without one is a miss, an expected one where may_miss holds."""
    allowed = F.lit(False) if may_miss is None else may_miss
    best = rows.groupBy("qid", "mode").agg(F.min(F.when(wanted, F.col("rank"))).alias("r"), F.bool_or(allowed).alias("may"))
    return best.groupBy("mode").agg(*[F.count_if(F.col("r") < k).alias(f"top{k}") for k in (1, 3, 10)], F.count_if(F.col("r").isNull() & ~F.col("may")).alias("miss"), F.count_if(F.col("r").isNull() & F.col("may")).alias("expected_miss"), F.count("*").alias("total"))


def mood_hits(rows: DataFrame, k: int = 10) -> DataFrame:
    """(qid, results, tagged, ok): how many of a query's first k rows have a desired mood; rows: qid, rank, tags, desired."""
    shares = F.coalesce(F.arrays_overlap("tags", "desired"), F.lit(False))
    out = rows.where(F.col("rank") < k).groupBy("qid").agg(F.count("*").alias("results"), F.count_if(shares).alias("tagged"))
    return out.withColumn("ok", F.col("tagged") > 0)
