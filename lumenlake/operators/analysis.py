"""Error analysis, confusion, graded relevance, model choice and series of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import settled
from .selection import with_quantiles

NO_RANK = 1_000_000_000


def error_records(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits: query_id, product_id, category, similarity, rank (products); queries: query_id, product_id, category.
    One row for each query: what came first, the best positive that was seen, and by how much it lost."""
    own = queries.select("query_id", F.col("product_id").alias("own"), F.col("category").alias("own_category"))
    rows = hits.join(own, "query_id")
    positive = F.col("product_id") == F.col("own")
    out = rows.groupBy("query_id", "own", "own_category").agg(
        F.min(F.when(positive, F.col("rank"))).alias("first_rank"),
        F.min_by("product_id", "rank").alias("top_product"),
        F.min_by("category", "rank").alias("top_category"),
        F.min_by("similarity", "rank").alias("top_similarity"),
        F.max(F.when(positive, F.col("similarity"))).alias("positive_similarity"),
    )
    wrong = F.col("top_product") != F.col("own")
    margin = F.when(wrong, F.round(F.col("top_similarity") - F.col("positive_similarity"), 10))
    return out.withColumn("top1_correct", ~wrong).withColumn("top5_correct", F.coalesce(F.col("first_rank") <= 5, F.lit(False))).withColumn("margin", margin)


def error_summary(records: DataFrame, *keys: str) -> DataFrame:
    wrong = ~F.col("top1_correct")
    return records.groupBy(*keys).agg(
        F.count("*").alias("queries"), F.sum(wrong.cast("long")).alias("top1_errors"), F.round(F.avg(wrong.cast("double")), 6).alias("top1_error_rate"), F.sum((~F.col("top5_correct")).cast("long")).alias("top5_errors"),
        F.round(F.avg("first_rank"), 6).alias("mean_rank"), F.expr("median(first_rank)").alias("median_rank"), F.round(F.avg("margin"), 6).alias("mean_margin"),
    )


def error_confusion(records: DataFrame) -> DataFrame:
    """Categories of wrong first products."""
    return records.where("not top1_correct").groupBy(F.col("own_category").alias("category"), "top_category").agg(F.count("*").alias("n"))


def representatives(records: DataFrame, n: int = 5, per_category: int = 3) -> DataFrame:
    """The first n records of each bucket, and the first per_category of each category of the stratified ones."""
    # Each bucket reads them.
    records = settled(records)
    rank, margin = F.coalesce("first_rank", F.lit(NO_RANK)), F.coalesce("margin", F.lit(float("inf")))
    buckets = {
        "top1_success": (F.col("top1_correct"), [F.desc("top_similarity")]),
        "top1_failure": (~F.col("top1_correct"), [F.desc("top_similarity")]),
        "near_miss": (~F.col("top1_correct") & F.col("top5_correct"), [margin.asc()]),
        "top5_failure": (~F.col("top5_correct"), [rank.asc()]),
        "not_found": (F.col("first_rank").isNull(), [F.desc("top_similarity")]),
        "large_margin": (F.col("margin").isNotNull(), [F.desc("margin")]),
        "same_category_error": (~F.col("top1_correct") & (F.col("top_category") == F.col("own_category")), [F.desc("top_similarity")]),
        "cross_category_error": (~F.col("top1_correct") & (F.col("top_category") != F.col("own_category")), [F.desc("top_similarity")]),
    }
    # Of each category, the first of those that aren't among ten and of those that look alike.
    stratified = {
        "category_top10_failure": (F.col("first_rank").isNull(), [rank.asc()]),
        "category_high_similarity": (~F.col("top1_correct"), [F.desc("top_similarity")]),
    }
    out = None
    for name, (member, order) in stratified.items():
        place = F.row_number().over(Window.partitionBy("own_category").orderBy(*order, "query_id"))
        part = records.where(member).withColumn("place", place).where(F.col("place") <= per_category).select(F.lit(name).alias("bucket"), "place", "query_id")
        out = part if out is None else out.unionByName(part)
    for name, (member, order) in buckets.items():
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order, "query_id"))
        part = records.where(member).orderBy(*order, "query_id").limit(n).select(F.lit(name).alias("bucket"), place.alias("place"), "query_id")
        out = part if out is None else out.unionByName(part)
    return out


def rank_stability(ranked: DataFrame, baseline: str) -> DataFrame:
    """ranked: query_id, variant, product_id, category, rank. Of each query and variant, against the variant `baseline`: how
    many products both lists have, whether the first is the same, how far shared products move on average (null without
    any), the rank of the first product of the baseline's first category (null if there is none), and whether the first
    product is of it. A variant without hits, of a query that the baseline has, counts with none shared; a query that the
    baseline lacks is left out."""
    base = ranked.where(F.col("variant") == baseline).select("query_id", F.col("product_id").alias("b_product"), F.col("category").alias("b_category"), F.col("rank").alias("b_rank"))
    first = base.groupBy("query_id").agg(F.min_by(F.struct("b_product", "b_category"), "b_rank").alias("b"), F.count("*").alias("wanted"))
    names = ranked.select("variant").distinct()
    rows = ranked.join(base.select("query_id", F.col("b_product").alias("product_id"), "b_rank"), ["query_id", "product_id"], "left")
    rows = first.crossJoin(F.broadcast(names)).join(rows, ["query_id", "variant"], "left")
    of_category = F.col("category") == F.col("b.b_category")
    return rows.groupBy("query_id", "variant").agg(
        F.first("wanted").alias("wanted"), F.count("b_rank").alias("shared"),
        F.coalesce(F.max((F.col("rank") == 1) & (F.col("product_id") == F.col("b.b_product"))), F.lit(False)).alias("same_first"),
        F.avg(F.abs(F.col("rank") - F.col("b_rank"))).alias("moved"), F.min(F.when(of_category, F.col("rank"))).alias("first_of_category"),
        F.coalesce(F.max((F.col("rank") == 1) & of_category), F.lit(False)).alias("passed"),
    )


def stability_report(rows: DataFrame) -> DataFrame:
    """rank_stability() of each variant over all queries."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return rows.groupBy("variant").agg(F.count("*").alias("queries"), F.round(F.avg(F.try_divide("shared", "wanted")), 6).alias("overlap"), mean("same_first"), mean("moved"), mean("passed"))


def confusion_matrix(hits: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(category, predicted, n) of first results, zeros included. A query with two first results is an error."""
    first = hits.where("rank = 1").withColumn("times", F.count("*").over(Window.partitionBy("query_id")))
    n = F.when(F.col("times") > 1, F.raise_error(F.lit("a query has two first results"))).otherwise(F.lit(1)).cast("long")
    seen = first.groupBy(F.col("own_category").alias("category"), F.col("category").alias("predicted")).agg(F.sum(n).alias("n"))
    names = hits.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    cells = names.crossJoin(names.withColumnRenamed("category", "predicted"))
    return cells.join(seen, ["category", "predicted"], "left").fillna(0, ["n"])


def relevance(annotations: DataFrame, least: int = 2) -> DataFrame:
    """annotations: query_id, query_category, rank (1..10), relevance (0..3). Metrics of each query; a label of `least`
    or more is relevant; the ideal order is that of the query's own labels."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank"))
    rows = annotations.withColumn("ideal", ideal).withColumn("good", (F.col("relevance") >= least).cast("double"))
    gain = lambda place, k: F.sum(F.when(F.col(place) <= k, F.col("relevance") / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    within = lambda c, k: F.when(F.col("rank") <= k, F.col(c)).otherwise(0.0)
    columns = []
    for k in (1, 5, 10):
        columns += [F.max(within("good", k)).alias(f"hit{k}"), (F.sum(within("good", k)) / k).alias(f"precision{k}"), (F.sum(within("relevance", k)) / k).alias(f"relevance{k}")]
    for k in (5, 10):
        columns.append(F.when(gain("ideal", k) > 0, gain("rank", k) / gain("ideal", k)).otherwise(0.0).alias(f"ndcg{k}"))
    return rows.groupBy("query_id", "query_category").agg(*columns)


def annotation_violations(annotations: DataFrame) -> DataFrame:
    """Queries whose labels aren't whole: ranks must be 1 to 10, labels 0 to 3."""
    rows = annotations.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"), F.sum((F.col("relevance").isNull() | ~F.col("relevance").between(0, 3)).cast("long")).alias("bad_labels"))
    wrong = F.col("ranks") != F.sequence(F.lit(1), F.lit(10))
    return rows.where(wrong | (F.col("bad_labels") > 0)).select("query_id", wrong.alias("bad_ranks"), "bad_labels")


def failure_classes(annotations: DataFrame, least: int = 2) -> DataFrame:
    """query_id, query_category, first_rank, in_top5, class."""
    good = F.col("relevance") >= least
    rows = annotations.groupBy("query_id", "query_category").agg(F.min(F.when(good, F.col("rank"))).alias("first_rank"), F.sum((good & (F.col("rank") <= 5)).cast("long")).alias("in_top5"))
    # The names of the classes.
    kind = (
        F.when(F.col("first_rank").isNull(), "no_relevant_in_top10")
        .when((F.col("first_rank") == 1) & (F.col("in_top5") >= 2), "relevant_at_top1_with_additional_top5_relevance")
        .when(F.col("first_rank") == 1, "relevant_at_top1_only_or_sparse")
        .when(F.col("first_rank") <= 5, "relevant_in_top5_but_not_top1")
        .otherwise("relevant_only_in_ranks_6_to_10")
    )
    return rows.withColumn("class", kind)


def failure_records(annotations: DataFrame, least: int = 2) -> DataFrame:
    """failure_classes() with the relevant ranks (array), how many labels of 0 to 3 there are (array of four), the first
    label, and how many of the first 5 and 10 are relevant. A query has ten rows, so the arrays are short."""
    ranks = F.array_sort(F.collect_list(F.when(F.col("relevance") >= least, F.col("rank").cast("long"))))
    labels = F.array(*(F.sum((F.col("relevance") == k).cast("long")) for k in range(4)))
    rows = annotations.groupBy("query_id").agg(ranks.alias("relevant_ranks"), labels.alias("labels"), F.max(F.when(F.col("rank") == 1, F.col("relevance"))).alias("top1_relevance"))
    return failure_classes(annotations, least).join(rows, "query_id").withColumn("in_top10", F.size("relevant_ranks").cast("long"))


def set_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, with the side that has them: equal sets give no rows."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def upper_median(c: str) -> Column:
    """The element at place len // 2 (from 0) of the sorted values: the least value that more than half of them don't
    exceed. It is counted by value, so no group is held as a list."""
    return F.expr(f"percentile_disc(0.500000000001D) within group (order by {c})").cast("long")


def compare_models(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, baseline, candidate, absolute and relative change (null from 0), verdict."""
    unpivot = lambda df, name: df.unpivot([], df.columns, "metric", name)
    rows = unpivot(baseline, "baseline").join(unpivot(candidate, "candidate"), "metric")
    change = F.col("candidate") - F.col("baseline")
    verdict = F.when(change > 0, "improved").when(change < 0, "regressed").otherwise("unchanged")
    return rows.select("metric", F.round("baseline", 6).alias("baseline"), F.round("candidate", 6).alias("candidate"), F.round(change, 6).alias("absolute"), F.round(F.try_divide(change, F.col("baseline")), 6).alias("relative"), verdict.alias("verdict"))


def select_model(results: DataFrame) -> DataFrame:
    """results: model, split, top1, top5, mrr. The best on the validation split by top1, then top5, then mrr, then the
    larger name; other splits or values that aren't finite are errors."""
    fine = (F.col("split") == "valid") & F.forall(F.array("top1", "top5", "mrr"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    order = F.when(fine, F.struct("top1", "top5", "mrr", "model")).otherwise(F.raise_error(F.lit("selection needs finite results of the validation split")))
    return results.agg(F.max(order).alias("b")).select("b.model", "b.top1", "b.top5", "b.mrr")


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Of each value of keys: how many rows, and mean, exact percentiles and extremes of a value."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    out = with_quantiles(out, rows, value, [0.5, 0.95, 0.99], *keys)
    return out.select(*keys, "n", *(F.round(c, 6).alias(n) for n, c in (("mean", F.col("mean")), ("p50", F.col("p")[0]), ("p95", F.col("p")[1]), ("p99", F.col("p")[2]), ("low", F.col("low")), ("high", F.col("high")))))


def recommend(stats: DataFrame, key: str) -> DataFrame:
    """Of the settings whose p95 is at most 3 times their mean, the one of the smallest mean; stable = 0 if there is
    none and all compete."""
    rows = stats.withColumn("stable", (F.col("p95") <= 3 * F.col("mean")).cast("int"))
    return rows.agg(F.max(F.struct("stable", (-F.col("mean")).alias("m"), F.col(key).alias("key"))).alias("b")).select(F.col("b.key").alias(key), "b.stable", (-F.col("b.m")).alias("mean"))


def early_stopping_within(epochs: DataFrame, patience: int, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """run, epoch, best, bad_epochs, stop: a value counts as better only if it passes the best by more than min_delta,
    down or up by mode; the best stands until then. Each value depends on those before, so a run's history (some hundred
    rows) is folded in one row."""
    if not isinstance(patience, int) or isinstance(patience, bool) or patience < 1 or min_delta < 0 or mode not in ("min", "max"):
        raise ValueError("patience must be above 0, min_delta at least 0 and mode 'min' or 'max'")
    history = epochs.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("val_loss").alias("value")))).alias("h"))
    better = "acc.best is null or " + ("x.value < acc.best - d" if mode == "min" else "x.value > acc.best + d").replace("d", repr(float(min_delta)))
    step = f"named_struct('best', if({better}, x.value, acc.best), 'bad', if({better}, 0L, acc.bad + 1L))"
    start = "named_struct('best', cast(null as double), 'bad', 0L, 'rows', cast(array() as array<struct<epoch:bigint,best:double,bad:bigint>>))"
    fold = f"aggregate(h, {start}, (acc, x) -> transform(array({step}), s -> named_struct('best', s.best, 'bad', s.bad, 'rows', concat(acc.rows, array(named_struct('epoch', cast(x.epoch as bigint), 'best', s.best, 'bad', s.bad)))))[0], acc -> acc.rows)"
    rows = history.select("run", F.inline(F.expr(fold)))
    return rows.select("run", "epoch", "best", F.col("bad").alias("bad_epochs"), (F.col("bad") >= patience).alias("stop"))


def epoch_losses(batches: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """batches: keys, batch, loss, samples. Mean losses weighted by samples, over the first `most` batches of each key."""
    rows = batches
    if most is not None:
        rows = rows.withColumn("_b", F.row_number().over(Window.partitionBy(*keys).orderBy("batch"))).where(F.col("_b") <= most)
    return rows.groupBy(*keys).agg(F.count("*").alias("batches"), F.sum("samples").alias("samples"), F.try_divide(F.sum(F.col("loss") * F.col("samples")), F.sum("samples")).alias("loss"))


def confirm_selection(results: DataFrame) -> DataFrame:
    """results: model, split, top1, top5, mrr of valid and test. The model that validation selects, its results of both
    splits, and whether it is the best of the test split as well."""
    chosen = select_model(results.where("split = 'valid'"))
    best = results.where("split = 'test'").agg(F.max(F.struct("top1", "top5", "mrr", "model")).alias("b")).select(F.col("b.model").alias("test_best"))
    own = results.where("split = 'test'").select("model", *(F.col(c).alias(f"test_{c}") for c in ("top1", "top5", "mrr")))
    return chosen.join(own, "model", "left").crossJoin(best).withColumn("confirmed", F.col("model") == F.col("test_best"))


def pivoted(cells: DataFrame, row: str, column: str, value: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows (row, column, value) as a matrix with a column for each of the given values."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.sum(value))


def early_stopping(epochs: DataFrame, patience: int, keys: list[str] | None = None) -> DataFrame:
    """epochs: run, epoch, val_loss. Adds the best loss so far, how many epochs it has stood, and whether to stop. A
    run's history is some hundred rows, so a window by run is bounded."""
    keys = keys or ["run"]
    w = Window.partitionBy(*keys).orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = epochs.withColumn("better", before.isNull() | (F.col("val_loss") < before)).withColumn("best", F.min("val_loss").over(w))
    since = F.max(F.when(F.col("better"), F.col("epoch"))).over(w)
    return rows.withColumn("bad_epochs", F.col("epoch") - since).withColumn("stop", F.col("bad_epochs") >= patience)


#: Images of at least this deviation are never flat; means and pixel ratios of black and white frames.
LOW_STD, BLACK_MEAN, WHITE_MEAN, DARK_RATIO, BRIGHT_RATIO = 12.0, 12.0, 243.0, 0.995, 0.995


def abnormal_reasons(mean: Column, std: Column, dark: Column, bright: Column) -> Column:
    """near_black and near_white, or else near_uniform, of an image whose luminance hardly varies, in an array."""
    black, white = (mean <= BLACK_MEAN) | (dark >= DARK_RATIO), (mean >= WHITE_MEAN) | (bright >= BRIGHT_RATIO)
    found = F.array_compact(F.array(F.when(black, "near_black"), F.when(white, "near_white"), F.when(~black & ~white, "near_uniform")))
    return F.when(std < LOW_STD, found).otherwise(F.array().cast("array<string>"))
