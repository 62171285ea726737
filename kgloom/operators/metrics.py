"""Metrics over iterations: precision and recall against a gold set, cumulative recall, share of candidates filtered out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)


def against_gold(model: DataFrame, gold: DataFrame, by: list[str], item: list[str], order: str) -> DataFrame:
    """tp, fp, fn over all of order, precision and recall of the last of order and over all (micro), for each of by.

    model, gold: by, order and item columns; repeated rows count once.
    """
    keys = [*by, order, *item]
    m = model.select(*keys).distinct().withColumn("_m", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = m.join(g, keys, "full").select(*by, order, F.coalesce("_m", F.lit(0)).alias("_m"), F.coalesce("_g", F.lit(0)).alias("_g"))
    each = both.groupBy(*by, order).agg(F.sum(F.col("_m") * F.col("_g")).alias("tp"), F.sum(F.col("_m") * (1 - F.col("_g"))).alias("fp"), F.sum((1 - F.col("_m")) * F.col("_g")).alias("fn"))
    last = F.max_by(F.struct("tp", "fp", "fn"), order)
    out = each.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), last.alias("_l"))
    pr = lambda t, p, n: (ratio(t, t + p), ratio(t, t + n))
    (micro_p, micro_r), (last_p, last_r) = pr(F.col("tp"), F.col("fp"), F.col("fn")), pr(F.col("_l.tp"), F.col("_l.fp"), F.col("_l.fn"))
    return out.select(*by, "tp", "fp", "fn", micro_p.alias("precision_micro"), micro_r.alias("recall_micro"), last_p.alias("precision_last"), last_r.alias("recall_last"))


def cumulative(items: DataFrame, relevant: DataFrame, item: list[str], iteration: str = "iteration") -> DataFrame:
    """For each iteration the distinct items so far, how many of them are relevant, recall and precision.

    An item counts from its first iteration on, so sums of new items over iterations give the distinct counts; the
    window runs over one row for each iteration.
    """
    first = items.groupBy(*item).agg(F.min(iteration).alias(iteration))
    known = relevant.select(*item).distinct().withColumn("_r", F.lit(1))
    new = first.join(known, item, "left").groupBy(iteration).agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("r"))
    every = items.select(iteration).distinct().join(new, iteration, "left")
    so_far = W.orderBy(iteration).rowsBetween(W.unboundedPreceding, 0)
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    out = every.withColumns({"n_items": F.sum(F.coalesce("n", F.lit(0))).over(so_far), "n_relevant": F.sum(F.coalesce("r", F.lit(0))).over(so_far)}).join(F.broadcast(total))
    return out.select(iteration, "n_items", "n_relevant", ratio(F.col("n_relevant"), F.col("_total")).alias("recall"), ratio(F.col("n_relevant"), F.col("n_items")).alias("precision"))


def level_metrics(generated: DataFrame, relevant: DataFrame, relaxed: DataFrame, corresponding: DataFrame, item: list[str]) -> DataFrame:
    """Recall and precision of generated items, and of a relaxed level: what corresponds to relaxed matches joins the found for recall, the relaxed matches themselves for precision."""
    g, r = generated.select(*item).distinct(), relevant.select(*item).distinct()
    found = g.join(r, item, "left_semi")
    more = found.union(corresponding.select(*item).join(r, item, "left_semi")).distinct()
    good = found.union(relaxed.select(*item).join(g, item, "left_semi")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(g, "n_generated").join(count(r, "n_relevant")).join(count(found, "n_found")).join(count(more, "n_more")).join(count(good, "n_good"))
    c = F.col
    return one.select("n_generated", "n_relevant", "n_found", ratio(c("n_found"), c("n_relevant")).alias("recall"), ratio(c("n_found"), c("n_generated")).alias("precision"), ratio(c("n_more"), c("n_relevant")).alias("recall_relaxed"), ratio(c("n_good"), c("n_generated")).alias("precision_relaxed"))


def filter_rate(candidates: DataFrame, confirmed: DataFrame, by: list[str]) -> DataFrame:
    """Of each group's candidates: how many there were, were confirmed, were filtered out, and the share of these in percent."""
    kept = confirmed.select(*candidates.columns).distinct().withColumn("_k", F.lit(1))
    out = candidates.distinct().join(kept, candidates.columns, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_original"), F.count("_k").alias("n_filtered"))
    gone = F.col("n_original") - F.col("n_filtered")
    return out.select(*by, "n_original", "n_filtered", gone.alias("n_filtered_out"), (100 * ratio(gone, F.col("n_original"))).alias("percent_filtered_out"))


def filter_summary(candidates: DataFrame, confirmed: DataFrame, model: str, iteration: str = "iteration", key: str = "query") -> DataFrame:
    """model, n_queries, n_original, n_filtered, n_filtered_out, percent_filtered_out of each model's first iteration, all queries together, and rows with a null model for all models.

    candidates, confirmed: model, iteration, key and further columns that tell a candidate; repeated rows count once. The
    first iteration of a model is the least one that has candidates.
    """
    first = candidates.groupBy(model).agg(F.min(iteration).alias(iteration))
    kept = confirmed.select(*candidates.columns).distinct().withColumn("_k", F.lit(1))
    rows = candidates.distinct().join(F.broadcast(first), [model, iteration], "left_semi").join(kept, candidates.columns, "left")  # a row for each model
    each = rows.groupBy(model, key).agg(F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_kept"))
    per_model = each.groupBy(model).agg(F.count(F.lit(1)).alias("n_queries"), F.sum("_n").alias("n_original"), F.sum("_kept").alias("n_filtered"))
    whole = per_model.agg(F.lit(None).cast(dict(candidates.dtypes)[model]).alias(model), *[F.sum(c).alias(c) for c in ("n_queries", "n_original", "n_filtered")]).where("n_original is not null")
    gone = F.col("n_original") - F.col("n_filtered")
    return per_model.union(whole).select(F.col(model), "n_queries", "n_original", "n_filtered", gone.alias("n_filtered_out"), (100 * ratio(gone, F.col("n_original"))).alias("percent_filtered_out"))


def accumulated(items: DataFrame, item: list[str], iteration: str = "iteration") -> DataFrame:
    """For each iteration its items, those that no earlier one had, and both summed so far: with repeats, and distinct."""
    counts = items.groupBy(iteration).agg(F.count(F.lit(1)).alias("n_items"))
    first = items.groupBy(*item).agg(F.min(iteration).alias(iteration)).groupBy(iteration).agg(F.count(F.lit(1)).alias("n_new"))
    every = counts.join(first, iteration, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("long")))
    so_far = W.orderBy(iteration).rowsBetween(W.unboundedPreceding, 0)  # one row for each iteration
    return every.withColumns({"n_accumulated": F.sum("n_items").over(so_far), "n_distinct": F.sum("n_new").over(so_far)})


def level_counts(levels: dict[str, DataFrame], correct: DataFrame, names: list[str]) -> DataFrame:
    """iteration, level, n: distinct generated triples (gen_ columns) with a pair of the level, and those of them that are correct besides (level_and_correct)."""
    good, out = correct.select("iteration", *names).distinct(), None
    for name, pairs in levels.items():
        own = pairs.select("iteration", *[F.col(f"gen_{c}").alias(c) for c in names]).distinct()
        for level, rows in ((name, own), (f"{name}_and_correct", own.join(good, ["iteration", *names], "left_semi"))):
            part = rows.groupBy("iteration").agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.union(part)
    return out


#: Levels at which a generated triple can count as good, and a relevant one as found.
PAIRED = ("similar", "equivalent", "exact")
LEVELS = ("match", *PAIRED, "correct", *(f"{k}_and_correct" for k in PAIRED))


def first_marks(generated: DataFrame, evaluations: DataFrame, relevant: DataFrame, item: list[str]) -> DataFrame:
    """For each evaluator and triple: relevant (boolean), made (the first iteration that generated it), and by level the first iteration of a generated triple (good_...) and of a graph triple that corresponds to one (found_...).

    One aggregation over all levels: each row of a kind becomes the marks of both its triples, with those of
    level_and_correct where the generated one is correct in the same iteration.
    """
    gen = [f"gen_{c}" for c in item]
    at = ["evaluator", "iteration", *gen]
    ok = evaluations.where("kind = 'correct'").select(*at).distinct().withColumn("_ok", F.lit(True))
    pairs = evaluations.where(F.col("kind").isin(*PAIRED)).select(*at, *item, "kind").join(ok, at, "left")
    names = evaluations.select("evaluator").distinct()
    levels = F.concat(F.array("kind"), F.when(F.col("_ok"), F.array(F.concat("kind", F.lit("_and_correct")))).otherwise(F.array().cast("array<string>")))
    marked = pairs.select("evaluator", "iteration", F.explode(levels).alias("level"), *gen, *item)
    mark = lambda side, cols: F.struct(F.concat(F.lit(f"{side}_"), "level").alias("mark"), *[F.col(g).alias(c) for g, c in zip(cols, item)])
    both = marked.select("evaluator", "iteration", F.inline(F.array(mark("good", gen), mark("found", item))))
    correct = ok.select("evaluator", "iteration", F.lit("good_correct").alias("mark"), *[F.col(g).alias(c) for g, c in zip(gen, item)])
    of_all = generated.select("iteration", F.lit("made").alias("mark"), *item).unionByName(relevant.select(F.lit(0).cast("long").alias("iteration"), F.lit("relevant").alias("mark"), *item))
    marks = both.unionByName(correct).unionByName(of_all.join(F.broadcast(names)))  # evaluators are a handful of configured names
    first = lambda mark: F.min(F.when(F.col("mark") == mark, F.col("iteration")))
    goods, founds = [f"good_{x}" for x in LEVELS[1:]], [f"found_{x}" for x in LEVELS[1:] if x != "correct"]
    return marks.groupBy("evaluator", *item).agg(F.coalesce(F.bool_or(F.col("mark") == "relevant"), F.lit(False)).alias("relevant"), *[first(m).alias(m) for m in ("made", *goods, *founds)])


def cumulative_levels(generated: DataFrame, evaluations: DataFrame, relevant: DataFrame, item: list[str]) -> DataFrame:
    """evaluator, iteration, level, n_generated, n_relevant, n_found, n_good, recall, precision: of all that iterations up to this one gave.

    generated: iteration and item columns; evaluations: evaluator, iteration, kind (similar, equivalent, exact, correct
    count), gen_ and item columns; relevant: item columns. A relevant triple is found at a level if it was generated or
    corresponds to a generated one of the level; a generated triple is good if it is relevant or of the level. Each counts
    from its first iteration on, so running sums over the iterations give the counts of the sets accumulated; a window has
    a row for each iteration.
    """
    first = first_marks(generated, evaluations, relevant, item)
    made, known, events = F.col("made"), F.col("relevant"), []
    for level in LEVELS:
        good = F.col(f"good_{level}") if level != "match" else F.lit(None).cast("long")
        found = F.col(f"found_{level}") if f"found_{level}" in first.columns else F.lit(None).cast("long")
        row = lambda what, when, level=level: F.struct(F.lit(level).alias("level"), F.lit(what).alias("what"), when.cast("long").alias("iteration"))
        events += [row("generated", made), row("found", F.when(known, F.least(made, found)))]
        events.append(row("good", F.when(made.isNotNull(), F.when(known, made).when(good.isNotNull(), F.greatest(made, good)))))
    counts = first.select("evaluator", F.inline(F.array(*events))).where("iteration is not null").groupBy("evaluator", "level", "iteration").agg(*[F.count(F.when(F.col("what") == w, 1)).alias(f"n_{w}") for w in ("generated", "found", "good")])
    levels = F.explode(F.array(*map(F.lit, LEVELS))).alias("level")
    every = generated.select("iteration").union(evaluations.select("iteration")).distinct().join(F.broadcast(evaluations.select("evaluator").distinct().select("evaluator", levels)))
    total = relevant.select(*item).distinct().agg(F.count(F.lit(1)).alias("n_relevant"))
    so_far = W.partitionBy("evaluator", "level").orderBy("iteration").rowsBetween(W.unboundedPreceding, 0)
    sums = {f"n_{w}": F.sum(F.coalesce(f"n_{w}", F.lit(0))).over(so_far) for w in ("generated", "found", "good")}
    out = every.join(counts, ["evaluator", "level", "iteration"], "left").withColumns(sums).join(F.broadcast(total))
    return out.select("evaluator", "iteration", "level", "n_generated", "n_relevant", "n_found", "n_good", ratio(F.col("n_found"), F.col("n_relevant")).alias("recall"), ratio(F.col("n_good"), F.col("n_generated")).alias("precision"))


def levels(generated: DataFrame, evaluations: DataFrame, relevant: DataFrame, item: list[str]) -> DataFrame:
    """As cumulative_levels over all iterations at once: evaluator, level, counts, recall and precision, from one aggregation for all levels."""
    first = first_marks(generated, evaluations, relevant, item)
    made, known, rows = F.col("made").isNotNull(), F.col("relevant"), []
    for level in LEVELS:
        has = lambda side, level=level: F.col(f"{side}_{level}").isNotNull() if f"{side}_{level}" in first.columns else F.lit(False)
        rows.append(F.struct(F.lit(level).alias("level"), made.alias("made"), known.alias("known"), (known & (made | has("found"))).alias("found"), (made & (known | has("good"))).alias("good")))
    n = lambda c, name: F.count(F.when(F.col(c), 1)).alias(name)
    out = first.select("evaluator", F.inline(F.array(*rows))).groupBy("evaluator", "level").agg(n("made", "n_generated"), n("known", "n_relevant"), n("found", "n_found"), n("good", "n_good"))
    return out.select("*", ratio(F.col("n_found"), F.col("n_relevant")).alias("recall"), ratio(F.col("n_good"), F.col("n_generated")).alias("precision"))
