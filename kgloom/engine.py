"""Runs of the whole pipeline: all iterations are one job, results are tables partitioned by iteration (and evaluator)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions import parse, text
from kgloom.operators import denoise, funnel, kg, knn, match, metrics, prompts, retrieve, state
from kgloom.operators.judge import Judge
from kgloom.operators.ledger import Ledger, work_table
from kgloom.sources import readers, sinks

NAMES = match.NAMES
#: What an evaluation's rows can be.
KINDS = ("similar", "equivalent", "exact", "correct", "wrong", "new", "new_beyond_exact", "conflict", "removal", "new_without_conflict")

GENERATED = T.StructType([T.StructField("iteration", T.LongType()), *[T.StructField(n, T.StringType()) for n in NAMES], T.StructField("matched", T.BooleanType())])
EVALUATED = T.StructType([T.StructField("evaluator", T.StringType()), T.StructField("iteration", T.LongType()), T.StructField("kind", T.StringType()), *[T.StructField(n, T.StringType()) for n in (*funnel.GEN, *NAMES)]])
CHUNKS = T.StructType([T.StructField("iteration", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("chunk", T.StringType())])

DONE = T.StructType([T.StructField("step", T.StringType()), T.StructField("iteration", T.LongType())])


@dataclass
class Engine:
    """graph: head, relation, tail; vectors: id, vec of entities; generator: answers a prompt with triples; evaluators: by name the judges of a funnel, and optionally conflict.

    method, encode: how chunks are retrieved (retrieve.METHODS or DENSE, which need an encoder). enable: strategies
    (prompts.STRATEGIES); criteria: the criteria of the prompt for triples (prompts.criteria); denoisers: the judges
    keywords and text of denoising_doc. start: the first iteration; with resume "missing" those from there on that aren't
    done are next, with "after_last" those after the last one done where start is 0. Either way an iteration of which a
    prompt went without an answer is not done: it has no rows until a later run got the answers that lack, and only
    those are asked for (see Ledger). per_day bounds each step's calls of a day.
    """

    spark: SparkSession
    folder: str
    graph: DataFrame
    vectors: DataFrame
    generator: Judge
    evaluators: dict[str, dict[str, Judge]] = field(default_factory=dict)
    top_k: int = 3
    retmax: int = 10
    candidates: int = 6
    strictness: str = "strict"
    start: int = 0
    resolve_conflicts: bool = False
    method: str = "bm25s"
    encode: Callable[[Column], Column] | None = None
    enable: tuple[str, ...] = ()
    criteria: Column | str = ""
    denoisers: dict[str, Judge] = field(default_factory=dict)
    rounds: int = 3
    resume: str = "missing"
    per_day: int | None = None

    def __post_init__(self):
        prompts.checked(self.enable)
        if self.resume not in ("missing", "after_last"):
            raise ValueError(f"no way to resume {self.resume!r}")
        if "denoising_doc" in self.enable and not {"keywords", "text"} <= set(self.denoisers):
            raise ValueError("denoising_doc needs denoisers for keywords and text")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as stored in the run's work folder."""
        return work_table(self.spark, self._path("work"))(df, name)

    @cached_property
    def ledger(self) -> Ledger:
        """What models answered is never asked for again."""
        return Ledger(self.spark, self._path("asked"), self._keep, self.per_day)

    def _delete(self, name: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _clear(self) -> None:
        self._delete("work")

    def _done(self) -> DataFrame:
        return readers.results_or_empty(self.spark, self._path("done"), DONE)

    def done(self, step: str) -> DataFrame:
        """Iterations that a step has dealt with, whether or not they gave rows."""
        return self._done().where(F.col("step") == step).select("iteration")

    def _mark(self, iterations: DataFrame, *steps: str) -> None:
        named = iterations.select(F.explode(F.array(*map(F.lit, steps))).alias("step"), F.col("iteration").cast("long").alias("iteration"))
        named.distinct().write.mode("append").parquet(self._path("done"))

    def _todo(self, every: DataFrame, done: DataFrame, step: str) -> DataFrame:
        """Rows of every whose iterations are next."""
        done = done.distinct()
        if self.resume == "missing":
            return every.where(F.col("iteration") >= self.start).join(done, "iteration", "left_anti")
        waiting = self.dead_letters().where(F.col("step").startswith(f"{step}:")).select("iteration")
        following = state.from_start(every.select("iteration"), done, self.start)
        return every.join(following.union(waiting).distinct(), "iteration", "left_semi")

    def generated(self) -> DataFrame:
        return readers.results_or_empty(self.spark, self._path("generated"), GENERATED)

    def evaluations(self) -> DataFrame:
        return readers.results_or_empty(self.spark, self._path("evaluations"), EVALUATED)

    def used_chunks(self) -> DataFrame:
        """iteration, rank, chunk: what the generator was given."""
        return readers.results_or_empty(self.spark, self._path("chunks"), CHUNKS)

    def dead_letters(self) -> DataFrame:
        """step, iteration, key, prompt, attempts, error: prompts without an answer that iterations wait for."""
        return self.ledger.dead(self._done())

    def timing(self) -> DataFrame:
        """step, iteration, n_prompts, attempts, seconds inside the clients."""
        return self.ledger.timing()

    def chunks(self, keywords: DataFrame, documents: DataFrame) -> DataFrame:
        """iteration, rank, chunk: the best chunks among the articles that hold all keywords of an iteration."""
        articles = readers.fetch(documents, keywords, self.retmax).where(F.length(text.strip(F.col("text"))) > 0)
        pieces = articles.select(F.col("iteration").alias("query_id"), "doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "chunk"))
        queries = keywords.select(F.col("iteration").alias("query_id"), text.keyword_query(F.col("keywords")).alias("query"))
        best = retrieve.retrieve_own(self.method, pieces, queries, self.top_k, self.encode)
        return best.join(pieces, ["query_id", "doc_id", "pos"]).select(F.col("query_id").alias("iteration"), "rank", "chunk")

    def generate(self, keywords: DataFrame, documents: DataFrame | None = None, copied: DataFrame | None = None) -> None:
        """Chunks (or copied ones: iteration, rank, chunk), prompts, answers, triples and matches of the iterations that are next."""
        done = self.generated().select("iteration").union(self.done("generated"))
        todo = self._keep(self._todo(keywords, done, "generated"), "todo")
        given = self._keep(copied.join(todo.select("iteration").distinct(), "iteration", "left_semi") if copied is not None else self.chunks(todo, documents), "chunks")
        waiting = self.spark.createDataFrame([], "iteration long")
        asked, own = todo, given
        if "denoising_doc" in self.enable:
            asked, own, waiting = denoise.in_rounds(todo, given, self.denoisers, self.rounds, lambda step, judge, df: self.ledger.ask(f"generated:{step}", judge, df, lambda x: x), self._keep)
        listed = own.groupBy("iteration").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
        ready = asked.join(listed, "iteration").join(waiting, "iteration", "left_anti")
        prompted = ready.withColumn("prompt", prompts.generate(F.col("keywords"), F.col("chunks"), self.enable, self.criteria))
        answered, lacking = self.ledger.ask("generated:triples", self.generator, prompted, lambda x: x)
        waiting = self._keep(waiting.union(lacking).distinct(), "waiting")
        answers = answered.join(waiting, "iteration", "left_anti").select(F.col("iteration").cast("long").alias("iteration"), F.inline(parse.model_triples(F.coalesce("answer", F.lit("")))))
        sinks.save_results(own.join(waiting, "iteration", "left_anti").select(*[F.col(f.name).cast(f.dataType) for f in CHUNKS]), self._path("chunks"), ("iteration",))
        sinks.save_results(match.flagged(answers, self.graph).select("iteration", *NAMES, "matched"), self._path("generated"), ("iteration",))
        self._mark(todo.join(waiting, "iteration", "left_anti"), "generated")
        self._clear()

    def _unmatched(self, todo: DataFrame) -> DataFrame:
        return self.generated().where(~F.col("matched")).join(todo.select("iteration").distinct(), "iteration", "left_semi")

    def _with_chunks(self, df: DataFrame) -> DataFrame:
        """df with chunks, the text that its iteration's triples came from."""
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"])
        texts = self.used_chunks().groupBy("iteration").agg(prompts.listed(ordered).alias("chunks"))
        return df.join(texts, "iteration", "left").withColumn("chunks", F.coalesce("chunks", F.lit("")))

    def near(self, unmatched: DataFrame) -> DataFrame:
        """The nearest graph entities of both ends of unmatched triples."""
        wanted = kg.ends(unmatched, "id").distinct()
        return knn.nearest(self.vectors.join(wanted, "id", "left_semi"), self.vectors.join(kg.entities(self.graph).withColumnRenamed("entity", "id"), "id", "left_semi"), self.candidates)

    def _asking(self, step: str, own: DataFrame) -> tuple[funnel.Ask, list[DataFrame]]:
        """(a way to ask by the ledger, the iterations that wait for answers, a table for each stage asked). own: iteration and gen_ columns of the triples judged."""
        waiting: list[DataFrame] = []
        ends = own.select("iteration", F.explode(F.array("gen_head", "gen_tail")).alias("query")).distinct()

        def owners(df: DataFrame) -> DataFrame:
            if "iteration" in df.columns:
                return df
            return df.join(ends, "query") if "query" in df.columns else df.join(own, funnel.GEN)

        def ask(stage: str, judge: Judge, df: DataFrame) -> DataFrame:
            answered, lacking = self.ledger.ask(f"{step}:{stage}", judge, df, owners)
            waiting.append(lacking)
            return answered

        return ask, waiting

    def _spread(self, rows: DataFrame, own: DataFrame, kind: str, name: str) -> DataFrame:
        """Results of triples back at each iteration that generated them, or at their own where they have one."""
        keyed = rows if "gen_head" in rows.columns else rows.select(*[c for c in rows.columns if c == "iteration"], *[F.col(c).alias(f"gen_{c}") for c in NAMES], *[F.lit(None).cast("string").alias(c) for c in NAMES])
        found = own.join(keyed, [c for c in own.columns if c in keyed.columns])
        return found.select(F.lit(name).alias("evaluator"), "iteration", F.lit(kind).alias("kind"), *funnel.GEN, *NAMES)

    def evaluate(self, legacy_union: bool = False) -> None:
        """The funnel of each evaluator over the iterations that it hasn't done."""
        every = self.generated().select("iteration").distinct()
        for name, judges in self.evaluators.items():
            known = self.evaluations() if legacy_union else self.evaluations().where(F.col("evaluator") == name)
            todo = self._keep(self._todo(every, known.select("iteration").union(self.done(f"evaluated:{name}")), f"evaluated:{name}"), "todo")
            unmatched = self._keep(self._with_chunks(self._unmatched(todo).select("iteration", *NAMES).distinct()), "unmatched")
            triples, own = unmatched.select(*NAMES).distinct(), unmatched.select("iteration", *[F.col(c).alias(f"gen_{c}") for c in NAMES])
            ask, waiting = self._asking(f"evaluated:{name}", own)
            f = funnel.run(unmatched, self._keep(self.near(triples), "near"), self.graph, judges, self.strictness, self._keep, ask, ("iteration",))
            parts = {"similar": f.similar, "equivalent": f.equivalent, "exact": f.exact, "correct": f.correct, "wrong": f.wrong, "new": f.new_beyond_equivalent, "new_beyond_exact": f.new_beyond_exact}
            if self.resolve_conflicts and "conflict" in judges:
                parts |= self._conflicts(f.similar, own, f.new_beyond_exact, judges["conflict"], ask)
            self._close(name, parts, own, todo, waiting, f"evaluated:{name}", f"exact:{name}")

    def _conflicts(self, similar: DataFrame, own: DataFrame, new: DataFrame, judge: Judge, ask: funnel.Ask) -> dict[str, DataFrame]:
        pairs = similar.join(own, [c for c in own.columns if c in similar.columns])
        found, removal = funnel.detect_conflicts(self._with_chunks(pairs), judge, self._keep, ask, ("iteration", "chunks"))
        return {"conflict": found, "removal": removal, "new_without_conflict": funnel.resolve(new, removal)[0]}

    def _close(self, name: str, parts: dict[str, DataFrame], own: DataFrame, todo: DataFrame, waiting: list[DataFrame], *steps: str) -> bool:
        """Saves and marks the iterations that have all answers; whether these are all."""
        waits = self._keep(reduce(DataFrame.union, waiting).distinct(), "waiting")
        self._save(parts, own.join(waits, "iteration", "left_anti"), name)
        self._mark(todo.join(waits, "iteration", "left_anti"), *steps)
        complete = waits.isEmpty()
        self._clear()
        return complete

    def _save(self, parts: dict[str, DataFrame], own: DataFrame, name: str) -> None:
        """Replaces all that an evaluator's iterations have of the kinds given; other kinds stay as they are."""
        iterations = own.select("iteration").distinct()
        before = self.evaluations().where(F.col("evaluator") == name).join(iterations, "iteration", "left_semi").select(*EVALUATED.names)
        out = before.where(~F.col("kind").isin(*parts))
        for kind, rows in parts.items():
            out = out.unionByName(self._spread(rows, own, kind, name))
        out = self._keep(out, "rows")
        emptied = before.select("iteration").distinct().join(out.select("iteration").distinct(), "iteration", "left_anti").collect()
        sinks.save_results(out, self._path("evaluations"), ("evaluator", "iteration"))
        for r in emptied:  # an overwrite by partitions leaves those without rows
            self._delete(f"evaluations/evaluator={name}/iteration={r.iteration}")

    def _rows(self, name: str, kind: str, *columns: str) -> DataFrame:
        """iteration and the columns given of an evaluator's rows of a kind."""
        return self.evaluations().where((F.col("evaluator") == name) & (F.col("kind") == kind)).select("iteration", *columns).distinct()

    def _triples(self, name: str, kind: str) -> DataFrame:
        """Generated triples of a kind, at each iteration."""
        return self._rows(name, kind, *[F.col(g).alias(c) for g, c in zip(funnel.GEN, NAMES)])

    def evaluate_exact(self) -> None:
        """Exact equivalence, and new knowledge beyond it, for the iterations that were evaluated without it; nothing else is asked."""
        for name, judges in self.evaluators.items():
            mine = self.evaluations().where(F.col("evaluator") == name)
            seen = mine.select("iteration").union(self.done(f"evaluated:{name}")).distinct()
            has = mine.where("kind = 'exact'").select("iteration").union(self.done(f"exact:{name}")).distinct()
            lacking = self._keep(seen.join(has, "iteration", "left_anti"), "lacking")
            pairs = self._keep(self._rows(name, "equivalent", *funnel.GEN, *NAMES).join(lacking, "iteration", "left_semi"), "pairs")
            own = self._keep(self._unmatched(lacking).select("iteration", *[F.col(c).alias(f"gen_{c}") for c in NAMES]).distinct(), "own")
            ask, waiting = self._asking(f"exact:{name}", own)
            exact = self._keep(funnel.agreed(pairs, judges["exact"], ask=ask, stage="exact"), "exact")
            correct = self._triples(name, "correct").join(lacking, "iteration", "left_semi")
            known = exact.select("iteration", *[F.col(g).alias(c) for g, c in zip(funnel.GEN, NAMES)]).distinct()
            self._close(name, {"exact": exact, "new_beyond_exact": correct.join(known, ["iteration", *NAMES], "left_anti")}, own, lacking, waiting, f"exact:{name}")

    def resolve(self) -> None:
        """Conflicts again for all iterations, asked anew; a run that went without some answers is taken up by the next one."""
        for name, judges in self.evaluators.items():
            own = self._keep(self._unmatched(self.generated()).select("iteration", *[F.col(c).alias(f"gen_{c}") for c in NAMES]).distinct(), "own")
            turn = self.done(f"resolved:{name}").count()
            ask, waiting = self._asking(f"resolved-{turn}:{name}", own)
            similar = self._rows(name, "similar", *funnel.GEN, *NAMES)
            parts = self._conflicts(similar, own, self._triples(name, "new_beyond_exact"), judges["conflict"], ask)
            if self._close(name, parts, own, own, waiting, f"resolved-{turn}:{name}"):
                self._mark(self.spark.createDataFrame([(turn,)], "iteration long"), f"resolved:{name}")

    def collect(self) -> DataFrame:
        """Generated counts of each iteration with a map from evaluator to how many rows it has, in all and (kinds) of each kind."""
        counts = self.evaluations().groupBy("evaluator", "iteration", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("evaluator", "iteration").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"), F.sum("n").alias("n_rows"))
        made = self.generated().groupBy("iteration").agg(F.count(F.lit(1)).alias("n_generated"), F.count(F.when(F.col("matched"), 1)).alias("n_matched"))
        return state.combined(made, counts, ["n_rows"])

    def mask(self, keywords: DataFrame, tag: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The graph's triples, entities and relations that keywords touch; written as text files where a tag is given, triples in the order of the graph's line_no where it has one."""
        order = "line_no" if "line_no" in self.graph.columns else None
        ordered = kg.mask(self.graph, keywords, order)
        triples = ordered.select(*NAMES)
        out = triples, kg.entities(triples), kg.relations(triples)
        if tag:
            sinks.save_mask(ordered, *out[1:], self.folder, tag, order)
        return out

    def metrics(self, keywords: DataFrame) -> DataFrame:
        """Cumulative recall and precision of generated triples against the masked graph, by iteration."""
        return metrics.cumulative(self.generated(), self.mask(keywords)[0], NAMES)

    def level_metrics(self, keywords: DataFrame) -> DataFrame:
        """evaluator, iteration, level and the cumulative recall and precision at each level, from what is saved."""
        return metrics.cumulative_levels(self.generated(), self.evaluations(), self.mask(keywords)[0], NAMES)

    def run(self, mode: str, **inputs):
        """One of the modes by name: generate, eval, generate_and_eval, metric, mask, eval_exact_equiv, conflict_resolve, plot_all (the series behind the plots of all evaluators and levels)."""
        if mode in ("generate", "generate_and_eval"):
            self.generate(**inputs)
        if mode in ("eval", "generate_and_eval"):
            self.evaluate()
            return self.collect()
        modes = {"generate": self.generated, "metric": self.metrics, "mask": self.mask, "eval_exact_equiv": self.evaluate_exact, "conflict_resolve": self.resolve, "plot_all": self.level_metrics}
        if mode not in modes:
            raise ValueError(f"no mode {mode!r}")
        return modes[mode](**({} if mode == "generate" else inputs))
