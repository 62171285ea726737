"""Quality classifier: a text's own evidence and the record of its host and path, by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import stored

FEATURES = ("log_bytes", "letters", "upper", "digits", "marks", "blanks", "breaks", "mean_word", "distinct_words", "distinct_pairs", "top_word", "marked_words", "stops")


def features(text: str) -> np.ndarray:
    """Numbers of a whole text that tell prose from noise; empty texts have zeros."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(len(FEATURES))
    h = np.bincount(data, minlength=256)
    upper, lower, digits = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    letters, blanks = upper + lower + h[128:].sum(), h[9:14].sum() + h[32]
    marks = n - letters - digits - blanks
    words = text.split()
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    marked = sum(k for w, k in seen.items() if not w[-1].isalnum())
    return np.array([np.log(n), letters / n, upper / max(1, letters), digits / n, marks / n, blanks / n, h[10] / n, (n - blanks) / m / 10, len(seen) / m, pairs / max(1, m - 1), max(seen.values(), default=0) / m, marked / m, h[46] / m])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, centre, scale) by Newton steps; the constant carries no penalty."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def _evidence(model):
    """mapInArrow function: the text's log likelihood ratio of good to bad."""

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if model is None:
                llr = np.zeros(batch.num_rows)
            else:
                (w, centre, scale), offset = model
                x = np.array([features(t.as_py() or "") for t in texts]).reshape(batch.num_rows, len(FEATURES))
                llr = np.clip(((x - centre) / scale) @ w[:-1] + w[-1] - offset, -20, 20)
                llr[np.array([not t.as_py() for t in texts], bool)] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(llr, pa.float64())], names=[*batch.schema.names[:-1], "llr"])

    return evidence


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py() or "").tolist() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def strength(good: Column, n: Column, parent: Column) -> tuple[Column, Column]:
    """Sums over sites by which moments tell how far sites differ from their parent: of squared deviations beyond chance, and of what full independence would give."""
    spread = parent * (1 - parent)
    return F.sum(F.pow(good - n * parent, 2) - n * spread), F.sum(n * (n - 1) * spread)


def concentration(beyond: float | None, most: float | None) -> float:
    """Pseudo-rows that the parent weighs, from the correlation of rows of a site: (1 - r) / r, within 1 and 10,000."""
    r = (beyond or 0.0) / most if most else 0.0
    return 10_000.0 if r <= 1e-4 else min(10_000.0, max(1.0, (1 - r) / r))


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, evidence, prior, quality, keep for each row of docs.

    evidence: log likelihood ratio of the whole text, from a logistic classifier over features that Newton's method fits
    to at most max_labelled labelled rows, chosen by hash. prior: the share of good rows expected of the row's path,
    from all other rows: paths shrink toward their host and hosts toward the corpus by concentrations that the moments
    of all sites give. A labelled row counts in its site as labelled, any other by its classifier's probability, so
    every row of the corpus takes part. quality is the posterior of good; keep is quality >= 0.5.

    host and path are columns of docs: by default the source, and the source with the language. Null sites are a site;
    null and empty texts have evidence 0 and stand by their site; null labels are none; of labels that disagree on an id
    the least counts; without labels evidence is 0 and every prior 0.5. Repeated rows count as rows; an empty table
    gives an empty result. Other columns are ignored.

    Sites are summed by partial aggregation and come back by joins of which Spark splits large partitions; texts are
    read where they lie and never shuffled. The driver sees the labelled sample and a few sums.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if path is None else path
    truth = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    amount = truth.count()
    model = None
    if amount:
        share = min(1.0, (max_labelled + 4 * max_labelled**0.5 + 20) / amount)
        few = truth.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 11)).where(F.col("h") <= F.lit(float(1 << 53)) * share).orderBy("h", "id").limit(max_labelled).select("id", F.col("label").cast("double").alias("y"))
        seen = slim.join(F.broadcast(few), "id").select("y", "text").mapInArrow(_measure, "y double, x array<double>").collect()
        y = np.array([r.y > 0 for r in seen], float)
        if 0 < y.sum() < len(y):
            model = fit_logistic(np.array([r.x for r in seen]), y), float(np.log(y.sum() / (len(y) - y.sum())))
    own = stored(slim.mapInArrow(_evidence(model), f"id {dict(slim.dtypes)['id']}, host string, path string, llr double"), "quality-evidence")
    overall = truth.agg(F.avg("label")).first()[0]
    base = 0.5 if overall is None else min(0.999, max(0.001, float(overall)))
    start = float(np.log(base / (1 - base)))
    rows = own.join(truth, "id", "left").withColumn("good", F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-(F.col("llr") + start)))) if model else F.lit(base))
    rows = stored(rows.select("id", "host", "path", "llr", "good"), "quality-rows")
    paths = rows.groupBy("host", "path").agg(F.sum("good").alias("path_good"), F.count(F.lit(1)).alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    total = hosts.agg(F.sum("host_good"), F.sum("host_n")).first()
    mean = min(0.999, max(0.001, total[0] / total[1])) if total[1] else base
    k_host = concentration(*hosts.agg(*strength(F.col("host_good"), F.col("host_n"), F.lit(mean))).first())
    shrunk = (F.lit(k_host * mean) + F.col("host_good")) / (F.lit(k_host) + F.col("host_n"))
    sites = paths.join(hosts, "host")
    k_path = concentration(*sites.agg(*strength(F.col("path_good"), F.col("path_n"), shrunk)).first())
    joined = rows.join(sites, ["host", "path"])
    others_host = (F.lit(k_host * mean) + F.col("host_good") - F.col("good")) / (F.lit(k_host - 1) + F.col("host_n"))
    prior = (F.lit(k_path) * others_host + F.col("path_good") - F.col("good")) / (F.lit(k_path - 1) + F.col("path_n"))
    scored = joined.select("id", F.col("llr").alias("evidence"), F.least(F.lit(0.999), F.greatest(F.lit(0.001), prior)).alias("prior"))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.ln(F.col("prior") / (1 - F.col("prior"))))))
    return scored.select(F.col("id").alias(id_col), "evidence", "prior", quality.alias("quality")).withColumn("keep", F.col("quality") >= 0.5)
