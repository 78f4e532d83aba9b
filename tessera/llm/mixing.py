"""Mixing to target weights with soft domain membership, with DataFrame operations only.

*Posteriors.* A multinomial naive Bayes classifier over ``buckets`` hashed words is counted from at most
``fit_rows`` rows of a labelled table (those of the smallest hash of doc_id); every document's posterior over the
domains comes from one aggregation over its exploded words, whose log probabilities are a broadcast table of at most
``buckets`` rows. The evidence of long texts is scaled down to ``evidence`` words, so memberships stay soft.

*Rates.* With ``a[d, k] = tokens of d * posterior of k``, rates ``x >= least`` minimise
``(A'x - T)' G^-1 (A'x - T)`` with ``G = A'A`` by projected gradient: in this metric the gradient is
``A G^-1 (A'x - T)`` and its Lipschitz constant is 1, so unit steps are safe and few are needed. Each step is one
aggregation of K sums; a document's rate is a nested expression of the K-vectors seen so far, so no state is kept.

Defined results: null and blank texts have no tokens, the prior as posterior, and the starting rate (1, or ``least``
if larger); a null doc_id is kept; repeated rows share their rate and each counts towards the totals; without labelled rows posteriors are uniform; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import free_names, give_back, materialize
from tessera.llm.decontamination import words_of


def classifier(docs: DataFrame, labelled: DataFrame, domains: dict[str, str], fit_rows: int, buckets: int, smoothing: float) -> tuple[DataFrame, list[float]]:
    """(log probabilities by bucket, for all ``buckets`` and an empty one, log prior)."""
    kind = F.coalesce(*(F.when(F.expr(c), F.lit(k)) for k, c in enumerate(domains.values())))
    rows = labelled.select(F.col("doc_id").alias("_id"), kind.alias("_k")).where("_id is not null and _k is not null").orderBy(F.xxhash64("_id"), "_id", "_k").limit(fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("_k", F.explode(words_of("text")).alias("w"))
    counts = found.groupBy("_k", F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "word-counts")
    total = {r._k: r.n for r in counts.groupBy("_k").agg(F.sum("n").alias("n")).collect()}
    rows_of = {r._k: r["count"] for r in rows.groupBy("_k").count().collect()}
    size, n = range(len(domains)), sum(rows_of.values())
    prior = [math.log((rows_of.get(k, 0) + 1) / (n + len(domains))) for k in size]
    low = [math.log(total.get(k, 0) + smoothing * buckets) for k in size]
    seen = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("_k") == k, F.col("n"))).alias(f"n{k}") for k in size))
    table = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(seen, "bucket", "left")
    table = table.select("bucket", *((F.log(F.coalesce(f"n{k}", F.lit(0)) + smoothing) - low[k]).alias(f"l{k}") for k in size))
    # a document's end counts as a word that says nothing
    ends = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("bucket"), *(F.lit(0.0).alias(f"l{k}") for k in size))
    return table.union(ends), prior


def posteriors(docs: DataFrame, labelled: DataFrame, domains: dict[str, str], fit_rows: int = 4000, buckets: int = 1 << 13, smoothing: float = 0.5, evidence: float = 50.0) -> DataFrame:
    """(doc_id, row_hash, n_tokens, n_rows, p array) of every distinct (doc_id, text), stored in the shared folder."""
    table, prior = classifier(docs, labelled, domains, fit_rows, buckets, smoothing)
    size = range(len(domains))
    # an empty word ends each document, so documents without words have a row, and repeated rows can be counted
    words = F.array_append(F.coalesce(words_of("text"), F.array().cast("array<string>")), "")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words.alias("words")).select("doc_id", "row_hash", F.explode("words").alias("w"))
    rows = rows.select("doc_id", "row_hash", F.when(F.col("w") == "", -1).otherwise(F.pmod(F.xxhash64("w"), F.lit(buckets))).cast("long").alias("bucket"))
    last = len(domains) - 1
    rows = rows.join(F.broadcast(table.select("bucket", *((F.col(f"l{k}") - F.col(f"l{last}")).alias(f"l{k}") for k in size[:-1]))), "bucket")
    sums = rows.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n"), F.count(F.when(F.col("bucket") < 0, 1)).alias("rows"), *(F.sum(f"l{k}").alias(f"s{k}") for k in size[:-1]))
    sums = sums.withColumn("n_words", ((F.col("n") - F.col("rows")) / F.col("rows")).cast("long"))
    scale = F.least(F.lit(1.0), F.lit(evidence) / F.greatest(F.col("n_words"), F.lit(1))) / F.col("rows")
    logs = [F.col(f"s{k}") * scale + (prior[k] - prior[last]) for k in size[:-1]] + [F.lit(0.0)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = F.array(*(F.exp(x - top) for x in logs))
    out = sums.select("doc_id", "row_hash", F.col("n_words").alias("n_tokens"), F.col("rows").alias("n_rows"), weights.alias("w"))
    return materialize(out.select("doc_id", "row_hash", "n_tokens", "n_rows", F.expr("transform(w, x -> x / aggregate(w, 0D, (a, b) -> a + b))").alias("p")), "posteriors")


def _solve(g: list[list[float]], r: list[float]) -> list[float]:
    """Solves a small symmetric system by elimination; directions without any tokens get 0."""
    n = len(r)
    ridge = 1e-12 * max([g[i][i] for i in range(n)] + [1e-300])
    m = [[g[i][j] + (ridge if i == j else 0.0) for j in range(n)] + [r[i]] for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(m[k][i]))
        m[i], m[p] = m[p], m[i]
        if abs(m[i][i]) < 1e-300:
            continue
        for k in range(n):
            if k != i:
                f = m[k][i] / m[i][i]
                m[k] = [a - f * b for a, b in zip(m[k], m[i])]
    return [m[i][n] / m[i][i] if abs(m[i][i]) >= 1e-300 else 0.0 for i in range(n)]


def _rate(pulls: list[list[float]], start: float, least: float) -> Column:
    """A document's rate after the steps so far: a fold over their vectors, of one code size however many."""
    steps = ", ".join("array(" + ", ".join(f"{x!r}D" for x in pull) + ")" for pull in pulls)
    move = " + ".join(f"p[{k}] * r[{k}]" for k in range(len(pulls[0])))
    return F.expr(f"aggregate(array({steps}), {float(start)!r}D, (x, r) -> greatest({float(least)!r}D, x - n_tokens * ({move})))")


def fit_rates(members: DataFrame, targets: list[float], total: float | None = None, least: float = 0.0, steps: int = 30, tolerance: float = 1e-6) -> tuple[DataFrame, list[float], list[float]]:
    """Adds ``rate``; returns also the targets in tokens and the expected totals reached.

    ``targets``: weights of the domains (sum 1). ``total``: tokens aimed at; by default the least at which no
    domain must shrink, so the mixture is reached by repeating.
    """
    size = range(len(targets))
    # a row of a table that repeats it stands for each of its rows
    a = [F.col("n_tokens") * F.col("p")[k] for k in size]
    rows = F.col("n_rows")
    first = members.agg(*(F.sum(rows * a[k]).alias(f"t{k}") for k in size), *(F.sum(rows * a[i] * a[j]).alias(f"g{i}_{j}") for i in size for j in size if i <= j)).first()
    now = [first[f"t{k}"] or 0.0 for k in size]
    gram = [[first[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in size] for i in size]
    if total is None:
        total = max([now[k] / targets[k] for k in size if targets[k] > 0], default=0.0)
    goal = [total * w for w in targets]
    start, pulls = max(1.0, least), []
    rate, reached = F.lit(start), [x * start for x in now]
    for _ in range(steps):
        gap = [x - y for x, y in zip(reached, goal)]
        if sum(abs(x) for x in gap) <= tolerance * max(total, 1.0):
            break
        pulls.append(_solve(gram, gap))
        rate = _rate(pulls, start, least)
        give_back(members.sparkSession)
        row = members.agg(*(F.sum(rows * rate * a[k]).alias(f"t{k}") for k in size)).first()
        reached = [row[f"t{k}"] or 0.0 for k in size]
    return members.withColumn("rate", rate), goal, reached


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies whose expectation is the rate: the fraction is settled by a hash of the key."""
    return (F.floor(rate) + F.when(F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) < (rate - F.floor(rate)) * (1 << 30), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Each document as often as its rate says; the columns of ``docs``."""
    d, h, n, i = free_names(docs, "_d", "_h", "_n", "_i")
    found = members.select(F.col("doc_id").alias(d), F.col("row_hash").alias(h), copies(F.col("rate"), F.col("doc_id"), F.col("row_hash")).alias(n))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)))
    return joined.where(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)
