"""Mixing to target weights by soft membership.

A classifier learned from the labels table gives each document a posterior over
the domains good, low and toxic: softmax regression on two sums of words' log
ratios (naive Bayes weights, of words that tell the domain beyond chance) and on
the shares of marks, bars, capitals and repeated words. Then nonnegative rates are
fitted so that the expected tokens of the domains, sum(rate * tokens * posterior),
meet targets in the least-squares sense: projected gradient steps from rate 1,
scaled by the curvature of the documents that are not at a bound. A step is a
vector with one number per domain, so the driver keeps these few numbers; a rate
is a fold of the steps over the document's posterior, and the sums of each step
are one aggregation over the documents. Only DataFrame expressions are used.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

DOMAINS = ("good", "low", "toxic")
#: Labelled documents that the classifier learns from, in the mean, and the buckets that words are hashed to.
SAMPLE, BUCKETS = 8000, 1 << 15
#: A bucket tells a domain if its log ratio is that many times its standard error; rounds and ridge of the regression.
TELLING, ROUNDS, RIDGE = 4.0, 12, 1.0
FEATURES = 7
STEPS, CLOSE = 16, 1e-6
#: Shares of all tokens.
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}


def domain(quality: Column, toxic: Column) -> Column:
    """0 good, 1 low quality, 2 toxic; a null flag counts as not set."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 2).when(F.coalesce(quality, F.lit(1)) == 0, 1).otherwise(0)


def words_of(text: Column) -> Column:
    """Lower-case runs of characters other than space, tab and line ends, without the marks they end with.

    A run of marks keeps its first. Blanks may stand at both ends of the array.
    """
    bare = F.regexp_replace(F.lower(text), r"(?<=[^ \t\r\n])[.,?;:!&%$*#]+(?=[ \t\r\n]|\z)", "")
    return F.split(bare, "[ \t\r\n]+")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with tokens, buckets (those of its words, once each) and the signals marks, bars, capitals, repeats.

    These names must not be taken.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.char_length(whole), F.lit(1))
    share = lambda pattern: 1 - F.char_length(F.regexp_replace(whole, pattern, "")) / size
    bucket = lambda w: F.xxhash64(w).bitwiseAND(BUCKETS - 1).cast("int")
    held = docs.withColumn("words", words_of(whole))
    held = held.withColumns({"tokens": F.size("words") - F.when(F.col("words")[0] == "", 1).otherwise(0) - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0), "buckets": F.array_distinct(F.transform("words", bucket))})
    signals = {"marks": share(r"[&%$*#!]+"), "bars": share(r"\|+"), "capitals": share(r"\p{Lu}+"), "repeats": 1 - F.size("buckets") / F.greatest(F.size("words"), F.lit(1))}
    return held.withColumns({"tokens": F.col("tokens").cast("long"), **signals}).drop("words")


class Classifier:
    """Weights of the buckets for each domain but the first, and of the features for the same."""

    def __init__(self, words: list[dict[int, float]], regression: list[list[float]]):
        self.words, self.regression = words, regression

    def features(self) -> list[Column]:
        """Of a row of ``measured``."""
        told = sorted(set().union(*self.words))
        place = {b: k for k, b in enumerate(told)}

        def table(values: dict[int, float]) -> Column:  # a string, as a literal array of many numbers is slow to plan
            full = ["0"] * len(told)
            for b, w in values.items():
                full[place[b]] = repr(w)
            return F.split(F.lit(",".join(full) or "0"), ",").cast("array<double>")

        marks = ["0"] * BUCKETS
        for b, k in place.items():
            marks[b] = str(k + 1)
        known = F.split(F.lit(",".join(marks)), ",").cast("array<int>")
        found = F.filter(F.transform("buckets", lambda b: F.get(known, b)), lambda k: k > 0)
        sums = [F.aggregate(F.transform(found, partial(lambda t, k: F.get(t, k - 1), table(w))), F.lit(0.0), lambda total, x: total + x) for w in self.words]
        return [F.lit(1.0), *sums, F.least(F.col("marks") * 10, F.lit(3.0)), F.least(F.col("bars") * 10, F.lit(3.0)), F.least(F.col("capitals") * 3, F.lit(3.0)), F.col("repeats") * 3]

    def posterior(self, names: list[str]) -> Column:
        """The domains' chances, as an array, of a row with its features under these names."""
        scores = [F.lit(0.0), *(sum((F.col(n) * w for n, w in zip(names[1:], row[1:], strict=True)), F.lit(row[0])) for row in self.regression)]
        top = F.greatest(*scores)
        parts = [F.exp(x - top) for x in scores]
        return F.array(*[x / sum(parts[1:], parts[0]) for x in parts])

    def applied(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with tokens and posterior; names of ``measured``, f0.. and posterior must not be taken."""
        names = [f"f{k}" for k in range(FEATURES)]
        told = measured(docs, text).withColumns(dict(zip(names, self.features(), strict=True)))
        return told.withColumn("posterior", self.posterior(names)).select(*docs.columns, "tokens", "posterior")


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(domain, text) of about ``sample`` labelled documents, by a hash of doc_id; with fewer labels of all.

    Repeated labels of a document are united. Every label is of use, as far as
    its document is there and has a text.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = F.xxhash64("doc_id", F.lit("mix")).bitwiseAND((1 << 30) - 1)
    chosen = known.where(drawn / float(1 << 30) < share).select("doc_id", domain(F.col("q"), F.col("t")).alias("domain"))  # bounded by ``sample``
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("domain", "text")


def word_weights(held: DataFrame, n: list[int]) -> list[dict[int, float]]:
    """Log ratios of the shares of documents that hold a bucket, of those that tell a domain; n documents a domain."""
    rows = held.select("domain", F.explode("buckets").alias("bucket"))
    sums = [F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))]
    counts = materialize(rows.groupBy("bucket").agg(*sums), "counts")
    total, weights = sum(n), []
    for k in range(1, len(DOMAINS)):
        own, rest = F.col(f"n{k}").cast("double"), sum((F.col(f"n{j}") for j in range(len(DOMAINS)) if j != k), F.lit(0)).cast("double")
        ratio = F.log((own + 0.5) / (n[k] + 1.0)) - F.log((rest + 0.5) / (total - n[k] + 1.0))
        error = F.sqrt(1 / (own + 0.5) + 1 / (rest + 0.5))
        told = counts.select("bucket", F.round(ratio, 6).alias("w")).where(ratio > TELLING * error)
        weights.append({r["bucket"]: r["w"] for r in told.collect()})  # at most BUCKETS rows
    return weights


def regress(rows: DataFrame, names: list[str]) -> list[list[float]]:
    """Softmax regression of ``domain`` on the named features by Newton steps, the first domain as the base."""
    k, f = len(DOMAINS) - 1, len(names)
    model = Classifier([], [[0.0] * f for _ in range(k)])
    for _ in range(ROUNDS):
        told = rows.withColumn("p", model.posterior(names)).select("domain", *names, *[F.col("p")[j + 1].alias(f"q{j}") for j in range(k)])
        off = [((F.col("domain") == j + 1).cast("double") - F.col(f"q{j}")) for j in range(k)]
        sums = [F.sum(off[j] * F.col(x)).alias(f"g{j}_{a}") for j in range(k) for a, x in enumerate(names)]
        for i in range(k):
            for j in range(i, k):
                spread = F.col(f"q{i}") * ((1.0 if i == j else 0.0) - F.col(f"q{j}"))
                sums += [F.sum(spread * F.col(names[a]) * F.col(names[b])).alias(f"h{i}_{j}_{a}_{b}") for a in range(f) for b in range(a, f)]
        got = told.agg(*sums).collect()[0]
        size = k * f
        h = [[0.0] * size for _ in range(size)]
        g = [(got[f"g{j}_{a}"] or 0.0) - RIDGE * model.regression[j][a] for j in range(k) for a in range(f)]
        for i in range(k):
            for j in range(i, k):
                for a in range(f):
                    for b in range(a, f):
                        x = got[f"h{i}_{j}_{a}_{b}"] or 0.0
                        for u, v in ((i * f + a, j * f + b), (i * f + b, j * f + a)):
                            h[u][v] = h[v][u] = x
        for u in range(size):
            h[u][u] += RIDGE
        step = _solve(h, g)
        model.regression = [[w + step[j * f + a] for a, w in enumerate(row)] for j, row in enumerate(model.regression)]
        if max(map(abs, step)) < 1e-4:
            break
    return model.regression


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learns from about ``sample`` labelled documents; without any all domains are equally likely."""
    held = materialize(measured(labelled(docs, labels, sample)).drop("text"), "labelled")
    counts = {r["domain"]: r["n"] for r in held.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [counts.get(k, 0) for k in range(len(DOMAINS))]
    if not sum(n):
        return Classifier([{}] * (len(DOMAINS) - 1), [[0.0] * FEATURES] * (len(DOMAINS) - 1))
    words = word_weights(held, n)
    names = [f"f{k}" for k in range(FEATURES)]
    rows = held.select("domain", *[x.alias(name) for x, name in zip(Classifier(words, []).features(), names, strict=True)])
    return Classifier(words, regress(materialize(rows, "features"), names))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination of a small system."""
    n = len(b)
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for k in range(n):
            if k != i:
                f = rows[k][i] / rows[i][i]
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def rate(posterior: list[Column], steps: list[list[float]], most: float | None) -> Column:
    """Rate after the steps, each projected onto [0, most]."""
    out = F.lit(1.0)
    for step in steps:
        moved = out - sum((p * g for p, g in zip(posterior[1:], step[1:], strict=True)), posterior[0] * step[0])
        out = F.greatest(F.lit(0.0), moved)
        out = out if most is None else F.least(F.lit(most), out)
    return out


def fit(table: DataFrame, targets: list[float], most: float | None = None) -> list[list[float]]:
    """Steps that take (tokens, p0, p1, ...) from rate 1 to the targets."""
    k, steps, best = len(targets), [], (float("inf"), 0)
    p = [F.col(f"p{i}") for i in range(k)]
    scale = max(1.0, sum(targets))
    for _ in range(STEPS):
        # the rate so far is a column of the inner select, so that it is computed once
        rows = table.select("tokens", *p, rate(p, steps, most).alias("r"))
        free = (F.col("r") > 0) & (F.lit(True) if most is None else (F.col("r") < most))
        weight = F.when(free | F.lit(not steps), F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("r") * F.col("tokens") * x).alias(f"a{i}") for i, x in enumerate(p)]
        sums += [F.sum(weight * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        got = rows.agg(*sums).collect()[0]
        over = [(got[f"a{i}"] or 0.0) - t for i, t in enumerate(targets)]
        off = math.sqrt(sum(x * x for x in over)) / scale
        if off < best[0]:
            best = (off, len(steps))
        if off < CLOSE:
            break
        gram = [[(got[f"g{min(i, j)}_{max(i, j)}"] or 0.0) + (1e-3 * scale if i == j else 0) for j in range(k)] for i in range(k)]
        steps.append(_solve(gram, over))
    return steps[: best[1]]


def weighed(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, tokens, p0, p1, p2) of each row."""
    told = classifier.applied(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return told.select("doc_id", "tokens", *[F.col("posterior")[k].alias(f"p{k}") for k in range(len(DOMAINS))])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """(doc_id, tokens, p_good, p_low, p_toxic, rate, copies) of each row of ``docs``.

    ``copies`` rounds the rate up or down by a hash of doc_id, so that it is the
    rate in the mean. Null and empty texts have no tokens and the posterior of a
    text without words; texts of any length are read whole. Repeated rows get
    equal results, null ids share a hash. Without labels all domains are equally
    likely. Other columns, of whatever names, are not read; an empty table gives
    an empty result.
    """
    table = materialize(weighed(docs, learn(docs, labels)), "weighed")
    total = table.agg(F.sum("tokens")).collect()[0][0] or 0
    goals = targets or TARGETS
    p = [F.col(f"p{k}") for k in range(len(DOMAINS))]
    steps = fit(table, [total * goals[d] for d in DOMAINS], most)
    rated = table.withColumn("rate", F.round(rate(p, steps, most), 9))
    return rated.select("doc_id", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + chance()).cast("long").alias("copies"))


def chance(doc_id: str = "doc_id") -> Column:
    """A number from 0 to below 1 for each doc_id."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.lit("copies")).bitwiseAND((1 << 40) - 1) / float(1 << 40)


def resample(docs: DataFrame, labels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Rows of ``docs`` kept by rates of at most 1.

    ``shares`` are the targets as shares of each domain's own expected tokens, 1
    leaving a domain as it is. Rows and columns, of whatever names, are
    unchanged; null and empty texts have no tokens and are kept like others of
    their posterior; an empty table stays empty.
    """
    classifier = learn(docs, labels)
    table = materialize(weighed(docs, classifier), "weighed")
    p = [F.col(f"p{k}") for k in range(len(DOMAINS))]
    own = table.agg(*[F.sum(F.col("tokens") * x).alias(f"t{k}") for k, x in enumerate(p)]).collect()[0]
    steps = fit(table, [(own[f"t{k}"] or 0.0) * shares[d] for k, d in enumerate(DOMAINS)], 1.0)
    inner = [f"c{k}" for k in range(len(docs.columns))]  # so that no name of the caller's meets another
    place = {name: k for k, name in reversed(list(enumerate(docs.columns)))}
    held = classifier.applied(docs.toDF(*inner), inner[place["text"]])
    posterior = [F.col("posterior")[k] for k in range(len(DOMAINS))]
    copies = F.floor(rate(posterior, steps, 1.0) + chance(inner[place["doc_id"]])).cast("int")
    # not a filter: pushed below, it would compute the posterior once for each use of it
    return held.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(inner).toDF(*docs.columns)
