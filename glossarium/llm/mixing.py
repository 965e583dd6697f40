"""Mixing documents to target weights of domains they belong to softly, in DataFrame operations only."""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text, stored, table
from .lines import _spaced

DOMAINS = ("clean", "low_quality", "toxic")
#: Shares of the mixture's expected tokens.
TARGETS = {"clean": 0.84, "low_quality": 0.08, "toxic": 0.08}
#: Upper edges of the bins of each measure of a text.
EDGES = {
    "log_words": (4, 6, 8, 10),
    "capitals": (0.01, 0.03, 0.08, 0.3),
    "marks": (0.0005, 0.01, 0.1),
    "digits": (0.0005, 0.01, 0.05),
    "word_length": (4.0, 5.0, 6.5, 9.0),
}
MAX_STEPS, TOLERANCE, RIDGE = 40, 1e-6, 1e-4
#: Words are told apart by a hash to so many buckets. A bucket is evidence if its share of some domain's labelled documents is
#: so many standard deviations off that of all; shares are raised by PRIOR documents of the common share.
BUCKETS, DEVIATIONS, PRIOR = 1 << 16, 3.0, 4.0


def word_buckets(tokens: Column) -> Column:
    """Distinct buckets of a text's lower-cased words (runs without white space)."""
    return F.array_distinct(F.transform(F.array_distinct(tokens), lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens (runs without white space), the distinct buckets of its words and the bin of each measure."""
    own = doc_text(docs, *more).withColumn("_tokens", F.array_remove(F.split(_spaced(F.col("text"), "\n"), " "), ""))
    text = own.select(
        "doc_id",
        *more,
        word_buckets(F.col("_tokens")).alias("words"),
        F.size("_tokens").cast("long").alias("n_tokens"),
        F.length("text").alias("size"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("upper"),
        F.regexp_count("text", F.lit(r"[!-+:-@|]")).alias("mark"),
        F.regexp_count("text", F.lit("[0-9]")).alias("digit"),
    )
    size = F.greatest(F.col("size"), F.lit(1))
    value = {
        "log_words": F.log2(F.greatest(F.col("n_tokens"), F.lit(1))),
        "capitals": F.col("upper") / size,
        "marks": F.col("mark") / size,
        "digits": F.col("digit") / size,
        "word_length": F.col("size") / F.greatest(F.col("n_tokens"), F.lit(1)),
    }

    def bin_of(name: str) -> Column:
        return sum(((value[name] > edge).cast("int") for edge in EDGES[name]), F.lit(0)).alias(name)

    return text.select("doc_id", *more, "n_tokens", "words", *(bin_of(k) for k in EDGES))


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic if labelled so, else low_quality if the quality is 0, else clean. A null label says
    nothing bad; of several rows of a document the worst counts."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int") * 2
    low = F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.greatest(toxic, low)).alias("w"))
    return worst.select("doc_id", F.when(F.col("w") == 2, "toxic").when(F.col("w") == 1, "low_quality").otherwise("clean").alias("domain"))


def word_evidence(labelled: DataFrame, total: dict[str, int]) -> list[list[float]]:
    """For each domain and bucket, the log of the domain's share of documents that hold the bucket over that of all
    labelled documents, 0 where the shares do not differ. A table of fixed size."""
    docs = sum(total.values())
    out = [[0.0] * BUCKETS for _ in DOMAINS]
    counts = labelled.select("domain", F.explode("words").alias("word")).groupBy("word")
    for r in counts.agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS)).collect():
        share = sum(r[d] for d in DOMAINS) / docs
        deviation = {d: sqrt(total[d] * share * (1 - share)) for d in DOMAINS}
        if any(abs(r[d] - total[d] * share) > DEVIATIONS * deviation[d] > 0 for d in DOMAINS):
            for k, d in enumerate(DOMAINS):
                out[k][r["word"]] = log((r[d] + PRIOR * share) / (total[d] + PRIOR) / share)
    return out


def posteriors(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` with a column p: the probabilities of DOMAINS by naive Bayes on the bins, counts raised by one, and on
    the words.

    ``labelled`` has the bins, the words and the domain. The tables of counts have a row for each bin, domain and measure and
    for each bucket, so their size is fixed. Without labels all domains are equally likely.
    """
    prior = labelled.groupBy("domain").count().collect()
    total = {d: 0 for d in DOMAINS} | {r["domain"]: r["count"] for r in prior}
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin")) for k in EDGES))).alias("x")
    counts = labelled.select("domain", bins).groupBy("domain", "x.measure", "x.bin").count().collect()
    seen = {(r["domain"], r["measure"], r["bin"]): r["count"] for r in counts}
    words = word_evidence(labelled, total)
    telling = [b for b in range(BUCKETS) if any(w[b] for w in words)]
    place = [-1] * BUCKETS
    for i, b in enumerate(telling):
        place[b] = i
    literal = lambda values, kind: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")
    rows = rows.withColumn("known", F.filter(F.transform("words", lambda b: F.get(literal(place, "int"), b)), lambda i: i >= 0))

    def log_score(k: int, d: str) -> Column:
        out = F.lit(log(total[d] + 1))
        for name, edges in EDGES.items():
            n = len(edges) + 1
            table_ = F.array(*(F.lit(log((seen.get((d, name, b), 0) + 1) / (total[d] + n))) for b in range(n)))
            out = out + F.get(table_, F.col(name))
        weights = literal([words[k][b] for b in telling], "double")
        return out + F.aggregate("known", F.lit(0.0), lambda a, i: a + F.get(weights, i))

    scored = rows.withColumn("s", F.array(*(log_score(k, d) for k, d in enumerate(DOMAINS))))
    scored = scored.withColumn("e", F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    return scored.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))).drop("s", "e", "known")


def _rate(dual: list[float]) -> Column:
    """max(0, 1 - p . dual): the documents' rates after the steps summed in ``dual``, projected to be nonnegative."""
    move = sum((F.col("p")[k] * v for k, v in enumerate(dual)), F.lit(0.0))
    return F.greatest(F.lit(1.0) - move, F.lit(0.0))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination of a small positive definite system."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    for i in range(n):
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [x - f * y for x, y in zip(rows[k], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


@dataclass(frozen=True)
class Fit:
    """The rate of a row as an expression on its p, the domains' totals that it gives and the wanted ones, as shares of all
    tokens there are, the passes it took, and how far the last one was from an optimum."""

    rate: Column
    totals: tuple[float, ...]
    wanted: tuple[float, ...]
    passes: int = 0
    residual: float = 0.0


#: Lengths of a step along its direction that a pass tries.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.01)


def fit(cells: DataFrame, targets: dict[str, float], total: float | None = None, steps: int = MAX_STEPS, ridge: float = RIDGE) -> Fit:
    """Rates by projected gradient steps.

    Over nonnegative rates r they minimise |totals - wanted|**2 / ridge + |r - 1|**2, where totals are the expected
    tokens of the domains as shares of all tokens, wanted is targets times ``total`` (default: the tokens there are),
    and rows weigh by their tokens. ``cells`` has the tokens m and probabilities p of documents; documents
    of equal p have equal rates. A pass sums residuals over the cells in parallel, for some lengths of a step at once; the best
    is taken. The next step is the residual scaled by the Gram matrix of the rows that are off the bound. A few numbers for
    each length go to the driver. Targets that nonnegative rates cannot meet have an optimum too; ``totals`` says how near
    it comes.
    """
    k = range(len(DOMAINS))
    p, pairs = F.col("p"), [(i, j) for i in k for j in k if i <= j]
    tokens = float(cells.agg(F.sum("m")).first()[0] or 0)
    if not tokens:
        return Fit(F.lit(1.0), tuple(0.0 for _ in k), tuple(0.0 for _ in k))
    wanted = [targets[d] * (tokens if total is None else total) / tokens for d in DOMAINS]
    tried, best, passes = [[0.0 for _ in k]], None, 0
    for passes in range(1, steps + 1):
        rated = cells.withColumns({f"r{c}": _rate(dual) for c, dual in enumerate(tried)})
        sums = [F.sum(F.col("m") * F.col(f"r{c}") * p[i]).alias(f"s{c}_{i}") for c in range(len(tried)) for i in k]
        sums += [F.sum(F.when(F.col(f"r{c}") > 0, F.col("m") * p[i] * p[j]).otherwise(0.0)).alias(f"g{c}_{i}{j}") for c in range(len(tried)) for i, j in pairs]
        got = rated.agg(*sums).first()
        before = best and best[0]
        for c, dual in enumerate(tried):
            totals = [float(got[f"s{c}_{i}"]) / tokens for i in k]
            residual = [totals[i] - wanted[i] - ridge * dual[i] for i in k]
            size = sqrt(sum(x * x for x in residual))
            if best is None or size < best[0]:
                gram = [[float(got[f"g{c}_{min(i, j)}{max(i, j)}"]) / tokens + (ridge if i == j else 0.0) for j in k] for i in k]
                best = size, dual, totals, residual, gram
        size, dual, totals, residual, gram = best
        if max(map(abs, residual)) < TOLERANCE or size == before:
            break
        direction = _solve(gram, residual)
        tried = [[a + t * b for a, b in zip(dual, direction)] for t in LENGTHS]
    return Fit(_rate(dual), tuple(totals), tuple(wanted), passes, max(map(abs, residual)))


def fit_rates(cells: DataFrame, targets: dict[str, float], total: float | None = None, steps: int = MAX_STEPS, ridge: float = RIDGE) -> Column:
    """The rate of ``fit``."""
    return fit(cells, targets, total, steps, ridge).rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, p (probabilities of DOMAINS), rate and copies of each document, and the columns ``more`` as they are.

    rate is how often a document is to be expected in the mixture; copies is its whole part, and one more with the
    probability of the rest, by a hash of the id. Null and empty texts have no tokens and are judged by their
    bins alone; equal texts get equal rates; an empty table gives none; further columns are not read.
    """
    bins = stored(measured(docs, *more), "measured")
    labelled = stored(bins.join(domain_of(labels).hint("merge"), "doc_id").select(*EDGES, "words", "domain"), "labelled")
    judged = stored(posteriors(bins, labelled).select("doc_id", *more, "n_tokens", "p"), "judged")
    out = judged.withColumn("rate", fit_rates(judged.select(F.col("n_tokens").cast("double").alias("m"), "p"), targets, total))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return out.select("doc_id", *more, "n_tokens", "p", "rate", F.floor(F.col("rate") + spot).cast("int").alias("copies"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return m.select("doc_id", "n_tokens", *(F.round(F.col("p")[k], 9).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round("rate", 6).alias("rate"), "copies")
