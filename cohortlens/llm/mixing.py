"""Mixing sources to target weights by soft membership.

A multinomial word model is fitted on the labelled table (hashed words, ``BUCKETS`` of them, add-half smoothing) and gives every
document a posterior over the domains; a temperature, chosen by the likelihood of a held-out fifth of the labelled sample,
keeps long texts from being certain. The rates r of the documents then minimise the squared distance between the expected
domain totals, sum of r * tokens * posterior, and the targets, over 0 <= r <= max_rate: projected gradient steps from r = 1,
preconditioned by the K x K matrix of the documents that are not at a bound. Each step is one aggregate over the table; only
K + K * K sums reach the driver. A step that does not lessen the distance is halved.

Built-in functions only. The model has at most ``BUCKETS`` rows of K numbers (K <= ``MAX_DOMAINS``), and the labelled sample at
most ``FIT_ROWS`` rows; these two bounds are what allows their broadcasts. All documents are scored, whole, and all count
in the totals.

Defined cases: null or empty texts have no tokens, the prior as posterior, and do not matter to the totals; labels of null
or other domains are passed over; without labels every posterior is even; repeated rows are documents of their own; an empty
table gives an empty result.

``mixed_documents`` thins out unwanted text and nothing else: one domain stays whole, the shares of the others are upper limits.
There a domain whose labelled documents have no words, and a document without a word of the model, have posteriors of 0: what the
labels say nothing about is kept.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.tables import BLANK, ascii_lower, discard, numbered, text_of, written

BUCKETS = 1 << 16
MAX_DOMAINS = 16
#: Labelled rows used to fit, taken by hash of their id.
FIT_ROWS = 20_000
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64)
STEPS = 25
#: After so many accepted steps the rates are written: each step otherwise nests in the expression of the next one, which the
#: driver analyses, optimises and compiles anew for every look.
STEPS_NESTED = 5
TOLERANCE = 1e-6
FOLDS = 5


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the label table: toxic, low or high."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels.select("doc_id", domain.alias("domain")).filter("doc_id is not null and domain is not null")


def _word_rows(docs: DataFrame, *keep: str) -> DataFrame:
    word = F.explode(F.split(ascii_lower(F.col("text")), BLANK + "+"))
    rows = docs.select(*keep, word.alias("w")).filter("w <> ''")
    return rows.select(*keep, F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("bucket"))


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _posterior(scores: list[str], priors: list[float], temperature: float) -> list[Column]:
    """Softmax of prior plus tempered score."""
    logits = [F.lit(log(p)) + F.col(s) / temperature for s, p in zip(scores, priors)]
    top = F.greatest(*logits)
    weights = [F.exp(x - top) for x in logits]
    total = _sum(weights)
    return [w / total for w in weights]


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], evident: bool = False) -> DataFrame:
    """rid, doc_id, tokens, p0.. (one posterior per domain): one row per document, written.

    ``evident``: posteriors are 0 for domains without fitted words and for documents without a word of the model.
    """
    if not 2 <= len(domains) <= MAX_DOMAINS:
        raise ValueError(f"2 to {MAX_DOMAINS} domains")
    docs = numbered(docs.select("doc_id", text_of(docs).alias("text")))
    known = labelled.filter(F.col("domain").isin(domains)).dropDuplicates(["doc_id"])
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = known.orderBy(order, "doc_id").limit(FIT_ROWS).withColumn("fold", F.pmod(order, F.lit(FOLDS)))
    sample = written(sample, "mix-labels").select(F.col("doc_id").alias("of"), "domain", "fold")
    fit = docs.join(F.broadcast(sample.filter("fold > 0")), docs["doc_id"] == F.col("of"))
    counts = _word_rows(fit, "domain").groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)]
    )
    counts = written(counts, "mix-words")
    totals = counts.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(domains))]).first()
    shares = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    priors = [(shares.get(d, 0) + 0.5) / (sum(shares.values()) + 0.5 * len(domains)) for d in domains]
    size = [(totals[i] or 0) + 0.5 * BUCKETS for i in range(len(domains))]
    score = [(F.log(F.col(f"c{i}") + 0.5) - log(n)).alias(f"l{i}") for i, n in enumerate(size)]
    model = counts.select("bucket", *score)
    unseen = [log(0.5) - log(n) for n in size]
    rows = _word_rows(docs, "rid").join(F.broadcast(model), "bucket", "left")
    sums = rows.groupBy("rid").agg(
        F.count(F.lit(1)).alias("tokens"),
        *([F.count("l0").alias("seen")] if evident else []),
        *[F.sum(F.coalesce(f"l{i}", F.lit(u))).alias(f"s{i}") for i, u in enumerate(unseen)],
    )
    scores = [f"s{i}" for i in range(len(domains))]
    scored = docs.select("rid", "doc_id").join(sums, "rid", "left").fillna(0)
    scored = scored.select("rid", "doc_id", "tokens", *(["seen"] if evident else []), *scores)
    scored = written(scored, "mix-scores")
    held = scored.join(F.broadcast(sample.filter("fold = 0")), scored["doc_id"] == F.col("of"))
    likelihood = []
    for t in TEMPERATURES:
        p = _posterior(scores, priors, t)
        own = F.coalesce(*[F.when(F.col("domain") == d, x) for d, x in zip(domains, p)])
        likelihood.append(F.avg(F.log(F.greatest(own, F.lit(1e-12)))).alias(f"t{t}"))
    found = held.agg(*likelihood).first()
    best = max(TEMPERATURES, key=lambda t: (found[f"t{t}"] is not None and found[f"t{t}"], t)) if found[0] is not None else 1
    posterior = _posterior(scores, priors, best)
    if evident:
        fitted = [i for i in range(len(domains)) if totals[i]]
        among = _posterior([scores[i] for i in fitted], [priors[i] for i in fitted], best) if len(fitted) > 1 else [F.lit(1.0)]
        of = dict(zip(fitted, among))
        posterior = [F.when(F.col("seen") > 0, of.get(i, F.lit(0.0))).otherwise(0.0) for i in range(len(domains))]
    posterior = [p.alias(f"p{i}") for i, p in enumerate(posterior)]
    return written(scored.select("rid", "doc_id", "tokens", *posterior), "mix-posteriors")


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting on a K x K system."""
    n = len(right)
    rows = [[*r, b] for r, b in zip(matrix, right)]
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [a - f * b for a, b in zip(rows[k], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


def fit_rates(
    members: DataFrame, weights: list[float], total: float | None = None, max_rate: float | None = None, steps: int = STEPS,
    whole: int | None = None,
) -> DataFrame:
    """``members`` (tokens, p0..) with ``rate``. ``total`` tokens are shared out by the weights; where it is None, the
    most that every domain can give without repeating a document (for a ``max_rate`` of 1), or the tokens there are.

    ``whole``: the domain of this number is to stay as it is and sets the total; the shares of the others are upper limits.
    Every rate is 1 where that domain has no tokens.
    """
    k = len(weights)
    share = [w / sum(weights) for w in weights]
    p = [F.col(f"p{i}") for i in range(k)]
    tokens = F.col("tokens").cast("double")
    have = members.agg(*[F.coalesce(F.sum(tokens * p[i]), F.lit(0.0)) for i in range(k)]).first()
    if whole is not None:
        total = have[whole] / share[whole]
    elif total is None:
        total = min(h / s for h, s in zip(have, share) if s > 0) if max_rate is not None else float(sum(have))
    if not (sum(have) if whole is None else have[whole]):
        return members.withColumn("rate", F.lit(1.0))
    targets = [s * total if whole is None else min(h, s * total) for h, s in zip(have, share)]

    def moved(rate: Column, y: list[float]) -> Column:
        free = rate - _sum([F.lit(float(v)) * c for v, c in zip(y, p)])
        free = F.greatest(free, F.lit(0.0))
        return F.least(free, F.lit(float(max_rate))) if max_rate is not None else free

    def look(rate: Column) -> tuple[list[float], list[list[float]]]:
        rows = members.select(tokens.alias("t"), *p, rate.alias("rate"))
        inside = F.col("rate") > 0
        if max_rate is not None:
            inside = inside & (F.col("rate") < max_rate)
        sums = [F.sum(F.col("t") * F.col("rate") * p[i]).alias(f"g{i}") for i in range(k)]
        # Documents at a bound lend a little to the matrix, so that they can leave it and the matrix stays regular.
        w = F.when(inside, F.col("t")).otherwise(F.col("t") * 0.01)
        sums += [F.sum(w * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        r = rows.agg(*sums).first()
        gap = [r[f"g{i}"] - targets[i] for i in range(k)]
        matrix = [[r[f"m{min(i, j)}_{max(i, j)}"] + (1e-9 * total if i == j else 0) for j in range(k)] for i in range(k)]
        return gap, matrix

    rate = F.lit(1.0 if max_rate is None else min(1.0, max_rate))
    gap, matrix = look(rate)
    scale, nested, held = 1.0, 0, None
    for _ in range(steps):
        if sum(g * g for g in gap) <= (TOLERANCE * total) ** 2:
            break
        y = [scale * v for v in _solve(matrix, gap)]
        trial = moved(rate, y)
        new_gap, new_matrix = look(trial)
        if sum(g * g for g in new_gap) < sum(g * g for g in gap):
            rate, gap, matrix, scale = trial, new_gap, new_matrix, min(1.0, 2 * scale)
            nested += 1
        else:
            scale /= 2
        if nested == STEPS_NESTED:
            members = written(members.withColumn("rate", rate), "mix-rates")
            if held is not None:
                discard(held)
            rate, nested, held = F.col("rate"), 0, members
    return members.withColumn("rate", rate)


def mix_to_targets(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, max_rate: float | None = None,
    whole: str | None = None,
) -> DataFrame:
    """doc_id, n_tokens, p_<domain>.., rate: one row per document. ``labelled`` is (doc_id, domain)."""
    domains = list(targets)
    members = domain_posteriors(docs, labelled, domains, evident=whole is not None)
    kept = None if whole is None else domains.index(whole)
    rated = fit_rates(members, [float(targets[d]) for d in domains], total, max_rate, whole=kept)
    named = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    return rated.select("doc_id", F.col("tokens").cast("bigint").alias("n_tokens"), *named, "rate")


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], whole: str = "high") -> DataFrame:
    """Documents drawn at their rates (at most 1, so none is repeated); columns as they came.

    The targets are upper limits beside the text of ``whole``, however scarce the other domains are. The draw is a hash of the id: the same document is drawn again in every run.
    """
    rates = mix_to_targets(docs, labelled, targets, max_rate=1.0, whole=whole)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    kept = rates.filter(draw < F.col("rate")).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
