"""Mixing to target weights with soft memberships, in DataFrame operations only.

A document's domain is unknown; a naive Bayes classifier fitted on the labelled table gives the
posterior of every domain (language group x quality) from a few bins of the text's style. Rates
r >= 0 then solve min over r of sum_k (sum_i n_i p_ik r_i - T_k)^2 / N_k, n_i being tokens, p_ik
posteriors, T_k the target tokens and N_k = sum_i n_i p_ik, by projected gradient steps from r = 1
in the metric of the tokens:

    r_i <- max(0, r_i - sum_k p_ik (S_k - T_k) / N_k),   S_k = sum_i n_i p_ik r_i.

Posteriors sum to one, so the step's matrix has no eigenvalue above 1 and a full step never
overshoots. Documents of one cell (equal bins) have equal posteriors and therefore equal rates, so
steps run on cells: at most ``CELLS`` rows whatever the corpus, which bounds their broadcast too.

Defined cases: null text has no tokens; a null or other language is the group 'other'; rows that
repeat an id are documents of their own; a label row without id or quality is ignored, and of several
for an id the lowest quality counts; without labelled rows posteriors are uniform; domains that no
document can belong to and weights of zero are fitted like any other; without tokens every rate is
1; extra columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.session import cut_lineage

LANGUAGES = ("en", "de", "fr", "es")
#: Target shares of tokens by domain.
TARGETS = {
    "en/high": 0.551, "de/high": 0.152, "fr/high": 0.152, "es/high": 0.095,
    "en/low": 0.029, "de/low": 0.008, "fr/low": 0.008, "es/low": 0.005,
}
#: Upper edges of the bins of each feature; the last bin is open.
EDGES = {
    "upper": (0.005, 0.05, 0.3),
    "symbol": (0.0, 0.02, 0.1),
    "distinct": (0.2, 0.4, 0.6, 0.8),
    "word_length": (3.0, 5.0, 7.0, 10.0),
    "log_length": (3.0, 5.0, 7.0, 9.0, 11.0),
}
CELLS = (len(LANGUAGES) + 1) * 4 * 4 * 5 * 5 * 6
SMOOTHING = 0.5
STEPS, TOLERANCE = 200, 1e-6
#: Steps computed in one expression before the rates are written.
CHAIN = 20
RESULTS = ("tokens", "domain", "posterior", "rate", "copies")

_FEATURES = ("_mix_lang", *(f"_mix_{name}" for name in EDGES))


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    return reduce(lambda n, edge: n + (value > edge).cast("int"), edges, F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tokens`` and one small integer per feature."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lang = F.col("lang").cast("string")
    group = reduce(lambda c, i: c.when(lang == LANGUAGES[i], i), range(len(LANGUAGES)), F).otherwise(len(LANGUAGES))
    rows = docs.withColumns(
        {
            "_mix_lang": group,
            "_mix_n": F.greatest(F.length(text), F.lit(1)),
            "_mix_upper": F.regexp_count(text, F.lit("[A-Z]")),
            "_mix_symbol": F.regexp_count(text, F.lit(r"[!#$%&*|<>{}]")),
            "tokens": F.size(words).cast("long"),
            "_mix_distinct": F.size(F.array_distinct(words)),
        }
    )
    n, w = F.col("_mix_n"), F.greatest(F.col("tokens"), F.lit(1))
    value = {
        "upper": F.col("_mix_upper") / n,
        "symbol": F.col("_mix_symbol") / n,
        "distinct": F.col("_mix_distinct") / w,
        "word_length": n / w,
        "log_length": F.log(n),
    }
    return rows.withColumns({f"_mix_{name}": _bin(value[name], EDGES[name]) for name in EDGES}).drop("_mix_n")


def _domains(targets: dict[str, float]) -> list[str]:
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative weights")
    return sorted(targets)


def posteriors(rows: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """One row per cell of ``rows``: its features, tokens, and ``posterior`` in order of ``domains``."""
    spark = rows.sparkSession
    quality = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min("quality").alias("_quality"))
    )
    name = reduce(lambda c, i: c.when(F.col("_mix_lang") == i, LANGUAGES[i]), range(len(LANGUAGES)), F).otherwise("other")
    domain = F.concat(name, F.when(F.col("_quality") > 0, "/high").otherwise("/low"))
    light = rows.select(F.col("doc_id").cast("long").alias("_id"), *_FEATURES)
    labelled = light.join(quality, "_id").select(*_FEATURES, domain.alias("_domain")).filter(F.col("_domain").isin(domains))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("bin")) for i, c in enumerate(_FEATURES)]))
    counts = labelled.groupBy("_domain", *_FEATURES).count()
    seen = (
        counts.select("_domain", "count", pairs.alias("_p"))
        .groupBy(F.col("_p.f").alias("f"), F.col("_p.bin").alias("bin"), F.col("_domain").alias("domain"))
        .agg(F.sum("count").alias("n"))
    )
    sizes = [len(LANGUAGES) + 1, *(len(e) + 1 for e in EDGES.values())]
    grid = spark.createDataFrame(
        [(f, b, k, d, sizes[f]) for f in range(len(sizes)) for b in range(sizes[f]) for k, d in enumerate(domains)],
        "f int, bin int, k int, domain string, bins int",
    )
    totals = counts.groupBy(F.col("_domain").alias("domain")).agg(F.sum("count").alias("all"))
    n, every = F.coalesce("n", F.lit(0)), F.coalesce("all", F.lit(0))
    likely = (
        grid.join(seen, ["f", "bin", "domain"], "left")
        .join(totals, "domain", "left")
        .select(
            "f", "bin", "k",
            F.log((n + SMOOTHING) / (every + SMOOTHING * F.col("bins"))).alias("ll"),
            F.log(every + SMOOTHING).alias("prior"),
        )
    )
    cells = rows.groupBy(*_FEATURES).agg(F.sum("tokens").alias("tokens"))
    scored = (
        cells.withColumn("_p", pairs)
        .join(F.broadcast(likely), (F.col("_p.f") == F.col("f")) & (F.col("_p.bin") == F.col("bin")))
        .groupBy(*_FEATURES, "tokens", "k")
        .agg((F.sum("ll") + F.first("prior")).alias("s"))
    )
    every_score = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])
    power = F.transform("scores", lambda x: F.exp(x - F.array_max("scores")))
    total = F.aggregate("powers", F.lit(0.0), lambda a, x: a + x)
    return (
        scored.groupBy(*_FEATURES, "tokens")
        .agg(every_score.alias("scores"))
        .withColumn("powers", power)
        .withColumn("posterior", F.transform("powers", lambda x: x / total))
        .drop("scores", "powers")
    )


def fit_rates(cells: DataFrame, weights: list[float]) -> DataFrame:
    """``cells`` (tokens, posterior) with ``rate``: projected gradient steps on their table.

    Only the sums of ``len(weights)`` domains return to the driver after a step.
    """
    domains = range(len(weights))

    def sums(rows: DataFrame) -> list[float]:
        found = [F.sum(F.col("tokens") * F.col("posterior")[k] * F.col("rate")) for k in domains]
        return list(rows.agg(*(F.coalesce(s, F.lit(0.0)).alias(f"s{k}") for k, s in enumerate(found))).first())

    table = cut_lineage(cells.withColumn("rate", F.lit(1.0)))
    size = sums(table)
    all_tokens = sum(size)
    target = [w / sum(weights) * all_tokens for w in weights]
    history: list[list[float]] = []
    before = None
    for _ in range(STEPS):
        now = sums(_stepped(table, history))
        moved = max((abs(a - b) for a, b in zip(now, before or target, strict=True)), default=0.0)
        if moved <= TOLERANCE * all_tokens:
            break
        before = now
        history.append([(s - t) / n if n > 0 else 0.0 for s, t, n in zip(now, target, size, strict=True)])
        if len(history) == CHAIN:
            table = cut_lineage(_stepped(table, history))
            history = []
    return _stepped(table, history)


def _stepped(table: DataFrame, history: list[list[float]]) -> DataFrame:
    """``table`` after the steps along the gradients of ``history``.

    Gradients are one constant array and not numbers in the plan, so Spark compiles one step's code for all steps.
    """
    if not history:
        return table

    def step(rate: Column, gradient: Column) -> Column:
        moves = F.zip_with("posterior", gradient, lambda p, g: p * g)
        return F.greatest(F.lit(0.0), rate - F.aggregate(moves, F.lit(0.0), lambda total, move: total + move))

    return table.withColumn("rate", F.aggregate(F.lit(history), F.col("rate"), step))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with tokens, domain (likeliest), posterior (in order of domain names), rate
    and copies.

    ``copies`` is the rate rounded up or down by a hash of the row, so that expected copies equal
    the rate and a rate of one or more never loses a document.
    """
    targets = TARGETS if targets is None else targets
    domains = _domains(targets)
    columns = [c for c in docs.columns if c not in RESULTS]
    rows = features(docs.select(*columns))
    # The texts are read twice, once for the bins of all rows and once for the result.
    light = cut_lineage(rows.select("doc_id", *_FEATURES, "tokens"))
    cells = fit_rates(posteriors(light, labels, domains), [targets[d] for d in domains])
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    named = cells.select(
        *_FEATURES,
        F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"),
        "posterior",
        "rate",
    )
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(1 << 20))
    return (
        rows.join(F.broadcast(cut_lineage(named)), list(_FEATURES))
        .withColumn("copies", F.floor(F.col("rate") + chance / float(1 << 20)).cast("int"))
        .select(*columns, *RESULTS)
    )


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs``, each row as often as its ``copies`` say."""
    mixed = mix(docs, labels, targets)
    once = mixed.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return once.select(*docs.columns)
