"""Mixing by iterative proportional fitting.

Token weights of (source, language, topic) cells are raked until their sums meet
the target of each source, each language and each topic; a document is then
kept with a probability in proportion to the factor of its cell, so the kept
tokens meet all three targets in expectation.  Whether a document is kept
depends on its id alone, so runs agree.

Targets are shares by value, given for any of the three (Targets); where none are
given they are the observed shares to the power TEMPER, which moves weight from
large groups to small ones.  A given target says nothing of values it doesn't
name: they get no weight.

The corpus is aggregated to its cells once; every source and every language has
a factor of its own.  Up to DRIVER_CELLS cells (they are counted first) are raked
on the driver; more are raked where they are, with the factors of sources and
languages as tables, of which only the sums of the topics reach the driver.  Both
do the same arithmetic.

Defined results: tokens are words; a null or blank text has none and topic
`empty`; a null source is the group ``, a null language is `other`; a null id
draws as the empty text.  Documents of one id and cell are kept or left together.
If no document has tokens, all have factor 0 and probability 0.  An empty table
gives an empty result.  Extra columns are ignored by mix() and kept by
sample_documents(), which keeps whole rows, repeated ones too.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.store import discard, materialise, table

TOPICS = ("empty", "tabular", "short", "medium", "long")
TEMPER = 0.85
SWEEPS = 10
DRIVER_CELLS = 20_000
_WORDS = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Shares by value, of any of the dimensions.
Targets = dict[str, dict[str, float]]


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by form: tables, then length of prose."""
    return F.when(tokens == 0, "empty").when(text.contains(" | "), "tabular").when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("other")).alias("lang"), text.alias("text"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("n_tokens"))
    return rows.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


@dataclass
class Raking:
    """Factors by source and by language (tables) and by topic; the largest factor of a cell; the largest
    share by which a marginal misses its target."""

    sources: DataFrame
    langs: DataFrame
    by_topic: dict[str, float]
    largest: float = 1.0
    residual: float = 0.0

    def factor(self) -> Column:
        """The factor of a row that was joined with both tables."""
        return F.coalesce(F.col("source_factor") * F.col("lang_factor"), F.lit(0.0)) * _looked_up(self.by_topic, F.col("topic"))


def _looked_up(values: dict[str, float], key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(known, key), F.lit(0.0))


def _goals(sums: dict[str, float], given: dict[str, float] | None, temper: float) -> dict[str, float]:
    """The tokens that each value shall have."""
    total = sum(sums.values())
    raised = {k: given.get(k, 0.0) if given is not None else s**temper for k, s in sums.items()}
    return {k: r / (sum(raised.values()) or 1.0) * total for k, r in raised.items()}


def rake(rows: DataFrame, targets: Targets | None = None, temper: float = TEMPER, sweeps: int = SWEEPS, driver_cells: int = DRIVER_CELLS) -> Raking:
    """The factors of rows (source, lang, topic, n_tokens)."""
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("w")).where("w > 0"), "mix-cells")
    fit = _raked_here if cells.count() <= driver_cells else _raked_there
    return fit(cells, targets or {}, temper, sweeps)


def _raked_here(cells: DataFrame, targets: Targets, temper: float, sweeps: int) -> Raking:
    """rake() on the driver."""
    spark = cells.sparkSession
    held = [((r.source, r.lang, r.topic), r.w) for r in cells.collect()]

    def sums(place: int, fits: list[dict[str, float]]) -> dict[str, float]:
        out = defaultdict(float)
        for key, w in held:
            out[key[place]] += w * fits[0][key[0]] * fits[1][key[1]] * fits[2][key[2]]
        return out

    fits = [dict.fromkeys((key[place] for key, _ in held), 1.0) for place in range(3)]
    goals = [_goals(sums(place, fits), targets.get(d), temper) for place, d in enumerate(DIMENSIONS)]
    for _ in range(sweeps):
        for place in range(3):
            now = sums(place, fits)
            fits[place] = {k: f * goals[place][k] / now[k] if now[k] else 0.0 for k, f in fits[place].items()}
    top = max((fits[0][s] * fits[1][lang] * fits[2][t] for (s, lang, t), _ in held), default=0.0)
    missed = [abs(s / goals[place][k] - 1) for place in range(3) for k, s in sums(place, fits).items() if goals[place][k] > 0]
    sources, langs = (materialise(spark.createDataFrame(list(fits[place].items()), f"{d} string, {d}_factor double").coalesce(1), f"mix-{d}s") for place, d in enumerate(DIMENSIONS[:2]))
    return Raking(sources, langs, fits[2], top or 1.0, max(missed, default=0.0))


def _raked_there(cells: DataFrame, targets: Targets, temper: float, sweeps: int) -> Raking:
    """rake() in the cluster."""
    topics = [r.topic for r in cells.select("topic").distinct().collect()]
    by_topic = [F.sum(F.when(F.col("topic") == t, F.col("w") * F.col("source_factor")).otherwise(0.0)).alias(t) for t in topics]

    def with_goals(d: str) -> DataFrame:
        tokens = cells.groupBy(d).agg(F.sum("w").alias("tokens"))
        raised = _looked_up(targets[d], F.col(d)) if d in targets else F.pow("tokens", F.lit(temper))
        total, powers = tokens.agg(F.sum("tokens"), F.sum(raised)).first()
        return materialise(tokens.select(d, (raised / F.lit(powers or 1.0) * F.lit(total or 0.0)).alias("goal")), f"mix-{d}-goals")

    def fitted(now: Column, d: str) -> Column:
        return F.coalesce(F.try_divide(F.col("goal"), now), F.lit(0.0)).alias(f"{d}_factor")

    goals = {d: with_goals(d) for d in DIMENSIONS[:2]}
    of_topics = _goals({r.topic: r.w for r in cells.groupBy("topic").agg(F.sum("w").alias("w")).collect()}, targets.get("topic"), temper)
    fits = dict.fromkeys(topics, 1.0)
    sources, langs = (goals[d].select(d, F.lit(1.0).alias(f"{d}_factor")) for d in DIMENSIONS[:2])
    spent: list[DataFrame] = []
    for _ in range(sweeps):
        # a factor is the goal over what all other factors make of the tokens
        now = cells.join(langs, "lang").groupBy("source").agg(F.sum(F.col("w") * F.col("lang_factor") * _looked_up(fits, F.col("topic"))).alias("now"))
        sources = materialise(goals["source"].join(now, "source").select("source", fitted(F.col("now"), "source")), "mix-sources")
        sums = materialise(goals["lang"].join(cells.join(sources, "source").groupBy("lang").agg(*by_topic), "lang"), "mix-sums")
        langs = sums.select("*", fitted(sum((F.col(t) * F.lit(fits[t]) for t in topics), F.lit(0.0)), "lang"))
        have = langs.agg(*[F.sum(F.col(t) * F.col("lang_factor")).alias(t) for t in topics]).first()
        langs = langs.select("lang", "lang_factor")
        fits = {t: of_topics[t] / have[t] if have[t] else 0.0 for t in topics}
        discard(*spent)
        spent = [sources, sums]
    out = Raking(materialise(sources, "mix-sources"), materialise(langs, "mix-langs"), fits)
    discard(*spent)
    scaled = materialise(cells.join(out.sources, "source").join(out.langs, "lang").select(*DIMENSIONS, "w", out.factor().alias("factor")), "mix-factors")
    out.largest = scaled.agg(F.max("factor")).first()[0] or 1.0
    for d in DIMENSIONS[:2]:  # topics are met last, so exactly
        met = scaled.groupBy(d).agg(F.sum(F.col("w") * F.col("factor")).alias("now")).join(goals[d].where("goal > 0"), d)
        out.residual = max(out.residual, met.agg(F.max(F.abs(F.col("now") / F.col("goal") - 1))).first()[0] or 0.0)
    return out


def mix(docs: DataFrame, targets: Targets | None = None, temper: float = TEMPER, sweeps: int = SWEEPS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, sampled of each document."""
    rows = materialise(described(docs), "mix-rows")
    raking = rake(rows, targets, temper, sweeps, driver_cells)
    factor = F.when(F.col("n_tokens") > 0, raking.factor()).otherwise(0.0)
    raked = rows.join(raking.sources, "source", "left").join(raking.langs, "lang", "left").withColumn("factor", factor)
    probability = F.col("factor") / F.lit(raking.largest)
    return raked.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round(probability, 6).alias("probability"), (draw(F.col("doc_id")) < probability).alias("sampled"))


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sample_documents(docs: DataFrame, targets: Targets | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    raking = rake(described(docs), targets, temper, sweeps)
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(_WORDS))
    kept = docs.select(F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("source"), draw(F.col("doc_id")).alias("draw"), F.coalesce("lang", F.lit("other")).alias("lang"), topic_of(text, tokens).alias("topic"), (tokens > 0).alias("words"))
    joined = kept.join(raking.sources, "source").join(raking.langs, "lang")
    return joined.where(F.col("words") & (F.col("draw") < raking.factor() / F.lit(raking.largest))).select("row.*")


def op9_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle(targets: Targets | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> str:
    """DuckDB SQL for mix()."""
    targets = targets or {}
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, 'other') AS lang, coalesce(text, '') AS text,
            len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS n_tokens FROM documents)""",
        """r AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'tabular'
            WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM d)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "total AS (SELECT sum(w) AS t FROM c)",
    ]
    for dim in DIMENSIONS:
        given = targets.get(dim)
        raised = f"pow(w, {temper})" if given is None else "CASE " + dim + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 0 END"
        parts.append(f"g_{dim} AS (SELECT {dim}, {raised} / sum({raised}) OVER () * t AS goal FROM (SELECT {dim}, sum(w) AS w FROM c GROUP BY 1), total)")
    last = "c"
    for k in range(sweeps):
        for dim in DIMENSIONS:
            parts.append(f"s{k}_{dim} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, coalesce(x.w * goal / nullif(sum(x.w) OVER (PARTITION BY x.{dim}), 0), 0) AS w FROM {last} x JOIN g_{dim} USING ({dim}))")
            last = f"s{k}_{dim}"
    parts.append(f"f AS (SELECT source, lang, topic, e.w / c.w AS factor FROM c JOIN {last} e USING (source, lang, topic))")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(factor, 0), 6) AS factor, round(coalesce(factor / top, 0), 6) AS probability,
       ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0 < coalesce(factor / top, 0) AS sampled
FROM r LEFT JOIN f USING (source, lang, topic), (SELECT max(factor) AS top FROM f)"""


QUERIES = {"op9_ipf_mixing": op9_ipf_mixing}
ORACLES = {"op9_ipf_mixing": oracle()}
