"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic). The cells' token weights are raked in
turn to the source, language and topic marginals until all agree to TOLERANCE, measured every STEP
rounds (at most ROUNDS: marginals that no weights of the given cells meet come as near as they can
by then); a document is then kept with
the probability of its cell, which is the calibrated weight over the weight at hand, scaled so
that the largest probability is 1. Only DataFrame functions are used. The cells are as many as
combinations of dimension values occur, and stay distributed; documents meet them by a join that
Spark broadcasts where the written cells are small enough. A round is a window over the cells of each
value of each dimension (texts are not touched), without shuffles if there are at most SMALL cells;
targets of a dimension of at most SMALL values are broadcast.

A marginal's targets are the shares at hand to a power (1 keeps them, 0 makes them equal).
Tokens are runs between blanks or line ends. The topic of a document is a column expression; the
default takes one of eight hash classes of its first word, as the tables have no topic column.

Edge cases: null source, language and text count as empty strings; documents without tokens have
weight 0 cells of their own and are kept with probability 0 (they carry no weight to calibrate),
unless nothing in the table has tokens; repeated rows have one fate, as the draw depends on the
doc_id and the seed only. Other columns pass unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOPICS = 8
ROUNDS, STEP = 64, 4
#: Largest relative deviation of a marginal from its target.
TOLERANCE = 1e-12
SMALL = 100_000
#: Rounds that the SQL unrolls: more than the driver's tables need to reach TOLERANCE.
SQL_ROUNDS = 24
#: Exponents of the present shares that make the targets.
SOURCE_POWER, LANG_POWER, TOPIC_POWER = 0.7, 0.8, 0.9


def token_count() -> Column:
    text = F.coalesce("text", F.lit(""))
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = F.contains(plain, F.lit("  ")) | F.startswith(plain, F.lit(" ")) | F.endswith(plain, F.lit(" ")) | (F.length(text) == 0)
    gaps = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(odd, F.regexp_count(text, F.lit("[^ \\n]+"))).otherwise(gaps + 1).cast("long")  # the same number, found faster


def lead_topic(topics: int = TOPICS) -> Column:
    lead = F.md5(F.substring_index(F.coalesce("text", F.lit("")), " ", 1))
    return (F.conv(F.substring(lead, 1, 6), 16, 10).cast("long") % topics).cast("int")


def draw(seed: str) -> Column:
    """A number in [0, 1) that depends on the doc_id and the seed."""
    name = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(name, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, powers: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``weight``: tokens fitted to the tempered
    marginals of each dimension in turn."""
    df = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    whole, n = df.agg(F.sum("tokens").cast("double"), F.count("*")).first()
    whole = whole or 0.0
    close = (lambda x: x.coalesce(1)) if n <= SMALL else (lambda x: x)  # few cells need no shuffles
    df = close(df)
    for d, power in powers.items():
        shares = df.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(whole), F.lit(power)).alias("_p"))
        total, n = shares.agg(F.sum("_p"), F.count("*")).first()
        target = shares.select(d, (F.col("_p") / F.lit(total or 1.0) * F.lit(whole)).alias(f"_t_{d}"))
        df = df.join(F.broadcast(target) if n <= SMALL else target, d)
    df = close(materialize(df, "targets"))
    for _ in range(0, rounds, STEP):
        for d in list(powers) * min(STEP, rounds):
            df = df.withColumn("weight", F.col("weight") * F.col(f"_t_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        df = close(materialize(df, "raked"))
        off = [df.groupBy(d).agg(F.abs(F.sum("weight") / F.first(f"_t_{d}") - 1).alias("off")).select("off") for d in powers]
        if (reduce(DataFrame.union, off).agg(F.max("off")).first()[0] or 0) <= tolerance:
            break
    return df.select(*cells.columns, "weight")


def mix(docs: DataFrame, topic: Column | None = None, powers: dict[str, float] | None = None, rounds: int = ROUNDS, seed: str = "mix") -> DataFrame:
    """``docs`` with topic, tokens, weight, probability and sampled."""
    powers = powers or {"source": SOURCE_POWER, "lang": LANG_POWER, "topic": TOPIC_POWER}
    made = ("topic", "tokens", "weight", "probability", "sampled")
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept).withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "topic": topic if topic is not None else lead_topic(), "tokens": token_count()})
    names = {"source": "_source", "lang": "_lang", "topic": "topic"}
    counted = rows.where("tokens > 0").groupBy(*names.values()).agg(F.sum("tokens").alias("tokens"))
    cells = materialize(rake(counted, {names[d]: p for d, p in powers.items()}, rounds).withColumn("weight", F.col("weight") / F.col("tokens")).drop("tokens"), "cells")
    most = cells.agg(F.max("weight")).first()[0] or 1.0
    out = rows.join(cells, list(names.values()), "left")
    weight = F.when(F.col("tokens") > 0, F.col("weight")).otherwise(F.lit(0.0))
    out = out.withColumns({"weight": weight, "probability": weight / F.lit(most)})
    return out.withColumn("sampled", draw(seed) < F.col("probability")).select(*kept, *made)


def sql(rounds: int = SQL_ROUNDS, powers: tuple[float, float, float] = (SOURCE_POWER, LANG_POWER, TOPIC_POWER), seed: str = "mix") -> str:
    """DuckDB SQL for the same rows of the query over ``documents``."""
    dims = dict(zip(("source", "lang", "topic"), powers, strict=True))
    steps = [
        """d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
  ('0x' || substr(md5(split_part(coalesce(text, ''), ' ', 1)), 1, 6))::bigint % """
        + str(TOPICS)
        + """ as topic,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\n]+')) as tokens
  from documents)""",
        "c as (select source, lang, topic, sum(tokens)::double as tokens from d where tokens > 0 group by all)",
    ]
    for k, p in dims.items():
        steps.append(f"t_{k} as (select {k}, pow(sum(tokens) / (select sum(tokens) from c), {p}) as p from c group by {k})")
    steps.append("w0 as (select c.*, tokens as weight from c)")
    n = 0
    for _ in range(rounds):
        for k in dims:
            steps.append(
                f"w{n + 1} as materialized (select w.source, w.lang, w.topic, w.tokens, w.weight * (t.p / (select sum(p) from t_{k}) * (select sum(tokens) from c)) / sum(w.weight) over (partition by w.{k}) as weight from w{n} w join t_{k} t using ({k}))"
            )
            n += 1
    return (
        "with "
        + ",\n".join(steps)
        + f""",
g as (select source, lang, topic, weight / tokens as weight from w{n}),
r as (select d.doc_id, d.source, d.lang, d.topic, d.tokens, case when d.tokens > 0 then g.weight else 0 end as weight,
  case when d.tokens > 0 then g.weight else 0 end / coalesce((select max(weight) from g), 1) as probability from d left join g using (source, lang, topic))
select doc_id, source, lang, topic::int as topic, tokens::bigint as tokens, round(weight, 6) as weight, round(probability, 6) as probability,
  ('0x' || substr(md5('{seed}|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0 < probability as sampled from r"""
    )
