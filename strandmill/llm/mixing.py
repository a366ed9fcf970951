"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted once into cells of (source, lang, topic). The cells' token weights are raked to the
three target marginals in turn, sweep after sweep, until the marginals are met; a sweep sums the cells up
by each dimension and joins the sums back. Then each document is sampled with its cell's calibrated
probability, by a hash of its identifier. What grows with the corpus is only the pass that classifies and
counts the texts, whose result is written, and the last scan of that. Only DataFrame functions are used.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, materialized_from, named, table

DIMENSIONS = ("source", "lang", "topic")

#: Topics of texts that come without one: the first of which some string occurs (or any digit, where there
#: are no strings) gives the topic, else DEFAULT_TOPIC. Name a column of your own topics in mix.
TOPICS = (("legal", ("License", "license", "Licence", "licence", "Copyright", "copyright")), ("numeric", ()), ("tabular", ("|",)))
DEFAULT_TOPIC = "prose"

#: Targets by dimension: shares by value, or the power to which the observed shares are raised. Values
#: without a share keep their observed one; shares are then scaled to 1 over the values that occur.
TARGETS: dict[str, dict[str, float] | float] = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {"prose": 0.8, "numeric": 0.1, "legal": 0.06, "tabular": 0.04},
}
#: Sweeps at most, and the difference from a marginal, as a share of all tokens, that ends them.
SWEEPS, TOLERANCE = 12, 1e-7
#: Share of all tokens that the sample is to have.
BUDGET = 0.7
#: Value of a null source or language.
UNKNOWN = "unknown"
#: Cells up to this many (some 100 bytes each) are broadcast to the documents, and raked by one task; beyond,
#: both are shuffled.
BROADCAST_CELLS = 100_000


def topic(text: Column) -> Column:
    """Of a null text: DEFAULT_TOPIC."""
    text, out = F.coalesce(text, F.lit("")), F.lit(DEFAULT_TOPIC)
    for name, strings in reversed(TOPICS):
        has = text.rlike("[0-9]")
        for k, x in enumerate(strings):
            has = F.contains(text, F.lit(x)) if not k else has | F.contains(text, F.lit(x))
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Words between ASCII white space; one at least, so that every document has weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("bigint")


def shares(cells: DataFrame, dimension: str, target: dict[str, float] | float, whole: float) -> DataFrame:
    """(dimension, share): the target share of each value that occurs. If no value that occurs has a positive
    one, all keep their observed shares."""
    seen = cells.groupBy(dimension).agg((F.sum("tokens") / F.lit(whole)).alias("observed"))
    if isinstance(target, dict):
        wanted = F.col("observed")
        for value, share in target.items():
            wanted = F.when(F.col(dimension) == value, F.lit(float(share))).otherwise(wanted)
    else:
        wanted = F.pow("observed", F.lit(float(target)))
    total = seen.agg(F.sum(wanted)).first()[0] or 0.0
    return seen.select(dimension, (wanted / F.lit(total) if total > 0 else F.col("observed")).alias(f"{dimension}_share"))


def at_hand(cells: DataFrame) -> DataFrame:
    """cells, in one partition if they are few, so that sums over them need no shuffle."""
    return cells.coalesce(1) if cells.count() <= BROADCAST_CELLS else cells


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float], sweeps: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds weight, the factor on a cell's tokens, after at most `sweeps` rounds over all dimensions. Cells of
    values with a target of zero have weight zero. Where the marginals aren't met by then, as of targets that can't all be,
    it warns and tells by what share of all tokens one is missed most."""
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    out = cells.withColumn("weight", F.lit(1.0))
    for dimension, target in targets.items():
        out = out.join(shares(cells, dimension, target, whole), dimension)
    out = at_hand(materialize(out, "raked"))
    left = 0.0
    for _ in range(sweeps):
        for dimension in targets:
            now = out.groupBy(dimension).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now"))
            moved = F.when(F.col("now") > 0, F.col("weight") * F.col(f"{dimension}_share") * F.lit(whole) / F.col("now")).otherwise(0.0)
            out = out.join(now, dimension).withColumn("weight", moved).drop("now")
        out = at_hand(materialize(out, "raked"))
        apart = None
        for dimension in targets:
            sums = out.groupBy(dimension).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now"), F.first(f"{dimension}_share").alias("share"))
            own = sums.agg(F.max(F.abs(F.col("now") - F.col("share") * F.lit(whole)) / F.lit(whole)).alias("apart"))
            apart = own if apart is None else apart.union(own)
        left = 0.0 if apart is None else apart.agg(F.max("apart")).first()[0] or 0.0
        if left <= tolerance:
            break
    else:
        if left > tolerance:
            warnings.warn(f"after {sweeps} sweeps a target is missed by {left:.3g} of all tokens", stacklevel=2)
    return out


def calibrate(raked: DataFrame, budget: float) -> DataFrame:
    """Adds probability = min(1, c * weight), c such that the expected tokens are `budget` of all.

    c is found in rounds: what it pushes over 1 is taken whole, and c is worked out anew for the rest, until
    nothing more is pushed over. Weights of zero have probability zero.
    """
    whole = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    c, pushed = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(c) > 1
        n, taken, rest = raked.agg(F.sum(over.cast("bigint")), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(over, 0.0).otherwise(F.col("weight") * F.col("tokens")))).first()
        if (n or 0) == pushed:
            break
        pushed, c = n or 0, (budget * whole - (taken or 0)) / rest if rest else c
    return raked.withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("weight")))


def draw(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the identifier alone (null: as an empty string)."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> Column:
    """The column mixing before any weights: source, lang, topic, tokens, draw."""
    text = named(text_col)
    own = [F.coalesce(named(c).cast("string"), F.lit(UNKNOWN)) for c in (source_col, lang_col)]
    kind = F.coalesce(named(topic_col).cast("string"), F.lit(UNKNOWN)) if topic_col else topic(text)
    return F.struct(own[0].alias("source"), own[1].alias("lang"), kind.alias("topic"), tokens(text).alias("tokens"), draw(named(id_col)).alias("draw"))


def sampled(rows: DataFrame, targets: dict[str, dict[str, float] | float], sweeps: int, budget: float) -> DataFrame:
    """rows, a written table with keyed as mixing, with the final mixing."""
    cells = at_hand(materialize(rows.select("mixing.*").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "cells"))
    columns = [F.struct(*DIMENSIONS).alias("cell"), F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability")]
    drawn = materialized_from(rows.sparkSession, lambda: calibrate(rake(cells, targets, sweeps), budget).select(*columns), "drawn")
    small = drawn.count() <= BROADCAST_CELLS
    out = rows.alias("d").join((F.broadcast(drawn) if small else drawn).alias("r"), F.struct(*[F.col(f"d.mixing.{d}") for d in DIMENSIONS]) == F.col("r.cell"))
    mixing = F.struct(*[F.col(f"d.mixing.{c}").alias(c) for c in (*DIMENSIONS, "tokens")], F.col("r.weight").alias("weight"), F.col("r.probability").alias("probability"), (F.col("d.mixing.draw") < F.col("r.probability")).alias("sampled"))
    return out.select(*[F.col("d.`" + c.replace("`", "``") + "`") for c in rows.columns if c != "mixing"], mixing.alias("mixing"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict[str, float] | float] = TARGETS, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """Every row and column of docs with a struct column `mixing`: source, lang, topic, tokens, weight
    (factor on its cell's tokens), probability, sampled.

    Null sources, languages and topics count as UNKNOWN, null and empty texts as one token. Rows with the
    same identifier are drawn alike. Values that no target mentions keep their observed shares; those with a target of
    zero are never sampled. An empty table gives no rows; a column named mixing is replaced.
    """
    others = [named(c) for c in docs.columns if c != "mixing"]
    rows = materialize(docs.select(*others, keyed(docs, id_col, text_col, source_col, lang_col, topic_col).alias("mixing")), "keyed")
    return sampled(rows, targets, sweeps, budget)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of documents, without their texts: null columns count as UNKNOWN or as one token, repeated rows
    are drawn alike, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", keyed(docs, "doc_id", "text", "source", "lang", None).alias("mixing")), "keyed")
    return sampled(rows, TARGETS, SWEEPS, BUDGET).select("doc_id", "mixing.*")


QUERIES = {"op1_mixing": op1_mixing}


def oracle() -> str:
    """The same sums in SQL, a common table for each step of each sweep."""
    def wanted(dimension: str) -> str:
        target = TARGETS[dimension]
        if isinstance(target, dict):
            return "CASE " + " ".join(f"WHEN {dimension} = '{v}' THEN {s}" for v, s in target.items()) + " ELSE n / sum(n) OVER () END"
        return f"pow(n / sum(n) OVER (), {target})"

    def holds(strings: tuple[str, ...]) -> str:
        return " OR ".join(f"contains(coalesce(text, ''), '{x}')" for x in strings) or "regexp_matches(coalesce(text, ''), '[0-9]')"

    topics = " ".join(f"WHEN {holds(strings)} THEN '{name}'" for name, strings in TOPICS)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
  CASE {topics} ELSE '{DEFAULT_TOPIC}' END AS topic,
  greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS tokens,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {1 << 48}.0::DOUBLE AS draw FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        steps.append(f"{x}_w AS (SELECT {x}, n, {wanted(x)} AS w FROM (SELECT {x}, sum(tokens) AS n FROM cells GROUP BY 1))")
        steps.append(f"{x}_s AS (SELECT {x}, w / sum(w) OVER () AS {x}_share FROM {x}_w)")
    steps.append("r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS weight, sum(tokens) OVER () AS whole, false AS done FROM cells JOIN source_s USING (source) JOIN lang_s USING (lang) JOIN topic_s USING (topic))")
    k = 0
    for _ in range(SWEEPS):
        for x in DIMENSIONS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN done THEN weight ELSE weight * {x}_share * whole / sum(weight * tokens) OVER (PARTITION BY {x}) END AS weight) FROM r{k})")
            k += 1
        apart = ", ".join(f"max(abs({x}_now - {x}_share * whole) / whole) OVER ()" for x in DIMENSIONS)
        sums = ", ".join(f"sum(weight * tokens) OVER (PARTITION BY {x}) AS {x}_now" for x in DIMENSIONS)
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(f'{x}_now' for x in DIMENSIONS)}) REPLACE (done OR greatest({apart}) <= {TOLERANCE} AS done) FROM (SELECT *, {sums} FROM r{k}))")
        k += 1
    steps.append(f"""o AS (SELECT *, row_number() OVER w AS place,
  ({BUDGET} * whole - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight * tokens) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM r{k} WINDOW w AS (ORDER BY weight DESC, source, lang, topic))""")
    steps.append("""p AS (SELECT source, lang, topic, round(weight, 9) AS weight,
  round(least(1.0, coalesce((SELECT arg_min(c, place) FROM o WHERE c * weight <= 1) * weight, 1.0)), 9) AS probability FROM o)""")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, tokens, weight, probability, draw < probability AS sampled FROM d JOIN p USING (source, lang, topic)"


ORACLES = {"op1_mixing": oracle()}
