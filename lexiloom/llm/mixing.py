"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The tokens of each (source, lang, topic) cell are raked: in turn, the cells of every source, language and
topic are scaled so that they sum to that margin's target, round after round. A document is then sampled with
probability p = raked tokens of its cell / tokens of its cell, by a hash of its id, so the sample is the same wherever and however often it is drawn.

No cell can give more tokens than it has, so the raking is bounded: each scaling stops a cell at its tokens, and later scalings make up for it in
the other cells. `rate` is the share of all tokens that is asked for. Where a margin's target asks for more than there is, or no bounded solution is found, a
smaller rate is taken: of `STEPS` rates, each `SHRINK` of the one before, the largest whose margins all lie within `TOLERANCE` of the targets (else the one that comes
closest). So the expected shares of the sample meet the targets; `margins` reports target and expected share of every value.
`repeated` keeps the rate instead, and draws documents of scarce cells more than once: the whole number of copies in the unbounded ratio, and one more
with the probability of its fraction.

Cells, not documents, are raked: one aggregation with partial sums shuffles the corpus once, as one row
a cell and task, and a cell that holds a third of all rows is no larger than another. Few cells are raked in one task, more by shuffle. The cells come back to the
documents by a join on the three columns: broadcast after a count shows them few, else by shuffle.

Targets default to the tempered shares tokens ** alpha (alpha 0.5 for each margin), normalised; a margin may be given as a
dictionary instead, whose missing values get weight 0.

Nulls: null source, lang and topic are values of their own. A null text has 0 tokens; documents without
tokens are in no sample's budget and get probability 0. Rows without id draw by their text. Repeated ids stay rows of their own and
share their fate. Columns topic, n_tokens, p and kept of the input are replaced in the report and handed on in the sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MARGINS = ("source", "lang", "topic")
ROUNDS, ALPHA, RATE = 16, 0.5, 0.5
#: Rates that are tried, each this part of the one before; how far a margin's share may be off.
STEPS, SHRINK, TOLERANCE = 8, 0.85, 0.001
#: Cells that one task rakes at most.
MOST_LOCAL = 20_000
#: Cells that are broadcast to the documents at most; more are joined by shuffle.
MOST_BROADCAST = 100_000


def topic(text: Column) -> Column:
    """A topic from what the text holds: licence, contact, table or prose."""
    return (
        F.when(F.contains(text, F.lit("icense")), "licence")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words of the six white-space characters' contract: the places where one begins."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 28 bits of the MD5 of the id, or of the text where there is no id."""
    own = F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(own), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def cells(docs: DataFrame) -> DataFrame:
    """source, lang, topic, tokens of the documents with tokens."""
    return docs.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0")


def with_targets(cell: DataFrame, targets: dict[str, dict[str | None, float]] | None, alpha: float) -> DataFrame:
    """cell with the share that each margin asks for: _source, _lang, _topic."""
    out = cell
    for m in MARGINS:
        if targets and m in targets:
            total = sum(targets[m].values())
            share = F.lit(0.0)
            for value, weight in targets[m].items():
                share = F.when(F.col(m).eqNullSafe(F.lit(value)), weight / total).otherwise(share)
            out = out.withColumn(f"_{m}", share)
        else:
            sums = cell.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("_t"))
            whole = sums.agg(F.sum("_t")).first()[0] or 1.0
            shares = sums.select(F.col(m).alias("_v"), (F.col("_t") / F.lit(whole)).alias(f"_{m}"))
            out = out.join(shares, F.col(m).eqNullSafe(F.col("_v"))).drop("_v")
    return cut(out)


def scaled(out: DataFrame, rounds: int, by: tuple[str, ...], want: Column, most: Column | None, local: bool) -> DataFrame:
    """out with its weights scaled to the margins in turn. Each scaling is one window over the cells of a margin."""
    for k in range(rounds):
        if local and k % 4 == 0:
            out = out.coalesce(1)  # one task, so no window shuffles
        for m in MARGINS:
            have = F.sum("weight").over(Window.partitionBy(*by, m))
            new = F.when(have > 0, F.col("weight") * F.col(f"_{m}") * want / have).otherwise(0.0)
            out = out.withColumn("weight", new if most is None else F.least(most, new))
        if k % 4 == 3:
            out = cut(out)
    return out


def rake(cell: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """cell with `weight`: raked shares that sum to 1 (the targets of the last margin are met exactly), whatever the cells hold."""
    out = with_targets(cell, targets, alpha).withColumn("weight", F.col("tokens"))
    out = scaled(out, rounds, (), F.lit(1.0), None, out.count() <= MOST_LOCAL)
    return out.select(*MARGINS, "tokens", "weight")


def calibrated(cell: DataFrame, targets: dict | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """cell with the targets' shares, and `weight`: the tokens to draw, at most those of the cell, at the largest rate that meets the margins."""
    out = with_targets(cell, targets, alpha)
    whole = out.agg(F.sum("tokens")).first()[0] or 0.0
    for m in MARGINS:
        have = F.sum("tokens").over(Window.partitionBy(m))
        out = out.withColumn(f"_fits_{m}", F.when(F.col(f"_{m}") > 0, have / (F.col(f"_{m}") * F.lit(whole))))
    # Without targets above 0 nothing fits, and nothing is drawn.
    fits = out.agg(F.min(F.least(*[f"_fits_{m}" for m in MARGINS]))).first()[0]
    most = min(rate, fits or 0.0)
    tried = F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(most * whole * SHRINK**k).alias("_want")) for k in range(STEPS)])
    out = out.drop(*[f"_fits_{m}" for m in MARGINS]).select("*", F.inline(tried)).withColumn("weight", F.col("tokens") * F.col("_want") / F.lit(whole or 1.0))
    out = scaled(out, rounds, ("_k",), F.col("_want"), F.col("tokens"), out.count() <= MOST_LOCAL)
    drawn_in = lambda *by: F.sum("weight").over(Window.partitionBy("_k", *by))
    off = [F.abs(F.try_divide(drawn_in(m), drawn_in()) - F.col(f"_{m}")) for m in MARGINS]
    residual = {r._k: r.off for r in out.withColumn("off", F.greatest(*off)).groupBy("_k").agg(F.max("off").alias("off")).collect()}
    best = min(residual, key=lambda k: (residual[k] > TOLERANCE, k if residual[k] <= TOLERANCE else residual[k], k), default=0) if all(v is not None for v in residual.values()) else 0
    return out.where(F.col("_k") == best).drop("_k", "_want")


def margins(cell: DataFrame) -> DataFrame:
    """margin, value, target, expected (share of the tokens drawn), residual, of calibrated cells."""
    whole = cell.agg(F.sum("weight")).first()[0] or 1.0
    out = None
    for m in MARGINS:
        part = cell.groupBy(m).agg(F.first(f"_{m}").alias("target"), (F.sum("weight") / F.lit(whole)).alias("expected"))
        part = part.select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), "target", "expected", (F.col("expected") - F.col("target")).alias("residual"))
        out = part if out is None else out.unionByName(part)
    return out


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.drop("p", "kept", "ratio", "times").withColumns({"topic": topic(text), "n_tokens": tokens(text).cast("bigint")})


def joined(docs: DataFrame, share: DataFrame, value: str) -> DataFrame:
    """docs with the value of their cell, 0 for documents without tokens."""
    share = cut(share.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], value))
    if share.count() <= MOST_BROADCAST:
        share = F.broadcast(share)
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    out = docs.join(share, same, "left").drop(*[f"_{m}" for m in MARGINS])
    return out.withColumn(value, F.when(F.col("n_tokens") > 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0))


def probabilities(docs: DataFrame, targets: dict | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """docs with topic, n_tokens, p (probability to be sampled) and kept (whether the id's hash falls below p)."""
    docs = measured(docs)
    cell = calibrated(cut(cells(docs)), targets, alpha, rounds, rate)
    out = joined(docs, cell.withColumn("p", F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))), "p")
    return out.withColumn("kept", uniform(F.col("doc_id"), F.col("text")) < F.col("p"))


def copies(docs: DataFrame, targets: dict | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """docs with topic, n_tokens, ratio (expected copies) and times (copies)."""
    docs = measured(docs)
    cell = rake(cut(cells(docs)), targets, alpha, rounds)
    whole = cell.agg(F.sum("tokens")).first()[0] or 0.0
    out = joined(docs, cell.withColumn("ratio", F.lit(rate) * F.col("weight") * F.lit(whole) / F.col("tokens")), "ratio")
    more = (uniform(F.col("doc_id"), F.col("text")) < F.col("ratio") - F.floor("ratio")).cast("bigint")
    return out.withColumn("times", F.floor("ratio") + more)


def drawn(docs: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What rows() makes of docs, with docs' own columns (also where one is named as a column that is made here)."""
    used = {"doc_id", "source", "lang", "text"}
    own = {c: c if c in used else f"_own_{c}" for c in docs.columns}
    out = rows(docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    return out.select([F.col(f"`{n}`").alias(c) for c, n in own.items()])


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, each once."""
    return drawn(docs, lambda d: probabilities(d, **options).where("kept"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as its cell's unbounded weight asks."""
    return drawn(docs, lambda d: copies(d, **options).where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p (6 places), kept for every row of docs."""
    out = probabilities(docs, **options)
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("p", 6).alias("p"), "kept")


def probabilities_sql(docs: str = "documents", alpha: float = ALPHA, rounds: int = ROUNDS, rate: float = RATE) -> tuple[str, str]:
    """DuckDB: common table expressions, and the last one's name (docs' columns with topic, n_tokens, p, kept)."""
    parts = [
        f"""mx AS (SELECT *, CASE WHEN contains(coalesce(text, ''), 'icense') THEN 'licence' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
        WHEN contains(coalesce(text, ''), ' | ') THEN 'table' ELSE 'prose' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {docs})""",
        "cell AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM mx GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in MARGINS:
        parts.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens), {alpha}) AS t FROM cell GROUP BY {m})")
        parts.append(f"s_{m} AS (SELECT {m}, t / (SELECT sum(t) FROM t_{m}) AS s FROM t_{m})")
    parts.append("whole AS (SELECT sum(tokens) AS w FROM cell)")
    least = ", ".join(f"(SELECT min(h / (s * w)) FROM (SELECT {m}, sum(tokens) AS h FROM cell GROUP BY {m}) c JOIN s_{m} s ON c.{m} IS NOT DISTINCT FROM s.{m}, whole)" for m in MARGINS)
    parts.append(f"most AS (SELECT least({rate}, {least}) AS r)")
    shares = " ".join(f"JOIN s_{m} ON c.{m} IS NOT DISTINCT FROM s_{m}.{m}" for m in MARGINS)
    parts.append(f"""w0 AS MATERIALIZED (SELECT c.*, {", ".join(f"s_{m}.s AS _{m}" for m in MARGINS)}, k, r * w * pow({SHRINK}, k) AS want, tokens * (r * pow({SHRINK}, k)) AS weight
        FROM cell c {shares}, range({STEPS}) t(k), most, whole)""")
    last = "w0"
    for k in range(rounds):
        for m in MARGINS:
            new = f"w_{k}_{m}"
            parts.append(f"{new} AS MATERIALIZED (SELECT * EXCLUDE (weight), least(tokens, weight * _{m} * want / sum(weight) OVER (PARTITION BY k, {m})) AS weight FROM {last})")
            last = new
    off = ", ".join(f"abs(sum(weight) OVER (PARTITION BY k, {m}) / sum(weight) OVER (PARTITION BY k) - _{m})" for m in MARGINS)
    parts.append(f"off AS (SELECT k, max(o) AS o FROM (SELECT k, greatest({off}) AS o FROM {last}) GROUP BY k)")
    parts.append(f"best AS (SELECT k AS best FROM off ORDER BY o > {TOLERANCE}, CASE WHEN o <= {TOLERANCE} THEN k ELSE o END, k LIMIT 1)")
    parts.append(f"share AS (SELECT source, lang, topic, least(1.0, weight / tokens) AS p FROM {last}, best WHERE k = best)")
    digits = " + ".join(f"(instr('0123456789abcdef', substr(md5(coalesce(doc_id::VARCHAR, text, '')), {k + 1}, 1)) - 1) * {16 ** (6 - k)}.0" for k in range(7))
    parts.append(
        f"""drawn AS (SELECT m.*, CASE WHEN n_tokens > 0 THEN coalesce(s.p, 0) ELSE 0 END AS p,
        ({digits}) / {1 << 28}.0 < CASE WHEN n_tokens > 0 THEN coalesce(s.p, 0) ELSE 0 END AS kept
        FROM mx m LEFT JOIN share s ON m.source IS NOT DISTINCT FROM s.source AND m.lang IS NOT DISTINCT FROM s.lang AND m.topic IS NOT DISTINCT FROM s.topic)"""
    )
    return ", ".join(parts), "drawn"


def mix_sql() -> str:
    with_, last = probabilities_sql()
    return f"WITH {with_} SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, kept FROM {last}"
