"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are those of three patterns, leftmost and non-overlapping for each. The method adds spans of
further credential shapes, and decides on them by ownership: the hashes of all candidates are counted by
distinct repositories and owners over the whole corpus. A value that `copied` or more owners hold, or that lies in `copied_repos`
or more repositories, whoever owns them, is a widely copied example (documentation, test vectors); another is specific to its owners and looks
live. Only live-looking added candidates become spans; base spans always stay.

Regular expressions give no positions in Spark SQL, so a text is both cut at the matches and reduced to
them; the running sums of the lengths, in a window over each text's matches, are the positions, in code points. Only texts that contain a match
pay for this, in proportion to their length. Nothing but candidates is shuffled: counts are combined on the map side, so a value that a
third of all rows hold costs one row a task, and the join of candidates with counts may be split for skew.

Nulls: a null text counts as empty; a null repository or owner is one more value of its own. Repeated ids
stay rows of their own. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KEYWORD = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"
#: kind -> (pattern, least length of the part that counts, pattern of what stands before that part)
BASE = {
    "assign": (KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 12, "^" + KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?"),
    "access": ("AKIA[A-Z0-9]{14,}", 18, ""),
    "hex": ("[0-9a-f]{16,}", 16, ""),
}
#: Shapes that the method adds, where their owners are few.
ADDED = {
    "bearer": ("[Bb]earer\\x20+[A-Za-z0-9._~+/-]{20,}=*", 20, ""),
    "issued": ("(?:gh[pousr]_|xox[abprs]-|sk-|pk_live_|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 20, ""),
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 27, ""),
    "url": ("[a-z][a-z0-9+.-]{1,15}://[^\\s/:@]{1,64}:[^\\s/:@]{6,128}@", 12, ""),
}
ORDER = [*BASE, *ADDED]


def matches_of(text: Column, kind: str) -> Column:
    """array<struct<place, gap, m>> of one kind: each match, and the code points between it and the one before."""
    pattern = (BASE | ADDED)[kind][0]
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)
    pairs = F.zip_with(found, between, lambda m, g: F.struct(F.lit(ORDER.index(kind)).alias("place"), F.length(g).cast("bigint").alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<place:int,gap:bigint,m:string>>")
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x["m"].isNotNull())).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row for each row of docs: _row, doc_id, repo, owner, found (array of all kinds' matches)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[matches_of(text, kind) for kind in ORDER])
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), found.alias("found"))


def spans_of(found: DataFrame) -> DataFrame:
    """One row for each match that counts: _row, repo, owner, start, place, kind, stop, hash. The positions are running sums of the
    lengths, in one pass over a text's matches, so their number costs no more than its logarithm beyond proportion."""
    flat = found.where(F.size("found") > 0).select("_row", "repo", "owner", F.posexplode("found").alias("at", "x"))
    flat = flat.select("_row", "repo", "owner", "at", "x.*")
    until = Window.partitionBy("_row", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("stop", F.sum(F.col("gap") + F.length("m")).over(until))
    value, least = F.col("m"), F.lit(0)
    for place, kind in enumerate(ORDER):
        _, size, before = (BASE | ADDED)[kind]
        here = F.col("place") == place
        least = F.when(here, size).otherwise(least)
        if before:
            value = F.when(here, F.regexp_replace("m", before, "")).otherwise(value)
    kinds = F.element_at(F.array(*map(F.lit, ORDER)), F.col("place") + 1)
    flat = flat.withColumns({"value": value, "least": least}).where(F.length("value") >= F.col("least"))
    return flat.select("_row", "repo", "owner", (F.col("stop") - F.length("m")).alias("start"), "place", kinds.alias("kind"), "stop", F.sha2("value", 256).alias("hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners: in how many repositories and with how many owners each candidate value occurs."""
    rows = spans.select("hash", F.struct("repo").alias("repo"), F.struct("owner").alias("owner"))
    # Distinct by hand: each level is combined on the map side.
    both = rows.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("_1"))
    repos = both.groupBy("hash", "repo").agg(F.lit(0).alias("o")).select("hash", F.lit(1).alias("r"), "o")
    owners = both.groupBy("hash", "owner").agg(F.lit(1).alias("o")).select("hash", F.lit(0).alias("r"), "o")
    return repos.union(owners).groupBy("hash").agg(F.sum("r").alias("n_repos"), F.sum("o").alias("n_owners"))


def joined(spans: Column) -> Column:
    """kind:start:stop, by start and then by the kind's place in ORDER (the spans' first two fields), comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", copied: int = 3, copied_repos: int = 12) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_specific, most_repos, most_owners.

    n_copied and n_specific count the row's candidates of any kind whose value is a widely copied example, or not;
    most_repos and most_owners are the largest counts of repositories and owners among them.
    """
    found = cut(candidates(docs, id_col, text_col, repo_col, owner_col))
    flat = cut(spans_of(found))
    live = (F.col("n_owners") < copied) & (F.col("n_repos") < copied_repos)
    known = flat.join(ownership(flat), "hash", "left").withColumn("live", live)
    span = F.struct("start", "place", "kind", "stop")
    base = F.col("place") < len(BASE)
    per_row = known.groupBy("_row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(base | F.col("live"), span)).alias("all"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.count_if("live").alias("n_specific"),
        F.max("n_repos").alias("most_repos"),
        F.max("n_owners").alias("most_owners"),
    )
    out = found.select("_row", "doc_id").join(per_row, "_row", "left")
    numbers = [*(f"n_{k}" for k in (*BASE, "copied", "specific")), "most_repos", "most_owners"]
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers]
    text = [F.coalesce(joined(F.col(c)), F.lit("")) for c in ("base", "all")]
    return out.select("doc_id", *zero[:3], F.sha2(text[0], 256).alias("base_sha256"), text[1].alias("spans"), *zero[3:])


def scan_sql(copied: int = 3, copied_repos: int = 12) -> str:
    """scan() of documents in DuckDB SQL."""
    parts = ["d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents)"]
    for place, (kind, (pattern, least, before)) in enumerate((BASE | ADDED).items()):
        quoted, lead = pattern.replace("'", "''"), before.replace("'", "''")
        value = f"regexp_replace(m, '{lead}', '')" if before else "m"
        parts.append(f"""m_{kind} AS (SELECT r, source, regexp_extract_all(text, '{quoted}') AS ms, list_transform(regexp_split_to_array(text, '{quoted}'), lambda x: length(x)) AS gs FROM d),
        e_{kind} AS (SELECT r, source, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(gs[1:i]), 0) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0))) AS a FROM m_{kind}),
        s_{kind} AS (SELECT r, source, {place} AS place, '{kind}' AS kind, a::BIGINT AS a, a::BIGINT + length(m) AS b, {value} AS v FROM e_{kind} WHERE length({value}) >= {least})""")
    parts.append("spans AS (" + " UNION ALL ".join(f"SELECT * FROM s_{k}" for k in ORDER) + ")")
    parts.append(f"own AS (SELECT v, count(DISTINCT coalesce('+' || source, '')) AS held, held < {copied} AND held < {copied_repos} AS live FROM spans GROUP BY v)")
    shown = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place)"
    parts.append(
        "per AS (SELECT r, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
        + f", {shown} FILTER (place < {len(BASE)}) AS base, {shown} FILTER (place < {len(BASE)} OR live) AS spans, count(*) FILTER (NOT live) AS n_copied, count(*) FILTER (live) AS n_specific, max(held) AS most_repos, max(held) AS most_owners FROM spans JOIN own USING (v) GROUP BY r)"
    )
    numbers = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*BASE, "copied", "specific")) + ", coalesce(most_repos, 0) AS most_repos, coalesce(most_owners, 0) AS most_owners"
    return f"WITH {', '.join(parts)} SELECT doc_id, {numbers}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"
