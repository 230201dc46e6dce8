"""URL filter: host and path rules, then a character language-model ratio, in DataFrame operations only.

The URLs that rules decide train two variable-order Markov models, of accepted
and of rejected URLs: order 4, each order smoothed by the next shorter one
(Witten-Bell). Rules leave other URLs open; those are judged by the difference
of the two log-likelihoods per character, against a threshold that a held-out
fifth of the decided URLs calibrates. Log-ratios are whole millionths, so sums
don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.session import materialize, read

# What is done, host, start of path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Characters of context; the least probability of a character; copies of the table that hot n-grams are spread over.
ORDER, UNIFORM, SALTS = 4, 1 / 256, 8
#: Rows (short string, long) of ratios that may be broadcast, about 20 MB; above it a salted, shuffled join is used.
BROADCAST_GRAMS = 250_000
#: Width of a calibration bin in millionths.
BIN = 10_000

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWERED)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides (host and path start), and what it does; null where none fits. The longest wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(pages: DataFrame) -> DataFrame:
    """Every character of each URL with its context, start and end marked."""
    padded = F.concat(F.lit("\x02" * ORDER), "chars", F.lit("\x03"))
    last = F.length("chars") + 1
    return pages.select("row", "allow", "block", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("gram"))


def _ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): for counts(gram, a, b) the log-ratio of accepted to rejected, in millionths."""
    out = counts.select("gram", F.lit(UNIFORM).alias("pa"), F.lit(UNIFORM).alias("pb"))
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        sums = [F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")]
        if k:
            context = F.substring("tail", 1, k).alias("context")
            level = seen.select("*", context).join(seen.groupBy(context).agg(*sums), "context").drop("context")
        else:
            level = seen.select("*", *(F.lit(n or 0).alias(name) for name, n in seen.agg(*sums).first().asDict().items()))
        out = out.withColumn("tail", tail).join(level, "tail")
        mixed = lambda c, n, t, p: F.when(F.col(n) + F.col(t) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        out = out.select("gram", mixed("a", "na", "ta", "pa").alias("pa"), mixed("b", "nb", "tb", "pb").alias("pb"))
    return out.select("gram", F.round((F.log("pa") - F.log("pb")) * 1e6).cast("long").alias("ratio"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score (log-ratio per character in millionths).

    Null URLs and those without ``://`` have empty host and path and are judged
    as empty strings. Repeated rows give repeated results. With no decided URL
    of one kind the threshold is 0 and ties are allowed. Other columns are
    ignored.
    """
    url = F.col("url")
    host, path = parts(url)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit("")).alias("rest"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", F.concat("host", F.substr("rest", F.length("host") + 1)).alias("chars"), rule.alias("rule"), verdict.alias("decided"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows)
    held = F.coalesce(F.col("page_id") % 5 == 0, F.lit(False))
    learn = lambda what: F.when(~held & (F.col("decided") == what), 1).otherwise(0)
    grams = _grams(rows.withColumns({"allow": learn("allow"), "block": learn("block")}))
    counts = materialize(grams.groupBy("gram").agg(F.sum("allow").alias("a"), F.sum("block").alias("b")))
    ratios = _ratios(counts)
    if counts.count() <= BROADCAST_GRAMS:
        rated = grams.join(F.broadcast(ratios), "gram")
    else:
        salted = grams.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
        rated = salted.join(ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["gram", "salt"])
    summed = rated.groupBy("row").agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))
    score = F.floor(F.col("total").cast("double") / F.col("n")).cast("long")
    scored = materialize(rows.join(summed.select("row", score.alias("score")), "row"))
    level = threshold(scored.where(held & F.col("decided").isNotNull()))
    judged = F.when(F.floor(F.col("score") / BIN) < level, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), "score")


def threshold(decided: DataFrame) -> int:
    """The bin from which on URLs are accepted, with the best sum of right shares of both kinds; of equal ones the nearest to 0."""
    bins = decided.groupBy(F.floor(F.col("score") / BIN).cast("long").alias("bin")).agg(F.count_if(F.col("decided") == "allow").alias("a"), F.count_if(F.col("decided") == "block").alias("b"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gain = F.coalesce(F.sum("b").over(below), F.lit(0)) * F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0)) * F.sum("b").over(every)
    best = bins.select("bin", gain.alias("gain"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb")).where("na > 0 and nb > 0")
    first = best.orderBy(F.desc("gain"), F.abs("bin"), "bin").select("bin").first()
    return int(first[0]) if first else 0


def op8_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return judge(read(spark, sf_dir, "pages"))


def _oracle() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda at, start: f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{start}')"
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(at, start)} THEN '{value(what, at + start)}'" for what, at, start in cases) + " END"
    levels = "".join(
        f""",
s{k} AS (SELECT right(gram, {k + 1}) AS tail, left(right(gram, {k + 1}), {k}) AS context, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1, 2),
c{k} AS (SELECT context, sum(a) AS na, sum(b) AS nb, count_if(a > 0) AS ta, count_if(b > 0) AS tb FROM s{k} GROUP BY 1),
p{k} AS MATERIALIZED (SELECT p.gram,
  CASE WHEN c.na + c.ta > 0 THEN (s.a + c.ta * p.pa) / (c.na + c.ta) ELSE p.pa END AS pa,
  CASE WHEN c.nb + c.tb > 0 THEN (s.b + c.tb * p.pb) / (c.nb + c.tb) ELSE p.pb END AS pb
  FROM p{k - 1} p JOIN s{k} s ON right(p.gram, {k + 1}) = s.tail JOIN c{k} c USING (context))""".replace("p-1 p", "p_ p")
        for k in range(ORDER + 1)
    )
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{UPPER}', '{LOWERED}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, page_id, host, path, host || substr(rest, length(host) + 1) AS chars,
  {pick(lambda what, rule: rule)} AS rule, {pick(lambda what, rule: what)} AS decided, coalesce(page_id % 5 = 0, FALSE) AS held FROM h),
g AS MATERIALIZED (SELECT row, held, decided, substr(repeat(chr(2), {ORDER}) || chars || chr(3), unnest(range(1, length(chars) + 2)), {ORDER + 1}) AS gram FROM d),
counts AS MATERIALIZED (SELECT gram, (count(*) FILTER (WHERE NOT held AND decided = 'allow'))::DOUBLE AS a, (count(*) FILTER (WHERE NOT held AND decided = 'block'))::DOUBLE AS b FROM g GROUP BY 1),
p_ AS (SELECT gram, {UNIFORM}::DOUBLE AS pa, {UNIFORM}::DOUBLE AS pb FROM counts){levels},
t AS (SELECT row, floor(sum(round((ln(pa) - ln(pb)) * 1e6)::BIGINT)::DOUBLE / count(*))::BIGINT AS score FROM g JOIN p{ORDER} USING (gram) GROUP BY 1),
x AS (SELECT d.*, score, floor(score / {BIN})::BIGINT AS bin FROM d JOIN t USING (row)),
bins AS (SELECT bin, count_if(decided = 'allow') AS a, count_if(decided = 'block') AS b FROM x WHERE held AND decided IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, coalesce(sum(b) OVER w, 0) * sum(a) OVER () - coalesce(sum(a) OVER w, 0) * sum(b) OVER () AS gain, sum(a) OVER () AS na, sum(b) OVER () AS nb
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce((SELECT bin FROM gains WHERE na > 0 AND nb > 0 ORDER BY gain DESC, abs(bin), bin LIMIT 1), 0) AS level)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN bin < level THEN 'block' ELSE 'allow' END) AS verdict, score FROM x, level
"""


ORACLE = _oracle()
