"""URL verdicts: rules first, and a ratio of two character models for what no rule decides.

URLs that a rule allows or blocks are the labelled examples. For each of the two classes a smoothed
Markov model of variable order predicts every character from up to ``order`` characters before it. A
string of characters is a node of the model when it makes up at least one part in ``limit`` of all
training positions, so there are at most ``limit`` nodes of each length, whatever the corpus: that is
the proven size of what is broadcast. A node's probability is interpolated with that of the shorter
context in Witten and Bell's way; a missing node passes its context's escape weight on to the shorter
context. The score of a URL is the difference of the two log-likelihoods (natural) per character, the
end counted; its threshold is calibrated on labelled URLs that the models have not seen.

Everything runs as DataFrame functions: positions are exploded and summed per row within the task that
made them, so a shuffle carries one row for each URL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
#: Probability of a character that no model has: one code point of all.
FLAT = 1.0 / 0x110000
BINS = 200


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        found = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _positions(rows: DataFrame, order: int) -> DataFrame:
    """One row for each character: ``g0`` the character itself, ``gk`` with the k characters before it (else null)."""
    text = F.concat(F.lit(START), F.col("chars"), F.lit(END))
    seen = rows.withColumn("s", text).withColumn("i", F.explode(F.sequence(F.lit(2), F.length("s"))))
    return seen.select(
        *rows.columns,
        *[F.when(F.col("i") > k, F.substr("s", F.col("i") - k, F.lit(k + 1))).alias(f"g{k}") for k in range(order + 1)],
    )


@dataclass(frozen=True)
class Model:
    """``nodes``: gram with its probability for each class; ``escapes``: context with the weight passed on."""

    order: int
    nodes: DataFrame
    escapes: DataFrame


def train(labelled: DataFrame, order: int, limit: int) -> Model:
    """From rows of (chars, verdict), verdict 'allow' or 'block'."""
    spots = _positions(labelled.select("chars", "verdict"), order)
    grams = spots.select("verdict", F.explode(F.array(*[F.col(f"g{k}") for k in range(order + 1)])).alias("gram")).where("gram is not null")
    of = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    counts = materialise(grams.groupBy("gram").agg(of("allow").alias("na"), of("block").alias("nb")))
    totals = counts.where(F.length("gram") == 1).agg(F.sum("na"), F.sum("nb")).first()
    least = [max(1, -(-2 * (n or 0) // limit)) for n in totals]  # of each class's own positions, so that the rarer one keeps its strings
    kept = counts.where((F.col("na") >= least[0]) | (F.col("nb") >= least[1])).withColumn("k", F.length("gram") - 1)
    kept = kept.withColumn("ctx", F.substr("gram", F.lit(1), F.col("k")))
    many = lambda c: F.sum((F.col(c) > 0).cast("long"))
    stats = materialise(kept.groupBy("ctx").agg(F.sum("na").alias("ta"), many("na").alias("da"), F.sum("nb").alias("tb"), many("nb").alias("db")))
    smooth = lambda n, t, d, p: F.when(t + d > 0, (n + d * p) / (t + d)).otherwise(p)
    levels: list[DataFrame] = []
    for k in range(order + 1):
        rows = kept.where(F.col("k") == k).join(stats, "ctx")
        if k:
            rows = rows.join(levels[-1].select(F.col("gram").alias("shorter"), "pa", "pb"), F.substr("gram", F.lit(2)) == F.col("shorter"))
        pa, pb = (F.col("pa"), F.col("pb")) if k else (F.lit(FLAT), F.lit(FLAT))
        p = [smooth(F.col(f"n{c}"), F.col(f"t{c}"), F.col(f"d{c}"), x).alias(f"p{c}") for c, x in (("a", pa), ("b", pb))]
        levels.append(materialise(rows.select("gram", *p)))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.union(more)
    escape = lambda c: F.when(F.col(f"t{c}") > 0, F.col(f"d{c}") / (F.col(f"t{c}") + F.col(f"d{c}"))).otherwise(1.0)
    return Model(order, nodes, stats.select("ctx", escape("a").alias("ea"), escape("b").alias("eb")))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``chars``) and ``score``: the log ratio of accepted to rejected, per character."""
    spots = _positions(rows, model.order)
    a = b = F.lit(FLAT)
    for k in range(model.order + 1):
        nodes = model.nodes.where(F.length("gram") == k + 1).select(F.col("gram").alias(f"g{k}"), F.col("pa").alias(f"a{k}"), F.col("pb").alias(f"b{k}"))
        ctx = model.escapes.where(F.length("ctx") == k).select(F.col("ctx").alias(f"c{k}"), F.col("ea").alias(f"x{k}"), F.col("eb").alias(f"y{k}"))
        spots = spots.join(F.broadcast(nodes), f"g{k}", "left").withColumn(f"c{k}", F.substr(f"g{k}", F.lit(1), F.lit(k)))
        spots = spots.join(F.broadcast(ctx), f"c{k}", "left")
        a = F.coalesce(f"a{k}", F.coalesce(f"x{k}", F.lit(1.0)) * a)
        b = F.coalesce(f"b{k}", F.coalesce(f"y{k}", F.lit(1.0)) * b)
    return spots.groupBy(*rows.columns).agg(F.avg(F.log(a) - F.log(b)).alias("score"))


def calibrated(scored: DataFrame) -> float:
    """The threshold, a multiple of 1 / BINS, with the greatest sum of both classes' hit rates; nearest to 0 among equals.

    From rows of (score, verdict). Without examples of both classes it is 0. Scores beyond 10 count as 10.
    """
    bins = F.greatest(F.lit(-10 * BINS), F.least(F.lit(10 * BINS), F.floor(F.col("score") * BINS)))
    rows = scored.groupBy(bins.alias("bin"), "verdict").count().collect()
    total = {v: sum(r["count"] for r in rows if r["verdict"] == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    by: dict[int, dict[str, int]] = {}
    for r in rows:
        by.setdefault(r["bin"], {})[r["verdict"]] = r["count"]
    below = {"allow": 0, "block": 0}
    best = (0.0, 0, 0)
    at = sorted({b for b in by} | {b + 1 for b in by} | {0})
    for b in at:  # rows of bins under b are rejected
        gain = below["block"] / total["block"] - below["allow"] / total["allow"]
        best = max(best, (round(gain, 12), -abs(b), b))
        for v, n in by.get(b, {}).items():
            below[v] += n
    return best[2] / BINS


def url_verdicts(pages: DataFrame, rules: list[Rule], order: int = 4, limit: int = 20_000) -> DataFrame:
    """Rows with host, path, rule (null without one), score and verdict ('allow' or 'block').

    The method judges the whole URL, its host in lower case and the rest as it stands, query and fragment included. A
    null URL, or one without ``://``, has an empty host and path; a null one is judged as the empty string. Repeated rows stay as they are, each judged alike. Without labelled URLs all scores are
    0 and the verdict is 'allow'. One in 16 of labelled texts, three times over, calibrates: those whose
    MD5 starts with 0, 1 or 2. Columns named like those added are replaced; the others stay.
    """
    added = ["host", "path", "rule", "score", "verdict"]
    kept = [c for c in pages.columns if c not in added]
    host, path = url_parts(F.col("url").cast("string"))
    found = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("chars"))
    at = F.locate("://", F.col("chars"))
    whole = F.concat(F.substr("chars", F.lit(1), at + 2), F.col("host"), F.substr("chars", at + 3 + F.length("host")))
    found = found.withColumn("chars", F.when(at > 0, whole).otherwise(F.col("chars")))
    found = found.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    found = found.select(
        F.monotonically_increasing_id().alias("rid"), "row", "host", "path", "found.rule", "found.verdict", "chars"
    )
    staged = materialise(found)
    learns = ~F.substr(F.md5("chars"), F.lit(1), F.lit(1)).isin("0", "1", "2")
    labelled = staged.where("verdict is not null")
    model = train(labelled.where(learns), order, limit)
    scores = materialise(score(staged.select("rid", "chars"), model).select("rid", "score"))
    judged = staged.join(scores, "rid")
    threshold = calibrated(judged.where(F.col("verdict").isNotNull() & ~learns).select("score", "verdict"))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path", "rule", "score", verdict.alias("verdict"))
