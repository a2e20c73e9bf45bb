"""Operator 10: URL filtering by rules, and by gradient-boosted trees on lexical features where no rule fits.

Everything is a column expression, a join, a sum or a tree ensemble of Spark's own: no Python runs on the executors. The
trees learn from the URLs that a rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules at most: they are one expression.
MOST_RULES = 1000
#: Labelled rows that the trees learn from: about so many, each drawn for itself.
SAMPLE = 20_000
#: Pseudo-rows with the overall rate of blocks that every suffix is given.
PRIOR = 20.0
FEATURES = ("url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digits", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "escapes", "fragment", "secure", "suffix_rate", "suffix_share")


@dataclass(frozen=True)
class Rule:
    """`host/path`, for the host and all its subdomains and the paths that start so."""

    text: str
    block: bool

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1] if "/" in self.text else ""


#: The rules of the contract.
RULES = (Rule("net/", True), Rule("example.net/en/", False), Rule("example.com/de/", True), Rule("org/fr/", False))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the URL is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as text; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return F.coalesce(*(F.when(fits(r), F.lit(r.text)) for r in ranked), F.lit(None).cast("string"))


def share(part: Column, whole: Column) -> Column:
    return F.length(part) / F.greatest(F.length(whole), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character of the text's own characters."""
    size = F.greatest(F.length(text), F.lit(1))
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.aggregate(each, F.lit(0.0), lambda sum_, p: sum_ - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """`pages` (url, host, path) with the lexical features but for those of the suffix, and the suffix."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = lambda text, kind: F.regexp_replace(text, f"[^{kind}]", "")
    return pages.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "query_length": F.length(query),
            "host_depth": F.size(F.split(host, r"\.")),
            "path_depth": F.length(kept(path, "/")),
            "digits": share(kept(url, "0-9"), url),
            "host_digits": share(kept(host, "0-9"), host),
            "hyphens": F.length(kept(url, "_-")),
            "entropy": entropy(url),
            "host_entropy": entropy(host),
            "parameters": F.when(query == "", 0).otherwise(F.length(kept(query, "&;")) + 1),
            "escapes": F.length(kept(url, "%")),
            "fragment": F.contains(url, F.lit("#")).cast("int"),
            "secure": F.startswith(F.lower(url), F.lit("https:")).cast("int"),
            "suffix": F.concat_ws(".", F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2)),
        }
    )


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block), score (the trees' probability of a block).

    The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, the path what follows up to `?`,
    `#` or the end; null URLs and those without `://` have both empty. The longest rule that fits decides; else the trees
    do: block at `least` or more. They learn from about SAMPLE rows that a rule decides; if those are all of one verdict or
    there are none, that verdict (allow if none) is given with score 1 or 0. Suffix statistics are counted over all rows, for a
    row that a rule decides without itself. Rules are the only labels.
    Repeated rows and null ids keep a row each; an empty table gives an empty result; other columns are not read.
    """
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    found = read.withColumns({"host": host, "path": path})
    found = found.withColumn("rule", fitting(rules, F.col("host"), F.col("path")))
    blocks = [r.text for r in rules if r.block]
    found = lexical(found.withColumn("label", F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocks).cast("double"))))
    # The statistics of a row leave out its own label, else the trees would read it there: they are counted by suffix and
    # label, and a labelled row takes itself off.
    by_suffix = checkpointed(found.groupBy("suffix").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")))
    total, labelled, blocked = by_suffix.agg(F.sum("n"), F.sum("known"), F.sum("bad")).first()
    rate = (blocked or 0.0) / max(labelled or 0, 1)
    if 0 < (blocked or 0) < (labelled or 0):
        own = F.col("label").isNotNull().cast("int")
        smooth = (F.col("bad") - F.coalesce("label", F.lit(0.0)) + PRIOR * rate) / (F.col("known") - own + PRIOR)
        statistics = {"suffix_rate": smooth, "suffix_share": F.col("n") / max(total, 1)}
        numbers = [F.col(c).cast("double").alias(c) for c in FEATURES]
        full = found.join(by_suffix, "suffix").withColumns(statistics).select("page_id", "host", "path", "rule", "label", *numbers)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        drawn = found.where("label is not null")
        if labelled > SAMPLE:
            drawn = drawn.where(F.rand(10) < SAMPLE / labelled)
        drawn = drawn.join(by_suffix, "suffix").withColumns(statistics).select("label", *numbers)
        train = checkpointed(vectors.transform(drawn).select("features", "label"))
        model = GBTClassifier(maxIter=15, maxDepth=4, maxBins=32, stepSize=0.3, seed=10, cacheNodeIds=False).fit(train)
        score = vector_to_array(F.col("probability"))[1]
        scored = model.transform(vectors.transform(full)).select("page_id", "host", "path", "rule", "label", score.alias("score"))
    else:
        scored = found.select("page_id", "host", "path", "rule", "label", F.lit(float(rate)).alias("score"))
    block = F.when(F.col("label").isNotNull(), F.col("label") == 1.0).otherwise(F.col("score") >= least)
    return scored.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "score")


__all__ = ["RULES", "Rule", "entropy", "fitting", "judged", "lexical", "parts"]
