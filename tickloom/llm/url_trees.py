"""URL filters: domain and path rules, and boosted trees for the URLs that no rule fits.

All on DataFrames and Spark's own tree learner. Features are lexical: lengths, depth,
shares of digits and signs, entropy, parameter counts, and length and share of vowels of
the host's last label. How often that label is blocked, or seen, is left out: rules go by
it, so trees that are told it learn the rules and judge no other. URLs with a rule are
the labelled ones.
"""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .postings import LOWER, UPPER

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))
#: Labelled rows that the trees are fitted on at most, those with the smallest hash.
SAMPLE_ROWS, TREES, DEPTH, SEED = 10_000, 12, 4, 7
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "sign_ratio",
            "entropy", "parameters", "hyphens", "has_fragment", "is_https", "longest_segment",
            "suffix_length", "suffix_vowels")


def parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, with its verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def entropy(c: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(c, ""))
    terms = F.transform(F.filter(chars, lambda x: x != ""), lambda x: (
        (F.length(c) - F.length(F.replace(c, x))) / n))
    return F.aggregate(terms, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))


def lexical(frame: DataFrame) -> DataFrame:
    """Adds the features to (url, host, path)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    segments, suffix = F.split(F.col("path"), "/"), F.regexp_extract("host", r"([^.]*)$", 1)
    columns = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "labels": F.size(F.split("host", r"\.")), "depth": F.regexp_count("path", F.lit("/")),
        "digit_ratio": share(url, "[0-9]"), "sign_ratio": share(url, "[^A-Za-z0-9]"),
        "entropy": entropy(F.concat("host", "path")), "parameters": F.regexp_count(url, F.lit("[?&][^?&#=]+=")),
        "hyphens": F.regexp_count("host", F.lit("-")), "has_fragment": url.contains("#").cast("int"),
        "is_https": url.startswith("https://").cast("int"),
        "suffix_length": F.length(suffix), "suffix_vowels": share(suffix, "[aeiou]"),
        "longest_segment": F.array_max(F.transform(segments, F.length)),
    }
    return frame.withColumns({k: v.cast("double") for k, v in columns.items()})


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, sample_rows: int = SAMPLE_ROWS):
    """The model, or the only verdict, from (url, host, path, verdict). Each url counts once,
    so that copies of one don't fill the sample."""
    chosen = settle(lexical(labelled.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(sample_rows))
                    .withColumn("label", (F.col("verdict") == "block").cast("double")))
    whole = chosen.agg(F.count("*").alias("n"), F.avg("label").alias("blocked")).first()
    if not whole["n"] or whole["blocked"] in (0.0, 1.0):
        return "block" if whole["blocked"] == 1.0 else "allow"
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=SEED,
                          cacheNodeIds=False).fit(
        assembled(chosen).select("features", "label").coalesce(1))
    return model


def assembled(frame: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id",
                url: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict (allow or block: the
    rule's, else the trees') and score (the trees' probability of block).

    A null url, or one without ``://``, has an empty host and path, so no rule fits and the
    trees judge it. Repeated urls have each a row, and count once in the fit. Without labelled rows the verdict is
    allow; if all have one verdict, it is that. Other columns are not read."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("fit", rule(F.col("host"), F.col("path"), rules))
    model = train(rows.where("fit is not null").select("url", "host", "path", "fit.verdict"))
    if isinstance(model, GBTClassificationModel):
        scored = model.transform(assembled(lexical(rows))).withColumn(
            "score", F.round(vector_to_array("probability")[1], 9))
        judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    else:
        scored, judged = rows.withColumn("score", F.lit(float(model == "block"))), F.lit(model)
    return scored.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", judged).alias("verdict"), "score")
