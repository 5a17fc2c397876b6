"""URL filters: rules for hosts and paths, and boosted trees on lexical features where no rule fits.

The trees learn from the URLs on which a rule decides. Only built-in functions and Spark's own learner are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.tables import checkpointed, salted_lookup

# The trees are fitted on at most so many different URLs of each label; suffixes are counted over all.
TRAIN_URLS = 10_000
TREES = 12
DEPTH = 4
PRIOR = 8.0  # pseudo-counts of the overall share of blocked URLs in that of a suffix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, which stands for its subdomains too, and after it the start of a path."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(text, verdict)`` of the longest rule that fits, the first of equal length; null if none does."""
    ordered = sorted(rules, key=lambda rule: -len(rule.text))
    return F.coalesce(
        F.lit(None).cast("struct<text:string,verdict:string>"),
        *[
            F.when(rule.fits(host, path), F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict")))
            for rule in ordered
        ],
    )


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    length = F.length(text)

    def share(letter: Column) -> Column:
        return (length - F.length(F.replace(text, letter, F.lit("")))) / length

    letters = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0.0), lambda sum_, x: sum_ - share(x) * F.log2(share(x)))
    return F.when(length > 0, bits).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    length = F.length(text)
    return {
        "f_length": length.cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": _count(path, "/").cast("double"),
        "f_labels": _count(host, r"\.").cast("double"),
        "f_digits": F.when(length > 0, _count(text, "[0-9]") / length).otherwise(0.0).cast("double"),
        "f_host_digits": F.when(F.length(host) > 0, _count(host, "[0-9]") / F.length(host)).otherwise(0.0).cast("double"),
        "f_hyphens": _count(text, "-").cast("double"),
        "f_entropy": _entropy(text),
        "f_host_entropy": _entropy(host),
        "f_parameters": _count(text, "[?&]").cast("double"),
        "f_secure": text.startswith("https").cast("double"),
    }


def suffix_of(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """``labels, suffix, seen, bad``: how many different labelled URLs end in a suffix of one or two labels, and how many of
    them are blocked; the suffix of no label has all.

    Different URLs are counted by sketches, which tasks merge before the shuffle: copies of a URL change nothing, and
    a suffix that very many URLs share is no larger than any other.
    """
    suffixes = [F.struct(F.lit(k).alias("labels"), suffix_of(F.col("host"), k).alias("suffix")) for k in (0, 1, 2)]
    each = labelled.select("url", "blocked", F.inline(F.array(*suffixes)))
    bad = F.approx_count_distinct(F.when(F.col("blocked") == 1, F.col("url"))).cast("double")
    return each.groupBy("labels", "suffix").agg(F.approx_count_distinct("url").cast("double").alias("seen"), bad.alias("bad"))


def _rates(rows: DataFrame, counts: DataFrame, share: float, own: Column) -> DataFrame:
    """Adds, for the last one and two labels of the host, the smoothed share of blocked URLs and their number.

    ``own`` is 1 in rows whose own label has been counted, which is then left out of their numbers, so that a rate says
    as much of them as of a URL without a label. Rows meet their suffix of two labels once, which brings both rates.
    """
    two, one = (counts.filter(F.col("labels") == k).select(F.col("suffix").alias(f"suffix{k}"), F.col("seen").alias(f"seen{k}"), F.col("bad").alias(f"bad{k}")) for k in (2, 1))
    keyed = rows.withColumn("suffix2", suffix_of(F.col("host"), 2))
    met = keyed.select("suffix2").distinct().withColumn("suffix1", suffix_of(F.col("suffix2"), 1))
    known = met.join(two, "suffix2", "left").join(one, "suffix1", "left").drop("suffix1").fillna(0.0)
    found = salted_lookup(keyed, "suffix2", known, F.col("url")).drop("suffix2")
    for k in (1, 2):
        seen = F.greatest(F.col(f"seen{k}") - own, F.lit(0.0))
        bad = F.greatest(F.col(f"bad{k}") - own * F.col("blocked"), F.lit(0.0))
        found = found.withColumns({f"f_rate{k}": (bad + share * PRIOR) / (seen + PRIOR), f"f_seen{k}": F.log1p(seen)})
    return found.drop("seen1", "seen2", "bad1", "bad2")


def _sample(labelled: DataFrame, bound: int) -> DataFrame:
    """Of each label at most ``bound`` different URLs: hashes deal them into so many buckets, of each the smallest stays.

    Tasks send one URL a bucket and label, however often a URL is repeated.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(bound)).alias("bucket")
    one = F.min(F.struct(F.hash("url").alias("order"), "url", "host", "path")).alias("one")
    return labelled.groupBy("blocked", bucket).agg(one).select("blocked", "one.url", "one.host", "one.path")


def judge_urls(pages: DataFrame, rules: list[Rule], bound: int = TRAIN_URLS) -> DataFrame:
    """``page_id, host, path, rule, verdict, chance`` of every row of ``pages`` (``page_id``, ``url``).

    The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, the path the
    rest up to ``?``, ``#`` or the end; both are empty without ``://`` or for a null. The longest rule that fits
    decides; ``chance`` is null there. Elsewhere trees do, which were fitted on different URLs that a rule decides, with
    ``chance`` as the chance of ``block``. If rules decide on no URL, or all alike, there is nothing to learn: the verdict
    is then the only one seen, or ``allow``. Rows that repeat are judged one by one and change no other verdict; a URL
    may be of any length; other columns of ``pages`` do not matter. An empty table gives no row.
    """
    own = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    split = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = rule_for(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("_rule", found).withColumns({"rule": F.col("_rule.text"), "said": F.col("_rule.verdict")}).drop("_rule")
    labelled = ruled.filter("said IS NOT NULL").select("url", "host", "path", (F.col("said") == "block").cast("double").alias("blocked"))
    sample = checkpointed(_sample(labelled, bound))
    seen = [row["blocked"] for row in sample.select("blocked").distinct().collect()]
    decided = ruled.filter("said IS NOT NULL").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("chance"))
    rest = ruled.filter("said IS NULL").select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"))
    if len(seen) < 2:
        judged = rest.withColumn("chance", F.lit(float(seen[0]) if seen else 0.0))
    else:
        counts = checkpointed(suffix_counts(labelled))
        whole = counts.filter("labels = 0").agg(F.sum("bad") / F.sum("seen")).first()[0]

        def ready(rows: DataFrame, counted: float) -> DataFrame:
            rated = _rates(rows, counts, float(whole), F.lit(counted))
            marked = rated.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))
            names = sorted(name for name in marked.columns if name.startswith("f_"))
            return VectorAssembler(inputCols=names, outputCol="features").transform(marked)

        known = checkpointed(ready(sample, 1.0).select("features", F.col("blocked").alias("label"), "url").coalesce(1).sortWithinPartitions("url").drop("url"))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1)
        unknown = ready(rest.withColumn("blocked", F.lit(0.0)), 0.0)
        judged = trees.fit(known).transform(unknown).withColumn("chance", vector_to_array("probability")[1])
    verdict = F.when(F.col("chance") >= 0.5, "block").otherwise("allow").alias("verdict")
    return decided.unionByName(judged.select("page_id", "host", "path", "rule", verdict, "chance"))
