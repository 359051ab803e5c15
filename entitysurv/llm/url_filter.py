"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The main path is DataFrame functions only: features, scores and verdicts are Catalyst expressions; the trees are fitted
by Spark's own GBTClassifier and then written out as CASE expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest, salted_join, staged

#: (verdict, host, path prefix): a rule fits its host and all subdomains; the longest host-and-path wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Host words that label a URL as unwanted for training: the fallback where rules and labels do not give both kinds.
SEED_WORDS = ["ads", "adult", "bets", "casino", "farm", "pills", "spam", "track", "win", "xxx"]

FOLDS = 5
FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_digit_ratio", "f_hyphens", "f_entropy", "f_params", "f_query_length", "f_suffix_block", "f_suffix_count", "f_path_block"]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(verdict, name) of the longest rule that fits, null if none does."""
    verdict = name = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
    return (verdict, name) if verdict is not None else (F.lit(None).cast("string"),) * 2


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of letters, digits and the other URL characters."""
    n = F.greatest(F.length(text), F.lit(1))
    total = F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789-._/":
        p = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the fold and the lexical features, without the statistics of suffixes, to columns url, host, path."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.select(
        "*",
        fold_of(F.col("host")).alias("fold"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
        F.concat_ws("/", F.regexp_extract("host", r"([^.]*)$", 1), F.regexp_extract("path", r"^/([^/]*)", 1)).alias("section"),
        F.length(url).cast("double").alias("f_length"),
        F.length("host").cast("double").alias("f_host_length"),
        F.regexp_count("path", F.lit("/[^/]+")).cast("double").alias("f_depth"),
        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("f_labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1))).alias("f_digit_ratio"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("f_hyphens"),
        _entropy(F.col("host")).alias("f_entropy"),
        F.regexp_count(query, F.lit("[^&=]+=")).cast("double").alias("f_params"),
        F.length(query).cast("double").alias("f_query_length"),
    )


def fold_of(host: Column) -> Column:
    """Whole hosts are in one fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), host), F.lit(FOLDS)).cast("int")


def statistics(labelled: DataFrame, key: str) -> DataFrame:
    """(key, fold, n, blocked, rows): how many labelled URLs of the other folds have the key, how many of these are
    blocked, and how many there are in this fold. So a URL's own host has no part in its features."""
    by_fold = labelled.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b"))
    total = by_fold.groupBy(key).agg(F.sum("n").alias("all"), F.sum("b").alias("all_b"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b")))).alias("own"))  # FOLDS entries at most
    every = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).withColumn("o", F.try_element_at("own", "fold"))
    own, own_b = F.coalesce("o.n", F.lit(0)), F.coalesce("o.b", F.lit(0))
    return every.select(key, "fold", (F.col("all") - own).alias("n"), (F.col("all_b") - own_b).alias("blocked"), own.alias("rows"))


def with_statistics(rows: DataFrame, suffixes: DataFrame, sections: DataFrame) -> DataFrame:
    """Joins the smoothed share of blocked URLs of each suffix and of each suffix with first path part, and the count.

    The statistics grow with the URLs and a suffix may have most of them: salted joins, nothing forced to broadcast."""
    share = (F.coalesce("blocked", F.lit(0)) + 1.0) / (F.coalesce("n", F.lit(0)) + 2.0)
    rows = salted_join(rows, suffixes, ["suffix", "fold"], "rows", ["url"], how="left")
    rows = rows.withColumns({"f_suffix_block": share, "f_suffix_count": F.log1p(F.coalesce("n", F.lit(0)).cast("double"))}).drop("n", "blocked", "rows")
    rows = salted_join(rows, sections, ["section", "fold"], "rows", ["url"], how="left")
    return rows.withColumn("f_path_block", share).drop("n", "blocked", "rows")


def _tree(node) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def fit_trees(ready: DataFrame, trees: int = 10, depth: int = 4, seed: int = 11):
    """Spark's gradient-boosted trees on rows of FEATURES and a label of 0.0 or 1.0."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=seed).fit(vectors)


def margin_of(model) -> Column:
    """The model's margin as an expression over FEATURES: the second raw prediction."""
    margin = F.lit(0.0)
    for w, tree in zip(model.treeWeights, model.trees, strict=True):
        margin = margin + F.lit(float(w)) * _tree(tree._call_java("rootNode"))
    return margin


def train(labelled: DataFrame, max_rows: int = 50_000, seed: int = 11) -> tuple[Column, DataFrame, DataFrame]:
    """(margin, suffix statistics, section statistics) from labelled(url, host, path, label 0/1, null: none).

    The statistics are those of all labelled rows, out of fold by host. The trees are fitted on at most max_rows of them,
    those of the lowest seeded hash. Without rows of both labels among these the margin is constant.
    """
    every = with_features(labelled.where("label is not null"))
    suffixes, sections = (staged(statistics(every, k), f"url-{k}") for k in ("suffix", "section"))
    rows = lowest(labelled.where("label is not null"), F.xxhash64(F.lit(seed), "url"), max_rows, "url")
    ready = staged(with_statistics(with_features(rows), suffixes, sections).select(*FEATURES, F.col("label").cast("double").alias("label")), "url-fit")
    kinds = {int(r[0]) for r in ready.select("label").distinct().collect()}
    if len(kinds) < 2:
        return F.lit(1.0 if kinds == {1} else -1.0), suffixes, sections
    return margin_of(fit_trees(ready, seed=seed)), suffixes, sections


def labelled_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, by_rule, rule, label: the rule's verdict where one fits, else labels(url, label 0/1, one row
    per url) of the caller, else 0: what no one has complained of is the background that the blocked ones stand out from.
    Where rules and labels block nothing, SEED_WORDS do: 1 if a part of the host between dots and hyphens is one."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    verdict, name = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"by_rule": verdict, "rule": name})
    given = F.lit(None).cast("int")
    if labels is not None:
        rows, given = rows.join(labels.select("url", F.col("label").cast("int").alias("_given")), "url", "left"), F.col("_given")
    label = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0).otherwise(F.coalesce(given, F.lit(0)))
    rows = rows.select("id", "url", "host", "path", "by_rule", "rule", label.alias("label"))
    if rows.where("label = 1").isEmpty():
        rows = rows.withColumn("label", F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, SEED_WORDS))).cast("int"))
    return rows


def judge(pages: DataFrame, rules=RULES, max_rows: int = 50_000, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """Verdict on every URL: id, url, host, path, rule, margin, verdict (allow or block).

    A rule that fits decides; otherwise the trees do: block if the margin is above 0. They are trained on labelled_urls,
    with statistics that leave a URL's own host out. A null URL or one without :// has empty host and path, fits no rule
    and is judged by its features. Repeated rows and null ids are kept; an empty table gives no rows; other columns are
    left out.
    """
    rows = labelled_urls(pages, rules, labels, id_col, url_col)
    margin, suffixes, sections = train(rows.select("url", "host", "path", "label"), max_rows)
    scored = with_statistics(with_features(rows), suffixes, sections).withColumn("margin", margin)
    return scored.select(F.col("id").alias(id_col), "url", "host", "path", "rule", "margin", F.coalesce("by_rule", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"))


def held_out(pages: DataFrame, rules=RULES, max_rows: int = 50_000, labels: DataFrame | None = None) -> DataFrame:
    """How well the trees do on hosts that they have not seen, over all folds: those of each fold are judged by trees that
    are fitted without it. One row a fold: n, blocked (by label), caught, false_blocks."""
    rows = labelled_urls(pages, rules, labels).withColumn("held", fold_of(F.col("host")))
    each = []
    for f in range(FOLDS):
        margin, suffixes, sections = train(rows.where(f"held <> {f}").select("url", "host", "path", "label"), max_rows)
        judged = with_statistics(with_features(rows.where(f"held = {f}").select("url", "host", "path", "label")), suffixes, sections).withColumn("block", margin > 0)
        each.append(judged.agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"), F.count_if(F.col("block") & (F.col("label") == 1)).alias("caught"), F.count_if(F.col("block") & (F.col("label") == 0)).alias("false_blocks")))
    return reduce(DataFrame.unionByName, each)
