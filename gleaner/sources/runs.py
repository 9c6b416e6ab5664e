"""Recorded runs, labelled sets, ground truth, and what is reckoned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import texts, urls

_DOC = "array<struct<url:string,name:string,why:string>>"
_LINK = "array<struct<url:string,name:string,context:string,section:string,column:string,path:string,dated:string,chrome:boolean>>"
TRUTH = f"site string, goal string, start_url string, profile string, goal_year string, shape string, notes string, expected_documents {_DOC}, decoy_documents {_DOC}, off_domain boolean, match_query boolean, identity_re string, latest boolean"
RUN = "site string, goal string, pages array<struct<page_no:int,url:string>>, page_kinds array<struct<url:string,kind:string,probability:double,sitemap:boolean>>, candidates array<struct<url:string,verdict:string,source:string>>"
HARVEST = f"url string, title string, html string, documents {_LINK}, page_links {_LINK}"
LABELLED = "site string, goal string, batch string, context string, url string, text string, row_text string, section string, column string, label int"


def ground_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, expected, decoys) of hand-checked JSON files, identities made by each entry's own rule; decoys that are
    expected do not count.  Files named ``example`` are left out."""
    d = spark.read.schema(TRUTH).json(folder, multiLine=True).where(~F.col("_metadata.file_name").startswith("example"))
    ident = lambda u: F.when(F.coalesce("match_query", F.lit(False)), urls.identity(u, F.col("identity_re"), True)).otherwise(urls.identity(u, F.col("identity_re")))
    of = lambda c: d.select("site", "identity_re", "match_query", F.explode(f"{c}.url").alias("url")).select("site", ident(F.col("url")).alias("ident")).distinct()
    expected = of("expected_documents")
    decoys = of("decoy_documents").join(expected, ["site", "ident"], "left_anti")
    entries = d.drop("expected_documents", "decoy_documents").fillna({"profile": "generic", "off_domain": False, "match_query": False, "latest": False, "shape": ""})
    return entries, expected, decoys


def recorded_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(runs, harvests) of recording folders: one run.json each and harvest_NNN.json up to the first gap."""
    name = lambda d: d.withColumn("recording", F.element_at(F.split("_metadata.file_path", "/"), -2)).withColumn("__file", F.col("_metadata.file_name"))
    runs = name(spark.read.schema(RUN).option("pathGlobFilter", "run.json").option("recursiveFileLookup", True).json(folder, multiLine=True)).drop("__file")
    h = name(spark.read.schema(HARVEST).option("pathGlobFilter", "harvest_*.json").option("recursiveFileLookup", True).json(folder, multiLine=True))
    h = h.withColumn("n", F.regexp_extract("__file", r"(\d+)", 1).cast("int")).drop("__file")
    w = Window.partitionBy("recording").orderBy("n")
    h = h.withColumn("__rank", F.row_number().over(w)).withColumn("__gap", F.col("n") - F.first("n").over(w) != F.col("__rank") - 1)
    whole = h.withColumn("__cut", F.max(F.col("__gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__cut = 0")
    return runs, whole.drop("__rank", "__gap", "__cut")


def recorded_answers(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds, verdicts) of recorded runs: the first kind of each page's identity, the verdict of each candidate."""
    k = runs.select("recording", F.posexplode("page_kinds").alias("ord", "k")).select("recording", "ord", urls.canonical(F.col("k.url")).alias("key"), "k.*")
    kinds = k.groupBy("recording", "key").agg(F.min_by(F.struct("url", "kind", "probability"), "ord").alias("k")).select("recording", "key", "k.*")
    return kinds, runs.select("recording", F.explode("candidates").alias("c")).select("recording", "c.*")


def joined_recording(harvests: DataFrame, kinds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(recording, key, url, kind, documents, accepted): each harvested page by its identity, with its kind and how many of its documents were accepted."""
    pages = harvests.select("recording", urls.canonical(F.col("url")).alias("key"), "url", F.transform("documents", lambda d: d["url"]).alias("docs"))
    docs = pages.select("recording", "key", F.explode("docs").alias("url")).join(verdicts.where("verdict = 'accepted'").select("recording", "url").distinct(), ["recording", "url"]).groupBy("recording", "key").agg(F.count_distinct("url").alias("accepted"))
    d = pages.join(kinds.select("recording", "key", "kind"), ["recording", "key"], "left").join(docs, ["recording", "key"], "left")
    return d.select("recording", "key", "url", "kind", F.size("docs").alias("documents"), F.coalesce("accepted", F.lit(0)).alias("accepted"))


def labelled_set(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of a labelled set (a JSON list)."""
    return spark.read.schema(LABELLED).json(path, multiLine=True)


def judge_report(judged: DataFrame) -> DataFrame:
    """Precision and recall of a judge (site, label, relevance) per site and pooled (site null), undefined ones null."""
    v = texts.verdict(F.col("relevance"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    yes = v == "accepted"
    s = judged.rollup("site").agg(n(yes & (F.col("label") == 1)).alias("tp"), n(yes & (F.col("label") == 0)).alias("fp"), n(F.col("label") == 1).alias("positives"), F.count("*").alias("candidates"), n(v == "unscored").alias("unscored"))
    share = lambda a, b: F.round(F.when(b > 0, a / b), 3)
    return s.select("site", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("positives")).alias("recall"), "tp", "fp", "positives", "candidates", "unscored")
