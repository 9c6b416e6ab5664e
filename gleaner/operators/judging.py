"""Relevance answers as tables: rules, recordings, fallback, breaker.

A judge is any function DataFrame -> DataFrame that adds ``relevance``.  The rule
judge is an expression, the recorded judge a join; a model behind a service goes
into the same place with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.texts import verdict

Judge = Callable[[DataFrame], DataFrame]
# Numbers for a model's words, how sure it says it is, sizes of what it is asked, tries of a request.
LEVELS = {"clearly_yes": 0.95, "probably_yes": 0.8, "unsure": 0.55, "probably_no": 0.25, "clearly_no": 0.05}
SURENESS = {"sure": 0.9, "likely": 0.7, "guess": 0.5}
BATCH, NEIGHBOURS, OPTIONS = 20, 10, 60
FAILURES, RATE_WAITS, SERVER_TRIES = 3, 6, 3
REFUSALS = {401: "auth", 402: "no_credits", 403: "auth"}


def number_of(word: Column, table: dict[str, float]) -> Column:
    """The number of a model's word, white space and case aside; null for any other."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(F.trim(word))]


def rule_judge(terms: Column) -> Judge:
    """Share of the goal's key terms in name, url and section, a document's extension counting half a term."""

    def judge(links: DataFrame) -> DataFrame:
        low = F.lower(F.concat_ws(" ", "name", "url", "section"))
        hits = F.size(F.filter(terms, lambda t: low.contains(F.lower(t))))
        share = (hits + F.when(F.col("url").rlike(r"(?i)\.(pdf|xlsx?|docx?)"), 0.5).otherwise(0.0)) / (F.greatest(F.size(terms), F.lit(1)) + 0.5)
        return links.withColumn("relevance", F.least(share, F.lit(1.0)))

    return judge


def recorded_judge(answers: DataFrame, keys: list[str]) -> Judge:
    """Answers of an earlier run; what was not asked stays unscored."""
    return lambda links: links.drop("relevance").join(answers.select(*keys, "relevance"), keys, "left")


def fallback_judge(primary: Judge, secondary: Judge) -> Judge:
    """The second judge where the first has no answer."""

    def judge(links: DataFrame) -> DataFrame:
        one = primary(links).withColumnRenamed("relevance", "__one")
        return secondary(one).withColumn("relevance", F.coalesce("__one", "relevance")).drop("__one")

    return judge


def judged(links: DataFrame, judge: Judge) -> DataFrame:
    return judge(links).withColumn("verdict", verdict(F.col("relevance")))


def known_kinds(links: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """``links`` with kind and probability; ('other', 0.0) where none is recorded."""
    d = links.join(kinds.select(key, F.col("kind").alias("__k"), F.col("probability").alias("__p")), key, "left")
    return d.withColumns({"kind": F.coalesce("__k", F.lit("other")), "probability": F.coalesce("__p", F.lit(0.0))}).drop("__k", "__p")


def picked_values(picks: DataFrame, options: DataFrame) -> DataFrame:
    """Picks that are listed options, other than keeping the filter as it is."""
    return picks.where("value <> 'keep'").join(options.select("filter_id", "value").distinct(), ["filter_id", "value"], "left_semi")


def question_batches(links: DataFrame, neighbours: DataFrame, scope: list[str], order: str) -> DataFrame:
    """(scope.., batch, links, neighbours): what a model is asked at once: :data:`BATCH` links as JSON states with their
    places, and the first :data:`NEIGHBOURS` judged ones for context.  ``state``: the JSON of a link."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(order)) - 1
    d = links.withColumns({"batch": F.floor(n / BATCH).cast("int"), "place": (n % BATCH + 1).cast("int")})
    asked = d.groupBy(*scope, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "state"))), lambda x: x["state"]).alias("links"))  # at most BATCH
    near = neighbours.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy(order))).where(F.col("__n") <= NEIGHBOURS)
    near = near.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "state"))), lambda x: x["state"]).alias("neighbours"))
    return asked.join(near, scope, "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def answered(links: DataFrame, answers: DataFrame, scope: list[str], order: str, table: dict[str, float] | None = None) -> DataFrame:
    """``links`` with ``relevance`` from a model's answers (scope.., batch, answer: JSON of place -> word), by place; null where
    the answer is missing or not one of the words."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(order)) - 1
    d = links.withColumns({"batch": F.floor(n / BATCH).cast("int"), "__place": F.concat(F.lit("L"), (n % BATCH + 1).cast("string"))})
    d = d.join(answers.select(*scope, "batch", F.from_json("answer", "map<string,string>").alias("__words")), [*scope, "batch"], "left")
    return d.withColumn("relevance", number_of(F.col("__words")[F.col("__place")], table or LEVELS)).drop("batch", "__place", "__words")


def edition_answers(groups: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(group_id, same, newest, sure) of a model's answers (group_id, answer: JSON with same, newest, sure) on groups
    (group_id, members: keys in the order shown); newest is the key at the place named, sure null without it."""
    d = groups.join(answers, "group_id").withColumn("__a", F.from_json("answer", "same string, newest string, sure string"))
    place = F.regexp_extract(F.trim("__a.newest"), r"^D(\d+)$", 1).try_cast("int")
    newest = F.when(place.between(1, F.size("members")), F.get("members", place - 1))
    return d.select("group_id", number_of(F.col("__a.same"), LEVELS).alias("same"), newest.alias("newest"), F.when(newest.isNotNull(), number_of(F.col("__a.sure"), SURENESS)).alias("sure"))


def hidden_documents(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """``pages`` (page_url) with ``hides_documents`` of a model's answers (page_url, answer: JSON with answer)."""
    said = answers.select("page_url", number_of(F.get_json_object("answer", "$.answer"), LEVELS).alias("hides_documents"))
    return pages.join(said, "page_url", "left")


def choose_judge(name: str | None, judges: dict[str, Judge | None]) -> Judge:
    """The judge asked for; ``auto`` or nothing takes the first two that can run, the second where the first has no answer."""
    able = [j for j in judges.values() if j is not None]
    if name not in (None, "auto"):
        if judges.get(name) is None:
            raise ValueError(f"judge {name!r} cannot run")
        return judges[name]
    if not able:
        raise ValueError("no judge can run")
    return fallback_judge(able[0], able[1]) if len(able) > 1 else able[0]


def valid_plan(steps: DataFrame, controls: DataFrame, limit: int = 8) -> DataFrame:
    """(form_id, n, control_id, kind, values): the part of a model's plan that a form really offers, the first ``limit`` steps.

    ``steps``: form_id, ord, control_id, values array<string>; ``controls``: form_id, control_id, kind, current, options
    array<string> or null.  A control is set once, by the first step that is good; options are matched without case and
    written as listed; a value that is not listed, empty, longer than 80 characters or already set is dropped, and with it a
    step that has no other.
    """
    c = controls.select("form_id", "control_id", F.col("kind").alias("kind"), F.coalesce("current", F.lit("")).alias("current"), "options")
    clean = F.transform("values", lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"[\x00-\x1f\x7f]", " ")))
    d = steps.where(F.col("ord") <= 2 * limit).withColumn("values", clean).join(c, ["form_id", "control_id"])
    wanted = F.when(F.col("kind") == "checkboxes", F.col("values")).otherwise(F.slice("values", 1, 1))
    listed = lambda v: F.try_element_at(F.filter("options", lambda o: F.lower(o) == F.lower(v)), F.lit(1))
    known = F.array_distinct(F.filter(F.transform(wanted, listed), lambda v: v.isNotNull()))
    chosen = F.when(F.col("kind") == "select", F.filter(F.slice(known, 1, 1), lambda v: v != F.col("current"))).otherwise(F.filter(known, lambda v: ~F.array_contains(F.split("current", ", "), v)))
    typed = F.filter(F.slice("values", 1, 1), lambda v: (v != "") & (F.length(v) <= 80) & (v != F.col("current")))
    d = d.withColumn("values", F.when(F.col("options").isNotNull(), chosen).otherwise(typed)).where(F.size("values") > 0)
    first = d.groupBy("form_id", "control_id").agg(F.min_by(F.struct("ord", "kind", "values"), "ord").alias("s")).select("form_id", "control_id", "s.*")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("form_id").orderBy("ord"))).where(F.col("n") <= limit).drop("ord")


def pressed(answers: DataFrame, buttons: DataFrame) -> DataFrame:
    """(form_id, press, label): the button a plan presses, null where the form has no such button."""
    return answers.join(buttons.withColumnRenamed("button_id", "press"), ["form_id", "press"], "left").select("form_id", F.when(F.col("label").isNotNull(), F.col("press")).alias("press"), F.coalesce("label", F.lit("")).alias("label"))


def call_outcomes(tries: DataFrame, scope: list[str], order: str) -> DataFrame:
    """(scope.., call, order, tries, outcome) of calls from their logged tries (scope.., call, order, status; null: no answer).

    ``ok`` by a 200; ``auth`` or ``no_credits`` by a refusal; a rate limit is waited out :data:`RATE_WAITS` times and a server
    error or silence tried :data:`SERVER_TRIES` times before the call is ``failed``; any other answer fails at once.  What was
    logged after a call's end does not count.
    """
    w = Window.partitionBy(*scope, "call").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("status")
    busy, down = s == 429, s.isNull() | (s >= 500)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w)
    end = (
        F.when(s == 200, "ok").when(s.isin(*REFUSALS), F.create_map(*[F.lit(x) for p in REFUSALS.items() for x in p])[s])
        .when(busy, F.when(count(busy) >= RATE_WAITS, "failed")).when(down, F.when(count(down) >= SERVER_TRIES, "failed")).otherwise("failed")
    )
    d = tries.withColumn("__end", end).groupBy(*scope, "call").agg(F.min(order).alias(order), F.min_by("__end", F.when(F.col("__end").isNotNull(), F.col(order))).alias("__out"), F.min(F.when(F.col("__end").isNotNull(), F.col(order))).alias("__at"), F.array_sort(F.collect_list(F.col(order))).alias("__orders"))
    n = F.when(F.col("__at").isNull(), F.size("__orders")).otherwise(F.size(F.filter("__orders", lambda o: o <= F.col("__at"))))
    return d.select(*scope, "call", order, n.alias("tries"), F.coalesce("__out", F.lit("failed")).alias("outcome"))


def breaker(requests: DataFrame, scope: list[str], order: str, failures: int = FAILURES) -> DataFrame:
    """``requests`` (status) with ``open``: refused (401, 402, 403) at once, or ``failures`` in a row, before or at this request."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = (F.col("status") < 400).cast("int")
    d = requests.withColumn("__island", F.sum(ok).over(w))
    run = F.sum(1 - ok).over(Window.partitionBy(*scope, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__trip", (F.col("status").isin(*REFUSALS) | (run >= failures)).cast("int"))
    return d.withColumn("open", F.max("__trip").over(w) == 1).drop("__island", "__trip")


def call_breaker(calls: DataFrame, scope: list[str], order: str) -> DataFrame:
    """:func:`call_outcomes` with ``open`` and ``reason``: refusals open at once and say why, three failed calls in a row open."""
    status = F.when(F.col("outcome") == "ok", 200).when(F.col("outcome") == "no_credits", 402).when(F.col("outcome") == "auth", 401).otherwise(500)
    d = breaker(calls.withColumn("status", status), scope, order).drop("status")
    why = F.when(F.col("outcome").isin("auth", "no_credits"), F.col("outcome")).when(F.col("open"), "failures")
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("reason", F.first(F.when(F.col("open"), why), ignorenulls=True).over(w))
