"""Text shown to models: elements, page state, domain knowledge, facet labels, budgets.

Everything is built by the JVM from tables; lists are capped as a report of the
first rows, in order, as the text's reader has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles that are shown, longest name, most elements, share of the budget from which to wrap up, and to warn.
SHOWN = ("link", "button", "textbox", "combobox", "menuitem", "checkbox", "radio")
MAX_NAME, MAX_ELEMENTS, WRAP_UP, WARN = 120, 500, 0.75, 0.5


def element_lines(elements: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): one line per shown element, each url once, the first :data:`MAX_ELEMENTS`."""
    d = elements.where(F.col("role").isin(*SHOWN))
    again = F.row_number().over(Window.partitionBy(key, F.coalesce("url", F.concat(F.lit("#"), F.col(order).cast("string")))).orderBy(order))
    d = d.withColumn("__again", again).where("__again = 1")
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= MAX_ELEMENTS + 1)
    name = F.when(F.length("name") > MAX_NAME, F.concat(F.substring("name", 1, MAX_NAME), F.lit("…"))).otherwise(F.col("name"))
    options = F.nullif(F.col("attributes")["select_options"], F.lit(""))
    line = F.concat(
        F.lit("["), "role", F.lit(" "), F.col(order).cast("string"), F.lit("] "), name,
        F.coalesce(F.concat(F.lit(" — "), "url"), F.lit("")), F.coalesce(F.concat(F.lit(" [options: "), options, F.lit("]")), F.lit("")),
    )
    rows = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))).alias("l"), F.max("__n").alias("n"))
    text = F.array_join(F.transform(F.slice("l", 1, MAX_ELEMENTS), lambda x: x["line"]), "\n")
    return rows.select(key, F.when(F.col("n") > MAX_ELEMENTS, F.concat(text, F.lit(f"\n(first {MAX_ELEMENTS} elements)"))).otherwise(text).alias("text"))


def page_state(url: Column, depth: Column, queued: Column, downloads: Column, terms: Column, memory: Column, elements: Column) -> Column:
    """The state of a page as text; ``downloads`` array<struct<name, source_page>>, ``terms`` array, ``memory`` map."""
    list_ = F.array_join(F.transform(downloads, lambda d: F.concat(F.lit("  - "), d["name"], F.lit("  [from: "), d["source_page"], F.lit("]"))), "\n")
    remembered = F.array_join(F.transform(F.map_entries(memory), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), e["value"])), "\n")
    parts = [
        F.concat(F.lit("PAGE: "), url), F.concat(F.lit("DEPTH: "), depth.cast("string"), F.lit("  QUEUE: "), queued.cast("string"), F.lit("  DOWNLOADS: "), F.size(downloads).cast("string")),
        F.concat(F.lit("FOUND:\n"), F.when(F.size(downloads) > 0, list_).otherwise("  (none yet)")),
        F.when(F.size(terms) > 0, F.concat(F.lit("KEY TERMS: "), F.array_join(terms, ", "))), F.when(F.size(memory) > 0, F.concat(F.lit("MEMORY:\n"), remembered)),
        F.concat(F.lit("ELEMENTS:\n"), F.coalesce(elements, F.lit("(none)"))),
    ]
    return F.concat_ws("\n", *parts)


def history(steps: DataFrame, scope: list[str], order: str, last: int = 10) -> DataFrame:
    """(scope.., steps, text): the number of steps and the last ones, one line each."""
    d = steps.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(order)))).groupBy(*scope)
    line = F.concat(F.lit("  "), "tool", F.lit("("), F.coalesce("arg", F.lit("")), F.lit(") — "), F.coalesce("reason", F.lit("")))
    kept = F.array_sort(F.collect_list(F.when(F.col("__n") <= last, F.struct(F.col(order).alias("o"), line.alias("line")))))
    return d.agg(F.count("*").alias("steps"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))


def domain_block(p: dict[str, Column] | None = None) -> Column:
    """What a store knows of a domain, as text; lines without content are left out."""
    c = lambda n: (p or {}).get(n, F.col(n))
    lines = lambda a: F.nullif(F.array_join(a, ", "), F.lit(""))
    step = lambda s: F.concat(F.lit("      "), s["tool"], F.lit(": "), s["hint"], F.when(F.coalesce(s["value"], F.lit("")) != "", F.concat(F.lit(" = "), s["value"])).otherwise(""))
    gates = F.array_join(F.transform(c("gate_sequences"), lambda g: F.concat_ws("\n", F.concat(F.lit("    - "), g["description"]), F.array_join(F.transform(g["steps"], step), "\n"))), "\n")
    memory = F.array_join(F.transform(F.array_sort(F.map_entries(c("memory_snapshot"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    some = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x))
    return F.concat_ws(
        "\n", F.lit("KNOWN OF THIS DOMAIN (hints of earlier crawls):"), some("  Goal then: ", c("last_goal")), some("  Prefer: ", lines(c("url_patterns_prefer"))), some("  Skip: ", lines(c("url_patterns_skip"))),
        some("  Gates:\n", gates), some("  Memory: ", memory), some("  Navigation: ", c("navigation_hints")),
    )


def facet_labels(options: DataFrame, scope: list[str], order: str, name: str = "name") -> DataFrame:
    """``options`` with ``label``: the name, or the name with its place in the list where another of the group has it before."""
    first = F.min(order).over(Window.partitionBy(*scope, name))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    return options.withColumn("label", F.when(F.col(order) == first, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), (place - 1).cast("string"), F.lit(")"))))


def budget_line(turn: Column, turns: Column, tokens: Column, max_tokens: Column, runs: Column, best: Column) -> Column:
    """Where an agent stands: the further spent of turns and tokens sets the tone."""
    spent = F.greatest(turn / turns, tokens / max_tokens)
    thousand = lambda c: F.concat(F.floor(c / 1000).cast("string"), F.lit("k"))
    head = F.concat(
        F.lit("[turn "), turn.cast("string"), F.lit(" of "), turns.cast("string"), F.lit(", "), thousand(tokens), F.lit(" of "), thousand(max_tokens), F.lit(" tokens, "), runs.cast("string"), F.lit(" runs, "),
        F.when(best >= 0, F.concat(F.lit("best "), best.cast("string"), F.lit(" accepted"))).otherwise("no run yet"), F.lit("]"),
    )
    return F.concat(head, F.when(spent >= WRAP_UP, " wrap up").when((spent >= WARN) & (runs == 0), " run a draft now").otherwise(""))
