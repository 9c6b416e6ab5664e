"""Saved discovery programs, run over recorded pages as a table function.

A program is Python source with ``discover(fetch, render)`` that returns records
of url, name and context.  It runs in a child process of its own with a limit on
time and memory and without open files; it sees the pages it was given, plain
copies of a few modules, and a bound on its results; what it raises becomes its
error.  Names and attributes with two leading underscores are refused before it runs.
"""

from __future__ import annotations

import ast
import importlib
import json
import os
import resource
import select
import signal
import time
import traceback
from types import ModuleType, SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import texts, urls

# What a program may import, and the bounds of its run and of what it returns.
MODULES = frozenset("re json math datetime html urllib.parse collections itertools string unicodedata base64 csv".split())
MAX_DOCUMENTS, MAX_NAME, MAX_CONTEXT = 5_000, 300, 400
SECONDS, MEMORY_MB, FRAMES, ERROR_TEXT = 300, 512, 6, 3000
#: Programs of a site that one task handles.
PER_TASK = 32
_BUILTINS = "len range enumerate zip map filter sorted reversed set frozenset dict list tuple str int float bool bytes min max sum any all abs round isinstance iter next repr ord chr print Exception ValueError KeyError TypeError IndexError AttributeError StopIteration".split()


def _plain(module: ModuleType) -> SimpleNamespace:
    """A module's public names that are not modules themselves."""
    return SimpleNamespace(**{n: v for n in dir(module) if not n.startswith("_") and not isinstance(v := getattr(module, n), ModuleType)})


def _load(name, globals=None, locals=None, fromlist=(), level=0):
    if name not in MODULES:
        raise ImportError(f"{name} may not be imported")
    part = _plain(importlib.import_module(name))
    if "." in name and not fromlist:
        return SimpleNamespace(**{name.split(".")[1]: part})
    return part


def refused(code: str) -> str | None:
    """Why a program may not run at all, or None."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return f"SyntaxError: {e}"
    for node in ast.walk(tree):
        name = node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""
        if name.startswith("__") or isinstance(node, ast.Attribute) and name in ("format_map", "gi_frame", "f_globals", "tb_frame"):
            return f"{name} may not be used"
    return None


def describe(error: BaseException) -> str:
    """The last frames of an error, bounded."""
    return "".join(traceback.format_exception(error)[-FRAMES:])[-ERROR_TEXT:]


def _discover(code: str, pages: dict[str, str]) -> tuple[list[tuple[str, str, str]], str | None]:
    import builtins

    space = {"__builtins__": {**{n: getattr(builtins, n) for n in _BUILTINS}, "__import__": _load, "print": lambda *a, **k: None}}
    fetch = lambda url: pages.get(url, "")
    try:
        exec(compile(code, "program", "exec"), space)  # noqa: S102 - running the saved program is the operator
        found = space["discover"](fetch, fetch)
        return [(str(d["url"]), str(d.get("name") or "")[:MAX_NAME], str(d.get("context") or "")[:MAX_CONTEXT]) for d in list(found)[:MAX_DOCUMENTS]], None
    except BaseException as e:  # noqa: BLE001 - whatever it raises is its error
        return [], describe(e)


def run_program(code: str, pages: dict[str, str], seconds: float = SECONDS, memory_mb: int = MEMORY_MB) -> tuple[list[tuple[str, str, str]], str | None]:
    """(documents, error) of one program over its recorded pages, in a child process."""
    if (why := refused(code)) is not None:
        return [], why
    for name in MODULES:
        importlib.import_module(name)  # the child opens no files
    used = _address_space()
    read, write = os.pipe()
    child = os.fork()
    if child == 0:
        try:
            os.setsid()
            os.dup2(write, 3)
            os.closerange(4, 4096)
            for fd in (0, 1, 2):
                os.close(fd)
            resource.setrlimit(resource.RLIMIT_AS, (used + (memory_mb << 20),) * 2)
            resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1,) * 2)
            resource.setrlimit(resource.RLIMIT_NOFILE, (4, 4))
            data = json.dumps(_discover(code, pages)).encode()
            while data:
                data = data[os.write(3, data) :]
        finally:
            os._exit(0)
    os.close(write)
    parts, end = [], time.monotonic() + seconds
    try:
        while (left := end - time.monotonic()) > 0 and select.select([read], [], [], left)[0]:
            part = os.read(read, 1 << 16)
            if not part:
                break
            parts.append(part)
        else:
            return [], f"stopped after {seconds:g} seconds"
    finally:
        os.close(read)
        try:
            os.killpg(child, signal.SIGKILL)
        except (ProcessLookupError, PermissionError):
            pass
        os.waitpid(child, 0)
    try:
        docs, error = json.loads(b"".join(parts))
    except ValueError:
        return [], "the program's process ended without a result"
    return [tuple(d) for d in docs], error


def _address_space() -> int:
    """Bytes of address space that the process has already: the limit counts from there."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[0]) * resource.getpagesize()


def run_programs(programs: DataFrame, pages: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """(program_key, url, name, context, error) of every program (program_key, site, code) over its site's pages.

    What shares a ``site`` is handled by one task: use :func:`split` where sites have many pages.  A program without
    documents gives one row with null url.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {u: h for u, h in zip(right["url"], right["html"], strict=True) if h is not None}
        rows: list[tuple] = []
        for r in left.itertuples(index=False):
            docs, error = run_program(r.code, held, seconds)
            rows += [(r.program_key, *d, None) for d in docs] or [(r.program_key, None, None, None, error)]
        return pd.DataFrame(rows, columns=["program_key", "url", "name", "context", "error"])

    out = programs.select("site", "program_key", "code").groupBy("site").cogroup(pages.select("site", "url", "html").groupBy("site"))
    return out.applyInPandas(run, "program_key string, url string, name string, context string, error string")


def split(programs: DataFrame, pages: DataFrame, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(programs, pages) with ``site`` narrowed to about ``per_task`` programs and the pages these can reach.

    ``programs``: program_key, site, start, code; ``pages``: site, url, html, to array<string> (recorded links).  A program
    reaches its start page and what that links, so a site with a third of all pages is spread over many tasks, each with the
    pages of its own programs.
    """
    parts = programs.groupBy("site").agg(F.ceil(F.count("*") / per_task).alias("__parts"))
    d = programs.join(parts, "site").withColumn("__part", F.concat_ws("#", "site", F.pmod(F.xxhash64("program_key"), "__parts").cast("string")))
    linked = d.join(pages.select("site", F.col("url").alias("start"), "to"), ["site", "start"], "left")
    reach = linked.select("site", "__part", F.explode(F.array_union(F.array("start"), F.coalesce("to", F.array().cast("array<string>")))).alias("url")).distinct()
    held = reach.join(pages.select("site", "url", "html"), ["site", "url"]).select(F.col("__part").alias("site"), "url", "html")
    return d.select(F.col("__part").alias("site"), "program_key", "code"), held


def as_candidates(docs: DataFrame) -> DataFrame:
    """Distinct documents of programs with sendable URLs."""
    return docs.where("url is not null").withColumn("url", urls.as_url(F.col("url"))).groupBy("program_key", "url").agg(F.min("name").alias("name"), F.min("context").alias("context"))


def judged_documents(docs: DataFrame, relevance: DataFrame) -> DataFrame:
    """Documents of programs with the judge's relevance (program_key, url, relevance), verdict, period, year and published date."""
    from gleaner.functions import periods

    d = docs.join(relevance, ["program_key", "url"], "left")
    near = F.concat_ws(" ", "name", "context", "url")
    return d.withColumns({"verdict": texts.verdict(F.col("relevance")), "period": periods.period_of(F.concat_ws(" ", "name", "url")), "year": periods.year_of(near), "published": periods.date_of(F.col("context"))})


def hybrid(answers: DataFrame, crawled: DataFrame, healthy: DataFrame) -> DataFrame:
    """Documents of healthy programs, and the crawl's for the other keys."""
    good = healthy.where("health = 'healthy'").select("program_key").distinct()
    return answers.join(good, "program_key", "left_semi").unionByName(crawled.join(good, "program_key", "left_anti"), allowMissingColumns=True)


def submit_gate(runs: DataFrame) -> DataFrame:
    """(program_key, ready, why): whether the newest draft of each program (run_no, error, documents, accepted) may be submitted:
    it ran, without error, with documents."""
    last = runs.groupBy("program_key").agg(F.max_by(F.struct("error", "documents"), "run_no").alias("r"))
    why = F.when(F.col("r.error").isNotNull(), "error").when(F.coalesce("r.documents", F.lit(0)) == 0, "empty")
    return last.select("program_key", why.isNull().alias("ready"), why.alias("why"))


def verified(kept: Column, error: Column) -> Column:
    """Whether a program's answer may be served: no error and something kept."""
    return error.isNull() & (F.coalesce(kept, F.lit(0)) > 0)
