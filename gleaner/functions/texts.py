"""Text functions as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.urls import is_binary

# Verdict bands.
ACCEPTED_AT, REJECTED_BELOW, SUPERSEDED_AT = 0.75, 0.4, 0.8
# Text written at models.
INJECTION = (
    r"(?i)ignore (all |any )?(previous|prior|above)|disregard (the )?(previous|above|instructions)|system\s*(prompt|message)\s*:"
    r"|you (must|should) (now )?(ignore|record|download|visit)|new instructions?\s*:|</?(system|assistant)>"
)
# Letters and common words of languages.
LETTERS = {"hu": "őű", "de": "ß", "es": "ñ¿¡", "pl": "łąęśźż", "cs": "ěř", "ro": "ășțşţ", "sk": "ľĺŕ", "uk": "іїєґ", "ru": "ыэъё"}
WORDS = {
    "en": "the of and all for from find every with in",
    "de": "der die das und alle vom von für zum zur mit den dem des",
    "hu": "az és egy meg le minden összes hogy szóló éves havi",
    "fr": "les des du et tous toutes pour la trouver",
    "es": "el los las del y todos todas para encuentra",
    "it": "il gli dei delle della tutti tutte per trova",
}
# White space and decimal digits of any script, as Python has them (Java lacks four separators, older Java the digits of three scripts).
SPACE, DIGIT = r"(?U)[\s\x1c-\x1f]+", r"[\p{Nd}\x{11f50}-\x{11f59}\x{16ac0}-\x{16ac9}\x{1e4f0}-\x{1e4f9}]"
# Content types of documents.
DOCUMENT_TYPES = ("application/pdf", "application/msword", "application/vnd.", "application/zip", "application/octet-stream", "application/rtf", "text/csv")


def clean(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def is_instruction(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(INJECTION)


def verdict(p: Column) -> Column:
    return F.when(p.isNull(), "unscored").when(p >= ACCEPTED_AT, "accepted").when(p < REJECTED_BELOW, "rejected").otherwise("unsure")


def is_weakly_named(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    words = F.size(F.filter(F.split(n, SPACE), lambda w: w != ""))
    return (words < 4) & ~n.rlike(DIGIT)


def link_state(ident: Column, name: Column, url: Column, context: Column, section: Column, column: Column, date: Column | None = None) -> Column:
    """What a judge sees of a link, as JSON; absent parts are left out."""
    text = F.coalesce(F.nullif(F.substring(F.coalesce(name, F.lit("")), 1, 200), F.lit("")), F.lit("(no link text)"))
    near = F.when((context != "") & is_weakly_named(name), F.substring(context, 1, 200))
    parts = [
        ident.alias("id"), text.alias("text"), url.alias("url"), near.alias("surrounding_text"),
        F.nullif(F.substring(section, 1, 160), F.lit("")).alias("section_heading"), F.nullif(F.substring(column, 1, 80), F.lit("")).alias("column_header"),
    ]
    return F.to_json(F.struct(*parts, *([date.alias("date_shown_on_site")] if date is not None else [])))


def years(c: Column) -> Column:
    """The years 1980-2099 a text names as whole numbers, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!\d)(19[89]\d|20\d\d)(?!\d)"), 1))


def goal_years(goal: Column) -> Column:
    """The years of a goal, its ranges written out."""
    g = F.coalesce(goal, F.lit(""))
    # Fixed value: how a range of years is written.
    span = r"(?iu)(?<!\d)(?:19[89]\d|20\d\d)\s*(?:-|–|to|until|through|bis|a|al|à|au|és|y)\s*(?:19[89]\d|20\d\d)(?!\d)"
    ends = F.transform(F.regexp_extract_all(g, F.lit(span), 0), lambda s: F.struct(F.substring(s, 1, 4).cast("int").alias("a"), F.substring(s, -4, 4).cast("int").alias("b")))
    good = F.filter(ends, lambda e: (e["b"] - e["a"] > 0) & (e["b"] - e["a"] <= 30))
    written = F.flatten(F.transform(good, lambda e: F.transform(F.sequence(e["a"], e["b"]), lambda y: y.cast("string"))))
    return F.array_sort(F.array_union(years(g), written))


def names_goal_year(name: Column, url: Column, wanted: Column) -> Column:
    return F.arrays_overlap(years(F.concat_ws(" ", name, url)), wanted)


def goal_language(goal: Column) -> Column:
    """The one language whose letters and words speak most for it, or null for a tie or none."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), 0)
    scores = []
    for lang in sorted({*LETTERS, *WORDS}):
        score = F.lit(0)
        if lang in LETTERS:
            score = score + 3 * (F.length(low) - F.length(F.translate(low, LETTERS[lang], "")))
        if lang in WORDS:
            common = F.array(*[F.lit(w) for w in WORDS[lang].split()])
            score = score + F.size(F.filter(words, lambda w: F.array_contains(common, w)))  # noqa: B023
        scores.append(F.struct(score.alias("n"), F.lit(lang).alias("lang")))
    best = F.array_sort(F.array(*scores), lambda a, b: b["n"] - a["n"])
    return F.when((best[0]["n"] > 0) & (best[0]["n"] > best[1]["n"]), best[0]["lang"])


def is_document_response(content_type: Column, disposition: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(content_type, F.lit(""))))
    typed = t.isin("pdf", "zip")
    for start in DOCUMENT_TYPES:
        typed = typed | t.startswith(start)
    return F.lower(F.coalesce(disposition, F.lit(""))).contains("attachment") | typed


def disposition_name(c: Column) -> Column:
    """The file name of a Content-Disposition header: extended, quoted or bare form."""
    get = lambda p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    name = F.coalesce(get(r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)"), get(r'(?i)filename\s*=\s*"([^"]+)"'), get(r"(?i)filename\s*=\s*([^;\s]+)"))
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def is_chrome_path(tag_path: Column) -> Column:
    return F.coalesce(tag_path, F.lit("")).rlike(r"(^|[/>])(nav|header|footer|aside)([./>]|$)")


def json_object(c: Column) -> Column:
    """The JSON object of a model's answer: without code fences, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    cut = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    pick = F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(cut, F.lit(""))))
    return F.when(F.schema_of_variant(pick).startswith("OBJECT"), F.to_json(pick))


def script_shell(html: Column) -> Column:
    """Whether a page is a shell that scripts fill: hardly any text, or little text beside much script."""
    text = F.length(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")))
    script = F.length(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1), ""))
    return (text < 300) | ((script > 3 * text) & (text < 1000))


def outcome(challenged_first: Column, challenged_last: Column, status: Column) -> Column:
    return F.when(challenged_last, "challenge").when(status >= 400, "blocked").when(challenged_first, "solved").otherwise("pass")


def on_cloudflare(server: Column, ray: Column) -> Column:
    """Whether response headers (server, cf-ray) are those of the challenge service."""
    return (F.lower(F.coalesce(server, F.lit(""))) == "cloudflare") | (F.coalesce(ray, F.lit("")) != "")


def network_mode(remote: Column, stealth: Column, proxy: Column) -> Column:
    """The way a check went out, without addresses."""
    browser = F.when(F.coalesce(remote, F.lit("")) != "", "remote browser").when(F.coalesce(stealth, F.lit("")) != "", "stealth browser").otherwise("local browser")
    return F.concat(browser, F.lit(", "), F.when(F.coalesce(proxy, F.lit("")) != "", "proxy").otherwise("direct"))


def cost_usd(tokens: Column, per_million: float) -> Column:
    return F.round(tokens * per_million / 1_000_000, 6)


def keeps_name(name: Column, terms: Column) -> Column:
    """Whether a record's name is kept: none is not, names that are no PDF are, others where a key term stands in them or none is asked for."""
    low = F.lower(name)
    named = F.coalesce(name, F.lit("")) != ""
    return named & (~low.endswith(".pdf") | (F.size(terms) == 0) | F.exists(terms, lambda t: low.contains(F.lower(t))))


def date_like(sample: Column, iso: Column, today: Column) -> Column:
    """An ISO date written in the form in which ``sample`` shows ``today`` (yyyy-MM-dd); null where it does not show it.

    The order of day, month and year is the one in which the sample reads as today, day first, then year first, then month
    first; separators, two-digit years, missing zeros and a dot at the end are kept.
    """
    form = r"^(\d{1,4})(\D)(\d{1,2})(\D)(\d{1,4})(\.?)$"
    s = F.trim(sample)
    part = lambda i: F.regexp_extract(s, form, i)
    ymd = F.split(iso, "-")
    number = {"y": F.get(ymd, 0), "m": F.get(ymd, 1), "d": F.get(ymd, 2)}
    now = F.split(today, "-")
    shown = {"y": F.get(now, 0).cast("int"), "m": F.get(now, 1).cast("int"), "d": F.get(now, 2).cast("int")}
    out = F.lit(None).cast("string")
    for order in ("dmy", "ymd", "mdy"):
        got = {k: part(2 * i + 1).try_cast("int") for i, k in enumerate(order)}
        width = {k: F.length(part(2 * i + 1)) for i, k in enumerate(order)}
        full = F.when(got["y"] < 100, got["y"] + 2000).otherwise(got["y"])
        same = (full == shown["y"]) & (got["m"] == shown["m"]) & (got["d"] == shown["d"])
        bare = F.least(width["d"], width["m"]) == 1
        write = {"y": F.when(width["y"] == 2, F.substring(number["y"], -2, 2)).otherwise(number["y"])}
        for k in "md":
            write[k] = F.when(bare, F.regexp_replace(number[k], "^0+", "")).otherwise(number[k])
        text = F.concat(write[order[0]], part(2), write[order[1]], part(4), write[order[2]], part(6))
        out = F.coalesce(out, F.when(s.rlike(form) & iso.rlike(r"^\d{4}-\d{2}-\d{2}$") & same, text))
    return out


__all__ = [n for n in dir() if not n.startswith("_")] + [is_binary.__name__]
