"""Scalar functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_key(url: Column) -> Column:
    """Dedup key: trimmed, without fragment, tracking parameters (utm_*) and empty parts of the query, and without the
    base's trailing slashes; host and scheme keep their case."""
    bare = F.substring_index(F.trim(url), "#", 1)
    base = F.rtrim(F.substring_index(bare, "?", 1), F.lit("/"))
    parts = F.filter(F.split(F.substring(bare, F.instr(bare, "?") + 1, F.length(bare)), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    has = (F.instr(bare, "?") > 0) & (F.size(parts) > 0)
    return F.when(has, F.concat(base, F.lit("?"), F.array_join(parts, "&"))).otherwise(base)


def host(url: Column) -> Column:
    """Lower-cased host without a leading "www."."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", "")


def slug(url: Column) -> Column:
    """Last part of the path."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(url, "[?#].*$", ""), F.lit("/")), "/"), -1)


def slug_terms(slug_: Column, stopwords: list[str], most: int = 6) -> Column:
    """The first words of a slug that are longer than two letters and no stopwords."""
    words = F.filter(F.split(slug_, "-"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stopwords))
    return F.array_join(F.slice(words, 1, most), " ")


def normalised_text(text: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def tidy_text(text: Column) -> Column:
    """Runs of blanks and tabs as one blank, three newlines or more as two."""
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def content_id(text: Column, prefix: str, digits: int = 16) -> Column:
    """prefix and the first digits of the text's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def stamp_date(stamp: Column) -> Column:
    """Date of a 14-digit capture stamp, or the first ten characters of an ISO text; else empty."""
    raw = F.trim(stamp)
    iso = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(raw.rlike("^(19|20)[0-9]{12}"), iso).when(raw.rlike("^[0-9]{4}-.{5}"), F.substring(raw, 1, 10)).otherwise("")


def epoch_date(seconds: Column) -> Column:
    """UTC date of epoch seconds given as text; null if invalid."""
    whole = seconds.try_cast("long")
    return F.date_from_unix_date(((whole - F.pmod(whole, F.lit(86400))) / 86400).try_cast("int"))


def date_text(day: Column) -> Column:
    """A date as SQL writes it: years after 9999 have no sign, which Spark's own cast puts before them."""
    return F.ltrim(day.cast("string"), F.lit("+"))


def page_cost(pages: Column, rate: float = 0.10, most: float = 3.00) -> Column:
    """Capped cost of a document by its pages; the cap where they are unknown."""
    return F.coalesce(F.least(F.lit(rate) * pages, F.lit(most)), F.lit(most))


def transcript_cost(pages: Column, rate: float = 0.10) -> Column:
    """Uncapped; null where the pages are unknown."""
    return F.lit(rate) * pages


def markdown_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def extension(mime: Column, url: Column) -> Column:
    """File extension by MIME type, else by the url's own."""
    own = F.regexp_extract(F.lower(F.regexp_replace(url, "[?#].*$", "")), "\\.(pdf|html?|txt|json|xml)$", 1)
    return (
        F.when(mime.contains("pdf"), ".pdf").when(mime.contains("html"), ".html").when(mime.contains("json"), ".json")
        .when(mime.contains("xml"), ".xml").when(mime.startswith("text/"), ".txt").when(own != "", F.concat(F.lit("."), own)).otherwise(".bin")
    )


# fixed values: where a docket's number stands in the address of an archive
DOCKET_ID = "courtlistener\\.com/(?:docket|recap/gov\\.uscourts\\.[a-z]+\\.)([0-9]+)"


def docket_id(url: Column) -> Column:
    return first_match(url, DOCKET_ID)


def host_in(url: Column, hosts: list[str]) -> Column:
    """Whether the host, in any case, is one of a few."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#]*)", 1)).isin(hosts)


def chained(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (pattern, replacement) that matches rewrites the value; else it stays."""
    out = value
    for pattern, replacement in reversed(rules):
        out = F.when(value.rlike(pattern), F.regexp_replace(value, pattern, replacement)).otherwise(out)
    return out


#: Apostrophes that end a possessive: the straight and the curly one.
APOSTROPHES = "['\\u2019]"


def repaired_label(label: Column, units: list[tuple[str, str, str | None]], surnames: dict[str, str], home: str) -> Column:
    """An agency's label without the possessives that names of persons left in it, by tiers, the first that fits.

    The label is trimmed, its white space folded, its possessive written 's and a leading "the" dropped. units: (pattern,
    name, pattern that rules it out or None): a label that holds a unit is the unit. surnames: (surname, state): a
    surname's possessive at the start gives way to the state. What is left of a title cut down to "General's" is the home
    state's. Other possessives (of places and offices) stay."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(label), f"(?i)\\s*{APOSTROPHES}+\\s*s\\b", "'s"), "\\s+", " "))
    clean = F.regexp_replace(clean, "(?i)^the ", "")
    out = F.when(clean.rlike("(?i)^general's \\S"), F.concat(F.lit(home + " "), F.regexp_replace(clean, "(?i)^general's ", ""))).otherwise(clean)
    for surname, state in reversed(surnames.items()):
        lead = f"(?i)^(?:general )?{surname}'s( |$)"
        out = F.when(clean.rlike(lead), F.trim(F.concat(F.lit(state + " "), F.regexp_replace(clean, lead, "")))).otherwise(out)
    for pattern, name, unless in reversed(units):
        fits = clean.rlike(f"(?i){pattern}")
        out = F.when(fits & ~clean.rlike(f"(?i){unless}") if unless else fits, F.lit(name)).otherwise(out)
    return F.when(F.trim(label) == "", label).otherwise(out)


# fixed values: what a wrapped address may go on with, and what it may not
URL_FRAGMENT = "^[A-Za-z0-9._~:/?#\\[\\]@!$&'()*+,;=%-]+$"
SPACED_FRAGMENT = "^[A-Za-z0-9][A-Za-z0-9\\s\\-,'.%]*$"
DATED_TAIL = "(^|/)[0-9]{6}-[0-9]{2}$"
NO_FRAGMENT = "(?i)^(\\(|\u2014|\u2013|FOR\\s+IMMEDIATE|CONTACT\\s*:|###)"
SPACED_LINES, FRAGMENT_CHARS = 2, 280


def line_class(line: Column) -> Column:
    """What a line may be to a url that wraps: "u" for url characters alone, "p" for a path with blanks in it, "-" for the
    end of it."""
    text = F.trim(line)
    path = text.rlike(SPACED_FRAGMENT) & ~text.rlike(NO_FRAGMENT) & ~text.rlike("([.][^.]*){3}") & (F.length(text) <= FRAGMENT_CHARS)
    return F.when(F.rlike(line, F.lit(URL_FRAGMENT)), "u").when(path & ~text.rlike(URL_FRAGMENT), "p").otherwise("-")


def _takes_paths(url: Column, paths: Column) -> Column:
    """Whether a path with blanks may follow: behind a date, or once such a path has begun; never behind a .pdf."""
    bare = F.rtrim(url, F.lit("/"))
    return (paths < SPACED_LINES) & ~F.lower(bare).endswith(".pdf") & (bare.rlike(DATED_TAIL) | (paths > 0))


def joined_source_url(url: Column, rest: Column, lines: Column) -> Column:
    """A url that wraps: what follows on its line (rest) and on the next lines (array<string>). The lines' classes make a
    word, of which the url takes a beginning: u*, then p u* as often as paths may follow, SPACED_LINES times at most, a path
    in rest included. Lines of url characters are taken as they stand, paths with one blank before."""
    word = F.array_join(F.transform(lines, line_class), "")
    folded = lambda line: F.regexp_replace(F.trim(line), "\\s+", " ")
    path = lambda line: F.concat(F.lit(" "), F.when(F.lower(folded(line)).endswith(".pdf"), folded(line)).otherwise(F.regexp_replace(folded(line), "[.,;]+$", "")))
    state = lambda text, at, paths: F.struct(text.alias("url"), at.cast("int").alias("at"), paths.cast("int").alias("paths"))

    rest = F.coalesce(rest, F.lit(""))
    on_line = (line_class(rest) == "p") & _takes_paths(url, F.lit(0))
    start = state(F.concat(url, F.when(on_line, path(rest)).otherwise("")), F.lit(0), on_line.cast("int"))

    def step(acc: Column, kind: Column) -> Column:
        at = acc["at"]
        run = F.length(F.regexp_extract(F.substr(word, at + 1), "^u*", 0))
        run_taken = state(F.concat(acc["url"], F.array_join(F.slice(lines, at + 1, run), "")), at + run, acc["paths"])
        follows = (F.substr(word, at + 1, F.lit(1)) == "p") & _takes_paths(acc["url"], acc["paths"])
        path_taken = state(F.concat(acc["url"], path(F.get(lines, at))), at + 1, acc["paths"] + 1)
        return F.when(kind == "u", run_taken).when(follows, path_taken).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, "u" + "pu" * SPACED_LINES)), start, step)["url"]


def joined_urls(lines: Column) -> Column:
    """Lines (array<string>) with urls that wrap onto the next line put together: a line with a url that ends in "-",
    "/", "_", "=" or "." takes the next line's first word, unless the url ends in .pdf."""

    def step(acc: Column, line: Column) -> Column:
        last = F.coalesce(F.element_at(acc, -1), F.lit(""))
        opens = last.rlike("https?://\\S*[-/_=.]$") & ~last.rlike("\\.pdf$") & line.rlike("^\\s{0,2}[A-Za-z0-9][A-Za-z0-9._~/%-]*(\\s|$)")
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.trim(line))))
        return F.when((F.size(acc) > 0) & opens, grown).otherwise(F.concat(acc, F.array(line)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def action_types(value: Column, legacy: Column) -> Column:
    """A list trimmed, lower-cased and without empty parts; else the legacy scalar as a list; else empty."""
    clean = F.filter(F.transform(value, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    single = F.filter(F.array(F.lower(F.trim(legacy))), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(F.coalesce(clean, F.array().cast("array<string>"))) > 0, clean).otherwise(single)
