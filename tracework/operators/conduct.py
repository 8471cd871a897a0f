"""Conduct: the acts that a record narrates, with the date and the means that stand in an act's window of text.

Acts are found by cues, a small vocabulary of our own with one phase for each kind. A verb that may mean more than one
act is decided by what follows it; cues inside a recital of the law are no conduct.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.operators import intervals
from tracework.operators.attribution import SENTENCE_END
from tracework.operators.tokens import in_arrays, in_batches, tokens_of

#: (kind, phase, cues): what a narrative says when the act is done.
ACTS = [
    ("setup", "preparation", [r"created\s+(?:a|an)\s+[\w\s]{0,20}(?:profile|account|company)", r"opened\s+(?:a|an)\s+[\w\s]{0,20}account", r"registered\s+a\s+domain"]),
    ("recruit", "preparation", [r"recruited"]),
    ("contact", "approach", [r"contacted", r"telephoned", r"messaged", r"sent\s+(?:\w+\s+)?(?:messages?|emails?|texts?)"]),
    ("deception", "approach", [r"posed\s+as", r"pretended\s+to\s+be", r"falsely\s+(?:claimed|told)", r"claimed\s+to\s+be"]),
    ("demand", "leverage", [r"(?:asked|instructed|directed|told)\s+[\w\s-]{1,30}?\s+to\s+(?:send|pay|wire|transfer)", r"demanded"]),
    ("threat", "leverage", [r"threatened"]),
    ("control", "leverage", [r"confiscated", r"took\s+(?:her|his|their)\s+passports?"]),
    ("transfer", "harm", [r"wired\s+\$", r"sent\s+\$", r"paid\s+\$", r"transferred\s+\$"]),
    ("access", "harm", [r"gained\s+access", r"logged\s+in(?:to)?", r"accessed"]),
    ("exploit", "harm", [r"exploited", r"forced\s+[\w-]+\s+to\s+work"]),
    ("transport", "harm", [r"transported", r"drove\s+[\w\s-]{1,30}?\s+across"]),
    ("supply", "harm", [r"sold", r"distributed"]),
    ("movement", "aftermath", [r"withdrew", r"moved\s+the\s+(?:funds|money)", r"converted\s+the\s+(?:funds|money)"]),
    ("concealment", "aftermath", [r"deleted", r"destroyed", r"laundered"]),
    ("detection", "detection", [r"executed\s+a\s+search\s+warrant", r"arrested", r"agents\s+seized"]),
]
PHASES = {kind: phase for kind, phase, _ in ACTS}
#: (field, label, cue): technology that a sentence names.
MEANS = [
    ("channel", "phone_call", r"\b(?:telephoned|phone\s+calls?)\b"), ("channel", "wire_transfer", r"\bwired\b"), ("channel", "gift_card", r"\bgift\s+cards?\b"),
    ("channel", "cryptocurrency", r"\b(?:bitcoin|cryptocurrency)\b"), ("platform", "whatsapp", r"\bWhatsApp\b"), ("platform", "telegram", r"\bTelegram\b"),
]
#: A heading that opens a recital of the law, and one that ends it.
RECITAL = r"(?mi)^[IVX]+\.\s+ELEMENTS\b.*$"
NEXT_HEADING = r"(?m)^[IVX]+\.\s+[A-Z]"
NOT_CONDUCT = "not_conduct"
# fixed value: where a numbered paragraph begins
PARAGRAPH = r"\n[ \t]*(?:\d{1,3}|[a-z])[.)][ \t]+(?=\S)"
BEFORE, AFTER = 600, 400
#: Windows are about 2 ** WINDOW_LEVEL characters long.
WINDOW_LEVEL = 10

_CUES = re.compile("|".join(rf"(?P<{kind}>\b(?:{'|'.join(cues)}))" for kind, _, cues in ACTS), re.IGNORECASE)


def _openings(cue: str) -> list[str]:
    """The words that a cue may begin with."""
    m = re.match(r"(?:\\b)?(?:\(\?:(?P<some>.+)\)|(?P<one>\w+))", cue)
    return [re.match(r"\w+", x).group() for x in m["some"].split("|")] if m["some"] else [m["one"]]


#: Letters that a cue begins with, and the words that a cue of means begins with: most words are passed over by these.
_LETTERS = 3
_FIRST = {w[:_LETTERS] for _, _, cues in ACTS for cue in cues for w in _openings(re.sub(r"\).*", ")", cue))}
_MEANS = [(field, label, re.compile(cue), _openings(cue)) for field, label, cue in MEANS]
_WORD, _SENTENCE, _PARAGRAPH, _RECITAL = re.compile(r"\w+"), re.compile(SENTENCE_END), re.compile(PARAGRAPH), re.compile(RECITAL)
_HEADING = re.compile(f"(?m)(?={NEXT_HEADING.removeprefix('(?m)')})")


def _cue_matches(text: str) -> Iterator[re.Match]:
    """_CUES.finditer(text), tried only at words that may begin a cue."""
    at = 0
    for word in _WORD.finditer(text):
        start = word.start()
        head = text[start : start + _LETTERS]
        if start < at or (head.isascii() and head.lower() not in _FIRST):
            continue
        if m := _CUES.match(text, start):
            at = m.end()
            yield m


def _window(ends: list[int], marks: list[int], size: int, start: int, end: int) -> tuple[int, int]:
    """The act's sentence, at most BEFORE and AFTER characters around it, cut at the borders of its numbered paragraph."""
    i, j = bisect_right(ends, start), bisect_left(ends, end)
    begin, finish = max(ends[i - 1] if i else 0, start - BEFORE), min(ends[j] if j < len(ends) else size, end + AFTER)
    i, j = bisect_left(marks, start), bisect_left(marks, end)
    return max(begin, marks[i - 1] if i else 0), min(finish, marks[j] if j < len(marks) else size)


def acts_of(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, start, end, begin, finish) of the acts in order, with their windows; kind not_conduct inside a recital. What
    the windows need of the text is read once, whatever the number of its acts."""
    recitals = [m.span() for m in _RECITAL.finditer(text)]
    headings = [m.start() for m in _HEADING.finditer(text)] if recitals else []
    opened, closed = [a for a, _ in recitals], []
    for _, b in recitals:
        k = bisect_left(headings, b)
        closed.append(max(headings[k] if k < len(headings) else len(text), closed[-1] if closed else 0))
    ends = marks = None
    for m in _cue_matches(text):
        if ends is None:
            ends, marks = [x.end() for x in _SENTENCE.finditer(text)], [x.start() for x in _PARAGRAPH.finditer(text)]
        k = bisect_right(opened, m.start())
        told = k > 0 and m.start() < closed[k - 1]
        yield NOT_CONDUCT if told else m.lastgroup, *m.span(), *_window(ends, marks, len(text), *m.span())


def cues_of(text: str) -> Iterator[tuple[str, str, int]]:
    for field, label, cue, openings in _MEANS:
        if any(word in text for word in openings):
            for m in cue.finditer(text):
                yield field, label, m.start()


def marked_acts_of(text: str) -> Iterator[tuple]:
    """(position, kind, start, end, date_at, dates, labels) of the acts outside of recitals, in order, with the dates and the
    labels of the means that stand in an act's window."""
    told = [a for a in acts_of(text) if a[0] != NOT_CONDUCT]
    dates = [(start, value) for _, start, _, value in tokens_of(text, ["date"])] if told else []
    cues = sorted((pos, label) for _, label, pos in cues_of(text)) if told else []
    for position, (kind, start, end, begin, finish) in enumerate(told):
        near = dates[bisect_left(dates, (begin,)) : bisect_left(dates, (finish,))]
        labels = sorted({label for _, label in cues[bisect_left(cues, (begin,)) : bisect_left(cues, (finish,))]})
        yield position, kind, start, end, [p for p, _ in near], [v for _, v in near], labels


def phase_of(kind: Column) -> Column:
    """The one phase of a kind; null for unknown ones."""
    return F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])[kind]


def precision_of(date: Column) -> Column:
    return F.when(date.isNull(), "none").when(F.length(date) == 7, "month").otherwise("day")


def acts(docs: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, kind, start, end, begin, finish) of docs(key, text)."""
    return in_batches(docs, key, acts_of, "kind string, start int, end int, begin int, finish int")


def means_cues(docs: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, field, label, pos)."""
    return in_batches(docs, key, cues_of, "field string, label string, pos int")


def conduct(found: DataFrame, dates: DataFrame, cues: DataFrame) -> DataFrame:
    """(record_id, position, kind, phase, date, precision, means) of acts in order of their spans: the date of
    dates(record_id, start, value) in the act's window nearest to its start (the first on a tie), and the labels of the
    cues in it, sorted. Recitals are left out. Windows are joined by record and bounded by BEFORE and AFTER."""
    told = found.where(F.col("kind") != NOT_CONDUCT)
    span = ["record_id", "start", "end"]
    within = lambda marks: intervals.inside(told, marks, end="finish", level=WINDOW_LEVEL)
    near = within(dates.select("record_id", F.col("start").alias("pos"), "value"))
    dated = near.groupBy(*span).agg(F.min_by("value", F.struct(F.abs(F.col("pos") - F.col("start")), "pos")).alias("date"))
    named = within(cues).groupBy(*span).agg(F.array_sort(F.collect_set("label")).alias("means"))
    every = told.join(dated, span, "left").join(named, span, "left")
    order = Window.partitionBy("record_id").orderBy("start", "end")
    return every.select("record_id", (F.row_number().over(order) - 1).alias("position"), "kind", phase_of(F.col("kind")).alias("phase"), "date", precision_of(F.col("date")).alias("precision"), F.coalesce("means", F.array().cast("array<string>")).alias("means"))


def read_conduct(docs: DataFrame) -> DataFrame:
    """docs(record_id, text, ...) without their texts and with acts, an array of (position, kind, phase, date, means) as
    conduct() has them in rows: each text is read once, and its acts stay together in its row."""
    read = in_arrays(docs, marked_acts_of, "position int, kind string, start int, end int, date_at array<int>, dates array<string>, labels array<string>")

    def nearest(a: Column) -> Column:
        return F.array_min(F.transform(a["date_at"], lambda p, i: F.struct(F.abs(p - a["start"]).alias("far"), p.alias("pos"), F.get(a["dates"], i).alias("value"))))["value"]

    act = lambda a: F.struct(a["position"].alias("position"), a["kind"].alias("kind"), phase_of(a["kind"]).alias("phase"), nearest(a).alias("date"), a["labels"].alias("means"))
    return read.select(*[c for c in docs.columns if c != "text"], F.transform("hits", act).alias("acts"))


def path_of(acts: Column, level: str = "act", with_detection: bool = True) -> Column:
    """The path of an array of acts in order, with runs of one step counted once, at the level act, phase or means; empty
    without acts."""
    from tracework.operators.machine import action_label

    step = {"act": lambda a: a["kind"], "phase": lambda a: a["phase"], "means": lambda a: action_label(a["kind"], a["means"])}[level]
    steps = F.transform(acts if with_detection else F.filter(acts, lambda a: a["kind"] != "detection"), step)
    # each step beside the one before it; the last row of the longer list has no step
    pairs = F.zip_with(steps, F.concat(F.array(F.lit(None).cast("string")), steps), lambda s, b: F.struct(s.alias("s"), b.alias("b")))
    runs = F.filter(pairs, lambda p: p["s"].isNotNull() & (p["b"].isNull() | (p["b"] != p["s"])))
    return F.array_join(F.transform(runs, lambda p: p["s"]), ">")


def conduct_paths(read: DataFrame, level: str = "act", with_detection: bool = True) -> DataFrame:
    """(record_id, path) of read(record_id, acts), without records of no step."""
    return read.select("record_id", path_of(F.col("acts"), level, with_detection).alias("path")).where("path <> ''")


def case_people(values: DataFrame, people: DataFrame) -> DataFrame:
    """values(record_id, ..., people) with the record's people named as the case's: people(record_id, record_person,
    person); unknown ones are left out, the rest is sorted and distinct."""
    keys = [c for c in values.columns if c != "people"]
    each = values.select(*keys, F.explode_outer("people").alias("record_person"))
    named = each.join(people.select("record_id", "record_person", "person"), ["record_id", "record_person"], "left")
    return named.groupBy(*keys).agg(F.array_sort(F.collect_set("person")).alias("people"))


def exported(read: DataFrame) -> DataFrame:
    """One row a record for export: (record_id, record_kind, domain, acts, path) of read(record_id, kind, domain, acts),
    without texts, people or statuses, and without records of no act."""
    acts = F.transform("acts", lambda a: F.struct(a["kind"].alias("kind"), a["phase"].alias("phase"), a["date"].alias("date"), a["means"].alias("means")))
    return read.where("size(acts) > 0").select("record_id", F.col("kind").alias("record_kind"), "domain", acts.alias("acts"), path_of(F.col("acts")).alias("path"))


def exact_traces(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(traces, exact, rate) of truth(record_id, path) whose path was found as it is."""
    both = truth.join(found.withColumnRenamed("path", "_f"), "record_id", "left")
    same = F.coalesce(F.col("path") == F.col("_f"), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("traces"), F.count_if(same).alias("exact")).withColumn("rate", F.when(F.col("traces") > 0, F.col("exact") / F.col("traces")).otherwise(0.0))


