"""Page-level operators: HTML blocks, page cuts, boilerplate gates, vocabulary tags and typed tokens."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracework.functions.columns import normalised_text
from tracework.operators.tokens import in_batches


#: Elements without content, which end where they begin.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Element:
    """A paragraph, row or cell: where its pieces of text begin and end, and the elements that begin inside of it."""

    __slots__ = ("tag", "first", "last", "next", "in_table", "in_row")

    def __init__(self, tag: str, first: int, in_table: bool, in_row: bool) -> None:
        self.tag, self.first, self.in_table, self.in_row = tag, first, in_table, in_row
        self.last = self.next = -1


class _Elements(HTMLParser):
    """Elements as they stand: what isn't closed lasts until something around it is. Scripts, styles and comments are no
    text, but part the texts around them. Pieces of text are kept once, in order, whatever the depth of elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.parted = True
        self.found: list[_Element] = []
        self.open: list[tuple[str, _Element | None]] = []
        self.count: Counter[str] = Counter()
        self.silent = ""

    def _begins(self, tag: str) -> _Element | None:
        self.parted = True
        if tag not in ("p", "tr", "td", "th"):
            return None
        element = _Element(tag, len(self.pieces), self.count["table"] > 0, self.count["tr"] > 0)
        self.found.append(element)
        return element

    def _ends(self, element: _Element | None) -> None:
        self.parted = True
        if element is not None:
            element.last, element.next = len(self.pieces), len(self.found)

    def handle_starttag(self, tag, attrs):
        element = self._begins(tag)
        if tag in ("script", "style"):
            self.silent = tag
        elif tag not in _VOID:
            self.open.append((tag, element))
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._ends(self._begins(tag))

    def _pop(self) -> str:
        tag, element = self.open.pop()
        self.count[tag] -= 1
        self._ends(element)
        return tag

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = ""
        elif self.count[tag]:
            while self._pop() != tag:
                pass

    def close(self):
        super().close()
        while self.open:
            self._pop()

    def handle_data(self, data):
        if not self.silent:
            if self.parted:
                self.pieces.append(data)
            else:
                self.pieces[-1] += data
            self.parted = False

    def handle_comment(self, data):
        self.parted = True

    def text(self, element: _Element) -> str:
        return " ".join(" ".join(self.pieces[element.first : element.last]).split())


def blocks_of(html: str | None) -> str:
    """The blocks of a page, one empty line between: paragraphs outside of tables, and the rows of tables that aren't
    inside other rows, as their cells that have text, joined by bars. White space, line breaks too, is folded. A page
    without blocks is its whole text, a line for each piece. Any depth of elements is read without recursion; a paragraph
    that isn't closed has all that follows inside of what stands around it, so n of them make n * n / 2 pieces."""
    page = _Elements()
    page.feed(html or "")
    page.close()
    blocks = []
    for i, e in enumerate(page.found):
        if e.tag == "tr" and not e.in_row:
            cells = [page.text(c) for c in page.found[i + 1 : e.next] if c.tag in ("td", "th")]
            blocks.append(" | ".join(c for c in cells if c))
        elif e.tag == "p" and not e.in_table:
            blocks.append(page.text(e))
    if not any(blocks):
        return re.sub(r"\n{3,}", "\n\n", "\n".join(t for t in map(str.strip, page.pieces) if t)).strip()
    return "\n\n".join(b for b in blocks if b)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(blocks_of)


def body_gate(text: Column, noise: list[str], topic: str, least: int = 80, length_only: bool = False) -> Column:
    """Long enough, none of the noise patterns, and the topic pattern. Cheap tests stand first."""
    passes = F.length(F.trim(text)) >= least
    if length_only:
        return passes
    for pattern in noise:
        passes = passes & ~text.rlike(pattern)
    return passes & text.rlike(topic)


def noise_url(url: Column, parts: list[str]) -> Column:
    """Any of the parts in the lower-cased url."""
    found = F.lit(False)
    for part in parts:
        found = found | F.lower(url).contains(part)
    return found


def exact_copies(pages: DataFrame, key: str, order: list[str], least: int = 80, within: list[str] | None = None) -> DataFrame:
    """The pages that repeat an earlier one (of the same document, with the columns that name it in `within`) after
    normalisation, which has `least` characters or more."""
    norm = pages.withColumn("_norm", normalised_text(F.col("text"))).where(F.length("_norm") >= least)
    # by the digest: texts don't go through the shuffle
    w = Window.partitionBy("_digest", *(within or [])).orderBy(*order)
    kept = dict.fromkeys([key, *order, *(within or [])])
    return norm.select(*kept, F.sha2("_norm", 256).alias("_digest")).withColumn("_k", F.row_number().over(w)).where("_k > 1").select(key)


def pages_to_cut(pages: DataFrame, patterns: str | list[str], keep_first: bool = False, follow: int = 0) -> DataFrame:
    """(doc, page) of pages(doc, page, text) with a hit of any pattern (but each pattern's first one in a document, if
    kept), and `follow` after it."""
    every = [patterns] if isinstance(patterns, str) else patterns
    tests = F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in enumerate(every)])
    hits = pages.select("doc", "page", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("pattern"))
    if keep_first:
        hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy("doc", "pattern").orderBy("page"))).where("_k > 1").drop("_k")
    spread = hits.select("doc", F.explode(F.sequence(F.col("page"), F.col("page") + follow)).alias("page")).distinct()
    return spread.join(pages.select("doc", "page"), ["doc", "page"], "left_semi")


def page_spec(spec: Column, pages: Column) -> Column:
    """Pages (1-based, sorted, array<int>) of a text such as "3,7-9", clipped to the number of pages."""
    parts = F.filter(F.split(F.regexp_replace(spec, "\\s", ""), ","), lambda x: x != "")
    low = lambda x: F.substring_index(x, "-", 1).cast("int")
    ranges = F.transform(parts, lambda x: F.sequence(low(x), F.greatest(low(x), F.call_function("substring_index", x, F.lit("-"), F.lit(-1)).cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(ranges), lambda p: (p >= 1) & (p <= pages))))


def vocabulary_pattern(cues: list[str]) -> str:
    """Any of the cues, in any case; a cue that begins or ends with a word character does so at a word's border."""
    bound = lambda cue: ("\\b" if re.match(r"\w", cue) else "") + cue + ("\\b" if re.search(r"\w$", cue) else "")
    return "(?i)(?:" + "|".join(map(bound, cues)) + ")"


def tagged(docs: DataFrame, vocabulary: list[tuple[str, str, list[str]]], key: str) -> DataFrame:
    """(key, field, label) for vocabulary rows (field, label, cues) with a cue in the text; one native pass."""
    tags = F.array(*[F.when(F.col("text").rlike(vocabulary_pattern(cues)), F.struct(F.lit(field).alias("field"), F.lit(label).alias("label"))) for field, label, cues in vocabulary])
    return docs.select(key, F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t")).select(key, "t.field", "t.label")


class Terms:
    """Rows (field, label, term) as one automaton, without regard to the case of A-Z. A term that begins or ends with a word
    character (a letter, a digit or _) does so at a word's border, as in vocabulary_pattern."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        import ahocorasick

        #: (field, label) of each number, and by term: its length, whether its ends need a border, and its numbers.
        self.labels = sorted({(f, n) for f, n, t in rows if t})
        number = {x: i for i, x in enumerate(self.labels)}
        by_term: dict[str, set[int]] = {}
        for f, n, t in rows:
            if t:
                by_term.setdefault(t.translate(_LOWER), set()).add(number[f, n])
        self.found_by = ahocorasick.Automaton()
        for t, numbers in by_term.items():
            self.found_by.add_word(t, (len(t), _in_word(t[0]), _in_word(t[-1]), sorted(numbers)))
        self.empty = not by_term
        if by_term:
            self.found_by.make_automaton()

    def tags(self, text: str | None) -> list[int]:
        """The numbers of the labels that a text has, once each."""
        if self.empty or not text:
            return []
        text, found = text.translate(_LOWER), set()
        for last, (size, begins, ends, numbers) in self.found_by.iter(text):
            first = last - size + 1
            if begins and first and _in_word(text[first - 1]) or ends and last + 1 < len(text) and _in_word(text[last + 1]):
                continue
            found.update(numbers)
        return sorted(found)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Terms of one pass, in characters: an automaton takes about a hundred times their memory.
TERMS_CHARS = 2 << 20


def tagged_by_terms(docs: DataFrame, terms: DataFrame, key: str, most_chars: int = TERMS_CHARS) -> DataFrame:
    """(key, field, label) for rows of terms(field, label, term), plain texts, that stand in docs(key, text): one automaton
    for all terms, so a pass takes the same time for ten terms as for ten thousand. A larger vocabulary is taken in parts
    by a hash of its terms, each built in its own pass. Null and empty terms and texts match nothing; labels that two terms
    give are one row."""
    rows = terms.where("term <> ''").select("field", "label", "term").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most_chars))
    sc, kind, found = docs.sparkSession.sparkContext, docs.schema[key].dataType, None
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        shared = sc.broadcast([tuple(r) for r in own.collect()])  # most_chars characters, about

        def run(batches, shared=shared):
            import pyarrow as pa

            known = Terms(shared.value)
            for batch in batches:
                at, fields, labels = [], [], []
                for i, text in enumerate(batch.column(1)):
                    for n in known.tags(text.as_py()):
                        at.append(i)
                        fields.append(known.labels[n][0])
                        labels.append(known.labels[n][1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(fields, pa.string()), pa.array(labels, pa.string())], [key, "field", "label"])

        one = docs.select(key, "text").mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("field", T.StringType()), T.StructField("label", T.StringType())]))
        found = one if found is None else found.unionByName(one)
    return found if parts == 1 else found.distinct()


def tagged_by_profile(docs: DataFrame, profiles: DataFrame, vocabulary: list[tuple[str, str, str, str]]) -> DataFrame:
    """(record_id, field, label) of docs(record_id, text) by the profiles(record_id, profile) that each is read against:
    vocabulary rows are (profile, field, label, cue); one native pass, in which the cues are constants."""
    mine = profiles.groupBy("record_id").agg(F.collect_set("profile").alias("_profiles"))
    rows = docs.select("record_id", "text").join(mine, "record_id")
    labels: dict[tuple[str, str], list] = {}
    for profile, field, label, cue in vocabulary:
        labels.setdefault((field, label), []).append(F.array_contains("_profiles", profile) & F.col("text").rlike(f"(?i)\\b(?:{cue})\\b"))
    tags = [F.when(reduce(lambda a, b: a | b, tests), F.struct(F.lit(field).alias("field"), F.lit(label).alias("label"))) for (field, label), tests in labels.items()]
    return rows.select("record_id", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("t")).select("record_id", "t.field", "t.label")


def sentences(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, sentence)."""
    return docs.select(key, F.posexplode(F.filter(F.split("text", "(?<=[.!?])\\s+"), lambda s: s != "")).alias("n", "sentence"))


def pattern_values(docs: DataFrame, pattern: str, key: str) -> DataFrame:
    """(key, value): every match in a text, inside the JVM; for matches with offsets see spans_of."""
    return docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("value"))


def spans_of(docs: DataFrame, patterns: dict[str, str], key: str) -> DataFrame:
    """(key, kind, start, end, value): matches with code point offsets, in Arrow batches."""
    compiled = {k: re.compile(p) for k, p in patterns.items()}
    found = lambda text: ((k, m.start(), m.end(), m.group()) for k, p in compiled.items() for m in p.finditer(text))
    return in_batches(docs, key, found, "kind string, start int, end int, value string")


def redacted(text: Column) -> Column:
    """E-mail names replaced, the domain kept; long numbers masked."""
    return F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+)", "[name]@$1"), "[0-9]{9,}", "[number]")


# fixed values: titles that stand before a name
_TITLES = "Mr|Mrs|Ms|Dr"


def people_numbered(docs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """docs(key, text) with the names of names(key, name) replaced by "Person n", n in the order of first mention, and what
    is left of a full name's words by "[name]"; e-mail names and long numbers as redacted(). leaks counts the full names
    that still stand in the text: the check after redaction, 0 if all went well.

    The names of one document are few by nature; they are put together in a list beside its text."""
    kind = docs.schema[key].dataType.simpleString()
    listed = names.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("_names"))

    def run(batches):
        for pdf in batches:
            texts, leaks = [], []
            for text, found in zip(pdf["text"], pdf["_names"], strict=True):
                text, found = text or "", [] if found is None else [n for n in found if n]
                order = sorted((n for n in found if n in text), key=lambda n: (text.index(n), -len(n), n))
                for n, name in sorted(enumerate(order, 1), key=lambda x: -len(x[1])):
                    text = re.sub(rf"(?:(?:{_TITLES})\.?\s+)?\b{re.escape(name)}\b", f"Person {n}", text)
                rest = sorted({w for name in found for w in name.split() if len(w) > 2 and w[:1].isupper() and w != "Person"}, key=lambda w: (-len(w), w))
                if rest:
                    text = re.sub(rf"\b(?:{'|'.join(map(re.escape, rest))})\b", "[name]", text)
                texts.append(text)
                leaks.append(sum(n in text for n in found))
            yield pd.DataFrame({key: pdf[key], "text": texts, "leaks": leaks})

    named = docs.select(key, "text").join(listed, key, "left").mapInPandas(run, f"`{key}` {kind}, text string, leaks int")
    return named.withColumn("text", redacted(F.col("text")))
