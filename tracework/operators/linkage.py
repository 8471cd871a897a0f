"""Linking records into cases and people, and values to people.

Connected components run on the cluster by alternating stars over cut tables, so lineage stays short and a lost
executor costs one round; few edges are joined by one task. Keys link star-shaped (each member to the least one), never in all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.functions.columns import content_id
from tracework.operators import intervals
from tracework.session import cut, small


def star_edges(members: DataFrame, record: str, *keys: str, distinct: bool = True) -> DataFrame:
    """(a, b): the least record of each key to every other one; unless distinct, as often as keys have them."""
    known = members.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]))
    least = known.withColumn("_least", F.min(record).over(Window.partitionBy(*keys)))
    edges = least.where(F.col(record) != F.col("_least")).select(F.col("_least").alias("a"), F.col(record).alias("b"))
    return edges.distinct() if distinct else edges


#: Edges that one task joins: a graph of no more is finished there, a larger one on the cluster until so few are left.
FEW_EDGES = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of at most FEW_EDGES edges(u, v): roots of either end are hooked onto the lesser one, all edges at once,
    until no edge joins two roots."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        names = pc.unique(pa.chunked_array([*table["u"].chunks, *table["v"].chunks]))
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(table[c], value_set=names).to_numpy() for c in "uv")
        root = np.arange(len(names))
        while len(a):
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root != (up := root[root])).any():
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected(edges: DataFrame, most_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """edges(a, b) -> (node, root), root the least node of the component; only nodes with edges. With few = 0 all rounds
    run on the cluster."""
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        if few and state.limit(few + 1).count() <= few:
            return _in_one_task(state)
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = cut(small_star.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def case_of(records: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, record_id) of records(record_id) and links(a, b): the case id is a hash of its least record."""
    found = connected(links.select("a", "b"))
    named = records.select("record_id").join(found, F.col("record_id") == F.col("node"), "left")
    return named.select(content_id(F.coalesce("root", "record_id").cast("string"), "case-").alias("case_id"), "record_id")


def cases(records: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, record_id, basis) of records(record_id) and links(a, b, basis): cases as case_of() has them, the basis the
    sorted labels of a record's links, or "single"."""
    labels = links.select(F.col("a").alias("record_id"), "basis").unionByName(links.select(F.col("b").alias("record_id"), "basis"))
    basis = labels.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("basis")), ",").alias("basis"))
    named = case_of(records, links).join(basis, "record_id", "left")
    return named.select("case_id", "record_id", F.coalesce("basis", F.lit("single")).alias("basis"))


def press_links(filings: DataFrame, press: DataFrame, prefix: str = "pr-") -> DataFrame:
    """(a, b, basis) of filings(record_id, press_url) whose release is in press(record_id): a release's id is a hash of
    its url."""
    wanted = filings.where("press_url IS NOT NULL AND press_url <> ''").select("record_id", content_id(F.col("press_url"), prefix).alias("press_id"))
    met = wanted.join(press.select(F.col("record_id").alias("press_id")).distinct(), "press_id")
    return met.select(F.least("record_id", "press_id").alias("a"), F.greatest("record_id", "press_id").alias("b"), F.lit("press_link").alias("basis")).distinct()


def case_candidates(numbers: DataFrame, case_of: DataFrame, most: int = 12) -> DataFrame:
    """(record_a, record_b, number): pairs in different cases that share a number which at most `most` entries have.
    A number that is too common is no lead, by definition. So a number's members are a short list, and its pairs are
    made from that list: no join of the entries with themselves."""
    few = numbers.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("number")
    placed = numbers.join(few, "number", "left_semi").join(case_of.select("record_id", "case_id"), "record_id")
    members = placed.groupBy("number").agg(F.sort_array(F.collect_set(F.struct("record_id", "case_id"))).alias("m")).where("size(m) > 1")
    one = members.select("number", "m", F.posexplode("m").alias("i", "a"))
    other = F.filter(F.slice("m", F.col("i") + 2, F.size("m")), lambda b: b["case_id"] != F.col("a.case_id"))
    return one.select("number", F.col("a.record_id").alias("record_a"), F.explode(other).alias("b")).select("record_a", F.col("b.record_id").alias("record_b"), "number")


def case_statistics(case_of: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    sizes = case_of.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") > 1).alias("with_more_than_one_record"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return found if candidates is None else found.crossJoin(F.broadcast(candidates.agg(F.count(F.lit(1)).alias("candidate_links"))))  # one row each


def people_summary(people: DataFrame) -> DataFrame:
    """(people, in_more_than_one_record) of people(case_id, person, record_id)."""
    by = people.groupBy("case_id", "person").agg(F.countDistinct("record_id").alias("records"))
    return by.agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("records") > 1).alias("in_more_than_one_record"))


def defendants(finals: DataFrame) -> DataFrame:
    return finals.where("field = 'party' AND role = 'defendant'")


def with_known_owners(values: DataFrame, people: DataFrame) -> DataFrame:
    """values(record_id, owners: array) with known: every owner is among the record's people(record_id, person)."""
    per = people.groupBy("record_id").agg(F.collect_set("person").alias("_all"))
    left = F.array_except("owners", F.coalesce("_all", F.array().cast("array<string>")))
    return values.join(per, "record_id", "left").withColumn("known", F.size(left) == 0).drop("_all")


def claim_statuses(claims: DataFrame, results: DataFrame) -> DataFrame:
    """claims(id, ...) with the status of results(id, status), "skip" without one."""
    return claims.join(results.select("id", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("skip")))


def name_key(name: Column) -> Column:
    """struct(surname, given) of "Given Surname" or "Surname, Given", lower-cased, without dots."""
    clean = F.lower(F.trim(F.regexp_replace(name, "[.]", "")))
    comma = F.instr(clean, ",") > 0
    words = F.split(clean, "\\s+")
    surname = F.when(comma, F.trim(F.substring_index(clean, ",", 1))).otherwise(F.element_at(words, -1))
    given = F.when(comma, F.trim(F.substring_index(clean, ",", -1))).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return F.struct(surname.alias("surname"), given.alias("given"))


def compatible(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Equal surnames, and given names that are missing, equal, or an initial of the other."""
    if a[0] != b[0]:
        return False
    short, long = sorted((a[1], b[1]), key=len)
    return not short or short == long or (len(short) == 1 and long.startswith(short))


def link_people(mentions: DataFrame) -> DataFrame:
    """(case_id, person, record_id, name, basis) of mentions(case_id, record_id, ord, name, surname, given).

    Inside a case, in order of (record_id, ord), a mention joins the first compatible person, whose fullest given name
    is kept; a case of one record numbers its people. People with other surnames are never compatible, so only the
    mentions of one surname in a case are put in order together; people are then numbered by their first mentions."""
    kinds = {f.name: f.dataType.simpleString() for f in mentions.schema}
    single = mentions.groupBy("case_id").agg((F.countDistinct("record_id") == 1).alias("single"))
    rows = mentions.join(single, "case_id").withColumn("surname", F.coalesce("surname", F.lit(""))).withColumn("given", F.coalesce("given", F.lit("")))
    alone = F.col("single") | (F.col("surname") == "")  # whoever has no surname is nobody else
    columns = ["case_id", "record_id", "ord", "name", "single"]

    def run(pdf):
        pdf = pdf.sort_values(["record_id", "ord"], kind="stable")
        known: list[tuple[str, object, object]] = []  # the fullest given name, and the first mention
        first = []
        for given, record, place in zip(pdf["given"], pdf["record_id"], pdf["ord"], strict=True):
            at = next((i for i, k in enumerate(known) if compatible(("", given), ("", k[0]))), None)
            if at is None:
                at = len(known)
                known.append((given, record, place))
            elif len(given) > len(known[at][0]):
                known[at] = (given, *known[at][1:])
            first.append(known[at][1:])
        return pdf[columns].assign(first_record=[f[0] for f in first], first_ord=[f[1] for f in first])

    schema = f"case_id {kinds['case_id']}, record_id {kinds['record_id']}, ord {kinds['ord']}, name string, single boolean, first_record {kinds['record_id']}, first_ord {kinds['ord']}"
    joined = rows.where(~alone).groupBy("case_id", "surname").applyInPandas(run, schema)
    own = rows.where(alone).select(*columns, F.col("record_id").alias("first_record"), F.col("ord").alias("first_ord"))
    number = F.dense_rank().over(Window.partitionBy("case_id").orderBy("first_record", "first_ord"))
    basis = F.when(F.col("single"), "single_record").otherwise("name_match")
    return joined.unionByName(own).select("case_id", F.concat(F.lit("p"), number.cast("string")).alias("person"), "record_id", "name", basis.alias("basis"))


def attribute_values(values: DataFrame, votes: DataFrame, people: DataFrame) -> DataFrame:
    """values(record_id, field, start, end) with people and basis: those voted for at the span, else the record's only
    person; values of records with more people and no vote have basis null (unattributed)."""
    per = people.groupBy("record_id").agg(F.array_sort(F.collect_set("person")).alias("all_people"))
    joined = values.join(votes.select("record_id", "field", "start", "end", F.col("people").alias("voted")), ["record_id", "field", "start", "end"], "left").join(per, "record_id", "left")
    sole = F.size("all_people") == 1
    return joined.select(
        "record_id", "field", "start", "end", F.coalesce("voted", F.when(sole, F.col("all_people"))).alias("people"),
        F.when(F.col("voted").isNotNull(), "vote").when(sole, "sole_defendant").alias("basis"),
    )


def inside_window(acts: DataFrame, marks: DataFrame) -> DataFrame:
    """Interval join: acts(record_id, act, at, begin, end) with marks(record_id, pos, value) in [begin, end)."""
    return intervals.inside(acts, marks)


def nearest_mark(acts: DataFrame, marks: DataFrame) -> DataFrame:
    """(record_id, act, value): the mark inside the act's window nearest to its start; the first on a tie; null if none."""
    return intervals.nearest(acts, marks)


def first_match_join(terms: DataFrame, dimension: DataFrame, order: list[str]) -> DataFrame:
    """terms(record_id, term, months) with the first row of dimension(record_id, label, low, high, ...), in its order, whose
    high or low equals the months; bound says which, and high is asked first."""
    bound = F.when(F.col("months") == F.col("high"), "maximum").when(F.col("months") == F.col("low"), "minimum")
    both = terms.join(dimension, "record_id").withColumn("bound", bound).where("bound IS NOT NULL")
    w = Window.partitionBy("record_id", "term").orderBy(*order)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def exact_then_fallback(left: DataFrame, right: DataFrame, exact: list[str], fallback: list[str], value: str) -> DataFrame:
    """left with right's value on the exact keys, else the first one (by value) on the fallback keys."""
    one = right.groupBy(*exact).agg(F.min(value).alias("_exact"))
    other = right.groupBy(*fallback).agg(F.min(value).alias("_other"))
    return left.join(one, exact, "left").join(other, fallback, "left").withColumn(value, F.coalesce("_exact", "_other")).drop("_exact", "_other")


def shared_nodes(triples: DataFrame) -> DataFrame:
    """(node, cases, shared) of triples(case, s): subjects and the number of cases that have them."""
    return triples.groupBy(F.col("s").alias("node")).agg(F.countDistinct("case").alias("cases")).withColumn("shared", F.col("cases") > 1)


#: Vectors that a task holds of either side.
BLOCK_VECTORS = 8_192
#: Vectors that meet a block at a time: their pairs leave the task before the next ones come, however many there are.
TILE_VECTORS = 128


def similar_pairs(vectors: DataFrame, threshold: float, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """(a, b, cosine) of vectors(id, v), a < b, at the threshold or above.

    Exact, hence every row meets every other one: the work is the square of the rows, in blocks of about block_vectors
    dealt by a hash of the id. Tasks are even, none holds more than a block and a batch, and a row travels once for each block."""
    blocks = max(1, -(-vectors.count() // block_vectors))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = vectors.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("_n", length).where("_n > 0")
    unit = unit.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v")).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, ids, held = None, [], []
        for batch in batches:
            x, y, role, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y", "_role", "id"))
            edges = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True):
                if a == b:
                    continue
                if (now := (x[a], y[a])) != key:
                    key, ids, held = now, [], []
                v = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if role[a] == 0:
                    ids.append(name[a:b].copy())
                    held.append(v.copy())
                elif held:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    for at in range(a, b, TILE_VECTORS):
                        cos = v[at - a : at - a + TILE_VECTORS] @ held[0].T
                        p, q = np.nonzero(cos >= threshold - 1e-12)
                        i, j, c = ids[0][q], name[at + p], cos[p, q]
                        if key[0] == key[1]:
                            i, j, c = i[keep := i < j], j[keep], c[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(c)], ["a", "b", "cosine"])

    pairs = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: k >= F.col("_b"))
    own = unit.select("id", "v", F.col("_b").alias("_x"), F.explode(pairs).alias("_y"), F.lit(0).alias("_role"))
    back = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: k <= F.col("_b"))
    other = unit.select("id", "v", F.explode(back).alias("_x"), F.col("_b").alias("_y"), F.lit(1).alias("_role"))
    dealt = own.unionByName(other).repartition("_x", "_y").sortWithinPartitions("_x", "_y", "_role")
    return dealt.mapInArrow(run, "a long, b long, cosine double")
