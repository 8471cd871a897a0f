"""Triples (s, p, o): neighbours, basic graph patterns, shape checks and subclass closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.operators import closure

TYPE = "a"


def local_name(column) -> F.Column:
    """What stands after the last "#", "/" or ":", so that one label under two prefixes is one."""
    return F.regexp_extract(column, "([^#/:]+)$", 1)


def neighbours(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, p, other, outward) of nodes(node): statements in which a node is subject or object."""
    out = triples.join(nodes, F.col("s") == F.col("node")).select("node", "p", F.col("o").alias("other"), F.lit(True).alias("outward"))
    back = triples.join(nodes, F.col("o") == F.col("node")).select("node", "p", F.col("s").alias("other"), F.lit(False).alias("outward"))
    return out.unionByName(back)


def match(triples: DataFrame, pattern: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern: terms that start with "?" are variables; one join for each further statement,
    on the variables that both sides share. A statement that shares none with those before it is refused. One whose
    variables all stand in another only thins it out, before the joins; and bindings of distinct statements are distinct,
    so nothing is compared after them."""

    def one(statement):
        kept, names, out = triples, {}, []
        for column, term in zip(("s", "p", "o"), statement, strict=True):
            if not term.startswith("?"):
                kept = kept.where(F.col(column) == term)
            elif term in names:
                kept = kept.where(F.col(column) == F.col(names[term]))
            else:
                names[term] = column
                out.append(F.col(column).alias(term[1:]))
        return kept.select(*out).distinct()

    parts = [one(statement) for statement in pattern]
    bound: list[str] = []
    for statement, part in zip(pattern, parts, strict=True):
        if bound and not set(part.columns) & set(bound):
            raise ValueError(f"{statement} shares no variable with the statements before it")
        bound += [c for c in part.columns if c not in bound]
    wide: list[DataFrame] = []
    for part in sorted(parts, key=lambda p: -len(p.columns)):
        at = next((i for i, w in enumerate(wide) if set(part.columns) <= set(w.columns)), None)
        if at is None:
            wide.append(part)
        else:
            wide[at] = wide[at].join(part, part.columns, "left_semi")
    found = wide.pop(0)
    while wide:
        part = wide.pop(next(i for i, w in enumerate(wide) if set(w.columns) & set(found.columns)))
        found = found.join(part, [c for c in part.columns if c in found.columns])
    return found.select(*bound)


def subclasses(edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """(sub, super) closure of a class hierarchy, each class its own superclass; a vocabulary, so rounds are few."""
    every = closure.reach(edges.select(F.col("sub").alias("a"), F.col("super").alias("b")), most_depth)
    return every.select(F.col("a").alias("sub"), F.col("b").alias("super"))


def with_supertypes(triples: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Type statements with all superclasses of the stated class."""
    typed = triples.where(F.col("p") == TYPE).join(hierarchy, F.col("o") == F.col("sub"), "left").select("s", "p", F.coalesce("super", "o").alias("o"))
    return triples.where(F.col("p") != TYPE).select("s", "p", "o").unionByName(typed).distinct()


def violations(triples: DataFrame, target: str, shapes: list[dict]) -> DataFrame:
    """(s, path, rule): nodes of the target class that break a shape. A shape has path and any of min, max (values),
    cls (each value's class), kind (each value's o_kind)."""
    nodes = triples.where((F.col("p") == TYPE) & (F.col("o") == target)).select("s").distinct()
    types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("cls")).distinct()
    found = None
    for shape in shapes:
        values = nodes.join(triples.where(F.col("p") == shape["path"]).drop("p"), "s", "left")
        counted = values.groupBy("s").agg(F.count("o").alias("n"))
        parts = []
        if "min" in shape:
            parts.append(counted.where(F.col("n") < shape["min"]).select("s", F.lit("min").alias("rule")))
        if "max" in shape:
            parts.append(counted.where(F.col("n") > shape["max"]).select("s", F.lit("max").alias("rule")))
        if "cls" in shape:
            ok = types.where(F.col("cls") == shape["cls"])
            parts.append(values.where("o IS NOT NULL").join(ok, "o", "left_anti").select("s", F.lit("class").alias("rule")))
        if "kind" in shape:
            parts.append(values.where(F.col("o").isNotNull() & (F.col("o_kind") != shape["kind"])).select("s", F.lit("kind").alias("rule")))
        for part in parts:
            part = part.distinct().select("s", F.lit(shape["path"]).alias("path"), "rule")
            found = part if found is None else found.unionByName(part)
    return found


def cohort_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cls, side) of the node classes that one graph has and the other hasn't, and those of both."""
    a, b = (t.where(F.col("p") == TYPE).select(F.col("o").alias("cls")).distinct() for t in (left, right))
    only = lambda x, y, name: x.join(y, "cls", "left_anti").withColumn("side", F.lit(name))
    return only(a, b, "left").unionByName(only(b, a, "right")).unionByName(a.join(b, "cls", "left_semi").withColumn("side", F.lit("both")))


def summary(triples: DataFrame) -> DataFrame:
    """(cls, nodes, statements): the nodes of each class, and what they state beside their classes."""
    typed = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct()
    said = triples.where(F.col("p") != TYPE).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return typed.join(said, "s", "left").groupBy("cls").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements"))


def search(triples: DataFrame, pattern: str) -> DataFrame:
    """(node, cls) of typed nodes whose name matches a pattern."""
    typed = triples.where((F.col("p") == TYPE) & F.col("s").rlike(pattern))
    return typed.select(F.col("s").alias("node"), F.col("o").alias("cls")).distinct()


def subset_candidates(cases: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(subset, key): every subset whose rule, a SQL condition on the case's row, a case meets."""
    met = F.filter(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in rules]), lambda x: x.isNotNull())
    return cases.select(F.explode(met).alias("subset"), key)
