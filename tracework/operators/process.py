"""Process discovery and alignment on variant counts.

Spark counts the variants; discovery works on them on the driver, as the log is small once counted (VARIANTS bounds it:
rarer ones than that would mean that activities aren't a vocabulary). Alignments run on the cluster, one per variant.

Trees are tuples: ("act", name), TAU, or (tag, children...) with tag seq, xor, par or loop. Discovery follows the
published inductive miner (Leemans et al., 2013): look for an exclusive choice, sequence, parallel or loop cut of the
directly-follows graph, split the log along it and go on; where no cut fits, a flower of the activities remains.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.operators import automaton

VARIANTS = 100_000
TAU = ("tau",)

Log = Counter


class TooLarge(ValueError):
    """A tree's language has more words than asked for."""


def collect_log(variants: DataFrame, most: int = VARIANTS) -> Log:
    rows = variants.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"more than {most} variants")
    return Counter({tuple(r["variant"].split(">")) if r["variant"] else (): r["n"] for r in rows})


def follows(log: Log, noise: float = 0.0) -> dict[str, set[str]]:
    """Successors of each activity; pairs rarer than `noise` times the most frequent one of their source are left out."""
    n: dict[str, Counter] = defaultdict(Counter)
    for trace, times in log.items():
        for a, b in zip(trace, trace[1:], strict=False):
            n[a][b] += times
        if trace:
            n[trace[-1]][None] += times  # ending counts among what follows
    return {a: {b for b, k in found.items() if b is not None and k >= noise * max(found.values())} for a, found in n.items()}


def _ends(log: Log, at: int, noise: float) -> set[str]:
    n: Counter = Counter()
    for trace, times in log.items():
        if trace:
            n[trace[at]] += times
    return {a for a, k in n.items() if k >= noise * max(n.values())}


def _groups(items: set[str], joined) -> list[set[str]]:
    """Connected components of the items under a symmetric relation, in order of their least item."""
    left, out = sorted(items), []
    while left:
        group, open_ = set(), [left[0]]
        while open_:
            a = open_.pop()
            if a not in group:
                group.add(a)
                open_ += [b for b in left if b not in group and joined(a, b)]
        out.append(group)
        left = [a for a in left if a not in group]
    return out


def _reach(graph: dict[str, set[str]], items: set[str]) -> dict[str, set[str]]:
    out = {}
    for a in items:
        seen, open_ = set(), [a]
        while open_:
            for b in graph.get(open_.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    open_.append(b)
        out[a] = seen
    return out


def _choice(graph, items, *_):
    parts = _groups(items, lambda a, b: b in graph.get(a, ()) or a in graph.get(b, ()))
    return parts if len(parts) > 1 else None


def _sequence(graph, items, *_):
    reach = _reach(graph, items)
    # together: those that reach each other, or neither reaches the other
    parts = _groups(items, lambda a, b: (b in reach[a]) == (a in reach[b]))
    parts.sort(key=lambda p: (-sum(len(reach[a] - p) for a in p) / len(p), min(p)))
    fits = all(b in reach[a] and a not in reach[b] for i, p in enumerate(parts) for q in parts[i + 1 :] for a in p for b in q)
    return parts if len(parts) > 1 and fits else None


def _parallel(graph, items, starts, ends):
    parts = _groups(items, lambda a, b: not (b in graph.get(a, ()) and a in graph.get(b, ())))
    whole = [p for p in parts if p & starts and p & ends]
    for p in parts:
        if p not in whole and whole:
            whole[0] |= p
    return whole if len(whole) > 1 else None


def _loop(graph, items, starts, ends):
    body = starts | ends
    parts = _groups(items - body, lambda a, b: b in graph.get(a, ()) or a in graph.get(b, ()))
    redo = []
    for p in parts:
        into = {a for a in items - p if graph.get(a, set()) & p}
        out = {b for a in p for b in graph.get(a, set()) - p}
        if into and out and into <= ends and out <= starts:
            redo.append(p)
        else:
            body |= p
    return [body, *redo] if redo else None


def _project(log: Log, part: set[str]) -> Log:
    out: Log = Counter()
    for trace, n in log.items():
        out[tuple(a for a in trace if a in part)] += n
    return out


def _split_sequence(log: Log, parts: list[set[str]]) -> list[Log]:
    place = {a: i for i, p in enumerate(parts) for a in p}
    out = [Counter() for _ in parts]
    for trace, n in log.items():
        for i in range(len(parts)):
            out[i][tuple(a for a in trace if place[a] == i)] += n
    return out


def _split_loop(log: Log, parts: list[set[str]]) -> list[Log]:
    place = {a: i for i, p in enumerate(parts) for a in p}
    out = [Counter() for _ in parts]
    for trace, n in log.items():
        runs: list[list[str]] = []
        for a in trace:
            if runs and place[runs[-1][0]] == place[a]:
                runs[-1].append(a)
            else:
                runs.append([a])
        if trace and place[trace[0]]:
            out[0][()] += n
        for run in runs:
            out[place[run[0]]][tuple(run)] += n
        if trace and place[trace[-1]]:
            out[0][()] += n
    return out


def mine(log: Log, noise: float = 0.0) -> tuple:
    """The process tree of a log of {trace: times}; equal for any order of the log."""
    log = Counter({t: n for t, n in log.items() if n > 0})
    items = {a for t in log for a in t}
    if not items:
        return TAU
    empty, total = log.get((), 0), sum(log.values())
    if empty:
        rest = Counter({t: n for t, n in log.items() if t})
        tree = mine(rest, noise)
        return ("xor", TAU, tree) if empty > noise * total else tree
    if len(items) == 1:
        name = min(items)
        return ("act", name) if all(len(t) == 1 for t in log) else ("loop", ("act", name), TAU)
    graph, starts, ends = follows(log, noise), _ends(log, 0, noise), _ends(log, -1, noise)
    if parts := _choice(graph, items):
        logs = [Counter() for _ in parts]
        for trace, n in log.items():  # to the part that has most of the trace
            best = max(range(len(parts)), key=lambda i: (sum(a in parts[i] for a in trace), -i))
            logs[best][tuple(a for a in trace if a in parts[best])] += n
        return ("xor", *[mine(x, noise) for x in logs])
    if parts := _sequence(graph, items):
        return ("seq", *[mine(x, noise) for x in _split_sequence(log, parts)])
    if parts := _parallel(graph, items, starts, ends):
        return ("par", *[mine(_project(log, p), noise) for p in parts])
    if parts := _loop(graph, items, starts, ends):
        return ("loop", *[mine(x, noise) for x in _split_loop(log, parts)])
    return ("loop", ("xor", *[("act", a) for a in sorted(items)]), TAU)


def tree_text(tree: tuple) -> str:
    if tree == TAU:
        return "tau"
    return tree[1] if tree[0] == "act" else f"{tree[0]}({', '.join(map(tree_text, tree[1:]))})"


def language(tree: tuple, loops: int = 1, most: int = 10_000) -> set[tuple[str, ...]]:
    """All words of a tree with loops gone round at most `loops` times."""

    def bounded(words: set) -> set:
        if len(words) > most:
            raise TooLarge(f"more than {most} words")
        return words

    def shuffled(a: tuple, b: tuple) -> set:
        if not a or not b:
            return {a + b}
        return {(a[0], *x) for x in shuffled(a[1:], b)} | {(b[0], *x) for x in shuffled(a, b[1:])}

    if tree == TAU:
        return {()}
    if tree[0] == "act":
        return {(tree[1],)}
    parts = [language(t, loops, most) for t in tree[1:]]
    if tree[0] == "xor":
        return bounded(set().union(*parts))
    if tree[0] == "loop":
        redo = set().union(*parts[1:])
        words = out = parts[0]
        for _ in range(loops):
            words = bounded({w + r + b for w in words for r in redo for b in parts[0]})
            out = bounded(out | words)
        return out
    words = parts[0]
    for p in parts[1:]:
        if tree[0] == "seq":
            words = bounded({a + b for a in words for b in p})
        else:
            words = bounded(set().union(*[shuffled(a, b) for a in words for b in p]))
    return words


def alignment(trace: tuple[str, ...], model: tuple[str, ...]) -> tuple[int, list[tuple[str | None, str | None]]]:
    """Cost and moves of the cheapest alignment: a move on one side alone costs 1, a joint move nothing."""
    n, m = len(trace), len(model)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            alone = 1 + min(cost[i - 1][j], cost[i][j - 1])
            cost[i][j] = min(alone, cost[i - 1][j - 1]) if trace[i - 1] == model[j - 1] else alone
    moves, i, j = [], n, m
    while i or j:
        if i and j and trace[i - 1] == model[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
            moves.append((trace[i], model[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            moves.append((trace[i], None))
        else:
            j -= 1
            moves.append((None, model[j]))
    return cost[n][m], moves[::-1]


def fitness(cost: int, trace_length: int, model_length: int) -> float:
    return 1 - cost / (trace_length + model_length) if trace_length + model_length else 1.0


def align(variants: DataFrame, allowed: list) -> DataFrame:
    """(variant, n, cost, fitness) against the nearest allowed trace: the cheapest, of equally cheap ones the longest."""
    models = [tuple(m) for m in allowed]

    def run(batches):
        for pdf in batches:
            best = []
            for text in pdf["variant"]:
                trace = tuple(text.split(">")) if text else ()
                costs = [(alignment(trace, m)[0], len(m)) for m in models]
                cost, k = min(costs, key=lambda c: (c[0], -c[1]), default=(len(trace), 0))
                best.append((cost, round(fitness(cost, len(trace), k), 6)))
            yield pdf[["variant", "n"]].assign(cost=[b[0] for b in best], fitness=[b[1] for b in best])

    return variants.select("variant", "n").mapInPandas(run, "variant string, n long, cost long, fitness double")


def tree_alignment(trace: tuple[str, ...], tree: tuple) -> tuple[int, int]:
    """(cost, length of the tree's word) of the cheapest alignment with any word of the tree, loops gone round at will;
    of equally cheap ones, the longest word."""
    return automaton.Aligner(automaton.compiled(tree)).align(trace)


def align_tree(variants: DataFrame, tree: tuple) -> DataFrame:
    """(variant, n, cost, fitness) against the whole language of a tree, compiled once. Tasks get ranges of variants in
    order, so that those with a common beginning meet."""
    model = automaton.compiled(tree)
    cores = variants.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        aligner = automaton.Aligner(model)
        for pdf in batches:
            traces = [tuple(text.split(">")) if text else () for text in pdf["variant"]]
            best = [aligner.align(t) for t in traces]
            fit = [round(fitness(c, len(t), k), 6) for t, (c, k) in zip(traces, best, strict=True)]
            yield pdf[["variant", "n"]].assign(cost=[c for c, _ in best], fitness=fit)

    ordered = variants.select("variant", "n").repartitionByRange(cores, "variant").sortWithinPartitions("variant")
    return ordered.mapInPandas(run, "variant string, n long, cost long, fitness double")


def log_fitness(aligned: DataFrame) -> DataFrame:
    """(traces, traces_fitting_exactly, fitness): weighted by the variants' traces."""
    exact = F.sum(F.when(F.col("cost") == 0, F.col("n")).otherwise(0))
    return aligned.agg(F.sum("n").alias("traces"), exact.alias("traces_fitting_exactly"), (F.sum(F.col("n") * F.col("fitness")) / F.sum("n")).alias("fitness"))
