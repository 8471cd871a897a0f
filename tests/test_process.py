"""Discovery, alignment and decision analyses on small invented logs."""

import heapq
import random
from collections import Counter

import pytest

from tracework.operators import automaton
from tracework.operators import decision as D
from tracework.operators import process as P


#: Invented logs: what is done in a kitchen and at a gate.
KITCHEN = Counter({("boil", "salt", "stir", "serve"): 7, ("boil", "stir", "salt", "serve"): 4, ("boil", "bake", "serve"): 2})


def words_of(log, **options):
    return P.language(P.mine(Counter(log), **options))


def test_choices_and_parallel_steps_are_found():
    tree = P.mine(KITCHEN)
    assert tree[0] == "seq" and tree[1] == ("act", "boil") and tree[-1] == ("act", "serve")
    assert P.language(tree) == set(KITCHEN)


def test_the_order_of_a_log_means_nothing():
    rows = [("open", "scan", "pass"), ("open", "pass"), ("scan", "open", "scan", "pass"), ("alarm",)]
    for noise in (0.0, 0.15):
        assert P.mine(Counter(rows), noise=noise) == P.mine(Counter(rows[::-1]), noise=noise)


def test_steps_that_some_skip_and_steps_done_again():
    assert words_of({("open", "scan", "pass"): 5, ("open", "pass"): 3}) == {("open", "scan", "pass"), ("open", "pass")}
    assert P.mine(Counter({("knock",): 6, ("knock", "knock", "knock"): 1})) == ("loop", ("act", "knock"), P.TAU)


def test_a_loop_goes_round():
    tree = P.mine(Counter({("scan", "pass"): 3, ("scan", "pass", "back", "scan", "pass"): 1, ("scan", "pass", "back", "scan", "pass", "back", "scan", "pass"): 1}))
    assert tree[0] == "loop"
    assert {("scan", "pass"), ("scan", "pass", "back", "scan", "pass")} <= P.language(tree)
    assert P.tree_alignment(("scan", "pass", *("back", "scan", "pass") * 9), tree)[0] == 0


def test_a_rare_order_is_left_out_of_the_model_only_with_noise():
    log = {("pay", "leave"): 60, ("leave", "pay"): 1}
    assert words_of(log, noise=0.2) == {("pay", "leave")} and ("leave", "pay") in words_of(log)


def test_without_noise_every_trace_replays():
    rng = random.Random(12)
    for _ in range(60):
        log = Counter(tuple(rng.choices("uvwxyz"[: rng.randint(2, 6)], k=rng.randint(1, 5))) for _ in range(rng.randint(1, 8)))
        tree = P.mine(log)
        assert all(P.tree_alignment(trace, tree)[0] == 0 for trace in log), log


def test_a_language_too_large_to_list_is_refused():
    with pytest.raises(P.TooLarge):
        P.language(("par", *[("act", f"step {i}") for i in range(11)]), most=5000)


def test_alignments():
    model = ("open", "scan", "pass")
    assert P.alignment(model, model)[0] == 0
    cost, moves = P.alignment(("scan", "alarm", "pass"), model)
    assert cost == 2 and (None, "open") in moves and ("alarm", None) in moves
    assert P.fitness(cost, 3, 3) == pytest.approx(2 / 3) and P.fitness(0, 0, 0) == 1


def test_alignments_on_the_cluster(spark):
    variants = spark.createDataFrame([("open>pass", 5), ("open>alarm", 2), ("", 1)], "variant string, n long")
    aligned = P.align(variants, [["open", "pass"], ["pass"]])
    assert {r["variant"]: r["cost"] for r in aligned.collect()} == {"open>pass": 0, "open>alarm": 2, "": 1}
    total = P.log_fitness(aligned).first()
    assert (total["traces"], total["traces_fitting_exactly"]) == (8, 5) and total["fitness"] == pytest.approx((5 + 2 * 0.5 + 0) / 8, abs=1e-6)


def by_hand(edges, rewards, gamma, rounds=64):
    """Values by the definition, state by state."""
    out = {}
    for (a, b), w in edges.items():
        out.setdefault(a, []).append((b, w))
    names = {s for e in edges for s in e} | set(rewards)
    v = {s: rewards.get(s, 0.0) for s in names}
    for _ in range(rounds):
        v = {s: max([rewards.get(s, 0.0), *(rewards.get(s, 0.0) + gamma * w / sum(x for _, x in out[s]) * v[n] for n, w in out.get(s, []))]) for s in names}
    return v


def random_graph(rng, n=6):
    return {(a, b): round(rng.random(), 3) for a in "opqrst"[:n] for b in "opqrst"[:n] if a != b and rng.random() < 0.5}


def test_values_by_definition():
    rng = random.Random(5)
    for _ in range(20):
        edges, rewards = random_graph(rng), {"t": 10.0, "q": 1.5}
        found = D.course(D.Graph.of(edges), "o", rewards, gamma=0.8)
        assert found.values == pytest.approx(by_hand(edges, rewards, 0.8), abs=1e-6)
        assert found.path[0] == "o" and len(set(found.path)) == len(found.path)


def test_courses_and_interventions():
    edges = {("home", "bus"): 1.0, ("home", "walk"): 3.0, ("bus", "work"): 1.0, ("walk", "work"): 1.0, ("walk", "park"): 3.0}
    graph = D.Graph.of(edges)
    # by bus: 0.25 of the way to 8; on foot: 0.75, but only a quarter of the walkers arrive
    found = D.course(graph, "home", {"work": 8.0})
    assert found.value == pytest.approx(2.0) and found.path == ["home", "bus", "work"] and found.best["work"] is None
    told = D.intervention(graph, "home", {"work": 8.0}, "bus")
    assert told["after"] == pytest.approx(8 / 4) and told["after_path"] == ["home", "walk", "work"] and told["delta"] == pytest.approx(0.0)
    assert D.intervention(graph, "home", {"work": 8.0}, "work")["after"] == 0.0
    assert D.course(D.Graph.of({("a", "c"): 1.0, ("a", "b"): 1.0}), "a", {}).path == ["a", "b"]  # ties by name
    assert D.course(D.Graph.of({("a", "a"): 2.0}), "a", {"a": 1.0}).value == 65.0  # grows to the last round
    assert D.course(D.Graph.of({}), "a", {"b": 1.0}).path == ["a"]


def test_strongest_paths_against_all_paths():
    rng = random.Random(8)

    def every(edges, path, weight):
        yield path, weight
        for (a, b), w in edges.items():
            if a == path[-1] and b not in path and w > 0:
                yield from every(edges, [*path, b], weight * w)

    for _ in range(30):
        edges = random_graph(rng)
        ends = [(w, p) for p, w in every(edges, ["o"], 1.0) if p[-1] == "t"]
        found = D.strongest_path(D.Graph.of(edges), "o", "t")
        assert found["weight"] == pytest.approx(max(w for w, _ in ends) if ends else 1.0)
        assert found["path"] in [p for w, p in ends if w == pytest.approx(found["weight"])] if ends else found["path"] == ["o"]


def test_parts_of_the_strongest_path():
    found = D.strongest_path(D.Graph.of({("s", "a"): 0.5, ("a", "g"): 1.0, ("s", "g"): 0.4}), "s", "g")
    assert (found["path"], found["weight"], found["fundamental"], found["variant"]) == (["s", "a", "g"], 0.5, ["a", "g"], [("s", 0.5)])
    alone = D.strongest_path(D.Graph.of({("s", "x"): 1.0}), "s", "g")
    assert (alone["path"], alone["weight"], alone["fundamental"], alone["variant"]) == (["s"], 1.0, ["s"], [])
    assert D.goal_rewards("sextortion") == {"CoercionCycle": 10.0} and D.goal_rewards("other") == {"Maintenance": 10.0}


def first_moves(tree):
    """(activity or None, what is left) of each move that a tree allows first: its meaning, step by step."""
    if tree[0] == "act":
        return [(tree[1], P.TAU)]
    if tree[0] == "xor":
        return [(None, t) for t in tree[1:]]
    if tree[0] == "loop":
        return [(None, what_is_left("seq", tree[1], ("xor", P.TAU, *[what_is_left("seq", t, tree) for t in tree[2:]])))]
    if tree == P.TAU:
        return []
    kind, parts, out = tree[0], tree[1:], []
    for i, t in enumerate(parts if kind == "par" else parts[:1]):
        if t == P.TAU:
            out.append((None, what_is_left(kind, *parts[:i], *parts[i + 1 :])))
        out += [(name, what_is_left(kind, *parts[:i], rest, *parts[i + 1 :])) for name, rest in first_moves(t)]
    return out


def what_is_left(kind, *parts):
    parts = [p for p in parts if p != P.TAU]
    return P.TAU if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def searched(trace, tree):
    """The cheapest alignment by a search over what is left of the trace and of the tree."""
    open_, seen, order = [(0, 0, 0, 0, tree)], set(), 0
    while open_:
        cost, alone, at, _, left = heapq.heappop(open_)
        at = -at
        if (at, left) in seen:
            continue
        seen.add((at, left))
        if at == len(trace) and left == P.TAU:
            return cost, len(trace) + cost - 2 * alone
        steps = [(cost + 1, alone + 1, at + 1, left)] if at < len(trace) else []
        for name, rest in first_moves(left):
            steps.append((cost + (name is not None), alone, at, rest))
            if at < len(trace) and trace[at] == name:
                steps.append((cost, alone, at + 1, rest))
        for c, s, i, rest in steps:
            order -= 1
            heapq.heappush(open_, (c, s, -i, order, rest))
    raise AssertionError("a tree has a word")


def random_tree(rng, depth):
    if not depth or rng.random() < 0.2:
        return P.TAU if rng.random() < 0.2 else ("act", rng.choice("abcd"))
    kind = rng.choice(["seq", "xor", "par", "loop"])
    return (kind, *[random_tree(rng, depth - 1) for _ in range(rng.randint(2, 3))])


@pytest.mark.parametrize("dense", [automaton.DENSE_STATES, 0])
def test_alignments_by_automaton_equal_the_search(monkeypatch, dense):
    monkeypatch.setattr(automaton, "DENSE_STATES", dense)
    rng = random.Random(31)
    for _ in range(120):
        tree = random_tree(rng, rng.randint(1, 3))
        aligner = automaton.Aligner(automaton.compiled(tree))
        for _ in range(6):  # one aligner for all: what traces share is kept
            trace = tuple(rng.choices("abcdx", k=rng.randint(0, 7)))
            assert aligner.align(trace) == searched(trace, tree), (trace, tree)


def test_automata_are_small():
    states = lambda tree: len(automaton.compiled(tree).moves)
    acts = [("act", f"step {i}") for i in range(10)]
    assert states(("loop", ("xor", *acts), P.TAU)) == 2 and states(("par", *acts[:6])) == 64 and states(("seq", *acts)) == 11
    assert automaton.Aligner(automaton.compiled(("par", *acts))).align(tuple(f"step {9 - i}" for i in range(9))) == (1, 10)
    with pytest.raises(automaton.TooManyStates):
        automaton.compiled(("par", *[("act", f"step {i}") for i in range(14)]))


def test_tree_alignment_takes_the_whole_language():
    tree = ("seq", ("act", "a"), ("par", ("act", "b"), ("xor", P.TAU, ("act", "c"))), ("loop", ("act", "d"), ("act", "e")))
    words = P.language(tree, loops=4)
    for trace in [("a", "c", "b", "d"), ("a", "d"), ("b", "x", "d", "e", "d"), (), ("a", "b", "d", "e", "d", "e", "e"), ("c", "b", "a", "d")]:
        cost, length = P.tree_alignment(trace, tree)
        best = min((P.alignment(trace, w)[0], -len(w)) for w in words)
        assert (cost, -length) == best, trace
    assert P.tree_alignment(("a", "b", *("d", "e") * 30, "d"), tree) == (0, 63)


def test_alignment_fitness_takes_every_variant(spark, sf):
    from tracework.operators import sequences as S
    from tracework.plans.sequences import alignment_fitness
    from tracework.session import table

    got = alignment_fitness(spark, sf).collect()
    traces = S.variants(S.collapsed(S.event_log(table(spark, sf, "events")))).agg({"n": "sum"}).first()[0]
    assert sum(r["n"] for r in got) == traces and any("error" in r["variant"] for r in got)
    fit = sum(r["n"] * r["fitness"] for r in got) / traces
    assert all(r["log_fitness"] == pytest.approx(fit, abs=1e-6) for r in got)
