"""State-machine fitting: walks -> steps -> transition counts, estimates, coverage and laws.

walks(walk, domain, i, state, action, ended_by); scheme(state, milestone, is_goal, source, ord) is a small dimension, the
projection of a hierarchy of states, states(state, parent, layer, is_goal, source, ord), to one of its layers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.operators import closure
from tracework.session import small

# fixed values: names of the start, of terminal states and of the closing actions
START, COMPLETED, DISRUPTED, UNRESOLVED = "(start)", "Completed", "Disrupted", "Unresolved"
STOP, DETECTED = "(stop)", "(detected)"
TERMINAL = [COMPLETED, DISRUPTED, UNRESOLVED]

#: Layers of a hierarchy from the coarsest to the finest.
LAYERS = ["milestone", "track", "source"]
#: States of a hierarchy that are followed on the driver.
MOST_STATES = 10_000


def ancestry(states: DataFrame, on_driver: int = MOST_STATES) -> DataFrame:
    """(state, ancestor, distance): each state with itself and all above it. A circle of parents is cut where it closes; of
    two parents the least counts. Up to on_driver states, a vocabulary, are followed on the driver, more on the cluster."""
    rows = states.select("state", "parent").limit(on_driver + 1).collect() if on_driver else []
    if not on_driver or len(rows) > on_driver:
        return closure.ancestors(states.select("state", "parent"))
    above, out = {}, []
    for r in rows:
        above[r["state"]] = min((p for p in (above.get(r["state"]), r["parent"]) if p is not None), default=None)
    for state in above:
        chain, seen = [state], {state}
        while (parent := above.get(chain[-1])) is not None and parent in above and parent not in seen:
            chain.append(parent)
            seen.add(parent)
        out += [(state, a, d) for d, a in enumerate(chain)]
    return states.sparkSession.createDataFrame(out, "state string, ancestor string, distance int")


def settled(states: DataFrame) -> DataFrame:
    """The states with is_goal and source from the nearest ancestor that says so, the state itself first; null if none
    does."""
    told = ancestry(states).join(small(states.select(F.col("state").alias("ancestor"), "is_goal", "source")), "ancestor")
    nearest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("distance"))).alias(c)
    return states.drop("is_goal", "source").join(small(told.groupBy("state").agg(nearest("is_goal"), nearest("source"))), "state")


def projected(states: DataFrame, layer: str) -> DataFrame:
    """scheme(state, milestone, is_goal, source, ord) at a layer: milestone is the nearest ancestor of that layer, the
    state itself first; a state of a coarser layer stands for itself, and one without such an ancestor has null. is_goal
    is that of the state stood for, ord the scheme's."""
    coarser = LAYERS[: LAYERS.index(layer)]
    every = settled(states)
    known = ancestry(states).join(small(every.select(F.col("state").alias("ancestor"), "layer", F.col("is_goal").alias("_goal"))), "ancestor")
    fits = known.where((F.col("layer") == layer) | ((F.col("distance") == 0) & F.col("layer").isin(coarser)))
    at = fits.groupBy("state").agg(F.min_by(F.struct(F.col("ancestor").alias("milestone"), F.coalesce("_goal", F.lit(False)).alias("is_goal")), "distance").alias("at"))
    return every.select("state", "source", "ord").join(at, "state", "left").select("state", "at.milestone", "at.is_goal", "source", "ord")


def in_scheme_order(rows: DataFrame, column: str, scheme: DataFrame) -> DataFrame:
    """rows with position, from 0 in the scheme's order; unknown states come last, by name."""
    known = rows.join(small(scheme.select(F.col("state").alias(column), F.col("ord").alias("_ord"))), column, "left")
    return known.withColumn("position", F.row_number().over(Window.orderBy(F.col("_ord").asc_nulls_last(), column)) - 1).drop("_ord")


def machine_states(stepped: DataFrame, scheme: DataFrame) -> DataFrame:
    """(state, position): the start, then all states left or entered, in the scheme's order; a vocabulary. scheme: its
    ord belongs to the names of the layer."""
    seen = stepped.select("state").unionByName(stepped.select(F.col("next").alias("state"))).where(~F.col("state").isin([START, *TERMINAL])).distinct()
    ordered = in_scheme_order(seen, "state", scheme).withColumn("position", F.col("position") + 1)
    return ordered.unionByName(stepped.sparkSession.createDataFrame([(START, 0)], "state string, position int"))


def machine_actions(stepped: DataFrame) -> DataFrame:
    """(action): all but stops and detections."""
    return stepped.select("action").where(~F.col("action").isin(STOP, DETECTED)).distinct()


def action_label(action: Column, means: Column | None = None) -> Column:
    """kind, or kind[m1+m2] with sorted distinct means."""
    if means is None:
        return action
    shown = F.array_join(F.array_sort(F.array_distinct(means)), "+")
    return F.when(F.size(means) > 0, F.concat(action, F.lit("["), shown, F.lit("]"))).otherwise(action)


def placed(walks: DataFrame, scheme: DataFrame) -> DataFrame:
    """Events with the milestone of their state (next); unplaced states dropped, and all from a terminal one on."""
    known = walks.join(small(scheme.select("state", F.col("milestone").alias("next"), "is_goal")), "state", "left")
    over = Window.partitionBy("walk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        known.where("next IS NOT NULL").withColumn("_t", F.max(F.col("next").isin(TERMINAL)).over(over)).where("NOT _t").drop("_t")
    )


def steps(walks: DataFrame, scheme: DataFrame) -> DataFrame:
    """(walk, domain, k, state, action, next): a step equal to the one before it counts once; each walk that has steps
    ends in a terminal state. Steps are at the act level; for the means level, give walks with_means."""
    in_walk = Window.partitionBy("walk").orderBy("i")
    events = placed(walks, scheme).withColumn("at", F.coalesce(F.lag("next").over(in_walk), F.lit(START)))
    this, last = F.struct("at", "action", "next"), F.lag(F.struct("at", "action", "next")).over(in_walk)
    kept = events.withColumn("_same", F.coalesce(this == last, F.lit(False))).where("NOT _same")
    ordinary = kept.select("walk", "domain", "i", F.col("at").alias("state"), "action", "next")
    ends = events.groupBy("walk", "domain", "ended_by").agg(F.max_by("next", "i").alias("state"), F.max("is_goal").alias("reached"), (F.max("i") + 1).alias("i"))
    detected = F.col("ended_by") == DETECTED
    closing = ends.select(
        "walk", "domain", "i", "state", F.when(detected, DETECTED).otherwise(STOP).alias("action"),
        F.when(F.col("reached"), COMPLETED).when(detected, DISRUPTED).otherwise(UNRESOLVED).alias("next"),
    )
    every = ordinary.unionByName(closing)
    return every.withColumn("k", F.row_number().over(in_walk) - 1).drop("i")


def with_means(walks: DataFrame) -> DataFrame:
    """walks(..., action, means) whose actions name their means."""
    return walks.withColumn("action", action_label(F.col("action"), F.col("means")))


def outcomes(stepped: DataFrame) -> DataFrame:
    """(walk, state, action, next, by_detection): detection right after an act is that act's outcome, in place of its own."""
    w = Window.partitionBy("walk").orderBy("k")
    ahead = stepped.withColumn("_a", F.lead("action").over(w)).withColumn("_n", F.lead("next").over(w)).where(F.col("action") != DETECTED)
    detected = F.coalesce(F.col("_a") == DETECTED, F.lit(False))
    return ahead.select("walk", "state", "action", F.when(detected, F.col("_n")).otherwise(F.col("next")).alias("next"), detected.alias("by_detection"))


def counts(stepped: DataFrame) -> DataFrame:
    """(state, action, next, by_detection, n)."""
    return outcomes(stepped).groupBy("state", "action", "next", "by_detection").agg(F.count(F.lit(1)).alias("n"))


def taken(stepped: DataFrame) -> DataFrame:
    """(state, action, n, share): how often each action was taken, detection left out but stops included."""
    by = stepped.where(F.col("action") != DETECTED).groupBy("state", "action").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def action_space(stepped: DataFrame, min_count: int = 5, min_share: float = 0.01) -> DataFrame:
    """(state, action): taken often enough, and the stop in every state."""
    often = taken(stepped).where((F.col("action") != STOP) & (F.col("n") >= min_count) & (F.col("share") >= min_share)).select("state", "action")
    return often.unionByName(stepped.select("state").distinct().withColumn("action", F.lit(STOP)))


def transition(stepped: DataFrame) -> DataFrame:
    """T(next | state, action) with the mass of detection folded into one outcome, as (state, action, next, p)."""
    told = counts(stepped).where(F.col("action") != STOP).withColumn("next", F.when(F.col("by_detection"), DETECTED).otherwise(F.col("next")))
    stops = counts(stepped).where(F.col("action") == STOP)
    by = told.unionByName(stops).groupBy("state", "action", "next").agg(F.sum("n").alias("n"))
    return by.select("state", "action", "next", (F.col("n") / F.sum("n").over(Window.partitionBy("state", "action"))).alias("p"))


def detected_after_goal(stepped: DataFrame) -> DataFrame:
    """(state, action, share): of the detections after an act, those that came after the goal."""
    return counts(stepped).where("by_detection").groupBy("state", "action").agg(
        (F.sum(F.when(F.col("next") == COMPLETED, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")
    )


def estimates(stepped: DataFrame, minimum: int = 1) -> DataFrame:
    """(state, action, next, times, of, probability) of acts seen `minimum` times or more."""
    by = counts(stepped).where(F.col("action") != STOP).groupBy("state", "action", "next").agg(F.sum("n").alias("times"))
    every = by.withColumn("of", F.sum("times").over(Window.partitionBy("state", "action"))).where(F.col("of") >= minimum)
    return every.withColumn("probability", F.col("times") / F.col("of"))


def machine_summary(stepped: DataFrame) -> DataFrame:
    """(trajectories, actions, state_action_pairs, steps, completed, disrupted, unresolved)."""
    ends = lambda t: F.count_if(F.col("next") == t)
    acts = ~F.col("action").isin(STOP, DETECTED)
    return stepped.agg(
        F.countDistinct("walk").alias("trajectories"), F.countDistinct(F.when(acts, F.col("action"))).alias("actions"),
        F.countDistinct(F.when(acts, F.struct("state", "action"))).alias("state_action_pairs"), F.count_if(F.col("action") != DETECTED).alias("steps"),
        ends(COMPLETED).alias("completed"), ends(DISRUPTED).alias("disrupted"), ends(UNRESOLVED).alias("unresolved"),
    )


def walk_paths(stepped: DataFrame) -> DataFrame:
    """(walk, domain, path): states entered, runs collapsed, with the terminal state."""
    w = Window.partitionBy("walk").orderBy("k")
    kept = stepped.withColumn("_b", F.lag("next").over(w)).where("_b IS NULL OR _b <> next")
    steps_ = F.array_sort(F.collect_list(F.struct("k", "next")))
    return kept.groupBy("walk", "domain").agg(F.transform(steps_, lambda s: s["next"]).alias("path"))


def enough(paths: DataFrame, minimum: int) -> DataFrame:
    """Paths of domains with `minimum` walks or more."""
    sizes = paths.groupBy("domain").agg(F.count(F.lit(1)).alias("walks")).where(F.col("walks") >= minimum)
    return paths.join(sizes, "domain")


def coverage(paths: DataFrame, minimum: int = 25) -> DataFrame:
    """(domain, state, share): walks of a domain that enter a state."""
    kept = enough(paths, minimum)
    entered = kept.select("domain", "walks", F.explode(F.array_distinct("path")).alias("state")).where(~F.col("state").isin(TERMINAL))
    return entered.groupBy("domain", "walks", "state").agg(F.count(F.lit(1)).alias("n")).select("domain", "state", (F.col("n") / F.col("walks")).alias("share"))


def backbone(paths: DataFrame, thresholds: list[float], minimum: int = 25) -> DataFrame:
    """(threshold, state): states that every domain covers to a threshold."""
    domains = enough(paths, minimum).agg(F.countDistinct("domain").alias("domains"))
    least = coverage(paths, minimum).groupBy("state").agg(F.min("share").alias("least"), F.count(F.lit(1)).alias("n"))
    held = least.join(F.broadcast(domains), F.col("n") == F.col("domains"))
    return held.select("state", "least", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("least >= threshold").select("threshold", "state")


def end_mix(paths: DataFrame, minimum: int = 25) -> DataFrame:
    by = enough(paths, minimum).groupBy("domain", "walks", F.element_at("path", -1).alias("end")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("domain", "end", (F.col("n") / F.col("walks")).alias("share"))


def laws(paths: DataFrame, roles: dict[str, str], minimum: int = 15) -> DataFrame:
    """Conditional shares over the walks that reach the goal, by domain. roles names the scheme's states: goal and any of
    contact, conditioning, maintenance and exit; a law whose role is missing is left out."""
    goal = roles["goal"]
    first = F.array_position("path", goal).cast("int")
    reached = paths.where(F.array_contains("path", goal)).withColumn("_before", F.slice("path", 1, first - 1)).withColumn("_on", F.slice("path", first, F.size("path")))
    held = {role: F.array_contains("_before" if role in ("contact", "conditioning") else "_on", state) for role, state in roles.items() if role != "goal"}
    told = {"contact_primacy": held.get("contact"), "conditioning_before_goal": held.get("conditioning")}
    if "contact" in held and "conditioning" in held:
        told["full_backbone_before_goal"] = held["contact"] & held["conditioning"]
    told |= {"maintenance_after_goal": held.get("maintenance"), "goal_reentered": F.size(F.filter("path", lambda s: s == goal)) > 1, "exit_after_goal": held.get("exit")}
    shares = [F.avg(test.cast("double")).alias(name) for name, test in told.items() if test is not None]
    return reached.groupBy("domain").agg(F.count(F.lit(1)).alias("reaching_goal"), *shares).where(F.col("reaching_goal") >= minimum)


def avoidance(paths: DataFrame, state: str, minimum: int = 25) -> DataFrame:
    """(domain, walks, share): completed walks that never enter a state."""
    done = paths.where(F.element_at("path", -1) == COMPLETED)
    return done.groupBy("domain").agg(F.count(F.lit(1)).alias("walks"), F.avg((~F.array_contains("path", state)).cast("double")).alias("share")).where(F.col("walks") >= minimum)


def predicate(walks: DataFrame, scheme: DataFrame) -> DataFrame:
    """(walk, domain, said): what the goal states that a walk reached say about the source. For a hierarchy, give the
    states settled."""
    known = walks.join(small(scheme.select("state", "is_goal", "source")), "state", "left")
    goal = F.coalesce("is_goal", F.lit(False))
    flags = known.groupBy("walk", "domain").agg(
        F.count_if(goal).alias("goals"), F.count_if(goal & F.coalesce("source", F.lit(False))).alias("yes"), F.count_if(goal & ~F.coalesce("source", F.lit(True))).alias("no")
    )
    said = F.when(F.col("goals") == 0, "not_reached").when(F.col("yes") > 0, "passes").when(F.col("no") == F.col("goals"), "fails").otherwise("unspecified")
    return flags.select("walk", "domain", said.alias("said"))


def predicate_mix(walks: DataFrame, scheme: DataFrame, minimum: int = 15) -> DataFrame:
    """(domain, said, share, trajectories) of domains with `minimum` walks or more."""
    by = predicate(walks, scheme).groupBy("domain", "said").agg(F.count(F.lit(1)).alias("n"))
    every = by.withColumn("trajectories", F.sum("n").over(Window.partitionBy("domain"))).where(F.col("trajectories") >= minimum)
    return every.select("domain", "said", (F.col("n") / F.col("trajectories")).alias("share"), "trajectories")


def unplaced(walks: DataFrame, scheme: DataFrame) -> DataFrame:
    known = walks.join(small(scheme.select("state", "milestone")), "state", "left")
    return known.groupBy("domain").agg(F.count_if(F.col("milestone").isNull()).alias("unplaced"))


def tracks(walks: DataFrame, scheme: DataFrame, minimum: int = 25) -> DataFrame:
    """(domain, milestone, state, share): how each milestone was reached, over the walks that reached it."""
    known = walks.join(small(scheme.select("state", "milestone")), "state").where("milestone IS NOT NULL").select("walk", "domain", "milestone", "state").distinct()
    sizes = walks.select("domain", "walk").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("walks")).where(F.col("walks") >= minimum)
    holding = known.select("walk", "domain", "milestone").distinct().groupBy("domain", "milestone").agg(F.count(F.lit(1)).alias("holding"))
    by = known.groupBy("domain", "milestone", "state").agg(F.count(F.lit(1)).alias("n"))
    return by.join(holding, ["domain", "milestone"]).join(sizes, "domain").select("domain", "milestone", "state", (F.col("n") / F.col("holding")).alias("share"))


def hierarchy_tracks(paths: DataFrame, states: DataFrame, minimum: int = 25) -> DataFrame:
    """(domain, milestone, state, share) of paths at the track layer: of the walks of a domain that hold a milestone or a
    track right below it, the share that holds each of these. Milestones without tracks are left out."""
    below = states.where("layer = 'track' AND parent IS NOT NULL").select(F.col("parent").alias("milestone"), "state")
    milestones = states.where("layer = 'milestone'").select(F.col("state").alias("milestone")).join(below.select("milestone").distinct(), "milestone", "left_semi")
    members = below.join(milestones, "milestone", "left_semi").unionByName(milestones.select("milestone", F.col("milestone").alias("state")))
    held = enough(paths, minimum).select("walk", "domain", F.explode(F.array_distinct("path")).alias("state")).join(small(members), "state")
    holding = held.groupBy("domain", "milestone").agg(F.countDistinct("walk").alias("holding"))
    by = held.groupBy("domain", "milestone", "state").agg(F.count(F.lit(1)).alias("n"))
    return by.join(holding, ["domain", "milestone"]).select("domain", "milestone", "state", (F.col("n") / F.col("holding")).alias("share"))


def from_start(stepped: DataFrame, first: list[str]) -> DataFrame:
    """Steps of the walks whose telling begins at one of the first milestones."""
    began = stepped.where((F.col("k") == 0) & F.col("next").isin(first)).select("walk")
    return stepped.join(began, "walk", "left_semi")


def models(walks: DataFrame, states: DataFrame, layers: list[str], minimum: int = 15) -> DataFrame:
    """(layer, domain, state, action, next, by_detection, n): a fitted machine for each layer, and each domain that has
    `minimum` walks or more."""
    sizes = walks.select("domain", "walk").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum).select("domain")
    kept, found = walks.join(sizes, "domain", "left_semi"), None
    for layer in layers:
        stepped = steps(kept, projected(states, layer))
        of = stepped.select("walk", "domain").distinct()
        part = outcomes(stepped).join(of, "walk").groupBy("domain", "state", "action", "next", "by_detection").agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(layer))
        found = part if found is None else found.unionByName(part)
    return found.select("layer", "domain", "state", "action", "next", "by_detection", "n")


def record_graphs(records: DataFrame, build: Callable[[dict], str | None], key: str = "record_id") -> DataFrame:
    """(key, graph, error, outcome): what build makes of each row, given as a dict; an exception is a row of its own and
    the others go on. None is skipped."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    graph, error = build(row), None
                except Exception as e:  # reported as the record's outcome
                    graph, error = None, f"{type(e).__name__}: {e}"
                out.append((row[key], graph, error, "error" if error else "skipped" if graph is None else "written"))
            import pandas as pd

            yield pd.DataFrame(out, columns=[key, "graph", "error", "outcome"])

    return records.mapInPandas(run, f"`{key}` {kind}, graph string, error string, outcome string")
