"""Queries on walks: what a user did on a day, placed in a small scheme of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework.operators import decision
from tracework.operators import machine as M
from tracework.operators import sequences as S
from tracework.plans.registry import query
from tracework.plans.sequences import LOG, log
from tracework.session import table

#: state, milestone, is_goal, source, ord: the scheme, a fixed vocabulary. Errors have no milestone.
SCHEME = [("view", "Contact", False, None, 1), ("click", "Conditioning", False, None, 2), ("signup", "Conditioning", False, None, 3), ("purchase", "Goal", True, True, 4)]
_lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
SCHEME_ROWS = ", ".join("(" + ", ".join(map(_lit, row)) + ")" for row in SCHEME)

def walk_sql(scheme_rows: str, state: str = "activity", action: str = "activity") -> str:
    """Tables of walks with a scheme: steps, outcomes, counts, taken, paths, sized, covered."""
    return LOG + f""",
scheme(state, milestone, is_goal, source, ord) AS (VALUES {scheme_rows}),
ends AS (SELECT trace AS walk, CASE WHEN arg_max(activity, (ts, event_id)) = 'error' THEN '(detected)' ELSE '(stop)' END AS ended_by FROM log GROUP BY 1),
walks AS (SELECT trace AS walk, user_id % 4 AS domain, position AS i, {state} AS state, {action} AS action, ended_by FROM lagged JOIN ends ON walk = trace),
placed AS (SELECT walk, domain, i, action, ended_by, milestone AS next, is_goal, coalesce(lag(milestone) OVER (PARTITION BY walk ORDER BY i), '(start)') AS here FROM walks JOIN scheme USING (state)),
kept AS (SELECT * FROM (SELECT *, lag((here, action, next)) OVER (PARTITION BY walk ORDER BY i) AS last FROM placed) WHERE last IS NULL OR last <> (here, action, next)),
closing AS (SELECT walk, domain, max(i) + 1 AS i, arg_max(next, i) AS state, ended_by AS action, CASE WHEN bool_or(is_goal) THEN 'Completed' WHEN ended_by = '(detected)' THEN 'Disrupted' ELSE 'Unresolved' END AS next FROM placed GROUP BY walk, domain, ended_by),
steps AS (SELECT walk, domain, state, action, next, row_number() OVER (PARTITION BY walk ORDER BY i) - 1 AS k FROM (SELECT walk, domain, i, here AS state, action, next FROM kept UNION ALL SELECT * FROM closing)),
outcomes AS (SELECT walk, state, action, CASE WHEN a = '(detected)' THEN nn ELSE next END AS next, coalesce(a = '(detected)', false) AS by_detection FROM
  (SELECT *, lead(action) OVER (PARTITION BY walk ORDER BY k) AS a, lead(next) OVER (PARTITION BY walk ORDER BY k) AS nn FROM steps) WHERE action <> '(detected)'),
counts AS (SELECT state, action, next, by_detection, count(*) AS n FROM outcomes GROUP BY ALL),
taken AS (SELECT state, action, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY state) AS share FROM steps WHERE action <> '(detected)' GROUP BY 1, 2),
runs AS (SELECT * FROM (SELECT *, lag(next) OVER (PARTITION BY walk ORDER BY k) AS b FROM steps) WHERE b IS NULL OR b <> next),
paths AS (SELECT walk, domain, list(next ORDER BY k) AS path FROM runs GROUP BY 1, 2),
sized AS (SELECT *, count(*) OVER (PARTITION BY domain) AS walks FROM paths),
covered AS (SELECT domain, s AS state, count(*) / any_value(walks) AS share FROM (SELECT domain, walks, unnest(list_distinct(path)) AS s FROM sized WHERE walks >= 25) WHERE s NOT IN ('Completed', 'Disrupted', 'Unresolved') GROUP BY 1, 2)"""


WALKS = walk_sql(SCHEME_ROWS)

def scheme(spark):
    return spark.createDataFrame(SCHEME, "state string, milestone string, is_goal boolean, source boolean, ord int")


def walks(spark, sf):
    events = S.positions(log(spark, sf))
    last = events.groupBy("trace").agg(F.max_by("activity", F.struct("ts", "event_id")).alias("last"))
    return events.join(last, "trace").select(
        F.col("trace").alias("walk"), (F.col("user_id") % 4).alias("domain"), F.col("position").alias("i"), F.col("activity").alias("state"), F.col("activity").alias("action"),
        F.when(F.col("last") == "error", M.DETECTED).otherwise(M.STOP).alias("ended_by"),
    )


def stepped(spark, sf):
    return M.steps(walks(spark, sf), scheme(spark))


def walked(spark, sf):
    return M.walk_paths(stepped(spark, sf))


@query(f"WITH {WALKS} SELECT walk, k, state, action, next FROM steps")
def machine_steps(spark, sf):
    return stepped(spark, sf).select("walk", F.col("k").cast("long").alias("k"), "state", "action", "next")


@query(f"WITH {WALKS} SELECT * FROM counts")
def machine_counts(spark, sf):
    return M.counts(stepped(spark, sf))


@query(f"WITH {WALKS} SELECT state, action, n, round(share, 4) AS share FROM taken")
def policy(spark, sf):
    return M.taken(stepped(spark, sf)).withColumn("share", F.round("share", 4))


@query(f"WITH {WALKS} SELECT state, action FROM taken WHERE action <> '(stop)' AND n >= 5 AND share >= 0.01 UNION ALL SELECT DISTINCT state, '(stop)' FROM steps")
def action_space(spark, sf):
    return M.action_space(stepped(spark, sf))


@query(f"""WITH {WALKS}, o AS (SELECT state, action, CASE WHEN action <> '(stop)' AND by_detection THEN '(detected)' ELSE next END AS next, sum(n) AS n FROM counts GROUP BY 1, 2, 3)
SELECT state, action, next, round(n / sum(n) OVER (PARTITION BY state, action), 6) AS p FROM o""")
def transition(spark, sf):
    return M.transition(stepped(spark, sf)).withColumn("p", F.round("p", 6))


@query(f"WITH {WALKS} SELECT state, action, round(sum(CASE WHEN next = 'Completed' THEN n ELSE 0 END) / sum(n), 6) AS share FROM counts WHERE by_detection GROUP BY 1, 2")
def machine_detection(spark, sf):
    return M.detected_after_goal(stepped(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"""WITH {WALKS}, b AS (SELECT state, action, next, CAST(sum(n) AS BIGINT) AS times FROM counts WHERE action <> '(stop)' GROUP BY 1, 2, 3)
SELECT state, action, next, times, CAST(sum(times) OVER (PARTITION BY state, action) AS BIGINT) AS "of", round(times / sum(times) OVER (PARTITION BY state, action), 4) AS probability FROM b""")
def machine_estimates(spark, sf):
    return M.estimates(stepped(spark, sf)).withColumn("probability", F.round("probability", 4))


@query(f"""WITH {WALKS} SELECT count(DISTINCT walk) AS trajectories, count(DISTINCT action) FILTER (action NOT LIKE '(%') AS actions,
count(DISTINCT (state, action)) FILTER (action NOT LIKE '(%') AS state_action_pairs, count(*) FILTER (action <> '(detected)') AS steps,
count(*) FILTER (next = 'Completed') AS completed, count(*) FILTER (next = 'Disrupted') AS disrupted, count(*) FILTER (next = 'Unresolved') AS unresolved FROM steps""")
def machine_summary(spark, sf):
    return M.machine_summary(stepped(spark, sf))


@query(f"WITH {WALKS} SELECT walk, array_to_string(path, '>') AS path FROM paths")
def walk_paths(spark, sf):
    return walked(spark, sf).select("walk", F.array_join("path", ">").alias("path"))


@query(f"WITH {WALKS} SELECT domain, state, round(share, 4) AS share FROM covered")
def state_coverage(spark, sf):
    return M.coverage(walked(spark, sf)).withColumn("share", F.round("share", 4))


@query(f"""WITH {WALKS}, l AS (SELECT state, min(share) AS least FROM covered GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT domain) FROM sized WHERE walks >= 25))
SELECT CAST(t AS DOUBLE) AS threshold, state FROM l, (SELECT unnest([0.9, 0.75, 0.5, 0.25, 0.1]) AS t) WHERE least >= t""")
def backbone(spark, sf):
    return M.backbone(walked(spark, sf), [0.9, 0.75, 0.5, 0.25, 0.1])


@query(f"WITH {WALKS} SELECT domain, path[-1] AS \"end\", round(count(*) / any_value(walks), 4) AS share FROM sized WHERE walks >= 25 GROUP BY 1, 2")
def end_mix(spark, sf):
    return M.end_mix(walked(spark, sf)).withColumn("share", F.round("share", 4))


#: The scheme has no states of its own for what comes after the goal, so these roles name the two that may.
ROLES = {"goal": "Goal", "contact": "Contact", "conditioning": "Conditioning", "maintenance": "Conditioning", "exit": "Contact"}


@query(f"""WITH {WALKS}, r AS (SELECT domain, path, path[1:list_position(path, 'Goal') - 1] AS b, path[list_position(path, 'Goal'):] AS a FROM paths WHERE list_contains(path, 'Goal'))
SELECT domain, count(*) AS reaching_goal, round(avg(list_contains(b, 'Contact')::INT), 4) AS contact_primacy, round(avg(list_contains(b, 'Conditioning')::INT), 4) AS conditioning_before_goal,
round(avg((list_contains(b, 'Contact') AND list_contains(b, 'Conditioning'))::INT), 4) AS full_backbone_before_goal, round(avg(list_contains(a, 'Conditioning')::INT), 4) AS maintenance_after_goal,
round(avg(list_contains(a, 'Contact')::INT), 4) AS exit_after_goal, round(avg((len(list_filter(path, lambda x: x = 'Goal')) > 1)::INT), 4) AS goal_reentered
FROM r GROUP BY 1 HAVING count(*) >= 15""")
def laws(spark, sf):
    found = M.laws(walked(spark, sf), ROLES)
    return found.select("domain", "reaching_goal", *[F.round(c, 4).alias(c) for c in found.columns[2:]])


@query(f"WITH {WALKS} SELECT domain, count(*) AS walks, round(avg((NOT list_contains(path, 'Contact'))::INT), 4) AS share FROM paths WHERE path[-1] = 'Completed' GROUP BY 1 HAVING count(*) >= 25")
def kappa(spark, sf):
    return M.avoidance(walked(spark, sf), "Contact").withColumn("share", F.round("share", 4))


@query(f"""WITH {WALKS}, s AS (SELECT walk, domain, CASE WHEN bool_or(coalesce(is_goal, false)) THEN 'passes' ELSE 'not_reached' END AS said FROM walks LEFT JOIN scheme USING (state) GROUP BY 1, 2),
n AS (SELECT domain, said, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY domain) AS BIGINT) AS trajectories FROM s GROUP BY 1, 2) SELECT domain, said, round(n / trajectories, 4) AS share, trajectories FROM n WHERE trajectories >= 15""")
def predicate_mix(spark, sf):
    return M.predicate_mix(walks(spark, sf), scheme(spark)).withColumn("share", F.round("share", 4))


@query(f"WITH {WALKS} SELECT domain, count(*) FILTER (milestone IS NULL) AS unplaced FROM walks LEFT JOIN scheme USING (state) GROUP BY 1")
def unplaced(spark, sf):
    return M.unplaced(walks(spark, sf), scheme(spark))


@query(f"""WITH {WALKS}, k AS (SELECT DISTINCT walk, domain, milestone, state FROM walks JOIN scheme USING (state)),
h AS (SELECT domain, milestone, count(DISTINCT walk) AS holding FROM k GROUP BY 1, 2), s AS (SELECT domain FROM walks GROUP BY 1 HAVING count(DISTINCT walk) >= 25)
SELECT k.domain, k.milestone, state, round(count(*) / any_value(holding), 4) AS share FROM k JOIN h USING (domain, milestone) JOIN s ON s.domain = k.domain GROUP BY 1, 2, 3""")
def tracks(spark, sf):
    return M.tracks(walks(spark, sf), scheme(spark)).withColumn("share", F.round("share", 4))


@query(f"""WITH {WALKS}, e AS (SELECT state, next, count(*) / (SELECT count(DISTINCT walk) FROM steps) AS w FROM steps GROUP BY 1, 2) SELECT state AS src, next AS dst, round(w, 6) AS w FROM e""")
def state_matrix(spark, sf):
    return _matrix(spark, sf).withColumn("w", F.round("w", 6))


def _matrix(spark, sf):
    steps = stepped(spark, sf)
    n = steps.agg(F.countDistinct("walk").alias("walks"))
    by = steps.groupBy(F.col("state").alias("src"), F.col("next").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(n), F.lit(True)).select("src", "dst", (F.col("n") / F.col("walks")).alias("w"))


#: A hierarchy, a fixed vocabulary: state, parent, layer, is_goal, source, ord. Sign-ups are told at the milestone itself.
STATES = [
    ("Contact", None, "milestone", None, None, 1), ("Look", "Contact", "track", None, None, 2), ("view", "Look", "source", None, None, 3),
    ("Conditioning", None, "milestone", None, None, 4), ("Try", "Conditioning", "track", None, None, 5), ("click", "Try", "source", None, None, 6),
    ("Goal", None, "milestone", True, None, 7), ("Buy", "Goal", "track", None, True, 8), ("purchase", "Buy", "source", None, None, 9),
]
STATE_ROWS = ", ".join("(" + ", ".join(map(_lit, row)) + ")" for row in STATES)
TOLD = "CASE activity WHEN 'signup' THEN 'Conditioning' ELSE activity END"
#: The hierarchy at each layer, worked out by hand: what each state stands for, and whether that is a goal.
AT_MILESTONES = "('Contact','Contact',false,NULL,1), ('Look','Contact',false,NULL,2), ('view','Contact',false,NULL,3), ('Conditioning','Conditioning',false,NULL,4), ('Try','Conditioning',false,NULL,5), ('click','Conditioning',false,NULL,6), ('Goal','Goal',true,NULL,7), ('Buy','Goal',true,true,8), ('purchase','Goal',true,true,9)"
AT_TRACKS = "('Contact','Contact',false,NULL,1), ('Look','Look',false,NULL,2), ('view','Look',false,NULL,3), ('Conditioning','Conditioning',false,NULL,4), ('Try','Try',false,NULL,5), ('click','Try',false,NULL,6), ('Goal','Goal',true,NULL,7), ('Buy','Buy',true,true,8), ('purchase','Buy',true,true,9)"
TRACK_WALKS = walk_sql(AT_TRACKS, TOLD)


def states(spark):
    return spark.createDataFrame(STATES, "state string, parent string, layer string, is_goal boolean, source boolean, ord int")


def told_walks(spark, sf):
    return walks(spark, sf).withColumn("state", F.when(F.col("state") == "signup", "Conditioning").otherwise(F.col("state")))


@query(f"""WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 'Conditioning' ELSE event_type END AS state, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT 'milestone' AS layer, * FROM (VALUES {AT_MILESTONES}) AS t(state, milestone, is_goal, source, ord) UNION ALL SELECT 'track', * FROM (VALUES {AT_TRACKS}) AS t(state, milestone, is_goal, source, ord))
SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN e USING (state)""")
def projected_scheme(spark, sf):
    """The layers' schemes, with the events that stand at each state."""
    one, other = (M.projected(states(spark), layer).select(F.lit(layer).alias("layer"), "state", "milestone", "is_goal", "source", "ord") for layer in ("milestone", "track"))
    at = table(spark, sf, "events").groupBy(F.when(F.col("event_type") == "signup", "Conditioning").otherwise(F.col("event_type")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(other).join(at, "state", "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Customers below customers of half their number, these below nations, nations below regions; two regions name each other.
PLACES = """SELECT 'c' || c_custkey AS state, CASE WHEN c_custkey < 2 THEN 'n' || c_nationkey ELSE 'c' || (c_custkey // 2) END AS parent FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE r_regionkey WHEN 0 THEN 'r1' WHEN 1 THEN 'r0' ELSE 'none' END FROM region"""


@query(f"""WITH RECURSIVE st AS ({PLACES}), up(state, ancestor, distance, seen) AS (SELECT state, state, 0, [state] FROM st UNION ALL
SELECT up.state, st.parent, distance + 1, list_append(seen, st.parent) FROM up JOIN st ON st.state = up.ancestor WHERE st.parent IN (SELECT state FROM st) AND NOT list_contains(seen, st.parent)) SELECT state, ancestor, distance FROM up""")
def state_ancestry(spark, sf):
    """Ancestors in a hierarchy of all customers, nations and regions, with a circle, in rounds on the cluster."""
    text = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    half = F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2).cast("string"))
    rows = table(spark, sf, "customer").select(text("c", "c_custkey").alias("state"), F.when(F.col("c_custkey") < 2, text("n", "c_nationkey")).otherwise(half).alias("parent"))
    rows = rows.unionByName(table(spark, sf, "nation").select(text("n", "n_nationkey").alias("state"), text("r", "n_regionkey").alias("parent")))
    circle = F.when(F.col("r_regionkey") == 0, "r1").when(F.col("r_regionkey") == 1, "r0").otherwise("none")
    return M.ancestry(rows.unionByName(table(spark, sf, "region").select(text("r", "r_regionkey").alias("state"), circle.alias("parent"))), on_driver=0)


@query(f"""WITH {TRACK_WALKS}, st(state, parent, layer, is_goal, source, ord) AS (VALUES {STATE_ROWS}), seen AS (SELECT state FROM steps UNION SELECT next FROM steps)
SELECT '(start)' AS state, 0 AS position UNION ALL SELECT seen.state, row_number() OVER (ORDER BY ord NULLS LAST, seen.state) FROM seen LEFT JOIN st ON st.state = seen.state WHERE seen.state NOT IN ('(start)', 'Completed', 'Disrupted', 'Unresolved')""")
def track_states(spark, sf):
    return M.machine_states(M.steps(told_walks(spark, sf), M.projected(states(spark), "track")), states(spark))


@query(f"WITH {TRACK_WALKS} SELECT DISTINCT action FROM steps WHERE action NOT IN ('(stop)', '(detected)')")
def track_actions(spark, sf):
    return M.machine_actions(M.steps(told_walks(spark, sf), M.projected(states(spark), "track")))


MEANS = "activity || '[' || CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END || ']'"
MEANS_WALKS = walk_sql(SCHEME_ROWS, action="meant").replace("event_type AS activity FROM events)", f"event_type AS activity, {MEANS.replace('activity', 'event_type')} AS meant FROM events)")


@query(f"WITH {MEANS_WALKS} SELECT * FROM counts")
def means_counts(spark, sf):
    """The machine at the means level: an act with what its event names."""
    odd = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "even").otherwise("odd")
    named = table(spark, sf, "events").select("event_id", F.array(odd, odd).alias("means"))
    rows = S.positions(log(spark, sf)).select(F.col("trace").alias("walk"), F.col("position").alias("i"), "event_id").join(named, "event_id")
    return M.counts(M.steps(M.with_means(walks(spark, sf).join(rows.select("walk", "i", "means"), ["walk", "i"])), scheme(spark)))


@query(f"""WITH {TRACK_WALKS}, m(milestone, state) AS (VALUES ('Contact','Look'), ('Contact','Contact'), ('Conditioning','Try'), ('Conditioning','Conditioning'), ('Goal','Buy'), ('Goal','Goal')),
k AS (SELECT walk, domain, unnest(list_distinct(path)) AS state FROM sized WHERE walks >= 25), g AS (SELECT * FROM k JOIN m USING (state)), h AS (SELECT domain, milestone, count(DISTINCT walk) AS holding FROM g GROUP BY 1, 2)
SELECT domain, milestone, state, round(count(*) / any_value(holding), 4) AS share FROM g JOIN h USING (domain, milestone) GROUP BY 1, 2, 3""")
def milestone_tracks(spark, sf):
    paths = M.walk_paths(M.steps(told_walks(spark, sf), M.projected(states(spark), "track")))
    return M.hierarchy_tracks(paths, states(spark)).withColumn("share", F.round("share", 4))


def _models_sql(scheme_rows: str, layer: str) -> str:
    return f"""(WITH {walk_sql(scheme_rows, TOLD)}, d AS (SELECT DISTINCT walk, domain FROM walks), big AS (SELECT domain FROM d GROUP BY 1 HAVING count(*) >= 15)
SELECT '{layer}' AS layer, domain, state, action, next, by_detection, count(*) AS n FROM outcomes JOIN d USING (walk) JOIN big USING (domain) GROUP BY ALL)"""


@query(_models_sql(AT_MILESTONES, "milestone") + " UNION ALL " + _models_sql(AT_TRACKS, "track"))
def layer_models(spark, sf):
    return M.models(told_walks(spark, sf), states(spark), ["milestone", "track"])


@query(f"WITH {WALKS}, b AS (SELECT walk FROM steps WHERE k = 0 AND next = 'Contact') SELECT state, action, next, count(*) AS n FROM steps JOIN b USING (walk) GROUP BY ALL")
def steps_from_start(spark, sf):
    return M.from_start(stepped(spark, sf), ["Contact"]).groupBy("state", "action", "next").agg(F.count(F.lit(1)).alias("n"))


def _graph_of(row: dict) -> str | None:
    if row["domain"] == 3:
        raise ValueError("no graph for domain 3")
    return None if row["n"] < 3 else f"walk of {row['n']}"


@query("""WITH w AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS walk, user_id % 4 AS domain, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CASE WHEN domain = 3 THEN 'error' WHEN n < 3 THEN 'skipped' ELSE 'written' END AS outcome, count(*) AS n, max(CASE WHEN domain = 3 THEN 'ValueError: no graph for domain 3' END) AS error FROM w GROUP BY 1""")
def graph_outcomes(spark, sf):
    """A record that fails is a row with its error; the others go on."""
    rows = walks(spark, sf).groupBy("walk", "domain").agg(F.count(F.lit(1)).alias("n"))
    return M.record_graphs(rows, _graph_of, "walk").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error"))


REWARDS = {"Goal": 10.0}
GAMMA, ROUNDS = 0.9, 64
EDGES = f"""{WALKS}, e AS (SELECT state AS src, next AS dst, count(*) / (SELECT count(DISTINCT walk) FROM steps) AS w FROM steps GROUP BY 1, 2)"""
_REWARD = "CAST(CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REWARDS.items()) + " ELSE 0.0 END AS DOUBLE)"


def values_sql(name: str, edges: str) -> str:
    """Tables of a value iteration over edges(src, dst, w): {name}_v(s, v) and {name}_best(src, dst). An edge of weight 0
    from each state to itself stands for its reward."""
    names = "".join(f" UNION SELECT '{k}'" for k in REWARDS)
    return f"""{name}_p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM {edges} WHERE w > 0),
{name}_s AS (SELECT s, {_REWARD} AS r FROM (SELECT src AS s FROM {edges} UNION SELECT dst FROM {edges}{names})),
{name}_q AS (SELECT src, dst, w FROM {name}_p UNION ALL SELECT s, s, 0.0 FROM {name}_s),
{name}_i(t, s, v) AS (SELECT 0, s, r FROM {name}_s UNION ALL SELECT x.t + 1, st.s, max(st.r + {GAMMA} * q.w * x.v) FROM {name}_s st JOIN {name}_q q ON q.src = st.s JOIN {name}_i x ON x.s = q.dst WHERE x.t < {ROUNDS} GROUP BY x.t, st.s),
{name}_v AS (SELECT s, v FROM {name}_i WHERE t = {ROUNDS}),
{name}_best AS (SELECT src, dst FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY round(p.w * v.v, 12) DESC, p.dst) AS k FROM {name}_p p JOIN {name}_v v ON v.s = p.dst) WHERE k = 1)"""


def rollout_sql(name: str, start: str) -> str:
    return f"""{name}_r(step, s, seen) AS (SELECT 0, '{start}', ['{start}'] UNION ALL SELECT step + 1, dst, list_append(seen, dst) FROM {name}_r JOIN {name}_best ON src = s WHERE NOT list_contains(seen, dst) AND step < 24)"""


def graph(spark, sf) -> decision.Graph:
    return decision.collect_graph(_matrix(spark, sf))


@query(f"WITH RECURSIVE {EDGES}, {values_sql('g', 'e')} SELECT s AS state, round(v, 6) AS value, dst AS best_next FROM g_v LEFT JOIN g_best ON src = s")
def value_iteration(spark, sf):
    found = decision.course(graph(spark, sf), M.START, REWARDS, gamma=GAMMA)
    return spark.createDataFrame([(s, round(v, 6), found.best[s]) for s, v in found.values.items()], "state string, value double, best_next string")


@query(f"WITH RECURSIVE {EDGES}, {values_sql('g', 'e')}, {rollout_sql('g', M.START)} SELECT CAST(step AS BIGINT) AS step, s AS state FROM g_r")
def greedy_rollout(spark, sf):
    return spark.createDataFrame(list(enumerate(decision.course(graph(spark, sf), M.START, REWARDS, gamma=GAMMA).path)), "step long, state string")


BLOCKED = ("Contact", "Conditioning")
_VALUE = "coalesce((SELECT v FROM {0}_v WHERE s = '(start)'), 0.0)"


@query(f"WITH RECURSIVE {EDGES}, {values_sql('g', 'e')}, " + ", ".join(f"x{i} AS (SELECT * FROM e WHERE src <> '{b}' AND dst <> '{b}'), {values_sql(f'b{i}', f'x{i}')}" for i, b in enumerate(BLOCKED))
       + " " + " UNION ALL ".join(f"SELECT '{b}' AS blocked, round({_VALUE.format('g')}, 6) AS before, round({_VALUE.format(f'b{i}')}, 6) AS after, round({_VALUE.format('g')} - {_VALUE.format(f'b{i}')}, 6) AS delta" for i, b in enumerate(BLOCKED)))
def intervention_delta(spark, sf):
    edges = graph(spark, sf)
    found = [decision.intervention(edges, M.START, REWARDS, s, gamma=GAMMA) for s in BLOCKED]
    return spark.createDataFrame([(x["blocked"], round(x["before"], 6), round(x["after"], 6), round(x["delta"], 6)) for x in found], "blocked string, before double, after double, delta double")


#: All paths without a state twice, and the strongest of them: fewest steps, then first by name.
STRONGEST = f"""{EDGES}, p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e),
r(s, path, ws, weight) AS (SELECT '(start)', ['(start)'], []::DOUBLE[], 1.0::DOUBLE UNION ALL SELECT dst, list_append(path, dst), list_append(ws, p.w), weight * p.w FROM r JOIN p ON src = s WHERE NOT list_contains(path, dst)),
best AS (SELECT * FROM r WHERE s = 'Completed' ORDER BY weight DESC, len(path), path LIMIT 1)"""


def strongest(spark, sf) -> dict:
    edges = S.normalised(_matrix(spark, sf), "w").withColumnRenamed("p", "w")
    return decision.strongest_path(decision.collect_graph(edges), M.START, M.COMPLETED)


@query(f"WITH RECURSIVE {STRONGEST} SELECT array_to_string(path, '>') AS path, round(weight, 6) AS weight FROM best")
def max_product_path(spark, sf):
    found = strongest(spark, sf)
    return spark.createDataFrame([(">".join(found["path"]), round(found["weight"], 6))], "path string, weight double")


@query(f"""WITH RECURSIVE {STRONGEST}, x AS (SELECT unnest(path) AS state, unnest(range(1, len(path) + 1)) AS i, len(path) AS n, ws FROM best)
SELECT state, CASE WHEN i < n THEN CASE WHEN ws[i] = 1 THEN 'fundamental' WHEN ws[i] < 1 THEN 'variant' END WHEN ws[n - 1] = 1 THEN 'fundamental' END AS part, round(ws[i], 6) AS weight FROM x WHERE i < n OR ws[n - 1] = 1""")
def path_parts(spark, sf):
    found = strongest(spark, sf)
    rows = [(s, "fundamental", 1.0 if s != found["path"][-1] else None) for s in found["fundamental"]] + [(s, "variant", round(w, 6)) for s, w in found["variant"]]
    return spark.createDataFrame(rows, "state string, part string, weight double")


@query(f"""WITH {WALKS}, q AS (SELECT walk, path[i] AS src, path[i + 1] AS dst FROM (SELECT walk, path, unnest(range(1, len(path))) AS i FROM paths)),
e AS (SELECT src, dst, count(*) / (SELECT count(*) FROM paths) AS w FROM q GROUP BY 1, 2)
SELECT walk, round(coalesce(product(w), 1.0), 9) AS weight FROM paths LEFT JOIN (SELECT walk AS k, w FROM q JOIN e USING (src, dst)) ON k = walk GROUP BY 1""")
def path_weights(spark, sf):
    paths = walked(spark, sf).select(F.col("walk").alias("case"), "path")
    return decision.path_weights(paths, decision.edge_frequencies(paths)).select(F.col("case").alias("walk"), F.round("weight", 9).alias("weight"))


@query(f"""WITH RECURSIVE {WALKS}, own AS (SELECT walk, path FROM paths WHERE domain = 1), q AS (SELECT path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM own)),
e AS (SELECT src, dst, count(*) / (SELECT count(*) FROM own) AS w FROM q GROUP BY 1, 2), {values_sql('g', 'e')}, {rollout_sql('g', 'Contact')}
SELECT (SELECT count(*) FROM own) AS cases, round({_VALUE.format('g').replace('(start)', 'Contact')}, 6) AS value, (SELECT string_agg(s, '>' ORDER BY step) FROM g_r) AS path""")
def goal_course(spark, sf):
    """The course on the walks of one goal; domains stand for goals."""
    paths = walked(spark, sf).select(F.col("walk").alias("case"), F.col("domain").cast("string").alias("goal"), "path")
    found, n = decision.course_for_goal(paths, "1", "Contact", REWARDS, gamma=GAMMA)
    return spark.createDataFrame([(n, round(found.value, 6), ">".join(found.path))], "cases long, value double, path string")
