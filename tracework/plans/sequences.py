"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework.operators import experiments, facets, process
from tracework.operators import sequences as S
from tracework.plans.registry import query
from tracework.session import cut, table

LOG = """log AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS trace, user_id, ts, event_id, event_type AS activity FROM events),
lagged AS (SELECT *, lag(activity) OVER w AS prev, lead(activity) OVER w AS nxt, row_number() OVER w - 1 AS position FROM log WINDOW w AS (PARTITION BY trace ORDER BY ts, event_id)),
collapsed AS (SELECT * FROM lagged WHERE prev IS NULL OR prev <> activity),
edges AS (SELECT activity AS src, nxt AS dst, count(*) AS n FROM lagged WHERE nxt IS NOT NULL GROUP BY 1, 2)"""

#: Coarse names of the activities; a fixed vocabulary.
LEVELS = [("view", "look"), ("click", "look"), ("signup", "act"), ("purchase", "act")]
LEVEL_ROWS = ", ".join(f"('{a}', '{c}')" for a, c in LEVELS)


def log(spark, sf):
    return S.event_log(table(spark, sf, "events"))


@query(f"""WITH {LOG}, v AS (SELECT trace, string_agg(activity, '>' ORDER BY ts, event_id) AS variant FROM collapsed GROUP BY trace)
SELECT variant, count(*) AS n FROM v GROUP BY variant ORDER BY n DESC, variant LIMIT 20""")
def variants_topk(spark, sf):
    return S.variants(S.collapsed(log(spark, sf)), 20)


@query(f"WITH {LOG} SELECT count(DISTINCT trace) AS traces, count(*) AS events, count(ts) AS dated, count(DISTINCT activity) AS activities FROM log")
def event_log_summary(spark, sf):
    return S.log_summary(log(spark, sf))


@query(f"WITH {LOG} SELECT trace, string_agg(activity, '>' ORDER BY ts, event_id) AS path, count(*) AS steps FROM collapsed GROUP BY trace")
def path_collapse(spark, sf):
    return S.paths(S.collapsed(log(spark, sf))).select("trace", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("steps"))


@query(f"WITH {LOG} SELECT * FROM edges")
def dfg_edges(spark, sf):
    return S.dfg(log(spark, sf))


@query(f"WITH {LOG} SELECT src, dst, round(n / (SELECT count(DISTINCT trace) FROM log), 6) AS weight FROM edges")
def edge_frequency(spark, sf):
    return S.edge_frequency(log(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {LOG} SELECT activity AS src, nxt AS dst, round(count(DISTINCT trace) / (SELECT count(DISTINCT trace) FROM log), 6) AS weight
FROM lagged WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def edge_containment(spark, sf):
    return S.edge_containment(log(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {LOG} SELECT src, dst, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM edges")
def transition_prob(spark, sf):
    return S.normalised(S.dfg(log(spark, sf))).withColumn("p", F.round("p", 6))


@query(f"""WITH {LOG}, p AS (SELECT src, n / sum(n) OVER (PARTITION BY src) AS p FROM edges)
SELECT src, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY src""")
def transition_entropy(spark, sf):
    return S.entropy(S.normalised(S.dfg(log(spark, sf)))).withColumn("bits", F.round("bits", 6))


@query(f"""WITH {LOG}, c AS (SELECT user_id % 4 AS grp, activity AS item, count(*) AS n FROM log GROUP BY 1, 2),
p AS (SELECT grp, item, n / sum(n) OVER (PARTITION BY grp) AS p FROM c), g AS (SELECT DISTINCT grp FROM c),
k AS (SELECT DISTINCT item FROM c),
x AS (SELECT a.grp AS "left", b.grp AS "right", coalesce(pa.p, 0) AS p, coalesce(pb.p, 0) AS q FROM g a JOIN g b ON a.grp < b.grp CROSS JOIN k
      LEFT JOIN p pa ON pa.grp = a.grp AND pa.item = k.item LEFT JOIN p pb ON pb.grp = b.grp AND pb.item = k.item)
SELECT "left", "right", round(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)), 6) AS bits
FROM x GROUP BY 1, 2""")
def group_divergence(spark, sf):
    counts = log(spark, sf).groupBy((F.col("user_id") % 4).alias("grp"), F.col("activity").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return S.divergence(counts).withColumn("bits", F.abs(F.round("bits", 6)))


@query(f"WITH {LOG} SELECT event_id, trace, position FROM lagged")
def trace_positions(spark, sf):
    return S.positions(log(spark, sf)).select("event_id", "trace", F.col("position").cast("long").alias("position"))


@query(f"""WITH {LOG}, levels(activity, coarse) AS (VALUES {LEVEL_ROWS})
SELECT coalesce(coarse, log.activity) AS activity, count(*) AS n FROM log LEFT JOIN levels ON log.activity = levels.activity GROUP BY 1""")
def coarse_levels(spark, sf):
    levels = spark.createDataFrame(LEVELS, "activity string, coarse string")
    return S.relabelled(log(spark, sf), levels).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, a AS (SELECT activity, count(DISTINCT trace) AS traces FROM log GROUP BY 1), n AS (SELECT count(DISTINCT trace) AS n FROM log)
SELECT activity, traces, traces = n AS fundamental, traces > 1 AND traces < n AS is_variant, traces = 1 AS is_unique FROM a, n""")
def cross_case_classes(spark, sf):
    return S.cross_case_classes(log(spark, sf))


@query(f"""WITH {LOG}, r AS (SELECT activity, coalesce(max(activity = 'purchase') OVER (PARTITION BY trace ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reached FROM log)
SELECT activity, reached, count(*) AS n FROM r GROUP BY 1, 2""")
def goal_so_far(spark, sf):
    return S.goal_so_far(log(spark, sf), "purchase").groupBy("activity", "reached").agg(F.count(F.lit(1)).alias("n"))


DATED = """dated AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
o_orderstatus AS kind FROM orders)"""


def dated_orders(spark, sf):
    """Orders with a date of month precision for even keys."""
    short = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, short).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.col("o_orderstatus").alias("kind")
    )


@query(f"""WITH {DATED}, d AS (SELECT o_custkey, o_orderkey, CAST(CASE WHEN length(day) = 7 THEN day || '-01' ELSE day END AS DATE) AS d FROM dated),
x AS (SELECT o_custkey, coalesce(d >= lag(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS ok FROM d)
SELECT o_custkey, count(*) AS dated, CASE WHEN count(*) >= 2 THEN bool_and(ok) END AS in_order FROM x GROUP BY 1""")
def in_date_order(spark, sf):
    return S.in_date_order(dated_orders(spark, sf), "o_custkey", ["o_orderkey"], "day")


@query(f"""WITH {DATED} SELECT CASE length(day) WHEN 7 THEN 'month' WHEN 10 THEN 'day' ELSE 'none' END AS "precision", count(*) AS n FROM dated GROUP BY 1""")
def date_precision(spark, sf):
    return dated_orders(spark, sf).groupBy(S.precision(F.col("day")).alias("precision")).agg(F.count(F.lit(1)).alias("n"))


PRECEDENCE = [("F", "O"), ("F", "P")]


@query(f"""WITH {DATED}, b AS (SELECT DISTINCT o_custkey AS "case", kind, CAST(CASE WHEN length(day) = 7 THEN day || '-01' ELSE day END AS DATE) AS lo,
CASE WHEN length(day) = 7 THEN last_day(CAST(day || '-01' AS DATE)) ELSE CAST(day AS DATE) END AS hi FROM dated),
prec(earlier, later) AS (VALUES ('F', 'O'), ('F', 'P'))
SELECT DISTINCT x."case", 'order' AS departure, x.kind AS "first", y.kind AS "second" FROM b x JOIN prec ON x.kind = earlier JOIN b y ON y."case" = x."case" AND y.kind = later AND y.hi < x.lo
UNION ALL SELECT DISTINCT x."case", 'repeat', x.kind, x.kind FROM b x JOIN b y ON y."case" = x."case" AND y.kind = x.kind AND y.hi < x.lo
UNION ALL SELECT "case", 'both', 'O', 'P' FROM b GROUP BY "case" HAVING bool_or(kind = 'O') AND bool_or(kind = 'P')""")
def procedure_departures(spark, sf):
    events = dated_orders(spark, sf).select(F.col("o_custkey").alias("case"), "kind", F.col("day").alias("date"))
    precedence = spark.createDataFrame(PRECEDENCE, "earlier string, later string")
    return S.procedure_departures(events, precedence).unionByName(S.both_outcomes(events, "O", "P", "both"))


def variant_counts(spark, sf):
    return S.variants(S.collapsed(log(spark, sf)))


@query()
def inductive_tree(spark, sf):
    """The process tree of the collapsed paths, as text."""
    tree = process.mine(process.collect_log(variant_counts(spark, sf)), noise=0.2)
    return spark.createDataFrame([(process.tree_text(tree),)], "tree string")


@query()
def alignment_fitness(spark, sf):
    """Each variant's cheapest alignment with the mined tree, and the fitness of the whole log."""
    counted = cut(variant_counts(spark, sf), "variants")
    aligned = cut(process.align_tree(counted, process.mine(process.collect_log(counted), noise=0.2)), "aligned")
    return aligned.crossJoin(process.log_fitness(aligned).select(F.round("fitness", 6).alias("log_fitness")))


@query(f"""WITH {LOG}, m AS (SELECT activity, CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 25) AS BIGINT) AS means FROM events e JOIN log USING (event_id))
SELECT activity, means, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY activity), 6) AS share FROM m GROUP BY 1, 2""")
def means_distribution(spark, sf):
    events = table(spark, sf, "events")
    means = F.floor(F.get_json_object("props", "$.k").cast("int") / 25).alias("means")
    by = events.groupBy(F.col("event_type").alias("activity"), means).agg(F.count(F.lit(1)).alias("n"))
    return S.normalised(by.select(F.col("activity").alias("src"), F.col("means").alias("dst"), "n")).join(
        by, (F.col("src") == F.col("activity")) & (F.col("dst") == F.col("means"))
    ).select("activity", "means", "n", F.round("p", 6).alias("share"))


@query("""SELECT CAST(user_id AS VARCHAR) AS "case", year(ts) AS "year", count(*) AS n, min(ts) AS "first", max(ts) AS "last" FROM events GROUP BY 1, 2""")
def timeline_by_year(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("case"), F.year("ts").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


@query("SELECT min(ts) AS earliest, max(ts) AS latest FROM events")
def date_range(spark, sf):
    return table(spark, sf, "events").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


@query("""WITH t AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS variant FROM conversations GROUP BY conv_id)
SELECT variant, count(*) AS n FROM t GROUP BY variant""")
def role_variants(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.groupBy(F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("variant")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, levels(activity, coarse) AS (VALUES {LEVEL_ROWS}), c AS (SELECT trace, ts, event_id, coalesce(coarse, log.activity) AS a FROM log LEFT JOIN levels ON log.activity = levels.activity),
d AS (SELECT *, lag(a) OVER (PARTITION BY trace ORDER BY ts, event_id) AS b FROM c), v AS (SELECT trace, string_agg(a, '>' ORDER BY ts, event_id) AS variant FROM d WHERE b IS NULL OR b <> a GROUP BY 1) SELECT variant, count(*) AS n FROM v GROUP BY 1""")
def coarse_variants(spark, sf):
    """Paths at the coarser level, runs collapsed there."""
    levels = spark.createDataFrame(LEVELS, "activity string, coarse string")
    return S.variants(S.collapsed(S.relabelled(log(spark, sf), levels)))


DRAWS, SEED = 5, 7
_HASH = "md5({0} || '|' || draw || '|" + str(SEED) + "')"


def _compared_sql(what: str) -> str:
    item = {"steps": "SELECT trace, activity AS item FROM log", "transitions": "SELECT trace, activity || '>' || nxt FROM lagged WHERE nxt IS NOT NULL"}[what]
    n = f"{what[0]}_"
    return f"""{n}x(trace, item) AS ({item}), {n}i AS (SELECT trace, item, count(*) AS n FROM {n}x GROUP BY 1, 2),
{n}c AS (SELECT draw, grp, item, sum(n) AS n FROM dealt JOIN {n}i USING (trace) GROUP BY ALL), {n}p AS (SELECT draw, grp, item, n / sum(n) OVER (PARTITION BY draw, grp) AS p FROM {n}c),
{n}g AS (SELECT DISTINCT draw, grp FROM {n}p), {n}k AS (SELECT DISTINCT item FROM {n}p),
{n}y AS (SELECT a.draw, a.grp AS l, b.grp AS r, coalesce(pa.p, 0) AS p, coalesce(pb.p, 0) AS q FROM {n}g a JOIN {n}g b ON a.draw = b.draw AND a.grp < b.grp CROSS JOIN {n}k k LEFT JOIN {n}p pa ON pa.draw = a.draw AND pa.grp = a.grp AND pa.item = k.item LEFT JOIN {n}p pb ON pb.draw = b.draw AND pb.grp = b.grp AND pb.item = k.item),
{n}b AS (SELECT draw, l, r, sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) AS bits FROM {n}y GROUP BY 1, 2, 3),
{n}m AS (SELECT draw, avg(bits) AS bits FROM {n}b GROUP BY 1), {n}r AS (SELECT max(bits) FILTER (draw < 0) AS mean_bits, avg(bits) FILTER (draw >= 0) AS shuffled_bits FROM {n}m)"""


#: Labels of a draw: the i-th trace by hash takes the i-th label in order.
DEALT = f"""t AS (SELECT trace, min(user_id % 4) AS grp FROM log GROUP BY 1), n AS (SELECT grp, count(*) AS n, sum(count(*)) OVER (ORDER BY grp) AS last FROM t GROUP BY 1),
k AS (SELECT draw, trace, row_number() OVER (PARTITION BY draw ORDER BY {_HASH.format('trace')}, trace) AS i FROM t, range({DRAWS}) AS d(draw)),
dealt AS (SELECT draw, trace, n.grp FROM k JOIN n ON i <= last AND i > last - n.n UNION ALL SELECT -1, trace, grp FROM t)"""


@query(f"""WITH {LOG}, {DEALT}, {_compared_sql('steps')}, {_compared_sql('transitions')} SELECT 'act' AS level, 'steps' AS what, round(mean_bits, 6) AS mean_bits, round(shuffled_bits, 6) AS shuffled_bits, round(mean_bits - shuffled_bits, 6) AS above_shuffled FROM s_r
UNION ALL SELECT 'act', 'transitions', round(mean_bits, 6), round(shuffled_bits, 6), round(mean_bits - shuffled_bits, 6) FROM t_r""")
def compared_domains(spark, sf):
    """Domains compared by steps and by transitions, beside shuffled labels."""
    own = log(spark, sf).withColumn("grp", F.col("user_id") % 4)
    found = experiments.compared_levels({"act": own}, "grp", DRAWS, SEED)
    return found.select("level", "what", *[F.round(c, 6).alias(c) for c in ("mean_bits", "shuffled_bits", "above_shuffled")])


@query(f"""WITH {LOG}, {DEALT} SELECT draw, grp, count(*) AS traces, min(trace) AS first FROM dealt WHERE draw >= 0 GROUP BY 1, 2""")
def shuffled_labels(spark, sf):
    traces = log(spark, sf).groupBy("trace").agg(F.min(F.col("user_id") % 4).alias("grp"))
    return experiments.shuffled_labels(traces, "grp", DRAWS, SEED).groupBy("draw", "grp").agg(F.count(F.lit(1)).alias("traces"), F.min("trace").alias("first"))


@query(f"""WITH {LOG}, m AS (SELECT draw, activity AS src, lead(activity) OVER (PARTITION BY draw, trace ORDER BY {_HASH.format('event_id')}, event_id) AS dst FROM log, range({DRAWS}) AS d(draw)),
e AS (SELECT draw, src, dst, count(*) AS n FROM m WHERE dst IS NOT NULL GROUP BY ALL UNION ALL SELECT -1, src, dst, n FROM edges),
h AS (SELECT draw, sum(-n * log2(n / t)) / sum(n) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY draw, src) AS t FROM e) GROUP BY 1)
SELECT round(max(bits) FILTER (draw < 0), 6) AS bits, round(avg(bits) FILTER (draw >= 0), 6) AS shuffled_bits, round(avg(bits) FILTER (draw >= 0) - max(bits) FILTER (draw < 0), 6) AS below_shuffled FROM h""")
def order_null(spark, sf):
    found = experiments.order_null(log(spark, sf), DRAWS, SEED)
    return found.select(*[F.round(c, 6).alias(c) for c in ("bits", "shuffled_bits", "below_shuffled")])


#: Groupings of the activities, fixed vocabularies: (name, activity, group).
GROUPINGS = [("intent", "view", 0), ("intent", "click", 0), ("intent", "error", 0), ("intent", "signup", 1), ("intent", "purchase", 1),
             ("money", "view", 0), ("money", "click", 0), ("money", "error", 0), ("money", "signup", 0), ("money", "purchase", 1)]


@query(f"""WITH {LOG}, g(name, activity, grp) AS (VALUES {", ".join(map(str, GROUPINGS))}), slots AS (SELECT name, grp, row_number() OVER (PARTITION BY name ORDER BY grp, activity) AS i FROM g),
k AS (SELECT name, draw, activity, row_number() OVER (PARTITION BY name, draw ORDER BY {_HASH.format("name || '/' || activity")}, activity) AS i FROM g, range({DRAWS}) AS d(draw)),
every AS (SELECT k.name, draw, activity, grp FROM k JOIN slots ON slots.name = k.name AND slots.i = k.i UNION ALL SELECT name, -1, activity, grp FROM g),
c AS (SELECT a.name, a.draw, a.grp AS x, b.grp AS y, sum(n) AS n FROM edges JOIN every a ON a.activity = src JOIN every b ON b.activity = dst AND b.name = a.name AND b.draw = a.draw GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY name, draw) AS t, sum(n) OVER (PARTITION BY name, draw, x) AS tx, sum(n) OVER (PARTITION BY name, draw, y) AS ty FROM c), m AS (SELECT name, draw, sum(n / t * log2(n * t / (tx * ty))) AS bits FROM t GROUP BY 1, 2)
SELECT name, abs(round(max(bits) FILTER (draw < 0), 6)) AS bits, abs(round(avg(bits) FILTER (draw >= 0), 6)) AS random_bits, round(max(bits) FILTER (draw < 0) - avg(bits) FILTER (draw >= 0), 6) AS above_random FROM m GROUP BY 1""")
def groupings_beside_random(spark, sf):
    groupings = spark.createDataFrame(GROUPINGS, "name string, activity string, grp int")
    found = experiments.groupings_beside_random(S.dfg(log(spark, sf)), groupings, DRAWS, SEED)
    return found.select("name", F.abs(F.round("bits", 6)).alias("bits"), F.abs(F.round("random_bits", 6)).alias("random_bits"), F.round("above_random", 6).alias("above_random"))


@query("""WITH c AS (SELECT o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) SELECT 'c' || o_custkey AS case_id, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS date FROM orders JOIN c USING (o_custkey)""")
def case_timeline(spark, sf):
    """All records of the case that the first order belongs to."""
    rows = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderdate").alias("date"))
    first = str(table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0])
    return facets.case_view(rows, first)


@query(f"WITH {LOG}, c AS (SELECT activity, count(*) AS n FROM log GROUP BY 1) SELECT activity, n, row_number() OVER (ORDER BY n DESC, activity) AS place FROM c")
def kinds_by_count(spark, sf):
    from pyspark.sql import Window

    by = log(spark, sf).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "activity")).cast("long"))


@query(f"""WITH {LOG}, {DEALT}, x AS (SELECT trace, activity AS src, nxt AS dst FROM lagged WHERE nxt IS NOT NULL), c AS (SELECT draw, grp, src, dst, count(*) AS n FROM dealt JOIN x USING (trace) GROUP BY ALL),
a AS (SELECT draw, sum(-n * log2(n / t)) / sum(n) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY draw, src) AS t FROM (SELECT draw, src, dst, sum(n) AS n FROM c GROUP BY ALL)) GROUP BY 1),
w AS (SELECT draw, sum(-n * log2(n / t)) / sum(n) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY draw, grp, src) AS t FROM c) GROUP BY 1), b AS (SELECT draw, a.bits - w.bits AS bits FROM a JOIN w USING (draw))
SELECT draw, round(bits, 6) AS bits, CASE WHEN draw >= 0 THEN round((SELECT bits FROM b WHERE draw < 0) - bits, 6) END AS paired FROM b""")
def invariance(spark, sf):
    """Whether the next step obeys one law in all domains, beside shuffled domains, paired by draw."""
    found = experiments.invariance(log(spark, sf).withColumn("grp", F.col("user_id") % 4), "grp", DRAWS, SEED)
    return found.select("draw", *[F.round(c, 6).alias(c) for c in ("bits", "paired")])


_SLOPE = """list_sum(list_transform(s, lambda t: list_sum(list_transform(t, lambda c: c.n * c.v)) - list_sum(list_transform(t, lambda c: c.n)) * list_sum(list_transform(t, lambda c: exp({0} * c.v) * c.v)) / list_sum(list_transform(t, lambda c: exp({0} * c.v)))))"""


@query(f"""WITH RECURSIVE {LOG}, worth AS (SELECT activity AS dst, sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*) AS v FROM (SELECT DISTINCT trace, activity FROM log) JOIN (SELECT trace, bool_or(activity = 'purchase') AS hit FROM log GROUP BY 1) USING (trace) GROUP BY 1),
m AS (SELECT draw, activity AS src, lead(activity) OVER (PARTITION BY draw, trace ORDER BY {_HASH.format('event_id')}, event_id) AS dst FROM log, range({DRAWS}) AS d(draw)),
c AS (SELECT draw, src, dst, count(*) AS n FROM m WHERE dst IS NOT NULL GROUP BY ALL UNION ALL SELECT -1, src, dst, n FROM edges),
o AS (SELECT s.draw, s.src, list({{v: v, n: CAST(coalesce(n, 0) AS DOUBLE)}} ORDER BY worth.dst) AS t FROM (SELECT DISTINCT draw, src FROM c) s CROSS JOIN worth LEFT JOIN c ON c.draw = s.draw AND c.src = s.src AND c.dst = worth.dst GROUP BY ALL),
d AS (SELECT draw, list(t ORDER BY src) AS s FROM o GROUP BY 1),
h(draw, s, low, high, k) AS (SELECT draw, s, CAST(0 AS DOUBLE), CAST(50 AS DOUBLE), 0 FROM d UNION ALL SELECT draw, s, CASE WHEN up THEN mid ELSE low END, CASE WHEN up THEN high ELSE mid END, k + 1 FROM (SELECT *, (low + high) / 2 AS mid, {_SLOPE.format('((low + high) / 2)')} > 0 AS up FROM h WHERE k < {experiments.HALVINGS})),
b AS (SELECT draw, CASE WHEN {_SLOPE.format('0.0')} <= 0 THEN 0 WHEN {_SLOPE.format('50.0')} >= 0 THEN 50 ELSE (low + high) / 2 END AS beta FROM h WHERE k = {experiments.HALVINGS})
SELECT draw, round(beta, 6) AS beta, CASE WHEN draw >= 0 THEN round((SELECT beta FROM b WHERE draw < 0) - beta, 6) END AS paired FROM b""")
def rationality_null(spark, sf):
    """How much steps are chosen for the share of traces with a purchase among those that have the step, beside shuffled
    orders."""
    rows = log(spark, sf)
    hit = rows.groupBy("trace").agg(F.bool_or(F.col("activity") == "purchase").cast("int").alias("hit"))
    worth = rows.select("trace", F.col("activity").alias("dst")).distinct().join(hit, "trace").groupBy("dst").agg(F.avg("hit").alias("v"))
    found = experiments.rationality_null(rows, worth, DRAWS, SEED)
    return found.select("draw", *[F.round(c, 6).alias(c) for c in ("beta", "paired")])
