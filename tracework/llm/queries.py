"""The registered queries of the corpus operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.llm import align, bpe, chat, decontam, golden, linedup, neardup, pii, quality, sharding, toxicity, urlfilter, wrappers
from tracework.session import spread, table

#: The shards that op2 deals to: 3 regions of 2 racks of 4 shards.
SHARD_TREE = sharding.even_tree(3, 2, 4)

# fixed values
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]

#: Listed hosts, blocked with their subdomains: these names below example in each of three top-level domains.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_HOSTS = [f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org")]


#: The conversation that op10 adds to the table: rows of (conv_id, turn, role, text), fixed values.
ADDED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str, *order: str) -> DataFrame:
    """The whole table, dealt to all cores if it is small, then in order in each partition."""
    return spread(table(spark, sf_dir, "documents"), *order)


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_TREE)
    return rows.withColumn("law", F.lit("key"))


def op3_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op4_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # op4 reads its input twice and needs one order of rows
    return bpe.encode_digests(documents(spark, sf_dir, "doc_id", "text"), vocabulary())


def op5_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_suffix_array_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose lines, the numbers of these lines and the documents that hold the first copies."""
    found = linedup.later_copies(documents(spark, sf_dir))
    return found.select(F.col("_d").alias("doc_id"), F.size("lines").alias("n_deleted"), F.col("lines").alias("deleted_lines"), F.col("first_docs").alias("first_doc_ids"))


def op9_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op10_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_TURNS, turns.schema)
    return chat.digests(chat.windows(turns.unionByName(added)))


def op11_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.golden_records(table(spark, sf_dir, "clients"))


def op12_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(spread(table(spark, sf_dir, "pages")))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pigeonhole_decontamination, op2_hash_tree_sharding, op3_cascade_url_filter, op4_distinct_word_bpe,
        op5_simhash_bk_trees, op6_quality_rules, op7_factorization_machine_toxicity, op8_suffix_array_line_dedup,
        op9_crf_personal_data, op10_budgeted_chat_windows, op11_golden_records, op12_html_wrappers,
        op13_tokenizer_alignment,
    )
}


def _draw(path: str, weight: float) -> str:
    bits = f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|{path}'), 1, 13) AS BIGINT)"
    return f"-ln(({bits} + 0.5) / 4503599627370496.0) / {weight}"


def _descend_sql(node, path: str = "r") -> str:
    """The shard below a node: the child with the smallest draw."""
    if isinstance(node, tuple):
        return str(node[0])
    if len(node) == 1:
        return _descend_sql(node[0], f"{path}.0")
    weight = lambda n: n[1] if isinstance(n, tuple) else sum(map(weight, n))
    draws = ", ".join(_draw(f"{path}.{i}", weight(child)) for i, child in enumerate(node))
    cases = " ".join(f"WHEN {i} THEN {_descend_sql(child, f'{path}.{i}')}" for i, child in enumerate(node))
    return f"CASE list_position([{draws}], list_min([{draws}])) - 1 {cases} END"


def _op2_sql() -> str:
    """CRC-32 by its rule: a table of 256 from eight steps each, then one look-up a byte."""
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    rounds = "".join(f", c{k + 1} AS (SELECT n, {step.format('c')} AS c FROM c{k})" for k in range(8))
    data = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {data}), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"
    bucket = f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || text_crc32), 1, 8) AS BIGINT) % {sharding.SLOT_BUCKETS}"
    return f"""
WITH c0 AS (SELECT n, CAST(n AS BIGINT) AS c FROM range(256) r(n)){rounds}, crc AS (SELECT list(c ORDER BY n) AS t FROM c8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, {crc} AS text_crc32, {_descend_sql(SHARD_TREE)} AS shard, {_descend_sql(sharding.grow(SHARD_TREE))} AS grown_shard FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM (SELECT *, {bucket} AS bucket FROM s)"""


def _op3_sql() -> str:
    rules = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in URL_RULES)
    listed = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
    return f"""
WITH rules(action, rhost, rpath) AS (VALUES {rules}), listed(lhost) AS (VALUES {listed}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM p),
r AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath) * 10000 + length(rhost)) AS rule,
             arg_max(action, length(rhost || rpath) * 10000 + length(rhost)) AS action
      FROM d, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
b AS (SELECT DISTINCT host, first(lhost ORDER BY length(lhost)) AS listed_host FROM d, listed WHERE host = lhost OR ends_with(host, '.' || lhost) GROUP BY host)
SELECT p.page_id, p.host, p.path, r.rule, b.listed_host,
       coalesce(r.action, CASE WHEN b.listed_host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r ON p.host = r.host AND p.path = r.path LEFT JOIN b ON p.host = b.host"""


ORACLES = {"op2_hash_tree_sharding": _op2_sql(), "op3_cascade_url_filter": _op3_sql()}

_SHOWN = "strlen(replace(replace({0}, '~', '~0'), '<|', '~1'))"
_SHOWN_CHARS = _SHOWN.replace("strlen", "length")
_MARKS = len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)
_FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

ORACLES["op10_budgeted_chat_windows"] = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES {", ".join(map(str, ADDED_TURNS))}),
t AS (SELECT *, coalesce(turn // {chat.BLOCK}, {chat.NO_TURN}) AS block, CAST({_MARKS} + {_SHOWN.format("role")} + {_SHOWN.format("text")} AS BIGINT) AS tokens,
  CAST({_MARKS} + {_SHOWN_CHARS.format("role")} + {_SHOWN_CHARS.format("text")} AS BIGINT) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS i FROM rows),
y AS (SELECT *, max(CASE WHEN i = 0 AND role = 'system' THEN tokens END) OVER c AS system, max(CASE WHEN i = 0 AND role = 'system' THEN chars END) OVER c AS system_chars FROM t WINDOW c AS (PARTITION BY conv_id)),
b AS (SELECT *, greatest(coalesce(system, 0) - {chat.SYSTEM_TOKENS}, 0) AS beyond FROM y),
l AS (SELECT *, greatest({chat.STRIDE} - greatest(beyond - {chat.HISTORY_TOKENS}, 0), 1) AS stride, {chat.HISTORY_TOKENS} - beyond AS budget,
  CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id, block ORDER BY i {_FRAME}), 0) AS BIGINT) AS start,
  lag(tokens) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(chars) OVER o AS c1, lag(chars, 2) OVER o AS c2, lag(role) OVER o AS r1, lag(role, 2) OVER o AS r2 FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
w AS (SELECT *, 2 * (start // stride) + CASE WHEN start // stride = (start + tokens - 1) // stride THEN 0 ELSE 1 END AS win FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block, win ORDER BY i) = 1 AS begins FROM w),
h AS (SELECT *, CASE WHEN begins AND r1 <> 'system' AND t1 <= budget THEN c1 ELSE 0 END
  + CASE WHEN begins AND r2 <> 'system' AND t2 + CASE WHEN r1 <> 'system' THEN t1 ELSE 0 END <= budget THEN c2 ELSE 0 END
  + CASE WHEN begins AND i > 0 THEN coalesce(system_chars, 0) ELSE 0 END AS again FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + again) AS BIGINT) AS formatted_chars FROM h GROUP BY conv_id"""


_RECENT = "upd DESC NULLS LAST, trust, client_id NULLS LAST"
_TRUSTED = f"stale, trust, {_RECENT}"
_FIRST = "first({{v: {0}, c: client_id}} ORDER BY {1}) FILTER ({0} IS NOT NULL)"
_TEXT = r"CASE WHEN regexp_matches({0}, '[^\x20\x09-\x0D]') THEN {0} END AS {0}"

ORACLES["op11_golden_records"] = f"""
WITH r AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, epoch_us(updated_at) AS upd, coalesce(list_position({list(golden.TRUST)}, source), 99) AS trust,
    {", ".join(map(_TEXT.format, ("name", "email", "segment", "city")))}, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance FROM clients),
s AS (SELECT *, upd IS NULL OR upd < max(upd) OVER (PARTITION BY cluster_id) - {golden.STALE_DAYS} * 86400000000 AS stale FROM r),
c AS (SELECT cluster_id, {_FIRST.format("segment", _RECENT + ", segment")} AS chosen FROM s GROUP BY cluster_id),
g AS (SELECT s.cluster_id, count(*) AS n_records, CAST(count(*) FILTER (stale) AS BIGINT) AS n_stale, any_value(chosen) AS seg,
    {_FIRST.format("name", f"length(name) DESC, {_TRUSTED}, name")} AS nam, {_FIRST.format("email", f"{_TRUSTED}, email")} AS mail,
    {_FIRST.format("balance", f"segment IS DISTINCT FROM chosen.v, {_RECENT}, balance")} AS bal,
    first({{city: city, nation_id: nation_id, c: client_id}} ORDER BY (city IS NULL)::INT + (nation_id IS NULL)::INT, {_TRUSTED}, city NULLS LAST, nation_id) AS adr
  FROM s JOIN c ON s.cluster_id IS NOT DISTINCT FROM c.cluster_id GROUP BY s.cluster_id)
SELECT cluster_id, n_records, n_stale, nam.v AS name, mail.v AS email, seg.v AS segment, adr.city AS city, adr.nation_id AS nation_id, CAST(floor(bal.v * 100 + 0.5) AS BIGINT) AS balance_cents,
  nam.c AS name_from, mail.c AS email_from, seg.c AS segment_from, bal.c AS balance_from, CASE WHEN adr.city IS NOT NULL OR adr.nation_id IS NOT NULL THEN adr.c END AS address_from FROM g"""
