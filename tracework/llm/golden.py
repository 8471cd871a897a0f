"""Golden records: one record per cluster of client rows, each field from the row that its rule puts first.

Rules become order-preserving binary keys: what comes first in a rule stands first in the key, and bytes compare as the rule
does. A plain min aggregate then finds the winner, map-side first, so a hot cluster is reduced before it is shuffled.

* RECENT, 18 bytes: inverted microseconds of updated_at (nine bytes, nulls last), trust (one byte), client_id (eight bytes
  with the sign flipped; null ids last, by the trust byte).
* TRUSTED: staleness (one byte), trust (one byte), RECENT.
* name: inverted code points (four bytes), TRUSTED; address: missing values (one byte), TRUSTED; balance: another
  segment than the chosen one (one byte), RECENT.

A first pass aggregates by cluster the latest time and the least RECENT key with a segment, whose text follows the key, so
that it is chosen already. These heads go back to the rows: those of the clusters that hold over 1 / HOT_SHARE of all
rows, hence at most HOT_SHARE, by broadcast; the others by a shuffle in which no key has more than that share.
A second pass finds the least key of each other field. The RECENT part at a key's end is joined to the row it came
from, which gives the values and the client_id.

Defined results: strings that are empty or only ASCII white space, and balances that are NaN or infinite, count as null;
sources other than those named, null too, have the least trust; rows without master_id and client_id form one cluster
with a null id; of rows equal in time, trust and client_id the least value wins (address: a known city first, then the
least city and nation_id); repeated rows count each; a cluster without any value of a field has null in it; an empty table
gives no rows; columns other than those named are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.session import cut

#: Sources by falling trust, fixed values.
TRUST = ("partner", "store", "web", "crm")
STALE_DAYS = 30
#: Clusters that hold more than this part of all rows, so at most so many, are joined by broadcast.
HOT_SHARE = 1_000

_FLIP = -(1 << 63)
#: Bytes of a RECENT key: time, trust, client_id.
_TIME, _RECENT = 9, 18


def _bytes(number: Column, size: int) -> Column:
    """Big-endian bytes of a number that is not negative, or of a whole long."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def microseconds(at: Column) -> Column:
    """Microseconds since 1970 by the wall clock, whatever the session's time zone."""
    seconds = F.unix_date(F.to_date(at)) * F.lit(86_400) + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def trust_rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(TRUST)], F.lit(len(TRUST)))


def present(text: Column) -> Column:
    """A string, or null where it has nothing but ASCII white space."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), text)


def recent_key(micros: Column, trust: Column, client_id: Column) -> Column:
    """Sorts as: latest first and null last, higher trust, smaller id and null last."""
    inverted = (-1 - micros).bitwiseXOR(F.lit(_FLIP))
    time = F.when(micros.isNull(), F.unhex(F.lit("01" + "00" * 8))).otherwise(F.concat(F.unhex(F.lit("00")), _bytes(inverted, 8)))
    # a null id stands behind every id of its trust
    number = F.when(client_id.isNull(), F.unhex(F.lit("FF" * 8))).otherwise(_bytes(client_id.bitwiseXOR(F.lit(_FLIP)), 8))
    return F.concat(time, _bytes(trust * 2 + F.when(client_id.isNull(), 1).otherwise(0), 1), number)


def client_of(recent: Column) -> Column:
    """The client_id at the end of a RECENT key; null for a null id."""
    known = F.conv(F.hex(F.substring(recent, _TIME + 1, 1)), 16, 10).cast("int") % 2 == 0
    return F.when(known, F.conv(F.hex(F.substring(recent, _TIME + 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_FLIP)))


def prepared(clients: DataFrame) -> DataFrame:
    """The rows with what keys and values need."""
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"),
        microseconds(F.col("updated_at")).alias("micros"),
        trust_rank(F.col("source")).alias("trust"),
        F.col("client_id").cast("long").alias("client_id"),
        *[present(F.col(c)).alias(c) for c in ("name", "email", "segment", "city")],
        "nation_id",
        F.when(F.abs(balance) < float("inf"), balance).alias("balance"),
    ).withColumn("recent", recent_key(F.col("micros"), F.col("trust"), F.col("client_id")))


def heads(rows: DataFrame) -> DataFrame:
    """(cluster_id, n_records, latest, _segment): the key of the chosen segment with its text behind."""
    return rows.groupBy("cluster_id").agg(
        F.count("*").alias("n_records"),
        F.max("micros").alias("latest"),
        F.min(F.when(F.col("segment").isNotNull(), F.concat("recent", F.encode("segment", "UTF-8")))).alias("_segment"),
    )


def _chosen() -> Column:
    """The text of the chosen segment."""
    return F.decode(F.substring("_segment", _RECENT + 1, 1 << 30), "UTF-8")


def _missing() -> Column:
    return F.isnull("city").cast("int") + F.isnull("nation_id").cast("int")


def _winners(rows: DataFrame) -> DataFrame:
    """By cluster: n_stale and the RECENT key of each field's winner."""
    stale = F.col("micros").isNull() | (F.col("micros") < F.col("latest") - STALE_DAYS * 86_400_000_000)
    flag = lambda c: F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    trusted = F.concat(flag(F.col("stale")), _bytes(F.col("trust"), 1), "recent")
    longest = _bytes(F.lit(0x7FFFFFFF) - F.length("name"), 4)
    keys = {
        "name": F.when(F.col("name").isNotNull(), F.concat(longest, trusted)),
        "email": F.when(F.col("email").isNotNull(), trusted),
        # without a chosen segment no row has one, and all are alike
        "balance": F.when(F.col("balance").isNotNull(), F.concat(flag(~F.col("segment").eqNullSafe(_chosen())), "recent")),
        "address": F.concat(_bytes(_missing(), 1), trusted),
    }
    least = rows.withColumn("stale", stale).groupBy("cluster_id").agg(
        F.first("n_records").alias("n_records"),
        F.count_if("stale").alias("n_stale"),
        F.first("_segment").alias("_segment"),
        *[F.min(k).alias(f"_{field}") for field, k in keys.items()],
    )
    recent = lambda c: F.substring(c, -_RECENT, _RECENT)
    return least.select("cluster_id", "n_records", "n_stale", "_segment", *[recent(f"_{f}").alias(f"_{f}") for f in keys])


def golden_records(clients: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """cluster_id, n_records, n_stale, the fields and the client_id that each came from."""
    rows = prepared(clients)
    found = cut(heads(rows), "cluster-heads")
    total = found.agg(F.sum("n_records")).first()[0] or 0
    is_hot = F.col("n_records") * hot_share > total
    hot = found.where(is_hot)
    ids = [r[0] for r in hot.select("cluster_id").collect()]  # at most hot_share
    known = [i for i in ids if i is not None]
    in_hot = F.when(F.isnull("cluster_id"), F.lit(None in ids)).otherwise(F.col("cluster_id").isin(known) if known else F.lit(False))
    narrow = [c for c in rows.columns if c != "client_id"]
    parts = []
    for some, head, hinted in ((rows.where(in_hot), hot, True), (rows.where(~in_hot), found.where(~is_hot), False)):
        if hinted and not ids:
            continue
        head = head.withColumnRenamed("cluster_id", "_cluster")
        head = F.broadcast(head) if hinted else head.hint("merge")
        parts.append(_winners(some.select(narrow).join(head, F.col("cluster_id").eqNullSafe(F.col("_cluster")))))
    won = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    won = cut(won, "cluster-winners")

    # the rows that won anything, each with its values; of rows with one key the value that its rule puts first, then the least
    fields = ("name", "email", "balance", "address")
    wanted = won.select("cluster_id", _chosen().alias("_chosen"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("recent")) for f in fields])).alias("w"))
    wanted = wanted.select(F.col("cluster_id").alias("_cluster"), "_chosen", F.col("w.field").alias("field"), F.col("w.recent").alias("_recent")).where("_recent IS NOT NULL")
    same = (F.col("recent") == F.col("_recent")) & F.col("cluster_id").eqNullSafe(F.col("_cluster"))
    met = rows.select("cluster_id", "recent", "name", "email", "segment", "city", "nation_id", "balance").join(wanted.hint("merge"), same)
    of = lambda field, *order: F.min(F.when((F.col("field") == field) & (F.lit(field == "address") | F.col(field if field != "address" else "city").isNotNull()), F.struct(*order))).alias(field)
    values = met.groupBy("cluster_id").agg(
        of("name", (-F.length("name")).alias("n"), "name"),
        of("email", "email"),
        of("balance", (~F.col("segment").eqNullSafe(F.col("_chosen"))).alias("n"), "balance"),
        of("address", _missing().alias("n"), F.isnull("city").alias("no_city"), "city", "nation_id"),
    )
    back = won.join(values.withColumnRenamed("cluster_id", "_cluster").hint("merge"), F.col("cluster_id").eqNullSafe(F.col("_cluster")), "left")
    cents = F.floor(F.col("balance.balance") * 100 + 0.5).cast("long")
    somewhere = F.col("address.city").isNotNull() | F.col("address.nation_id").isNotNull()
    return back.select(
        "cluster_id", "n_records", "n_stale",
        F.col("name.name").alias("name"),
        F.col("email.email").alias("email"),
        _chosen().alias("segment"),
        F.col("address.city").alias("city"),
        F.col("address.nation_id").alias("nation_id"),
        cents.alias("balance_cents"),
        client_of(F.col("_name")).alias("name_from"),
        client_of(F.col("_email")).alias("email_from"),
        client_of(F.substring("_segment", 1, _RECENT)).alias("segment_from"),
        client_of(F.col("_balance")).alias("balance_from"),
        F.when(somewhere, client_of(F.col("_address"))).alias("address_from"),
    )
