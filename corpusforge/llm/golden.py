"""Golden records: one surviving record for each cluster of client rows.

Method: map-side dominance pruning. Each partition keeps, of every cluster, the rows that win a slot there: the latest
row, the latest with a segment, and for each level of trust the best e-mail, name and address, for each segment the
latest balance. A row that wins no slot of its partition can't win one of its cluster, since fresh rows of one trust
are the latest ones: within a trust, "fresh before stale, then RECENT" is RECENT alone. Only these survivors are
shuffled. Clusters that leave `DENSE` survivors or more in a partition are pruned once more by (cluster, a salt of the
partition), with about the square root of the partitions as salts, so a cluster with a third of all rows brings a few
rows from each salt to the last step. There, pandas goes over whole clusters, which lie sorted in a partition, batch by
batch, and picks the fields.

Staleness counts are kept map-side too: rows of each (cluster, day) with the day's first and last instant. The day of
the limit itself is looked at again, in a join on (cluster, day), only where the limit cuts it.

Defined results. Strings that are empty or hold only `[\\x20\\x09-\\x0D]` are null, as are balances that aren't finite. Trust
falls in the order given; other sources (null too) come after all of it. A null updated_at is stale and last; null client
ids are last. Rows that tie in all of this are ordered by a hash of their values, so equal rows give equal records. Rows with
neither id make up one cluster, whose id is null. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEPARATORS, written

#: Sources by falling trust; a record is stale this long before its cluster's latest.
TRUST = ("partner", "store", "web", "crm")
STALE_HOURS = 30 * 24
#: Rows that a partition holds at once; survivors in a partition from which a cluster is pruned a second time.
HELD, DENSE = 100_000, 4
NO_TIME = -(2**63)
NO_ID = 2**63 - 1
CLUSTER = ["known", "cluster"]
ROW = "known boolean, cluster long, stamp long, trust int, client long, tie long, name string, name_length int, email string, segment string, city string, nation string, filled int, balance double"
RECORD = "known boolean, cluster long, name string, email string, segment string, city string, nation string, balance double, name_from long, email_from long, segment_from long, balance_from long, address_from long"


def filled(text: Column) -> Column:
    return F.when(F.translate(text, SEPARATORS, "") != "", text)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone."""
    at = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        whole = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
        return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_micros(at.cast("timestamp"))


def slim_rows(clients: DataFrame, trust: tuple[str, ...] = TRUST) -> DataFrame:
    """The columns of ROW of every row of clients, without nulls where numbers are ordered."""
    level = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(trust)], F.lit(len(trust)))
    key = F.coalesce("master_id", "client_id")
    balance = F.col("balance").cast("double")
    strings = {c: filled(F.col(c)) for c in ("name", "email", "segment", "city")}
    rows = clients.select(
        key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).cast("long").alias("cluster"),
        F.coalesce(micros(clients, "updated_at"), F.lit(NO_TIME)).alias("stamp"), level.alias("trust"),
        F.coalesce(F.col("client_id").cast("long"), F.lit(NO_ID)).alias("client"),
        *[v.alias(c) for c, v in strings.items()], F.col("nation_id").cast("string").alias("nation"),
        F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance).alias("balance"),
    )
    whole = rows.withColumns({
        "tie": F.xxhash64("name", "email", "segment", "city", "nation", "balance"),
        "name_length": F.coalesce(F.length("name"), F.lit(0)),
        "filled": F.col("city").isNotNull().cast("int") + F.col("nation").isNotNull().cast("int"),
    })
    return whole.select(*[f.split()[0] for f in ROW.split(", ")])


def recent(rows: pd.DataFrame) -> pd.DataFrame:
    """rows in the order RECENT: latest first (null last), higher trust, smaller client_id."""
    return rows.iloc[np.lexsort((rows["tie"], rows["client"], rows["trust"], ~rows["stamp"].to_numpy()))]


def survivors(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that win a slot of their cluster among these rows."""
    ordered = recent(rows).reset_index(drop=True)
    by_trust = [*CLUSTER, "trust"]
    named, mailed, paid = (ordered[ordered[c].notna()] for c in ("name", "email", "balance"))
    longest = named.sort_values("name_length", ascending=False, kind="stable")
    fullest = ordered.sort_values("filled", ascending=False, kind="stable")
    winners = [ordered.drop_duplicates(CLUSTER), ordered[ordered["segment"].notna()].drop_duplicates(CLUSTER), mailed.drop_duplicates(by_trust), longest.drop_duplicates(by_trust), fullest.drop_duplicates(by_trust), paid.drop_duplicates([*CLUSTER, "segment"])]
    return ordered.loc[np.unique(np.concatenate([w.index.to_numpy() for w in winners]))]


def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Survivors of a partition, of `HELD` rows at a time where a partition has more."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= HELD:
            left = survivors(pd.concat(held))
            held, n = [left], len(left)
            if 2 * n > HELD:
                yield left
                held, n = [], 0
    if n:
        yield survivors(pd.concat(held))


def picked(ordered: pd.DataFrame, field: str) -> pd.DataFrame:
    """Of each cluster the first row of ordered with the field."""
    first = ordered[ordered[field].notna()].drop_duplicates(CLUSTER)
    return first.set_index(CLUSTER)[[field, "client"]]


def merge(rows: pd.DataFrame, stale_micros: int) -> pd.DataFrame:
    """One record for each cluster of rows."""
    by_time = recent(rows).reset_index(drop=True)
    clusters = by_time.drop_duplicates(CLUSTER).set_index(CLUSTER)[["stamp"]]
    latest = by_time[CLUSTER].merge(clusters["stamp"].rename("latest").reset_index(), on=CLUSTER, how="left")["latest"].to_numpy()
    stamp = by_time["stamp"].to_numpy()
    # NO_TIME is told apart first: subtracting from it would wrap around.
    stale = (stamp == NO_TIME) | (np.where(stamp == NO_TIME, latest, stamp) < np.where(latest == NO_TIME, 0, latest) - stale_micros)
    trusted = by_time.iloc[np.lexsort((np.arange(len(by_time)), by_time["trust"], stale))]
    segment = picked(by_time, "segment")
    chosen = by_time[CLUSTER].merge(segment["segment"].rename("chosen").reset_index(), on=CLUSTER, how="left")["chosen"].to_numpy()
    other = (by_time["segment"].to_numpy() != chosen) & pd.notna(chosen)
    found = {
        "segment": segment,
        "email": picked(trusted, "email"),
        "name": picked(trusted.sort_values("name_length", ascending=False, kind="stable"), "name"),
        "balance": picked(by_time.iloc[np.argsort(other, kind="stable")], "balance"),
    }
    out = clusters.drop(columns="stamp")
    for field, rows_of in found.items():
        out = out.join(rows_of.rename(columns={"client": f"{field}_from"}))
    place = trusted.sort_values("filled", ascending=False, kind="stable").drop_duplicates(CLUSTER).set_index(CLUSTER)
    out = out.join(place[["city", "nation"]]).join(place.loc[place["filled"] > 0, ["client"]].rename(columns={"client": "address_from"}))
    ids = [c for c in out.columns if c.endswith("_from")]
    # Through object columns: ids beyond 2^53 would lose digits as floats.
    return out.astype({c: "Int64" for c in ids}).reset_index()


def of_clusters(stale_micros: int):
    """Records of a partition sorted by cluster: a batch's last cluster waits for its other rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch])
            last = (rows["known"] == rows["known"].iloc[-1]) & (rows["cluster"] == rows["cluster"].iloc[-1]) if len(rows) else None
            if last is None:
                continue
            waiting = rows[last]
            if not last.all():
                yield merge(rows[~last], stale_micros)
        if waiting is not None:
            yield merge(waiting, stale_micros)

    return run


def pruned(rows: DataFrame) -> DataFrame:
    """The survivors of rows: pruned where they lie, dense clusters once more by salts of their partitions."""
    columns = rows.columns

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for left in prune(batches):
            yield left.assign(dense=left.groupby(CLUSTER)["trust"].transform("size") >= DENSE)

    first = rows.mapInPandas(local, f"{ROW}, dense boolean").withColumn("part", F.spark_partition_id())
    first = written(first, "golden-survivors")
    parts = first.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    salts = max(1, int(np.ceil(np.sqrt(parts))))
    dense = first.where("dense").withColumn("salt", F.col("part") % salts).repartition(*CLUSTER, "salt").select(*columns)
    return first.where("not dense").select(*columns).unionByName(dense.mapInPandas(prune, ROW))


def record_counts(rows: DataFrame, stale_micros: int) -> DataFrame:
    """known, cluster, n_records, n_stale."""
    day_micros = 86_400_000_000
    timed = F.col("stamp") != NO_TIME
    slim = rows.select(*CLUSTER, "stamp", F.when(timed, F.floor(F.col("stamp") / F.lit(day_micros))).alias("day"))
    days = slim.groupBy(*CLUSTER, "day").agg(F.count(F.lit(1)).alias("n"), F.min("stamp").alias("low"), F.max("stamp").alias("high"))
    latest = F.max(F.when(F.col("day").isNotNull(), F.col("high"))).over(Window.partitionBy(*CLUSTER))  # a row a day
    marked = days.withColumn("limit", latest - stale_micros)
    before = F.when(F.col("day").isNull() | (F.col("high") < F.col("limit")), F.col("n")).otherwise(0)
    cut = F.col("day").isNotNull() & (F.col("low") < F.col("limit")) & (F.col("high") >= F.col("limit"))
    whole = marked.groupBy(*CLUSTER).agg(F.sum("n").alias("n_records"), F.sum(before).alias("sure"), F.max(F.when(cut, F.struct("day", "limit"))).alias("cut"))
    whole = written(whole, "golden-counts")
    limits = whole.where("cut is not null").select(*CLUSTER, "cut.day", "cut.limit")
    more = slim.join(limits, [*CLUSTER, "day"]).where(F.col("stamp") < F.col("limit")).groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("more"))
    return whole.join(more, CLUSTER, "left").select(*CLUSTER, "n_records", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_stale"))


def golden_records(clients: DataFrame, trust: tuple[str, ...] = TRUST, stale_hours: int = STALE_HOURS) -> DataFrame:
    """cluster_id, n_records, n_stale, the fields of each cluster's record, and the client that gave each.

    clients: client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance.
    """
    rows, stale = slim_rows(clients, trust), stale_hours * 3_600_000_000
    order = [*CLUSTER, "stamp", "client", "tie"]
    records = pruned(rows).repartition(*CLUSTER).sortWithinPartitions(*order).mapInPandas(of_clusters(stale), RECORD)
    met = records.join(record_counts(rows, stale), CLUSTER)
    given = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("name_from", "email_from", "segment_from", "balance_from", "address_from")]
    nation = F.col("nation").cast(clients.schema["nation_id"].dataType).alias("nation_id")
    return met.select(F.when(F.col("known"), F.col("cluster")).alias("cluster_id"), "n_records", "n_stale", "name", "email", "segment", "city", nation, "balance", *given)


def digests(clients: DataFrame) -> DataFrame:
    """golden_records with the balance in cents, half up."""
    records = golden_records(clients)
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long").alias("balance_cents")
    return records.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, "name_from", "email_from", "segment_from", "balance_from", "address_from")


#: DuckDB SQL of `digests`.
DIGESTS_SQL = r"""
WITH r AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id,
    coalesce(list_position(['partner', 'store', 'web', 'crm'], source), 5) AS trust,
    CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
    CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment, CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city,
    CASE WHEN isfinite(balance) THEN balance END AS balance FROM clients),
s AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id) AS recent,
    updated_at IS NULL OR updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 720 HOUR AS stale FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) AS trusted,
    first(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS chosen FROM s),
g AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale,
    arg_min({'v': name, 'c': client_id}, (-length(name), trusted)) FILTER (name IS NOT NULL) AS n,
    arg_min({'v': email, 'c': client_id}, trusted) FILTER (email IS NOT NULL) AS e,
    arg_min({'v': segment, 'c': client_id}, recent) FILTER (segment IS NOT NULL) AS s,
    arg_min({'v': balance, 'c': client_id}, (coalesce(segment <> chosen, chosen IS NOT NULL)::INT, recent)) FILTER (balance IS NOT NULL) AS b,
    arg_min({'v': city, 'w': nation_id, 'c': client_id}, ((city IS NULL)::INT + (nation_id IS NULL)::INT, trusted)) AS a FROM t GROUP BY cluster_id)
SELECT cluster_id, n_records, n_stale, n.v AS name, e.v AS email, s.v AS segment, a.v AS city, a.w AS nation_id, floor(100 * b.v + 0.5)::BIGINT AS balance_cents,
    n.c AS name_from, e.c AS email_from, s.c AS segment_from, b.c AS balance_from, CASE WHEN a.v IS NOT NULL OR a.w IS NOT NULL THEN a.c END AS address_from FROM g
"""
