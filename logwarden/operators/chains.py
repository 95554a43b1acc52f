"""Process relation graphs per window and host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import field, first_present, strip
from logwarden.functions.times import as_timestamp, bucket, bucket_start, iso_text, micros

SYSMON_PROVIDER = "Microsoft-Windows-Sysmon"
_CELL = ["window_start", "host"]


def process_rows(df: DataFrame, minutes: int = 10, id_col: str = "id", ts_col: str = "ts") -> DataFrame:
    """Sysmon rows with host and window, the input of both trees."""
    host = first_present(field(df, "agent_host"), field(df, "computer_0"), F.lit("unknown"))
    names = {
        "event_id": "eventid_0", "guid": "processguid_2", "parent": "parentprocessguid_2", "pid": "processid_2",
        "parent_pid": "parentprocessid_2", "from_guid": "sourceprocessguid_2", "from_pid": "sourceprocessid_2",
        "to_guid": "targetprocessguid_2", "to_pid": "targetprocessid_2",
    }
    trimmed = {"event_id", "guid", "parent", "from_guid", "to_guid"}
    return df.filter(field(df, "providername_0") == SYSMON_PROVIDER).select(
        bucket_start(bucket(ts_col, minutes * 60), minutes * 60).alias("window_start"),
        host.alias("host"), as_timestamp(ts_col).alias("ts"), F.col(id_col).alias("id"),
        *[(strip(field(df, c)) if n in trimmed else field(df, c)).alias(n) for n, c in names.items()],
    )


def _nodes(rows: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column]) -> DataFrame:
    """Node per GUID: last time seen, process id of the row that made it.

    Each argument is (guid, process id); the first one of a row is made first.
    """
    pieces = F.array(*[
        F.struct(guid.alias("guid"), pid.alias("process_id"), F.lit(i).alias("i"))
        for i, (guid, pid) in enumerate((first, second))
    ])
    seen = rows.select(*_CELL, "ts", "id", F.explode(pieces).alias("n")).filter(F.col("n.guid") != "")
    return seen.groupBy(*_CELL, F.col("n.guid").alias("guid")).agg(
        F.max("ts").alias("last_seen"),
        F.min_by("n.process_id", F.struct(micros("ts"), F.col("id"), F.col("n.i"))).alias("process_id"),
    )


def _neighbours(rows: DataFrame, node: Column, other: Column, name: str) -> DataFrame:
    """Distinct neighbours in order of first appearance.

    Repeated edges are reduced to one row before anything is collected.
    """
    edges = rows.filter((node != "") & (other != "")).groupBy(
        *_CELL, node.alias("guid"), other.alias("other")
    ).agg(F.min(F.struct(micros("ts"), F.col("id"))).alias("o"))
    return edges.groupBy(*_CELL, "guid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "other"))), lambda s: s["other"]).alias(name)
    )


def creation_nodes(rows: DataFrame) -> DataFrame:
    """Creation tree: every process of any event, parents from creation events."""
    create = F.col("event_id") == "1"
    parent = F.when(create, F.col("parent")).otherwise("")
    nodes = _nodes(rows, (F.col("guid"), F.col("pid")), (parent, F.col("parent_pid")))
    created = rows.filter(create)
    children = _neighbours(created, F.col("parent"), F.col("guid"), "children")
    parents = _neighbours(created, F.col("guid"), F.col("parent"), "parents")
    key = [*_CELL, "guid"]
    return nodes.join(children, key, "left").join(parents, key, "left")


def source_target_nodes(rows: DataFrame) -> DataFrame:
    """Source-target tree of remote-thread and process-access events."""
    linked = rows.filter(F.col("event_id").isin("8", "10"))
    nodes = _nodes(linked, (F.col("from_guid"), F.col("from_pid")), (F.col("to_guid"), F.col("to_pid")))
    outgoing = _neighbours(linked, F.col("from_guid"), F.col("to_guid"), "outgoing")
    incoming = _neighbours(linked, F.col("to_guid"), F.col("from_guid"), "incoming")
    key = [*_CELL, "guid"]
    return nodes.join(outgoing, key, "left").join(incoming, key, "left")


def _chain(nodes: DataFrame, hosts: DataFrame, kind: str, lists: tuple[str, str]) -> DataFrame:
    node = F.struct(iso_text("last_seen").alias("last_seen"), "process_id", *lists)
    entries = F.array_sort(F.collect_list(F.struct(F.col("guid"), node.alias("node"))))
    graph = nodes.groupBy(*_CELL).agg(
        F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("chain_json"),
        F.count("*").alias("nodes"),
    )
    return hosts.join(graph, _CELL, "left").select(
        *_CELL, F.lit(kind).alias("chain_type"), F.coalesce("chain_json", F.lit("{}")).alias("chain_json"),
        F.coalesce("nodes", F.lit(0)).alias("nodes"),
    )


def process_chains(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per window, host and chain type with the graph as JSON.

    Only the (window, host) pairs of ``hosts`` are built; a host without rows
    gets an empty graph.
    """
    wanted = hosts.select(*_CELL).filter(F.col("host") != "").distinct()
    scoped = rows.join(wanted, _CELL, "left_semi")
    trees = _chain(creation_nodes(scoped), wanted, "creation_tree", ("children", "parents")).unionByName(
        _chain(source_target_nodes(scoped), wanted, "source_target_tree", ("outgoing", "incoming"))
    )
    return trees.withColumn("stats_json", F.to_json(F.struct("nodes")))
