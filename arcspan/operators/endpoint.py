"""Endpoint telemetry: normalisation, anchored process windows, window features, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import basename, coalesce_alias, entropy, to_int
from ..session import ship
from ..sinks import spool
from . import anchors, series

# Names of field aliases, programs and spawns that rules refer to.
ALIASES = {
    "timestamp": [
        "UtcTime", "@timestamp", "timestamp", "TimeCreated", "SystemTime", "time", "creation_time",
        "TimeCreated.SystemTime", "TimeCreated.@SystemTime", "TimeCreated.timestamp",
    ],
    "host": ["Computer", "host.name", "computer_name", "ComputerName", "host_name", "host"],
    "user": ["User", "user.name", "user_name", "username", "SubjectUserName", "user"],
    "provider": ["ProviderName", "provider", "event.provider", "Provider_Name", "provider_name"],
    "channel": ["Channel", "winlog.channel", "channel", "ChannelName"],
    "event_id": ["EventID", "event_id", "event.code", "EventId", "event_code"],
    "process_name": ["Image", "process.executable", "process.name", "process_name", "process_path", "SourceImage"],
    "parent_process_name": ["ParentImage", "process.parent.executable", "process.parent.name", "parent_process_name", "parent_process_path"],
    "process_id": ["ProcessId", "process.pid", "process_id", "ProcessID", "SourceProcessId", "SourceProcessID"],
    "parent_process_id": ["ParentProcessId", "process.parent.pid", "parent_process_id", "ParentProcessID"],
    "command_line": ["CommandLine", "process.command_line", "command_line", "process_command_line"],
    "parent_command_line": ["ParentCommandLine", "process.parent.command_line", "parent_command_line", "process_parent_command_line"],
    "image_path": ["Image", "process.executable", "process_path", "SourceImage"],
    "hashes": ["Hashes", "process.hash", "hashes", "process_hash"],
    "integrity_level": ["IntegrityLevel", "integrity_level", "process.integrity_level"],
    "target_process": ["TargetImage", "process.target.executable", "target_image", "process_target_image", "TargetProcessAddress"],
    "granted_access": ["GrantedAccess", "granted_access", "AccessMask", "granted_access_mask"],
    "destination_ip": ["DestinationIp", "destination.ip", "destination_ip", "DestinationIP"],
    "destination_port": ["DestinationPort", "destination.port", "destination_port", "DestinationPortValue"],
    "dns_query": ["QueryName", "dns.question.name", "dns_query", "dns_name", "QueryNameValue"],
    "registry_path": ["TargetObject", "registry.path", "registry_path", "registry_key", "TargetObjectValue"],
    "file_path": ["TargetFilename", "file.path", "file_path", "TargetFile", "TargetFilenameValue"],
    "image_loaded": ["ImageLoaded", "process.thread.image_loaded", "image_loaded"],
}
SCRIPT_INTERPRETERS = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "bash", "sh", "python.exe", "python", "perl.exe", "regini.exe"]
LOLBINS = ["certutil.exe", "rundll32.exe", "mshta.exe", "regsvr32.exe", "bitsadmin.exe", "wmic.exe", "installutil.exe", "wuauclt.exe", "mavinject.exe", "schtasks.exe", "scrcons.exe", "hh.exe", "control.exe", "explorer.exe", "verclsid.exe"]
ATTACK_PROCESSES = [
    "mimikatz.exe", "rubeus.exe", "seatbelt.exe", "dumpert.exe", "psexec.exe", "sharpview.exe", "sharpsc.exe", "msfvenom.exe", "installutil.exe",
    "mshta.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "wmic.exe",
]
COMMON_SPAWNS = [
    ("explorer.exe", "chrome.exe"), ("explorer.exe", "iexplore.exe"), ("explorer.exe", "explorer.exe"), ("services.exe", "svchost.exe"), ("services.exe", "spoolsv.exe"),
    ("smss.exe", "csrss.exe"), ("smss.exe", "wininit.exe"), ("wininit.exe", "services.exe"), ("wininit.exe", "lsass.exe"),
]


def normalize(df: DataFrame, record: str = "record") -> DataFrame:
    """Canonical fields of raw records (a map of strings), and why a record is discarded.

    The first alias that a record holds counts, a plain one even if its value is null. `reason` is
    null for good events.
    """
    r = F.col(record)
    out = df.select("*", *[coalesce_alias(r, names).alias(f"n_{field}") for field, names in ALIASES.items()])
    time = F.coalesce(F.col("n_timestamp").try_cast("timestamp"), F.try_to_timestamp(F.col("n_timestamp")))
    plain = {f: F.col(f"n_{f}") for f in ALIASES}
    plain |= {f: basename(plain[f]) for f in ("process_name", "parent_process_name", "target_process")}
    plain |= {"timestamp": time} | {f: to_int(plain[f]) for f in ("process_id", "parent_process_id", "destination_port")}
    out = out.withColumns(plain).drop(*[f"n_{f}" for f in ALIASES])
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    reason = F.when(missing("timestamp"), "missing_timestamp").when(missing("host"), "missing_host").when(missing("event_id"), "missing_event_id")
    return out.withColumn("reason", reason)


def window_starts(times: DataFrame, key: str, us: str, width_us: int) -> DataFrame:
    """Rows key, us, window_index: where each key's anchored windows start.

    A key's times are sorted by Spark and pass as a stream of batches; only the current window's
    start is held, and each window costs one search in its batch, however many events it has.
    """
    ship(times.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, index = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            keys, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(t)]
            found: list[tuple[str, int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                at = a
                if keys[a] != last:
                    last, start, index = keys[a], int(t[a]), 0
                    found.append((last, start, index))
                while (at := at + int(np.searchsorted(t[at:b], start + width_us, "right"))) < b:
                    start, index = int(t[at]), index + 1
                    found.append((last, start, index))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32())], [key, us, "window_index"])

    sorted_ = times.select(F.col(key), F.col(us).cast("long").alias(us)).repartition(key).sortWithinPartitions(key, us)
    return sorted_.mapInArrow(run, f"{key} string, {us} long, window_index int")


def anchored_windows(df: DataFrame, keys: list[str], us: str, width_us: int) -> DataFrame:
    """`df` with window_index and window_start: windows anchored at their first event.

    An event more than `width_us` after its window's first event opens the next one; exactly at the
    width it still belongs. Rows without a time are left out. The starts are found on times alone, those of
    a key that is spread over several tasks by `anchors`; rows then get theirs by a sorted sweep over
    rows and starts, the last start carried on, so nothing of a key is gathered, however busy it is.
    """
    rows = df.filter(F.col(us).isNotNull()).withColumn("_us", F.col(us).cast("long"))
    parts = series.cut(rows, keys, ["_us"])
    columns = [*df.columns, "window_index", "window_start"]
    if getattr(parts, "whole", False):
        return _swept(parts, _own_starts(parts, width_us)).select(columns)
    # Ranges cut fewer keys than there are partitions.
    shared = F.broadcast(spool(parts.groupBy(series.KEY).agg(F.min(series.PART).alias("a"), F.max(series.PART).alias("b")).filter("a < b").select(series.KEY)))
    few, busy = parts.join(shared, series.KEY, "left_anti"), parts.join(shared, series.KEY, "left_semi")
    times = busy.select(series.KEY, series.PART, F.col("_us").alias("us")).distinct()
    return _swept(few, _own_starts(few, width_us)).unionByName(_swept(busy, anchors.starts(times, width_us))).select(columns)


def _own_starts(parts: DataFrame, width_us: int) -> DataFrame:
    """The windows of keys that are one segment each, as `anchors.starts` has them."""
    found = window_starts(parts.select(series.KEY, "_us"), series.KEY, "_us", width_us)
    part = parts.groupBy(series.KEY).agg(F.first(series.PART).alias(series.PART)) if not getattr(parts, "whole", False) else None
    found = found.withColumn(series.PART, F.lit(0)) if part is None else found.join(part, series.KEY)
    return found.select(series.KEY, series.PART, F.col("_us").alias("at"), F.col("_us").alias("window_start"), "window_index")


def _swept(parts: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of segments with the window that is open at their time."""
    starts = starts.select(series.KEY, series.PART, F.col("at").alias("_us"), F.lit(0).alias("_row"), "window_start", "window_index")
    both = parts.withColumn("_row", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    upto = Window.partitionBy(series.KEY, series.PART).orderBy("_us", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, True).over(upto) for c in ("window_index", "window_start")}).filter("_row = 1")


def describe_windows(df: DataFrame, keys: list[str], us: str, tie: str, parent: str) -> DataFrame:
    """One row per window: first parent, start, end, number of events."""
    order = F.struct(us, tie)
    return df.groupBy(*keys, "window_index").agg(F.min_by(parent, order).alias("parent_process"), F.min(us).alias("window_start"), F.max(us).alias("window_end"), F.count("*").alias("event_count"))


def window_features(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The features of each window of endpoint events, in one aggregation.

    Columns used: event_id, process_name, parent_process_name, command_line, destination_ip,
    destination_port, image_loaded, granted_access, target_process, integrity_level, user.
    """
    eid = F.col("event_id")
    one = lambda c: F.count_if(c).cast("double")
    distinct = lambda c, when: F.count_distinct(F.when(when, F.col(c))).cast("double")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    image = F.lower(F.coalesce(F.col("image_loaded"), F.lit("")))
    rare = F.lit(False)
    for part in ("\\temp\\", "\\public\\", "\\appdata\\", "\\users\\"):
        rare = rare | image.contains(part)
    out = df.groupBy(*keys).agg(
        F.count("*").cast("double").alias("event_count"),
        F.min_by("process_name", order).alias("process"),
        F.min_by("parent_process_name", order).alias("parent_process"),
        F.min_by(F.col("command_line"), F.when(has("command_line"), order)).alias("_command"),
        one(eid == "1").alias("child_process_count"),
        distinct("process_name", (eid == "1") & has("process_name")).alias("unique_child_processes"),
        one(eid == "3").alias("network_connection_count"),
        distinct("destination_ip", (eid == "3") & has("destination_ip")).alias("unique_destination_count"),
        distinct("destination_port", eid == "3").alias("destination_port_count"),
        one(eid == "22").alias("dns_query_count"),
        one(eid.isin("12", "13", "14")).alias("registry_modification_count"),
        one(eid.isin("12", "13")).alias("registry_create_count"),
        one(eid == "11").alias("file_create_count"),
        one(eid == "7").alias("image_load_count"),
        one((eid == "7") & rare).alias("rare_image_load_count"),
        one(eid == "8").alias("remote_thread_count"),
        one(eid == "10").alias("process_access_count"),
        one((eid == "10") & F.lower(F.coalesce(F.col("target_process"), F.lit(""))).contains("lsass")).alias("lsass_access_count"),
        F.coalesce(F.max(F.when((eid == "10") & has("granted_access"), entropy(F.col("granted_access")))), F.lit(0.0)).alias("granted_access_entropy"),
        (F.count_distinct(F.when(has("integrity_level"), F.col("integrity_level"))) > 1).cast("double").alias("integrity_level_change"),
        distinct("user", has("user")).alias("cross_user_process_count"),
    )
    command, process, parent = F.coalesce("_command", F.lit("")), F.lower(F.coalesce("process", F.lit(""))), F.lower(F.coalesce("parent_process", F.lit("")))
    low = F.lower(command)
    any_of = lambda text, parts: F.coalesce(*[F.when(text.contains(p), 1.0) for p in parts], F.lit(0.0))
    spawn = F.lit(False)
    for a, b in COMMON_SPAWNS:
        spawn = spawn | ((parent == a) & (process == b))
    return out.withColumns({
        "process_depth": F.when(parent != "", 2.0).otherwise(1.0),
        "parent_child_rarity": F.when(spawn, 0.0).otherwise(1.0),
        "command_length": F.length(command).cast("double"),
        "command_token_count": F.when(F.trim(command) == "", 0.0).otherwise(F.size(F.split(F.trim(command), r"\s+")).cast("double")),
        "encoded_command_flag": any_of(low, ["-enc", "-encodedcommand", "base64", "-e "]),
        "powershell_flag": F.greatest(any_of(process, ["powershell", "pwsh"]), any_of(low, ["powershell", "pwsh"])),
        "script_interpreter_flag": process.isin(SCRIPT_INTERPRETERS).cast("double"),
        "lolbin_flag": process.isin(LOLBINS).cast("double"),
    }).drop("_command")


def parent_child_frequency(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """How often each window's own parent and process occur together in its events."""
    own = df.groupBy(*keys).agg(F.lower(F.min_by("process_name", order)).alias("_c"), F.lower(F.min_by("parent_process_name", order)).alias("_p"))
    same = (F.lower("process_name") == F.col("_c")) & (F.lower("parent_process_name") == F.col("_p"))
    return df.join(own, keys).groupBy(*keys).agg(F.count_if(same).cast("double").alias("parent_child_frequency"))


def all_features(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """`window_features` and the frequency of each window's own parent and child: all 26 features."""
    return window_features(df, keys, order).join(parent_child_frequency(df, keys, order), keys)


def rule_field(columns: list[str], record: str | None = None) -> Callable[[str], Column]:
    """How rules find a field: a key of the raw record (a map of strings) whatever its case, else the
    canonical column that has the name as an alias, whatever its case; null without either."""
    there = set(columns)

    def get(name: str) -> Column:
        low = name.lower()
        known = [F.col(field).cast("string") for field, names in ALIASES.items() if field in there and low in [n.lower() for n in names]]
        known += [F.col(c).cast("string") for c in columns if c.lower() == low and c not in ALIASES]
        if record is None:
            return F.coalesce(*known, F.lit(None).cast("string"))
        held = F.filter(F.map_entries(F.col(record)), lambda e: F.lower(e["key"]) == low)
        return F.when(F.size(held) > 0, F.get(held, F.lit(0))["value"]).otherwise(F.coalesce(*known, F.lit(None).cast("string")))

    return get


def heuristic_label(attack_processes: list[str] | None = None) -> Column:
    """Whether a window's features look malicious: any of six signs."""
    f = F.col
    long_powershell = (f("powershell_flag") > 0) & (f("command_length") > 150)
    out = F.lower(F.coalesce("process", F.lit(""))).isin(attack_processes or ATTACK_PROCESSES) | long_powershell
    for sign in ("lsass_access_count", "remote_thread_count", "encoded_command_flag", "rare_image_load_count"):
        out = out | (f(sign) > 0)
    return out.cast("int")


def fuse(score: Column, severities: Column) -> Column:
    """Risk, severity and confidence from a model's score and the severities of matched rules."""
    strong = F.exists(severities, lambda s: s.isin("high", "critical", "medium"))
    some = F.size(severities) > 0
    made = lambda risk, severity, confidence: F.struct(risk.alias("risk_score"), severity.alias("severity"), F.lit(confidence).alias("confidence"))
    lit = F.lit
    return (
        F.when((score >= 0.75) & strong, made(F.greatest(score, lit(0.95)), lit("critical"), 0.95))
        .when(score >= 0.75, made(score, F.when(score >= 0.85, "high").otherwise("medium"), 0.75))
        .when(strong, made(lit(0.80), lit("medium"), 0.80))
        .when(some, made(F.greatest(score, lit(0.50)), lit("low"), 0.60))
        .otherwise(made(score, lit("low"), 0.50))
    )


#: Feature, bound that it must exceed, reason (fixed values).
REASONS = [
    ("encoded_command_flag", 0.0, "Encoded command execution observed"),
    ("powershell_flag", 0.0, "PowerShell execution detected"),
    ("lsass_access_count", 0.0, "LSASS memory access observed"),
    ("remote_thread_count", 0.0, "CreateRemoteThread injection behaviour"),
    ("lolbin_flag", 0.0, "Suspicious LOLBin executable usage"),
    ("child_process_count", 5.0, "High process fan-out rate"),
    ("parent_child_rarity", 0.5, "Rare parent-child execution relationship"),
    ("registry_modification_count", 10.0, "High registry modification rate"),
    ("network_connection_count", 5.0, "High volume of outgoing network connections"),
]


def reasons(columns: list[str], rules: Column | None = None) -> Column:
    """The reasons whose features exceed their bound, then matched rules; each once."""
    found = F.array_compact(F.array(*[F.when(F.col(c) > bound, text) for c, bound, text in REASONS if c in columns]))
    return F.array_distinct(found if rules is None else F.concat(found, rules))


def contract_check(df: DataFrame, contract: dict[str, str]) -> list[str]:
    """What a frame lacks of a feature contract (name to type), from its schema alone."""
    there = dict(df.dtypes)
    return [f"missing {c}" for c in contract if c not in there] + [f"{c} is {there[c]}, not {kind}" for c, kind in contract.items() if c in there and there[c] != kind]


def field_availability(df: DataFrame) -> DataFrame:
    """Each column's share of non-null rows and its rating, in one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])
    long = shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in df.columns])).alias("x")).select("x.*")
    return long.withColumn("rating", F.when(F.col("share") >= 0.8, "available").when(F.col("share") >= 0.2, "partial").otherwise("unavailable"))


def provider_counts(df: DataFrame, provider: str, n: int = 10) -> DataFrame:
    """The most frequent providers and how often they occur, ties by name (a report of `n`)."""
    return df.groupBy(F.col(provider).alias("provider")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "provider").limit(n)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with each row's place within its key."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
