"""Five activity views over Windows and Linux events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.values import contains_any, holds, non_blank, text


def is_powershell(code: Column, provider: Column, channel: Column, process: Column) -> Column:
    named = contains_any(provider, ["powershell"]) | contains_any(channel, ["powershell"]) | contains_any(process, ["powershell"])
    return holds(code.isin("4103", "4104")) | named


def summary_views(windows: DataFrame, linux: DataFrame) -> dict[str, DataFrame]:
    """auth, process, service, scheduled_task and powershell rows of both systems."""
    c = F.col
    win = windows.withColumn("src", F.lit("windows_evtx"))
    lnx = linux.withColumn("src", F.coalesce("source", F.lit("linux_event")))

    def rows(df: DataFrame, keep: Column, **columns: Column) -> DataFrame:
        return df.where(keep).select(
            "event_id", text(c("timestamp")).alias("timestamp"), c("src").alias("source"),
            *[text(v).alias(k) for k, v in columns.items()], "raw_hash", "parser_confidence",
        )

    command = F.coalesce(non_blank(c("command_line_summary")), c("object_path"))
    runs = c("process_name").isNotNull() | c("command_line_summary").isNotNull()
    auth = rows(
        win, holds(c("event_code").isin("4624", "4625")) | c("source_ip").isNotNull() | c("target_user").isNotNull(),
        user=c("user"), source_ip=c("source_ip"), target_user=c("target_user"), result=c("result"),
    ).unionByName(rows(
        lnx, holds(c("action").isin("login_success", "login_failed", "auth")) | c("src_ip").isNotNull(),
        user=c("user"), source_ip=c("src_ip"), target_user=F.lit(""), result=c("result"),
    ))
    process = rows(
        win, runs, process_name=c("process_name"), process_id=c("process_id"), parent_process_name=c("parent_process_name"),
        command_line_summary=c("command_line_summary"), user=c("user"),
    ).unionByName(rows(
        lnx, runs, process_name=c("process_name"), process_id=c("pid"), parent_process_name=c("ppid"),
        command_line_summary=c("command_line_summary"), user=c("user"),
    ))
    service = rows(
        win, c("service_name").isNotNull() | holds(c("action") == "service_install"),
        service_name=c("service_name"), action=c("action"), path=c("object_path"), user=c("user"),
    ).unionByName(rows(
        lnx, holds(c("action").isin("service_started", "service_failed")) | holds(c("unit").endswith(".service")),
        service_name=c("unit"), action=c("action"), path=c("object_path"), user=c("user"),
    ))
    task = rows(
        win, c("task_name").isNotNull() | holds(c("action").isin("scheduled_task_create", "scheduled_task_update")),
        task_name=c("task_name"), action=c("action"), command=command, user=c("user"),
    ).unionByName(rows(
        lnx, holds(c("action") == "cron"), task_name=F.lit("cron"), action=c("action"), command=c("command_line_summary"), user=c("user"),
    ))
    powershell = rows(
        win, is_powershell(c("event_code"), c("provider"), c("channel"), c("process_name")),
        script_summary=command, user=c("user"), process_id=c("process_id"),
    )
    return {"auth": auth, "process": process, "service": service, "scheduled_task": task, "powershell": powershell}
