"""Container inventories from Docker, containerd and Kubernetes metadata files.

Inputs are whole files ``(source_file, text)``. Results: containers, mounts, networks, images.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions.values import holds, let, sorted_join, text
from tracelight.sources.jsonfields import json_map

# Host paths whose mount is sensitive, and web roots.
SENSITIVE_PATHS = ["/var/run/docker.sock", "/run/containerd/containerd.sock", "/proc", "/sys", "/etc", "/root", "/var/lib/docker",
                   "/var/lib/kubelet", "/host"]
WEB_ROOTS = ["/var/www", "/usr/share/nginx/html", "/usr/local/tomcat/webapps", "/app/public", "/inetpub/wwwroot"]
CONTAINER_COLUMNS = ["container_id", "container_name", "runtime", "image", "image_id", "pod_name", "namespace", "process_id",
                     "created_at", "started_at", "is_privileged", "host_pid", "host_network", "risk_flags", "source_file"]
MOUNT_COLUMNS = ["container_id", "container_name", "source", "destination", "mode", "is_sensitive", "risk_flags"]


@dataclass(frozen=True)
class ContainerInventory:
    containers: DataFrame
    mounts: DataFrame
    networks: DataFrame
    images: DataFrame
    rejects: DataFrame


def _mentions(value: Column, needles: list[str]) -> Column:
    lowered = F.lower(F.replace(text(value), F.lit("\\"), F.lit("/")))
    result = F.lit(False)
    for needle in needles:
        result = result | lowered.contains(needle)
    return result


def mount_flags(source: Column, destination: Column, mode: Column) -> Column:
    """sensitive_mount, web_root_mount and writable_mount, sorted."""
    sensitive = _mentions(F.concat_ws(" ", source, destination), SENSITIVE_PATHS)
    into_web = _mentions(destination, WEB_ROOTS)
    web = into_web | _mentions(source, WEB_ROOTS)
    writable = ~F.lower(text(mode)).contains("ro") & (sensitive | into_web)
    return sorted_join([F.when(sensitive, F.lit("sensitive_mount")), F.when(web, F.lit("web_root_mount")), F.when(writable, F.lit("writable_mount"))])


def container_flags(privileged: Column, host_pid: Column, host_network: Column) -> Column:
    return sorted_join([F.when(privileged, F.lit("privileged")), F.when(host_pid, F.lit("host_pid")), F.when(host_network, F.lit("host_network"))])


def _get(doc: str, *paths: str) -> Column:
    """First JSON path of a text column holding a non-blank scalar."""
    return F.coalesce(*[let(F.trim(F.get_json_object(doc, p)), lambda v: F.when((v != "") & ~v.rlike(r"^[\[{]"), v)) for p in paths])


def _bool(doc: str, *paths: str) -> Column:
    return holds(F.lower(_get(doc, *paths)) == "true")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole small files as ``(source_file, text)``."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def _mounts(df: DataFrame) -> DataFrame:
    """Shape ``source, destination, mode`` rows that carry their container."""
    kept = df.where((text(F.col("source")) != "") | (text(F.col("destination")) != ""))
    flagged = kept.withColumn("risk_flags", mount_flags(F.col("source"), F.col("destination"), F.col("mode")))
    return flagged.withColumn("is_sensitive", F.col("risk_flags").contains("sensitive_mount")).select(
        "container_id", "container_name", text(F.col("source")).alias("source"), text(F.col("destination")).alias("destination"),
        text(F.col("mode")).alias("mode"), "is_sensitive", "risk_flags")


def _images(containers: DataFrame) -> DataFrame:
    rows = containers.where((F.col("image") != "") | (F.col("image_id") != ""))
    return rows.select("image", "image_id", "created_at", F.when(F.col("image") != "", F.array("image")).otherwise(F.array().cast("array<string>")).alias("repo_tags")).distinct()


def _host_networks(containers: DataFrame) -> DataFrame:
    return containers.where("host_network").select(
        "container_id", "container_name", F.lit("host").alias("network"), F.lit("").alias("ip_address"), F.lit("").alias("ports"),
        F.lit(True).alias("host_network"), F.lit("host_network").alias("risk_flags"))


def _rejects(df: DataFrame, parser: str, message: str) -> DataFrame:
    return df.select("source_file", F.lit(0).cast("bigint").alias("line_number"), F.lit(parser).alias("parser_name"), F.lit(message).alias("message"))


def parse_docker(files: DataFrame) -> ContainerInventory:
    """Docker ``config.v2.json`` and inspect files."""
    is_json = json_map(F.col("text")).isNotNull()
    docs = files.where(is_json)
    folder = F.element_at(F.split("source_file", r"[/\\]"), -2)
    c = docs.select(
        "source_file", F.col("text").alias("doc"), F.coalesce(_get("text", "$.ID"), folder, F.lit("")).alias("container_id"),
        F.ltrim(F.coalesce(_get("text", "$.Name", "$.Config.Hostname"), F.lit("")), F.lit("/")).alias("container_name"),
        F.lit("docker").alias("runtime"), F.coalesce(_get("text", "$.Config.Image", "$.ImageName"), F.lit("")).alias("image"),
        F.coalesce(_get("text", "$.Image"), F.lit("")).alias("image_id"), F.lit(None).cast("string").alias("pod_name"),
        F.lit(None).cast("string").alias("namespace"), _get("text", "$.State.Pid").alias("process_id"), _get("text", "$.Created").alias("created_at"),
        _get("text", "$.State.StartedAt").alias("started_at"), _bool("text", "$.HostConfig.Privileged").alias("is_privileged"),
        holds(_get("text", "$.HostConfig.PidMode").contains("host")).alias("host_pid"),
        holds(_get("text", "$.HostConfig.NetworkMode").contains("host")).alias("host_network"),
    )
    c = c.withColumn("risk_flags", container_flags(F.col("is_privileged"), F.col("host_pid"), F.col("host_network")))
    points = F.map_values(F.from_json(F.get_json_object("doc", "$.MountPoints"), "map<string,string>"))
    listed = F.from_json(F.get_json_object("doc", "$.Mounts"), "array<string>")
    m = c.select("container_id", "container_name", F.explode(F.concat(F.coalesce(points, F.array()), F.coalesce(listed, F.array()))).alias("m"))
    rw = F.lower(_get("m", "$.RW"))
    mounts = _mounts(m.select(
        "container_id", "container_name", _get("m", "$.Source").alias("source"), _get("m", "$.Destination", "$.DestinationPath").alias("destination"),
        F.coalesce(_get("m", "$.Mode"), F.when(rw == "true", "rw").when(rw.isNotNull(), "ro")).alias("mode")))
    bindings = F.from_json(F.get_json_object("doc", "$.NetworkSettings.Ports"), "map<string,array<struct<HostIp:string,HostPort:string>>>")
    port_texts = F.flatten(F.transform(F.map_entries(bindings), lambda e: F.when(e["value"].isNull(), F.array(e["key"])).otherwise(
        F.transform(e["value"], lambda b: F.concat(text(b["HostIp"]), F.lit(":"), text(b["HostPort"]), F.lit("->"), e["key"])))))
    ports = F.coalesce(F.array_join(port_texts, ";"), F.lit(""))
    attached = F.from_json(F.get_json_object("doc", "$.NetworkSettings.Networks"), "map<string,struct<IPAddress:string>>")
    networks = c.select("container_id", "container_name", ports.alias("ports"), F.explode(attached).alias("network", "n")).select(
        "container_id", "container_name", "network", text(F.col("n.IPAddress")).alias("ip_address"), "ports", F.lit(False).alias("host_network"), F.lit("").alias("risk_flags"))
    host = c.where("host_network").select(
        "container_id", "container_name", F.lit("host").alias("network"), F.lit("").alias("ip_address"), ports.alias("ports"),
        F.lit(True).alias("host_network"), F.lit("host_network").alias("risk_flags"))
    containers = c.select(*CONTAINER_COLUMNS)
    return ContainerInventory(containers, mounts, networks.unionByName(host), _images(containers),
                              _rejects(files.where(~is_json), "docker_config", "invalid Docker config JSON"))


def parse_docker_images(files: DataFrame) -> DataFrame:
    """Image metadata files: one object or an array of objects."""
    items = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    docs = files.select(F.explode(items).alias("d"))
    tags = F.from_json(F.get_json_object("d", "$.RepoTags"), "array<string>")
    shaped = docs.select(
        F.coalesce(F.get(tags, F.lit(0)), _get("d", "$.image"), F.lit("")).alias("image"), F.coalesce(_get("d", "$.id", "$.Id", "$.ID"), F.lit("")).alias("image_id"),
        _get("d", "$.created", "$.Created").alias("created_at"), F.when(_get("d", "$.Size").rlike(r"^\d{1,18}$"), _get("d", "$.Size").cast("bigint")).alias("size"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("repo_tags"), F.coalesce(_get("d", "$.Digest"), F.get_json_object("d", "$.RepoDigests[0]")).alias("digest"))
    return shaped.where((F.col("image_id") != "") | (F.col("image") != ""))


def parse_containerd(files: DataFrame) -> ContainerInventory:
    """containerd metadata: a ``containers`` list or one container object."""
    is_json = json_map(F.col("text")).isNotNull()
    many = F.from_json(F.get_json_object("text", "$.containers"), "array<string>")
    items = F.when(many.isNotNull(), many).otherwise(F.when(_get("text", "$.id", "$.metadata.id").isNotNull(), F.array("text")))
    d = files.where(is_json).select("source_file", F.explode(items).alias("d"))
    labels = F.from_json(F.get_json_object("d", "$.labels"), "map<string,string>")
    label = lambda k: F.try_element_at(labels, F.lit(k))
    e = lambda *p: F.coalesce(_get("d", *p), F.lit(""))
    c = d.select(
        "source_file", "d", e("$.id", "$.ID", "$.metadata.id").alias("container_id"), e("$.name", "$.metadata.name").alias("container_name"),
        F.lit("containerd").alias("runtime"), e("$.image", "$.Image", "$.spec.image").alias("image"), e("$.image_id", "$.imageID").alias("image_id"),
        label("io.kubernetes.pod.name").alias("pod_name"), label("io.kubernetes.pod.namespace").alias("namespace"), _get("d", "$.pid").alias("process_id"),
        _get("d", "$.created_at", "$.createdAt").alias("created_at"), _get("d", "$.started_at", "$.startedAt").alias("started_at"),
        (_bool("d", "$.privileged") | _bool("d", "$.spec.linux.security_context.privileged")).alias("is_privileged"),
        (_bool("d", "$.host_pid") | _bool("d", "$.hostPID")).alias("host_pid"), (_bool("d", "$.host_network") | _bool("d", "$.hostNetwork")).alias("host_network"))
    c = c.withColumn("risk_flags", container_flags(F.col("is_privileged"), F.col("host_pid"), F.col("host_network")))
    lists = [F.coalesce(F.from_json(F.get_json_object("d", p), "array<string>"), F.array()) for p in ("$.mounts", "$.Mounts", "$.spec.mounts")]
    m = c.select("container_id", "container_name", F.explode(F.concat(*lists)).alias("m"))
    mounts = _mounts(m.select(
        "container_id", "container_name", _get("m", "$.source", "$.Source").alias("source"),
        _get("m", "$.destination", "$.Destination", "$.containerPath").alias("destination"), _get("m", "$.options", "$.mode").alias("mode")))
    containers = c.select(*CONTAINER_COLUMNS)
    return ContainerInventory(containers, mounts, _host_networks(containers), _images(containers),
                              _rejects(files.where(~is_json), "containerd_metadata", "invalid containerd JSON"))


def _yaml_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each YAML document of each file as JSON text; an unreadable document becomes an error row."""
    import yaml

    def split(body: str) -> list[str]:
        docs, current = [], []
        for line in body.splitlines():
            if line.rstrip() == "---" or line.startswith("--- "):
                docs.append("\n".join(current))
                current = [line[4:]] if line.startswith("--- ") else []
            else:
                current.append(line)
        docs.append("\n".join(current))
        return docs

    for batch in batches:
        rows = []
        for source_file, body in zip(batch["source_file"], batch["text"]):
            for number, part in enumerate((d for d in split(body or "") if d.strip()), 1):
                try:
                    value = yaml.safe_load(part)
                    rows.append((source_file, number, json.dumps(value, default=str), None))
                except yaml.YAMLError as error:
                    rows.append((source_file, number, None, f"YAML document could not be parsed structurally: {str(error)[:200]}"))
        yield pd.DataFrame(rows, columns=["source_file", "doc_number", "doc", "error"])


def manifest_documents(files: DataFrame) -> DataFrame:
    """Kubernetes manifests as one JSON document per row ``(source_file, doc_number, doc, error)``; lists are unpacked."""
    schema = "source_file string, doc_number int, doc string, error string"
    is_json = F.ltrim("text").startswith("{")
    as_json = files.where(is_json).select("source_file", F.lit(1).alias("doc_number"), F.when(json_map(F.col("text")).isNotNull(), F.col("text")).alias("doc"))
    as_json = as_json.withColumn("error", F.when(F.col("doc").isNull(), F.lit("invalid JSON manifest")))
    docs = files.where(~is_json).select("source_file", "text").mapInPandas(_yaml_documents, schema).unionByName(as_json)
    items = F.from_json(F.get_json_object("doc", "$.items"), "array<string>")
    return docs.withColumn("doc", F.explode_outer(F.when(items.isNotNull(), items).otherwise(F.array("doc"))))


def parse_k8s(files: DataFrame) -> ContainerInventory:
    """Pods and pod templates: host path volumes are paired with mounts by volume name; unmounted ones are kept."""
    docs = manifest_documents(files)
    bad = docs.where(F.col("error").isNotNull()).select(
        "source_file", F.col("doc_number").cast("bigint").alias("line_number"), F.lit("kubernetes_yaml").alias("parser_name"), F.col("error").alias("message"))
    own, templated = F.get_json_object("doc", "$.spec"), F.get_json_object("doc", "$.spec.template.spec")
    has = lambda spec: F.get_json_object(spec, "$.containers").startswith("[")
    good = docs.where(F.col("error").isNull() & F.col("doc").isNotNull()).withColumn("meta", F.get_json_object("doc", "$.metadata")).withColumn(
        "spec", F.when(has(own), own).when(has(templated), templated))
    declared = _get("doc", "$.kind") == "Pod"
    broken = good.where(holds(declared) & (F.col("spec").isNull() | F.col("meta").isNull())).select(
        "source_file", F.lit(0).cast("bigint").alias("line_number"), F.lit("kubernetes_yaml").alias("parser_name"),
        F.when(F.col("meta").isNull(), "Pod document has no metadata mapping").when(own.isNull(), "Pod document has no spec mapping")
        .otherwise("Pod document has no spec.containers sequence").alias("message"))
    pods = good.where(F.col("spec").isNotNull() & F.col("meta").isNotNull()).select(
        "source_file", "spec", _get("meta", "$.namespace").alias("namespace"), _get("meta", "$.name").alias("pod_name"),
        _get("meta", "$.creationTimestamp").alias("created_at"), _get("spec", "$.nodeName").alias("node"), _bool("spec", "$.hostPID").alias("host_pid"),
        _bool("spec", "$.hostNetwork").alias("host_network"), F.from_json(F.get_json_object("spec", "$.containers"), "array<string>").alias("items"),
        F.from_json(F.get_json_object("spec", "$.volumes"), "array<struct<name:string,hostPath:struct<path:string>>>").alias("vols"),
    ).withColumn("base", F.concat(F.lit("k8s-"), F.coalesce("namespace", F.lit("default")), F.lit("-"), text(F.col("pod_name"))))
    host_paths = F.filter(F.coalesce("vols", F.array()), lambda v: v["hostPath"]["path"].isNotNull() & v["name"].isNotNull())
    privileged_names = F.transform(
        F.filter("items", lambda i: holds(F.lower(F.get_json_object(i, "$.securityContext.privileged")) == "true")),
        lambda i: text(F.get_json_object(i, "$.name")))
    pods = pods.withColumn("hp", host_paths).withColumn("priv", F.array_join(privileged_names, ","))
    c = pods.withColumn("c", F.explode("items")).withColumn("container_name", F.coalesce(_get("c", "$.name"), F.lit("")))
    c = c.withColumn("is_privileged", _bool("c", "$.securityContext.privileged")).withColumn("container_id", F.concat("base", F.lit("-"), "container_name"))
    flags = F.concat_ws(
        ";", F.when(container_flags(F.col("is_privileged"), F.col("host_pid"), F.col("host_network")) != "",
                    container_flags(F.col("is_privileged"), F.col("host_pid"), F.col("host_network"))),
        F.concat(F.lit("node:"), "node"), F.when(F.col("priv") != "", F.concat(F.lit("pod_privileged_containers="), "priv")))
    null = F.lit(None).cast("string")
    containers = c.select(
        "container_id", "container_name", F.lit("kubernetes").alias("runtime"), F.coalesce(_get("c", "$.image"), F.lit("")).alias("image"),
        F.lit("").alias("image_id"), "pod_name", "namespace", null.alias("process_id"), "created_at", null.alias("started_at"), "is_privileged",
        "host_pid", "host_network", flags.alias("risk_flags"), "source_file")
    used = F.from_json(F.get_json_object("c", "$.volumeMounts"), "array<struct<name:string,mountPath:string>>")
    m = c.select("container_id", "container_name", "hp", F.explode(used).alias("u"))
    source = let(F.get(F.filter("hp", lambda v: v["name"] == F.col("u.name")), F.lit(0)), lambda v: v["hostPath"]["path"])
    mounted = m.withColumn("source", source).where(F.col("source").isNotNull()).select(
        "container_id", "container_name", "source", F.coalesce("u.mountPath", "source").alias("destination"), F.lit("rw").alias("mode"))
    names = F.array_distinct(F.flatten(F.transform("items", lambda i: F.coalesce(F.transform(
        F.from_json(F.get_json_object(i, "$.volumeMounts"), "array<struct<name:string>>"), lambda u: u["name"]), F.array().cast("array<string>")))))
    idle = pods.withColumn("mounted", names).withColumn("v", F.explode("hp")).where(~F.array_contains("mounted", F.col("v.name"))).select(
        F.col("base").alias("container_id"), text(F.col("pod_name")).alias("container_name"), F.col("v.hostPath.path").alias("source"),
        F.col("v.hostPath.path").alias("destination"), F.lit("rw").alias("mode"))
    return ContainerInventory(containers, _mounts(mounted.unionByName(idle)), _host_networks(containers), _images(containers), bad.unionByName(broken))
