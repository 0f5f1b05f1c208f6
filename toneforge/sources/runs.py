"""Run folders and their artifacts, pins and manifests, through the file system that Spark has for a path."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..operators.corpus import CorpusViolation
from .files import artifact


def _file(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or, on one machine where that is unset, its temp folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/toneforge-checkpoints"
    return f"{path.rstrip('/')}/toneforge/{tag}-{uuid.uuid4().hex}"


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")


def unique_run_dir(spark: SparkSession, root: str, name: str) -> str:
    """root/name, or with the first free number after it, made now: the folder is the caller's alone."""
    fs, _ = _file(spark, root)
    k = 0
    while True:
        path = f"{root.rstrip('/')}/{name}" + (f"-{k}" if k else "")
        own = _file(spark, path)[1]
        if not fs.exists(own) and fs.mkdirs(own):
            return path
        k += 1


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file; an existing one is refused."""
    fs, own = _file(spark, path)
    if fs.exists(own):
        raise FileExistsError(path)
    out = fs.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise CorpusViolation(f"{path} is {len(rows)} files")
    return rows[0]["value"]


def write_run(spark: SparkSession, folder: str, config: dict, cases: DataFrame, summary: dict, report: str) -> None:
    """config.json, cases.jsonl (a folder of parts, for cases may be many), summary.json and report.md."""
    write_text(spark, f"{folder}/config.json", artifact(config))
    cases.write.mode("errorifexists").json(f"{folder}/cases.jsonl")
    write_text(spark, f"{folder}/summary.json", artifact(summary))
    write_text(spark, f"{folder}/report.md", report)


def read_pins(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    """A JSON file, or by its suffix a YAML one of keys, nested by indentation, and plain values. Missing required keys (dotted) raise."""
    text = read_text(spark, path)
    try:
        found = plain_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text)
    except ValueError as error:
        raise CorpusViolation(f"{path} is malformed: {error}") from error
    if not isinstance(found, dict):
        raise CorpusViolation(f"{path} holds no mapping")
    for key in required:
        value = found
        for part in key.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            raise CorpusViolation(f"{path} lacks {key}")
    return found


def plain_yaml(text: str) -> dict:
    """Mappings nested by indentation, lists of plain values by dashes, and values that are JSON or bare words. Anything else raises."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    pending: tuple[dict, str] | None = None
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or body == "---":
            continue
        depth, item = len(body) - len(body.lstrip(" ")), body.strip()
        if pending is not None and (depth > stack[-1][0] or item.startswith("- ") and depth >= stack[-1][0]):
            holder, key = pending
            holder[key] = [] if item.startswith("- ") else {}
            stack.append((depth, holder[key]))
        pending = None
        while depth < stack[-1][0] or isinstance(stack[-1][1], list) and not item.startswith("- "):
            stack.pop()
        top = stack[-1][1]
        if item.startswith("- "):
            if not isinstance(top, list):
                raise ValueError(f"line {number}: an item outside a list")
            top.append(_value(item[2:]))
            continue
        key, colon, value = item.partition(":")
        if not colon or not isinstance(top, dict) or value and value[0] != " ":
            raise ValueError(f"line {number}: no key")
        key = key.strip("\"' ")
        if key in top:
            raise ValueError(f"line {number}: {key} twice")
        if stack[-1][0] < 0:
            stack[-1] = (depth, top)
        top[key] = _value(value)
        if top[key] is None:
            pending = (top, key)
    return root


def _value(raw: str) -> object:
    raw = raw.strip()
    if raw in ("", "~", "null"):
        return None
    if raw[0] == raw[-1] == "'" and len(raw) > 1:
        return raw[1:-1].replace("''", "'")
    try:
        return json.loads(raw)
    except ValueError:
        return raw
