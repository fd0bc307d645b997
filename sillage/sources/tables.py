"""Tables and files of a project: pages, link graph, index with its version, caches, logs, checkpoints, chats, settings."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import re
import tempfile
import uuid
import warnings
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = "url string, html string, crawled_at string, length int"
USAGE = "type string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, text_count int, timestamp string"
CACHE = "key string, vector array<double>, created_at string"
GRAPH = "map<string,array<struct<target:string,anchor_text:string,source_chunk:string>>>"


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or one of our own where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="sillage-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unique(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder. What is there when the driver's Python ends goes then."""
    folder = f"{scratch(spark)}/sillage/{spark.sparkContext.applicationId}-tables"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and its rows survive lost executors. What nothing removes, since a result
    still reads it, goes with unique()'s folder."""
    spark = df.sparkSession
    path = unique(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    kept.stored_at = path  # type: ignore[attr-defined]
    return kept


_folders: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, folder)


def remove_stored(*given: DataFrame) -> None:
    """Delete stored tables that nothing will read any more; tables that aren't stored are let be."""
    for df in given:
        if hasattr(df, "stored_at"):
            remove(df.sparkSession, df.stored_at)  # type: ignore[attr-defined]


def now() -> str:
    return datetime.now(UTC).isoformat()


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages of a JSON-lines file; lines that are no JSON, and pages without URL or HTML, drop out."""
    raw = spark.read.schema(f"{PAGES}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null and url <> '' and html <> ''").drop("_bad")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a page file that are no JSON objects."""
    return spark.read.text(path).where(F.trim("value") != "").where(F.try_parse_json("value").isNull()).select(F.col("value").alias("line"))


def written_pages(rows: DataFrame) -> DataFrame:
    """Rows (url, html) as they are written: trimmed URL, no blank pages, length, time of writing."""
    return rows.select(F.trim("url").alias("url"), "html").where((F.col("url") != "") & (F.trim("html") != "")).withColumn("crawled_at", F.lit(now())).withColumn("length", F.length("html"))


def append_pages(rows: DataFrame, path: str) -> None:
    written_pages(rows).write.mode("append").json(path)


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, any that Spark reaches, and the path in its terms."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str, non_empty: bool = False) -> bool:
    """Whether there is a file or folder, with any bytes in it if asked."""
    store, there = _store(spark, path)
    return store.exists(there) and not (non_empty and store.getContentSummary(there).getLength() == 0)


def remove(spark: SparkSession, path: str) -> None:
    store, there = _store(spark, path)
    store.delete(there, True)


def put_json(spark: SparkSession, path: str, data: object) -> None:
    """save_json() in any file system that Spark reaches."""
    store, there = _store(spark, path)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    out = store.create(_store(spark, part)[1], True)
    try:
        out.write(json.dumps(data, ensure_ascii=False, indent=2).encode())
    finally:
        out.close()
    store.delete(there, False)
    store.rename(_store(spark, part)[1], there)


def results_path(spark: SparkSession, given: str, out_dir: str, non_empty: bool = False) -> str:
    """The first of the likely places of a page file that exists (and is not empty), else the given one."""
    stem = re.sub(r"\.jsonl?$", "", given)
    places = [given, f"{stem}.json" if given.endswith(".jsonl") else f"{stem}.jsonl", f"{out_dir}/results.jsonl", f"{out_dir}/results.json"]
    return next((c for c in places if exists(spark, c, non_empty)), given)


def graph(spark: SparkSession, path: str) -> DataFrame:
    """from_url and links of a link graph: a JSON object by URL, or the JSON lines of write_graph(); none where the path is missing or broken."""
    form = "from_url string, links array<struct<target:string,anchor_text:string,source_chunk:string>>"
    if not exists(spark, path):
        return spark.createDataFrame([], form)
    store, there = _store(spark, path)
    if store.getFileStatus(there).isDirectory():
        return spark.read.schema(form).json(path)
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", GRAPH)).alias("from_url", "links"))


def write_graph(links: DataFrame, path: str) -> None:
    """Links as JSON lines (from_url, links), one for each page."""
    nested = F.transform(F.array_sort(F.collect_list(F.struct("pos", "target", "anchor_text", "source_chunk"))), lambda x: F.struct(x["target"].alias("target"), x["anchor_text"].alias("anchor_text"), x["source_chunk"].alias("source_chunk")))
    links.groupBy("from_url").agg(nested.alias("links")).write.mode("overwrite").json(path)


def save_index(index: DataFrame, path: str, kind: str = "flat", version: int = 1) -> None:
    """The index as a table, and its settings as a table of one row beside it.

    Both are written beside the old ones and take their places when they are whole: a write that fails leaves the old index.
    """
    spark, beside = index.sparkSession, f"{path}/new-{uuid.uuid4().hex}"
    index.write.parquet(f"{beside}/records")
    spark.createDataFrame([(version, kind)], "index_version int, index_type string").coalesce(1).write.json(f"{beside}/settings")
    for part in ("records", "settings"):
        remove(spark, f"{path}/{part}")
        store, there = _store(spark, f"{beside}/{part}")
        store.rename(there, _store(spark, f"{path}/{part}")[1])
    remove(spark, beside)


def load_index(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """RuntimeError where the stored version is another; an index without a version is taken as it is."""
    got = spark.read.schema("index_version int, index_type string").json(f"{path}/settings").first()
    if got is None or got["index_version"] is None:
        warnings.warn(f"the index at {path} has no version: taken as it is", stacklevel=2)
    if got is not None and got["index_version"] is not None and got["index_version"] != version:
        raise RuntimeError(f"index version {got['index_version']}, expected {version}: build it anew")
    return spark.read.parquet(f"{path}/records")


def save_json(path: str, data: object) -> None:
    """Written beside its place and moved there, so that readers see the old or the new file."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.tmp")
    part.write_text(json.dumps(data, ensure_ascii=False, indent=2), "utf-8")
    os.replace(part, target)


def load_json(path: str, default: object = None) -> object:
    try:
        return json.loads(Path(path).read_text("utf-8-sig"))
    except (OSError, ValueError):
        return default


def checkpoint(spark: SparkSession, path: str, stage: str, **more: object) -> None:
    put_json(spark, path, {"stage": stage, "timestamp": now(), **more})


def append_usage(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE).json(path)


class Projects:
    """Projects as folders with config.json; names are checked, settings are kept without derived folders."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def folder(self, name: str) -> Path:
        last = name.replace("\\", "/").rsplit("/", 1)[-1].strip()
        if not last or last.startswith("."):
            raise ValueError(f"no project name: {name!r}")
        return self.root / last

    def names(self) -> list[str]:
        return sorted(p.name for p in self.root.iterdir() if (p / "config.json").exists()) if self.root.exists() else []

    def exists(self, name: str) -> bool:
        return (self.folder(name) / "config.json").exists()

    def save(self, name: str, config: dict) -> None:
        save_json(str(self.folder(name) / "config.json"), {k: v for k, v in config.items() if k not in ("output_dir", "index_dir")})

    def load(self, name: str) -> dict:
        got = load_json(str(self.folder(name) / "config.json"))
        if not isinstance(got, dict):
            raise FileNotFoundError(name)
        return got | {"output_dir": str(self.folder(name)), "index_dir": str(self.folder(name) / "index")}

    def delete(self, name: str) -> None:
        import shutil

        shutil.rmtree(self.folder(name))


class Chats:
    """Chats of a project: title, settings, messages. Names are checked before anything is touched; an older chat, a list of pairs of a
    question and its answer, is read as a user's and an assistant's message each."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def path(self, name: str) -> str:
        if not isinstance(name, str) or not name.strip() or name.startswith(".") or re.search(r"[/\\\x00]", name):
            raise ValueError(f"no chat name: {name!r}")
        return str(self.root / f"{name}.json")

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.root.glob("*.json"))

    @staticmethod
    def normalised(payload: object, title: str = "Untitled Chat") -> dict:
        if isinstance(payload, list):
            pairs = [m for m in payload if isinstance(m, list | tuple) and len(m) == 2]
            payload = {"title": title, "messages": [{"role": role, "content": text} for pair in pairs for role, text in zip(("user", "assistant"), pair, strict=True)]}
        if not isinstance(payload, dict):
            payload = {}
        settings = payload.get("settings")
        messages = payload.get("messages")
        return {**payload, "title": payload.get("title") or title, "settings": {"score_threshold": 0.5, "memory_reset_at": 0, **(settings if isinstance(settings, dict) else {})}, "messages": messages if isinstance(messages, list) else []}

    def load(self, name: str) -> dict:
        return self.normalised(load_json(self.path(name)), name)

    def save(self, name: str, payload: object) -> None:
        save_json(self.path(name), self.normalised(payload, name))

    def rename(self, name: str, new: str) -> None:
        """A chat that isn't there is let be."""
        old, to = self.path(name), self.path(new)
        if Path(old).exists():
            os.replace(old, to)

    def delete(self, name: str) -> None:
        Path(self.path(name)).unlink(missing_ok=True)

    def turns(self, spark: SparkSession, name: str) -> DataFrame:
        rows = [(0, k, m.get("role", "user"), m.get("content", "")) for k, m in enumerate(self.load(name)["messages"])]
        return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
