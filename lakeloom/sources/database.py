"""The database: a catalog of tables, logs and indexes under one root folder, and the entry points of queries."""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeloom.plans.query import Frame, Input, run_get, run_update
from lakeloom.sources.changelog import nullable
from lakeloom.sources.collection import Log, Table, remove
from lakeloom.sources.files import Files

KINDS = {"table": "tables", "log": "logs", "index": "indexes"}
KEPT_CATALOGS = 20
#: Functions of indexes by name; a function that isn't here is found by its module and name. Text from a catalog is never executed.
FUNCTIONS: dict[str, Callable] = {}


def register(f: Callable) -> Callable:
    FUNCTIONS[f.__qualname__] = f
    return f


def _reference(f: Callable) -> str:
    name = f"{f.__module__}:{f.__qualname__}"
    if f.__qualname__ in FUNCTIONS and FUNCTIONS[f.__qualname__] is f:
        return f.__qualname__
    if "<" in name:
        register(f)
        return f.__qualname__
    return name


def _function(reference: str) -> Callable:
    if reference in FUNCTIONS:
        return FUNCTIONS[reference]
    module, _, name = reference.partition(":")
    if not name:
        raise LookupError(f"the function {reference!r} isn't registered")
    found = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found


class Database:
    def __init__(self, spark: SparkSession, root: str, on_index_failed: Callable[[str, Exception], None] | None = None, remove_failed: bool = False):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.on_index_failed, self.remove_failed = on_index_failed, remove_failed
        self._observers: list[Callable[[dict], None]] = []
        self._open: dict[tuple[str, str], Table | Log] = {}
        self._version, self._config = 0, {k: {} for k in KINDS.values()}
        self.refresh()

    # catalog: numbered versions, each published by a rename that fails if another driver was first

    def refresh(self) -> None:
        """Take over what other drivers changed."""
        names = [n for n in self.files.names(f"{self.root}/catalog") if n.endswith(".json") and not n.startswith(".")]
        if names and int(names[-1][:-5]) > self._version:
            self._version, self._config = int(names[-1][:-5]), json.loads(self.files.read_text(f"{self.root}/catalog/{names[-1]}"))

    def _change(self, change: Callable[[dict], None]) -> None:
        """Change the catalog: on top of what is current, again if another driver's change comes first."""
        self.files.mkdirs(f"{self.root}/catalog")
        while True:
            self.refresh()
            new = deepcopy(self._config)
            change(new)
            tmp, to = f"{self.root}/catalog/.{uuid.uuid4().hex}.tmp", self._version + 1
            self.files.write_text(tmp, json.dumps(new))
            if self.files.rename_new(tmp, f"{self.root}/catalog/{to:012d}.json"):
                break
            self.files.delete(tmp)
        self._version, self._config = to, new
        if to > KEPT_CATALOGS:
            self.files.delete(f"{self.root}/catalog/{to - KEPT_CATALOGS:012d}.json")
        for observer in list(self._observers):
            observer(deepcopy(new))

    def observe_config(self, observer: Callable[[dict], None]) -> None:
        """The catalog now and after every change."""
        self._observers.append(observer)
        observer(deepcopy(self._config))

    def config(self, kind: str, name: str) -> dict:
        found = self._config[KINDS[kind]].get(name)
        if found is None:
            self.refresh()
            found = self._config[KINDS[kind]].get(name)
        if found is None:
            raise LookupError(f"{kind} {name!r} not found")
        return found

    def names(self, kind: str) -> list[str]:
        self.refresh()
        return sorted(self._config[KINDS[kind]])

    def observe_names(self, kind: str, observer: Callable[[list[str]], None]) -> None:
        """The names of all tables, logs or indexes, now and whenever they change."""
        last: list[list[str]] = []

        def tell(config: dict) -> None:
            names = sorted(config[KINDS[kind]])
            if not last or last[-1] != names:
                last[:] = [names]
                observer(names)

        self.observe_config(tell)

    def catalog(self) -> DataFrame:
        self.refresh()
        rows = [(k, n, c["uid"], c.get("status", "ready")) for k, of in KINDS.items() for n, c in sorted(self._config[of].items())]
        return self.spark.createDataFrame(rows, "kind string, name string, uid string, status string")

    def _create(self, kind: str, name: str, config: dict) -> None:
        if not name:
            raise ValueError("a name must not be empty")
        new = {"uid": uuid.uuid4().hex} | config

        def add(catalog: dict) -> None:
            if name in catalog[KINDS[kind]]:
                raise ValueError(f"{kind} {name!r} already exists")
            catalog[KINDS[kind]][name] = new

        self._change(add)

    def _path(self, kind: str, name: str) -> str:
        return f"{self.root}/{self.config(kind, name)['uid']}"

    def create_table(self, name: str, schema: T.StructType | str) -> Table:
        return self._create_rows("table", name, schema)

    def create_log(self, name: str, schema: T.StructType | str) -> Log:
        return self._create_rows("log", name, schema)

    def _create_rows(self, kind: str, name: str, schema: T.StructType | str):
        if isinstance(schema, str):
            schema = self.spark.createDataFrame([], schema).schema
        if kind == "table" and "id" not in schema.names:
            raise ValueError("a table needs a field id")
        self._create(kind, name, {"schema": nullable(schema).jsonValue()})
        return self.open(kind, name)

    def create_index(self, name: str, code: Callable, params: Mapping | None = None):
        """code(input, output, params), a function that can be found again by its module and name; built at once."""
        from lakeloom.streaming.index import IndexOutput

        frame, output = Frame(incremental=True), IndexOutput(self.spark, self)
        code(Input(self, frame), output, dict(params or {}))
        schema = nullable(output._folded().schema)
        self._create("index", name, {"code": _reference(code), "params": dict(params or {}), "schema": schema.jsonValue(), "sources": frame.lineage, "status": "ready"})
        index = self.open("index", name)
        try:
            index.update()
        except Exception as e:
            self.index_failed(index, e)
            raise
        return index

    def open(self, kind: str, name: str):
        """The handle of a collection; one for each, however often it's asked for."""
        config = self.config(kind, name)
        key = (kind, config["uid"])
        if key not in self._open:
            path, schema = self._path(kind, name), T.StructType.fromJson(config["schema"])
            if kind == "index":
                from lakeloom.streaming.index import Index

                self._open[key] = Index(self.spark, path, schema, self, _function(config["code"]), config["params"])
            else:
                self._open[key] = (Table if kind == "table" else Log)(self.spark, path, schema)
        return self._open[key]

    def table(self, name: str) -> Table:
        return self.open("table", name)

    def log(self, name: str) -> Log:
        return self.open("log", name)

    def index(self, name: str):
        return self.open("index", name)

    def delete(self, kind: str, name: str) -> None:
        """Remove a collection, its rows and operations."""
        path, handle = self._path(kind, name), self._open.pop((kind, self.config(kind, name)["uid"]), None)
        if hasattr(handle, "stop"):
            handle.stop()
        self._change(lambda catalog: catalog[KINDS[kind]].pop(name, None))
        remove(self.spark, path)

    def rename(self, kind: str, name: str, to: str) -> None:
        """A change of the catalog only; what refers to the collection does so by its uid."""
        uid = self.config(kind, name)["uid"]

        def move(catalog: dict) -> None:
            if to in catalog[KINDS[kind]]:
                raise ValueError(f"{kind} {to!r} already exists")
            catalog[KINDS[kind]][to] = catalog[KINDS[kind]].pop(name)
            for index in catalog["indexes"].values():
                for source in index["sources"]:
                    if source["uid"] == uid:
                        source["name"] = to

        self._change(move)

    # indexes

    def index_order(self) -> list[str]:
        """Names of the indexes, each after those it reads."""
        by_uid = {c["uid"]: n for n, c in self._config["indexes"].items()}
        out: list[str] = []

        def visit(name: str) -> None:
            if name not in out:
                for s in self._config["indexes"][name]["sources"]:
                    if s["uid"] in by_uid:
                        visit(by_uid[s["uid"]])
                out.append(name)

        for name in self.names("index"):
            visit(name)
        return out

    def update_indexes(self) -> None:
        """Bring every index up to date, sources first; one that fails is marked and doesn't stop the others."""
        for name in self.index_order():
            try:
                self.index(name).update()
            except Exception as e:
                self.index_failed(self.index(name), e)

    def start(self, slow: bool = False) -> None:
        """Open all collections, one after the other if slow, and start the indexes."""
        jobs = [(k, n) for k in ("table", "log") for n in self.names(k)]
        if slow:
            for job in jobs:
                self.open(*job)
        else:
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(lambda job: self.open(*job), jobs))
        for name in self.index_order():
            try:
                self.index(name).start()
            except Exception as e:
                self._failed(name, e)

    def index_failed(self, index, e: Exception) -> None:
        uid = index.changelog.path.rsplit("/", 1)[-1]
        for name, c in list(self._config["indexes"].items()):
            if c["uid"] == uid:
                self._failed(name, e)

    def _failed(self, name: str, e: Exception) -> None:
        if self.remove_failed:
            self.delete("index", name)
        else:
            status = {"status": f"failed: {type(e).__name__}: {str(e)[:300]}"}
            self._change(lambda catalog: catalog["indexes"].get(name, {}).update(status))
        if self.on_index_failed:
            self.on_index_failed(name, e)

    def clear_oplogs(self, before_ms: int, limit: int | None = None) -> dict:
        """Truncate the operation logs of all tables and indexes; {count, last} over all and ``results`` of each. An index that fails counts nothing."""
        results = []
        for kind in ("table", "index"):
            for name in self.names(kind):
                try:
                    results.append({"type": kind, "name": name} | self.open(kind, name).clear_oplog(before_ms, limit))
                except Exception:
                    if kind == "table":
                        raise
                    results.append({"type": kind, "name": name, "count": 0, "last": None})
        return {"count": sum(r["count"] for r in results), "last": min((r["last"] for r in results if r["last"]), default=None), "results": results}

    # queries

    def query_get(self, code: Callable) -> DataFrame:
        """The rows of code(input, output), ordered by id; lazy."""
        return run_get(self, code)

    def query_update(self, code: Callable) -> DataFrame:
        """As query_get, with writers at output.table(name) and output.log(name), whose writes happen as they're called."""
        return run_update(self, code)

    def query_object_get(self, code: Callable) -> DataFrame:
        """The first row, or none."""
        return run_get(self, code).limit(1)

    def query_observable(self, code: Callable, most: int = 100_000):
        from lakeloom.streaming.live import LiveList

        return LiveList(self, code, most)

    def query_object_observable(self, code: Callable, most: int = 100_000):
        from lakeloom.streaming.live import LiveObject

        return LiveObject(self, code, most)
