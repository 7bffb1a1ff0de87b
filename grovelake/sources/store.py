"""A versioned store: immutable Parquet snapshots, commits and branches, over any file system that Spark reads.

Layout: ``data/`` one folder for each snapshot, never changed; ``commits/<id>.json`` what a commit holds;
``refs.<n>`` branches; ``HEAD.<n>`` the branch and its staging; a commit writes data, then itself, then its ref.
Numbered files are never changed: a new state is a new number, which one of several writers gets, so a crash leaves
the state before and no commit of another writer is lost.
Namespaces hold (key, value) in bytes, tables hold typed rows; both are versioned alike.
"""

import hashlib
import heapq
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import MergeConflict, NotFound, StoreError, TreeConfig, validated
from ..operators import blobs as bl
from ..operators import diff as df_
from ..operators import kv
from ..operators import merge as mg
from ..operators import merkle
from ..tables import Files

KV = "key BINARY, value BINARY"
CHANGES = "key BINARY, value BINARY, is_delete BOOLEAN, seq BIGINT"


def refuse_writes(spark: SparkSession, query: str) -> None:
    """Raises unless Spark's parser reads ``query`` as a query and nothing else."""

    def kinds(cls) -> set[str]:
        if cls is None:
            return set()
        return {cls.getName()}.union(kinds(cls.getSuperclass()), *(kinds(x) for x in cls.getInterfaces()))

    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    for plan in todo:
        if any(x.rpartition(".")[2] in ("Command", "ParsedStatement") for x in kinds(plan.getClass())):
            raise StoreError("only queries can be run on a version")
        children = plan.children()
        todo.extend(children.apply(k) for k in range(children.size()))


class Store:
    """One handle on a store's path. ``create`` makes one where there is none."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True, config: TreeConfig = TreeConfig(), author: str = "unknown") -> None:
        self.spark, self.path, self.author, self.threshold = spark, path.rstrip("/"), author, None
        self.files = Files(spark, self.path)
        if not self.files.versions("refs"):
            if not create:
                raise NotFound(f"no store at {path}")
            if len([x for x in self.files.names("commits") if x.endswith(".json")]) > 1:
                raise StoreError(f"the store at {path} has commits but no branches")
            self.files.write("config.json", config.to_json())
            first = self._put_commit([], "Initial commit", {"default": None}, {})
            self.files.write_next("refs", -1, json.dumps({"main": first}))
            self._head({"branch": "main", "staged": {}})
        self.config = TreeConfig.from_json(self.files.read("config.json"))

    # metadata

    def _state(self, name: str, change=None) -> dict:
        """A numbered file's last state, or the next one that ``change`` makes of it."""
        for _ in range(50):
            found = self.files.versions(name)
            old = json.loads(self.files.read(f"{name}.{found[-1]:012d}")) if found else {}
            if change is None:
                return old
            new = change(old)
            if self.files.write_next(name, found[-1] if found else -1, json.dumps(new)):
                return new
            time.sleep(0.05)
        raise StoreError(f"other writers keep changing {name}")

    def _head(self, new: dict | None = None) -> dict:
        return self._state("HEAD", None if new is None else lambda _: new)

    def _refs(self) -> dict:
        return self._state("refs")

    def _move(self, branch: str, to: str, was: str | None) -> None:
        """Moves a branch that still is where it was seen."""

        def moved(refs: dict) -> dict:
            if refs.get(branch) != was:
                raise StoreError(f"another writer moved {branch!r}")
            return refs | {branch: to}

        self._state("refs", moved)

    def _put_commit(self, parents: list[str], message: str, spaces: dict, tables: dict, streams: dict | None = None) -> str:
        body = {"streams": streams or {}, "parents": parents, "message": message, "author": self.author, "ts": int(time.time()), "format_version": 2, "spaces": spaces, "tables": tables, "nonce": uuid.uuid4().hex}
        name = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:40]
        self.files.write(f"commits/{name}.json", json.dumps(body))
        return name

    def _commit(self, name: str) -> dict:
        return json.loads(self.files.read(f"commits/{name}.json")) | {"id": name}

    def resolve(self, ref: str = "HEAD") -> str:
        """A branch, then a commit id or an unambiguous beginning of one."""
        refs = self._refs()
        if ref == "HEAD":
            return refs[self._head()["branch"]]
        if ref in refs:
            return refs[ref]
        found = [x[:-5] for x in self.files.names("commits") if x.startswith(ref) and x.endswith(".json")] if len(ref) >= 4 else []
        if len(found) != 1:
            raise NotFound(f"no branch or commit {ref!r}")
        return found[0]

    def current_branch(self) -> str:
        return self._head()["branch"]

    def branches(self) -> list[str]:
        return sorted(self._refs())

    def branch(self, name: str, at: str = "HEAD") -> None:
        if name in self._refs():
            raise StoreError(f"there is a branch {name!r}")
        self._move(name, self.resolve(at), None)

    def create_branch(self, name: str) -> None:
        """A branch from here, switched to; staged changes are dropped."""
        self.branch(name)
        self.checkout(name)

    def checkout(self, name: str) -> None:
        if name not in self._refs():
            raise NotFound(f"no branch {name!r}")
        self._head({"branch": name, "staged": {}})

    def log(self, ref: str = "HEAD", limit: int | None = 100) -> list[dict]:
        """Commits from ``ref``, newest first: by time, a commit before its parents."""
        first = self._commit(self.resolve(ref))
        out, seen, todo = [], {first["id"]}, [(-first["ts"], 0, first)]
        while todo and (limit is None or len(out) < limit):
            out.append(heapq.heappop(todo)[2])
            for name in out[-1]["parents"]:
                if name not in seen:
                    seen.add(name)
                    c = self._commit(name)
                    heapq.heappush(todo, (-min(c["ts"], out[-1]["ts"]), len(seen), c))
        return out

    def ancestors(self, ref: str) -> set[str]:
        return {c["id"] for c in self.log(ref, None)}

    def is_ancestor(self, a: str, b: str) -> bool:
        return self.resolve(a) in self.ancestors(b)

    def merge_base(self, a: str, b: str) -> str | None:
        """The first of b's history, breadth first, that a descends from."""
        known, todo = self.ancestors(a), [self.resolve(b)]
        for name in todo:
            if name in known:
                return name
            todo.extend(p for p in self._commit(name)["parents"] if p not in todo)
        return None

    # data

    def _read(self, entry: dict | None) -> DataFrame:
        if entry is None or entry.get("path") is None:
            return self.spark.createDataFrame([], KV if entry is None or "schema" not in entry else StructType.fromJson(entry["schema"]))
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['path']}")

    def _save(self, rows: DataFrame, ranged: bool) -> dict:
        """Entries lie in key order, so that a scan of one key reads few row groups."""
        path = f"data/{uuid.uuid4().hex}"
        (rows.repartitionByRange("key").sortWithinPartitions("key") if ranged else rows).write.parquet(f"{self.path}/{path}")
        saved = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{path}")
        return {"path": path, "schema": json.loads(rows.schema.json()), "mark": merkle.mark(saved) if ranged else path}

    def at(self, ref: str = "HEAD", namespace: str = "default", raw: bool = False) -> DataFrame:
        """All entries of a namespace at a branch or commit; large values are put back unless ``raw``."""
        spaces = self._commit(self.resolve(ref))["spaces"]
        if namespace not in spaces:
            raise NotFound(f"no namespace {namespace!r}")
        rows = self._read(spaces[namespace])
        return rows if raw or not self.files.exists("blobs") else bl.unwrap(rows, self.blobs())

    def namespaces(self, ref: str = "HEAD") -> list[str]:
        return sorted(set(self._commit(self.resolve(ref))["spaces"]) | set(self._head()["staged"]) if ref == "HEAD" else self._commit(self.resolve(ref))["spaces"])

    def namespace_mark(self, ref: str = "HEAD", namespace: str = "default") -> str | None:
        entry = self._commit(self.resolve(ref))["spaces"].get(namespace)
        return entry and entry["mark"]

    def namespace_changed(self, a: str, b: str, namespace: str = "default") -> bool:
        return self.namespace_mark(a, namespace) != self.namespace_mark(b, namespace)

    def root_hash(self, ref: str = "HEAD", namespace: str = "default") -> str:
        return merkle.root_hash(merkle.node_table(self.at(ref, namespace, raw=True), self.config))

    def stage(self, changes: DataFrame, namespace: str = "default") -> None:
        """Changes (key, value, is_delete, seq) go to the staging; later calls win over earlier ones."""
        head = self._head()
        parts = head["staged"].get(namespace, [])
        path = f"staging/{uuid.uuid4().hex}"
        rows = changes.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_delete", (F.col("seq") + F.lit(len(parts) << 40)).alias("seq"))
        validated(rows).write.parquet(f"{self.path}/{path}")
        head["staged"][namespace] = [*parts, path]
        self._head(head)

    def staged(self, namespace: str = "default") -> DataFrame:
        parts = self._head()["staged"].get(namespace, [])
        if not parts:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/{p}" for p in parts])

    def discard(self) -> None:
        """Drops all that is staged."""
        head = self._head()
        for parts in head["staged"].values():
            for p in parts:
                self.files.delete(p)
        self._head(head | {"staged": {}})

    def _rows(self, items: dict) -> DataFrame:
        as_bytes = lambda x: x.encode() if isinstance(x, str) else x
        return self.spark.createDataFrame([(bytearray(as_bytes(k)), None if v is None else bytearray(as_bytes(v))) for k, v in items.items()], KV)

    def insert(self, items: dict | DataFrame, namespace: str = "default") -> None:
        rows = self._rows(items) if isinstance(items, dict) else items
        self.stage(kv.upserts(rows), namespace)

    def update(self, items: dict, namespace: str = "default") -> list:
        """Stages those that are there; returns their keys."""
        rows = self._rows(items)
        here = [bytes(r.key) for r in rows.join(self.now(namespace).select("key"), "key", "left_semi").select("key").collect()]
        as_bytes = lambda x: x.encode() if isinstance(x, str) else x
        self.insert({k: v for k, v in items.items() if as_bytes(k) in here}, namespace)
        return sorted(here)

    def delete(self, keys: list, namespace: str = "default") -> None:
        """Stages deletions of those keys that are there."""
        asked = self._rows(dict.fromkeys(keys)).select("key")
        self.stage(kv.deletes(asked.join(self.now(namespace).select("key"), "key", "left_semi"), "binary"), namespace)

    def now(self, namespace: str = "default") -> DataFrame:
        """The namespace with what is staged."""
        base = self.at("HEAD", namespace) if namespace in self._commit(self.resolve())["spaces"] else self.spark.createDataFrame([], KV)
        return kv.overlay(base, kv.last_wins(self.staged(namespace)))

    def get(self, key, namespace: str = "default") -> bytes | None:
        row = self.now(namespace).where(F.col("key") == F.lit(bytearray(key.encode() if isinstance(key, str) else key))).first()
        return row and bytes(row.value)

    def list_keys(self, namespace: str = "default") -> DataFrame:
        return self.now(namespace).select("key").orderBy("key")

    def status(self, namespace: str = "default") -> DataFrame:
        return kv.status(self.at("HEAD", namespace), self.staged(namespace))

    def commit(self, message: str, parents: list[str] | None = None) -> str:
        """All namespaces' staged changes in one commit."""
        head = self._head()
        changes = {name: self.staged(name) for name, staged in head["staged"].items() if staged}
        made = self._commit_of(changes, message, parents)
        self.discard()
        return made

    def commit_changes(self, changes: DataFrame, message: str, namespace: str = "default", streams: dict | None = None) -> str:
        """Commits (key, value, is_delete, seq) at once; what is staged stays. ``streams`` names the batch that they are."""
        rows = changes.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_delete", F.col("seq").cast("bigint").alias("seq"))
        return self._commit_of({namespace: validated(rows)}, message, None, streams)

    def last_batch(self, stream: str) -> int:
        """The last micro-batch of a stream on this branch; -1 before the first."""
        return self._commit(self.resolve()).get("streams", {}).get(stream, -1)

    def _commit_of(self, changes: dict, message: str, parents: list[str] | None, streams: dict | None = None) -> str:
        was = self._commit(self.resolve())
        spaces = dict(was["spaces"])
        for name, rows in changes.items():
            last = kv.last_wins(rows)
            if self.threshold is not None:
                last = self._externalised(last)
            spaces[name] = self._save(kv.overlay(self._read(spaces.get(name)), last), True)
        return self._finish(message, spaces, was["tables"], parents, streams)

    def _externalised(self, rows: DataFrame) -> DataFrame:
        """Large values of ``rows`` go to the blobs first, so that no commit has an envelope without its blob."""
        out, new = bl.externalise(rows, max(self.threshold, bl.SIZE), self.blobs())
        new.write.mode("append").parquet(f"{self.path}/blobs")
        return out

    def _finish(self, message: str, spaces: dict, tables: dict, parents: list[str] | None = None, streams: dict | None = None) -> str:
        branch = self._head()["branch"]
        was = (parents or [self._refs()[branch]])[0]
        made = self._put_commit(parents or [was], message, spaces, tables, self._commit(was).get("streams", {}) | (streams or {}))
        self._move(branch, made, was)
        return made

    def delete_namespace(self, name: str) -> str:
        if name == "default":
            raise StoreError("the default namespace stays")
        was = self._commit(self.resolve())
        if name not in was["spaces"]:
            raise NotFound(f"no namespace {name!r}")
        return self._finish(f"Delete namespace {name}", {k: v for k, v in was["spaces"].items() if k != name}, was["tables"])

    def clear(self, confirm: bool = False) -> None:
        """Empties all namespaces and tables in a commit; history stays."""
        if not confirm:
            raise StoreError("clearing needs confirm=True")
        self._finish("Clear", {"default": None}, {})

    def migrate(self, flat: DataFrame) -> str:
        """Entries of a store without namespaces become the default namespace."""
        if self._commit(self.resolve())["spaces"].get("default"):
            raise StoreError("this store has namespaces and entries already")
        self.insert(flat)
        return self.commit("Migrate")

    # blobs

    def blobs(self) -> DataFrame:
        kind = "hash BINARY, bytes BINARY"
        return self.spark.read.schema(kind).parquet(f"{self.path}/blobs") if self.files.exists("blobs") else self.spark.createDataFrame([], kind)

    def gc_blobs(self, scope: str = "all_commits") -> dict:
        """Drops blobs that no commit (``head``: that the current one doesn't) refers to."""
        commits = [self._commit(self.resolve())] if scope == "head" else [self._commit(x[:-5]) for x in self.files.names("commits") if x.endswith(".json")]
        paths = {e["path"]: e for c in commits for e in c["spaces"].values() if e}
        dead = bl.garbage(self.blobs(), [self._read(e) for e in paths.values()])
        total, gone = self.blobs().count(), dead.count()
        if gone:
            kept = f"blobs-{uuid.uuid4().hex[:8]}"
            self.blobs().join(dead, "hash", "left_anti").write.parquet(f"{self.path}/{kept}")
            self.files.delete("blobs")
            self.files.fs.rename(self.files._path(kept), self.files._path("blobs"))
        return {"total": total, "referenced": total - gone, "removed": gone}

    # versions

    def diff(self, a: str, b: str, namespace: str = "default") -> DataFrame:
        """Sorted by key; nothing is read where the marks are equal."""
        if not self.namespace_changed(a, b, namespace):
            return self.spark.createDataFrame([], "key BINARY, op STRING, old BINARY, new BINARY")
        read = lambda ref: self.at(ref, namespace) if namespace in self._commit(self.resolve(ref))["spaces"] else self.spark.createDataFrame([], KV)
        return df_.diff(read(a), read(b)).orderBy("key")

    def show(self, ref: str = "HEAD", namespace: str = "default") -> tuple[dict, DataFrame]:
        """The commit and its difference to its first parent; all is added in the first commit."""
        c = self._commit(self.resolve(ref))
        if c["parents"]:
            return c, self.diff(c["parents"][0], c["id"], namespace)
        return c, df_.diff(self.spark.createDataFrame([], KV), self.at(c["id"], namespace))

    def revert(self, ref: str, namespace: str = "default") -> str:
        c, changes = self.show(ref, namespace)
        back = df_.inverse(changes)
        self.stage(back.select("key", F.col("new").alias("value"), (F.col("op") == "removed").alias("is_delete"), F.lit(0).cast("bigint").alias("seq")), namespace)
        return self.commit(f'Revert "{c["message"]}"')

    def key_history(self, key, namespace: str = "default", limit: int | None = 100) -> DataFrame:
        """(commit_id, ts, value, present) where the key's value differs from the commit before, newest first."""
        k = bytearray(key.encode() if isinstance(key, str) else key)
        commits = [c for c in self.log("HEAD", limit)][::-1]
        out = self.spark.createDataFrame([(i, c["id"], c["ts"]) for i, c in enumerate(commits)], "seq INT, commit_id STRING, ts BIGINT")
        found = None
        for i, c in enumerate(commits):
            if c["spaces"].get(namespace):
                now = self.at(c["id"], namespace).where(F.col("key") == F.lit(k)).select(F.lit(i).alias("seq"), "value", F.lit(True).alias("here"))
                found = now if found is None else found.union(now)
        if found is None:
            return out.where("false").select("commit_id", "ts", F.lit(None).cast("binary").alias("value"), F.lit(False).alias("present"))
        rows = out.join(F.broadcast(found), "seq", "left").select(F.lit(k).alias("key"), "value", F.col("here").isNull().alias("is_delete"), "seq", "commit_id", "ts")  # one row for each commit
        return df_.key_history(rows, ["seq"]).orderBy(F.col("seq").desc()).select("commit_id", "ts", "value", (~F.col("is_delete")).alias("present"))

    def try_merge(self, source: str, resolver=None, policy: str = "store", namespace: str = "default") -> DataFrame:
        """Conflicts of merging ``source`` into this branch; nothing is changed."""
        return mg.conflicts(self._merge(source, resolver, policy, namespace))

    def _merge(self, source: str, resolver, policy: str, namespace: str) -> DataFrame:
        base = self.merge_base("HEAD", source)
        read = lambda ref: self.at(ref, namespace, raw=resolver is None) if ref and namespace in self._commit(self.resolve(ref))["spaces"] else self.spark.createDataFrame([], KV)
        return mg.merge3(read(base), read(source), read("HEAD"), policy, resolver)

    def merge(self, source: str, resolver=None, policy: str = "store", message: str | None = None) -> str:
        """Fast-forwards where it can, else merges every namespace that the source changed; raises on conflicts."""
        here, there = self.resolve(), self.resolve(source)
        if self.is_ancestor(there, here):
            return here
        if self.is_ancestor(here, there):
            self._move(self._head()["branch"], there, here)
            return there
        base, a, b = self._commit(self.merge_base(here, there)), self._commit(there), self._commit(here)
        mark = lambda c, n: (c["spaces"].get(n) or {}).get("mark")
        changed = {n for n in set(a["spaces"]) | set(base["spaces"]) if mark(a, n) != mark(base, n)}
        spaces, merges = dict(b["spaces"]), {}
        for n in sorted(changed):
            if mark(b, n) == mark(base, n):
                spaces[n] = a["spaces"].get(n)
            elif mark(b, n) != mark(a, n):
                merges[n] = self._merge(there, resolver, policy, n)
                if mg.conflicts(merges[n]).limit(1).count():
                    raise MergeConflict(mg.conflicts(merges[n]))
        for n, m in merges.items():
            rows = mg.apply_merge(self.at(here, n, raw=resolver is None), m)
            spaces[n] = self._save(self._externalised(rows) if resolver is not None and self.threshold is not None else rows, True)
        tables = {n: self._merged_table(n, *(c["tables"].get(n) for c in (base, a, b)), resolver, policy) for n in sorted(set(a["tables"]) | set(b["tables"]))}
        return self._finish(message or f"Merge {source}", spaces, {n: t for n, t in tables.items() if t}, [here, there])

    def _merged_table(self, name: str, base: dict | None, source: dict | None, dest: dict | None, resolver, policy: str) -> dict | None:
        """The table of the side that changed it; of both, by rows with the primary key."""
        if source == base or source == dest:
            return dest
        if dest == base:
            return source
        known = [t for t in (base, source, dest) if t]
        keys = {t.get("pk") for t in known}
        if source is None or dest is None or len(keys) > 1 or None in keys or any(t["schema"] != dest["schema"] for t in known):
            raise StoreError(f"both branches changed table {name!r}: only rows of one schema with a primary key can be merged")
        pk, kind = dest["pk"], StructType.fromJson(dest["schema"])
        side = lambda t: (self._read(t) if t else self.spark.createDataFrame([], kind)).select(F.col(pk).alias("key"), F.struct(*(F.col(c) for c in kind.names)).alias("value"))
        merged = mg.merge3(side(base), side(source), side(dest), policy, resolver)
        if mg.conflicts(merged).limit(1).count():
            raise MergeConflict(mg.conflicts(merged))
        return self._save(mg.apply_merge(side(dest), merged).select("value.*"), False) | {"pk": pk}

    def stats(self, namespace: str = "default") -> dict:
        nodes = merkle.node_table(self.at("HEAD", namespace, raw=True), self.config)
        commits = self.log("HEAD", None)
        return merkle.stats(nodes).first().asDict() | {"branch": self.current_branch(), "commits": len(commits), "latest": commits[0]["ts"]}

    # tables

    def put_table(self, name: str, rows: DataFrame, message: str | None = None, pk: str | None = None) -> str:
        """A table's rows as of a new commit; a primary key that it has stays."""
        was = self._commit(self.resolve())
        pk = pk or was["tables"].get(name, {}).get("pk")
        return self._finish(message or f"Write table {name}", was["spaces"], was["tables"] | {name: self._save(rows, False) | ({"pk": pk} if pk else {})})

    def table(self, name: str, ref: str = "HEAD") -> DataFrame:
        found = self._commit(self.resolve(ref))["tables"]
        if name not in found:
            raise NotFound(f"no table {name!r}")
        return self._read(found[name])

    def tables(self, ref: str = "HEAD") -> dict[str, StructType]:
        return {n: StructType.fromJson(e["schema"]) for n, e in sorted(self._commit(self.resolve(ref))["tables"].items())}

    def create_table(self, name: str, schema: str, pk: str | None = None) -> str:
        if name in self.tables():
            raise StoreError(f"there is a table {name!r}")
        return self.put_table(name, self.spark.createDataFrame([], schema), f"Create table {name}", pk)

    def drop_table(self, name: str) -> str:
        """Its rows go with it."""
        was = self._commit(self.resolve())
        self.table(name)
        return self._finish(f"Drop table {name}", was["spaces"], {k: v for k, v in was["tables"].items() if k != name})

    def insert_rows(self, name: str, rows: DataFrame, pk: str | None = None) -> str:
        """Upserts by ``pk``; without one, rows are appended."""
        old = self.table(name)
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in old.schema.fields])
        return self.put_table(name, (old.join(rows.select(pk), pk, "left_anti").select(*old.columns) if pk else old).unionByName(rows), pk=pk)

    def update_rows(self, name: str, where: str, /, **values: str) -> str:
        """SET column = expression WHERE a condition."""
        old = self.table(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        return self.put_table(name, old.select([F.when(hit, F.expr(values[f.name])).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in old.schema.fields]))

    def delete_rows(self, name: str, where: str) -> str:
        return self.put_table(name, self.table(name).where(~F.coalesce(F.expr(where), F.lit(False))))

    def sql(self, query: str, ref: str = "HEAD") -> DataFrame:
        """A query over the tables as they were at ``ref``; statements that write are refused. The session's views stay as they were."""
        refuse_writes(self.spark, query)
        found = self._commit(self.resolve(ref))["tables"]
        used = {n: self._read(e) for n, e in found.items() if re.search(rf"\b{re.escape(n)}\b", query)}
        hidden = {n: self.spark.table(n) for n in used if any(t.isTemporary and t.name == n for t in self.spark.catalog.listTables())}
        try:
            for n, rows in used.items():
                rows.createOrReplaceTempView(n)
            return self.spark.sql(query)  # its plan is fixed here
        finally:
            for n in used:
                if n in hidden:
                    hidden[n].createOrReplaceTempView(n)
                else:
                    self.spark.catalog.dropTempView(n)

    # sessions: named checkouts of branches

    def _sessions(self, new: dict | None = None) -> dict:
        return self._state("sessions", None if new is None else lambda _: new)

    def add_session(self, name: str, branch: str) -> None:
        known = self._sessions()
        if name in known:
            raise StoreError(f"there is a session {name!r}")
        if branch not in self._refs():
            self.branch(branch)
        self._sessions(known | {name: {"branch": branch, "locked": None}})

    def sessions(self) -> dict:
        return self._sessions()

    def lock_session(self, name: str, reason: str = "") -> None:
        known = self._sessions()
        if known[name]["locked"] is not None:
            raise StoreError(f"session {name!r} is locked")
        self._sessions(known | {name: known[name] | {"locked": reason}})

    def unlock_session(self, name: str) -> None:
        known = self._sessions()
        self._sessions(known | {name: known[name] | {"locked": None}})

    def remove_session(self, name: str) -> None:
        known = self._sessions()
        if known[name]["locked"] is not None:
            raise StoreError(f"session {name!r} is locked")
        self._sessions({k: v for k, v in known.items() if k != name})

    def merge_session(self, name: str, into: str = "main", resolver=None, policy: str = "store") -> str:
        """Merges a session's branch; it is locked meanwhile."""
        source = self._sessions()[name]["branch"]
        if source == into:
            raise StoreError("a session can't be merged into its own branch")
        self.lock_session(name, "merging")
        try:
            self.checkout(into)
            return self.merge(source, resolver, policy)
        finally:
            self.unlock_session(name)
