"""Versioned Parquet tables: parts that are added, paths that are dropped, and numbered states.

A change writes a part: the new rows of each table with the source path that owns them, and
the paths whose older rows are dropped.  What a change costs follows its own size, not
the store's.  A state ``state-N.json`` names the parts in order, the corpus root and the layout.  A
writer fills its part under a name of its own and then publishes state N + 1 by a rename that
never replaces: readers see one whole state or another, a crash before the rename leaves the old
state in force, and of two writers that began from one state the second fails with
``StoreConflict``.  Reading joins the rows with the dropped paths; after ``MAX_PARTS`` parts the
tables are rewritten as one.  ``vacuum`` removes what the last states do not use.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TABLES = {"sources": schema.SOURCES, "chunks": schema.CHUNKS, "edges": schema.EDGES, "embeddings": schema.EMBEDDINGS, "postings": schema.POSTINGS, "lengths": schema.LENGTHS}
#: Where the owning path of a row is found; other tables carry it beside their columns.
OWNER = {"sources": "path", "chunks": "source_path"}
MAX_PARTS = 24
_STATE = re.compile(r"state-(\d+)\.json\Z")


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> list[str]:
        fs, at = self._fs(), self._at("")
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _state(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/state-{version}.json", wholetext=True).first()[0]
        state = json.loads(text)
        if state["layout"] > schema.VERSION:
            raise schema.UnsupportedSchemaVersion(str(state["layout"]))
        return state

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for name in self._listed() if (m := _STATE.match(name)))

    def state(self) -> dict:
        """The newest state; version 0 if nothing was written."""
        versions = self.versions()
        if not versions:
            return {"version": 0, "root": None, "layout": schema.VERSION, "parts": []}
        return self._state(versions[-1])

    def _publish(self, state: dict) -> None:
        """Make ``state`` the newest one, unless another writer has made one of its version."""
        fs, part = self._fs(), self._at(f"_{uuid.uuid4().hex}.json")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm, to = self.spark._jvm, self._at(f"state-{state['version']}.json")
        try:
            none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(to), none)
        except Exception as e:
            fs.delete(part, False)
            if fs.exists(to):
                raise schema.StoreConflict(f"another writer has made version {state['version']}") from e
            raise

    # -- reading

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        """A table of the newest (or the given) state; columns that an older layout lacks are null."""
        return self._owned(table, state or self.state()).drop("owner")

    def _owned(self, table: str, state: dict) -> DataFrame:
        wanted = self.spark.createDataFrame([], TABLES[table]).schema
        rows, dropped = None, None
        for seq, part in enumerate(state["parts"]):
            if part.get("replaces") and table in part["replaces"]:
                rows = None
            if table in part["tables"]:
                own = self.spark.read.parquet(f"{self.path}/{part['name']}/{table}")
                owner = F.col(OWNER[table]) if table in OWNER else F.col("owner")
                own = own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted], owner.alias("owner"), F.lit(seq).alias("seq"))
                rows = own if rows is None else rows.unionByName(own)
            if part["drops"]:
                own = self.spark.read.parquet(f"{self.path}/{part['name']}/dropped").select(F.col("path").alias("owner"), F.lit(seq).alias("until"))
                dropped = own if dropped is None else dropped.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], wanted).withColumn("owner", F.lit(None).cast("string"))
        if dropped is not None:
            rows = rows.join(dropped.groupBy("owner").agg(F.max("until").alias("until")), "owner", "left").where(F.col("until").isNull() | (F.col("seq") >= F.col("until")))
        return rows.select(*wanted.fieldNames(), "owner")

    # -- writing

    def change(self, root: str | None, dropped: DataFrame | None = None, replaces: tuple[str, ...] = (), base: dict | None = None, **tables: DataFrame) -> int:
        """Drop the rows that the paths of ``dropped`` own, add the rows of ``tables`` and publish the next state after ``base``.

        Rows of tables other than sources and chunks need a column ``owner``.  Tables in
        ``replaces`` hold nothing but the new rows afterwards.
        """
        state = base or self.state()
        if state["root"] is not None and root is not None and state["root"] != root:
            raise schema.CorpusMismatch(f"{state['root']} is stored, not {root}")
        name = f"part-{uuid.uuid4().hex}"
        for table, rows in tables.items():
            rows.write.parquet(f"{self.path}/{name}/{table}")
        if dropped is not None:
            dropped.select("path").write.parquet(f"{self.path}/{name}/dropped")
        part = {"name": name, "tables": sorted(tables), "drops": dropped is not None, "replaces": sorted(replaces)}
        version = state["version"] + 1
        self._publish({"version": version, "root": root or state["root"], "layout": schema.VERSION, "parts": [*state["parts"], part]})
        if len(state["parts"]) + 1 > MAX_PARTS:
            self.compact()
        return self.state()["version"]

    def compact(self) -> int:
        """Rewrite all tables as one part."""
        state, name = self.state(), f"part-{uuid.uuid4().hex}"
        for table in TABLES:
            rows = self._owned(table, state)
            (rows.drop("owner") if table in OWNER else rows).write.parquet(f"{self.path}/{name}/{table}")
        self._publish({**state, "version": state["version"] + 1, "layout": schema.VERSION, "parts": [{"name": name, "tables": sorted(TABLES), "drops": False, "replaces": []}]})
        return state["version"] + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove states but the last ``keep`` and the parts that these do not use; not while a writer is at work."""
        versions = self.versions()
        used = {part["name"] for v in versions[-keep:] for part in self._state(v)["parts"]}
        gone = [f"state-{v}.json" for v in versions[:-keep]]
        gone += [n for n in self._listed() if (n.startswith("part-") and n not in used) or n.startswith("_")]
        for name in gone:
            self._fs().delete(self._at(name), True)
        return gone
