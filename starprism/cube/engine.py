"""The engine: projects, cubes and their jobs, and SQL that is routed to them."""

from __future__ import annotations

import contextlib
import dataclasses
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starprism.cube import sqlcompat
from starprism.cube.builder import Builder, flatten, sizes, tasks
from starprism.cube.digest import Unroutable, digest, finish
from starprism.cube.model import CubeDesc, StarModel, physical, validated
from starprism.cube.routing import CubeRealization, DetailRealization, LookupRealization, Router, answer
from starprism.cube.segments import Segment, Timeline
from starprism.cube.storage import Store
from starprism.operators import ScanTooLarge

KEPT, KEPT_ROWS = 200, 10_000  # answers in the cache, and rows of each

# fixed values: a job's states, and which may follow which
TRANSITIONS = {"READY": {"RUNNING", "DISCARDED", "STOPPED"}, "RUNNING": {"SUCCEED", "ERROR", "READY", "DISCARDED", "STOPPED"}, "STOPPED": {"READY", "DISCARDED"}, "ERROR": {"READY", "DISCARDED"}, "SUCCEED": set(), "DISCARDED": set()}


@dataclasses.dataclass
class Job:
    cube: str
    kind: str
    status: str = "READY"
    error: str = ""
    id: str = dataclasses.field(default_factory=lambda: uuid.uuid4().hex[:12])
    plan: Callable | None = None

    def to(self, status: str) -> None:
        if status not in TRANSITIONS[self.status]:
            raise ValueError(f"a job cannot go from {self.status} to {status}")
        self.status = status


@dataclasses.dataclass
class Result:
    """A query's answer: its rows, where they came from, and whether a limit cut them."""

    rows: list
    columns: list[str]
    note: dict
    seconds: float
    partial: bool = False
    cached: bool = False


class Engine:
    """Cubes under ``root`` over tables that ``tables`` finds (by default the session's).

    Every query has its answer from plain Spark SQL; a cube or the detail store answers where it provably gives the same
    rows (sketch measures: the same up to their error), and the query runs as it is otherwise.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Callable[[str], DataFrame] | None = None):
        self.spark, self.store, self.tables = spark, Store(spark, root), tables or spark.table
        self.realizations: dict[str, CubeRealization | DetailRealization | LookupRealization] = {}
        self.router, self.jobs, self.last = Router(), [], {}
        self._cache: OrderedDict[str, Result] = OrderedDict()
        self.saved: dict[str, str] = {}
        self.projects: dict[str, list[str]] = {}

    # cubes

    def create(self, cube: CubeDesc) -> CubeRealization:
        validated(cube)
        timeline = Timeline(cube.model.start if cube.model.partition else "0000-01-01", partitioned=bool(cube.model.partition))
        snapshots = {t: Builder(self.store, cube, self.tables).snapshot(t) for t in cube.derived}
        found = CubeRealization(self.store, cube, timeline, self.tables, snapshots)
        self.realizations[cube.name] = found
        self._save(found)
        return found

    def _save(self, r: CubeRealization) -> None:
        self.store.write({"desc": r.cube.to_json(), "segments": [dataclasses.asdict(s) for s in r.timeline.segments], "snapshots": r.snapshots, "enabled": r.enabled, "cost": r.fixed_cost}, "meta", f"{r.name}.json")

    def load(self) -> list[str]:
        """Finds the cubes that an earlier session left under the root."""
        for file in self.store.names("meta"):
            if file.endswith(".json"):
                d = self.store.read("meta", file)
                cube = CubeDesc.from_json(d["desc"])
                timeline = Timeline(cube.model.start if cube.model.partition else "0000-01-01", [Segment(**s) for s in d["segments"]], bool(cube.model.partition))
                timeline.drop_new()
                r = CubeRealization(self.store, cube, timeline, self.tables, d["snapshots"])
                r.enabled, r.fixed_cost = d["enabled"], d.get("cost")
                self.realizations[cube.name] = r
        there = self.store.names()
        self.saved = self.store.read("queries.json") if "queries.json" in there else {}
        self.projects = self.store.read("projects.json") if "projects.json" in there else {}
        return sorted(self.realizations)

    def update(self, cube: CubeDesc) -> CubeRealization:
        """A new description under the name. Built segments stay only if what they hold is described as before."""
        old = self.realizations[cube.name]
        built = lambda c: (c.model, c.row_key, c.measures, c.groups, c.hierarchies, c.expressions)
        if old.timeline.ready() and built(old.cube) != built(cube):
            raise ValueError("purge the cube first: its segments hold something else")
        new = self.create(cube)
        new.timeline.segments, new.enabled, new.fixed_cost = old.timeline.segments, old.enabled, old.fixed_cost
        self._save(new)
        self.clear_cache()
        return new

    def set_cost(self, name: str, cost: int | None) -> None:
        """What routing takes as the cube's cost instead of its rows (None: its rows again)."""
        self.realizations[name].fixed_cost = cost
        self._save(self.realizations[name])
        self.clear_cache()

    def project(self, name: str, realizations: list[str]) -> None:
        """Names the realizations that queries of a project may use."""
        if unknown := sorted(set(realizations) - set(self.realizations)):
            raise KeyError(f"no realizations {unknown}")
        self.projects[name] = list(realizations)
        self.store.write(self.projects, "projects.json")

    def clear_cache(self) -> None:
        self._cache.clear()

    # jobs

    def job(self, job_id: str) -> Job:
        return next(j for j in self.jobs if j.id == job_id)

    def cancel(self, job_id: str) -> Job:
        """Discards a job; the Spark jobs of one that runs (in another thread) are stopped."""
        job = self.job(job_id)
        job.to("DISCARDED")
        self.spark.sparkContext.cancelJobGroup(f"starprism-{job.id}")
        return job

    def resume(self, job_id: str) -> list[Segment]:
        """Runs a failed or stopped job once more, from its plan."""
        job = self.job(job_id)
        job.to("READY")
        job.error = ""
        return self._execute(job)

    def _run(self, r: CubeRealization, kind: str, plan: Callable[[], list[tuple[Segment, list[Segment] | None]]]) -> list[Segment]:
        """A build: plans segments, builds each from facts or from others, promotes them together."""
        job = Job(r.name, kind, plan=plan)
        self.jobs.append(job)
        return self._execute(job)

    def _execute(self, job: Job) -> list[Segment]:
        r, plan = self.realizations[job.cube], job.plan
        job.to("RUNNING")
        self.spark.sparkContext.setJobGroup(f"starprism-{job.id}", f"{job.kind} {job.cube}")
        builder = Builder(self.store, r.cube, self.tables)
        try:
            r.snapshots = {t: builder.snapshot(t) for t in r.cube.derived}
            built: list[Segment] = []
            for segment, parts in plan():
                built.append(builder.build(segment) if parts is None else builder.merged(segment, [*parts, *[b for b in built if b.start >= segment.start and b.end <= segment.end]]))
            final = [b for b in built if not any(o is not b and o.start <= b.start and b.end <= o.end for o in built)]
            r.timeline.segments = [next((b for b in built if (b.start, b.end) == (s.start, s.end) and s.is_new), s) for s in r.timeline.segments]
            r.timeline.promote(*final)
            r._extent_seen = None
            self._save(r)
            self._cache.clear()
            job.to("SUCCEED")
            return final
        except Exception as e:
            r.timeline.drop_new()
            job.error = str(e)
            if job.status != "DISCARDED":
                job.to("ERROR")
            raise
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description"):
                self.spark.sparkContext.setLocalProperty(name, None)

    def build(self, name: str, end: str | None = None) -> list[Segment]:
        """Appends the next segment. A cube with distinct counts kept as numbers keeps one segment: its next one is
        merged with all before at once."""
        r = self.realizations[name]

        def plan():
            if r.cube.holistic and r.timeline.partitioned and r.timeline.segments:
                before = r.timeline.ready()
                tail, whole = r.timeline.append_and_merge(end)
                return [(tail, None), (whole, before)]
            return [(r.timeline.append(end), None)]

        return self._run(r, "BUILD", plan)

    def refresh(self, name: str, start: str, end: str) -> list[Segment]:
        r = self.realizations[name]
        return self._run(r, "REFRESH", lambda: [(r.timeline.refresh(start, end), None)])

    def merge(self, name: str, start: str, end: str) -> list[Segment]:
        r = self.realizations[name]

        def plan():
            new = r.timeline.merge(start, end)
            return [(new, r.timeline.within(new))]

        return self._run(r, "MERGE", plan)

    def purge(self, name: str) -> None:
        r = self.realizations[name]
        r.timeline.segments = []
        self.store.delete(name)
        self._save(r)
        self._cache.clear()

    def enable(self, name: str, on: bool = True) -> None:
        self.realizations[name].enabled = on
        self._save(self.realizations[name])
        self._cache.clear()

    def drop(self, name: str) -> None:
        del self.realizations[name]
        self.store.delete(name)
        self.store.delete("meta", f"{name}.json")
        self._cache.clear()

    def refresh_snapshot(self, name: str, lookup: str) -> str:
        r = self.realizations[name]
        r.snapshots[lookup] = Builder(self.store, r.cube, self.tables).snapshot(lookup)
        self._save(r)
        self.clear_cache()
        return r.snapshots[lookup]

    def orphans(self, delete: bool = False) -> list[str]:
        """Segment folders that no cube uses any more."""
        used = {s.path for r in self.realizations.values() if isinstance(r, CubeRealization) for s in r.timeline.segments}
        found = [self.store.path(n, f) for n, r in self.realizations.items() if isinstance(r, CubeRealization) for f in self.store.names(n) if self.store.path(n, f) not in used]
        if delete:
            for p in found:
                self.store.delete(*p.removeprefix(self.store.root + "/").split("/"))
        return found

    def sizes(self, name: str) -> DataFrame:
        """Rows of each cuboid of each ready segment; of those that aren't written, their groups in what stands for them."""
        r = self.realizations[name]
        rows = None
        for s in r.timeline.ready():
            for path in dict.fromkeys(s.cuboids.values()):
                for one in sizes(self.spark.read.parquet(path), r.lattice, [int(c) for c, p in s.cuboids.items() if p == path], path):
                    one = one.select(F.lit(f"{s.start}_{s.end}").alias("segment"), "cuboid", "n")
                    rows = one if rows is None else rows.unionByName(one)
        return rows

    def expose_lookup(self, cube: str, table: str) -> LookupRealization:
        """From now on queries on a lookup alone read the cube's snapshot of it: what the lookup held when it was taken."""
        found = LookupRealization(self.store, table, self.realizations[cube].snapshots[table])
        self.realizations[found.name] = found
        return found

    def detail(self, name: str, model: StarModel, columns: list[str] | None = None, shards: int = 4, shard_by: str | None = None, slice_rows: int = 50_000) -> DetailRealization:
        """Writes the star at the fact's grain: dealt to shards by a key, in time order within, in files of bounded size. A
        shard of more rows than suit a task is dealt to several, each in time order."""
        columns = columns or [f"{t}.{c}" for t in model.tables for c in self.tables(t).columns]
        flat = flatten(self.tables, model, columns, {}).select(*[physical(c) for c in columns])
        order = physical(model.partition) if model.partition else flat.columns[0]
        path = self.store.path(name, "detail")
        parts = -(-tasks(self.spark, self.tables(model.fact).count()) // shards) * shards
        flat.repartition(parts, physical(shard_by) if shard_by else order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", slice_rows).option("compression", "zstd").parquet(path)
        builder = Builder(self.store, CubeDesc(name, model, (), ()), self.tables)
        lossless = builder.lossless(builder._fact(None, None))
        self.realizations[name] = DetailRealization(self.store, name, model, path, columns, lossless)
        return self.realizations[name]

    # queries

    def sql(self, query: str, args: list | dict | None = None, project: str | None = None) -> DataFrame:
        """The query's rows as a DataFrame, from the best realization (of a project, if one is named); ``last`` tells
        which, or why none."""
        text = sqlcompat.heal(query)
        if not sqlcompat.is_query(text):
            raise ValueError("only queries are run")
        raw = sqlcompat.run(self.spark, text, args)
        self.last = {"realization": None, "kind": "spark"}
        candidates = [r for n, r in self.realizations.items() if project is None or n in self.projects[project]]
        if not candidates:
            return raw
        try:
            d = digest(raw, {k: v for r in candidates if isinstance(r, CubeRealization) for k, v in self._canonical(r).items()})
            match, why = self.router.route(candidates, d)
            if match is None:
                self.last["why"] = why
                return raw
            out = finish(answer(match, d), d, raw.columns)
            if [f.dataType for f in out.schema] != [f.dataType for f in raw.schema]:
                self.last["why"] = "types differ"
                return raw
            self.last = match.note
            return out
        except Unroutable as e:
            self.last["why"] = str(e)
            return raw

    def _canonical(self, r: CubeRealization) -> dict[str, str]:
        """Expression dimensions as Catalyst writes them over flat columns."""
        if not hasattr(r, "_texts"):
            r._texts = {}
            for name, text in r.cube.expressions.items():
                frame = None
                for t in r.cube.model.tables:
                    if f"{t}." in text:
                        frame = self.tables(t).select(*[F.col(c).alias(physical(f"{t}.{c}")) for c in self.tables(t).columns])
                        for c in self.tables(t).columns:
                            text = text.replace(f"{t}.{c}", physical(f"{t}.{c}"))
                plan = frame.selectExpr(f"{text} AS x")._jdf.queryExecution().analyzed()
                canonical = plan.projectList().apply(0).child().sql()
                for c in sorted(frame.columns, key=len, reverse=True):
                    canonical = canonical.replace(f"`{c}`", c).replace(c, f"`{c}`")
                r._texts[name] = canonical
        return r._texts

    def query(self, text: str, args: list | dict | None = None, limit: int | None = None, offset: int | None = None, partial: int | None = None, threshold_s: float = 2.0, most: int = 1_000_000, project: str | None = None) -> Result:
        """Runs a query to its rows, at most ``most`` of them: more raise ScanTooLarge. ``partial`` accepts the first so many
        rows instead and says so. Answers of realizations that took over ``threshold_s`` seconds are kept until a cube
        changes, the last ``KEPT`` of them, none of over ``KEPT_ROWS`` rows; those of the tables themselves, which may
        change at any time, are not."""
        key = repr((text, args, limit, offset, partial, project))
        if key in self._cache:
            self._cache.move_to_end(key)
            return dataclasses.replace(self._cache[key], cached=True)
        began = time.monotonic()
        df = self.sql(sqlcompat.with_limit(text, limit, offset), args, project)
        bound = most if partial is None else min(most, partial)
        rows = df.limit(bound + 1).collect()
        if len(rows) > bound and partial is None:
            raise ScanTooLarge(f"more than {most} rows")
        cut = len(rows) > bound
        out = Result(rows[:bound], df.columns, dict(self.last), time.monotonic() - began, cut)
        if out.seconds > threshold_s and len(rows) <= KEPT_ROWS and self.last["kind"] != "spark":
            self._cache[key] = out
            if len(self._cache) > KEPT:
                self._cache.popitem(last=False)
        return out

    def explain(self, text: str) -> str:
        df = self.sql(text)
        return f"{self.last}\n{df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"

    def save_query(self, name: str, text: str) -> None:
        self.saved[name] = text
        self.store.write(self.saved, "queries.json")

    def metadata(self) -> DataFrame:
        """Tables and columns of the models, as a JDBC client asks for them."""
        rows = []
        for r in self.realizations.values():
            if isinstance(r, LookupRealization):
                continue
            model = r.cube.model if isinstance(r, CubeRealization) else r.model
            for t in model.tables:
                rows += [(r.name, t, f.name, f.dataType.simpleString(), i, f.nullable) for i, f in enumerate(self.tables(t).schema)]
        return self.spark.createDataFrame(rows, "realization string, table_name string, column_name string, type_name string, ordinal int, nullable boolean")


def cardinality(df: DataFrame, error: float = 0.02) -> DataFrame:
    """Approximate distinct count of each column, in one pass."""
    row = df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_distinct")) for c in df.columns])).alias("x")).select("x.*")


@contextlib.contextmanager
def rule(engine: Engine, extra):
    """A routing rule for the length of a block."""
    engine.router.register(extra)
    try:
        yield engine
    finally:
        engine.router.remove(extra)
