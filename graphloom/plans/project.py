"""A project: sources and what steps found in them, kept in one append-only log.

Sources are records in the scope ``project``; each has its own scope ``doc/<slug>``.
Every step takes all its documents in one job and adds one delta a scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import iri, lexical, literal, slug
from graphloom.operators import consolidate, emit, entities, store
from graphloom.operators.ontology import materialized
from graphloom.plans.tasks import TaskGraph
from graphloom.sources.log import SCHEMA, append, ntriple, read_log
from graphloom.sources.snapshots import Snapshots

#: Fields of a source's record and the predicates that say them.
FIELDS = {n: f"x:{n}" for n in ("slug", "path", "hash", "mime", "size", "added")}


class Project:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.kept = Snapshots(spark, f"{self.root}/snapshots/kept", f"{self.root}/log")

    def _there(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def init(self, force: bool = False) -> None:
        """An empty log; where one is already, an error unless forced."""
        path = f"{self.root}/log"
        if self._there(path) and not force:
            raise ValueError(f"{self.root} holds a project")
        self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
        for kind in ("snapshots", "marks"):  # of what was there before
            self._drop(f"{self.root}/{kind}")

    def _drop(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def log(self) -> DataFrame:
        return read_log(self.spark, f"{self.root}/log")

    def state(self, at_seq: int | None = None) -> DataFrame:
        """From the nearest kept state and the log's tail."""
        return self.kept.state(at_seq)

    def record(self, step: str, added: DataFrame | None = None, removed: DataFrame | None = None, agent: str | None = None) -> int:
        """Append what changes: additions (scope, s, p, o) that don't hold, removals that
        do. Each scope goes up by one step. Returns how many rows were written."""
        held, parts = self.state(), []
        if added is not None:
            parts.append(added.select(store.KEYS).distinct().join(held, store.KEYS, "left_anti").withColumn("op", F.lit("added")))
        if removed is not None:
            parts.append(removed.select(store.KEYS).distinct().join(held, store.KEYS, "left_semi").withColumn("op", F.lit("removed")))
        if not parts:
            return 0
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        seq = F.coalesce("next_seq", F.lit(1)).cast("long")
        rows = changes.join(store.next_seq(self.log()), "scope", "left").select(
            "scope", seq.alias("seq"), (seq - 1).alias("parent_seq"), F.lit(step).alias("step"), F.lit(agent).cast("string").alias("agent"), F.current_timestamp().alias("ts"), "op", "s", "p", "o"
        )
        rows = materialized(rows)
        n = rows.count()
        if n:
            append(rows, f"{self.root}/log", by_scope=False)
        return n

    # --- sources -------------------------------------------------------------------

    def registry(self) -> DataFrame:
        """(s, slug, path, hash, mime, size, added) of every source."""
        rows = store.pivot(self.state().filter("scope = 'project'"), FIELDS)
        return rows.filter("slug is not null").select("s", *[lexical(F.col(n)).alias(n) for n in FIELDS])

    def add(self, files: DataFrame) -> int:
        """Register files (path, content, mime). Content that is registered stays out, and of
        equal new contents the smallest path comes in; slugs are made from file names."""
        known = self.registry()
        hashed = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), "mime", F.octet_length("content").alias("size"))
        new = hashed.groupBy("hash").agg(F.min_by(F.struct("path", "mime", "size"), "path").alias("f")).select("hash", "f.*").join(known.select("hash"), "hash", "left_anti")
        stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
        numbered = consolidate.fresh_slugs(new.select("path", "hash", "mime", "size", slug(stem).alias("slug")), known.select("slug"), "slug", "path").drop("slug").withColumnRenamed("unique_slug", "slug")
        me = iri("x:source/", F.col("slug"))
        said = numbered.withColumn("added", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        facts = F.array(*[F.struct(F.lit("project").alias("scope"), me.alias("s"), F.lit(p).alias("p"), literal(F.col(n)).alias("o")) for n, p in FIELDS.items()])
        return self.record("add", added=said.select(F.inline(facts)).filter("o is not null"))

    def remove(self, slugs: list[str]) -> int:
        """Forget sources and everything their scopes hold."""
        gone = [*(f"doc/{x}" for x in slugs)]
        held = self.state()
        return self.record("remove", removed=held.filter(F.col("scope").isin(*gone) | ((F.col("scope") == "project") & F.col("s").isin(*(f"x:source/{x}" for x in slugs)))))

    def status(self) -> DataFrame:
        r = self.registry()
        return store.status(r.select("slug", "size", F.to_timestamp("added").alias("added_at")))

    # --- steps ---------------------------------------------------------------------

    def unrecognized(self) -> DataFrame:
        """Sources whose hash their own graph doesn't say."""
        r = self.registry()
        said = entities.recorded_hash(self.state().select("s", "p", "o"), r.select("s", "hash"))
        return r.join(said.filter("same").select("s"), "s", "left_anti")

    def recognize(self) -> int:
        """The facts of every source that has none yet, or has others."""
        none = F.lit(None).cast("string")
        open_ = materialized(self.unrecognized())
        files = open_.select(F.col("s").alias("uri"), "path", "size", "hash", "mime", F.col("slug").alias("title"), none.alias("author"), none.alias("producer"), none.alias("pages"))
        facts = emit.recognized_files(files)
        owner = open_.select("s", F.concat(F.lit("doc/"), "slug").alias("scope"))
        # every subject is the source's own name, or that with something after the first dash behind it
        names = F.array("s", *[F.concat("s", F.lit(f"-{n}{tail}")) for n in ("FileSize", "FilePath", "FileHash", "MimeType") for tail in ("", "-datum")])
        scoped = facts.join(owner.select("scope", F.explode(names).alias("s")), "s")
        stale = self.state().join(scoped.select("scope").distinct(), "scope", "left_semi").join(scoped.select("s").distinct(), "s", "left_semi").join(scoped, store.KEYS, "left_anti")
        return self.record("recognize", scoped, stale)

    # --- classes -------------------------------------------------------------------

    def _touched(self, task: str) -> DataFrame:
        """(scope, seq): scopes with steps that ``task`` hasn't seen."""
        path = f"{self.root}/marks/{task}"
        steps = self._steps()
        if not self._there(path):
            return steps
        seen = self.spark.read.schema("scope string, seq long").parquet(path).groupBy("scope").agg(F.max("seq").alias("seen"))
        return steps.join(seen, "scope", "left").filter(F.col("seq") > F.coalesce("seen", F.lit(0))).select("scope", "seq")

    def _mark(self, task: str) -> None:
        """``task`` has seen all steps so far, its own too."""
        self._touched(task).write.mode("append").parquet(f"{self.root}/marks/{task}")

    def classes(self) -> DataFrame:
        """(scope, cls, slug, anchor, label, alt_labels, comment, deprecated): classes that a scope
        defines; the slug is what follows the last slash."""
        state = self.state()
        defined = state.filter("p = 'rdf:type' and o = 'owl:Class'").select("scope", "s")
        text = lambda p: F.min(F.when(F.col("p") == p, lexical(F.col("o"))))
        rows = state.join(defined, ["scope", "s"], "left_semi").groupBy("scope", "s").agg(
            F.min(F.when(F.col("p") == "rdfs:subClassOf", F.col("o"))).alias("anchor"), text("rdfs:label").alias("label"), text("rdfs:comment").alias("comment"),
            F.array_sort(F.collect_set(F.when(F.col("p") == "skos:altLabel", lexical(F.col("o"))))).alias("alt_labels"), F.coalesce(F.bool_or((F.col("p") == "owl:deprecated") & F.col("o").startswith('"true"')), F.lit(False)).alias("deprecated"),
        )
        return rows.select("scope", F.col("s").alias("cls"), F.substring_index("s", "/", -1).alias("slug"), "anchor", "label", "alt_labels", "comment", "deprecated")

    def _classes_touched(self, task: str) -> DataFrame:
        """All classes under slugs that a scope with new steps defines."""
        known = materialized(self.classes())
        slugs = known.join(self._touched(task).select("scope"), "scope", "left_semi").select("slug").distinct()
        return known.join(slugs, "slug", "left_semi")

    def promotable(self, least: int = 2) -> DataFrame:
        """Classes to promote: one for each slug that ``least`` sources define and the project
        doesn't, among the slugs that steps have touched since the last promotion."""
        known = materialized(self._classes_touched("consolidate"))
        own = known.filter("scope = 'project'").select("slug", F.lit(True).alias("promoted"))
        defined = known.filter("scope <> 'project'").join(own, "slug", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False))).withColumnRenamed("scope", "doc")
        slugs = consolidate.candidates(defined, least).select("slug")
        return consolidate.merge(defined.filter("not deprecated").join(slugs, "slug", "left_semi"))

    def consolidate(self, least: int = 2) -> int:
        """Promote classes to the project."""
        made = consolidate.definitions(self.promotable(least), "x:ext/").select(F.lit("project").alias("scope"), "s", "p", "o")
        n = self.record("consolidate", made)
        self._mark("consolidate")
        return n

    def alignable(self) -> DataFrame:
        """(scope, old, new): classes of sources under a slug that the project has too, among
        the slugs touched since the last alignment."""
        known = materialized(self._classes_touched("align"))
        higher = known.filter("scope = 'project'").select("cls", "slug", F.lit(0).alias("priority"), "deprecated")
        local = known.filter("scope <> 'project' and not deprecated").select("scope", "cls", "slug")
        return local.join(consolidate.align(local.select("cls", "slug").distinct(), higher), "cls").select("scope", F.col("cls").alias("old"), F.col("target").alias("new"))

    def align(self) -> int:
        """Mark sources' classes as replaced by the project's and type their instances anew."""
        mapping = materialized(self.alignable())
        moved = materialized(self.state().filter("p = 'rdf:type'").join(mapping.withColumnRenamed("old", "o"), ["scope", "o"]).select("scope", "s", "p", "o", "new"))
        said = F.array(F.struct(F.lit("owl:deprecated").alias("p"), F.lit('"true"^^xsd:boolean').alias("o")), F.struct(F.lit("dct:isReplacedBy").alias("p"), F.col("new").alias("o")))
        added = moved.select("scope", "s", "p", F.col("new").alias("o")).unionByName(mapping.select("scope", F.col("old").alias("s"), F.inline(said)))
        n = self.record("align", added, moved.select("scope", "s", "p", "o"))
        self._mark("align")
        return n

    def history(self) -> DataFrame:
        return store.history(self.log())

    def diff(self, a: int, b: int) -> DataFrame:
        return store.diff(self.log(), a, b)

    def snapshot(self, at_seq: int | None = None) -> str | None:
        """N-Triples of every scope, a folder each, of the end or after a step; nothing is
        written where nothing holds. The steps behind the one of the end are kept beside it,
        and the state itself, from which later ones start."""
        steps = materialized(self._steps())
        state = materialized(self.state(at_seq))
        if state.isEmpty():
            return None
        self.kept.write(at_seq)
        path = f"{self.root}/snapshots/" + ("graph" if at_seq is None else f"graph.{at_seq:03d}")
        state.select("scope", ntriple().alias("value")).write.mode("overwrite").partitionBy("scope").text(path)
        if at_seq is None:
            steps.write.mode("overwrite").parquet(f"{self.root}/snapshots/steps")
        return path

    def _steps(self) -> DataFrame:
        return self.log().groupBy("scope").agg(F.max("seq").alias("seq"))

    def outdated(self) -> bool:
        """There is no snapshot, or a step came after it."""
        kept = f"{self.root}/snapshots/steps"
        return not self._there(kept) or not self._steps().subtract(self.spark.read.schema("scope string, seq long").parquet(kept)).isEmpty()

    def tasks(self) -> TaskGraph:
        """recognize where a source needs it, classes promoted and aligned where steps since
        then have touched any that are to be, and a snapshot where a step came after the
        last one or there is none."""
        g = TaskGraph()

        @g.task()
        def recognize(ctx):
            ctx["recognized"] = self.recognize()

        @g.dirty("recognize")
        def _(ctx):
            return not self.unrecognized().isEmpty()

        @g.task("recognize", name="consolidate")
        def _(ctx):
            ctx["promoted"] = self.consolidate()

        @g.dirty("consolidate")
        def _(ctx):
            return not self.promotable().isEmpty()

        @g.task("consolidate", name="align")
        def _(ctx):
            ctx["aligned"] = self.align()

        @g.dirty("align")
        def _(ctx):
            return not self.alignable().isEmpty()

        @g.task("recognize", "align")
        def snapshot(ctx):
            ctx["snapshot"] = self.snapshot()

        @g.dirty("snapshot")
        def _(ctx):
            return self.outdated()

        return g
