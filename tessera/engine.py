"""The facade: ingest documents, report on jobs, answer questions."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import answer as A
from .operators import chunking, graph, plugins, relations, resolution, retrieval
from .sources import documents as sources
from .sources.shared import discard, shared_dir, written

PHASES = ["upload", "chunk", "extract", "normalise", "features", "resolve", "graph", "embed", "verify"]


class UnknownJob(KeyError):
    """No job has this id."""


class NotReady(RuntimeError):
    """The job hasn't completed."""


class Engine:
    """Many documents at a time, each known by the hash of its text; a job is one ingest.

    What is kept lies below `home`, in the shared folder unless another is
    given: the results of chunks, so that a later ingest extracts only what is
    new or had failed, and the active documents, so that another engine takes
    up where this one stopped. `model` takes a prompt and gives a reply
    (a string, or what plugins.response_text reads); without one answers are
    extracts. `score` and `verify` judge pairs of entities, as in resolution.
    `progress` is called with the job, the phase and its state.
    """

    def __init__(
        self,
        spark: SparkSession,
        extractor: Callable[[str], list[dict]] = plugins.rule_extractor,
        model: Callable | None = None,
        size: int = fixed.CHUNK_SIZE,
        overlap: int = fixed.CHUNK_OVERLAP,
        home: str | None = None,
        score: Callable | None = None,
        verify: Callable | None = None,
        progress: Callable[[str, str, str], None] | None = None,
    ):
        chunking.check(size, overlap)
        self.spark, self.extractor, self.model, self.size, self.overlap = spark, extractor, model, size, overlap
        self.score, self.verify, self.progress = score, verify, progress
        self.home = home or f"{shared_dir(spark)}/tessera-engine"
        self.jobs: dict[str, dict] = {}
        self.tables: dict[str, dict[str, DataFrame]] = {}
        self.current: str | None = None

    def health(self) -> dict:
        """Whether the session answers and the shared folder can be reached."""
        return {"status": "ok", "spark": self.spark.version, "active": self.spark.range(1).count() == 1, "home_exists": sources.exists(self.spark, self.home)}

    # --- ingest ---------------------------------------------------------------

    def _fingerprint(self, docs: DataFrame) -> str:
        """One string for a set of documents and how they are cut."""
        half = lambda at: F.sum(F.conv(F.substring("file_hash", at, 15), 16, 10).cast("decimal(38,0)"))
        row = docs.agg(F.count("*"), half(1), half(16), half(31)).first()
        return "-".join(str(x) for x in (*row, self.size, self.overlap, fixed.CACHE_VERSION))

    def _extracted(self, docs: DataFrame, chunks: DataFrame) -> DataFrame:
        """doc_id, chunk_id, text, status, error, triples of every chunk: from the cache where it holds a success for the same text, else extracted now and kept."""
        counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_chunks"))
        named = docs.select("doc_id", "file_hash").join(counts, "doc_id").withColumn("chunk_size", F.lit(self.size)).withColumn("overlap", F.lit(self.overlap))
        wanted = named.select("file_hash", "chunk_size", "overlap", "total_chunks").distinct()
        known = sources.cached_chunks(self.spark, self.home, wanted)
        own = chunks.join(named, "doc_id")
        judged = written(sources.marked(own, known.select("file_hash", "chunk_id", "text", "status", "triples"), "file_hash"))
        new = written(plugins.extract(judged.filter("not reused").select("doc_id", "chunk_id", "text"), self.extractor))
        sources.save_chunks(new.join(named, "doc_id"), self.home, time.time_ns())
        old = judged.filter("reused").select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "text", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), "triples")
        found = written(old.unionByName(new))
        discard(judged)
        discard(new)
        return found

    def ingest(self, docs: DataFrame, clear: bool = False) -> str:
        """docs (doc_id, text; ids unique) through all phases; the job's id. Documents that are active and complete are not ingested again. A phase that fails marks the job failed and raises. `clear` drops what earlier jobs made."""
        job = uuid.uuid4().hex
        state = self.jobs[job] = {"status": "queued", "phases": dict.fromkeys(PHASES, "pending"), "error": None}

        def phase(name: str | None) -> None:
            for p, s in state["phases"].items():
                if s == "running":
                    state["phases"][p] = "completed"
                    if self.progress:
                        self.progress(job, p, "completed")
            if name:
                state["phases"][name] = "running"
                if self.progress:
                    self.progress(job, name, "running")

        try:
            docs = docs.select("doc_id", "text").withColumn("file_hash", sources.file_hash(F.coalesce("text", F.lit("")))).withColumn("source_file", F.col("doc_id").cast("string"))
            same = self._fingerprint(docs)
            active = self._active()
            if active and active["fingerprint"] == same and active["complete"] and not clear:
                state |= {"status": "completed", "phases": dict.fromkeys(PHASES, "completed"), "counts": active["counts"]}
                self.tables[job] = self._read(active["tables"])
                self._activate(job, active | {"job": job})
                return job
            state["status"] = "running"
            phase("upload")
            docs = written(docs)
            phase("chunk")
            chunks = written(chunking.recursive(docs.select("doc_id", "text"), self.size, self.overlap))
            phase("extract")
            found = self._extracted(docs, chunks)
            triples = found.select("doc_id", "chunk_id", F.posexplode("triples").alias("i", "t")).select("doc_id", (F.col("chunk_id").cast("long") * (1 << 32) + F.col("i")).alias("pos"), "t.*")
            phase("normalise")
            clean = written(relations.normalise(triples, plugins.embed_string).withColumn("source_file", F.col("doc_id").cast("string")))
            phase("features")
            order = ["doc_id", "pos"]
            phase("resolve")
            resolved, names, decisions, _ = resolution.resolve(clean, plugins.embed, found, self.score, verify=self.verify, order=order)
            resolved = written(resolved)
            phase("graph")
            if clear:
                self.clear()
            nodes, edges = graph.nodes(resolved, order), written(graph.edges(resolved))
            phase("embed")
            nodes = written(plugins.embed(nodes, "name"))
            kept = graph.fresh_chunks(found.withColumn("source_file", F.col("doc_id").cast("string")))
            kept = written(plugins.embed(kept, "text"))
            phase("verify")
            state["counts"] = graph.counts(nodes, kept, edges).first().asDict()
            complete = found.filter("status <> 'success'").limit(1).count() == 0
            phase(None)
            state["status"] = "completed"
            tables = {"chunks": kept, "nodes": nodes, "edges": edges, "triples": resolved, "normalised": clean, "found": found, "decisions": decisions, "names": written(names)}
            self.tables[job] = tables
            self._activate(job, {"job": job, "fingerprint": same, "complete": complete, "counts": state["counts"], "tables": {k: t._tessera_path for k, t in tables.items()}})
            discard(chunks)
            discard(docs)
        except Exception as e:
            state["status"], state["error"] = "failed", str(e)
            state["phases"] |= {p: "failed" for p, s in state["phases"].items() if s == "running"}
            raise
        return job

    def clear(self) -> None:
        """Drop the tables of all jobs and forget the active documents; the cache of chunks stays."""
        for tables in self.tables.values():
            for t in tables.values():
                discard(t)
        for job in self.tables:
            self.jobs.pop(job, None)
        self.tables.clear()
        self.current = None
        sources.save_state(self.spark, self.home, {})

    # --- state ----------------------------------------------------------------

    def _read(self, paths: dict[str, str]) -> dict[str, DataFrame]:
        out = {}
        for name, path in paths.items():
            out[name] = self.spark.read.parquet(path)
            out[name]._tessera_path = path
        return out

    def _activate(self, job: str, state: dict) -> None:
        self.current = job
        sources.save_state(self.spark, self.home, state)

    def _active(self) -> dict | None:
        """The state saved last, if its tables are still there."""
        state = sources.load_state(self.spark, self.home)
        return state if state and all(sources.exists(self.spark, p) for p in state["tables"].values()) else None

    def current_document(self) -> dict | None:
        """The last completed job and its counts, of this engine or else of the one that saved its state last; None before there is one."""
        if self.current is None:
            state = self._active()
            if state is None:
                return None
            job = state["job"]
            self.jobs[job] = {"status": "completed", "phases": dict.fromkeys(PHASES, "completed"), "error": None, "counts": state["counts"]}
            self.tables[job] = self._read(state["tables"])
            self.current = job
        return {"job": self.current, "counts": self.jobs[self.current]["counts"]}

    def status(self, job: str) -> dict:
        if job not in self.jobs:
            raise UnknownJob(job)
        return self.jobs[job]

    # --- questions ------------------------------------------------------------

    def _ask(self, kind: str, question: str, context: str, draft: str = "") -> str:
        """A model's reply to a prompt; without a model the draft is an extract, borne out unless it says that there is no evidence, and nothing is better than it."""
        if self.model is not None:
            return plugins.response_text(self.model(A.prompt(kind, question, context, draft)))
        if kind == "generate":
            return plugins.extractive_answer(question, context.split("\n\n"))
        return ("UNSUPPORTED" if "insufficient" in draft.lower() else "SUPPORTED") if kind == "validate" else ""

    def query(self, job: str, question: str, k: int = 8) -> dict:
        """The answer payload of a question of 1 to 2000 characters."""
        if self.status(job)["status"] != "completed":
            raise NotReady(job)
        if not 1 <= len(question or "") <= 2000 or not question.strip():
            raise ValueError("a question has 1 to 2000 characters")
        t = self.tables[job]
        found = retrieval.retrieve(t["chunks"], t["nodes"], t["edges"], question, k=k)
        blocks = A.joined(A.vector_context(found["expanded"]), "No vector evidence retrieved.").first()["context"]
        paths = found["graph_paths"]
        lines = A.joined(A.graph_context(paths), "No graph evidence retrieved.").first()["context"]
        ask = lambda kind: lambda q, c, d="": self._ask(kind, q, c, d)
        out = A.answer(question, f"{blocks}\n\n{lines}", ask("generate"), ask("validate"), ask("correct"))
        names, links = A.payload(paths)
        rows = lambda df: [r.asDict() for r in df.collect()]
        return out | {"vector_evidence": rows(A.evidence(found["expanded"])), "graph_evidence": rows(paths), "entity_candidates": rows(found["entities"]), "graph": {"nodes": rows(names), "links": rows(links)}}
