"""The knowledge base: documents in, answers out. Results are DataFrames unless they are one small record."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from copy import copy

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import sources
from .config import Config, check_windows
from .errors import KnowledgeError
from .functions import text
from .functions.embedders import Embedder, Tokenizer, embedder_for, tokenizer_for
from .operators import documents as manage
from .operators import cells, graph, index, ingest, search
from .schema import SCHEMA_VERSION, SORTED, TABLES, all_of, check_chunks, check_documents, shaped
from .store import MAX_NAMED, Store, few

#: Folders of documents (see store), and so the most batches that a reindex takes them in.
MAX_BATCHES = 256


class KnowledgeBase:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: Embedder | None = None, tokenizer: Tokenizer | None = None, check_model: bool = True, extractors: Sequence[graph.Extractor] = (), progress: Callable[[str, dict], None] | None = None):
        """Opens the store of the configuration. extractors find entities besides the rules (see graph.extract). progress is called as each stage of an upload or a reindex ends (see _stage). A store that was made with another embedder can only be opened to reindex it (check_model=False)."""
        self.spark, self.config = spark, config or Config()
        self.embedder, self.tokenizer = embedder or embedder_for(self.config), tokenizer or tokenizer_for(self.config)
        self.store, self.extractors, self.progress = Store(spark, self.config.storage.path), extractors, progress
        self.migrate()
        meta = self.store.meta()
        known = (meta.get("embedding_model"), meta.get("embedding_dimension"))
        if check_model and meta and known != (self.embedder.name, str(self.embedder.dimension)):
            raise KnowledgeError("E_MODEL_MISMATCH", f"the store has embeddings of {known[0]} ({known[1]}), the configuration asks for {self.embedder.name} ({self.embedder.dimension})")
        if not meta:
            self.store.commit({"meta": self._meta()})

    def migrate(self) -> bool:
        """Brings a store of an earlier schema to this one, in one commit; whether that was needed. Its old files stay."""
        state = self.store.pointer()
        if not state["version"] or state["schema"] == SCHEMA_VERSION:
            return False
        tables = {name: df for name, df in self.store.tables(state).items() if state["tables"].get(name)}
        stats = None
        if "chunk" in tables:
            chunks = tables["chunk"] = ingest.indexed(tables["chunk"])
            added, stats = self._index(chunks, state)
            tables |= added
        if "meta" in tables:
            tables["meta"] = tables["meta"].where("key <> 'schema_version'").unionByName(self.store.meta_table(schema_version=SCHEMA_VERSION))
        self.store.commit(replace=tables, migrating=True, since=state["version"], stats=stats)
        return True

    def clean(self, retention: float = 7 * 86400.0) -> int:
        """Removes files that no version of the last `retention` seconds names; how many parts."""
        return self.store.clean(retention)

    def as_of(self, version: int) -> KnowledgeBase:
        """This knowledge base as it was at a version, to read from."""
        then = copy(self)
        then.store = Store(self.spark, self.store.path, version)
        then.store.pointer()
        return then

    def _index(self, chunks: DataFrame, state: dict | None = None) -> tuple[dict[str, DataFrame], dict]:
        """What is stored beside chunks (with embedding and terms) to find them, and their numbers.

        Centers are those of the state that is given, or trained on these chunks, if there are enough of them.
        """
        sums = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        centers, added = self.centers(state) if state else [], {"posting": ingest.posted(chunks)}
        if not centers and sums["n"] >= cells.TRAIN_FROM:
            centers = cells.trained(chunks, sums["n"])
            added["center"] = self.spark.createDataFrame(list(enumerate(centers, 1)), TABLES["center"])
        added["vector"] = cells.assigned(chunks, centers)
        added["reach"] = cells.reach(added["vector"])
        return added, {"chunks": sums["n"], "terms": sums["terms"]}

    def centers(self, state: dict) -> list[list[float]]:
        """The trained centers of the cells 1, 2, ...; at most MAX_CELLS."""
        if not state["tables"].get("center"):
            return []
        return [r["center"] for r in self.store.table("center", state).orderBy("cell").collect()]

    def compact(self) -> int:
        """Writes all tables anew, without what was deleted, as one part each, with newly trained cells; the new version."""
        state = self.store.pointer()
        anew = {}
        if state["tables"].get("chunk"):
            chunks = self.store.table("chunk", state)
            # indexed by the text, as stored: blocks are full again, and cells are those of all vectors
            anew, _ = self._index(chunks)
            if state["tables"].get("center") and "center" not in anew:
                anew["center"] = self.spark.createDataFrame([], TABLES["center"])
        return self.store.compacted(anew)

    def _meta(self) -> DataFrame:
        return self.store.meta_table(schema_version=SCHEMA_VERSION, embedding_model=self.embedder.name, embedding_dimension=self.embedder.dimension, tokenizer=self.tokenizer.name)

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def create_views(self) -> None:
        """The tables as temporary views, for spark.sql."""
        for name, df in self.store.tables().items():
            df.createOrReplaceTempView(name)

    # documents in

    def upload(self, path=None, url=None, content=None, content_base64=None, title: str | None = None, tags: Sequence[str] = (), metadata: Mapping[str, str] | None = None, force: bool = False) -> DataFrame:
        """Uploads files, pages or texts, one or many, in one commit; a row of status for each (see upload_rows).

        Of several, those that can't be taken are reported and the others stored. One that can't is an exception.
        """
        rows = sources.from_request(self.spark, self.config, path, url, content, content_base64, title)
        done = self.upload_rows(sources.extracted(rows, tags, dict(metadata or {})), force)
        first = done.limit(2).collect()
        if len(first) == 1 and first[0]["status"] == "failed":
            code, _, message = first[0]["error"].partition(": ")
            raise KnowledgeError(code, message)
        return done

    def upload_rows(self, rows: DataFrame, force: bool = False) -> DataFrame:
        """Uploads rows of the table document; a row with an error (column error, if there is one) is not taken.

        Returns document_id, title, sha256, status, chunks, tokens, entities, error: "created"; "skipped", where the
        same content is stored already or came first in rows, by their column order, if there is one, else as they are
        read, which for several files needn't be as they are named; "updated", with force; "empty", where there are no
        tokens, which is not stored and replaces nothing; "failed", with the error, which the table failure has too.
        Only new rows are written, and the ids of documents that they replace.
        """
        pointer = self.store.pointer()
        # written once, so ids and times are the same in all that follows
        staged = self.store.scratch()
        given = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
        # rows are named by _order in what follows, so texts are shuffled only to be filed
        every = self._stage("rows", given.withColumn("_order", F.monotonically_increasing_id()), staged, failed=F.count("error"))
        failed, batch = every.where("error is not null"), every.where("error is null").drop("error")
        check_documents(batch)
        by = [F.asc_nulls_last("order")] if "order" in batch.columns else []
        first = ingest.first_of_each(batch.select("_order", "document_id", "title", "sha256", *(["order"] if by else [])), *by, "_order").drop("order")
        known = self.store.known(first, pointer).select("sha256", F.lit(True).alias("_known"))
        marked = self._stage("marked", first.join(known, "sha256", "left"), staged, known=F.count("_known"))
        taken = marked if force else marked.where(F.col("_known").isNull())
        chunks = self._stage("chunks", sorted_chunks(self._chunked(ordered(batch, taken))), staged, tokens=F.sum("token_count"))
        check_chunks(chunks, self.embedder.dimension)
        filled = taken.join(chunks.select("document_id").distinct(), "document_id", "left_semi")
        some = not filled.isEmpty()
        new = ordered(batch, filled).drop("_order")
        replaced = filled.where(F.col("_known").isNotNull()).select("document_id")
        entities, mentions = self._entities(chunks, staged)

        found, stats = self._index(chunks, pointer)
        added = {"document": new, "mentions": mentions, "entity": entities, **found}
        if self.config.graph.extended:
            added["related_to"] = graph.part_of(new, "document_id").withColumn("weight", F.lit(1.0))
        bad = not failed.isEmpty()
        if bad:
            added["failure"] = failed.select("source", "error", F.current_timestamp().alias("failed_at"))
        state = F.when(F.col("chunks") == 0, "empty").when(F.col("_known").isNotNull(), "updated").otherwise("created")
        summary = ingest.upload_summary(taken, chunks, mentions)
        done = summary.join(marked.select("document_id", "_known", "_order"), "document_id").withColumn("status", state)
        done = done.withColumn("document_id", F.when(F.col("status") != "empty", F.col("document_id"))).withColumn("error", F.lit(None).cast("string"))
        others = batch.join(done.select("_order"), "_order", "left_anti").withColumns({"error": F.lit(None).cast("string"), "status": F.lit("skipped")})
        others = others.unionByName(failed.withColumns({"status": F.lit("failed"), "sha256": F.lit(None).cast("string")}), allowMissingColumns=True)
        others = others.withColumns({"document_id": F.lit(None).cast("string"), "chunks": F.lit(0).cast("long"), "tokens": F.lit(0).cast("long"), "entities": F.array().cast("array<string>")})
        columns = ["document_id", "title", "sha256", "status", "chunks", "tokens", "entities", "error"]
        result = done.select("_order", *columns).unionByName(others.select("_order", *columns))
        # a row for each given one, without its text; it outlives the folder
        told = self.store.scratch().replace("/staged/", "/uploads/")
        result.write.parquet(told)
        if some or bad:
            gone = None if not force or replaced.isEmpty() else replaced
            forgotten = None
            if gone is not None:
                forgotten, less = self._forgotten(gone, pointer)
                stats = {key: stats[key] - less[key] for key in stats}
            self._commit({t: df for t, df in added.items() if t == "failure" or some}, deleted=gone, since=pointer["version"], forgotten=forgotten, stats=stats if some else None, moved={"chunk": [f"{staged}/chunks"]} if some else None)
        self.store.remove(staged)
        return self.spark.read.schema(result.schema).parquet(told).orderBy("_order").drop("_order")

    def _how(self) -> str:
        """What chunks and their embeddings hang on besides the content."""
        windows = self.config.chunking
        return json.dumps([self.embedder.name, self.embedder.dimension, self.tokenizer.name, windows.max_tokens, windows.overlap_tokens])

    def _marked(self, documents: DataFrame) -> DataFrame:
        """documents with made: a hash of their content's hash and of how they are chunked and embedded now."""
        return documents.withColumn("made", F.md5(F.concat(F.lit(self._how()), "sha256")))

    def _chunked(self, documents: DataFrame) -> DataFrame:
        """The rows of chunk that documents make; made tells from what."""
        windows = self.config.chunking
        return ingest.indexed(ingest.embedded(ingest.chunk_rows(self._marked(documents), self.tokenizer, windows.max_tokens, windows.overlap_tokens), self.embedder))

    def _stage(self, name: str, rows: DataFrame, staged: str, **sums: Column) -> DataFrame:
        """rows, written under staged and read again. Then progress(name, numbers) is called: the number of rows, and sums.

        Stages are rows (given), marked (of different content, and known ones), chunks (of each batch, in a reindex),
        taken (where a reindex takes up what there is) and found (entities), and committed, with the version. The numbers are observed as the rows are written, so they take no other job.
        """
        seen = Observation(name)
        if self.progress:
            given = {key: F.coalesce(value.cast("long"), F.lit(0)).alias(key) for key, value in sums.items()}
            rows.observe(seen, F.count(F.lit(1)).alias("rows"), *given.values()).write.option("compression", "zstd").parquet(f"{staged}/{name}")
            self.progress(name, seen.get)
        else:
            rows.write.option("compression", "zstd").parquet(f"{staged}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{staged}/{name}")

    def _commit(self, *given, **more) -> int:
        version = self.store.commit(*given, **more)
        if self.progress:
            self.progress("committed", {"version": version})
        return version

    def _entities(self, chunks: DataFrame, staged: str) -> tuple[DataFrame, DataFrame]:
        """The rows of entity and of mentions; what they are made of is extracted once, and stored under staged."""
        found = graph.extract(chunks, "chunk_id", extended=self.config.graph.extended, extractors=self.extractors)
        found = self._stage("found", found, staged)
        return graph.entity_rows(found), graph.mention_edges(found)

    def _forgotten(self, gone: DataFrame, state: dict) -> tuple[DataFrame, dict]:
        """(term, df) and the numbers of the stored chunks of documents (document_id) that go; only their text is read again."""
        chunks = self.store.table("chunk", state).join(few(gone.select("document_id").distinct()), "document_id", "left_semi")
        sums = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        terms = chunks.select(F.explode(F.array_distinct(text.analyzed(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return terms.repartitionByRange("term").sortWithinPartitions("term"), {"chunks": sums["n"], "terms": sums["terms"]}

    # answers out

    def search(self, query: str | Sequence[str], mode: str | None = None, top_k: int | None = None, graph_expand: int = 0, filter: Mapping[str, str] | None = None, prefilter: bool = False, exact: bool = True, probes: int = 8, hops: int = 0, undefined: bool = False) -> DataFrame:
        """query_id, rank, document_id, chunk_id, chunk_idx, content, score, title, source, highlights (stretches around
        query terms, but for vector mode) and matched_entities (of chunks that graph_expand adds) for one query or many.

        Hits are found in the stored blocks of postings and cells of vectors (self.read tells how much of them was
        read), then their text is read by name. Vectors: exact, or with exact=False from the `probes` nearest cells. The
        filter is applied after the top k, so fewer rows may come; with prefilter before, to all chunks, whose postings
        and vectors are then read. Chunks that share an entity with the first hits, graph_expand of them at most, come
        after the hits; with hops, those of entities so many edges away too, and all are ranked anew by their distance.

        Chunks whose cosine isn't defined, as their vector or the query's is zero, are no hits of a vector; with
        undefined they are, with the score NaN, which comes first in the order of SQL.
        """
        mode, k = mode or self.config.search.default_mode, top_k or self.config.search.top_k
        if mode not in search.MODES:
            raise KnowledgeError("E_VALIDATION", f"unknown mode: {mode}")
        given = search.check_filter(filter)
        queries = [query] if isinstance(query, str) else [*query]
        asked = self.spark.createDataFrame([*enumerate(queries)], "query_id long, query string")
        now = self.store.pointer()
        keep = None
        if prefilter and given:
            keep = self.store.table("document", now).where(all_of([F.col(c) == v for c, v in given.items()])).select("document_id")
        self.read: dict = {}
        by_vector = lambda k: self._by_vector(asked, k, now, keep, exact, probes, undefined)
        by_term = lambda k: self._by_term(asked, k, now, keep)
        if mode == "vector":
            hits = by_vector(k)
        elif mode == "keyword":
            hits = by_term(k)
        else:
            hits = search.fused(by_vector(3 * k), by_term(3 * k), k, self.config.search.rrf_k)
        matched = None
        few = len(queries) * (k + graph_expand) <= search.MAX_HITS
        if few:  # ranked once; what follows reads by these names
            hits = self.spark.createDataFrame(hits.collect(), hits.schema)
        if graph_expand > 0 and hops > 0:
            mentions = self.store.table("mentions", now)
            ranked = graph.reranked(hits, mentions, graph.reached(hits, mentions, self.store.edges(now), hops), graph_expand)
            if few:
                ranked = self.spark.createDataFrame(ranked.collect(), ranked.schema)
            hits, matched = ranked.drop("matched"), ranked.select("query_id", "id", "matched")
        elif graph_expand > 0:
            more = graph.expand_hits(hits, self.store.table("mentions", now), graph_expand)
            hits, matched = graph.appended(hits, more), more.select("query_id", "id", "matched")
        return self._told(asked, hits, matched, now, given, mode != "vector", few)

    def _by_vector(self, asked: DataFrame, k: int, now: dict, keep: DataFrame | None, exact: bool, probes: int, undefined: bool = False) -> DataFrame:
        vectors = asked.select("query_id", self.embedder.embed(F.col("query"), F.lit(0)).alias("vector"))
        stored = self.store.table("vector", now)
        if keep is not None:
            hits = search.vector_search(stored.join(keep, "document_id", "left_semi"), vectors, k)
        else:
            stats = {r["cell"]: (r["rows"], r["radius"]) for r in self.store.table("reach", now).collect()}  # a row for each cell
            hits, self.read["vector"] = cells.cell_search(stored, self.centers(now), stats, vectors, k, exact, probes)
        if not undefined:
            return hits
        chunks = self.store.table("chunk", now)
        if keep is not None:
            chunks = chunks.join(keep, "document_id", "left_semi")
        return search.top_k(hits.select("query_id", "id", "score").unionByName(search.undefined_pairs(chunks, vectors, k)), k)

    def _by_term(self, asked: DataFrame, k: int, now: dict, keep: DataFrame | None) -> DataFrame:
        terms = asked.select("query_id", F.explode(text.analyzed(F.col("query"))).alias("term"))
        how = {"k1": self.config.search.bm25_k1, "b": self.config.search.bm25_b}
        many = terms.select("term").distinct().limit(index.NAMED_TERMS + 1).count() > index.NAMED_TERMS
        if keep is None and not many:
            alive = lambda rows: self.store.alive(rows, "posting", now)
            scores, self.read["keyword"] = index.block_search(self.store.blocks(now), alive, self.store.forgotten(now), now["stats"]["chunks"], now["stats"]["terms"], terms, k, **how)
            return search.top_k(scores, k)
        posted, chunks = self.store.table("posting", now), self.store.table("chunk", now)
        if keep is not None:
            posted, chunks = (t.join(keep, "document_id", "left_semi") for t in (posted, chunks))
        return search.top_k(index.stored_scores(posted, chunks.select("terms"), terms, **how), k)

    def _told(self, asked: DataFrame, hits: DataFrame, matched: DataFrame | None, now: dict, given: dict, marked: bool, few: bool) -> DataFrame:
        """hits with their text, and what their documents are called. So many hits as can be named are named in the scans."""
        documents, chunks = self.store.table("document", now), self.store.table("chunk", now)
        named = [r["id"] for r in hits.select("id").distinct().limit(search.NAMED_HITS + 1).collect()] if few else []
        if few and len(named) <= search.NAMED_HITS:
            chunks = chunks.where(F.col("chunk_id").isin(named))
            documents = documents.where(F.col("document_id").isin(sorted({n.rpartition("#")[0] for n in named})))
        told = chunks.select(F.col("chunk_id").alias("id"), "document_id", F.col("idx").alias("chunk_idx"), "content")
        full = told.join(F.broadcast(hits) if few else hits, "id")
        full = search.filtered(full, documents, given)
        called = documents.select("document_id", "title", "source").join(F.broadcast(full) if few else full, "document_id")
        nothing = F.array().cast("array<string>")
        if matched is None:
            called = called.withColumn("matched", nothing)
        else:
            called = called.join(matched, ["query_id", "id"], "left")
        words = asked.select("query_id", F.array_distinct(text.analyzed(F.col("query"))).alias("_words"))
        called = called.join(F.broadcast(search.check_queries(words)), "query_id")
        marks = text.highlights(F.col("content"), F.col("_words")) if marked else nothing
        return called.select(
            "query_id", "rank", "document_id", F.col("id").alias("chunk_id"), "chunk_idx", "content", "score", "title", "source",
            marks.alias("highlights"), F.coalesce("matched", nothing).alias("matched_entities"),
        ).orderBy("query_id", "rank")

    def list(self, limit: int = 50, offset: int = 0, order: str = "created_desc") -> DataFrame:
        return manage.listed(self.table("document"), self.table("chunk"), limit, offset, order)

    def get(self, document_id: str, with_chunks: bool = False) -> DataFrame:
        return manage.got(self.table("document"), self.table("chunk"), document_id, with_chunks)

    def delete(self, document_id: str | Sequence[str]) -> DataFrame:
        """document_id, chunks_deleted for each id that was given, in one commit; an unknown one has 0. Only the ids are written."""
        ids = [document_id] if isinstance(document_id, str) else [*document_id]
        return self.delete_rows(self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "document_id string"))

    def delete_rows(self, gone: DataFrame) -> DataFrame:
        """delete() of the documents of a table (document_id)."""
        gone = few(gone.select("document_id").distinct())
        pointer = self.store.pointer()
        chunks = self.store.table("chunk", pointer)
        counts = chunks.join(gone, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks_deleted"))
        if not self.store.table("document", pointer).join(gone, "document_id", "left_semi").isEmpty():
            forgotten, less = self._forgotten(gone, pointer)
            self.store.commit(deleted=gone, since=pointer["version"], forgotten=forgotten, stats={key: -n for key, n in less.items()})
        return gone.join(counts, "document_id", "left").select("document_id", F.coalesce("chunks_deleted", F.lit(0)).cast("long").alias("chunks_deleted"))

    def stats(self) -> dict:
        row = manage.stats(self.table("document"), self.table("chunk")).first().asDict()
        return row | {"embedding_model": self.embedder.name, "embedding_dimension": self.embedder.dimension}

    def doctor(self) -> list[str]:
        meta = self.store.meta()
        return [
            f"store: {self.store.path}, version {self.store.pointer()['version']}",
            f"schema version: {meta.get('schema_version')}",
            f"embedding: {meta.get('embedding_model')}, dimension {meta.get('embedding_dimension')} (configured: {self.embedder.name}, {self.embedder.dimension})",
            f"tokenizer: {meta.get('tokenizer')} (configured: {self.tokenizer.name}), vocabulary: {getattr(self.tokenizer, 'vocab_size', None) or 'none'}",
            f"spark: {self.spark.version}",
        ]

    # the graph

    def upsert_entity(self, name: str, kind: str, description: str | None = None) -> str:
        key = graph.parse_start(name if ":" not in name else f"entity:{name}")[1]
        new = self.spark.createDataFrame([(key, name, kind, description)], "entity_id string, name string, kind string, description string")
        self.store.commit({"entity": new})
        return key

    def link_entities(self, src: str, dst: str, relation: str, weight: float = 1.0) -> None:
        ends = [graph.parse_start(x if ":" not in x else f"entity:{x}")[1] for x in (src, dst)]
        none = self.spark.createDataFrame([], TABLES["related_to"])
        self.store.commit({"related_to": graph.link(none, *ends, relation, weight)})

    def graph_query(self, start: str, relation: str | None = None, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        now = self.store.pointer()
        t = self.store.tables(now)
        return graph.traverse(start, t["document"], t["chunk"], t["entity"], t["mentions"], self.store.edges(now), relation, depth, limit)

    def extract_and_save_entities(self, document_id: str) -> DataFrame:
        """Entities of the whole text of one document, saved; name, kind."""
        own = manage.got(self.table("document"), self.table("chunk"), document_id)
        found = graph.entity_rows(graph.extract(own, "document_id", extended=self.config.graph.extended, extractors=self.extractors))
        self.store.commit({"entity": found})
        return found.select("name", "kind")

    def reindex(self, dry_run: bool = False, stale_only: bool = False, resume: bool = True, batch_rows: int = 1_000_000) -> dict:
        """Chunks, embeddings and mentions of all documents anew, in one commit; the store then has this embedder's.

        Documents are taken in batches of about batch_rows (MAX_BATCHES at most), each some of their folders, and the
        chunks of a batch are kept as it ends. If the reindex is interrupted, or another commit comes in between, the next
        one with the same embedder, tokenizer and windows goes on from there: it takes the kept chunks of documents that
        are stored still with the same content, and makes those of the others. With resume=False nothing kept is taken.
        Until the commit searches see the old chunks, so never those of two models.

        With stale_only, stored chunks that were made in the way that is asked for are taken too, and nothing is written
        where all are. A dry run counts only; it counts entities of whole texts, not of chunks.
        """
        check_windows(self.config.chunking.max_tokens, self.config.chunking.overlap_tokens)
        if batch_rows < 1:
            raise KnowledgeError("E_VALIDATION", "batch_rows must be at least 1")
        pointer = self.store.pointer()
        stored = self.store.tables(pointer)
        if dry_run:
            chunks = ingest.chunk_rows(stored["document"], self.tokenizer, self.config.chunking.max_tokens, self.config.chunking.overlap_tokens)
            return reindex_counts(stored["document"], chunks)
        name = f"reindex/{hashlib.md5(self._how().encode()).hexdigest()}"
        folder, staged = f"{self.store.path}/{name}", self.store.scratch()
        if not resume:
            self.store.remove(folder)
        kept = self.store.finished(f"{name}/*/chunks")
        read = lambda parts: self.spark.read.schema(TABLES["chunk"]).parquet(*parts)
        had = [read(kept)] if kept else []
        if stale_only:
            had.append(stored["chunk"])
        documents = self._marked(stored["document"]).select("document_id", "made")
        done = None
        for some in had:
            ids = some.select("document_id", "made").distinct().join(documents, ["document_id", "made"], "left_semi").select("document_id")
            done = ids if done is None else done.union(ids).distinct()
        left = documents.count() if done is None else documents.join(done, "document_id", "left_anti").count()
        if stale_only and not left and not kept and self.store.meta().get("embedding_model") == self.embedder.name:
            return self._reindexed()
        made, batches = [], min(MAX_BATCHES, -(-left // batch_rows))
        for i in range(batches):
            batch = self.store.filed(pointer, i, batches)
            if done is not None:
                batch = batch.join(done, "document_id", "left_anti")
            own = f"{folder}/{uuid.uuid4().hex}"
            made.append(f"{own}/chunks")
            self._stage("chunks", sorted_chunks(self._chunked(batch)), own, tokens=F.sum("token_count"))
        new = read([*kept, *made]) if kept or made else self.spark.createDataFrame([], TABLES["chunk"])
        folders = [*kept, *made]
        if had:
            # what was made now is of the documents as they are, so only what was kept may be stale, and written again
            every = new.unionByName(stored["chunk"]) if stale_only else read(kept)
            keys = every.select("chunk_id", "document_id", "made")
            stale = keys.select("document_id", "made").distinct().join(documents, ["document_id", "made"], "left_anti").select(F.col("document_id").alias("_id"), F.col("made").alias("_made"))
            if stale_only or not stale.isEmpty() or not twice(keys).isEmpty():
                same = (F.col("document_id") == F.col("_id")) & F.col("made").eqNullSafe(F.col("_made"))
                fresh = every.join(few(stale), same, "left_anti")
                # equal rows of a document that was both kept and stored, or kept by two at once, count once
                fresh = fresh if twice(fresh).isEmpty() else fresh.dropDuplicates(["chunk_id"])
                self._stage("taken", sorted_chunks(fresh), staged)
                folders = [f"{staged}/taken", *([] if stale_only else made)]
                new = read(folders)
        entities, mentions = self._entities(new, staged)
        found, stats = self._index(new)
        if "center" not in found:
            found["center"] = self.spark.createDataFrame([], TABLES["center"])
        self._commit({"entity": entities, "meta": self._meta()}, replace={"mentions": mentions, **found}, since=pointer["version"], stats=stats, moved={"chunk": folders}, emptied=["chunk"])
        self.store.remove(folder)
        self.store.remove(staged)
        return self._reindexed()

    def _reindexed(self) -> dict:
        done = self.table("chunk").agg(F.count_distinct("document_id").alias("d"), F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).first()
        return {"dry_run": False, "documents_processed": done["d"], "chunks_created": done["c"], "tokens_total": done["t"], "entities_extracted": self.table("mentions").count()}


def sorted_chunks(chunks: DataFrame) -> DataFrame:
    """chunks in the shape and order of a part of their table."""
    return shaped(chunks, "chunk").sortWithinPartitions(SORTED["chunk"])


def twice(chunks: DataFrame) -> DataFrame:
    """The chunk_ids that are there more than once."""
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordered(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows with the _order of a row of kept. Whichever are few, those that are kept or the others, are broadcast."""
    kept = kept.select("_order")
    n = kept.count()
    if n > MAX_NAMED and rows.count() - n <= MAX_NAMED:
        return rows.join(F.broadcast(rows.select("_order").join(kept, "_order", "left_anti")), "_order", "left_anti")
    return rows.join(F.broadcast(kept) if n <= MAX_NAMED else kept, "_order", "left_semi")


def reindex_counts(documents: DataFrame, chunks: DataFrame) -> dict:
    c = chunks.agg(F.count_distinct("document_id").alias("d"), F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).first()
    e = documents.agg(F.coalesce(F.sum(F.size(text.entities(F.col("content")))), F.lit(0)).alias("e")).first()
    return {"dry_run": True, "documents_processed": c["d"], "chunks_created": c["c"], "tokens_total": c["t"], "entities_extracted": e["e"]}
