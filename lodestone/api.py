"""The public queries over one set of tables or one index: find, context, impact, window and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import expand_query, literals_of_regex, signals_of
from lodestone.functions.vectors import hash_embedding_of
from lodestone.operators import extract, graph, grep, lookup, notes, search, windows
from lodestone.sources.tables import current_corpus, current_files, table
from lodestone.sources.versioned import read_version

MODES = ("search", "symbol", "grep", "paths", "recent", "context")


def clamp(value: object, default: int, most: int) -> int:
    """A whole number in 1..most; the default for None and what is not a number."""
    try:
        number = int(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default
    return max(1, min(most, number))


class Engine:
    """Queries over the tables of one folder, or over an index that ``build_index`` wrote.

    Every method returns a DataFrame of at most top_k rows where it ranks. Over an index, searches read stored
    postings, vectors, n-grams and edges instead of the texts.
    """

    def __init__(self, spark: SparkSession, folder: str, workspace: str | None = None):
        own = self._own(workspace)
        self.stored: dict[str, DataFrame] = {}
        self.files, self.corpus = own(current_files(spark, folder)), own(current_corpus(spark, folder))
        self.symbols = own(table(spark, folder, "symbols").dropDuplicates(["id"]))
        self.chunks = own(table(spark, folder, "chunks").dropDuplicates(["symbol_id"]))
        self.notes = own(table(spark, folder, "memories"))

    @staticmethod
    def _own(workspace: str | None):
        return (lambda df: df.where(F.col("workspace") == workspace)) if workspace else (lambda df: df)

    @classmethod
    def over_index(cls, spark: SparkSession, root: str, notes: DataFrame | None = None, workspace: str | None = None) -> Engine:
        """An engine that reads the current version of every table below ``root``; notes are given beside it."""
        engine = cls.__new__(cls)
        own = cls._own(workspace)
        engine.stored = {name: own(read_version(spark, f"{root}/{name}")) for name in ("files", "corpus", "symbols", "chunks", "imports", "calls", "ngrams", "postings", "stats", "vectors")}
        engine.files, engine.corpus, engine.symbols = engine.stored["files"], engine.stored["corpus"], engine.stored["symbols"]
        engine.chunks = engine.stored["chunks"].withColumnRenamed("id", "symbol_id")
        engine.notes = None if notes is None else own(notes)
        return engine

    def _chunk_docs(self) -> DataFrame:
        names = self.symbols.select(F.col("id").alias("symbol_id"), "name", "line")
        return self.chunks.join(names, "symbol_id").select(F.col("symbol_id").alias("id"), "workspace", "path", "name", "line", F.concat_ws("\n", "header", "text").alias("text"))

    def _imports(self) -> DataFrame:
        return self.stored["imports"] if self.stored else extract.resolve_imports(extract.import_edges(self.corpus), self.files)

    def _ranked_chunks(self, query: str, path_prefix: str | None) -> DataFrame:
        """(id, score, rank) of the best chunks, of those below a path prefix only where one is given."""
        if not self.stored:
            docs = self._chunk_docs()
            return search.hybrid_search(docs if path_prefix is None else docs.where(F.col("path").startswith(path_prefix)), query, "id", "text", 20)
        within = lambda df: df if path_prefix is None else df.join(self.chunks.where(F.col("path").startswith(path_prefix)).select(F.col("symbol_id").alias("id")), "id", "left_semi")
        return search.hybrid_stored(within(self.stored["postings"]), self.stored["stats"], within(self.stored["vectors"]), query)

    def find(self, query: str, mode: str = "search", kind: str | None = None, top_k: object = 8, path_prefix: str | None = None) -> DataFrame:
        """Hits of a query. Modes: search, symbol, grep, paths, recent, context. An unknown mode or an empty query is an error."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if mode != "recent" and not query.strip():
            raise ValueError("query is empty")
        k = clamp(top_k, 8, 20)
        if mode == "symbol":
            return lookup.symbol_lookup(self.symbols, query, k, kind)
        if mode == "grep":
            literals = literals_of_regex(query) if self.stored else []
            within = self.corpus.join(grep.grep_candidates(self.stored["ngrams"], literals), ["workspace", "path"], "left_semi") if literals else self.corpus
            return grep.grep_lines(within, query, k, path_prefix=path_prefix)
        if mode == "paths":
            return lookup.list_paths(self.files, query, max(k, 40))
        if mode == "recent":
            return lookup.recent_symbols(self.symbols, self.files, k)
        ranked = self._ranked_chunks(query, path_prefix)
        hits = self._chunk_docs().join(F.broadcast(ranked), "id").select(F.col("id").alias("hit_id"), "workspace", "path", "line", F.col("name").alias("symbol"), "score", F.substring("text", 1, 240).alias("snippet"))
        if mode == "context":
            return lookup.context_pack(hits, self._imports() if self.stored else extract.import_edges(self.corpus))
        best = hits.orderBy(F.desc("score"), "hit_id").limit(k)
        shown = windows.enrich_hits(best.select("hit_id", "workspace", "path", "line", "snippet"), self.chunks, self.corpus)
        return best.drop("snippet", "line", "path", "workspace").join(shown, "hit_id").orderBy(F.desc("score"), "hit_id")

    def context(self, task: str, top_k: object = 8) -> DataFrame:
        """(part, path, score, detail) for a task: hits of the names that stand out in it, else of the whole task, else of the
        names by themselves; packed within the token budget.
        """
        k = clamp(top_k, 8, 20)
        names = signals_of(task)
        for query in ([" ".join(names)] if names else []) + [task]:
            packed = self.find(query, "context", top_k=k)
            if not packed.isEmpty():
                return packed
        found = lookup.fallback_ladder(self.symbols, self.corpus, names or task.split(), k)
        return found.select(F.lit("name").alias("part"), "path", F.lit(0.0).alias("score"), F.col("text").alias("detail"))

    def impact(self, name: str, depth: object = 2) -> DataFrame:
        """Definitions, importers, callers and references of a name."""
        if not name.strip():
            raise ValueError("name is empty")
        calls = self.stored["calls"] if self.stored else extract.call_edges(self.corpus)
        return graph.impact(self.symbols, self._imports(), calls, self.corpus, name, clamp(depth, 2, 3))

    def window(self, path: str, start_line: int, end_line: int) -> DataFrame:
        """(first, last, clamped, body) of a file's lines; no row for unsafe and unknown paths."""
        ranges = self.files.where(F.col("path") == path).select(F.lit(1).alias("hit_id"), "workspace", "path", F.lit(int(start_line)).alias("first"), F.lit(int(end_line)).alias("last"))
        return windows.read_windows(ranges, self.corpus)

    def recall(self, query: str, as_of: str, scope: list[str] | None = None, top_k: object = 3) -> DataFrame:
        """(id, score) of the notes to recall; the caller writes ``notes.mark_recalled``."""
        text = self.notes.select("id", F.concat_ws(" ", "text", "tags", "paths").alias("text"))
        phrases = [t for t in expand_query(query) if t.isascii() and t.isalnum()]
        lexical = search.ranked(search.bm25(text, "id", "text", [p.lower() for p in phrases]), "id", 40) if phrases else None
        return notes.recall(self.notes, hash_embedding_of(query).tolist(), lexical, as_of, scope, clamp(top_k, 3, 10))
