"""Building a whole index from a corpus, as versioned tables by workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import hash_vectors
from lodestone.operators import extract, grep, search


def index_tables(files: DataFrame, corpus: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index: files, corpus, symbols, chunks, imports, calls, ngrams, postings with their stats, and vectors, each keyed by workspace.

    files and corpus are current versions, one row for each (workspace, path).
    """
    corpus = corpus.where("workspace is not null and path is not null")
    symbols = extract.python_symbols(corpus).unionByName(extract.go_symbols(corpus)).unionByName(extract.script_symbols(corpus))
    symbols = symbols.withColumn("id", F.xxhash64("workspace", "path", "line", "name", "kind"))
    chunks = extract.build_chunks(symbols, corpus)
    imports = extract.resolve_imports(extract.import_edges(corpus), files)
    docs = chunks.select("workspace", "id", F.concat_ws("\n", "header", "text").alias("text"))
    named = symbols.select("id", "name", "kind").join(chunks.select("id", "workspace", "text"), "id")
    inputs = named.select(F.struct("workspace", "id").alias("key"), F.concat(F.concat_ws(" ", "name", "kind"), F.lit("\n"), "text").alias("input"))
    vectors = hash_vectors(inputs, "key", "input").select("key.workspace", "key.id", "embedding")
    return {
        "files": files, "corpus": corpus, "symbols": symbols, "chunks": chunks, "imports": imports, "calls": extract.resolve_calls(extract.call_edges(corpus), symbols, imports),
        "ngrams": grep.ngram_postings(corpus, settled=True).withColumn("part", F.substring("hash", 1, 2)),
        "postings": search.postings_of(docs, ["workspace", "id"], "text"), "stats": search.posting_stats(docs, "text", "workspace"), "vectors": vectors,
    }


def build_index(files: DataFrame, corpus: DataFrame, root: str) -> dict[str, str]:
    """Write every index table as a new version below ``root``; returns the versions.

    Postings lie in folders by the first two characters of the term and n-grams by the first two of the hash, sorted by
    workspace within, so a query reads the folders that its terms can be in; the other tables lie by workspace.
    Rows go to the files evenly, a large folder to several.
    """
    from lodestone.sources.versioned import write_version

    written = {}
    for name, df in index_tables(files, corpus).items():
        by = "part" if "part" in df.columns else "workspace"
        written[name] = write_version(df.hint("rebalance", by).sortWithinPartitions(*dict.fromkeys([by, "workspace"])), f"{root}/{name}", [by])
    return written
