"""Impact and call-graph queries over import and call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Callees that say little about a project.
NOISE_NAMES = "expect jest describe it test beforeeach aftereach console json buffer math object array promise error map set date number string boolean regexp parseint parsefloat require import logger debug info warn error log".split()
NOISE_PREFIXES = "expect. jest. console. logger. JSON. Buffer. Math. Object. Array. Promise. fs. path. process.".split()
DECORATORS = "Get Post Put Patch Delete Body Query Param Inject Injectable Module Controller Column Entity".split()


def useful_callee(name):
    """Whether a called name is worth showing: two characters or more, no noise word, noise prefix or decorator."""
    n = F.trim(name)
    prefixed = F.lit(False)
    for p in NOISE_PREFIXES:
        prefixed = prefixed | n.startswith(p)
    return (F.length(n) >= 2) & (n != "(anon)") & ~F.lower(n).isin(*NOISE_NAMES) & ~prefixed & ~n.isin(*DECORATORS)


def definitions(symbols: DataFrame, name: str) -> DataFrame:
    """(workspace, path, line, name, exact): symbols of the name or members called so."""
    exact = F.col("name") == name
    return symbols.where(exact | F.col("name").endswith(f".{name}")).select("workspace", "path", "line", "name", exact.cast("int").alias("exact")).distinct()


def best_definitions(symbols: DataFrame, name: str, k: int = 20) -> DataFrame:
    """(workspace, path, line, name, rank): the first k definitions, exact ones first."""
    order = [F.desc("exact"), "workspace", "path", "line", "name"]
    best = definitions(symbols, name).orderBy(*order).limit(k)
    return best.select("workspace", "path", "line", "name", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # k rows


def importers(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(workspace, path, depth): files that import a start file, directly or through others, at their least depth.

    edges (workspace, from_path, to_path); start (workspace, path). Breadth first with a visited set;
    depth is clamped to 1..3. Start files themselves are left out.
    """
    depth = max(1, min(3, depth))
    known = edges.where("to_path is not null").select("workspace", "from_path", "to_path").distinct()
    seen = start.select("workspace", "path").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, depth + 1):
        reached = known.join(frontier.select("workspace", F.col("path").alias("to_path")), ["workspace", "to_path"]).select("workspace", F.col("from_path").alias("path")).distinct()
        frontier = reached.join(seen.select("workspace", "path"), ["workspace", "path"], "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def callers(calls: DataFrame, name: str, defined: DataFrame, k: int | None = None) -> DataFrame:
    """(workspace, path, line, to_name): calls of the name or a member of it, outside the files that define it."""
    met = calls.where((F.col("to_name") == name) | F.col("to_name").endswith(f".{name}")).select("workspace", F.col("from_path").alias("path"), "line", "to_name").distinct()
    out = met.join(defined.select("workspace", "path").distinct(), ["workspace", "path"], "left_anti")
    return out if k is None else out.orderBy("workspace", "path", "line", "to_name").limit(k)


def references(files: DataFrame, name: str, *known: DataFrame) -> DataFrame:
    """(workspace, path): files whose text holds the name as a whole word, other than the known ones."""
    out = files.where(F.contains("content", F.lit(name)) & F.col("content").rlike(rf"(^|[^A-Za-z0-9_]){name}([^A-Za-z0-9_]|$)")).select("workspace", "path").distinct()
    for k in known:
        out = out.join(k.select("workspace", "path").distinct(), ["workspace", "path"], "left_anti")
    return out


def impact(symbols: DataFrame, edges: DataFrame, calls: DataFrame, files: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """(section, workspace, path, line, score) of definitions, importers, callers and references of a name."""
    defined = definitions(symbols, name)
    imported = importers(edges, defined, depth)
    called = callers(calls, name, defined)
    referred = references(files, name, defined, called)
    return (
        defined.select(F.lit("definition").alias("section"), "workspace", "path", "line", F.lit(1.0).alias("score"))
        .unionByName(imported.select(F.lit("importer").alias("section"), "workspace", "path", F.lit(0).alias("line"), (F.lit(depth) - F.col("depth") + 1).cast("double").alias("score")))
        .unionByName(called.select(F.lit("caller").alias("section"), "workspace", "path", "line", F.lit(0.8).alias("score")))
        .unionByName(referred.select(F.lit("reference").alias("section"), "workspace", "path", F.lit(0).alias("line"), F.lit(0.5).alias("score")))
    )


def call_graph(calls: DataFrame, top: int = 288, targets: int = 48, most_edges: int = 90, most_nodes: int = 72) -> DataFrame:
    """(source, target, weight) of a readable sample: the most called useful names and the files that call them.

    Sources are admitted in order of their heaviest edge while the nodes stay within ``most_nodes``. The
    sample is top-k of grouped counts throughout; only its few rows meet in one window.
    """
    degree = calls.groupBy("to_name").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "to_name").limit(top)
    chosen = degree.where(useful_callee(F.col("to_name"))).orderBy(F.desc("degree"), "to_name").limit(targets)
    weighted = calls.join(F.broadcast(chosen.select("to_name")), "to_name").groupBy("from_path", "to_name").agg(F.count("*").alias("weight"))
    edges = weighted.orderBy(F.desc("weight"), "from_path", "to_name").limit(3 * most_edges)
    order = Window.orderBy(F.desc("weight"), "from_path", "to_name")
    numbered = edges.withColumn("n", F.row_number().over(order))
    first = numbered.groupBy("from_path").agg(F.min("n").alias("first"))
    admitted = first.withColumn("place", F.row_number().over(Window.orderBy("first"))).where(F.col("place") <= most_nodes - targets).select("from_path")
    kept = numbered.join(admitted, "from_path").orderBy("n").limit(most_edges)
    return kept.select(F.col("from_path").alias("source"), F.col("to_name").alias("target"), "weight")


def call_graph_nodes(calls: DataFrame, symbols: DataFrame, top: int = 48) -> DataFrame:
    """(name, kind, line, n_paths, callers, sites) of the most called useful names; kind and line of the first definition, if any."""
    last = F.element_at(F.split("to_name", r"\."), -1)
    degree = calls.where(useful_callee(F.col("to_name"))).groupBy(last.alias("name")).agg(F.count("*").alias("sites"), F.countDistinct("workspace", "from_path").alias("callers"))
    chosen = degree.orderBy(F.desc("sites"), "name").limit(top)
    place = F.struct("workspace", "path", "line")
    defined = symbols.join(F.broadcast(chosen.select("name")), "name", "left_semi").groupBy("name").agg(F.min_by("kind", place).alias("kind"), F.min_by("line", place).alias("line"), F.countDistinct("workspace", "path").alias("n_paths"))
    return chosen.join(defined, "name", "left").select("name", "kind", "line", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "callers", "sites")


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(workspace, from_path, to_name, line, n, from_symbol): calls of one line counted, with the innermost symbol that holds the line, if any.

    An equi-join on the file with the line range as residue; an aggregate keeps one symbol for each call.
    """
    key = ["workspace", "from_path", "to_name", "line"]
    counted = calls.groupBy(*key).agg(F.count("*").alias("n"))
    last = F.coalesce("end_line", "line")
    spans = symbols.select("workspace", F.col("path").alias("from_path"), F.col("name").alias("symbol"), F.least("line", last).alias("a"), F.greatest("line", last).alias("b")).distinct()
    met = counted.join(spans, ["workspace", "from_path"]).where("line between a and b")
    best = met.groupBy(*key).agg(F.min_by("symbol", F.struct(F.col("b") - F.col("a"), -F.col("a"), F.col("symbol"))).alias("from_symbol"))
    return counted.join(best, key, "left")


def node_details(held: DataFrame, symbols: DataFrame, top: int = 48, paths: int = 6, peers: int = 8) -> DataFrame:
    """(name, kind, signature, line, paths, callers, callees, top_callers, top_callees) of the most called useful names.

    ``held`` are calls with their symbols, as ``enclosing`` gives them. Kind, signature (160 characters) and line
    are of the first definition; callers and callees are numbers of calls by and of useful names, callers that of
    all calls where no caller is known; the peers with most calls are listed, joined by blanks.
    """
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    counted = held.where(useful_callee(F.col("to_name"))).groupBy(last("to_name").alias("name")).agg(F.sum("n").alias("sites"))
    chosen = counted.orderBy(F.desc("sites"), "name").limit(top)
    names = F.broadcast(chosen.select("name"))  # ``top`` rows
    place = F.struct("workspace", "path", "line")
    defined = symbols.join(names, "name", "left_semi")
    first = defined.groupBy("name").agg(F.min_by("kind", place).alias("kind"), F.min_by(F.substring("signature", 1, 160), place).alias("signature"), F.min_by("line", place).alias("line"))
    ordered = Window.partitionBy("name").orderBy("path")
    listed = defined.select("name", "path").distinct().withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= paths).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("paths"))

    def side(name, peer, total: str, best: str) -> DataFrame:
        pairs = held.select(name.alias("name"), peer.alias("peer"), "n").where(F.coalesce(F.col("peer"), F.lit("")) != "").where(useful_callee(F.col("peer"))).join(names, "name").groupBy("name", "peer").agg(F.sum("n").alias("w"))
        numbered = pairs.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("w"), "peer")))
        shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= peers, F.struct("r", "peer")))), lambda x: x.peer), " ")
        return numbered.groupBy("name").agg(F.sum("w").alias(total), shown.alias(best))

    callers = side(last("to_name"), F.col("from_symbol"), "callers", "top_callers")
    callees = side(last("from_symbol"), F.col("to_name"), "callees", "top_callees")
    joined = chosen.join(first, "name", "left").join(listed, "name", "left").join(callers, "name", "left").join(callees, "name", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select("name", "kind", "signature", "line", empty("paths"), F.coalesce("callers", "sites").alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), empty("top_callers"), empty("top_callees"))
