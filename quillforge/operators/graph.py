"""Dependency graphs as two tables: nodes(id, kind) and edges(source, target, kind)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..io import written
from .joins import first_match, longest_prefix, prefer_submodules, relative_base

UNREACHABLE = 1 << 30
ROOT = "(root)"
#: Files that mark a Python project; packages whose import marks a design decision; suffixes that a JavaScript import may leave out.
PROJECT_MARKERS = ["pyproject.toml", "setup.py", "setup.cfg"]
INFRA_PACKAGES = ["arq", "celery", "redis", "kafka", "sqlalchemy", "httpx", "requests", "boto3"]
JS_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def parent_dir(path: Column) -> Column:
    """GRF-05: the directory of a path, ROOT for none."""
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(path.contains("/"), F.substring(path, F.lit(1), cut)).otherwise(ROOT)


def nesting(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit("")))


def degrees(nodes: DataFrame, edges: DataFrame, internal: bool) -> DataFrame:
    """AGG-09 (edges between files only) and AGG-10 (all edges that touch a file): (id, degree) of all files, 0 for none."""
    files = nodes.where("kind = 'file'").select("id")
    if internal:
        edges = edges.join(files.withColumnRenamed("id", "source"), "source", "left_semi").join(files.withColumnRenamed("id", "target"), "target", "left_semi")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return files.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def diagram(nodes: DataFrame, edges: DataFrame, most_nodes: int = 30, most_edges: int = 60) -> tuple[DataFrame, DataFrame]:
    """TOP-04, JON-12: the best connected files by (-degree, id), and the edges among them by (source, target, kind)."""
    kept = degrees(nodes, edges, True).where("degree > 0").orderBy(F.desc("degree"), "id").limit(most_nodes)
    inner = edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    return kept, inner.select("source", "target", "kind").orderBy("source", "target", "kind").limit(most_edges)


def decision_points(nodes: DataFrame, edges: DataFrame, modules: DataFrame, infra: list[str] = INFRA_PACKAGES, most: int = 8, boost: int = 100) -> DataFrame:
    """TOP-05, AGG-11: files that import infrastructure (boosted) or are connected, by (-score, id); cut before modules are looked up, so fewer may come.

    modules(id, line_start, line_end).
    """
    used = edges.where((F.col("kind") == "imports_external") & F.col("target").startswith("external:")).select(F.col("source").alias("id"), F.regexp_replace("target", "^external:", "").alias("package"))
    used = used.where(F.col("package").isin(infra)).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("package")), ", ").alias("packages"))
    scored = degrees(nodes, edges, False).join(used, "id", "left").where("packages IS NOT NULL OR degree > 0")
    reason = F.when(F.col("packages").isNotNull(), F.concat(F.lit("imports infra package(s): "), "packages")).otherwise(F.concat(F.lit("fan-in+fan-out="), F.col("degree").cast("string")))
    scored = scored.select("id", (F.col("degree") + F.when(F.col("packages").isNotNull(), boost).otherwise(0)).alias("score"), reason.alias("reason"))
    return scored.orderBy(F.desc("score"), "id").limit(most).join(modules, "id")


def bounded_graph(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, reserve: int = 100, most_edges: int = 1000) -> tuple[DataFrame, DataFrame]:
    """TOP-03: files by id, with slots held back for external nodes next to any file and filled by those next to kept files; slots not used go back to files. Both tables are written once: the three steps read them."""
    nodes, edges = written(nodes.select("id", "kind"), "nodes"), written(edges.select("source", "target", "kind"), "edges")
    files, others = nodes.where("kind = 'file'").select("id", "kind"), nodes.where("kind <> 'file'").select("id", "kind")

    def next_to(some: DataFrame) -> DataFrame:
        ids = some.select("id")
        out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        return out.unionByName(back).distinct()

    candidates = others.join(next_to(files), "id", "left_semi")
    held = min(reserve, candidates.limit(reserve).count())
    kept = files.orderBy("id").limit(most_nodes - held)
    n_kept = kept.count()
    outside = written(candidates.join(next_to(kept), "id", "left_semi").orderBy("id").limit(most_nodes - n_kept), "externals")
    n_out = outside.count()
    kept = files.orderBy("id").limit(most_nodes - n_out)
    all_kept = written(kept.unionByName(outside), "bounded")
    inner = edges.join(all_kept.select(F.col("id").alias("source")), "source", "left_semi").join(all_kept.select(F.col("id").alias("target")), "target", "left_semi")
    return all_kept, inner.select("source", "target", "kind").orderBy("source", "target", "kind").limit(most_edges)


def bfs_depth(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """GRF-04: edges from the nearest entry for each file, UNREACHABLE for none. A join and an anti-join a level, as many levels as there are; each level is written, so the plan stays short, and adds files, so the loop ends."""
    files = nodes.where("kind = 'file'").select("id")
    steps = edges.join(files.withColumnRenamed("id", "source"), "source", "left_semi").join(files.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target").distinct()
    steps = written(steps, "steps")
    frontier = written(files.join(entries.select("id").distinct(), "id", "left_semi").withColumn("depth", F.lit(0)), "depth0")
    seen, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        reached = frontier.join(steps, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        frontier = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)), f"depth{level}")
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = written(seen, "seen")
    return files.join(seen, "id", "left").select("id", F.coalesce("depth", F.lit(UNREACHABLE)).alias("depth"))


def merge_groups(sizes: dict[str, int], least: int = 3, most: int = 20) -> dict[str, str]:
    """GRF-06, GRF-07: where each directory ends up. sizes: files of each directory.

    First, while a group other than ROOT has fewer than `least` files, the deepest
    such group (by name among equals) is folded into its parent, which may come
    into being by that. Then, while there are more than `most` groups, the smallest
    one (deeper first, then by name) is. Works on directories, not on files.
    """
    import heapq

    now = dict(sizes)
    # a group that is folded and comes into being again is another group: each has a number
    number, into, names = {k: i for i, k in enumerate(sizes)}, {}, list(sizes)
    up = lambda k: k.rsplit("/", 1)[0] if "/" in k else ROOT

    def fold(k: str) -> str:
        to = up(k)
        if to not in number:
            number[to] = len(names)
            names.append(to)
        now[to] = now.get(to, 0) + now.pop(k)
        into[number.pop(k)] = number[to]
        return to

    small = [(-k.count("/"), k) for k, n in now.items() if k != ROOT and n < least]
    heapq.heapify(small)
    while small:
        _, k = heapq.heappop(small)
        if k in now and now[k] < least:
            to = fold(k)
            if to != ROOT and now[to] < least:
                heapq.heappush(small, (-to.count("/"), to))
    by_size = [(n, -k.count("/"), k) for k, n in now.items() if k != ROOT]
    heapq.heapify(by_size)
    while len(now) > most and by_size:
        n, _, k = heapq.heappop(by_size)
        if now.get(k) != n:
            continue
        to = fold(k)
        if to != ROOT:
            heapq.heappush(by_size, (now[to], -to.count("/"), to))

    def end(i: int) -> str:
        while i in into:
            i = into[i]
        return names[i]

    return {k: end(i) for i, k in enumerate(sizes)}


def partition(nodes: DataFrame, depths: DataFrame, least: int = 3, most: int = 20, most_directories: int = 1_000_000) -> DataFrame:
    """GRF-08, AGG-16, TOP-10: (group, depth, files, ordinal), outside in by (depth, nesting, name), every file in one group.

    Only the counts of directories come to the driver, most_directories of them at most.
    """
    files = nodes.where("kind = 'file'").select("id", parent_dir(F.col("id")).alias("directory"))
    counts = files.groupBy("directory").agg(F.count("*").alias("n")).limit(most_directories + 1).collect()
    if len(counts) > most_directories:
        raise ValueError(f"more than {most_directories} directories")
    ends = merge_groups({r["directory"]: r["n"] for r in counts}, least, most)
    moved = files.sparkSession.createDataFrame(list(ends.items()) or [("", "")], "directory string, `group` string")
    grouped = files.join(moved, "directory").join(depths, "id", "left").groupBy("group").agg(F.min(F.coalesce("depth", F.lit(UNREACHABLE))).alias("depth"), F.count("*").alias("files"))
    return grouped.withColumn("ordinal", F.row_number().over(Window.orderBy("depth", nesting(F.col("group")), "group")))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """GRF-09: distinct edges between groups. An edge from a file without a group goes, an external target stays, one within a group goes.

    groups(id, group).
    """
    source, target = groups.select(F.col("id").alias("source"), F.col("group").alias("from")), groups.select(F.col("id").alias("target"), F.col("group").alias("to"))
    both = edges.join(source, "source").join(target, "target", "left").withColumn("to", F.coalesce("to", F.when(F.col("target").startswith("external:"), F.col("target"))))
    return both.where("to IS NOT NULL AND `from` <> to").select("from", "to").distinct()


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """GRF-10, SET-03: edges that came and went."""
    gone = before.subtract(after).withColumn("kind", F.lit("removed"))
    return after.subtract(before).withColumn("kind", F.lit("added")).unionByName(gone)


def neighbours(edges: DataFrame) -> DataFrame:
    """JON-16: for each file that has any, its distinct importers and what it imports within the repository, ascending."""
    inner = edges.where("kind = 'imports'")
    to = inner.groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_set("source")).alias("imported_by"))
    of = inner.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("imports"))
    none = F.array().cast("array<string>")
    return to.join(of, "id", "full_outer").select("id", F.coalesce("imported_by", none).alias("imported_by"), F.coalesce("imports", none).alias("imports"))


def mermaid(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """GRF-11, WIN-11: a diagram as one text. nodes(id), edges(source, target), labels(id, label) are bounded by diagram()."""
    from ..functions.text import fallback_label, sanitize_label

    numbered = nodes.join(labels, "id", "left").select("id", F.concat(F.lit("n"), F.row_number().over(Window.orderBy("id")) - 1).alias("node"), sanitize_label(F.coalesce("label", fallback_label(F.col("id")))).alias("label"))
    lines = numbered.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.format_string('    %s["%s"]', "node", "label").alias("line"))
    a, b = numbered.select(F.col("id").alias("source"), F.col("node").alias("x")), numbered.select(F.col("id").alias("target"), F.col("node").alias("y"))
    arrows = edges.select("source", "target").distinct().join(a, "source").join(b, "target").select(F.lit(2).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.format_string("    %s --> %s", "x", "y").alias("line"))
    return joined_lines(lines.unionByName(arrows), ["part", "a", "b"]).select(F.concat(F.lit("graph TD\n"), "text").alias("text"))


def joined_lines(lines: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """SNK-06, STR-27: the lines of each key as one text, in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(*(keys or [])).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def directory_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """GRF-12: (parts, depth, line): every directory and file once, in order of their parts, indented by depth."""
    parts = paths.select(F.split(path, "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", F.lit(1), n))).alias("parts"))
    depth = F.size("parts") - 1
    return parts.distinct().select("parts", depth.alias("depth"), F.concat(F.repeat(F.lit("  "), depth), F.element_at("parts", -1)).alias("line"))


def package_roots(paths: DataFrame, path: str = "path") -> DataFrame:
    """GRF-02: (root): '' and directories with a project marker, src/ beside those, and parents of the topmost packages."""
    files = paths.select(F.col(path).alias("path"), F.when(F.col(path).contains("/"), parent_dir(F.col(path))).otherwise("").alias("dir"), F.substring_index(path, "/", -1).alias("name"))
    marked = files.where(F.col("name").isin(PROJECT_MARKERS)).select(F.col("dir").alias("root")).distinct()
    marked = marked.unionByName(files.sparkSession.createDataFrame([("",)], "root string")).distinct()
    ups = files.select(F.split("dir", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("src")).distinct()
    beside = marked.select(F.when(F.col("root") == "", "src").otherwise(F.concat("root", F.lit("/src"))).alias("src")).join(ups, "src", "left_semi").select(F.col("src").alias("root"))
    packages = files.where("name = '__init__.py'").select("dir").distinct()
    # the topmost package above each: climb while the parent is a package too
    climb = packages.select("dir", F.posexplode(F.transform(F.sequence(F.size(F.split("dir", "/")), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))).alias("up", "prefix"))
    stop = climb.join(packages.withColumnRenamed("dir", "prefix").where("prefix <> ''"), "prefix", "left_anti").groupBy("dir").agg(F.min_by("prefix", "up").alias("root")).select("root")
    return marked.unionByName(beside).unionByName(stop).distinct()


def module_map(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """GRF-03: (module, path): names as seen from '' win, then those from deeper roots, then by root; the last path of one name and root '' stands, the first elsewhere."""
    files = paths.select(F.col(path).alias("path")).where(F.col(path).endswith(".py") | F.col(path).endswith(".pyi"))
    ups = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("root"))
    under = ups.join(roots.select("root").distinct(), "root", "left_semi")
    stem = F.regexp_replace(F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)")), r"\.[^./]*$", "")
    named = under.withColumn("module", F.replace(F.regexp_replace(stem, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))).where("module <> ''")
    top = F.col("root") == ""
    w = Window.partitionBy("module").orderBy(top.desc(), nesting(F.col("root")).desc(), "root", F.when(top, F.col("path")).desc(), "path")
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("module", "path")


def normal_path(path: Column) -> Column:
    """STR-23: '.' goes, '..' takes the part before it, at the root it goes too; '.' for nothing left."""
    stack = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p)))
    out = F.array_join(stack, "/")
    return F.when(out == "", ".").otherwise(out)


def external_name(raw: Column) -> Column:
    """GRF-01: the package of a bare import: two segments after '@', else one."""
    return F.when(raw.startswith("@") & raw.contains("/"), F.substring_index(raw, "/", 2)).otherwise(F.substring_index(raw, "/", 1))


def build(files: DataFrame, imports: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-01, JON-07..10, AGG-17: nodes and distinct edges.

    files(path, language); imports(path, raw, kind, names, level) with kind one of
    py_plain, py_from, js_relative, js_bare. Relative imports that resolve to
    nothing go; absolute ones become external nodes.
    """
    known = written(module_map(files.where("language = 'python'"), roots), "modules")
    i = imports.withColumn("import_id", F.xxhash64("path", "raw", "kind", "names", "level"))
    py = i.where("kind IN ('py_plain', 'py_from')").withColumn("base", F.when(F.col("level") > 0, relative_base(F.col("path"), F.col("level"), F.col("raw"))).otherwise(F.col("raw")))
    from_ = prefer_submodules(py.where("kind = 'py_from' AND base IS NOT NULL").select("import_id", "base", "names").distinct(), known.select("module", "path"))
    # a relative import names its module exactly, an absolute one may lead below it
    rest = py.join(from_.select("import_id").distinct(), "import_id", "left_anti").where("level = 0")
    rest = longest_prefix(rest.withColumnRenamed("path", "source"), "base", known.withColumnRenamed("path", "found"), "module", "found")
    js = i.where("kind = 'js_relative'").withColumn("base", normal_path(F.concat(F.when(F.col("path").contains("/"), F.concat(parent_dir(F.col("path")), F.lit("/"))).otherwise(""), "raw")))
    js = first_match(js.withColumnRenamed("path", "source"), "base", files.select("path"), "path", JS_SUFFIXES)
    inner = py.select("import_id", F.col("path").alias("source")).distinct().join(from_, "import_id").select("source", F.col("path").alias("target"))
    inner = inner.unionByName(rest.where("found IS NOT NULL").select("source", F.col("found").alias("target"))).unionByName(js.where("target IS NOT NULL").select("source", "target"))
    package = F.when(F.col("kind") == "js_bare", external_name(F.col("raw"))).otherwise(F.substring_index("raw", ".", 1))
    outer = rest.where("found IS NULL").select("source", "kind", "raw").unionByName(i.where("kind = 'js_bare'").select(F.col("path").alias("source"), "kind", "raw"))
    outer = outer.select("source", F.concat(F.lit("external:"), package).alias("target"), F.lit("imports_external").alias("kind"))
    edges = inner.withColumn("kind", F.lit("imports")).unionByName(outer).dropDuplicates(["source", "target", "kind"])
    nodes = files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), "language").unionByName(outer.select(F.col("target").alias("id"), F.lit("external").alias("kind"), F.lit(None).cast("string").alias("language")).distinct())
    return nodes, edges


def matched(pairs: DataFrame, key: str) -> DataFrame:
    """GRF-13: (key, id, drawn): the stable matching of pairs(key, id, drawn, like): no two nodes without each other would both be better off together.

    Of two pairs the one with more `like` is better, then the one with the lesser id, then drawn. In each
    round the pairs that are the best of both their nodes are matched and all others of these nodes
    go; the best of the pairs left is always matched, so rounds end. Each round is one written table of its matches and of the pairs left.
    """
    left, out, turn = written(pairs.select(key, "id", "drawn", "like"), "pairs"), [], 0
    w = lambda node, *more: Window.partitionBy(key, node).orderBy(F.desc("like"), "id", "drawn", *more)
    taken = lambda node: F.max("_best").over(Window.partitionBy(key, node))
    while not left.isEmpty():
        turn += 1
        # rows that are alike in all are told apart by _a, so that one of them is the first in both orders
        placed = left.withColumn("_a", F.row_number().over(w("id"))).withColumn("_b", F.row_number().over(w("drawn", "_a")))
        placed = placed.withColumn("_best", (F.col("_a") == 1) & (F.col("_b") == 1)).withColumn("_gone", taken("drawn")).withColumn("_gone", F.col("_gone") | taken("id"))
        turned = written(placed.where("_best OR NOT _gone").select(key, "id", "drawn", "like", "_best"), f"matched{turn}")
        out.append(turned.where("_best").select(key, "id", "drawn"))
        left = turned.where("NOT _best").drop("_best")
    return reduce(DataFrame.unionByName, out) if out else left.select(key, "id", "drawn")


def grade_drawing(nodes: DataFrame, edges: DataFrame, drawn_nodes: DataFrame, drawn_edges: DataFrame, key: str, alike: float = 0.8, penalty: float = 0.1) -> DataFrame:
    """GRF-13: (key, node_share, edge_share, extraneous, score) of drawings against reference graphs.

    nodes(key, id, label), edges(key, source, target). Reference nodes are matched to
    drawn ones by labels (one less the edit distance over the longer length, at
    least `alike`), see matched(): a node that loses its first choice gets its next. An edge is found if both ends are and the drawn
    edge has its direction. Score: 0.6 of the edges' share and 0.4 of the nodes',
    less `penalty` times the share of what is drawn without a counterpart, in 0 to
    1. A reference without edges counts as found in its edges.
    """
    low, size = F.lower("label").alias("_low"), F.length(F.lower("label")).alias("_size")
    nodes, drawn_nodes = (written(n.select(key, "id", "label").distinct(), name) for n, name in ((nodes, "nodes"), (drawn_nodes, "drawn")))
    edges, drawn_edges = (e.select(key, "source", "target").distinct() for e in (edges, drawn_edges))
    drawn = drawn_nodes.select(F.col(key), F.col("id").alias("drawn"), F.lower("label").alias("_as"), F.length(F.lower("label")).alias("_long"))
    longer = F.greatest("_size", "_long", F.lit(1))
    pairs = nodes.select(key, "id", low, size).join(drawn, key).where(F.abs(F.col("_size") - F.col("_long")) <= F.lit(1 - alike) * longer + F.lit(1e-9))
    # the distance need not be known beyond what is alike (-1 there, one more for rounding)
    most = (F.floor(F.lit(1 - alike) * longer) + 1).cast("int")
    apart = F.when(F.col("_low") == F.col("_as"), 0).otherwise(F.nullif(F.call_function("levenshtein", F.col("_low"), F.col("_as"), most), F.lit(-1)))
    pairs = pairs.withColumn("like", 1 - apart / longer).where(F.col("like") >= alike)
    best = matched(pairs.select(key, "id", "drawn", "like"), key)
    # matches are one to one, so that each edge and each drawn edge is one row of the outer join
    ends = edges.join(best.select(key, F.col("id").alias("source"), F.col("drawn").alias("_source")), [key, "source"], "left").join(best.select(key, F.col("id").alias("target"), F.col("drawn").alias("_target")), [key, "target"], "left")
    ends = ends.select(key, F.col("_source").alias("source"), F.col("_target").alias("target"), F.lit(True).alias("_edge"))
    both = ends.join(drawn_edges.withColumn("_arrow", F.lit(True)), [key, "source", "target"], "full_outer")
    names = ["_nodes", "_edges", "_met", "_found", "_drawn", "_arrows"]
    flags = lambda df, **on: df.select(key, *[on.get(n, F.lit(False)).alias(n) for n in names])
    edge, arrow, known = F.col("_edge").isNotNull(), F.col("_arrow").isNotNull(), F.col(key).isNotNull()
    seen = flags(nodes, _nodes=F.lit(True)).unionByName(flags(best, _met=F.lit(True))).unionByName(flags(drawn_nodes.where(known), _drawn=F.lit(True)))
    seen = seen.unionByName(flags(both.where(known), _edges=edge, _arrows=arrow, _found=edge & arrow))
    out = seen.groupBy(key).agg(*[F.count_if(F.col(n)).alias(n) for n in names]).where("_nodes > 0")
    node_share = F.col("_met") / F.col("_nodes")
    edge_share = F.when(F.col("_edges") > 0, F.col("_found") / F.col("_edges")).otherwise(1.0)
    extra = F.col("_drawn") - F.col("_met") + F.col("_arrows") - F.col("_found")
    score = 0.6 * edge_share + 0.4 * node_share - F.lit(penalty) * (extra / F.greatest(F.col("_drawn") + F.col("_arrows"), F.lit(1)))
    return out.select(key, node_share.alias("node_share"), edge_share.alias("edge_share"), extra.alias("extraneous"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
