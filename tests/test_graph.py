import random
from collections import Counter

from pyspark.sql import functions as F
from quillforge.operators import extract as E
from quillforge.operators import graph as G
from quillforge.operators import joins as J


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def parent(directory):
    return directory.rsplit("/", 1)[0] if "/" in directory else G.ROOT


def small_folded(sizes, least):
    """Where directories end up by the first rule alone, bottom-up: the deepest level first, each level's small groups hand all they hold to their parents."""
    held = {d: {d} for d in sizes}
    files = Counter(sizes)
    for depth in range(max((d.count("/") for d in sizes), default=0), -1, -1):
        for d in [d for d in held if d != G.ROOT and d.count("/") == depth and files[d] < least]:
            to = parent(d)
            held.setdefault(to, set()).update(held.pop(d))
            files[to] += files.pop(d)
    return {d: group for group, ds in held.items() for d in ds}


def test_small_directories_are_folded_level_by_level():
    assert G.merge_groups({"a/b/c": 2, "a/b": 2, "a": 3}) == {"a/b/c": "a/b", "a/b": "a/b", "a": "a"}
    for dirs in random_trees(9, 300):
        assert G.merge_groups(dirs, 3, 1 << 30) == small_folded(dirs, 3), dirs


def test_merged_directories_hold_to_their_bounds():
    """Every directory in one group, itself or one above it; no small group but the root; no more groups than allowed unless the root alone is left; the folded ones were no larger than those kept."""
    for dirs in random_trees(10, 300):
        for most in (1, 3, 20):
            got = G.merge_groups(dirs, 3, most)
            assert set(got) == set(dirs)
            assert all(g == d or g == G.ROOT or d.startswith(f"{g}/") for d, g in got.items())
            files = Counter()
            for d, g in got.items():
                files[g] += dirs[d]
            assert all(n >= 3 for g, n in files.items() if g != G.ROOT)
            assert len(files) <= most or set(files) == {G.ROOT}
            first = small_folded(dirs, 3)
            if len(set(first.values())) <= most:
                assert got == first
            whole = Counter()
            for d, g in first.items():
                whole[g] += dirs[d]
            kept = {g for g in files if g in whole and files[g] == whole[g] and g != G.ROOT}
            gone = {g for g in whole if g != G.ROOT and got[next(d for d in first if first[d] == g)] != g}
            assert not gone or not kept or min(whole[g] for g in gone) <= min(whole[g] for g in kept)


def random_trees(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        dirs = {"/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 6) for _ in range(rng.randint(0, 40))}
        if rng.random() < 0.5:
            dirs[G.ROOT] = 2
        yield dirs


def graph(spark, edges, files, externals=()):
    nodes = spark.createDataFrame([(f, "file") for f in files] + [(x, "external") for x in externals], "id string, kind string")
    return nodes, spark.createDataFrame([(a, b, "imports_external" if b.startswith("external:") else "imports") for a, b in edges], "source string, target string, kind string")


def test_bfs_partition_and_contraction(spark):
    files = ["main.py", "x/a.py", "x/b.py", "x/c.py", "x/d/e.py", "y/f.py"]
    nodes, edges = graph(spark, [("main.py", "x/a.py"), ("x/a.py", "x/d/e.py"), ("x/d/e.py", "x/a.py"), ("x/b.py", "external:z"), ("x/a.py", "y/f.py")], files, ["external:z"])
    depth = G.bfs_depth(nodes, edges, spark.createDataFrame([("main.py",), ("gone.py",)], "id string"))
    assert dict(rows(depth)) == {"main.py": 0, "x/a.py": 1, "x/d/e.py": 2, "y/f.py": 2, "x/b.py": G.UNREACHABLE, "x/c.py": G.UNREACHABLE}
    assert [tuple(r) for r in G.partition(nodes, depth).orderBy("ordinal").collect()] == [(G.ROOT, 0, 2, 1), ("x", 1, 4, 2)]
    groups = spark.createDataFrame([("x/a.py", "x"), ("x/d/e.py", "x"), ("y/f.py", "y"), ("x/b.py", "x")], "id string, `group` string")
    assert rows(G.contract(edges, groups)) == [("x", "external:z"), ("x", "y")]


def plain_bounded(files, externals, edges, most, reserve):
    adjacent = lambda ids: {b for a, b in edges if a in ids} | {a for a, b in edges if b in ids}
    cand = [x for x in sorted(externals) if x in adjacent(set(files))]
    kept = sorted(files)[: most - min(reserve, len(cand))]
    out = [x for x in cand if x in adjacent(set(kept))][: most - len(kept)]
    return set(sorted(files)[: most - len(out)]) | set(out)


def test_bounded_graph_against_plain_version(spark):
    rng = random.Random(2)
    for _ in range(3):
        files, ext = [f"f{i:02}" for i in range(12)], [f"external:{i}" for i in range(6)]
        edges = list({(rng.choice(files), rng.choice(files + ext)) for _ in range(15)})
        nodes, e = graph(spark, edges, files, ext)
        kept, inner = G.bounded_graph(nodes, e, 8, 3, 5)
        want = plain_bounded(files, ext, edges, 8, 3)
        assert {r.id for r in kept.collect()} == want
        assert rows(inner.select("source", "target")) == sorted((a, b) for a, b in edges if a in want and b in want)[:5]


def test_decision_points_cut_before_lookup(spark):
    nodes, edges = graph(spark, [("a", "external:redis"), ("a", "external:numpy"), ("b", "c"), ("d", "c")], ["a", "b", "c", "d"], ["external:redis", "external:numpy"])
    modules = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "id string, line_start int, line_end int")
    got = rows(G.decision_points(nodes, edges, modules, most=2))
    assert got == [("a", 102, "imports infra package(s): redis", 1, 2)]


def test_python_imports_resolve(spark):
    src = {
        "app/__init__.py": "", "app/main.py": "import app.api.repos\nfrom app import db\nimport numpy.linalg\n", "app/db.py": "x = 1\n", "app/api/__init__.py": "from . import repos\n",
        "app/api/repos.py": "from ..db import session\nfrom ... import nothing\nfrom .missing import a\n", "web/a.ts": 'import b from "./b";\nimport r from "react-dom/x";\nconst q = require("@s/p/q");\nimport z from "./gone";\n', "web/b/index.ts": "export const v = 1;\n",
    }
    files = spark.createDataFrame([(p, "python" if p.endswith("py") else "typescript", t) for p, t in src.items()], "path string, language string, text string")
    imports = E.imports(E.parse(files))
    nodes, edges = G.build(files.select("path", "language"), imports, G.package_roots(files))
    assert rows(edges.select("source", "target")) == [
        ("app/api/__init__.py", "app/api/repos.py"), ("app/api/repos.py", "app/db.py"), ("app/main.py", "app/api/repos.py"), ("app/main.py", "app/db.py"), ("app/main.py", "external:numpy"),
        ("web/a.ts", "external:@s/p"), ("web/a.ts", "external:react-dom"), ("web/a.ts", "web/b/index.ts"),
    ]
    assert {r.id for r in nodes.where("kind = 'external'").collect()} == {"external:numpy", "external:@s/p", "external:react-dom"}


def test_roots_and_modules(spark):
    paths = spark.createDataFrame([("backend/pyproject.toml",), ("backend/src/pkg/__init__.py",), ("backend/src/pkg/sub/__init__.py",), ("backend/src/pkg/m.py",), ("lib/q/__init__.py",), ("m.py",)], "path string")
    roots = G.package_roots(paths)
    assert rows(roots) == [("",), ("backend",), ("backend/src",), ("lib",)]
    got = dict(rows(G.module_map(paths, roots)))
    assert got["pkg.m"] == got["src.pkg.m"] == got["backend.src.pkg.m"] == "backend/src/pkg/m.py" and got["m"] == "m.py" and got["q"] == "lib/q/__init__.py"


def test_diffs(spark):
    kind = "key string, name string, members array<string>"
    before = spark.createDataFrame([("a", "A", ["1", "2"]), ("b", "B", ["3"]), ("c", "C", ["4"])], kind)
    after = spark.createDataFrame([("a", "renamed", ["2", "1", "1"]), ("c", "C2", ["4", "5"]), ("d", "D", [])], kind)
    got = {(r.kind, r.key, r.name, tuple(r.gained), tuple(r.lost)) for r in J.diff_members(before, after, "key", "members", "name").collect()}
    assert got == {("removed", "b", "B", (), ("3",)), ("changed", "c", "C2", ("5",), ()), ("added", "d", "D", (), ())}
    cards = "decision string, ev array<string>"
    b = spark.createDataFrame([("x", ["p", "q"]), ("w", ["q", "p"]), ("y", ["r"])], cards)
    a = spark.createDataFrame([("w", ["p", "q"]), ("y", ["s"])], cards)
    got = rows(J.diff_by_evidence(b, a, "ev", "decision").select("kind", "decision"))
    assert got == [("added", "y"), ("removed", "y"), ("same", "w")]


def test_rendering(spark):
    nodes = spark.createDataFrame([("a/my_mod.py",), ("b.py",)], "id string")
    edges = spark.createDataFrame([("a/my_mod.py", "b.py")], "source string, target string")
    labels = spark.createDataFrame([("b.py", 'The "B"\n[x]')], "id string, label string")
    assert G.mermaid(nodes, edges, labels).first().text == 'graph TD\n    n0["My Mod"]\n    n1["The B x"]\n    n0 --> n1'
    tree = G.directory_tree(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string")).orderBy("parts").collect()
    assert [r.line for r in tree] == ["a", "  b", "    c.py", "  d.py", "e.py"]


def test_relative_base_climbs_no_further_than_the_root(spark):
    df = spark.createDataFrame([("a/b/c.py", 1, "."), ("a/b/c.py", 2, "..x.y"), ("a/b/c.py", 3, "..."), ("a/b/c.py", 4, "....")], "p string, l int, r string")
    assert [r[0] for r in df.select(G.relative_base(F.col("p"), F.col("l"), F.col("r"))).collect()] == ["a.b", "a.x.y", "", None]


def test_bfs_follows_a_long_chain_to_its_end(spark):
    """As many levels as there are; a file beside the chain is not reached."""
    from quillforge.operators.graph import bfs_depth

    nodes = spark.createDataFrame([(f"n{i}", "file") for i in range(26)], "id string, kind string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)], "source string, target string")
    entries = spark.createDataFrame([("n0",)], "id string")
    assert {r.id: r.depth for r in bfs_depth(nodes, edges, entries).collect()} == {f"n{i}": i for i in range(25)} | {"n25": 1 << 30}


def test_matching_is_stable(spark):
    """Equal to taking the best pair left again and again; a chain where each loses its first choice to the one before."""
    rng = random.Random(6)
    pairs = [("chain", i, i + d, 1 - (2 * i + d) / 100) for i in range(12) for d in (0, 1)]
    for k in range(40):
        pairs += list({(f"q{k}", i, d): (f"q{k}", i, d, rng.choice([0.8, 0.85, 0.9, 1.0])) for i in range(rng.randint(1, 5)) for d in range(rng.randint(1, 5)) if rng.random() < 0.7}.values())
    want = set()
    for q in {p[0] for p in pairs}:
        taken = set()
        for _, i, d, _ in sorted((p for p in pairs if p[0] == q), key=lambda p: (-p[3], p[1], p[2])):
            if not {("i", i), ("d", d)} & taken:
                taken |= {("i", i), ("d", d)}
                want.add((q, i, d))
    assert set(rows(G.matched(spark.createDataFrame(pairs, "q string, id long, drawn long, like double"), "q"))) == want
    assert G.matched(spark.createDataFrame([], "q string, id long, drawn long, like double"), "q").count() == 0


def test_drawings(spark):
    """A missing edge and a mislabelled node; labels alike; two reference nodes like one drawn node; nothing drawn; no edges."""
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    nodes = frame([("a", 1, "Auth Service"), ("a", 2, "Database"), ("a", 3, "Worker"), ("b", 1, "Cache 1"), ("b", 2, "Cache 2"), ("c", 1, "Alone"), ("d", 1, "Never drawn")], "q string, id long, label string")
    edges = frame([("a", 1, 2), ("a", 2, 3), ("b", 1, 2)], "q string, source long, target long")
    drawn = frame([("a", 10, "auth servise"), ("a", 20, "database"), ("a", 30, "something else"), ("b", 10, "Cache 2"), ("c", 10, "alone")], "q string, id long, label string")
    arrows = frame([("a", 10, 20), ("a", 30, 20)], "q string, source long, target long")
    got = {r.q: (round(r.node_share, 6), round(r.edge_share, 6), r.extraneous, round(r.score, 6)) for r in G.grade_drawing(nodes, edges, drawn, arrows, "q").collect()}
    assert got == {
        "a": (round(2 / 3, 6), 0.5, 2, round(0.3 + 0.4 * 2 / 3 - 0.1 * 2 / 5, 6)), "b": (0.5, 0.0, 0, 0.2), "c": (1.0, 1.0, 0, 1.0), "d": (0.0, 1.0, 0, 0.6),
    }
