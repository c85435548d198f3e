import json
import subprocess

import pytest
from pyspark.sql import functions as F

from treeloom.functions import scalars as S
from treeloom.operators import graph, history, ledger, text
from treeloom.plans.corpus import Corpus, greedy_pack
from treeloom.sources import git, sink
from treeloom.sources.tree import load_settings, read_tree, stale
from treeloom.streaming import watch

SERVICE = '''
from src.db import db
from src.emailer import send_welcome_email

class UserService:
    def create_user(self, email: str) -> dict:
        user = db.users.create(email)
        send_welcome_email(email)
        return user

    def delete_user(self, user_id: str) -> None:
        db.users.delete(user_id)
'''
FILES = {
    "src/services/user_service.py": SERVICE,
    "src/controllers/user_controller.py": "\nfrom src.services.user_service import UserService\n\ndef create_user_controller(request):\n    return UserService().create_user(request.email)\n",
    "src/routes/user_routes.py": '\nfrom src.controllers.user_controller import create_user_controller\n\nROUTES = {"POST /api/users": create_user_controller}\n',
    "src/db.py": "\nclass Users:\n    def create(self, e): pass\n    def delete(self, i): pass\nclass DB:\n    users = Users()\ndb = DB()\n",
    "src/emailer.py": "\ndef send_welcome_email(email):\n    pass\n",
    "tests/test_user_service.py": "\nfrom src.services.user_service import UserService\n\ndef test_create_user():\n    assert UserService\n",
    "web/app.js": "import {a} from './lib';\nexport class Page {\n  draw(x) {\n    return x;\n  }\n}\n",
    "web/lib.js": "export const a = (x) => x;\nfunction b() {\n  return 1;\n}\n",
    "go/main.go": "package main\nfunc (s *Server) Run(a int) {\n}\ntype Server struct {\n}\n",
    "danger.py": 'import subprocess\npassword = "abcdefghijklmnop"\nsubprocess.run("x", shell=True)\neval("1")\n',
    "quiet.py": '"""password = "abcdefghijklmnop" """\n# eval(1)\n',
    "broken.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    for path, body in FILES.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(body)
    (at / "node_modules").mkdir()
    (at / "node_modules/x.js").write_text("class Hidden {}")
    (at / "src/__init__.py").write_text("")
    for args in (["init", "-q"], ["config", "user.email", "a@b.com"], ["config", "user.name", "A"], ["add", "src", "tests"], ["commit", "-qm", "one"]):
        subprocess.run(["git", *args], cwd=at, check=True)
    return str(at)


@pytest.fixture(scope="module")
def corpus(spark, root, tmp_path_factory):
    """Scanned, stored and loaded."""
    where = str(tmp_path_factory.mktemp("stored") / "corpus")
    Corpus.scan(spark, root).save(where)
    return Corpus.load(spark, where)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_scan_and_manifest(spark, root):
    files = read_tree(spark, root)
    assert {r.path for r in files.collect()} == {*FILES, "src/__init__.py"}
    kept = files.select("path", "size", "mtime")
    assert stale(kept, kept).count() == 0
    assert rows(stale(kept.where("path <> 'src/db.py'"), kept.where("path <> 'src/emailer.py'")), "path", "state") == [("src/db.py", "new"), ("src/emailer.py", "deleted")]


def test_symbols_and_edges(corpus):
    own = corpus.symbols.where("path = 'src/services/user_service.py'")
    assert rows(own, "name", "kind", "line", "end_line", "signature") == [("UserService", "class", 5, 12, "class UserService"), ("UserService.create_user", "method", 6, 9, "def create_user(self, email: str) -> dict"), ("UserService.delete_user", "method", 11, 12, "def delete_user(self, user_id: str) -> None")]
    edges = set(rows(corpus.deps, "src", "dst"))
    assert {("src/services/user_service.py", "src/db.py"), ("src/services/user_service.py", "src/emailer.py"), ("src/controllers/user_controller.py", "src/services/user_service.py"), ("tests/test_user_service.py", "src/services/user_service.py"), ("web/app.js", "web/lib.js")} <= edges
    assert not any(d == "danger.py" for _, d in edges)
    kinds = {r.path: r.analyzer for r in corpus.files.collect()}
    assert kinds["web/app.js"] == "syntax_scan" and kinds["broken.py"] == "regex" and kinds["src/db.py"] == "python_ast"
    assert ("Page.draw", "method") in rows(corpus.symbols.where("path = 'web/app.js'"), "name", "kind")
    assert ("(*Server).Run", "method") in rows(corpus.symbols.where("path = 'go/main.go'"), "name", "kind")


def test_labels(corpus):
    assert rows(corpus.side_effects.where("path like 'src/%'"), "path", "label") == [("src/services/user_service.py", "DB write")]
    assert {r.label for r in corpus.findings.where("path = 'danger.py'").collect()} == {"possible hardcoded secret", "unsafe eval/exec", "shell=True command execution"}
    assert corpus.findings.where("path = 'quiet.py'").count() == 0
    assert rows(corpus.routes, "route", "handler") == [("POST /api/users", "create_user_controller")]


def test_questions(corpus):
    assert [r.path for r in corpus.map().limit(1).collect()] == ["src/services/user_service.py"]
    assert sum(r.total for r in corpus.search("UserService").dropDuplicates(["path"]).collect()) == 3
    assert rows(corpus.tests(F.col("path") == "src/services/user_service.py"), "test") == [("tests/test_user_service.py",)]
    chain = corpus.callgraph("POST /api/users").collect()
    assert [(r.class_name, r.method_name, r.inferred, r.side_effects) for r in chain] == [("UserService", "create_user", False, ["DB write"])]
    risk = {r.path: r for r in corpus.risk().collect()}
    assert risk["src/services/user_service.py"].impact == "MEDIUM" and risk["src/db.py"].impact == "HIGH"
    body = corpus.slice("UserService.create_user").first()
    assert body.body.startswith("    def create_user") and (body.line, body.end_line) == (6, 9)
    assert corpus.read("src/services/user_service.py").first().dependent_paths == ["src/controllers/user_controller.py", "tests/test_user_service.py"]
    assert {r.relation for r in corpus.symbol("UserService").collect()} == {"definition", "caller", "test"}
    assert {(r.relation, r.path) for r in corpus.symbol("db.users.delete").collect()} == {("text match", "src/services/user_service.py")}
    assert corpus.slice("Nobody.create_user").first().name == "UserService.create_user"
    shown = corpus.uses("send_welcome_email").collect()
    assert len(corpus.uses("send_welcome_email", include_definitions=True).collect()) == len(shown) + 1
    refs = corpus.callgraph("UserService").collect()
    assert {r.path for r in refs} >= {"tests/test_user_service.py"} and refs[0].side_effects == ["DB write"]
    assert corpus.read("src/db.py").first().role == "data/model layer" and corpus.read("src/db.py").first().trust == "python_ast/high"
    assert corpus.read("tests/test_user_service.py").first().role == "test coverage"
    assert corpus.uses("UserService").count() >= 2 and corpus.api("src").count() >= 5 and corpus.flow("src/services/user_service.py").count() == 1
    assert corpus.budget(top=3).count() == 3 and corpus.languages().count() >= 3
    assert corpus.languages().where("is_primary").first().lang == "Python" and tuple(corpus.counts().first()) == (len(FILES) + 1, 1)
    assert [r.label for r in corpus.effects_of("POST /api/users").collect()] == ["DB write"]
    packed = corpus.pack("src/services/user_service.py").collect()
    assert packed[0].relation == "target" and "likely-test" in {r.relation for r in packed}


def test_snapshot(spark, root, corpus, tmp_path):
    new = Corpus.of(spark.createDataFrame([(p, t + ("def brand_new_helper(x: int) -> int:\n    return x\n" if p == "src/emailer.py" else "")) for p, t in FILES.items()], "path string, text string"))
    assert ("src/emailer.py", "brand_new_helper", "added") in rows(new.sdiff(corpus).where("status = 'added'"), "path", "name", "status")
    where = str(tmp_path / "stored")
    corpus.save(where)
    assert Corpus.load(spark, where).files.count() == corpus.files.count()
    landing = tmp_path / "landing"
    landing.mkdir()
    event = spark.createDataFrame([("2024-01-01T00:00:00", "src/emailer.py", "delete", None), ("2024-01-01T00:00:01", "src/new_one.py", "upsert", "from src.db import db\n")], "ts string, path string, kind string, text string")
    event.coalesce(1).write.mode("append").json(str(landing / "e"))
    watch.watch(spark, str(landing / "e"), where, str(tmp_path / "cp")).awaitTermination(120)
    after = Corpus.load(spark, watch.current(spark, where))
    paths = {r.path for r in after.files.select("path").collect()}
    assert "src/new_one.py" in paths and "src/emailer.py" not in paths
    last = Corpus.load(spark, watch.current(spark, where))
    assert last.symbols.count() == after.symbols.count()
    assert ("src/new_one.py", "src/db.py") in rows(after.deps, "src", "dst") and not after.deps.where("dst = 'src/emailer.py'").count()


def test_history(spark, root):
    commits = git.commit_files(spark, root)
    assert commits.where("path = 'src/db.py'").count() == 1
    churned = history.churn(commits)
    assert history.hot_threshold(churned).first().threshold == 3
    assert history.neighbors(commits, "src/db.py").count() == 6
    blame = git.blame(spark, root, "src/services/user_service.py", 6, 9)
    own = history.ownership(blame).first()
    assert (own.author, own.lines, own.per_mille) == ("A", 4, 1000)
    assert ("danger.py",) in rows(git.changed(spark, root), "path") and git.status(spark, root).count() > 0
    assert git.commit_files(spark, "/nonexistent").count() == 0 and git.since_argument("90d") == ["--since=90 days ago"]


@pytest.mark.parametrize(("counts", "threshold"), [([], 3), ([2], 3), ([9] * 3, 9), ([10, 8, *[1] * 7], 10), ([10, 8, *[1] * 8], 8), ([10, 8, *[1] * 9], 8)])
def test_threshold(spark, counts, threshold):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(counts)], "path string, commits long")
    assert history.hot_threshold(df).first().threshold == threshold


def test_scalars(spark):
    every = "a\nb\r\nc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k\n"
    df = spark.createDataFrame([(every,), ("",), (" \x1c clé  ",)], "t string")
    got = [r[0] for r in df.select(S.lines(F.col("t"))).collect()]
    assert got[0] == every.splitlines() and got[1] == []
    assert df.select(S.strip(F.col("t"))).collect()[2][0] == "clé"
    paths = spark.createDataFrame([("src/click/testing.py",), ("main.rs",), ("auth_test.rs",), ("Tests/a.py",), ("a.java",), ("Makefile",)], "p string")
    assert [tuple(r) for r in paths.select(S.is_test(F.col("p")), S.language(F.col("p"))).collect()] == [(False, "Python"), (False, "Rust"), (True, "Rust"), (True, "Python"), (False, "java"), (False, "text")]
    assert [r[0] for r in df.select(S.tokens(F.col("t"))).collect()] == [max(1, len(every) // 4), 0, max(1, len(" \x1c clé  ") // 4)]


def test_ledger(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"ts": 1.0, "command": "hook: cat a.py -> t read a.py", "raw_tokens": 10, "output_tokens": 4, "saved_tokens": 6}\nnot json\n{"ts": 1.0, "command": "hook: cat a.py -> t read a.py", "raw_tokens": 10, "output_tokens": 4, "saved_tokens": 6}\n')
    found = ledger.totals(ledger.once(ledger.read(spark, str(tmp_path / "h.json")))).first()
    assert (found.commands, found.saved_tokens, found.saved_per_mille) == (1, 6, 600)
    cases = {"cat a.py": "treeloom read a.py", "tail -f a.py": None, "cat a.py b.py": None, "grep foo": "treeloom search foo", "grep -r foo": None, "find .": "treeloom map", "git status": "treeloom status", "git log": None, "pytest -q": "treeloom test pytest -q", "npm test": "treeloom test npm test", "cat a.py | wc": None, "!raw cat a.py": "cat a.py", "": None}
    df = ledger.rewritten(spark.createDataFrame([(c,) for c in cases], "command string"))
    assert {r.command: r.rewritten for r in df.collect()} == cases


def test_greedy_skips_and_continues(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([50, 60, 30, 25, 20])] + [("h", 0, 500), ("h", 1, 1)], "g string, o int, c long")
    assert rows(text.greedy(df, "g", ["o"], "c", 100), "g", "o") == [("g", 0), ("g", 2), ("g", 4), ("h", 0)]
    packed = greedy_pack(spark.createDataFrame([("a" * 400, 0, "target", "source", None), ("b", 1, "dependent", "source", ["x"]), ("c" * 900, 2, "dependent", "source", None)], "path string, rank int, relation string, role string, says array<string>"), 120)
    assert [r.path[0] for r in packed.collect()] == ["a", "b"]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[index]\nextra_test_dirs = ["QA"]\n[side_effects]\ncustom_rules = [{pattern = "kafka", label = "Queue"}, {pattern = "(", label = "bad"}]\n')
    found = load_settings(str(tmp_path / "c.toml"))
    assert found.test_dirs == ("qa",) and found.side_effects == (("kafka", "Queue"),) and len(found.problems) == 1
    assert load_settings(str(tmp_path / "none.toml")).problems == ()


def test_containment_of_any_number_of_parts(spark, tmp_path):
    """More items than one block of hashes, short, empty, null and repeated ones, and texts across step and row ends."""
    from treeloom.plans import catalog

    items = [(i, f"question {i:05d}: what is it worth, {'ä漢' * (i % 3)} all told?") for i in range(10_050)]
    items += [(20_000, "worth"), (20_001, ""), (20_002, None), (20_003, items[9][1]), (20_004, "question 00009: what is it worth, but"), (20_005, "x" * 24), (20_006, "one row ends and the next begins")]
    docs = [(i, f"é {items[i * 70][1]} then {items[10_049 - i][1]} and {items[i][1]}") for i in range(140)]
    docs += [(1, "é " + items[5][1]), (300, None), (301, ""), (302, "x" * 24), (303, "x" * 23), (304, "one row ends and"), (305, " the next begins"), (None, items[7][1])]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted((i, -1 if d is None else d) for i, item in items for d, own in docs if item is not None and own is not None and item in own)
    said = lambda df: sorted((r[0], -1 if r[1] is None else r[1]) for r in df.collect())
    assert said(catalog.tests_for_match(spark, str(tmp_path))) == want
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet")).withColumnRenamed("text", "item")
    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert said(text.holding(own, bench, part="item", block=900).select("item_id", "doc_id")) == want


def sources(spark, **files):
    return Corpus.of(spark.createDataFrame([(p.replace("__", "."), t) for p, t in files.items()], "path string, text string"))


def test_relative_imports_take_the_first_candidate(spark):
    """Scripts before typed ones, an index before a package, the name itself before all; a script's extension may stand for another source."""
    texts = {"a/x.jsx": "", "a/x.ts": "", "a/p/index.js": "", "a/p/__init__.py": "", "a/y.ts": "", "a/z.css": "", "a/z.css.py": "", "a/main.js": "import './x'; import './p'; import './y.js'; import './z.css'; import '../a/x';"}
    files = spark.createDataFrame([(p,) for p in texts], "path string")
    raw = spark.createDataFrame([("a/main.js", i, 0, t) for i, t in enumerate(["./x", "./p", "./y.js", "./z.css", "../a/x", "../../x"])], "path string, pos int, level int, target string")
    assert rows(graph.resolve(raw, files), "src", "dst") == [("a/main.js", d) for d in ("a/p/index.js", "a/x.jsx", "a/y.ts", "a/z.css")]


def test_signatures(spark):
    got = sources(spark, m__py="def f(a, b=1, *c, d: int = 2, **e): pass\ndef g(a, /, b: str, *, c=None) -> int: pass\nasync def h(): pass\n")
    assert [r.signature for r in got.symbols.orderBy("line").collect()] == ["def f(a, b = 1, *c, d: int = 2, **e)", "def g(a, /, b: str, *, c = None) -> int", "def h()"]


def test_references_by_scope(spark):
    body = """import a.helper as h
from b import helper
def one(helper):
    return helper()
def two(x):
    x += helper
    return lambda helper: helper
def three():
    q[helper] = 1
    *helper, rest = x
    return h(1), helper
def four():
    del helper
    return helper
@helper
class K(helper):
    y = helper
z.helper
"""
    got = sources(spark, m__py=body)
    assert [r.line for r in got.references("helper").collect()] == [6, 9, 11, 16, 17, 18]


def test_calls_outside_python(spark):
    got = sources(spark, web__js="function run(req) {\n  const s = 1;\n  svc = Service(req);\n  svc.start();\n  new Page(req).draw();\n  Cache.clear();\n  other.go();\n}\nclass Page {\n  draw(x) {\n    return 1;\n  }\n}\n")
    assert [tuple(r) for r in got.calls.select("symbol", "class_name", "method_name", "inferred").orderBy("class_name").collect()] == [("run", "Cache", "clear", False), ("run", "Page", "draw", False), ("run", "Service", "start", True)]
    refs = sources(spark, a__go='package a\n// Widget here\nfunc f() {\n  x := "Widget"\n  Widget(x)\n}\n')
    assert [r.line for r in refs.references("Widget").collect()] == [5]


def test_comments_but_not_strings_are_stripped(spark):
    """What looks like a comment inside a string is none, in any language; a hash begins one where the language says so."""
    texts = [
        (".js", 'fetch("https://x/y"); // gone\nlet a = "#no"; /* gone\n too */ b = `//${a}`;', 'fetch("https://x/y"); \nlet a = "#no";  b = `//${a}`;'),
        (".rb", "a = '#no' # gone\nb // c", "a = '#no' \nb // c"), (".go", "a := '\"' // gone\nb # c", "a := '\"' \nb # c"),
        (".php", "a # gone\nb // gone", "a \nb "), (".rs", "fn f<'a>(x: &'a str) // it's gone", "fn f<'a>(x: &'a str) "), (".js", '"' + "x" * 30_000 + '\\"' * 500 + '" // gone', '"' + "x" * 30_000 + '\\"' * 500 + '" '),
    ]
    df = spark.createDataFrame(texts, "ext string, t string, want string")
    assert all(r[0] == r[1] for r in df.select(S.without_comments(F.col("t"), F.col("ext")), "want").collect())
    assert rows(sources(spark, a__js='fetch("https://example.org/x")').side_effects, "path", "label") == [("a.js", "Network call")]


def test_trust_and_analogues(spark):
    df = spark.createDataFrame([("python_ast",), ("syntax_scan",), ("regex",)], "a string")
    assert [r[0] for r in df.select(S.precision_label(F.col("a"))).collect()] == ["python_ast/high", "syntax_aware/medium", "heuristic/low"]
    cases = {"t read a.py": "cat a.py", "t map": "find . -maxdepth 3 -type f", "t symbol X": "(no direct shell equivalent — would have required multiple grep+sed)", "t pack x": "(equivalent of) t pack x", "t": "t"}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", ledger.raw_analogue(F.col("c")).alias("a")).collect()
    assert {r.c: r.a for r in got} == cases


def test_greedy_of_a_null_group(spark):
    df = spark.createDataFrame([(None, i, 60) for i in range(4)] + [(7, 0, 60), (7, 1, 40)], "g long, o int, c long")
    assert sorted((r.g or -1, r.o) for r in text.greedy(df, "g", ["o"], "c", 100).collect()) == [(-1, 0), (7, 0), (7, 1)]


def test_primary_language_of_ties(spark):
    df = spark.createDataFrame([("ab",), ("a",), ("Z",), ("ab",), ("a",)], "lang string")
    assert [r.lang for r in text.histogram(df).where("is_primary").collect()] == ["a"]


def brute_tests(paths, tests, imports):
    out = set()
    for p in paths:
        stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        base = stem.replace("test_", "").lower().replace("_", "")
        module = "/".join(x.lower().replace("_", "") for x in p.rsplit(".", 1)[0].split("/") if x not in ("src", "lib"))
        for t in tests:
            name = t.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower().replace("_", "")
            whole = "/".join(x.lower().replace("_", "") for x in t.rsplit(".", 1)[0].split("/") if x not in ("tests", "test", "spec"))
            own = name[4:] if name.startswith("test") else name
            if (t, p) in imports or (base and own == base) or (module and module in whole) or (len(base) >= 4 and base in name):
                out.add((p, t))
    return out


def test_tests_for_equals_the_plain_rules(spark):
    import random

    r = random.Random(3)
    bits = ["db", "user", "a", "feed", "feedback", "api_v2", "Auth", "x_y", "src", "lib"]
    paths = sorted({"/".join(r.choice(bits) for _ in range(r.randrange(3))) + f"/{r.choice(bits)}{r.choice(bits)}.py" for _ in range(60)} | {"src/db.py", "db.py", "lib/api_v2/user.py"})
    paths = [p.lstrip("/") for p in paths]
    tests = sorted({r.choice(["tests/", "spec/", "pkg/tests/"]) + "/".join(r.choice(bits) for _ in range(r.randrange(3))) + f"/test_{r.choice(bits)}_{r.choice(bits)}.py" for _ in range(40)})
    tests = [t.replace("//", "/") for t in tests]
    files = spark.createDataFrame([(p, False) for p in {*paths}] + [(t, True) for t in {*tests}], "path string, is_test boolean")
    imports = [(r.choice(tests), r.choice(paths)) for _ in range(10)]
    got = set(rows(graph.tests_for(files, spark.createDataFrame(imports, "src string, dst string")), "path", "test"))
    assert got == brute_tests({*paths, *tests}, {*tests}, {*imports})


def test_cochange_of_large_commits(spark):
    df = spark.createDataFrame([(1, f"p{i:03d}") for i in range(40)] + [(2, "p001"), (2, "p002"), (3, "p001")], "commit int, path string")
    whole, cut = (rows(history.cochange(df, 10_000, b), "a", "b", "co_changes") for b in (500, 7))
    assert whole == cut and len(whole) == 780 and ("p001", "p002", 2) in whole


def test_cochange_tasks_do_not_grow_with_the_pairs(spark, monkeypatch):
    import itertools
    import random
    from collections import Counter

    monkeypatch.setattr(history, "TASK_ROWS", 2000, raising=False)
    r = random.Random(5)
    commits = {c: sorted(r.sample(range(3000), 100 if c == 7 else 20)) for c in range(400)}
    given = [(c, p) for c, paths in commits.items() for p in paths + paths[:2]] + [(None, 1), (None, 2), (1, None), (2, None)]
    pairs = Counter(x for paths in commits.values() for x in itertools.combinations(paths, 2))
    sc = spark.sparkContext
    sc.setJobGroup("cochange tasks", "")
    got = [tuple(x) for x in history.cochange(spark.createDataFrame(given, "commit long, path long"), 50, 30).collect()]
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == sorted(((*x, n) for x, n in pairs.items()), key=lambda x: (-x[2], x[0], x[1]))[:50]
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("cochange tasks") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    tasks = [t.taskMetrics().get() for s in stages for ts in [sc._jsc.sc().statusStore().taskList(s, 0, 10_000)] for t in map(ts.apply, range(ts.size()))]
    most = max(max(m.shuffleReadMetrics().recordsRead(), m.shuffleWriteMetrics().recordsWritten()) for m in tasks)
    assert len(pairs) > 70_000 and sum(m.shuffleWriteMetrics().recordsWritten() for m in tasks) > 70_000 and most < 8500  # 8,804 rows are given, by 4 tasks


def test_review_preflight_impact_and_diff_pack(spark, root, corpus):
    base = corpus
    more = {**FILES, "src/emailer.py": FILES["src/emailer.py"] + "def brand_new_helper(x: int) -> int:\n    return x\n", "src/services/user_service.py": SERVICE.replace("email: str) -> dict", "email: str, name = None) -> dict")}
    new = Corpus.of(spark.createDataFrame(list(more.items()), "path string, text string"))
    commits = git.commit_files(spark, root)
    chosen = new.selected(spark.createDataFrame([("src/emailer.py",), ("src/services/user_service.py",), ("danger.py",), ("gone.py",)], "path string"))
    got = {r.path: r for r in new.review(base, chosen, commits, security=True).collect()}
    assert [tuple(x) for x in got["src/emailer.py"].changed_symbols] == [("brand_new_helper", "added")]
    service = got["src/services/user_service.py"]
    assert [tuple(x) for x in service.changed_symbols] == [("UserService.create_user", "signature")] and service.risks == ["DB write"] and service.tests == ["tests/test_user_service.py"]
    assert service.summary == "1 changed symbols; side effects: DB write" and got["gone.py"].summary == "not indexed" and got["gone.py"].analyzer is None
    assert len(got["danger.py"].findings) == 3 and not any(r.findings for r in new.review(base, chosen, commits).collect())
    impact = {r.path: r for r in new.impact(chosen, commits).collect()}
    assert (impact["src/services/user_service.py"].risk, impact["src/services/user_service.py"].commits) == ("MEDIUM", 1) and impact["danger.py"].risk == "LOW"
    assert new.impact(new.selected(target="src/db.py")).first().risk == "HIGH"
    flight = new.preflight("src/services/user_service.py", commits).first()
    assert flight.checks == ["pytest tests/test_user_service.py"] and len(flight.neighbors) == 3 and flight.blast_radius == "MEDIUM" and flight.symbols == 3
    assert new.preflight("danger.py").first().checks == ["review security flags before editing"] and new.preflight("gone.py").count() == 0
    changes = [(r.path, r.risk_points, r.level) for r in new.changes(base, chosen, commits, security=True).collect()]
    assert changes == [("src/services/user_service.py", 5, "HIGH"), ("danger.py", 5, "HIGH"), ("src/emailer.py", 3, "MEDIUM")]
    packed = new.diff_pack(base, chosen, commits, security=True).collect()
    assert [r.path for r in packed] == [c[0] for c in changes]
    assert "signature UserService.create_user" in packed[0].rendered


def test_blame_show_and_status(spark, root, corpus):
    row = corpus.blame("UserService.create_user", git.blame(spark, root, "src/services/user_service.py")).first()
    assert (row.author, row.lines, row.per_mille) == ("A", 4, 1000) and row.newest_commit
    assert rows(git.show(spark, root, "HEAD", ["src/__init__.py", "nowhere.py", "src/emailer.py"]), "path", "text") == [("src/__init__.py", ""), ("src/emailer.py", FILES["src/emailer.py"])]
    assert sum(r.files for r in git.status_counts(git.status(spark, root)).collect()) == git.status(spark, root).count()
    assert git.commit_files(spark, root, most=1).count() == 7 and spark.read.format("git_log").option("commitsPerPartition", "1").load(root).count() == 7


def test_changed_paths_that_are_gone(spark, tmp_path):
    for args in (["init", "-q"], ["config", "user.email", "a@b.com"], ["config", "user.name", "A"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    for args in (["add", "."], ["commit", "-qm", "one"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    (tmp_path / "a.py").unlink()
    (tmp_path / "b.py").write_text("x = 2\n")
    (tmp_path / "c.py").write_text("")
    assert rows(git.changed(spark, str(tmp_path)), "path") == [("b.py",), ("c.py",)]
    assert rows(git.changed(spark, str(tmp_path), "HEAD", spark.createDataFrame([("a.py",), ("z.py",)], "path string")), "path") == [("a.py",), ("b.py",), ("c.py",)]


def test_gain_scopes_and_sinks(spark, tmp_path):
    one, two = str(tmp_path / "repo"), str(tmp_path / "all")
    line = spark.createDataFrame([(1.0, "map", 100, 40, 60, "r"), (2.0, "read", 50, 50, 0, "r")], ledger.SCHEMA)
    ledger.append(line, one, two)
    ledger.append(spark.createDataFrame([(3.0, "map", 10, 0, 10, "q")], ledger.SCHEMA), two)
    assert [ledger.gain(spark, s, one, two).count() for s in ("repo", "global", "all")] == [2, 3, 3]
    shown = ledger.shown(ledger.gain(spark, "repo", one, two)).first()
    assert (shown.commands, shown.saved_per_mille, shown.bar) == (2, 400, "█" * 9 + "░" * 15)
    said = json.loads(sink.document(line.select("command", "repo").orderBy("command"), "gain", scope="repo").first().value)
    assert said == {"command": "gain", "scope": "repo", "rows": [{"command": "map", "repo": "r"}, {"command": "read", "repo": "r"}]}
    sink.write(line.select("raw_tokens"), "gain", str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["raw_tokens"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [50, 100]
    assert [r.value for r in sink.text_lines(line.select("command").limit(1), "gain").collect()] == ["# gain", "- command: map"]


def test_polling_moves_and_refusal(spark, tmp_path):
    tree, where = tmp_path / "tree", str(tmp_path / "stored")
    tree.mkdir()
    (tree / "a.py").write_text("x = 1\n")
    (tree / "b.py").write_text("import a\n")
    Corpus.scan(spark, str(tree)).save(where)
    stored = lambda: Corpus.load(spark, watch.current(spark, where))
    assert watch.polled(spark, str(tree), where).count() == 0 and stored().freshness(spark, str(tree)).count() == 0
    (tree / "a.py").unlink()
    (tree / "c.py").write_text("import b\n")
    assert rows(stored().freshness(spark, str(tree)), "state", "files") == [("deleted", 1), ("new", 1)]
    watch.apply(spark, watch.polled(spark, str(tree), where), where)
    assert rows(stored().files, "path") == [("b.py",), ("c.py",)] and rows(stored().deps, "src", "dst") == [("c.py", "b.py")]
    assert watch.polled(spark, str(tree), where).count() == 0
    events = spark.createDataFrame([("b.py", "move", "x = 1\n", "d.py")], "path string, kind string, text string, moved_to string").withColumn("ts", F.current_timestamp())
    watch.apply(spark, watch.relevant(watch.steps(events)), where)
    assert rows(stored().files, "path") == [("c.py",), ("d.py",)] and len(watch.versions(spark, where)) == 2
    stored().files.drop("confidence").write.parquet(str(tmp_path / "old/files"))
    for name in ("symbols", "imports", "raw_imports", "refs", "calls", "routes", "side_effects", "findings", "deps"):
        stored().tables[name].write.parquet(str(tmp_path / "old" / name))
    with pytest.raises(ValueError, match="files.confidence"):
        Corpus.load(spark, str(tmp_path / "old"))


def test_bursts(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00", "a"), ("u", "2024-01-01 00:00:00.4", "b"), ("u", "2024-01-01 00:00:02", "a"), ("v", "2024-01-01 00:00:00.2", "c")], "by string, ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.by, r.paths, r.events) for r in watch.debounced(df, "by").collect()) == [("u", ["a"], 1), ("u", ["a", "b"], 2), ("v", ["c"], 1)]
    assert [r.paths for r in watch.debounced(df).orderBy("began").collect()] == [["a", "b", "c"], ["a"]]
